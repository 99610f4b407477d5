"""Line dedup: lines that many documents hold stay in the first of them alone (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chartspan.llm.common import SPACES, text_or_empty, written

#: Keys of fewer code points are never dropped; keys in fewer documents neither.
MIN_CHARS, MIN_DOCS = 10, 2


def key_of(line: Column) -> Column:
    """What two lines have to share: the line without white space at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(SPACES)), ascii_uppercase, ascii_lowercase)


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_id, _t1, _t2, _at, _k1, _k2): the lines of (_id, _text) that are long enough, by the place in their text, as two independent
    64-bit hashes of the key. _t1, _t2 are the text's own, so that different texts of one id are told apart."""
    text = text_or_empty("_text")
    split = docs.select("_id", F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2"), F.posexplode(F.split(text, "\n", -1)).alias("_at", "_line"))
    keyed = split.select("_id", "_t1", "_t2", "_at", key_of(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    return keyed.select("_id", "_t1", "_t2", "_at", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(1), "_key").alias("_k2"))


@F.pandas_udf(StringType())
def _without(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The texts without the lines of the given places; null stays null."""

    def rest(text, places):
        gone = set(places)
        return "\n".join([line for at, line in enumerate(text.split("\n")) if at not in gone])

    for text, places in texts:
        yield pd.Series([None if t is None else rest(t, p) for t, p in zip(text, places)], dtype=object)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with shared lines dropped from their texts, and two columns more: n_lines (before) and n_dropped, both long.

    A line's key is the line without white space at both ends and with A-Z in lower case. Keys of at least min_chars code points in at
    least min_docs (two or more) documents lose all their lines but those in the document of smallest id; what stays is joined
    by line ends in its order. A null text counts as one empty line and stays null; an empty text is one empty line. Rows of one id
    are one document, whatever their texts: repeated rows all keep, or all lose, a line. A null id is one document, too, after
    all others. Other columns stay, but one named n_lines or n_dropped gives way. An empty table gives no rows.

    Only hashes and places of lines are shuffled for the counts, with partial sums; a text moves once, to meet its places to drop. The
    lines and the shared keys are written, so a key of many lines is a plain join side that adaptive execution splits.
    """
    if min_docs < 2:
        raise ValueError("a line is shared by two documents at least")
    named = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    held = written(lines(named.select("_id", "_text"), min_chars), "lines")
    nameless = F.max(F.col("_id").isNull().cast("int"))
    counted = held.groupBy("_k1", "_k2").agg(F.count_distinct("_id").alias("_n"), nameless.alias("_null"), F.min("_id").alias("_first"))
    shared = written(counted.where(F.col("_n") + F.col("_null") >= min_docs).select("_k1", "_k2", "_first"), "shared-lines")
    late = held.join(shared, ["_k1", "_k2"]).where(~F.col("_id").eqNullSafe(F.col("_first")))
    # rows of one id and text each had their lines exploded, so a place may come more than once
    gone = written(late.groupBy("_id", "_t1", "_t2").agg(F.sort_array(F.collect_set("_at")).alias("_gone")), "dropped-lines")
    text = text_or_empty("_text")
    own = named.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(1), text)})
    same = [own["_id"].eqNullSafe(gone["_id"]), own["_t1"] == gone["_t1"], own["_t2"] == gone["_t2"]]
    met = own.join(gone, same, "left").select(own["_row"], own["_text"], gone["_gone"])
    fewer = F.coalesce(_without(F.when(F.col("_gone").isNotNull(), F.col("_text")), F.col("_gone")), F.col("_text"))
    n_lines = F.size(F.split(text, "\n", -1)).cast("long")
    kept = [fewer.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return met.select(*kept, n_lines.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
