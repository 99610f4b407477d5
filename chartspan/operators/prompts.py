"""Prompts under a token budget, text quality, structured summaries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.functions.text import estimated_tokens, head_tail

HEAD, NEXT, DIVIDER, QUERY = "\n\nEXAMPLES:\n\n", "\n\n", "\n\n---", "\n\nNEW PATIENT:\n\n"


def assembled(queries: DataFrame, examples: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """queries(prompt_id, header, query) and examples(prompt_id, pos, text) -> (prompt_id, prompt, n_dropped, query_cut).

    While a prompt is over the budget its largest example goes, the first of equal ones; all gone, the query is cut to its head
    and tail. Which examples stay follows from a running sum over each prompt's examples by size."""
    size = F.length("text") + len(NEXT)
    w = Window.partitionBy("prompt_id").orderBy(F.desc(estimated_tokens(F.col("text"))), "pos")
    framed = queries.withColumn("_base", F.length("header") + F.length("query") + len(QUERY))
    total = F.sum(size).over(Window.partitionBy("prompt_id"))
    gone_before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = examples.join(framed.select("prompt_id", "_base"), "prompt_id")
    # the prompt as it is when the turn comes to this example, frame of the examples included
    left = F.col("_base") + total - gone_before - len(NEXT) + len(HEAD) + len(DIVIDER)
    fits = F.lit(True) if max_tokens is None else F.floor(left / 4) <= max_tokens
    rows = rows.withColumn("_keep", fits)
    kept = rows.groupBy("prompt_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_keep"), F.struct("pos", "text")))), lambda x: x["text"]), NEXT).alias("_examples"), F.count_if("_keep").alias("_n"), F.count_if(~F.col("_keep")).alias("n_dropped")
    )
    both = framed.join(kept, "prompt_id", "left").na.fill({"_n": 0, "n_dropped": 0})
    middle = F.when(F.col("_n") > 0, F.concat(F.lit(HEAD), "_examples", F.lit(DIVIDER))).otherwise("")
    frame = F.length("header") + F.length(middle) + len(QUERY)
    query, cut = F.col("query"), F.lit(False)
    if max_tokens is not None:
        room = F.greatest(F.lit(64), max_tokens - F.floor(frame / 4) - 16) * 4
        cut = F.floor((frame + F.length("query")) / 4) > max_tokens
        half = F.greatest(F.lit(1), F.floor((room - 20) / 2)).cast("int")
        query = F.when(cut & (F.length("query") > room), F.concat(F.left("query", half), F.lit(" [truncated] "), F.right(F.col("query"), half))).otherwise(F.col("query"))
    return both.select("prompt_id", F.concat("header", middle, F.lit(QUERY), query).alias("prompt"), "n_dropped", cut.alias("query_cut"))


def head_tail_tokens(c: Column, tokens: int) -> Column:
    return head_tail(c, 4 * tokens)


def text_quality(c: Column, procedure: str, result: str, quantity: str, trajectory: str) -> Column:
    """A struct of sentence counts by the four patterns and `passes`: two sentences with results, at most half with a procedure
    and no result, and a quantity or a trajectory."""
    sentences = F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    n = F.size(sentences)
    n_result = F.size(F.filter(sentences, lambda s: s.rlike(result)))
    only = F.size(F.filter(sentences, lambda s: s.rlike(procedure) & ~s.rlike(result)))
    has_q, has_t = c.rlike(quantity), c.rlike(trajectory)
    share = F.when(n > 0, F.round(only / n, 3)).otherwise(1.0)
    return F.struct(n.alias("n_sentences"), n_result.alias("n_result"), only.alias("n_procedure_only"), share.alias("procedure_only"), has_q.alias("has_quantity"), has_t.alias("has_trajectory"), ((n_result >= 2) & (share <= 0.5) & (has_q | has_t)).alias("passes"))


#: How a missing value is written, and the keys of a field's value and of its description.
MISSING = {"", "null", "none", "n/a", "na", "unknown", "not available", "not documented", "missing", "not found"}
VALUE_KEYS = {"value", "extracted_value"}
SCHEMA_KEYS = {"field_name", "extraction_instructions", "format", "missing_value", "description", "type", "extraction_guidance", "name", "rubric_name", "query"}
_BULLET = re.compile(r"\*\*([^*]+?)\*\*:?\s+(.*)")


def rubric_sizes(text: str) -> tuple[int, int, int, int]:
    """(schema characters, value characters, fields, missing values) of JSON field lists, nested JSON or marked-up bullets."""
    body = re.sub(r"```(?:json)?\n?|```", "", text).strip()
    try:
        tree = json.loads(body)
    except ValueError:
        tree = None
    schema: list[str] = []
    values: list[str] = []

    def visit(node: object, key: str, named: bool) -> None:
        """named: values stand under keys of their own; otherwise every leaf is one."""
        if isinstance(node, dict):
            for k, v in node.items():
                if not named:
                    schema.append(k)
                visit(v, k.lower(), named)
        elif isinstance(node, list):
            for v in node:
                visit(v, key if not named else "", named)
        elif not named or key in VALUE_KEYS:
            values.append(str(node))
        else:
            schema.append(str(node))

    if isinstance(tree, (dict, list)) and tree:
        fields = tree if isinstance(tree, list) else tree.get("fields")
        if isinstance(fields, list) and all(isinstance(x, dict) for x in fields):
            for x in fields:
                values += [str(v) for k, v in x.items() if k.lower() in VALUE_KEYS]
                schema += [str(v) for k, v in x.items() if k.lower() in SCHEMA_KEYS]
            if isinstance(tree, dict):
                schema += [str(tree[k]) for k in ("rubric_name", "query") if k in tree]
            return sum(map(len, schema)), sum(map(len, values)), len(fields), sum(v.strip().lower() in MISSING for v in values)
        visit(tree, "", bool(re.search(r'"value"\s*:', body, re.IGNORECASE)))
    else:
        for line in text.split("\n"):
            m = _BULLET.search(line)
            if m and m[2].strip():
                schema.append(m[1].strip().rstrip(":"))
                values.append(m[2].strip())
            else:
                schema.append(line)
        if not values:
            return len(text), 0, 0, 0
    return sum(map(len, schema)), sum(map(len, values)), len(values), sum(v.strip().lower() in MISSING for v in values)


def with_rubric_sizes(rows: DataFrame, text: str) -> DataFrame:
    """rows with schema_chars, value_chars, n_fields, n_missing and value_ratio, v / (s + v + 1)."""

    @F.pandas_udf("schema_chars long, value_chars long, n_fields long, n_missing long")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([rubric_sizes(t or "") for t in s], columns=["schema_chars", "value_chars", "n_fields", "n_missing"])

    out = rows.withColumn("_m", sizes(F.col(text))).select("*", "_m.*").drop("_m")
    return out.withColumn("value_ratio", F.col("value_chars") / (F.col("schema_chars") + F.col("value_chars") + 1))
