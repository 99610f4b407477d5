"""Text search that forgives typing errors: words within a few edits, or begun by the last word of the query, by joins alone.

Every term is filed under what is left of its first letters when up to two of them are deleted. Two words within n edits share
such a rest, each with at most n letters deleted, so an equality join finds all candidates and an edit distance confirms them:
no word is compared with the whole vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.functions.text import terms as terms_of
from chartspan.session import written

#: Letters of a word that deletions are taken from: edits beyond them show as well, as the first letters then differ by no more edits.
HEAD = 8
#: Letters from which a query's word may have one error, and two.
ONE, TWO = 5, 9
#: Rows of the queries' matched terms that are sent to all executors, at about 100 bytes each; beyond, they are shuffled.
SENT_ROWS = 1 << 19


@dataclass
class TypoIndex:
    """postings(term, doc), terms(term), rests(rest, term). Postings of an index that isn't stored are a plan over the texts: a search reads
    few of them, and splitting texts again costs less than to write every word of every document."""

    postings: DataFrame
    terms: DataFrame
    rests: DataFrame

    def save(self, path: str) -> None:
        """Each table clustered by what it is looked up by."""
        for name, key in (("postings", "term"), ("terms", "term"), ("rests", "rest")):
            getattr(self, name).distinct().repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> TypoIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "rests")))


def _one_less(word: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.transform(at, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))


def rests(word: Column, edits: Column) -> Column:
    """The word's head with up to `edits` letters deleted, two at most, each rest once."""
    head = F.left(word, F.lit(HEAD))
    none = F.array(head)
    one = F.when(edits >= 1, _one_less(head)).otherwise(F.array().cast("array<string>"))
    two = F.when(edits >= 2, F.flatten(F.transform(_one_less(head), _one_less))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(none, one, two))


def allowed(word: Column) -> Column:
    """Errors that a query's word may have."""
    return F.when(F.length(word) >= TWO, 2).when(F.length(word) >= ONE, 1).otherwise(0)


def build(docs: DataFrame, doc: str, *texts: str) -> TypoIndex:
    """An index of the words of the text columns, or arrays of texts. A document without a word is in no result. A document that comes
    twice has some postings twice. docs should be a table, not a long plan: its texts are split at each use."""
    fields = [F.array_join(c, " ") if docs.schema[c].dataType.typeName() == "array" else F.col(c).cast("string") for c in texts]
    words = F.array_distinct(terms_of(F.concat_ws(" ", *fields)))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows = docs.select(F.col(doc).alias("doc"), words.alias("words"))
    if docs.rdd.getNumPartitions() < cores:
        rows = written(docs.select(*dict.fromkeys([doc, *texts])).repartition(cores), "typo-texts").select(F.col(doc).alias("doc"), words.alias("words"))
    postings = rows.select("doc", F.explode("words").alias("term"))
    terms = written(postings.select("term").distinct(), "typo-terms")
    # a query's word has one letter fewer at least than its term has with one error, two with two
    most = F.when(F.length("term") >= TWO - 2, 2).when(F.length("term") >= ONE - 1, 1).otherwise(0)
    return TypoIndex(postings, terms, written(terms.select(F.explode(rests(F.col("term"), most)).alias("rest"), "term"), "typo-rests"))


def matched(index: TypoIndex, words: DataFrame) -> DataFrame:
    """(word, last, term, cost) of distinct words(word, last): cost 2 for each error, 1 for a term that a last word merely begins. Of several
    ways the cheapest."""
    words = words.withColumn("allowed", allowed(F.col("word")))
    near = words.withColumn("rest", F.explode(rests(F.col("word"), F.col("allowed")))).join(index.rests, "rest").select("word", "last", "term", "allowed").distinct()
    near = near.withColumn("edits", F.levenshtein("word", "term")).where("edits <= allowed").select("word", "last", "term", (2 * F.col("edits")).alias("cost"))
    begun = index.terms.where(F.length("term") > 1).select("term", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("term") - 1, F.lit(1))), lambda n: F.left("term", n))).alias("word"))
    begun = begun.join(words.where("last"), "word").select("word", "last", "term", F.lit(1).alias("cost"))
    return near.unionByName(begun).groupBy("word", "last", "term").agg(F.min("cost").alias("cost"))


def search(index: TypoIndex, queries: DataFrame, query: str, text: str, k: int | None, all_begun: bool = False) -> DataFrame:
    """(query, doc, edits, begun, rank): documents that hold a match of every word of the query, fewest errors first, then fewest words that are
    merely begun, then by document; the k best, or all. The last word may be merely begun, with all_begun each word. A query
    without a word finds nothing."""
    found = terms_of(F.col(text))
    asked = queries.select(F.col(query).alias("query"), F.size(found).alias("n"), F.posexplode(found).alias("at", "word"))
    asked = written(asked.withColumn("last", F.lit(True) if all_begun else F.col("at") == F.col("n") - 1), "asked-words")
    terms = written(matched(index, asked.select("word", "last").distinct()), "matched-terms")
    # a document's cost for a word is that of its best term; words are sent to the postings where they fit, so that these need not move
    wanted = written(asked.join(terms, ["word", "last"]).select("term", "query", "n", "at", "cost"), "wanted-terms")
    wanted = F.broadcast(wanted) if wanted.count() <= SENT_ROWS else wanted
    hits = index.postings.join(wanted, "term").groupBy("query", "n", "doc", "at").agg(F.min("cost").alias("cost"))
    each = hits.groupBy("query", "n", "doc").agg(F.count(F.lit(1)).alias("held"), F.sum(F.floor(F.col("cost") / 2)).alias("edits"), F.sum(F.col("cost") % 2).cast("long").alias("begun"))
    rows = each.where("held = n").select("query", "doc", "edits", "begun")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("edits", "begun", "doc")))
    return rows if k is None else rows.where(F.col("rank") <= k)
