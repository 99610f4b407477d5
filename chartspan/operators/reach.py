"""All pairs of codes of which one reaches the other, with the fewest levels between them: an index for closures of any depth.

Doubling: pairs up to k levels apart and those exactly k apart give, joined, all pairs up to 2k apart, so a hierarchy of depth d
takes about log2(d) rounds. Each round writes only what is new. Cycles need no care: a pair is kept at its fewest levels alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspan.operators import ontology
from chartspan.session import or_none, written


@dataclass
class Reach:
    """pairs(code, reached, level) of level one and more; edges(child, parent) that they go along; up tells the direction."""

    pairs: DataFrame
    edges: DataFrame
    up: bool = True

    def save(self, path: str) -> None:
        """Pairs clustered by code, so that a lookup reads the row groups of its codes; the mark comes last, so that a half-written index
        is never taken for a whole one."""
        self.pairs.repartitionByRange("code").sortWithinPartitions("code").write.mode("overwrite").parquet(f"{path}/pairs")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        self.edges.sparkSession.createDataFrame([(self.up,)], "up boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/whole")

    @classmethod
    def load(cls, spark, path: str) -> Reach | None:
        """The index stored at path, or None."""
        mark = or_none(lambda: spark.read.parquet(f"{path}/whole"))
        if mark is None:
            return None
        up = mark.first()["up"]
        return cls(spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/edges"), up)


def build(edges: DataFrame, concepts: DataFrame, up: bool = True, vocabularies: list[str] | None = None) -> Reach:
    """Of edges(child, parent): what every code reaches going up, or down. Codes that aren't in concepts or in none of the vocabularies are
    not entered, nor gone through; a code they start from needs neither."""
    near, far = ("child", "parent") if up else ("parent", "child")
    known = concepts.select(F.col("code").alias(far)).distinct()
    open_ = written(edges.select("child", "parent").distinct().join(known, far, "left_semi").where(ontology._allowed(F.col(far), vocabularies)), "open-edges")
    fresh = written(open_.where("child <> parent").select(F.col(near).alias("code"), F.col(far).alias("reached"), F.lit(1).alias("level")), "reach")
    pairs, k = fresh, 1
    while True:
        exact = fresh.where(F.col("level") == k).select("code", F.col("reached").alias("middle"))
        further = pairs.select(F.col("code").alias("middle"), "reached", (F.col("level") + k).alias("level"))
        met = exact.join(further, "middle").where("code <> reached").groupBy("code", "reached").agg(F.min("level").alias("level"))
        fresh = written(met.join(pairs, ["code", "reached"], "left_anti"), "reach")
        if fresh.isEmpty():
            return Reach(pairs, open_, up)
        pairs, k = pairs.unionByName(fresh), 2 * k


def closure(index: Reach, starts: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ontology.closure()'s (nodes, links) of starts(code), as lookups: one join of the starts with the pairs, however deep they reach."""
    near, far = ("child", "parent") if index.up else ("parent", "child")
    roots = starts.select(F.col("code").alias("root")).where("root is not null").distinct()
    seen = roots.select("root", F.col("root").alias("code"), F.lit(0).alias("level"))
    seen = seen.unionByName(index.pairs.join(roots.withColumnRenamed("root", "code"), "code").select(F.col("code").alias("root"), F.col("reached").alias("code"), "level"))
    nodes = seen.join(concepts, "code", "left").select("root", "code", "level", F.coalesce("description", "code").alias("description"), (F.col("level") == 0).alias("is_start"))
    links = seen.select("root", F.col("code").alias(near)).join(index.edges, near).select("root", "child", "parent").distinct()
    return nodes, links


def metadata_of(nodes: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Each code of a subgraph's nodes(root, code, ...) once per root, with description, vocabulary, parents and whether it is known."""
    codes = ontology.metadata(nodes.select("code").distinct(), concepts, edges)
    return nodes.select("root", "code").distinct().join(codes, "code")
