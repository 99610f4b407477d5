"""What several operators share: the shared folder, written intermediate tables, block pairs, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.session import shared_dir, written  # noqa: F401  the operators take both from here

#: Words are runs of characters that are none of these.
SPACES = " \t\n\x0b\x0c\r"


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def in_block_pairs(members: DataFrame, key: list[str], order: Column, block: int) -> DataFrame:
    """Deals the rows of each key to comparison groups of at most about 2 * block rows, so that any two rows of a key meet.

    Adds `chunk`, `pair_lo`, `pair_hi`. A key of up to `block` rows stays whole (0, 0). A larger one is hashed by `order` into chunks of
    about `block` rows and each chunk meets each: a row is copied once per chunk, never once per row. The counts of large keys are
    written first, so that the planner knows their size: few go to all tasks, and of many a hot key's side can be split.
    """
    counts = written(members.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block), "large-keys")
    chunks = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")
    dealt = (
        members.join(counts, key, "left")
        .withColumn("_chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64(order, F.lit(7)), F.col("_chunks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    )
    return dealt.withColumns({"pair_lo": F.least("chunk", "_other"), "pair_hi": F.greatest("chunk", "_other")}).drop("_n", "_chunks", "_other")


def spanning_edges(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric boolean matrix, a forest with the same components: two arrays of row numbers."""
    left, right = [], []
    unseen = linked.any(axis=1)
    for start in np.flatnonzero(unseen):
        if not unseen[start]:
            continue
        unseen[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(linked[at] & unseen)
            unseen[new] = False
            left += [at] * len(new)
            right += new.tolist()
            todo += new.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (src, dst), both long: (node, component), component being the smallest node.

    Contraction: each round, every node moves to the neighbour (or itself) of least hash, links between the nodes that are left
    go on to the next round, and each round's moves are a written table. The hash differs by round, so the nodes that are left
    fall by a constant factor a round, however long the chains. Nothing is gathered: groups are minima with partial aggregation.
    Nodes with no link to another are not in the result. Nulls in an edge drop the edge.
    """
    edges = written(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(moves))).alias("h"), F.col(c).alias("id"))
        both = edges.select("src", "dst").union(edges.select("dst", "src"))
        move = written(
            both.groupBy(F.col("src").alias("node")).agg(F.min(ranked("dst")).alias("near")).select("node", F.least(ranked("node"), F.col("near"))["id"].alias("root")),
            "moves",
        )
        moves.append(move)
        edges = (
            edges.join(move.select(F.col("node").alias("src"), F.col("root").alias("a")), "src")
            .join(move.select(F.col("node").alias("dst"), F.col("root").alias("b")), "dst")
            .where("a <> b")
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
            .distinct()
        )
        edges = written(edges, "edges")
    if not moves:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    found = moves.pop()
    for move in reversed(moves):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = written(move.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "roots")
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", F.least("node", "component").alias("component"))
