"""Near-duplicate vectors by a forest of random-projection trees with spill (operator 5)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import components, in_block_pairs, spanning_edges, written

#: The trees' upper levels are fitted on a sample of at most SAMPLE distinct vectors; every vector is then put into every tree.
TREES, SPILL, LEAF, SAMPLE, BLOCK, SEED = 4, 1.0, 768, 20_000, 1024, 17
#: A node stays a leaf, however large, if a side of its cut would keep more than this share: its rows are one dense group.
DENSE = 0.7
#: Leaves larger than so many times the aim are split again, each on a sample of its own of about so many rows.
LARGE, OWN_SAMPLE = 2, 2048
#: A leaf's code is its tree's number above so many bits and its number as in a heap below.
BITS = 50

Cuts = dict[int, tuple[float, float]]


@functools.lru_cache(20_000)
def _direction(seed: int, tree: int, node: int, dim: int) -> np.ndarray:
    """The random direction of a node: from its place alone, so that no task needs another's."""
    out = np.random.default_rng([seed, tree, node]).standard_normal(dim)
    return out / np.linalg.norm(out)


def grow(sample: np.ndarray, n_rows: float, leaf: int, band: float, seed: int, tree: int, root: int = 0) -> Cuts:
    """Splits at the median of a random projection, node -> (lowest value on the upper side, highest on the lower): rows within half of
    `band` of the cut go both ways. A node's children are 2 * node + 1 and + 2. n_rows: how many of all rows come to the root."""
    cuts, todo = {}, [(root, sample, n_rows)]
    while todo:
        node, rows, expected = todo.pop()
        if expected <= leaf or len(rows) < 8 or node >= 1 << (BITS - 2):
            continue
        at = rows @ _direction(seed, tree, node, rows.shape[1])
        low, high = float(np.median(at) - band / 2), float(np.median(at) + band / 2)
        parts = rows[at <= high], rows[at >= low]
        if max(map(len, parts)) > DENSE * len(rows):
            continue
        cuts[node] = low, high
        todo += [(2 * node + 1 + side, part, expected * len(part) / len(rows)) for side, part in enumerate(parts)]
    return cuts


def place(rows: np.ndarray, cuts: Cuts, seed: int, tree: int, root: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row number, leaf's code), once for each leaf that a row falls in."""
    found, todo = [], [(root, np.arange(len(rows)))]
    while todo:
        node, at = todo.pop()
        if node not in cuts:
            found.append((at, np.full(len(at), tree << BITS | node, np.int64)))
        elif len(at):
            value, (low, high) = rows[at] @ _direction(seed, tree, node, rows.shape[1]), cuts[node]
            todo += [(2 * node + 1, at[value <= high]), (2 * node + 2, at[value >= low])]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def band_of(threshold: float, dim: int, spill: float = SPILL) -> float:
    """`spill` times the spread that a pair at the threshold shows along a random direction."""
    return spill * float(np.sqrt(max(0.0, 2 - 2 * threshold) / dim))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values, where each row's start, and the end)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; first divided by their greatest component, so that no square leaves the doubles."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _unit(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of one length, as rows of length one in double precision."""
    values, offsets = _flat(column)
    return _scaled(values[offsets[rows][:, None] + np.arange(dim)].astype(np.float64))


def _lists(row: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    """For each of n rows its values in ascending order."""
    order = np.lexsort((value, row))
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32), pa.array(value[order]))


def _met_before(column: pa.Array, order: np.ndarray, code: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j share a leaf of a lower code than this: so a pair that meets often counts once, without a shuffle of pairs."""
    values, offsets = _flat(column)
    sizes = np.diff(offsets)[order]
    values = np.concatenate([values[a : a + n] for a, n in zip(offsets[:-1][order], sizes)])
    row, early = np.repeat(np.arange(len(order)), sizes), values < code
    kinds, at = np.unique(values[early], return_inverse=True)
    held = np.zeros((len(order), len(kinds)), bool)
    held[row[early], at] = True
    bits = np.packbits(held[:, held.sum(axis=0) > 1], axis=1)
    return np.concatenate([(bits[i[k : k + 65_536]] & bits[j[k : k + 65_536]]).any(axis=1) for k in range(0, len(i), 65_536)] or [np.zeros(0, bool)])


def plant(classes: DataFrame, kind: str, sizes: dict[int, int], threshold: float, trees: int, leaf: int, spill: float, sample: int, seed: int) -> DataFrame:
    """(_c, _w, _v, dim, leaves): each vector once, with the codes of the leaves that it falls in, in order.

    The upper levels are fitted by the driver on at most `sample` vectors. Leaves that came out large are then split again in
    rounds within Spark: each on about OWN_SAMPLE of its own rows, by one task a leaf; only the cuts, a few numbers a node, meet the
    leaf's rows. What can't be split, a dense group, stays.
    """
    rows = classes.select("_v").orderBy(F.xxhash64("_v", F.lit(seed))).limit(sample).collect()
    forests = {}
    for d, n in sizes.items():
        some = [r[0] for r in rows if len(r[0]) == d]
        if some:
            some = np.array(some, np.float64)
            some = _scaled(some)
            forests[d] = [grow(some, n, leaf, band_of(threshold, d, spill), seed, t) for t in range(trees)]
    shared = classes.sparkSession.sparkContext.broadcast(forests)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(_flat(batch["_v"])[1])
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                unit = _unit(batch["_v"], at, d)
                found = [place(unit, cuts, seed, t) for t, cuts in enumerate(shared.value.get(d, [{}]))]  # a length too rare for the sample: one leaf for all of it
                leaves = _lists(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]), len(at))
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part["_c"], part["_w"], part["_v"], pa.array(np.full(len(at), d, np.int32)), leaves], names=["_c", "_w", "_v", "dim", "leaves"])

    planted = written(classes.select("_c", "_w", "_v").mapInArrow(first, f"_c long, _w long, _v {kind}, dim int, leaves array<long>"), "planted")
    key, tried = ["dim", "code"], None

    def fit(group: pa.Table) -> pa.Table:
        d, code, n = (group[c][0].as_py() for c in ("dim", "code", "n"))
        tree, node = code >> BITS, code & (1 << BITS) - 1
        cuts = grow(_unit(group["_v"], np.arange(len(group)), d), n, leaf, band_of(threshold, d, spill), seed, tree, node)
        return pa.table({"dim": pa.array([d], pa.int32()), "code": [code], "nodes": pa.array([list(cuts)], pa.list_(pa.int64())), "low": pa.array([[a for a, _ in cuts.values()]], pa.list_(pa.float64())), "high": pa.array([[b for _, b in cuts.values()]], pa.list_(pa.float64()))})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, dims = batch["code"].to_numpy(), batch["dim"].to_numpy()
            for d, code in set(zip(dims.tolist(), codes.tolist())):
                at = np.flatnonzero((codes == code) & (dims == d))
                nodes, low, high = (batch[c][int(at[0])].as_py() for c in ("nodes", "low", "high"))
                row, into = place(_unit(batch["_v"], at, d), dict(zip(nodes, zip(low, high))), seed, code >> BITS, code & (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([batch["_c"].take(pa.array(at)), pa.array(np.full(len(at), code)), _lists(row, into, len(at))], names=["_c", "code", "into"])

    while True:  # each round splits what is large by up to OWN_SAMPLE / 8, or finds it dense: rounds grow with the logarithm of the table
        entries = planted.select("_c", "_v", "dim", F.explode("leaves").alias("code"))
        large = entries.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE * leaf)
        large = written(large if tried is None else large.join(tried, key, "left_anti"), "large")
        if large.isEmpty():
            return planted
        some = entries.join(large, key).where(F.pmod(F.xxhash64("_c", F.lit(seed)), F.lit(1 << 20)) < F.col("n") ** -1.0 * OWN_SAMPLE * (1 << 20))
        cuts = written(some.groupBy(*key).applyInArrow(fit, "dim int, code long, nodes array<long>, low array<double>, high array<double>"), "cuts")
        tried = written(large.select(key) if tried is None else tried.unionByName(large.select(key)), "tried")
        split = cuts.where(F.size("nodes") > 0)
        moved = entries.join(split, key).mapInArrow(again, "_c long, code long, into array<long>")
        moved = moved.groupBy("_c").agg(F.collect_list("code").alias("old"), F.flatten(F.collect_list("into")).alias("new"))  # of a row's leaves, a few
        leaves = F.when(F.col("new").isNull(), F.col("leaves")).otherwise(F.array_sort(F.concat(F.array_except("leaves", "old"), "new")))
        planted = written(planted.join(moved, "_c", "left").select("_c", "_w", "_v", "dim", leaves.alias("leaves")), "planted")


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept (id = component_id).

    Equal vectors are one class, looked up once and counted as often as they occur. All classes are put into all trees; within a
    leaf all pairs are compared by cosine in double precision and linked at the threshold or above. A leaf of more than `block`
    rows is compared in block pairs, all of them. Only counts by vector and a spanning forest of each block leave a task.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own component; any
    other length, however small or large, counts; vectors of different numbers of components never link. Repeated rows and rows that share an id each
    count as a vector. Rows with a null id take part; they are a component's id only if all its ids are null. Other columns are
    ignored. An empty table gives no rows. Recall depends on the forest: about 0.999 of the pairs at the threshold with the defaults
    on 50,000 vectors, 0.98 on a billion.
    """
    kind = table.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    vectors = table.select(F.col(id_col).alias("_id"), F.col(vector_col).cast(kind).alias("_v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = F.coalesce(F.col("_v").isNotNull() & ~F.exists("_v", bad) & F.exists("_v", lambda x: x != 0), F.lit(False))
    vectors = vectors.withColumn("_v", F.when(valid, F.col("_v"))).withColumns({"_a": F.xxhash64("_v", F.lit(1)), "_b": F.xxhash64("_v", F.lit(2))})  # 128 bits stand for a vector
    grouped = vectors.where("_v is not null").groupBy("_a", "_b").agg(F.first("_v").alias("_v"), F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_w"))
    classes = written(grouped.withColumn("_c", F.monotonically_increasing_id()), "classes")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(16).collect()}
    planted = plant(classes, kind, sizes, threshold, trees, leaf, spill, sample, seed)
    dealt = in_block_pairs(planted.withColumn("code", F.explode("leaves")), ["dim", "code"], F.col("_c"), block)

    def compare(group: pa.Table) -> pa.Table:
        dim, code, lo, hi = (group[c][0].as_py() for c in ("dim", "code", "pair_lo", "pair_hi"))
        order = np.argsort(group["_c"].to_numpy())
        unit, c, w = _unit(group["_v"], order, dim), group["_c"].to_numpy()[order], group["_w"].to_numpy()[order]
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        a, b = spanning_edges(linked)
        if lo != hi:  # pairs within a chunk are counted where the chunk meets itself
            chunk = group["chunk"].to_numpy()[order]
            linked &= chunk[:, None] != chunk[None, :]
        i, j = np.nonzero(np.triu(linked))
        once = ~_met_before(group["leaves"], order, code, i, j)
        n = np.bincount(i[once], w[j[once]], len(c)) + np.bincount(j[once], w[i[once]], len(c))
        some = np.flatnonzero(n)
        kinds = np.repeat(np.array([0, 1], np.int32), [len(a), len(some)])
        return pa.table({"kind": kinds, "src": np.concatenate([c[a], c[some]]).astype(np.int64), "dst": np.concatenate([c[b], n[some].astype(np.int64)]).astype(np.int64)})

    found = written(dealt.groupBy("dim", "code", "pair_lo", "pair_hi").applyInArrow(compare, "kind int, src long, dst long"), "found")
    degree = found.where("kind = 1").groupBy(F.col("src").alias("_c")).agg(F.sum("dst").alias("_n"))
    linked = components(found.where("kind = 0").select("src", "dst")).select(F.col("node").alias("_c"), F.col("component").alias("_root"))
    known = classes.drop("_v").join(degree, "_c", "left").join(linked, "_c", "left").withColumn("_root", F.coalesce("_root", "_c"))
    known = written(known.select("_a", "_b", "_root", "_least", (F.coalesce("_n", F.lit(0)) + F.col("_w") - 1).alias("n_links")), "known")
    roots = known.groupBy("_root").agg(F.min("_least").alias("component_id"))
    known = written(known.join(roots, "_root").select("_a", "_b", "n_links", "component_id"), "known")
    alone = vectors.where("_v is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return (
        vectors.where("_v is not null").select("_id", "_a", "_b").join(known, ["_a", "_b"]).select("_id", "n_links", "component_id").unionByName(alone)
        .select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )
