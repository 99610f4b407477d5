"""SimHash near-duplicates by bit-sliced comparison (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import components, in_block_pairs, spanning_edges, written

SEED, WIDTH, RADIUS = 42, 3, 2
#: Fingerprints compared with each other at once.
BLOCK = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64 bits as a signed number: bit b is set if over half of the shingles' XXH64 have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at 0x20 and 0x09-0x0D alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(len(words) - width + 1, 1)
    last = ends[width - 1 :] - 1 if len(words) >= width else ends[-1:] - 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        cuts = map(slice, starts[at : at + 65_536][: n - at].tolist(), last[at : at + 65_536].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", to: str = "_fp") -> DataFrame:
    """docs with a column more: the fingerprint as a long."""

    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([fingerprint(t) for t in s], dtype="int64")

    return docs.withColumn(to, prints(F.col(text_col)))


def _parts(start: int, bits: int, n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of n nearly equal parts."""
    edges = [start + bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def bucket_keys(fp: Column, radius: int = RADIUS) -> Column:
    """The (table, bits) keys of a fingerprint.

    Of radius + 1 parts of the bits, one is the same in two fingerprints within the radius; of radius + 1 parts of the other bits,
    again one. A key holds both, so any two fingerprints within the radius share a key of the (radius + 1) ** 2.
    """
    keys = []
    for first, bits in _parts(0, 64, radius + 1):
        part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))
        # the other bits, rotated to the bottom
        rest_bits = 64 - bits
        turned = F.shiftrightunsigned(fp, first + bits) if first + bits < 64 else F.lit(0).cast("long")
        rest = (turned if first == 0 else F.shiftleft(turned, first).bitwiseOR(fp.bitwiseAND(F.lit((1 << first) - 1)))).cast("long")
        for low, n in _parts(0, rest_bits, radius + 1):
            sub = F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << n) - 1))
            keys.append(F.struct(F.lit(len(keys)).alias("table"), F.shiftleft(part, n).bitwiseOR(sub).cast("long").alias("bits")))
    return F.array(*keys)


def near_pairs(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the fingerprints (int64) are within the radius of each other, as a boolean matrix with a false diagonal.

    Bit-sliced: plane b holds bit b of all fingerprints, 64 to a machine word. For each fingerprint the planes are compared one
    after the other; carry-save counters, one bit of the count a word, add the differing bits of 64 others with a few bitwise
    operations. A row of which all counts exceed the radius is left out of the planes that follow.
    """
    m = len(fps)
    words = -(-m // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:m] = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    turned = np.where(bits[:m].astype(bool), ~np.uint64(0), np.uint64(0))
    width = max(1, int(radius + 1).bit_length())
    start = (1 << width) - 1 - radius  # the counters overflow with the first bit beyond the radius
    alive = np.arange(m)
    own = np.zeros((m, words), np.uint64)
    counters = [np.full_like(own, ~np.uint64(0)) if start >> i & 1 else own.copy() for i in range(width)]
    over = own.copy()
    if m % 64:
        over[:, -1] = ~np.uint64(0) << np.uint64(m % 64)
    own[np.arange(m), np.arange(m) // 64] = np.uint64(1) << (np.arange(m) % 64).astype(np.uint64)
    over |= own
    for b in range(64):
        carry = planes[b][None, :] ^ turned[alive, b][:, None]
        for c in counters:
            c ^= carry
            carry &= ~c
        over |= carry
        if b % 8 == 7:
            keep = (over != ~np.uint64(0)).any(axis=1)
            if not keep.all():
                alive, over, counters = alive[keep], over[keep], [c[keep] for c in counters]
            if not len(alive):
                break
    linked = np.zeros((m, m), bool)
    if len(alive):
        linked[alive] = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :m].astype(bool)
    return linked


def _edges(block: np.ndarray, radius: int) -> pd.DataFrame:
    fps = np.unique(block)
    a, b = spanning_edges(near_pairs(fps, radius))
    return pd.DataFrame({"src": fps[a], "dst": fps[b]})


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (src, dst) between fingerprints within the radius; their components are those of all such pairs.

    distinct: a column _fp, each value once. Candidates are those that share a bucket key; keys with many members are dealt to
    block pairs, so no task gets more than about 2 * block of a key at once, and every pair of a key is still compared.
    """
    keyed = distinct.select("_fp", F.explode(bucket_keys(F.col("_fp"), radius)).alias("k")).select("_fp", "k.table", "k.bits")
    dealt = in_block_pairs(keyed, ["table", "bits"], F.col("_fp"), block)
    group = ["table", "bits", "pair_lo", "pair_hi"]
    dealt = dealt.select(F.xxhash64(*group).alias("g"), "_fp")  # a clash of two groups only adds comparisons
    sorted_ = dealt.repartition("g").sortWithinPartitions("g")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Packs the groups of two or more into blocks; a group never spans two blocks."""
        rest = None
        for pdf in batches:
            g, fp = pdf["g"].to_numpy(), pdf["_fp"].to_numpy()
            if rest is not None:
                g, fp = np.concatenate([rest[0], g]), np.concatenate([rest[1], fp])
            cut = np.flatnonzero(g != g[-1])
            cut = cut[-1] + 1 if len(cut) else 0  # the last group may go on in the next batch
            rest = g[cut:], fp[cut:]
            yield from blocks(g[:cut], fp[:cut])
        if rest is not None:
            yield from blocks(*rest)

    def blocks(g: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.array([], int)
        sizes = np.diff(np.append(starts, len(g)))
        held, n = [], 0
        for s, k in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            if n and n + k > block // 2:
                yield _edges(np.concatenate(held), radius)
                held, n = [], 0
            held.append(fp[s : s + k])
            n += k
        if n:
            yield _edges(np.concatenate(held), radius)

    return sorted_.mapInPandas(compare, "src long, dst long")


def _classes(prints: DataFrame, radius: int, block: int, least: Column) -> DataFrame:
    """(_fp, least): of each fingerprint's component the least of `least` over prints."""
    nodes = written(prints.groupBy("_fp").agg(F.min(least).alias("_least")), "prints")
    found = components(links(nodes.select("_fp"), radius, block))
    rooted = nodes.join(found.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("_root", F.coalesce("component", "_fp")).select("_fp", "_root", "_least")
    roots = rooted.groupBy("_root").agg(F.min("_least").alias("least"))
    return rooted.join(roots, "_root").select("_fp", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable by links, itself included).

    Documents of one fingerprint are one node; nodes link at `radius` or fewer differing bits. A null or empty text, or one of
    white space alone, has fingerprint zero and links like any other. A very long text is read whole, in memory proportional to it.
    Rows with a null id keep their fingerprint and take part; they are never a component's id unless all its ids are null.
    Repeated rows stay. Other columns are ignored. An empty table gives no rows.
    """
    prints = written(with_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text").select("_id", "_fp"), "fingerprints")
    known = _classes(prints, radius, block, F.col("_id")).withColumnRenamed("least", "component_id")
    return prints.join(known, "_fp").select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """The documents without near-duplicates: of each component one row, the first by id (nulls last) and text.

    Columns, whatever their names, and types stay. Different texts under one id are different documents: each component keeps one.
    Rows without an id are documents like any other. Of rows of one id and text, any one stays. An empty table gives no rows.
    Texts move once, to meet the rows that stay; copies of one of these are told apart by narrow numbers.
    """
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    place = F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.coalesce(F.xxhash64("_text"), F.lit(0)).alias("c"), F.xxhash64("_text", F.lit(11)).alias("d"))
    prints = written(with_fingerprint(named.select("_id", "_text"), "_text").select("_fp", place.alias("at")), "fingerprints")
    stays = written(_classes(prints, radius, block, F.col("at")).select("least").distinct(), "stays")
    times = written(prints.join(stays, F.col("at") == F.col("least")).groupBy("least").agg(F.count(F.lit(1)).alias("n")), "times")
    kept = named.select("row", place.alias("at")).join(times, F.col("at").eqNullSafe(F.col("least")))
    once, more = kept.where("n = 1"), kept.where("n > 1").dropDuplicates(["least"])
    return once.unionByName(more).select(*(F.col("row")[c].alias(c) for c in docs.columns))
