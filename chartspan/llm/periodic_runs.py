"""Periodic runs of words by an enhanced suffix array (operator 11).

A run is a stretch of words with smallest period q, at least 2 * q long, that no neighbour extends. Its last square (2 * q words
that repeat) is followed by a word that breaks the period, so the two suffixes at its start and middle part after exactly q
words: both lie in the LCP interval of depth q, in different children. Of each interval all suffixes but those of its largest
child are asked whether the suffix q words on, or back, is in the interval by its place in the suffix array. Each square so
found is rotated to the left as far as it goes, and squares of one stretch merge into its run.

All of it is array work over as many texts at once as make up a block; words are numbered by text, so that texts never mix.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a block of texts; a longer text is a block of its own.
BLOCK = 1 << 18
#: Suffixes that are asked at once, and rounds of jumps before nearest smaller values are found by a stack.
AT_ONCE, ROUNDS = 1 << 20, 48

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def suffix_ranks(codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for each k the class of every place's next 2**k words: equal numbers, equal words. The last are the places
    in the suffix array. stop: the end of each place's text, before which its suffix ends. Doubling; only suffixes not yet told apart
    are sorted again."""
    n = len(codes)
    sa = np.argsort(codes, kind="stable")
    at = np.arange(n)
    head = np.ones(n, bool)
    rank = np.empty(n, np.int64)
    active, width, levels = at, 1, []
    key = codes[sa]
    while True:
        head = np.ones(len(active), bool)
        head[1:] = key[1:] != key[:-1]
        rank[sa[active]] = active[np.flatnonzero(head)[np.cumsum(head) - 1]]
        levels.append(rank.astype(np.int32))
        alone = head & np.append(head[1:], True)
        active = active[~alone]
        if not len(active):
            return sa, levels
        here = sa[active]
        after = here + width
        key = rank[here] * (n + 1) + np.where(after < stop[here], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        sa[active], key = here[order], key[order]
        width *= 2


def shared_ahead(a: np.ndarray, b: np.ndarray, stop: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words from places a and b on are the same."""
    n = np.zeros(len(a), np.int64)
    last = len(stop) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + n, b + n
        inside = (x < stop[a]) & (y < stop[b])
        x, y = np.minimum(x, last), np.minimum(y, last)
        n += (inside & (levels[k][x] == levels[k][y])).astype(np.int64) << k
    return n


def shared_behind(a: np.ndarray, b: np.ndarray, begin: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words before places a < b of one text are the same."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - n - (1 << k), b - n - (1 << k)
        inside = x >= begin[a]
        x, y = np.maximum(x, 0), np.maximum(y, 0)
        n += (inside & (levels[k][x] == levels[k][y])).astype(np.int64) << k
    return n


def nearest_smaller(v: np.ndarray, asked: np.ndarray, step: int) -> np.ndarray:
    """For each place asked, the nearest one in the direction of step with a smaller value; v is zero at both ends and positive where asked."""
    to = np.arange(len(v)) + step
    todo = asked
    for _ in range(ROUNDS):
        at = to[todo]
        further = v[at] >= v[todo]
        todo = todo[further]
        if not len(todo):
            return to
        to[todo] = to[at[further]]
    held: list[int] = []
    values = v.tolist()
    for i in range(len(v)) if step < 0 else range(len(v) - 1, -1, -1):
        while held and values[held[-1]] >= values[i]:
            held.pop()
        to[i] = held[-1] if held else i + step
        held.append(i)
    return to


def squares(sa: np.ndarray, rank: np.ndarray, lcp: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of each square whose next word breaks the period, from the LCP intervals of depth one or more."""
    n = len(sa)
    edges = np.flatnonzero(lcp > 0)
    if not len(edges):
        return edges, edges
    low, high, depth = nearest_smaller(lcp, edges, -1)[edges], nearest_smaller(lcp, edges, 1)[edges], lcp[edges]
    order = np.lexsort((edges, depth, low))  # an interval's edges lie together, in order
    edges, low, high, depth = edges[order], low[order], high[order], depth[order]
    first = np.ones(len(edges), bool)
    first[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    owner = np.cumsum(first) - 1
    opens = np.flatnonzero(first)
    # children: one before each interval's first edge, and one from each edge to the next
    ends = np.where(np.append(first[1:], True), high, np.append(edges[1:], 0))
    child_low = np.concatenate([low[opens], edges])
    child_high = np.concatenate([edges[opens], ends])
    of = np.concatenate([np.arange(len(opens)), owner])
    sizes = child_high - child_low
    order = np.lexsort((sizes, of))
    largest = np.append(of[order][1:] != of[order][:-1], True)
    small = order[~largest]
    found = [np.empty(0, np.int64)]
    until = np.cumsum(sizes[small])
    at = 0
    while at < len(small):
        upto = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + AT_ONCE, "right")))
        part, at = small[at:upto], upto
        k = sizes[part]
        c_low, c_high, lb, hb, d = (np.repeat(x, k) for x in (child_low[part], child_high[part], low[opens][of[part]], high[opens][of[part]], depth[opens][of[part]]))
        i = sa[np.arange(len(c_low)) - np.repeat(np.cumsum(k) - k, k) + c_low]
        for j, square, inside in ((i + d, i, i + d < stop[i]), (i - d, i - d, i - d >= begin[i])):
            r = rank[np.clip(j, 0, n - 1)]
            hit = inside & (r >= lb) & (r < hb) & ((r < c_low) | (r >= c_high))
            found.append(np.unique(square[hit] * (n + 1) + d[hit]))
    keys = np.unique(np.concatenate(found))
    return keys // (n + 1), keys % (n + 1)


def runs_of(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of texts one after the other, by start and period. codes: a number for each word, no
    number in two texts; sizes: words of each text."""
    n = len(codes)
    if not n:
        return (np.empty(0, np.int64),) * 3
    ends = np.cumsum(sizes)
    stop, begin = np.repeat(ends, sizes), np.repeat(ends - sizes, sizes)
    sa, levels = suffix_ranks(codes, stop)
    rank = levels[-1].astype(np.int64)
    lcp = np.zeros(n + 1, np.int64)
    near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    lcp[near] = shared_ahead(sa[near - 1], sa[near], stop, levels)
    at, period = squares(sa, rank, lcp, begin, stop)
    start = at - shared_behind(at, at + period, begin, levels)
    end = at + 2 * period
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def long_enough(length: np.ndarray, period: np.ndarray) -> np.ndarray:
    return length >= np.maximum(6, 4 * period)


def _block(words: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text of words its runs and the words that are left, joined."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [w for text in words for w in text]
    number: dict[bytes, int] = defaultdict(count().__next__)
    codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)) + np.repeat(np.arange(len(words)) * len(number), sizes)
    start, length, period = runs_of(codes, sizes)
    kept = long_enough(length, period)
    start, length, period = start[kept], length[kept], period[kept]
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    gone = np.cumsum(change) > 0
    ends = np.cumsum(sizes)
    begins = ends - sizes
    own = np.searchsorted(start, np.append(begins, len(flat) + 1))
    for t, text in enumerate(words):
        a, b = own[t], own[t + 1]
        if a == b:
            yield [], b" ".join(text)
            continue
        yield list(zip((start[a:b] - begins[t]).tolist(), length[a:b].tolist(), period[a:b].tolist())), b" ".join([w for w, g in zip(text, gone[begins[t] : ends[t]].tolist()) if not g])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """One row per row of docs: id, runs (an array of start, length, period, by start and period), best (the run of greatest exact length
    by period; ties: smallest start, then period; null without a run), collapsed (the text's words without those that a run
    holds after its first period, joined by one space).

    Words are runs of characters other than ASCII white space, numbered from 0. A run is a longest stretch of smallest period q with
    at least max(6, 4 * q) words. rewrite(id, words), if given, makes the words that are looked at. A null, empty or blank text
    has no words, no runs and an empty `collapsed`. A very long text is read whole, as a block of its own, in memory proportional to it
    times the logarithm of its longest repeat. Rows with a null id and repeated rows are rows like any other. Other columns are
    ignored. An empty table gives no rows. No shuffle.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def best(runs):
        return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("_id")
        held: list[list[bytes]] = []
        n = first = 0
        for i in range(batch.num_rows):
            text = batch.column("_text")[i].as_py()
            words = text.split() if text else []
            if rewrite:
                words = rewrite(ids[i].as_py(), words)
            if held and n + len(words) > BLOCK:
                yield rows(ids.slice(first, len(held)), held)
                held, n, first = [], 0, i
            held.append(words)
            n += len(words)
        if held:
            yield rows(ids.slice(first, len(held)), held)

    def rows(ids: pa.Array, words: list[list[bytes]]) -> pa.RecordBatch:
        runs, left = zip(*_block(words))
        as_rows = lambda found: None if found is None else dict(zip(("start", "length", "period"), found))
        columns = [ids, pa.array([[as_rows(r) for r in rs] for rs in runs], pa.list_(run)), pa.array([as_rows(best(rs)) for rs in runs], run), pa.array(left, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "runs", "best", "collapsed"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from blocks(batch)

    one = "struct<start:long,length:long,period:long>"
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(find, f"`{id_col}` {kind}, runs array<{one}>, best {one}, collapsed string")
