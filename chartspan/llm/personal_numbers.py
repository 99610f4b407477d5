"""Proposals of numbers, and their features, for texts of very many numbers: as arrays, a block of numbers at a time (operator 4).

The same proposals and features as personal_data.candidates() and features() give one by one, in blocks of bounded size: a table or a
log of numbers proposes about eighteen spans for each number in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

#: Numbers whose proposals are made at once.
BLOCK = 2048
_SEPARATORS = " ().-/"


def _before(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int32)])


class _Text:
    """A text's characters as numbers, with running counts."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.padded = np.concatenate([np.zeros(4, c.dtype), c, np.zeros(4, c.dtype)])
        kinds = np.unique(self.padded)
        self.alnum = np.array([chr(k).isalnum() for k in kinds.tolist()])[np.searchsorted(kinds, self.padded)]
        self.digit = (self.padded >= 48) & (self.padded <= 57)
        self.separator = np.isin(self.padded, [ord(x) for x in _SEPARATORS])
        low = c | 32
        self.letters = _before((c >= 128) | ((low >= 97) & (low <= 122)))
        self.count = {x: _before(c == ord(x)) for x in " -./()"}

    def at(self, array: np.ndarray, places: np.ndarray, off: int) -> np.ndarray:
        return array[places + (4 + off)]


def _goes_on(t: _Text, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Whether another number stands right before and after, apart from up to two separators, and whether no blank is among these."""
    d, s, c = ([t.at(a, start, -k) for k in (1, 2, 3)] for a in (t.digit, t.separator, t.padded))
    ways = [d[0], s[0] & d[1], s[0] & s[1] & d[2]]
    blank = [np.zeros(len(start), bool), c[0] == 32, (c[0] == 32) | (c[1] == 32)]
    left, left_tight = ways[0] | ways[1] | ways[2], np.any([w & ~b for w, b in zip(ways, blank)], axis=0)
    d, s, c = ([t.at(a, end, k) for k in range(4)] for a in (t.digit, t.separator, t.padded))
    ways = [d[0], s[0] & d[1], s[0] & s[1] & d[2], (c[0] == 40) & s[1] & s[2] & d[3]]
    blank = [np.zeros(len(end), bool), c[0] == 32, (c[0] == 32) | (c[1] == 32), (c[1] == 32) | (c[2] == 32)]
    right, right_tight = np.any(ways, axis=0), np.any([w & ~b for w, b in zip(ways, blank)], axis=0)
    return [left, right, left_tight, right_tight]


def _cues(t: _Text, start: np.ndarray, end: np.ndarray, window: int, cues: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Columns: for each list of cues whether one of the last two words before is in it, then whether any word around is."""
    m = len(cues)
    out = np.zeros((len(start), 2 * m), bool)
    sets = [set(c) for c in cues]

    def bits(words) -> list[bool]:
        return [not s.isdisjoint(words) for s in sets]

    low = np.maximum(start - window, 0)
    high = np.minimum(end + window, t.n)
    for places, far, before in ((start, low, True), (end, high, False)):
        some = np.flatnonzero(t.letters[np.maximum(places, far)] > t.letters[np.minimum(places, far)])
        if not len(some):
            continue
        each, back = np.unique(places[some], return_inverse=True)
        known = np.zeros((len(each), 2 * m), bool)
        for i, p in enumerate(each.tolist()):
            words = re.findall(r"[a-z]+", (t.text[max(0, p - window) : p] if before else t.text[p : p + window]).lower())
            known[i, m:] = bits(words)
            if before:
                known[i, :m] = bits(words[-2:])
        out[some] |= known[back]
    return out


def proposals(text: str, runs: list[tuple[int, int]], taken: list[tuple[int, int]], most_digits: int, window: int, cues: tuple[tuple[str, ...], ...], counters: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (spans, features): spans has start, end, kind, start of the run, and the number's and the kind's place in the order of
    proposals; features are whole numbers. The run itself as an address isn't among them."""
    t = _Text(text)
    run_start, run_end = (np.array([r[i] for r in runs], np.int64) for i in (0, 1))
    inside = np.zeros(t.n + 1, np.int8)
    np.add.at(inside, run_start, 1)
    np.add.at(inside, run_end, -1)
    digit = t.digit[4 : 4 + t.n] & (np.cumsum(inside)[: t.n] > 0)
    edge = np.diff(np.concatenate([[0], digit.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.searchsorted(run_start, first, "right") - 1
    of_run = np.bincount(run, minlength=len(runs))
    covered = np.zeros(t.n + 1, np.int32)
    for a, b in taken:
        covered[a:b] = 1
    covered = _before(covered)
    free = covered[last] == covered[first]
    piece = np.cumsum(np.append(0, (run[1:] != run[:-1]) | ~free[1:] | ~free[:-1]) if len(run) else [])
    first, last, run, piece = first[free], last[free], run[free], piece[free]
    g = len(first)
    if not g:
        return
    of_piece = np.bincount(piece)[piece]
    whole_piece = of_piece == of_run[run]
    begins_piece = np.append(True, piece[1:] != piece[:-1])
    size = last - first
    total = _before(size)
    # digits one after the other, and by place parity: as they are, and doubled for the check digit
    places = np.repeat(first - total[:-1], size) + np.arange(total[-1])
    q = (t.padded[places + 4] - 48).astype(np.int64)
    odd = np.arange(len(q)) % 2
    doubled = 2 * q - 9 * (q > 4)
    plain, twice = ([_before(np.where(odd == r, x, 0)) for r in (0, 1)] for x in (q, doubled))
    seen = np.stack([_before(q == k) for k in range(10)])
    value = np.where(size <= 3, sum(np.where(size > k, q[np.maximum(total[1:] - 1 - k, 0)] * 10**k, 0) for k in range(3)), 999)
    byte = _before(value <= 255)
    head = q[total[:-1]]
    second = q[np.minimum(total[:-1] + 1, len(q) - 1)]
    year = _before((size == 4) & (((head == 1) & (second == 9)) | ((head == 2) & (second == 0))))
    # the separator after each number by its text, and the last number before it that is followed by the same one
    ids: dict[str, int] = {}
    between = np.array([ids.setdefault(text[a:b], len(ids)) if p == r else -1 for a, b, p, r in zip(last[:-1].tolist(), first[1:].tolist(), piece[:-1].tolist(), piece[1:].tolist())], np.int64)
    same = np.full(g, -1, np.int64)
    order = np.argsort(between, kind="stable")
    equal = between[order][1:] == between[order][:-1]
    same[order[1:][equal]] = order[:-1][equal]
    opening = t.at(t.padded, first, -1)
    may_open = (first > run_start[run]) & (covered[first] == covered[first - 1])
    for at in range(0, g, BLOCK):
        i = np.arange(at, min(at + BLOCK, g))
        most, least = size[i].copy(), size[i].copy()
        most_later, least_later = np.zeros_like(most), np.full_like(most, most_digits + 1)
        kinds_of_separator = np.zeros_like(most)
        for k in range(most_digits):
            j = i + k
            alive = (j < g) & (piece[np.minimum(j, g - 1)] == piece[i])
            alive &= total[np.minimum(j, g - 1) + 1] - total[i] <= most_digits
            i, j, most, least, most_later, least_later, kinds_of_separator = (x[alive] for x in (i, j, most, least, most_later, least_later, kinds_of_separator))
            if not len(i):
                break
            if k:
                most, least = np.maximum(most, size[j]), np.minimum(least, size[j])
                most_later, least_later = np.maximum(most_later, size[j]), np.minimum(least_later, size[j])
                kinds_of_separator = kinds_of_separator + (same[j - 1] < i)
            n, end = total[j + 1] - total[i], last[j]
            closed = t.count[")"][end] > t.count[")"][first[i]]
            is_whole = begins_piece[i] & whole_piece[i] & (k + 1 == of_piece[i])
            opened = may_open[i] & ((opening[i] == 43) | ((opening[i] == 40) & (closed | is_whole)))
            start = first[i] - opened
            dots = t.count["."][end] - t.count["."][start]
            is_run = (start == run_start[run[i]]) & (end == run_end[run[i]])
            chosen = [(3, (n >= 7) & (n <= 16)), (2, n >= 12), (1, (k == 3) & ~is_run & (dots == 3))]
            pick = np.flatnonzero(np.any([c for _, c in chosen], axis=0))
            if not len(pick):
                continue
            a, b, s, e, m = i[pick], j[pick], start[pick], end[pick], n[pick]
            tail = (total[b + 1] - 1) % 2
            lo, hi = total[a], total[b + 1]
            summed = lambda sums, r: np.where(r == 0, sums[0][hi] - sums[0][lo], sums[1][hi] - sums[1][lo])  # noqa: B023, E731
            luhn = (m >= 12) & ((summed(plain, tail) + summed(twice, 1 - tail)) % 10 == 0)
            sizes = lambda *want: (k + 1 == len(want)) & np.all([size[np.minimum(a + x, g - 1)] == w for x, w in enumerate(want)], axis=0)  # noqa: B023, E731
            upto = np.minimum(b, a + 3) + 1
            cue = _cues(t, s, e, window, (*cues, counters))
            c = len(cues)
            near, around = cue[:, : c + 1], cue[:, c + 1 :]
            nxt, previous = t.at(t.padded, e, 0), t.at(t.padded, s, -1)
            columns = [
                *near[:, :c].T, *around[:, :c].T, near[:, c], around[:, c],
                e - s, m, np.full(len(a), k + 1), most[pick], least[pick], *(t.count[x][e] - t.count[x][s] for x in " -./("),
                t.at(t.padded, s, 0) == 43, t.at(t.padded, s, 0) == 40, (t.at(t.padded, s, 0) == 48) & (t.at(t.padded, s, 1) == 48),
                luhn, byte[upto] - byte[a] == upto - a, year[b + 1] > year[a], (seen[:, hi] > seen[:, lo]).sum(axis=0) <= 2,
                t.at(t.alnum, s, -1), t.at(t.alnum, e, 0), np.isin(previous, [ord(x) for x in "$€#v.=/"]), np.isin(nxt, [ord(x) for x in "%€/."]) & t.at(t.alnum, e, 1),
                *_goes_on(t, s, e), np.zeros(len(a)), (head[a] >= 3) & (head[a] <= 6), np.isin(m, (13, 15, 16)), head[a] == 0,
                sizes(3, 3, 4) | sizes(1, 3, 3, 4), sizes(4, 4, 4, 4) | sizes(4, 6, 5) | sizes(13) | sizes(15) | sizes(16), (most_later[pick] == least_later[pick]) & (k + 1 > 3),
                size[a], size[b], kinds_of_separator[pick], np.zeros(len(a)), np.zeros(len(a)),
            ]
            body = np.stack([np.asarray(x, np.int64) for x in columns], axis=1)
            for turn, (kind, fits) in enumerate(chosen):
                own = np.flatnonzero(fits[pick])
                if len(own):
                    kinds = np.zeros((len(own), 4), np.int64)
                    kinds[:, kind] = 1
                    spans = np.stack([s[own], e[own], np.full(len(own), kind), run_start[run[a[own]]], a[own], np.full(len(own), 3 * k + turn)], axis=1)
                    yield spans, np.concatenate([kinds, body[own]], axis=1)


class Judge:
    """Probabilities of rows of whole numbers; equal rows are judged once."""

    def __init__(self, probability: Callable[[np.ndarray], np.ndarray], width: int, most: int = 1 << 18):
        self.probability, self.most = probability, most
        self.mix = np.random.default_rng(1).integers(1, 1 << 62, width) * 2 + 1
        self.known, self.values = np.empty(0, np.int64), np.empty(0)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            keys = (rows * self.mix).sum(axis=1)
        each, where, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, each)
        old = (at < len(self.known)) & (self.known[np.minimum(at, max(len(self.known) - 1, 0))] == each) if len(self.known) else np.zeros(len(each), bool)
        out = np.empty(len(each))
        out[old] = self.values[at[old]]
        if not old.all():
            out[~old] = self.probability(rows[where[~old]].astype(np.float64))
            if len(self.known) + len(each) > self.most:
                self.known, self.values = np.empty(0, np.int64), np.empty(0)
                old[:] = False
            keys = np.concatenate([self.known, each[~old]])
            order = np.argsort(keys)
            self.known, self.values = keys[order], np.concatenate([self.values, out[~old]])[order]
        return out[back]
