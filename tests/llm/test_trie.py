"""The conversation prefix trie against brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from chartspan.llm import prefix_trie, queries
from tests.conftest import DATA
from tests.oracle import connect, difference


def brute(rows, family=100):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((t is not None, t or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    convs = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(convs.get(c - c % family, [])[:h] + own[h:]) if family else tuple(own)
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in whole.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[k] for k in kids[seq]) or 1
        saved[seq] = sum(saved[k] for k in kids[seq]) + ((len(members[seq]) - 1) * len(seq[-1][1]) if seq else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], sha(ends[s])) for s, m in members.items())


def got(frame):
    return sorted(tuple(x) for x in frame.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def random_rows(r, n):
    rows = []
    for _ in range(n):
        c = r.choice([r.randrange(12), 100 + r.randrange(30), 205, 300 + r.randrange(60)])
        rows += [(c, r.choice([None, 0, 1, 2, 3, 3]), r.choice(["user", "assistant", None, ""]), r.choice([None, "", "a", "bb", "user", "😀é"])) for _ in range(r.randint(1, 2))]
    return rows


@pytest.mark.parametrize("seed, last, family", [(1, 3, 100), (2, 40, 100), (3, 1 << 16, 100), (4, 5, None)])
def test_trie_of_random_conversations(spark, monkeypatch, seed, last, family):
    monkeypatch.setattr(prefix_trie, "ranked", lambda arcs, _, ranked=prefix_trie.ranked: ranked(arcs, last))
    rows = random_rows(random.Random(seed), 260) + [(None, 1, "user", "no conversation")]
    # a third of the conversations are the same, and one is long
    rows += [(400 + i, t, "user", "same") for i in range(60) for t in range(3)] + [(1000, t, "user", str(t % 7)) for t in range(150)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, c string")
    assert got(prefix_trie.trie(df, family=family)) == brute(rows, family)


def test_trie_of_empty_and_null_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema), family=100).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    rows = [(7, None, None, None), (7, None, None, None), (8, 0, "user", "x" * 100_000)]
    assert got(prefix_trie.trie(spark.createDataFrame(rows, schema), family=100)) == brute(rows)


def test_ranking_of_a_list_in_any_order(spark):
    r = random.Random(5)
    ids = list(range(500))
    r.shuffle(ids)
    weights = {i: (1, r.randint(0, 1), r.randint(0, 9)) for i in ids}
    arcs = spark.createDataFrame([(i, nxt, *weights[i]) for i, nxt in zip(ids, [*ids[1:], None])], "id long, next long, n long, leaves long, saved long")
    want, sums = {}, (0, 0, 0)
    for i in ids:
        want[i] = sums
        sums = tuple(a + b for a, b in zip(sums, weights[i]))
    assert {x.id: (x.n, x.leaves, x.saved) for x in prefix_trie.ranked(arcs, last=9).collect()} == want


def test_trie_query(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    frame = queries.op12_prefix_trie(spark, DATA)
    assert got(frame) == brute(rows)
    assert difference(frame, connect(DATA), queries.SQL["op12_prefix_trie"]) == ""
