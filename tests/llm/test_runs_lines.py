"""Periodic runs and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartspan.llm import line_dedup, periodic_runs, queries
from tests.conftest import DATA
from tests.llm.test_exact import ODD, frame

WHITE = " \t\n\x0b\x0c\r"


def brute_runs(words):
    """Every maximal stretch of period q, for each q, that no smaller period has."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - i >= 2 * q:
                found.setdefault((i, e + q), q)
            i = e + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def contract_row(doc_id, text):
    words = [w for w in "".join(" " if c in WHITE else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted((r for r in brute_runs(words) if r[1] >= max(6, 4 * r[2])), key=lambda r: (r[0], r[2]))
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return (len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("rounds", [0, 48])
def test_all_runs_of_random_words(monkeypatch, rounds):
    monkeypatch.setattr(periodic_runs, "ROUNDS", rounds)
    monkeypatch.setattr(periodic_runs, "AT_ONCE", 7)
    r = random.Random(rounds)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(0, 5)):
            k = r.randint(1, 4)
            piece = [r.randrange(k) for _ in range(r.randint(1, 7))]
            texts.append(r.choice([[r.randrange(k) for _ in range(r.randint(0, 40))], piece * r.randint(1, 9) + piece[:1], [0] * r.randint(0, 30)]))
        codes = np.array([w + 10 * t for t, text in enumerate(texts) for w in text], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        got = list(zip(*(x.tolist() for x in periodic_runs.runs_of(codes, sizes))))
        begins = (np.cumsum(sizes) - sizes).tolist()
        assert got == sorted(((b + s, k, q) for b, t in zip(begins, texts) for s, k, q in brute_runs(t)), key=lambda x: (x[0], x[2]))


def test_runs_of_odd_texts_and_tables(spark):
    texts = [*ODD, "a b " * 3, "a b " * 4, "x " * 5, "x " * 6, "p q r " * 3 + "z z z z z z z " * 2, None, "x y z w " * 9 + "\x00    "]
    ids = list(range(len(texts)))
    got = {x.doc_id: x for x in periodic_runs.find_runs(frame(spark, texts, extra=True)).collect()}
    for i in ids:
        words = (texts[i] or "").encode().split()
        want = [r for r in brute_runs(words) if r[1] >= max(6, 4 * r[2])] if len(words) < 2000 else [(0, len(words), 1)]
        assert [tuple(x) for x in got[i].runs] == want, i
        gone = {j for s, k, q in want for j in range(s + q, s + k)}
        assert got[i].collapsed == b" ".join(w for j, w in enumerate(words) if j not in gone).decode()
        assert (got[i].best is None) == (not want)
    twice = frame(spark, ["a a a a a a", "a a a a a a"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [x.best.length for x in periodic_runs.find_runs(twice).collect()] == [6, 6]
    assert periodic_runs.find_runs(frame(spark, []).limit(0)).count() == 0


def test_runs_of_very_long_texts(spark):
    began = time.perf_counter()
    r = random.Random(3)
    piece = " ".join(r.choice("abcdefghij") for _ in range(997))
    texts = ["w " * 300_000, " ".join([piece] * 200), "a b " * 50_000 + "c", " ".join(str(r.randrange(50)) for _ in range(200_000))]
    got = [x.runs for x in periodic_runs.find_runs(frame(spark, texts)).orderBy("doc_id").collect()]
    assert [tuple(x) for x in got[0]] == [(0, 300_000, 1)] and (0, 199_400, 997) in [tuple(x) for x in got[1]] and [tuple(x) for x in got[2]] == [(0, 100_000, 2)]
    assert time.perf_counter() - began < 60


def test_runs_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 2000").select("doc_id", "text").collect()
    got = {x.doc_id: tuple(x)[1:8] for x in queries.op11_periodic_runs(spark, DATA).collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    for x in docs:
        assert got[x.doc_id] == contract_row(x.doc_id, x.text), x.doc_id


def brute_lines(rows, min_docs=2):
    key = lambda line: line.strip(WHITE).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < min_docs or i == min(held[key(x)], key=lambda v: (v is None, v or 0))]
        out.append((i, None if t is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_of_random_documents(spark, min_docs):
    r = random.Random(min_docs)
    pool = ["a shared line here", "A SHARED line here", "  a shared line here\t", "short", "exactly 10", "exactly_9", "É shared line here", "é shared line here", "", " ", "\x0b\x0cframed lines\r", "framed lines", "framed\x0blines!", "😀😀😀😀😀😀😀😀😀😀", "x" * 5000]
    pool += [f"line number {i} of the pool" for i in range(30)]
    rows = [(r.choice([None, *range(40)]), "\n".join(r.choice(pool) for _ in range(r.randint(0, 8)))) for _ in range(120)]
    rows += [(3, None), (None, None), (41, ""), (42, "\n\n"), (43, "\n".join(["a shared line here", "z"] * 3000)), (1, rows[0][1]), (1, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("_id", "_text", "_gone", "_k1", "n_lines", "_row", "_at")})
    out = line_dedup.dedup(docs, min_docs=min_docs)
    assert set(out.columns) == {*docs.columns, "n_dropped"} and {x["_gone"] for x in out.collect()} == {"clash"}
    assert sorted([(x.doc_id, x.text, x.n_lines, x.n_dropped) for x in out.collect()], key=repr) == brute_lines(rows, min_docs)


def test_lines_of_empty_tables(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_query(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, k, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, n, k in brute_lines(rows))
    assert sorted((x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in queries.op13_line_dedup(spark, DATA).collect()) == want


def test_lines_query_as_sql(spark):
    from tests.oracle import connect, difference

    assert difference(queries.op13_line_dedup(spark, DATA), connect(DATA), queries.SQL["op13_line_dedup"]) == ""
