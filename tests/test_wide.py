"""Structures that are made to be asked often, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chartspan.operators import metrics, ontology, ordered, reach, sampling, typo_search
from chartspan.sources import mutable
from chartspan.streaming import ingest


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_typing_errors(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.choice([1, 3, 4, 5, 6, 7, 8, 9, 10, 13])))
    vocabulary = [word() for _ in range(120)]

    def typed(w):
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcé") + w[i:], w[:i] + r.choice("abcé") + w[i + 1 :]]) or "a"
        return w if r.random() < 0.8 else w[: r.randint(1, len(w))]

    docs = {i: " ".join(r.sample(vocabulary, 8)) for i in range(60)} | {60: None, 61: " -- "}
    asked = {q: " ".join(typed(r.choice(vocabulary)) for _ in range(r.randint(1, 3))) for q in range(80)} | {80: "", 81: None}
    df = spark.createDataFrame([(i, t, ["Zebra", None]) for i, t in docs.items()], "doc long, text string, more array<string>")
    typo_search.build(df, "doc", "text", "more").save(f"{tmp_path}/index")
    index = typo_search.TypoIndex.load(spark, f"{tmp_path}/index")
    found = typo_search.search(index, spark.createDataFrame(list(asked.items()), "q long, text string"), "q", "text", None).collect()
    want = set()
    for q, text in asked.items():
        words = re.findall(r"\w+", (text or "").lower())
        for i, t in docs.items():
            held, costs = {*re.findall(r"\w+", (t or "").lower()), "zebra"}, []
            for n, w in enumerate(words):
                most = 2 if len(w) >= 9 else 1 if len(w) >= 5 else 0
                ways = [2 * e for x in held if (e := edits(w, x)) <= most] + [1 for x in held if n == len(words) - 1 and x.startswith(w) and x != w]
                costs += [min(ways)] if ways else []
            if words and len(costs) == len(words):
                want.add((q, i, sum(c // 2 for c in costs), sum(c % 2 for c in costs)))
    assert len(want) > 200 and {(x["query"], x.doc, x.edits, x.begun) for x in found} == want
    by_query = {}
    for x in sorted(found, key=lambda x: x["rank"]):
        by_query.setdefault(x["query"], []).append((x.edits, x.begun, x.doc))
    assert all(v == sorted(v) for v in by_query.values())


@pytest.mark.parametrize("through", [True, False])
def test_as_of(spark, through):
    r = random.Random(through)
    times = lambda: r.choice([None, *range(40)])
    key = lambda: r.choice([None, "a", "a", "a", "b", "c", "d"])
    marks = [(i, key(), times(), "clash") for i in range(200)] + [(999, "nobody", 5, "clash")]
    events = [(key(), times(), r.choice([None, *range(50)]), r.choice([None, 1, 2])) for _ in range(300)]
    got = ordered.as_of(
        spark.createDataFrame(marks, "i long, k string, at long, _part string").repartition(5), spark.createDataFrame(events, "k string, ts long, v long, w long").repartition(4), "k", "at", "ts", {"seen": "v", "also": "w"}, {"total": "w"}, through
    ).collect()
    low = lambda x: (x is not None, x or 0)
    want = []
    for i, k, at, c in marks:
        own = sorted((e for e in events if None not in (k, at, e[1]) and e[0] == k and (e[1] <= at if through else e[1] < at)), key=lambda e: (e[1], low(e[2]), low(e[3])))
        sums = [e[3] for e in own if e[3] is not None]
        want.append((i, k, at, c, own[-1][2] if own else None, own[-1][3] if own else None, sum(sums) if sums else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_values_are_carried_over_parts(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("k"), "id", F.when(F.col("id") % 1700 == 3, F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    held = ordered.in_order(rows.repartition(8), "k", "id")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert held.select("_part").distinct().count() > 1
    got = ordered.carried(held, ["k"], seen=(F.col("v"), "last"), total=(F.col("v"), "sum")).collect()
    assert all(x.seen == (None if x.id < 3 else (x.id - 3) // 1700 * 1700 + 3) for x in got)
    assert all((x.total or 0) == sum(v for v in (3, 1703, 3403) if v <= x.id) for x in got)


def test_a_chain_of_a_thousand_levels(spark, tmp_path, monkeypatch):
    rounds = []
    monkeypatch.setattr(reach, "written", lambda df, name, f=reach.written: rounds.append(name) or f(df, name))
    n = 1000
    edges = spark.createDataFrame([(f"V/{i}", f"V/{i + 1}") for i in range(n)] + [("V/7", "V/7"), ("V/3", "V/unknown"), (None, "V/1"), ("V/1", None)], "child string, parent string")
    concepts = spark.range(n + 1).select(F.concat(F.lit("V/"), "id").alias("code"), F.lit("x").alias("description"))
    reach.build(edges, concepts).save(f"{tmp_path}/r")
    assert rounds.count("reach") <= 12
    index = reach.Reach.load(spark, f"{tmp_path}/r")
    assert index.pairs.count() == n * (n + 1) // 2 and index.pairs.where("level <> cast(substr(reached, 3) as int) - cast(substr(code, 3) as int)").count() == 0
    nodes, links = reach.closure(index, spark.createDataFrame([("V/0",), ("V/990",), ("V/1000",), (None,)], "code string"), concepts)
    assert {x.root: x["count"] for x in nodes.groupBy("root").count().collect()} == {"V/0": 1001, "V/990": 11, "V/1000": 1}
    assert links.where("root = 'V/0'").count() == 1001  # with the loop at V/7
    assert reach.Reach.load(spark, f"{tmp_path}/none") is None


@pytest.mark.parametrize("up", [True, False])
def test_reach_is_the_closure(spark, up):
    r = random.Random(up)
    codes = [f"{r.choice('AB')}/{i}" for i in range(40)]
    edges = spark.createDataFrame([(r.choice(codes), r.choice(codes)) for _ in range(70)], "child string, parent string")
    concepts = spark.createDataFrame([(c, f"about {c}") for c in codes[:36]], "code string, description string")
    starts = spark.createDataFrame([(c,) for c in codes], "code string")
    for vocabularies in (None, ["A"]):
        want = ontology.closure(starts, edges, concepts, up, vocabularies)
        got = reach.closure(reach.build(edges, concepts, up, vocabularies), starts, concepts)
        assert sorted(map(tuple, got[0].collect())) == sorted(map(tuple, want[0].collect()))
        assert sorted(map(tuple, got[1].collect())) == sorted(map(tuple, want[1].collect()))
    assert reach.build(edges.limit(0), concepts).pairs.count() == 0


@pytest.mark.parametrize("bits", [4, 12])
def test_samples_by_cuts(spark, monkeypatch, bits):
    monkeypatch.setattr(sampling, "BITS", bits)
    r = random.Random(bits)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), r.choice([0, 1, None])) for i in range(700)] + [(700, "alone", 1), (5, "a", 0)]
    df = spark.createDataFrame(rows, "i long, g string, y int")
    quotas = {"a": 120, "b": 0, "c": 10_000, "alone": 1, "nobody": 4}
    order = sorted(rows, key=lambda x: (hashlib.md5(f"9:{x[0]}".encode()).hexdigest(), x[0]))
    got = sampling.by_quota(df, spark.createDataFrame(list(quotas.items()), "g string, quota long"), ["g"], 9, "i").collect()
    own = lambda g: [x for x in order if x[1] == g]
    # rows of one id share their draw and come in together
    want = [x for g, q in quotas.items() for x in own(g) if q and (q > len(own(g)) or x[0] in {y[0] for y in own(g)[:q]})]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    turned = {(x.i, x.g): x.y for x in sampling.flipped(df.where("y is not null"), "y", 30, 9, "g", "i").collect()}
    for g in "abc":
        flips = [x for x in [y for y in order if y[2] is not None] if x[1] == g and turned[x[0], g] != x[2] and x[0] != 5]
        assert 28 <= len(flips) <= 30
    named = sampling.balanced(df, "g", "y", 41, 9, "i", names=(-1, 9)).groupBy("g", "y").count().collect()
    assert {(x.g, x.y): x["count"] for x in named if x.g in ("a", "c")} == {("a", 9): 20, ("a", -1): 21, ("c", 9): 20, ("c", -1): 21}


def test_interpolated_percentiles(spark):
    r = random.Random(1)
    rows = [(r.choice("abc"), r.choice([None, r.randrange(20), r.randrange(1000)])) for _ in range(400)] + [("d", 7), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    for q in (0.0, 0.1, 0.5, 0.937, 1.0):
        got = {x.k: x.value for x in metrics.interpolated(df, ["k"], "v", q).collect()}
        want = {x.k: x.v for x in df.where("v is not null").groupBy("k").agg(F.percentile("v", q).alias("v")).collect()}
        assert got == pytest.approx(want)


def test_mutable_table(spark, tmp_path, monkeypatch):
    t = mutable.MutableTable(spark, str(tmp_path / "t"), ["k", "g"], "at", buckets=5)
    assert t.rows() is None and t.get(spark.createDataFrame([("a", 1)], "k string, g long")) is None
    r, want, reads = random.Random(3), {}, []
    monkeypatch.setattr(mutable.MutableTable, "_read", lambda self, held, f=mutable.MutableTable._read: reads.append(sorted(held)) or f(self, held))
    for n in range(9):
        fresh = [(r.choice([None, "a", "b", "c", "dd"]), r.randrange(3), r.randrange(20), f"{n}-{i}") for i in range(r.choice([0, 1, 4, 12]))]
        fresh = list({(k, g): (k, g, at, v) for k, g, at, v in sorted(fresh, key=lambda x: x[2])}.values())
        for k, g, at, v in fresh:
            if (k, g) not in want or want[k, g][0] <= at:
                want[k, g] = (at, v)
        assert t.put(spark.createDataFrame(fresh, "k string, g long, at long, v string")) == n + 1
        assert {(x.k, x.g): (x.at, x.v) for x in t.rows().collect()} == want
    # one key more: one bucket is read at most
    reads.clear()
    t.put(spark.createDataFrame([("a", 1, 99, "last")], "k string, g long, at long, v string"))
    assert all(len(x) <= 1 for x in reads)
    got = t.get(spark.createDataFrame([("a", 1), ("a", 1), ("nobody", 0)], "k string, g long")).collect()
    assert [(x.at, x.v) for x in got] == [(99, "last")] and len(reads[-1]) <= 2
    before = sorted(map(tuple, t.rows().collect()), key=repr)
    assert t.vacuum() > 0 and sorted(map(tuple, t.rows().collect()), key=repr) == before


def test_stream_compacted_and_restarted(spark, tmp_path):
    """Counts are the same whether batches were folded or not, over restarts; what is read is the base and the batches after it."""
    out = str(tmp_path / "counts")

    def run(name, *rows):
        made = spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
        made.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in" / "*"))
        ingest.counted(ingest.windowed_counts(stream), out, str(tmp_path / "ck"), compact_every=2).awaitTermination()
        return {(x.start.hour, x.event_type): x.n for x in ingest.current_counts(spark, out).collect()}

    want = {}
    for n in range(5):
        want[5, f"x{n}"] = 1
        want[5, "y"] = n + 1
        assert run(str(n), ("2024-01-01 05:10:00", f"x{n}"), ("2024-01-01 05:20:00", "y")) == want
    left = sorted(p.name for p in (tmp_path / "counts").iterdir() if p.is_dir())
    folded = ingest._folded(spark, out)
    assert folded >= 3 and all(int(x.split("=")[1]) > folded for x in left) and len(left) <= 2
    ingest.compact(spark, out, ["start", "end", "event_type"], folded)  # again: nothing changes
    assert {(x.start.hour, x.event_type): x.n for x in ingest.current_counts(spark, out).collect()} == want


def test_typo_search_writes_no_word_of_every_document(spark, monkeypatch):
    names = []
    monkeypatch.setattr(typo_search, "written", lambda df, name, f=typo_search.written: names.append((name, df.columns)) or f(df, name))
    docs = spark.createDataFrame([(1, "patient with asthma"), (1, "patient with asthma"), (2, "asthmatic patient"), (3, "no word")], "doc long, text string").repartition(16)
    asked = spark.createDataFrame([(7, "patiemt asthma")], "q long, text string")
    for rows in (typo_search.SENT_ROWS, 0):
        monkeypatch.setattr(typo_search, "SENT_ROWS", rows)
        found = typo_search.search(typo_search.build(docs, "doc", "text"), asked, "q", "text", None).collect()
        assert [(r.doc, r.edits, r.begun, r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1, 0, 1), (2, 1, 1, 2)]
    assert not [n for n, columns in names if "doc" in columns]
