"""Queries that leave out no row: held against brute force over all of them."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chartspan.operators import cohort, text_index
from chartspan.plans import catalog


@pytest.mark.parametrize("name, k", [("unbalanced_neighbors", 5), ("balanced_neighbors", 4)])
def test_neighbours_among_all_labelled_texts(spark, tmp_path, name, k):
    r = random.Random(8)
    texts = {i: " ".join(r.choice("abcdefghijklmnop") * 2 for _ in range(r.randint(3, 9))) for i in range(40)}
    texts[17], texts[8] = texts[11] + " zz", texts[21] + " zz"  # the nearest texts lie in splits 7 and 8
    labels = {i: (i % 2, i % 3 % 2) for i in texts if i != 25}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, *v) for i, v in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {}
    for x in catalog.QUERIES[name](spark, str(tmp_path)).orderBy("task", "query", "position").collect():
        got.setdefault((x.task, x["query"]), []).append(x.person_id)
    pool = {i: Counter(texts[i].split()) for i in labels if i % 10 != 1}
    average = sum(map(Counter.total, pool.values())) / len(pool)
    df = Counter(t for c in pool.values() for t in c)
    for q in (i for i in labels if i % 10 == 1):
        scores = {}
        for i, c in pool.items():
            s = sum(math.log(1 + (len(pool) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / average)) for t in texts[q].split() if c[t])
            if s:
                scores[i] = round(s, 6)
        best = sorted(scores, key=lambda i: (-scores[i], i))
        for n, task in enumerate(("quality", "toxic")):
            if name.startswith("unbalanced"):
                assert got[task, q] == best[:k]
            else:
                sides = {v: [i for i in best if labels[i][n] == v][: k // 2] for v in (0, 1)}
                first = labels[best[0]][n]
                assert got[task, q] == [x for pair in zip(sides[first], sides[1 - first]) for x in pair]
    assert len(got) == 8 and got["quality", 11][0] == 17 and got["toxic", 21][0] == 8


def test_corpora_alike_of_more_rows_than_a_wide_sum_holds(spark):
    rows = spark.range(18_000_000).selectExpr("'a' AS corpus", "id AS query", "'x' AS term", "1L AS qtf")
    words = spark.createDataFrame([("a", 1, ["x"])], "corpus string, doc long, terms array<string>")
    assert [tuple(r) for r in cohort.alike(words, rows).collect()] == [("a", "a")]


@pytest.mark.parametrize("copied, distinct", [(0, 60), (40, 20)])
def test_documents_and_queries_of_one_text_are_searched_once(spark, monkeypatch, copied, distinct):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghijklmnop") * 2 for _ in range(r.randint(4, 12))) + f" own{i}" for i in range(60)]
    texts = [texts[7] if 10 <= i < 10 + copied else t for i, t in enumerate(texts)]  # more of one text than are among a query's best
    states = spark.createDataFrame([(i, "t", 0, t, None) for i, t in enumerate(texts)], "person_id long, embed_time string, split int, vignette string, task_vignettes map<string,string>")
    items = spark.createDataFrame([(i, "t", t, i % 2 if t == "a" else i % 3 % 2, 0) for i in range(60) for t in "ab"], "person_id long, embed_time string, task string, label int, split int")
    queries = spark.createDataFrame([(t, 100 + i, texts[i // 2]) for i in range(20) for t in "ab"], "corpus string, query long, text string")
    read, real = [], text_index.bm25_best
    monkeypatch.setattr(text_index, "bm25_best", lambda index, asked, *a: read.append((index.words.count(), asked.select("corpus", "query").distinct().count())) or real(index, asked, *a))
    got = cohort.neighbours_by_text(items, states, 0, queries, 4)
    index, pool = cohort.task_index(items, states, 0)
    scores = text_index.top(text_index.bm25(index, text_index.query_terms(queries, "query", "text")).withColumn("score", F.round("score", 6)), 32)
    want = cohort.nearest(scores.join(pool.withColumnRenamed("task", "corpus"), ["corpus", "doc"]).withColumn("query_person", F.col("query")), 4)
    rows = lambda df: sorted(map(tuple, df.select("corpus", "query", "position", "person_id", "label", "score").collect()))
    assert rows(got) == rows(want) and len({x[:2] for x in rows(got)}) == 40
    assert read == [(len(set(texts)), 10)] and len(set(texts)) == distinct
