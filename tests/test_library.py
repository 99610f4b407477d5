from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chartspan.functions import text, times
from chartspan.functions.calculator import calculate
from chartspan.operators import cohort, labels, metrics, ontology, prompts, sampling, text_index
from chartspan.sources import tables
from chartspan.streaming import ingest


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_times(spark):
    assert str(one(spark, times.parsed, "2023-10-15T14:30:00Z")) == "2023-10-15 14:30:00"
    assert str(one(spark, times.parsed, "2023-10-15 14:30")) == "2023-10-15 14:30:00"
    assert one(spark, times.parsed, "garbage") is None and one(spark, times.minutes_only, "2023-10-15T14:30") is None
    assert str(one(spark, times.end_of_day, "2023-10-15")).startswith("2023-10-15 23:59:59")


def test_text(spark):
    assert one(spark, text.title_case, "o'neil-smith") == "O'Neil-Smith"
    assert one(spark, lambda c: text.head_tail(c, 60), "a" * 50 + "b" * 50) == "a" * 20 + " [truncated] " + "b" * 20
    assert one(spark, text.estimated_tokens, "") == 1 and one(spark, lambda c: text.last_tokens(c, 2), "x" * 20) == "x" * 8


@pytest.mark.parametrize("given,want", [("2 + 2", "4"), ("(5+3)*2", "16"), ("1/4", "0.25"), ("2**10", "1024"), ("1/0", "Error: division by zero"), ("__import__('os')", "Error: not arithmetic"), ("9**9**9", "Error: not arithmetic")])
def test_calculator(given, want):
    assert calculate(given) == want


def test_answers(spark):
    for raw, want in [('{"outcome": "True"}', "yes"), ("No", "no"), ("So the answer is yes because", "yes"), ("maybe", None), ("yes and no", None)]:
        assert one(spark, labels.binary, raw) == want
    assert one(spark, labels.categorical, "The severity appears to be moderate.") == "moderate" and one(spark, labels.grade_number, "severe") == 3
    assert one(spark, labels.parse_yes_no, "Yes, because") == "Yes" and one(spark, labels.parse_yes_no, "I say no") == "No"
    assert one(spark, labels.parse_tri, "label -1") == "1" and one(spark, labels.parse_tri, "-1") == "-1"
    assert one(spark, labels.ground_truth, "TRUE") == "yes" and one(spark, lambda c: labels.ground_truth(c, False), "2") == "moderate"
    assert one(spark, labels.reason, "Reason:  a  b ") == "a b" and one(spark, labels.reason, "") == labels.NO_REASON
    assert one(spark, labels.reason, " ".join(["w"] * 50)) == " ".join(["w"] * 45) + "."
    assert one(spark, labels.is_calculation, "what is 5 + 3") and not one(spark, labels.is_calculation, "what is 5 year lab")


def test_cohort_records(spark, tmp_path):
    (tmp_path / "c.csv").write_text("person_id,embed_time,extra\n1,2020-01-01,a\n1,2021-01-01,b\n2,,c\n,2020-01-01,d\n3,2020-02-02,\n")
    got = {r.person_id: r.cutoff_date for r in tables.read_cohort_records(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"1": "2020-01-01", "2": None, "3": "2020-02-02"}
    got = tables.read_cohort_records(spark, str(tmp_path / "c.csv"), complete=True).collect()
    assert [r.person_id for r in got] == ["1"]


def vocabulary(folder):
    (folder / "CONCEPT.csv").write_text(
        "concept_id\tvocabulary_id\tconcept_code\tconcept_name\tinvalid_reason\tstandard_concept\n1\tSNOMED\t123456\t\"A\" one\t\tS\n2\tSNOMED\t789012\tB\t\tS\n3\tRxNorm\tABC123\tC\t\tS\n4\tSNOMED\t999999\tD\tD\tS\n5\tICD10CM\tE11.9\tE\t\t\n"
    )
    (folder / "CONCEPT_RELATIONSHIP.csv").write_text("concept_id_1\tconcept_id_2\trelationship_id\n5\t1\tMaps to\n1\t2\tIs a\n1\t1\tMaps to\n")
    (folder / "CONCEPT_ANCESTOR.csv").write_text("ancestor_concept_id\tdescendant_concept_id\tmin_levels_of_separation\n2\t1\t1\n3\t1\t2\n1\t2\t1\n")


def test_ontology(spark, tmp_path):
    (tmp_path / "v").mkdir()
    vocabulary(tmp_path / "v")
    read = lambda n: tables.read_vocabulary(spark, str(tmp_path), n)
    rows = ontology.coded(read("CONCEPT"))
    assert rows.count() == 4 and ontology.coded(read("CONCEPT"), False).count() == 5
    names = ontology.descriptions(rows)
    assert {r.code: r.description for r in names.collect()}["OMOP_CONCEPT_ID/1"] == '"A" one'
    edges = ontology.edges(rows, read("CONCEPT_RELATIONSHIP"), read("CONCEPT_ANCESTOR"))
    assert {(r.child, r.parent) for r in edges.collect()} == {("ICD10CM/E11.9", "SNOMED/123456"), ("SNOMED/123456", "SNOMED/789012"), ("SNOMED/789012", "SNOMED/123456")}
    start = names.where("code = 'ICD10CM/E11.9'").select("code")
    nodes, links = ontology.closure(start, edges, names)  # with a cycle
    assert {r.code for r in nodes.collect()} == {"ICD10CM/E11.9", "SNOMED/123456", "SNOMED/789012"} and links.count() == 3
    nodes, links = ontology.closure(start, edges, names, vocabularies=["RxNorm"])
    assert [r.code for r in nodes.collect()] == ["ICD10CM/E11.9"] and links.count() == 0
    assert ontology.closure_counts(nodes, links).first().asDict() == {"root": "ICD10CM/E11.9", "node_count": 1, "edge_count": 0}
    own = spark.createDataFrame([("ICD10CM/E11.9", "CUSTOM/1")], "child string, parent string")
    replaced = ontology.edges(rows, read("CONCEPT_RELATIONSHIP"), read("CONCEPT_ANCESTOR"), own)
    assert [r.parents for r in ontology.parents_of(replaced).where("code = 'ICD10CM/E11.9'").collect()] == [["CUSTOM/1"]]
    tables.write_vocabulary(names, ontology.parents_of(edges), str(tmp_path / "out"))
    assert tables.read_ontology(spark, str(tmp_path / "out"))[1].count() == 3


def reference_balance(hits, k):
    """hits: (label, score) in order. An independent statement of the allocation."""
    by = {}
    for i, (lab, s) in enumerate(hits):
        by.setdefault(lab, []).append((i, s))
    order = sorted(by, key=lambda x: (-max(s for _, s in by[x]), str(x)))[:2]
    if not order:
        return []
    take = {x: 0 for x in order}
    share = [(k + 1) // 2, k // 2][: len(order)]
    for x, n in zip(order, share):
        take[x] = min(n, len(by[x]))
    left = k - sum(take.values())
    for x in order:
        more = min(left, len(by[x]) - take[x])
        take[x] += more
        left -= more
    queues, out = {x: [i for i, _ in by[x][: take[x]]] for x in order}, []
    while any(queues.values()):
        for x in order:
            if queues[x]:
                out.append(queues[x].pop(0))
    return out[:k]


def test_balanced_neighbours(spark):
    r = random.Random(4)
    rows, want = [], {}
    for q in range(60):
        k, hits = 4, sorted(((r.choice([0, 1]), round(r.random(), 3)) for _ in range(r.randint(0, 9))), key=lambda x: -x[1])
        rows += [("t", q, 1000 * q + i, 1000 * q + i, -1, lab, s) for i, (lab, s) in enumerate(hits)]
        want[q] = reference_balance(hits, k)
    df = spark.createDataFrame(rows, "corpus string, query int, doc long, person_id long, query_person long, label int, score double")
    got = {}
    for x in cohort.nearest(df, 4).orderBy("query", "position").collect():
        got.setdefault(x["query"], []).append(x.doc - 1000 * x["query"])
    assert {q: v for q, v in want.items() if v} == got
    assert cohort.nearest(df.withColumn("query_person", F.col("person_id")), 4).count() == 0
    again = cohort.rebalanced(cohort.nearest(df, 4, balanced=False), 4, 1)
    assert again.groupBy("query").count().agg(F.max("count")).first()[0] <= 4


def test_states(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "1")], "person_id string, embed_time string")
    with pytest.raises(ValueError, match="occurs 2 times"):
        cohort.checked(rows)
    row = spark.createDataFrame([("v", {"t": " ", "u": "x"})], "vignette string, task_vignettes map<string,string>")
    got = row.select(cohort.vignette_for_task(F.lit("t")).alias("a"), cohort.vignette_for_task(F.lit("u")).alias("b")).first()
    assert (got.a, got.b) == ("v", "x")


def test_samples_ignore_partitions(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    a = sampling.stratified(rows.repartition(7), ["g"], 10, 1, "id").select("id").orderBy("id").collect()
    assert a == sampling.stratified(rows.coalesce(1), ["g"], 10, 1, "id").select("id").orderBy("id").collect() and len(a) == 30
    quotas = sampling.ratio_quotas(rows, "g", "y", 20).groupBy("g").agg(F.sum("quota").alias("q")).collect()
    assert all(r.q == 20 for r in quotas)
    assert [r.quota for r in sampling.even_quotas(rows, "g", 11).orderBy("g").collect()] == [4, 4, 3]
    with pytest.raises(ValueError, match="places"):
        sampling.even_quotas(rows, "g", 3000)


def test_metrics(spark):
    rows = spark.createDataFrame([("t", 1, 1), ("t", 1, None), ("t", 0, 0), ("u", 1, 1)], "task string, label int, pred int")
    got = {r.task: r for r in metrics.accuracy(rows, ["task"]).collect()}
    assert got["t"].accuracy == pytest.approx(2 / 3) and got["t"].accuracy_parsed == 1 and got["u"].balanced_accuracy is None
    auc = metrics.bootstrap_auc(spark.range(200).select("id", (F.col("id") >= 100).cast("int").alias("y"), F.col("id").cast("double").alias("s")), "y", "s", "id", 20).first()
    assert auc.auc == 1 and auc.low == 1
    assert {r.bin: r.n for r in metrics.histogram(spark.range(6), "id", [0, 2, 4]).collect()} == {"(0, 2]": 3, "(2, 4]": 2, "> 4": 1}
    values = spark.range(1, 11).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    assert metrics.nearest_rank(values, ["g"], "v", 0.5).first().value == 5 and metrics.interpolated(values, ["g"], "v", 0.5).first().value == 5.5


def test_prompts(spark):
    queries = spark.createDataFrame([(1, "H", "Q" * 2000), (2, "H", "q")], "prompt_id int, header string, query string")
    examples = spark.createDataFrame([(1, 0, "a" * 400), (1, 1, "b" * 800), (2, 0, "x"), (2, 1, "y")], "prompt_id int, pos int, text string")
    got = {r.prompt_id: r for r in prompts.assembled(queries, examples, 300).collect()}
    assert got[1].n_dropped == 2 and got[1].query_cut and len(got[1].prompt) // 4 <= 300
    assert got[2].prompt == "H\n\nEXAMPLES:\n\nx\n\ny\n\n---\n\nNEW PATIENT:\n\nq"
    assert {r.n_dropped for r in prompts.assembled(queries, examples).collect()} == {0}


def test_rubrics(spark):
    rows = spark.createDataFrame([('[{"field_name": "abc", "value": "xy"}, {"field_name": "d", "value": "N/A"}]',), ('{"AGE": 70, "SEX": {"now": "unknown"}}',), ("**Field:** value\nother",), ("plain",)], "t string")
    got = [tuple(r)[1:5] for r in prompts.with_rubric_sizes(rows, "t").collect()]
    assert got == [(4, 5, 2, 1), (9, 9, 2, 1), (10, 5, 1, 0), (5, 0, 0, 0)]
    quality = one(spark, lambda c: prompts.text_quality(c, "(?i)scan", "(?i)nodule", r"\d+ mm", "(?i)stable"), "CT scan showed a nodule. The nodule is 4 mm. Scan done.")
    assert quality.n_sentences == 3 and quality.n_result == 2 and quality.passes


def test_results_and_caches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, at int")
    assert tables.upsert(rows.limit(0), rows, ["k"], "at").first().v == "b"
    tables.append_results(rows.select("k", "v"), str(tmp_path / "r"), ["k"])
    tables.append_results(spark.createDataFrame([(1, "c"), (2, "d")], "k int, v string"), str(tmp_path / "r"), ["k"])
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    requests = spark.createDataFrame([("1", "s", "u", ""), ("2", "s", "w", None), ("3", "s", "z", "kept")], "request_id string, system string, user string, value string")
    outputs = spark.createDataFrame([("1", "s", "u", "by id"), (None, "s", "w", "by content"), ("3", "s", "z", "new")], "request_id string, system string, user string, text string")
    assert {r.request_id: r.value for r in tables.reingested(requests, outputs).collect()} == {"1": "by id", "2": "by content", "3": "kept"}
    said = spark.createDataFrame([('{"candidates":[{"content":{"parts":[{"text":"t","thought":true},{"text":"out"}]}}]}', None), ("{}", "failed")], "response string, status string")
    assert [r.text for r in tables.model_text(said).collect()] == ["out"]
    arrays = tmp_path / "arr" / "taskA"
    arrays.mkdir(parents=True)
    (arrays / "train.json").write_text('[{"a": 1}, {"a": 2}]')
    assert {(r.task, r.split, r.a) for r in tables.read_json_arrays(spark, str(tmp_path / "arr" / "*")).collect()} == {("taskA", "train", 1), ("taskA", "train", 2)}


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, " ")], "id int, t string")
    text_index.build(docs, "id", "t").save(str(tmp_path / "i"))
    index = text_index.Index.load(spark, str(tmp_path / "i"))
    asked = text_index.query_terms(spark.createDataFrame([(9, "B b")], "q int, t string"), "q", "t")
    assert [r.doc for r in text_index.top(text_index.bm25(index, asked), 5).orderBy("rank").collect()] == [1, 2]
    assert text_index.fingerprint(docs, "id", "t").collect() == text_index.fingerprint(docs.repartition(3), "id", "t").collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("<R><encounter><events><entry timestamp='2023-01-01 00:00'><event type='x' name='y'/></entry></events></encounter></R>")
    for _ in range(2):
        ingest.ingest(ingest.read_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        (tmp_path / "in" / "b.xml").write_text((tmp_path / "in" / "a.xml").read_text())
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert {r.person_id for r in rows.collect()} == {"a", "b"} and rows.count() == 2
    counts = ingest.windowed_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")), width="1 day").first()
    assert counts.n == 2


def test_stream_drops_late_events(spark, tmp_path):
    """Two runs of one stream: a window that changed is counted anew, an event behind the watermark is dropped, and the table can be read
    between and after."""
    def run(name, *rows):
        made = spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
        made.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in" / "*"))
        ingest.counted(ingest.windowed_counts(stream), str(tmp_path / "counts"), str(tmp_path / "ck")).awaitTermination()
        return {(x.start.hour, x.event_type): x.n for x in ingest.current_counts(spark, str(tmp_path / "counts")).collect()}

    assert run("a", ("2024-01-01 00:10:00", "x"), ("2024-01-01 08:10:00", "x")) == {(0, "x"): 1, (8, "x"): 1}
    got = run("b", ("2024-01-01 00:20:00", "x"), ("2024-01-01 07:20:00", "x"), ("2024-01-01 08:20:00", "x"), ("2024-01-01 08:30:00", "y"))
    assert got == {(0, "x"): 1, (7, "x"): 1, (8, "x"): 2, (8, "y"): 1}


def test_closure_is_never_cut(spark):
    names = spark.createDataFrame([(f"n{i}", str(i)) for i in range(9)], "code string, description string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)] + [("n8", "n0")], "child string, parent string")
    start = names.where("code = 'n0'").select("code")
    nodes, links = ontology.closure(start, edges, names)
    assert {(x.code, x.level) for x in nodes.collect()} == {(f"n{i}", i) for i in range(9)} and links.count() == 9
    with pytest.raises(ValueError):
        ontology.closure(start, edges, names, most_levels=3)
    assert ontology.closure(start.limit(0), edges, names)[0].count() == 0


def test_stems_and_stored_indexes(spark, tmp_path):
    codes = spark.createDataFrame([("A/1", "Fractured bones"), ("A/2", "a bone"), ("A/3", "skin")], "code string, description string")
    assert [x.code for x in text_index.code_search(codes, "bones", 5).collect()] == ["A/1"]
    assert {x.code for x in text_index.code_search(codes, "bones", 5, stem=True).collect()} == {"A/1", "A/2"}
    path = str(tmp_path / "i")
    folders = lambda: {x.name for x in (tmp_path / "i").iterdir()}
    first = text_index.cached(codes, "code", "description", path)
    was = folders()
    assert text_index.cached(codes.repartition(2), "code", "description", path).postings.count() == first.postings.count() == 5 and folders() == was
    text_index.cached(codes.where("code <> 'A/3'"), "code", "description", path)
    assert len(folders()) == 2
    text_index.clear_cache(codes, path)
    assert text_index.cached(codes, "code", "description", path).postings.count() == 5


def test_vocabulary_of_most_frequent_terms(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "a e f")], "id int, t string")
    index = text_index.build(docs, "id", "t")
    assert {x.term for x in text_index.vocabulary(index, 4).collect()} == {"a", "b", "c", "d"}
    asked = text_index.query_terms(spark.createDataFrame([(9, "a c e")], "q int, t string"), "q", "t")
    plain, kept = text_index.tfidf(index, asked, 4), text_index.tfidf(index, asked, 4, text_index.tfidf_norms(index, 4))
    assert sorted(plain.collect()) == sorted(kept.collect()) and plain.count() == 3


def test_rows_in_file_order(spark, tmp_path):
    for name, n in (("b", 400), ("a", 300)):
        (tmp_path / f"{name}.csv").write_text("patient_id,value\n" + "".join(f"{name}{i},{i % 2}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = tables.read_labels(spark, {"t": str(tmp_path / "*.csv")}).orderBy("_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x.patient_id for x in rows] == [f"a{i}" for i in range(300)] + [f"b{i}" for i in range(400)]


def test_cohort_store(spark, tmp_path):
    states = spark.createDataFrame([("p", "t1", "0", "v", {"a": "x"}), ("p", "t2", "1", "w", None)], tables.STATES)
    items = spark.createDataFrame([("p", "t1", "a", "q", 1, None, "0"), ("p", "t2", "b", "q", 0, "d", "1")], tables.ITEMS)
    tables.write_cohort(states, items, str(tmp_path / "c"))
    s, i = tables.read_cohort(spark, str(tmp_path / "c"))
    assert sorted(s.collect(), key=str) == sorted(states.collect(), key=str) and sorted(i.collect(), key=str) == sorted(items.collect(), key=str)
    assert cohort.items_for(i, "p", task="b").first().label == 0 and [x.embed_time for x in cohort.states_for(s, "p").collect()] == ["t1", "t2"]
    assert cohort.updated(s, states.where("embed_time = 't1'").withColumn("vignette", F.lit("new"))).where("vignette = 'new'").count() == 1
    with pytest.raises(ValueError):
        cohort.with_cutoffs(i, "other")


def test_tasks_of_the_same_texts_are_searched_once(spark, monkeypatch):
    texts = {i: f"w{i % 3} w{i % 5} w{i % 7} all" for i in range(40)}
    rows = [(i, t, i % 2 if t == "b" else 1 - i % 2, x + (" more" if t == "c" and i == 9 else "")) for i, x in texts.items() for t in "abc"]
    items = spark.createDataFrame([(i, t, label, "t") for i, t, label, _ in rows if i % 4], "person_id long, task string, label int, embed_time string").withColumn("split", F.lit(0))
    states = spark.createDataFrame([(i, "t", 0, x, {"c": x + " more"} if i == 9 else None) for i, x in texts.items()], "person_id long, embed_time string, split int, vignette string, task_vignettes map<string,string>")
    asked = text_index.query_terms(spark.createDataFrame([(t, i, x) for i, t, _, x in rows if i % 4 == 0], "corpus string, q long, x string"), "q", "x")
    index, pool = cohort.task_index(items, states, 0)
    searched = []
    real = text_index.bm25_best
    monkeypatch.setattr(text_index, "bm25_best", lambda index, asked, *a: searched.append(sorted(r[0] for r in asked.select("corpus").distinct().collect())) or real(index, asked, *a))
    found = {(r.corpus, r["query"], r.position): (r.person_id, r.label, r.score) for r in cohort.neighbours(index, pool, asked, 4).collect()}
    assert searched == [["a", "c"]] and {c for c, *_ in found} == set("abc")  # c's text of one person is another
    alone = asked.where("corpus = 'b'")
    one = cohort.nearest(text_index.top(real(index, alone, 32), 32).join(pool.withColumnRenamed("task", "corpus"), ["corpus", "doc"]).withColumn("query_person", F.col("query")), 4)
    assert {k: v for k, v in found.items() if k[0] == "b"} == {(r.corpus, r["query"], r.position): (r.person_id, r.label, r.score) for r in one.collect()}
