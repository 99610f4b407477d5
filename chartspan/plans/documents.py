"""Queries over XML timelines and what is made of them: documents are built from the events table within the query and parsed again,
so that the SQL can be stated on the table. A user is a person, a day an encounter, an event an entry."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.operators import cohort, context, facets, metrics, text_index
from chartspan.plans.catalog import _BM25, CUTOFF, _cohort, _events, _made, _results, query
from chartspan.session import shared_dir, table, written
from chartspan.sources import tables, timelines

#: The kinds that events stand for; their codes are of few values, so that persons share some.
KINDS = {"click": "condition", "view": "drug_exposure", "purchase": "visit_detail", "error": "note"}

_USER = """p AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, CASE user_id % 3 WHEN 0 THEN 'No matching concept' WHEN 1 THEN 'Asian' ELSE 'White' END AS race, CASE WHEN user_id % 4 = 0 THEN 'Hispanic' ELSE 'Non-Hispanic' END AS ethnicity,
CAST(user_id % 90 AS INTEGER) AS age, CAST(DATE '1950-01-01' + CAST(user_id % 20000 AS INTEGER) AS DATE) AS born, 'P' || (user_id % 5) AS plan FROM events)"""
_ROWS = """e AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'click' THEN 'condition' WHEN 'view' THEN 'drug_exposure' WHEN 'purchase' THEN 'visit_detail' WHEN 'error' THEN 'note' ELSE event_type END AS kind,
CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) - 1 AS INTEGER) AS enc, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) - 1 AS INTEGER) AS ent, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) - 1 AS INTEGER) AS flat FROM events),
x AS (SELECT *, CASE WHEN kind = 'note' THEN 'STANFORD_NOTE/' WHEN k % 2 = 0 THEN 'SNOMED/' ELSE 'OTHER/' END || kind || (k % 7) AS code, CASE k % 3 WHEN 0 THEN 'progress notes' WHEN 1 THEN 'Letter' END AS title FROM e)"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """(person_id, xml, size): a document of each user. Grouped by person, as documents are."""
    rows = table(spark, sf, "events")
    u, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("long")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")], F.col("event_type"))
    prefix = F.when(kind == "note", "STANFORD_NOTE/").when(k % 2 == 0, "SNOMED/").otherwise("OTHER/")
    title = F.when(k % 3 == 0, ' note_title="progress notes"').when(k % 3 == 1, ' note_title="Letter"').otherwise("")
    entry = F.concat(
        F.lit('<entry timestamp="'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"><event type="'), kind, F.lit('" code="'), prefix, kind, (k % 7).cast("string"), F.lit('" name="'), "event_type", F.lit('" unit="u" note_id="'),
        F.col("event_id").cast("string"), F.lit('"'), title, F.lit(">"), F.format_string("%d", F.floor("value")), F.lit("</event></entry>"),
    )
    person = F.concat(
        F.lit("<person><birthdate>"), F.date_add(F.lit("1950-01-01").cast("date"), (u % 20000).cast("int")).cast("string"), F.lit("</birthdate><age><years>"), (u % 90).cast("string"), F.lit("</years></age><demographics><gender>"),
        F.when(u % 2 == 0, "FEMALE").otherwise("male"), F.lit("</gender><race>"), F.when(u % 3 == 0, "No matching concept").when(u % 3 == 1, "Asian").otherwise("White"), F.lit("</race><ethnicity>"),
        F.when(u % 4 == 0, "Hispanic or Latino").otherwise("Not Hispanic"), F.lit("</ethnicity></demographics><payerplan>P"), (u % 5).cast("string"), F.lit(" | OTHER</payerplan></person>"),
    )
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda m: m["x"]), "")
    days = rows.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(joined(F.struct("event_id", entry.alias("x"))).alias("entries"))
    visit = F.concat(F.lit("<encounter>"), person, F.lit("<events>"), "entries", F.lit("</events></encounter>"))
    docs = days.groupBy(F.col("user_id").cast("string").alias("person_id")).agg(F.concat(F.lit("<ROOT>"), joined(F.struct("day", visit.alias("x"))), F.lit("</ROOT>")).alias("xml"))
    return docs.withColumn("size", F.octet_length("xml").cast("long"))


def _at(rows: DataFrame) -> DataFrame:
    return rows.select("person_id").distinct().withColumn("cutoff", F.lit(CUTOFF).cast("timestamp_ntz"))


def _shown(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("at")


# ---- documents


@query("WITH " + _ROWS + " SELECT CAST(user_id AS VARCHAR) AS person_id, user_id || '_event_' || flat AS event_id, user_id || '_enc' || enc || '_ent' || ent || '_ev0' AS visit_event_id, enc AS enc_idx, ent AS ent_idx, 0 AS ev_idx, flat AS flat_idx, stamp AS at, kind AS event_type, code, event_type AS name, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, 'u' AS unit, title AS note_title FROM x")
def xml_events(spark, sf):
    rows = timelines.events(_documents(spark, sf))
    return rows.select("person_id", "event_id", "visit_event_id", "enc_idx", "ent_idx", "ev_idx", "flat_idx", _shown("ts"), "event_type", "code", "name", "value", "unit", F.col("attrs")["note_title"].alias("note_title"))


@query("WITH " + _ROWS + " SELECT user_id || '_entry_' || flat AS event_id, enc AS enc_idx, ent AS ent_idx, stamp AS at, 'entry' AS event_type FROM x")
def xml_entries(spark, sf):
    return timelines.events(_documents(spark, sf), "entry").select("event_id", "enc_idx", "ent_idx", _shown("ts"), "event_type")


@query("WITH " + _ROWS + " SELECT CAST(user_id AS VARCHAR) AS person_id, enc AS enc_idx, count(*) AS n, user_id || '_enc' || enc || '_ent0_ev0' AS first_event FROM x GROUP BY user_id, enc")
def xml_visits(spark, sf):
    rows = timelines.events(_documents(spark, sf))
    return rows.groupBy("person_id", "enc_idx").agg(F.count(F.lit(1)).alias("n"), F.min_by("visit_event_id", "flat_idx").alias("first_event"))


@query("WITH " + _ROWS + ", " + _USER + " SELECT CAST(p.user_id AS VARCHAR) AS person_id, enc AS enc_idx, true AS has_events, true AS has_person, CAST(born AS VARCHAR) AS birthdate, CAST(age AS VARCHAR) AS age_years, plan || ' | OTHER' AS payerplan FROM (SELECT DISTINCT user_id, enc FROM x) v JOIN p USING (user_id)")
def xml_persons(spark, sf):
    return timelines.persons(_documents(spark, sf)).select("person_id", "enc_idx", "has_events", "has_person", "birthdate", "age_years", "payerplan")


@query("WITH " + _ROWS + ", " + _USER + """ SELECT CAST(p.user_id AS VARCHAR) AS person_id, gender, race, ethnicity, age, CASE WHEN age < 18 THEN '0-17' WHEN age < 35 THEN '18-34' WHEN age < 50 THEN '35-49' WHEN age < 65 THEN '50-64' ELSE '65+' END AS age_range, plan AS insurance_type, n AS encounter_count, d AS diagnosis_codes, m AS medication_codes, v AS departments
FROM p JOIN (SELECT user_id, count(DISTINCT enc) AS n, coalesce(array_to_string(list_sort(list(DISTINCT split_part(code, '/', 2)) FILTER (kind = 'condition')), ','), '') AS d, coalesce(array_to_string(list_sort(list(DISTINCT split_part(code, '/', 2)) FILTER (kind = 'drug_exposure')), ','), '') AS m,
coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (kind = 'visit_detail')), ','), '') AS v FROM x GROUP BY user_id) USING (user_id)""")
def xml_facet_documents(spark, sf):
    docs = _documents(spark, sf)
    found = facets.documents(timelines.events(docs), timelines.persons(docs))
    lists = [F.array_join(c, ",").alias(c) for c in ("diagnosis_codes", "medication_codes", "departments")]
    return found.select("person_id", "gender", "race", "ethnicity", "age", "age_range", "insurance_type", "encounter_count", *lists)


@query("WITH " + _USER + f", a AS (SELECT *, date_diff('year', born, DATE '{CUTOFF[:10]}') - CASE WHEN strftime(born, '%m%d') > strftime(DATE '{CUTOFF[:10]}', '%m%d') THEN 1 ELSE 0 END AS years FROM p) SELECT CAST(user_id AS VARCHAR) AS person_id, 'PATIENT DEMOGRAPHICS AT PREDICTION TIME:' || chr(10) || 'Age: ' || years || ' years' || chr(10) || 'Sex: ' || lower(gender) || chr(10) || CASE WHEN race <> 'No matching concept' THEN 'Race: ' || race || chr(10) ELSE '' END || 'Ethnicity: ' || CASE WHEN ethnicity = 'Hispanic' THEN 'Hispanic or Latino' ELSE 'Not Hispanic' END || chr(10) AS demographics FROM a")
def xml_demographics(spark, sf):
    docs = _documents(spark, sf)
    return context.demographics(timelines.persons(docs), _at(docs)).select("person_id", "demographics")


@query("WITH " + _USER + f" SELECT CAST(user_id AS VARCHAR) AS person_id, CAST(floor(date_diff('day', born, DATE '{CUTOFF[:10]}') / 365.25) AS INTEGER) AS age, race FROM p")
def xml_compact_persons(spark, sf):
    docs = _documents(spark, sf)
    return context.compact_persons(timelines.persons(docs), _at(docs)).select("person_id", "age", "race")


@query("WITH " + _ROWS + f" SELECT CAST(user_id AS VARCHAR) AS person_id, enc AS enc_idx, ent AS ent_idx, 1 AS n_events, code, coalesce(title, '') AS note_title, false AS has_id FROM x WHERE CAST(stamp AS TIMESTAMP) <= TIMESTAMP '{CUTOFF}'")
def xml_hoisted_entries(spark, sf):
    docs = _documents(spark, sf)
    found = context.hoisted(context.compact(timelines.events(docs), _at(docs)))
    first = F.get("events", F.lit(0))
    return found.select("person_id", "enc_idx", "ent_idx", F.size("events").alias("n_events"), first["code"].alias("code"), F.coalesce(first["attrs"]["note_title"], F.lit("")).alias("note_title"), F.map_contains_key(first["attrs"], F.lit("note_id")).alias("has_id"))


@query("WITH " + _ROWS + " SELECT user_id || '_event_' || flat AS event_id FROM x WHERE code LIKE 'SNOMED/%' OR (code LIKE 'STANFORD_NOTE/%' AND title = 'progress notes')")
def xml_allowed_events(spark, sf):
    rows = timelines.events(_documents(spark, sf))
    return rows.where(context.allowed(("SNOMED", "STANFORD_NOTE"), ("progress notes",))).select("event_id")


@query("WITH " + _ROWS + f" SELECT CAST(user_id AS VARCHAR) AS person_id, string_agg('[' || stamp || '] ' || kind || ' | ' || code || ' | ' || event_type || ' | ' || CAST(floor(value) AS BIGINT), chr(10) ORDER BY flat) AS text FROM x WHERE CAST(stamp AS TIMESTAMP) <= TIMESTAMP '{CUTOFF}' AND (code LIKE 'SNOMED/%' OR (code LIKE 'STANFORD_NOTE/%' AND title = 'progress notes')) GROUP BY user_id")
def xml_linearised(spark, sf):
    docs = _documents(spark, sf)
    return context.linearised(timelines.events(docs), _at(docs), keep=context.allowed(("SNOMED", "STANFORD_NOTE"), ("progress notes",))).select("person_id", "text")


@query("SELECT count(DISTINCT user_id) AS n_documents, count(*) AS n_events, count(DISTINCT user_id) AS n_persons, count(DISTINCT event_type) AS n_types, count(*) AS n_dated FROM events")
def xml_store_stats(spark, sf):
    docs = _documents(spark, sf)
    return timelines.store_stats(timelines.events(docs), docs).select("n_documents", "n_events", "n_persons", "n_types", "n_dated")


@query("SELECT user_id || '' AS person_id, CASE WHEN user_id % 3 = 0 THEN 'there' ELSE 'new' END AS came FROM (SELECT DISTINCT user_id FROM events)")
def xml_load_twice(spark, sf):
    """A store of some documents, then all loaded, twice: what is there stays as it is."""
    docs = written(_documents(spark, sf).withColumn("came", F.lit("new")), "documents")
    store = docs.where(F.col("person_id").cast("long") % 3 == 0).withColumn("came", F.lit("there"))
    for _ in range(2):
        store = store.unionByName(timelines.append_new(store, docs))
    return store.select("person_id", "came")


# ---- cohorts from records to neighbours

_LIN = f"""k AS (SELECT *, CAST(ts AS DATE) AS d FROM events WHERE ts <= TIMESTAMP '{CUTOFF}'), b AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) AS r FROM k GROUP BY user_id, d),
lin AS (SELECT k.user_id AS doc_id, string_agg('[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || event_type || ' | ' || props, chr(10) ORDER BY event_id) AS text FROM k JOIN b ON k.user_id = b.user_id AND k.d = b.d AND r <= 2 GROUP BY k.user_id)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).withColumns({"ts_raw": F.date_format("ts", "yyyy-MM-dd HH:mm"), "text_all": F.col("content"), "attrs": F.create_map(F.lit("type"), F.col("event_type"))})


@query(_BM25.format(corpus="'all'", docs="lin", qid="doc_id", queries="(SELECT * FROM lin WHERE doc_id % 100 = 0)").replace("WITH t AS", "WITH " + _LIN + ", t AS", 1) + "SELECT query, doc AS person_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS INTEGER) AS rank FROM s WHERE doc <> query QUALIFY rank <= 5")
def records_to_similar(spark, sf):
    """Every person whose id is divisible by 100 against all."""
    rows = _lines(spark, sf)
    return cohort.similar_persons(_at(rows), _at(rows).where("person_id % 100 = 0"), rows, 5)


@query(f"WITH l AS (SELECT user_id, max(ts) AS own FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id AS person_id, count(*) FILTER (ts < own) AS n_own, count(*) FILTER (ts < TIMESTAMP '{CUTOFF}') AS n_query, count(*) AS n_none FROM events JOIN l USING (user_id) GROUP BY user_id")
def corpus_cutoff_modes(spark, sf):
    rows = _events(spark, sf)
    records = rows.where("event_type = 'purchase'").groupBy("person_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("cutoff_date"))
    counts = [context.at_landmarks(rows, cohort.with_cutoffs(records, m, CUTOFF), "before").groupBy("person_id").agg(F.count(F.lit(1)).alias(f"n_{m}")) for m in ("own", "query", "none")]
    found = records.select("person_id").join(counts[0], "person_id", "left").join(counts[1], "person_id", "left").join(counts[2], "person_id", "left")
    return found.na.fill(0)


# ---- stores and sinks


@query("WITH " + _LIN + " SELECT doc_id AS person_id, text FROM lin")
def cached_contexts(spark, sf):
    """Contexts of some persons are cached first; then all are asked for, and only the others are made."""
    rows = _lines(spark, sf)
    marks = _at(rows)
    path, keys = f"{shared_dir(spark)}/contexts-{uuid.uuid4().hex}", ["person_id", "cutoff"]
    make = lambda missing: context.linearised(rows, missing, 2)
    tables.cached_by_key(marks.where("person_id % 2 = 0"), path, keys, make)
    return tables.cached_by_key(marks, path, keys, make).select("person_id", "text")


@query(_BM25.format(corpus="'all'", docs="(SELECT p_partkey AS doc_id, p_name AS text FROM part)", qid="n_nationkey", queries="(SELECT n_nationkey, 'cyan blue part ' || n_nationkey AS text FROM nation)") + "SELECT query, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 5")
def cached_index_search(spark, sf):
    """The index is built at first and read the second time."""
    parts, path = table(spark, sf, "part"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    asked = text_index.query_terms(table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("cyan blue part "), F.col("n_nationkey").cast("string")).alias("t")), "n_nationkey", "t")
    text_index.cached(parts, "p_partkey", "p_name", path)
    index = text_index.cached(parts, "p_partkey", "p_name", path)
    return text_index.top(text_index.bm25(index, asked).withColumn("score", F.round("score", 6)), 5).select("query", "doc", "score", "rank")


@query("SELECT CAST(doc_id AS VARCHAR) AS person_id, 'quality' AS task, quality AS label, CAST(doc_id % 10 AS VARCHAR) AS split, lang AS vignette FROM labels JOIN documents USING (doc_id)")
def cohort_store(spark, sf):
    """Written as JSON lines, read back typed, joined at their own time."""
    states, items = _cohort(spark, sf)
    lang = table(spark, sf, "documents").select(F.col("doc_id").alias("person_id"), "lang")
    states = states.join(lang, "person_id").select(F.col("person_id").cast("string").alias("person_id"), "embed_time", F.col("split").cast("string").alias("split"), F.col("lang").alias("vignette"), "task_vignettes")
    items = cohort.items_for(items, task="quality").select(F.col("person_id").cast("string").alias("person_id"), "embed_time", "task", F.col("label").cast("int").alias("label"), F.col("split").cast("string").alias("split"))
    path = f"{shared_dir(spark)}/cohort-{uuid.uuid4().hex}"
    tables.write_cohort(states, items, path)
    states, items = tables.read_cohort(spark, path)
    return cohort.joined(items, states).select("person_id", "task", "label", "split", "vignette")


@query("SELECT lang, CAST(count(*) AS VARCHAR) AS n, CAST(sum(n_chars) AS VARCHAR) AS total FROM documents GROUP BY lang")
def csv_sink(spark, sf):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total")), path, ["lang"])
    return spark.read.csv(path, header=True)


# ---- metrics


@query("WITH " + _made(1) + ", " + _made(2) + " SELECT v1.doc_id, v1.task, v1.pred, CASE WHEN v1.doc_id % 2 = 0 THEN v2.pred END AS tool FROM v1 JOIN v2 USING (doc_id)")
def tool_left_join(spark, sf):
    rows, tool = _results(spark, sf, 1), _results(spark, sf, 2).where("doc_id % 2 = 0")
    return metrics.with_tool(rows.select("doc_id", "task", "pred"), tool, ["doc_id", "task"], "pred")


_RIGHT = "coalesce({0}.pred = v1.label, false)"


@query("WITH " + ", ".join(map(_made, (1, 2, 3))) + ", r AS (SELECT v1.task, " + ", ".join(_RIGHT.format(f"v{i}") + f" AS {c}" for i, c in ((1, "a"), (2, "b"), (3, "c"))) + " FROM v1 JOIN v2 USING (doc_id) JOIN v3 USING (doc_id)) SELECT task, count(*) AS n, count(*) FILTER (a) AS right_a, count(*) FILTER (b) AS right_b, count(*) FILTER (c) AS right_c, count(*) FILTER (a AND NOT b AND NOT c) AS only_a, count(*) FILTER (b AND NOT a AND NOT c) AS only_b, count(*) FILTER (c AND NOT a AND NOT b) AS only_c, count(*) FILTER (a AND b AND c) AS all_right, count(*) FILTER (NOT a AND NOT b AND NOT c) AS none_right FROM r GROUP BY task")
def three_way_comparison(spark, sf):
    rows = _results(spark, sf, 1)
    for i in (2, 3):
        rows = metrics.with_tool(rows, _results(spark, sf, i), ["doc_id", "task"], "pred", f"pred{i}")
    return metrics.three_ways(rows, "task", "label", "pred", "pred2", "pred3")


@query("SELECT min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def items_per_task(spark, sf):
    return metrics.items_per_task(_events(spark, sf).withColumnRenamed("event_type", "task"))


@query("SELECT lang AS task, count(*) AS n, round(avg(length(text) / (length(source) + length(text) + 1.0)), 6) AS value_ratio, round(avg(CASE WHEN n_chars < 500 THEN 1.0 ELSE 0.0 END), 6) AS missing_ratio FROM documents GROUP BY lang")
def schema_value_ratio(spark, sf):
    rows = table(spark, sf, "documents").select("lang", F.length("source").alias("s"), F.length("text").alias("v"), F.when(F.col("n_chars") < 500, 1.0).otherwise(0.0).alias("m"))
    return metrics.schema_ratio(rows, "lang", "s", "v", "m").select(F.col("lang").alias("task"), "n", F.round("value_ratio", 6).alias("value_ratio"), F.round("missing_ratio", 6).alias("missing_ratio"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def persons_without_open_orders(spark, sf):
    left, right = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.pending(left, right, ["c_custkey"])
