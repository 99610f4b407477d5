"""Queries beside those of the catalogue: sources, cohorts and texts, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.functions import text, times
from chartspan.operators import cohort, context, events, facets, labels, metrics, ontology, ordered, prompts, sampling, text_index
from chartspan.plans.catalog import AT, CUTOFF, SHOWN, _events, _facet_docs, _FACET_DOCS, query
from chartspan.session import table
from chartspan.sources import tables

# ---- vocabulary snapshots: parts are concepts, line items their relationships

_CONCEPTS = """c0 AS (SELECT p_partkey AS concept_id, p_brand || '/' || p_partkey AS code, p_name AS description, p_size % 3 = 0 AS non FROM part WHERE p_size % 10 <> 0)"""


def _snapshot(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CONCEPT, CONCEPT_RELATIONSHIP and CONCEPT_ANCESTOR as a snapshot has them: all columns are text."""
    part, items = table(spark, sf, "part"), table(spark, sf, "lineitem")
    concepts = part.select(
        F.col("p_partkey").cast("string").alias("concept_id"), F.col("p_brand").alias("vocabulary_id"), F.col("p_partkey").cast("string").alias("concept_code"), F.col("p_name").alias("concept_name"),
        F.when(F.col("p_size") % 10 == 0, "D").alias("invalid_reason"), F.when(F.col("p_size") % 3 != 0, "S").alias("standard_concept"),
    )
    a, b = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    relations = items.select(a.alias("concept_id_1"), b.alias("concept_id_2"), F.when(F.col("l_returnflag") == "N", "Maps to").otherwise("Is a").alias("relationship_id"))
    ancestors = items.select(b.alias("ancestor_concept_id"), a.alias("descendant_concept_id"), F.col("l_linenumber").cast("string").alias("min_levels_of_separation"))
    return concepts, relations, ancestors


@query("WITH " + _CONCEPTS + """, m AS (SELECT x.code AS child, y.code AS parent, 'maps_to' AS kind FROM lineitem JOIN c0 x ON x.concept_id = l_partkey JOIN c0 y ON y.concept_id = l_suppkey WHERE l_returnflag = 'N' AND l_partkey <> l_suppkey AND x.non),
a AS (SELECT x.code AS child, y.code AS parent, 'ancestor' AS kind FROM lineitem JOIN c0 x ON x.concept_id = l_partkey JOIN c0 y ON y.concept_id = l_suppkey WHERE l_linenumber = 1) SELECT * FROM m UNION SELECT * FROM a""")
def vocabulary_edges(spark, sf):
    concepts, relations, ancestors = _snapshot(spark, sf)
    return ontology.edges(ontology.coded(concepts), relations, ancestors)


@query("WITH " + _CONCEPTS + " SELECT code, description FROM c0 UNION ALL SELECT 'OMOP_CONCEPT_ID/' || concept_id, description FROM c0")
def concept_descriptions(spark, sf):
    return ontology.descriptions(ontology.coded(_snapshot(spark, sf)[0]))


@query("WITH " + _CONCEPTS + ", own AS (SELECT p_brand || '/' || p_partkey AS code, 'own ' || p_name AS description FROM part WHERE p_size = 7), b AS (SELECT code, description FROM c0 UNION ALL SELECT 'OMOP_CONCEPT_ID/' || concept_id, description FROM c0) SELECT coalesce(b.code, own.code) AS code, coalesce(own.description, b.description) AS description FROM b FULL JOIN own ON b.code = own.code")
def custom_descriptions(spark, sf):
    part = table(spark, sf, "part").where("p_size = 7")
    own = part.select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("code"), F.concat(F.lit("own "), "p_name").alias("description"))
    return ontology.descriptions(ontology.coded(_snapshot(spark, sf)[0]), own)


@query("SELECT p_brand AS vocabulary, count(*) AS n_concepts, count(*) FILTER (p_size % 3 = 0) AS n_non_standard FROM part WHERE p_size % 10 <> 0 GROUP BY p_brand")
def vocabulary_counts(spark, sf):
    rows = ontology.coded(_snapshot(spark, sf)[0])
    return rows.groupBy(text.vocabulary_of(F.col("code")).alias("vocabulary")).agg(F.count(F.lit(1)).alias("n_concepts"), F.count_if("is_non_standard").alias("n_non_standard"))


# ---- ranked search of events

_SEARCH = """WITH t AS (SELECT event_id, unnest(regexp_extract_all(lower(props), '[\\p{L}\\p{N}_]+')) AS term FROM events), p AS (SELECT event_id, term, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT event_id, count(*) AS len FROM t GROUP BY event_id),
c AS (SELECT count(*) AS n, avg(len) AS avgdl FROM l), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT p.event_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))), 6) AS score FROM p JOIN d USING (term) JOIN l USING (event_id), c WHERE term IN ('k', '42') GROUP BY p.event_id)
"""


@query(_SEARCH + f"SELECT event_id, coalesce(score, 0) AS score, {AT} FROM events LEFT JOIN s USING (event_id) WHERE event_type IN ('click', 'view') ORDER BY score DESC, event_id LIMIT 100")
def event_search_ranked(spark, sf):
    rows = _events(spark, sf)
    asked = text_index.query_terms(spark.range(1).select("id", F.lit("k 42").alias("q")), "id", "q")
    scores = text_index.bm25(text_index.build(rows, "event_id", "content", only=asked), asked).select(F.col("doc").alias("event_id"), F.round("score", 6).alias("score"))
    return events.search(rows, scores, events.Filters(event_types=["click", "view"], max_results=100)).selectExpr("event_id", "score", SHOWN)


# ---- persons and times


@query("""SELECT c_custkey, CASE WHEN a < 18 THEN '0-17' WHEN a < 35 THEN '18-34' WHEN a < 50 THEN '35-49' WHEN a < 65 THEN '50-64' ELSE '65+' END AS age_range, CASE c_custkey % 4 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' WHEN 2 THEN NULL ELSE 'O''Neil-Smith' END AS gender,
CASE c_custkey % 3 WHEN 0 THEN 'Non-Hispanic' WHEN 1 THEN 'Hispanic' ELSE NULL END AS ethnicity, c_mktsegment AS insurance FROM (SELECT *, c_custkey % 97 AS a FROM customer)""")
def normalised_demographics(spark, sf):
    key = F.col("c_custkey")
    gender = F.when(key % 4 == 0, "FEMALE").when(key % 4 == 1, "male").when(key % 4 == 2, " ").otherwise("o'neil-smith")
    ethnicity = F.when(key % 3 == 0, "NOT HISPANIC or Latino").when(key % 3 == 1, "hispanic").otherwise("")
    plan = F.concat(F.col("c_mktsegment"), F.lit(" | OTHER"))
    return table(spark, sf, "customer").select(
        "c_custkey", facets.age_range(key % 97).alias("age_range"), context.normalised_gender(gender).alias("gender"), facets.normalised_ethnicity(ethnicity).alias("ethnicity"), facets.first_insurance(plan).alias("insurance")
    )


@query("SELECT o_orderkey, CAST(date_diff('year', d, DATE '2024-03-01') - CASE WHEN strftime(d, '%m%d') > '0301' THEN 1 ELSE 0 END AS INTEGER) AS age FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def age_at_cutoff(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", times.age_years(F.col("o_orderdate").cast("date"), F.lit("2024-03-01").cast("date")).alias("age"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN strftime(ts, '%H:%M:%S') = '00:00:00' THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS shown, '[' || strftime(ts, '%B %d, %Y') || '] ' || event_type AS line, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def event_time_texts(spark, sf):
    raw = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return _events(spark, sf).select("event_id", times.day_key(F.col("ts")).alias("day"), times.display(times.parsed(raw)).alias("shown"), context.dated_line(F.col("ts"), F.col("event_type")).alias("line"), labels.iso_time(raw).alias("iso"))


# ---- point-in-time joins of neighbours

_ANCHORS = "pairs AS (SELECT a.c_custkey AS query_id, b.c_custkey AS person_id FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1), last AS (SELECT o_custkey, max(o_orderdate) AS cutoff FROM orders GROUP BY o_custkey)"


def _neighbour_events(spark: SparkSession, sf: str, anchor: str) -> DataFrame:
    """Each customer's neighbour, the one of the next key, with the neighbour's orders up to its own last order or the query's."""
    people, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    pairs = people.select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") + 1).alias("person_id")).join(people.select(F.col("c_custkey").alias("person_id")), "person_id", "left_semi")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("cutoff"))
    landmarks = pairs.join(last, F.col(anchor) == F.col("o_custkey")).drop("o_custkey")
    rows = orders.select(F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("ts"), "o_totalprice", F.lit(1).cast("long").alias("one"))
    found = ordered.as_of(landmarks, rows, "person_id", "cutoff", "ts", sums={"n": "one", "total": "o_totalprice"})
    return found.where("n > 0").select("query_id", "person_id", "n", F.round("total", 2).alias("total"))


def _neighbour_sql(anchor: str) -> str:
    return f"WITH {_ANCHORS} SELECT query_id, person_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM pairs JOIN last ON last.o_custkey = pairs.{anchor} JOIN orders o ON o.o_custkey = pairs.person_id AND o_orderdate <= cutoff GROUP BY ALL"


@query(_neighbour_sql("query_id"))
def neighbours_at_query_cutoff(spark, sf):
    return _neighbour_events(spark, sf, "query_id")


@query(_neighbour_sql("person_id"))
def neighbours_at_own_cutoff(spark, sf):
    return _neighbour_events(spark, sf, "person_id")


# ---- cohorts and sets


@query("SELECT split, count(*) AS n, count(quality) AS n_labelled, count(*) FILTER (quality = 1) AS n_positive FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'valid' ELSE 'train' END AS split FROM documents) LEFT JOIN labels USING (doc_id) GROUP BY split")
def labels_by_split(spark, sf):
    key = F.col("doc_id") % 10
    splits = table(spark, sf, "documents").select("doc_id", F.when(key == 0, "test").when(key == 1, "valid").otherwise("train").alias("split"))
    return cohort.split_counts(splits, table(spark, sf, "labels"), "doc_id", "quality")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def id_set_semi_join(spark, sf):
    return cohort.in_set(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").where("toxic = 1"), "doc_id")


@query("SELECT o_custkey AS person_id FROM orders INTERSECT SELECT user_id FROM events")
def key_intersection(spark, sf):
    return cohort.keys_in(table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id")), table(spark, sf, "events").select(F.col("user_id").alias("person_id")), "both")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def key_difference(spark, sf):
    return cohort.keys_in(table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "first", "c_custkey")


@query("SELECT event_type AS task FROM events UNION SELECT lang FROM documents")
def task_union(spark, sf):
    return cohort.keys_in(table(spark, sf, "events").select(F.col("event_type").alias("task")), table(spark, sf, "documents").select(F.col("lang").alias("task")), "either", "task")


@query("SELECT count(*) AS n_persons FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderdate) > 1)")
def persons_with_several_landmarks(spark, sf):
    return metrics.several_landmarks(table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("embed_time")))


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_row_per_key(spark, sf):
    return metrics.last_per_key(table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("SELECT k, v FROM (SELECT user_id AS k, event_id AS v FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id FROM events WHERE event_type = 'click') QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1")
def key_value_upsert(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), "event_type")
    return tables.upsert(rows.where("event_type = 'view'").drop("event_type"), rows.where("event_type = 'click'").drop("event_type"), ["k"], "v")


@query("SELECT event_type AS model, count(*) AS n_entries, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY event_type")
def cache_statistics(spark, sf):
    found = tables.cache_stats(_events(spark, sf), "event_type", "ts")
    return found.select(F.col("event_type").alias("model"), "n_entries", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_at", "last_at")])


@query("WITH g AS (SELECT lang, row_number() OVER (ORDER BY lang) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT lang FROM documents)), q AS (SELECT lang, 42 // k + CASE WHEN i <= 42 % k THEN 1 ELSE 0 END AS quota FROM g) SELECT d.doc_id, d.lang FROM documents d JOIN q USING (lang) QUALIFY row_number() OVER (PARTITION BY d.lang ORDER BY md5('11:' || d.doc_id), d.doc_id) <= any_value(quota) OVER (PARTITION BY d.lang)")
def even_sample(spark, sf):
    rows = table(spark, sf, "documents")
    return sampling.by_quota(rows, sampling.even_quotas(rows, "lang", 42), ["lang"], 11, "doc_id").select("doc_id", "lang")


@query("SELECT conv_id, arg_min(role, turn) AS first_role, CAST(count(*) AS BIGINT) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def conversation_totals(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


# ---- texts


def _said() -> Column:
    k = F.col("event_id") % 6
    return F.when(k == 0, "Yes, it is.").when(k == 1, "no").when(k == 2, "The evidence says YES here").when(k == 3, "-1").when(k == 4, "It is 0 I think").otherwise("unclear")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Yes' ELSE NULL END AS yes_no, CASE event_id % 6 WHEN 3 THEN '-1' WHEN 4 THEN '0' ELSE NULL END AS tri FROM events")
def yes_no_and_tri(spark, sf):
    return table(spark, sf, "events").select("event_id", labels.parse_yes_no(_said()).alias("yes_no"), labels.parse_tri(_said()).alias("tri"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'severe' WHEN 1 THEN 'moderate' WHEN 2 THEN 'normal' ELSE NULL END AS grade, CAST(CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE NULL END AS INTEGER) AS number FROM events")
def grade_parsing(spark, sf):
    k = F.col("event_id") % 4
    grade = labels.categorical(F.when(k == 0, "critical").when(k == 1, "The severity is Moderate.").when(k == 2, "nl").otherwise("?"))
    return table(spark, sf, "events").select("event_id", grade.alias("grade")).withColumn("number", labels.grade_number(F.col("grade")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'same ' || event_type ELSE 'seen ' || event_type END AS reason FROM events")
def reason_texts(spark, sf):
    even = F.col("event_id") % 2 == 0
    raw = F.when(even, F.concat(F.lit('{"reason": "same  '), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit("Reason:  seen "), "event_type"))
    return table(spark, sf, "events").select("event_id", labels.reason(raw).alias("reason"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 190) || ' [truncated] ' || right(text, 190) END AS short, CASE WHEN length(text) <= 400 THEN text ELSE right(text, 400) END AS tail FROM documents")
def head_and_tail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.head_tail(F.col("text"), 400).alias("short"), text.last_tokens(F.col("text"), 100).alias("tail"))


@query("SELECT n_name, CASE WHEN r_name IS NULL THEN 'own' ELSE r_name END AS vignette FROM nation LEFT JOIN (SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS r_name FROM region) ON n_regionkey = r_regionkey")
def task_vignettes(spark, sf):
    from chartspan.operators.cohort import vignette_for_task

    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = rows.select("n_name", F.lit("own").alias("vignette"), F.create_map(F.lit("t"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).otherwise(" ")).alias("task_vignettes"))
    return rows.select("n_name", vignette_for_task(F.lit("t")).alias("vignette"))


@query("SELECT item_id, CAST(len(s) AS INTEGER) AS n_sentences FROM (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM benchmark)")
def sentence_counts(spark, sf):
    report = prompts.text_quality(F.col("text"), r"\bdone\b", r"\bfound\b", r"\d", r"\bthen\b")
    return table(spark, sf, "benchmark").select("item_id", report["n_sentences"].alias("n_sentences"))


# ---- facets, percentiles


@query("WITH " + _FACET_DOCS + " SELECT person_id FROM docs WHERE (lower(segment) LIKE 'build%' OR lower(nation) LIKE 'build%' OR list_contains(list_transform(priorities, lambda p: starts_with(lower(p), 'build')), true)) AND list_contains(list_transform(priorities, lambda p: contains(lower(p), 'urgent')), true)")
def facet_text_search(spark, sf):
    docs = _facet_docs(spark, sf)
    return docs.where(facets.mentions(docs, "build urgent")).select("person_id")


@query("WITH " + _FACET_DOCS + ", fresh AS (SELECT * FROM docs WHERE balance < 0) SELECT person_id, encounter_count FROM docs WHERE person_id NOT IN (SELECT person_id FROM fresh) UNION ALL SELECT person_id, -1 FROM fresh")
def facet_upsert(spark, sf):
    docs = _facet_docs(spark, sf)
    fresh = docs.where("balance < 0").withColumn("encounter_count", F.lit(-1).cast("long"))
    return facets.upserted(docs, fresh).select("person_id", "encounter_count")


@query("WITH r AS (SELECT source, n_chars AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY source) AS k FROM documents) SELECT source, max(v) FILTER (i = greatest(1, CAST(ceil(k * 0.95) AS BIGINT))) AS value FROM r GROUP BY source")
def nearest_rank_percentile(spark, sf):
    return metrics.nearest_rank(table(spark, sf, "documents"), ["source"], "n_chars", 0.95)


@query("SELECT source, round(quantile_cont(n_chars, 0.9), 4) AS value FROM documents GROUP BY source")
def interpolated_percentile(spark, sf):
    return metrics.interpolated(table(spark, sf, "documents"), ["source"], "n_chars", 0.9).withColumn("value", F.round("value", 4))


@query(f"SELECT user_id AS person_id, count(*) AS n_through, count(*) FILTER (ts < TIMESTAMP '{CUTOFF}') AS n_before FROM events WHERE ts <= TIMESTAMP '{CUTOFF}' GROUP BY user_id")
def history_through_cutoff(spark, sf):
    rows = _events(spark, sf)
    at = rows.select("person_id").distinct().withColumn("cutoff", F.lit(CUTOFF).cast("timestamp_ntz"))
    found = context.at_landmarks(rows, at, "through")
    return found.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_through"), F.count_if(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")).alias("n_before"))
