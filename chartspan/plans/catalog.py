"""The library's operators over the given tables, each with the SQL of the same result.

Stand-ins: events.user_id is the person, its calendar day the encounter, props the attributes; documents are texts to rank,
labels their labels, doc_id % 10 the split; customers with their orders are facet documents; parts, brands, types, nations and
regions form the hierarchy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.functions.text import estimated_tokens
from chartspan.operators import activity, cohort, context, events, facets, labels, metrics, ontology, sampling, text_index
from chartspan.session import shared_dir, table, written
from chartspan.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CUTOFF = "2024-01-20 12:00:00"
SHOWN = "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as at"
AT = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS at"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rows.select(
        F.col("user_id").alias("person_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", F.col("event_type").alias("name"), F.concat(F.lit("EV/"), "event_type").alias("code"),
        F.col("value").alias("amount"), F.format_string("%d", F.floor("value")).alias("value"), F.lit("u").alias("unit_source_value"), F.from_json("props", "map<string,string>").alias("attrs"), F.col("props").alias("content"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01")).alias("enc_idx"), F.col("event_id").alias("flat_idx"),
    )


def _landmarks(rows: DataFrame) -> DataFrame:
    return rows.select("person_id").distinct().withColumn("cutoff", F.lit(CUTOFF).cast("timestamp_ntz"))


def _six(c: str):
    return F.round(c, 6).alias(c)


# ---- events


@query(f"""SELECT event_id, user_id AS person_id, {AT} FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 500""")
def events_by_type(spark, sf):
    f = events.Filters(start="2024-01-05", end="2024-01-15", sort_by="date_asc", max_results=500)
    return events.by_type(_events(spark, sf), "purchase", f).selectExpr("event_id", "person_id", SHOWN)


@query(f"""SELECT event_id, user_id AS person_id, {AT}, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'error' AND json_extract_string(props, '$.k') IN ('1','2','3','5','8','13','21','34','55','89')""")
def event_history_attr(spark, sf):
    found = events.history(_events(spark, sf), {"k": ["1", "2", "3", "5", "8", "13", "21", "34", "55", "89"]}, "error")
    return found.selectExpr("event_id", "person_id", SHOWN, "attrs['k'] as k")


@query(f"""WITH first AS (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 800) SELECT event_id, {AT} FROM first WHERE json_extract_string(props, '$.k') = '7'""")
def event_history_limit_first(spark, sf):
    return events.history(_events(spark, sf), {"k": "7"}, "error", events.Filters(sort_by="date_asc", max_results=800)).selectExpr("event_id", SHOWN)


@query(f"""SELECT event_id, {AT} FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND regexp_matches(json_extract_string(props, '$.k'), '^[4-6]') AND event_type IN ('click', 'view') AND length(props) >= 9 ORDER BY ts DESC, event_id LIMIT 300""")
def event_filters_sorted(spark, sf):
    import re

    f = events.Filters(start="2024-01-10", end="2024-01-12", event_types=["click", "view"], attributes={"k": re.compile("^[4-6]")}, min_length=9, exclude_empty=True, sort_by="date_desc", max_results=300)
    return events.ordered(events.filtered(_events(spark, sf).withColumn("score", F.lit(1.0)), f), f).selectExpr("event_id", SHOWN)


@query("""WITH best AS (SELECT CAST(ts AS DATE) AS d, max(value) AS b FROM events GROUP BY 1), top AS (SELECT d, row_number() OVER (ORDER BY b DESC, datediff('day', DATE '2024-01-01', d)) AS r FROM best QUALIFY r <= 3)
SELECT event_id, CAST(r AS INTEGER) AS enc_rank, round(value, 6) AS score FROM events JOIN top ON CAST(ts AS DATE) = d WHERE event_type = 'signup'""")
def event_encounter_limit(spark, sf):
    f = events.Filters(event_types=["signup"])
    rows = events.top_encounters(_events(spark, sf).withColumn("score", F.col("amount")), 3, F.col("enc_idx"))
    return events.filtered(rows, f).select("event_id", "enc_rank", _six("score"))


@query("""SELECT event_id, user_id AS person_id FROM events WHERE contains(lower(props), '"k": 4') OR contains(event_type, '"k": 4') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5""")
def event_text_filter_first_k(spark, sf):
    return events.first_per_person(events.containing(_events(spark, sf), '"K": 4'), 5).select("event_id", "person_id")


@query("""SELECT CAST(user_id AS VARCHAR) || ':' || event_id AS event_key, strftime(ts, '%Y-%m-%d %H:%M') || ' | ' || event_type || ' | ' || event_type || ' | ' || props AS snippet FROM events""")
def event_snippets(spark, sf):
    return events.snippets(_events(spark, sf).withColumn("text_all", F.col("content"))).select("event_key", "snippet")


@query("""SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_persons, count(DISTINCT event_type) AS n_types, min(event_id) AS first_id, max(event_id) AS last_id FROM events""")
def store_stats(spark, sf):
    return _events(spark, sf).agg(F.count("event_id").alias("n_events"), F.countDistinct("person_id").alias("n_persons"), F.countDistinct("event_type").alias("n_types"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""SELECT event_id, lag(event_id) OVER w AS prev_id, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def event_links(spark, sf):
    from chartspan.sources.timelines import linked

    return linked(_events(spark, sf)).select("event_id", "prev_id", "next_id")


# ---- ranked text

_BM25 = """WITH t AS (SELECT {corpus} AS corpus, doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM {docs}), p AS (SELECT corpus, doc, term, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT corpus, doc, count(*) AS len FROM t GROUP BY ALL), c AS (SELECT corpus, count(*) AS n, avg(len) AS avgdl FROM l GROUP BY corpus), d AS (SELECT corpus, term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT {qid} AS query, term, count(*) AS qtf FROM (SELECT {qid}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM {queries}) GROUP BY ALL),
s AS (SELECT p.corpus, query, p.doc, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))) AS score FROM q JOIN p USING (term) JOIN d ON d.corpus = p.corpus AND d.term = p.term JOIN c ON c.corpus = p.corpus JOIN l ON l.corpus = p.corpus AND l.doc = p.doc GROUP BY ALL)
"""


@query(_BM25.format(corpus="'all'", docs="documents", qid="item_id", queries="benchmark") + "SELECT query, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def bm25_search(spark, sf):
    asked = text_index.query_terms(table(spark, sf, "benchmark"), "item_id", "text")
    index = text_index.build(table(spark, sf, "documents"), "doc_id", "text", only=asked)
    return text_index.top(text_index.bm25_best(index, asked, 10), 10).select("query", "doc", "score", "rank")


@query(_BM25.format(corpus="lang", docs="documents", qid="item_id", queries="benchmark") + "SELECT corpus, query, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY corpus, query ORDER BY round(score, 6) DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def bm25_per_corpus(spark, sf):
    asked = text_index.query_terms(table(spark, sf, "benchmark"), "item_id", "text")
    index = text_index.build(table(spark, sf, "documents"), "doc_id", "text", F.col("lang"), only=asked)
    return text_index.top(text_index.bm25_best(index, asked, 3), 3)


@query(_BM25.format(corpus="'all'", docs="conversation_docs", qid="doc_id", queries="conversation_docs").replace("WITH t AS", "WITH conversation_docs AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id), t AS", 1) + "SELECT query, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS INTEGER) AS rank FROM s WHERE doc <> query QUALIFY rank <= 5")
def bm25_similar_persons(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    docs = written(turns.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("m", lambda x: x["text"]), " ").alias("text")), "conversations")
    return text_index.top(text_index.bm25_best(text_index.build(docs, "doc_id", "text"), text_index.query_terms(docs, "doc_id", "text"), 6), 5, exclude_self=True).select("query", "doc", "score", "rank")


@query("""WITH t AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents), p AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(DISTINCT doc) AS n FROM t),
d AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM p, n GROUP BY term, n), w AS (SELECT doc, term, (1 + ln(tf)) * idf AS w FROM p JOIN d USING (term)), nd AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc),
q AS (SELECT item_id AS query, term, (1 + ln(count(*))) * idf AS qw FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark) JOIN d USING (term) GROUP BY item_id, term, idf), nq AS (SELECT query, sqrt(sum(qw * qw)) AS qnorm FROM q GROUP BY query),
s AS (SELECT query, doc, sum(qw * w) AS dot FROM q JOIN w USING (term) GROUP BY ALL)
SELECT query, doc, round(dot / (norm * qnorm), 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(dot / (norm * qnorm), 6) DESC, doc) AS INTEGER) AS rank FROM s JOIN nd USING (doc) JOIN nq USING (query) QUALIFY rank <= 5""")
def tfidf_search(spark, sf):
    index = text_index.build(table(spark, sf, "documents"), "doc_id", "text")
    return text_index.top(text_index.tfidf_best(index, text_index.query_terms(table(spark, sf, "benchmark"), "item_id", "text"), 5, None), 5).select("query", "doc", "score", "rank")


@query(_BM25.format(corpus="'all'", docs="(SELECT 'P/' || p_partkey AS doc_id, p_name AS text FROM part)", qid="i", queries="(SELECT 0 AS i, (SELECT p_name FROM part ORDER BY p_partkey LIMIT 1) AS text)") + "SELECT doc AS code, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(score, 6) DESC, doc LIMIT 25")
def code_search_topk(spark, sf):
    parts = table(spark, sf, "part").select(F.concat(F.lit("P/"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("description"), "p_partkey")
    name = parts.orderBy("p_partkey").first()["description"]
    return text_index.code_search(parts, name, 25)


# ---- point in time


@query(f"""SELECT event_id, user_id AS person_id, {AT} FROM events WHERE ts < TIMESTAMP '{CUTOFF}'""")
def context_before_cutoff(spark, sf):
    rows = _events(spark, sf)
    return context.at_landmarks(rows, _landmarks(rows), "before").selectExpr("event_id", "person_id", SHOWN)


@query(f"""WITH k AS (SELECT *, CAST(ts AS DATE) AS d FROM events WHERE ts <= TIMESTAMP '{CUTOFF}'), m AS (SELECT user_id, d, max(ts) AS m FROM k GROUP BY user_id, d), b AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, d) AS r FROM m)
SELECT event_id, k.user_id AS person_id FROM k JOIN b ON k.user_id = b.user_id AND k.d = b.d AND r = 1""")
def single_visit_events(spark, sf):
    rows = _events(spark, sf)
    return context.single_visit(rows, _landmarks(rows)).select("event_id", "person_id")


@query(f"""WITH k AS (SELECT *, CAST(ts AS DATE) AS d FROM events WHERE ts <= TIMESTAMP '{CUTOFF}'), b AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) AS r FROM k GROUP BY user_id, d)
SELECT event_id, k.user_id AS person_id FROM k JOIN b ON k.user_id = b.user_id AND k.d = b.d AND r <= 3""")
def last_n_encounters(spark, sf):
    rows = _events(spark, sf)
    return context.last_encounters(rows, _landmarks(rows), 3).select("event_id", "person_id")


_LINE = "'EV/' || event_type || ' | ' || event_type || ' | ' || CAST(floor(value) AS BIGINT) || ' u'"
_DELTA = """WITH k AS (SELECT *, {head} AS h FROM events WHERE ts < TIMESTAMP '{cutoff}'), n AS (SELECT *, lag({same}) OVER w AS p, row_number() OVER w AS i FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS person_id, string_agg(CASE WHEN p IS NULL OR p <> {same} THEN h || chr(10) ELSE '' END || {line}, chr(10) ORDER BY i) AS context FROM n GROUP BY user_id"""


@query(_DELTA.format(head="CASE WHEN strftime(ts, '%H:%M:%S') = '00:00:00' THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M') END", same="ts", cutoff=CUTOFF, line=_LINE))
def delta_encoded_context(spark, sf):
    rows = _events(spark, sf)
    return context.delta_encoded(context.at_landmarks(rows, _landmarks(rows), "before")).select("person_id", "context")


@query(_DELTA.format(head="strftime(ts, '%Y-%m-%d')", same="h", cutoff=CUTOFF, line=_LINE + " || ' [[' || user_id || ':' || event_id || ']]'").replace("AS context", "AS context0").replace("SELECT user_id AS person_id, string_agg", "SELECT person_id, right(context0, 4000) AS context FROM (SELECT user_id AS person_id, string_agg") + ")")
def delta_encoded_lab_context(spark, sf):
    rows = _events(spark, sf)
    return context.delta_encoded(context.at_landmarks(rows, _landmarks(rows), "before"), lab=True, with_key=True, max_tokens=1000).select("person_id", "context")


@query(f"""SELECT user_id AS person_id, string_agg('[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || event_type || ' | ' || 'EV/' || event_type || ' | ' || event_type || ' | ' || props, chr(10) ORDER BY event_id) AS text FROM events WHERE ts <= TIMESTAMP '{CUTOFF}' GROUP BY user_id""")
def linearised_timeline(spark, sf):
    rows = _events(spark, sf)
    attrs = F.create_map(F.lit("type"), F.col("event_type"), F.lit("code"), F.col("code"), F.lit("name"), F.col("name"))
    rows = rows.withColumns({"ts_raw": F.date_format("ts", "yyyy-MM-dd HH:mm"), "text_all": F.col("content"), "attrs": attrs})
    return context.linearised(rows, _landmarks(rows)).select("person_id", "text")


@query(f"""WITH k AS (SELECT *, CAST(ts AS DATE) AS d, CAST(floor(date_diff('microsecond', TIMESTAMP '{CUTOFF}', ts) / 60000000.0) AS BIGINT) AS m FROM events WHERE ts <= TIMESTAMP '{CUTOFF}'), s AS (SELECT user_id, d, sum(strlen(props)) AS z FROM k GROUP BY ALL), r AS (SELECT user_id, d, sum(z) OVER (PARTITION BY user_id ORDER BY d DESC) AS run FROM s),
x AS (SELECT k.*, CAST(floor(m / 1440.0) AS BIGINT) AS days, m - 1440 * CAST(floor(m / 1440.0) AS BIGINT) AS rest FROM k JOIN r ON k.user_id = r.user_id AND k.d = r.d WHERE run <= 300)
SELECT event_id, CAST(floor(days / 365.0) AS BIGINT) || 'y ' || (days - 365 * CAST(floor(days / 365.0) AS BIGINT)) || 'd ' || (rest // 60) || 'h ' || (rest % 60) || 'm' AS "when" FROM x""")
def compact_timeline(spark, sf):
    rows = _events(spark, sf).withColumn("ts_raw", F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return context.compact(rows, _landmarks(rows), 300).select("event_id", "when")


@query("""SELECT conv_id, turn FROM (SELECT *, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations) WHERE run <= 200""")
def token_budget_prefix(spark, sf):
    return context.token_prefix(table(spark, sf, "conversations"), ["conv_id"], [F.col("turn")], "text", 200).select("conv_id", "turn")


@query("""SELECT conv_id, turn FROM (SELECT *, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS run FROM conversations) WHERE run <= 900""")
def size_budget_suffix(spark, sf):
    return context.size_suffix(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], F.octet_length("text"), 900).select("conv_id", "turn")


@query("""WITH l AS (SELECT c_custkey AS person_id, CASE c_custkey % 3 WHEN 0 THEN DATE '1990-01-01' WHEN 1 THEN DATE '1995-06-17' ELSE DATE '2024-01-01' END AS day FROM customer), f AS (SELECT o_custkey AS person_id, min(o_orderdate) AS first FROM orders GROUP BY 1)
SELECT CASE WHEN first IS NULL THEN 'no_events' WHEN day < CAST(first AS DATE) THEN 'before_first' WHEN day = CAST(first AS DATE) THEN 'same_day' ELSE 'after' END AS category, count(*) AS n FROM l LEFT JOIN f USING (person_id) GROUP BY 1""")
def landmark_category(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    key = F.col("c_custkey") % 3
    at = F.when(key == 0, "1990-01-01").when(key == 1, "1995-06-17").otherwise("2024-01-01").cast("timestamp_ntz")
    found = context.landmark_categories(table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), at.alias("cutoff")), rows)
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# ---- cohorts

_POOL = """items AS (SELECT l.doc_id, CAST(doc_id % 10 AS INTEGER) AS s, unnest([{'task': 'quality', 'label': quality}, {'task': 'toxic', 'label': toxic}], recursive := true) FROM labels l)"""


def _cohort(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    states = docs.select(F.col("doc_id").alias("person_id"), F.lit("t").alias("embed_time"), (F.col("doc_id") % 10).alias("split"), F.col("text").alias("vignette"), F.lit(None).cast("map<string,string>").alias("task_vignettes"))
    pairs = F.array(F.struct(F.lit("quality").alias("task"), F.col("quality").alias("label")), F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("label")))
    items = marks.select(F.col("doc_id").alias("person_id"), F.lit("t").alias("embed_time"), (F.col("doc_id") % 10).alias("split"), F.explode(pairs).alias("m")).select("*", "m.*").drop("m")
    return cohort.checked(states), items


def _neighbours(spark: SparkSession, sf: str, k: int, balanced: bool) -> DataFrame:
    """For each text of split 1 that has a label, its neighbours among the labelled texts of all other splits: each labelled text
    is a query or in the pool."""
    states, items = _cohort(spark, sf)
    items = items.withColumn("split", (F.col("split") == 1).cast("int"))
    asked = cohort.joined(items.where("split = 1"), states).select(F.col("task").alias("corpus"), F.col("person_id").alias("query"), F.col("vignette").alias("text"))
    found = cohort.neighbours_by_text(items, states, 0, asked, k, balanced)
    return found.select(F.col("corpus").alias("task"), "query", "person_id", "label", "score", "position")


_NEAR = "WITH " + _POOL + """, t AS (SELECT task AS corpus, i.doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM items i JOIN documents d ON i.doc_id = d.doc_id WHERE s <> 1 AND trim(text) <> ''),
p AS (SELECT corpus, doc, term, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT corpus, doc, count(*) AS len FROM t GROUP BY ALL), c AS (SELECT corpus, count(*) AS n, avg(len) AS avgdl FROM l GROUP BY corpus), df AS (SELECT corpus, term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT corpus, query, term, count(*) AS qtf FROM (SELECT task AS corpus, i.doc_id AS query, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM items i JOIN documents d ON i.doc_id = d.doc_id WHERE s = 1) GROUP BY ALL),
sc AS (SELECT q.corpus AS task, query, p.doc AS person_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))), 6) AS score FROM q JOIN p ON q.corpus = p.corpus AND q.term = p.term JOIN df ON df.corpus = p.corpus AND df.term = p.term JOIN c ON c.corpus = p.corpus JOIN l ON l.corpus = p.corpus AND l.doc = p.doc GROUP BY ALL),
r AS (SELECT sc.*, i.label, row_number() OVER (PARTITION BY sc.task, query ORDER BY score DESC, person_id) AS rn FROM sc JOIN items i ON i.task = sc.task AND i.doc_id = sc.person_id)
"""


_BALANCED = """, o AS (SELECT * FROM r WHERE rn <= 32 AND person_id <> query), k AS (SELECT *, row_number() OVER (PARTITION BY task, query, label ORDER BY rn) AS cr, count(*) OVER (PARTITION BY task, query, label) AS av, max(score) OVER (PARTITION BY task, query, label) AS tp FROM o),
g AS (SELECT *, dense_rank() OVER (PARTITION BY task, query ORDER BY tp DESC, CAST(label AS VARCHAR)) AS cl FROM k), a AS (SELECT task, query, coalesce(max(av) FILTER (cl = 1), 0) AS a, coalesce(max(av) FILTER (cl = 2), 0) AS b FROM g GROUP BY ALL),
z AS (SELECT g.*, CASE WHEN cl = 1 THEN least(a, least(2, a) + 2 - least(2, b)) ELSE least(b, least(2, b) + 2 - least(2, a)) END AS quota FROM g JOIN a USING (task, query)),
y AS (SELECT *, row_number() OVER (PARTITION BY task, query ORDER BY cr, cl) AS position FROM z WHERE cr <= quota) SELECT task, query, person_id, label, score, CAST(position AS INTEGER) AS position FROM y WHERE position <= 4"""
_UNBALANCED = "SELECT task, query, person_id, label, score, CAST(rn AS INTEGER) AS position FROM r WHERE person_id <> query AND rn <= 5"


@query(_NEAR + _BALANCED)
def balanced_neighbors(spark, sf):
    return _neighbours(spark, sf, 4, True)


@query(_NEAR + _UNBALANCED)
def unbalanced_neighbors(spark, sf):
    return _neighbours(spark, sf, 5, False)


@query("WITH " + _POOL + " SELECT s AS split, task, label, count(*) AS n, count(DISTINCT doc_id) AS n_persons FROM items GROUP BY ALL")
def cohort_counts(spark, sf):
    return metrics.cohort_counts(_cohort(spark, sf)[1]).select(F.col("split").cast("int").alias("split"), "task", "label", "n", "n_persons")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def completed_anti_join(spark, sf):
    return tables.pending(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id")


# ---- facets

_FACET_DOCS = """docs AS (SELECT c_custkey AS person_id, c_mktsegment AS segment, n_name AS nation, CAST(round(c_acctbal) AS BIGINT) AS balance, coalesce(o.n, 0) AS encounter_count, coalesce(o.priorities, []) AS priorities FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY 1) o ON o_custkey = c_custkey)"""


def _facet_docs(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.round("c_acctbal").cast("long").alias("balance"), F.coalesce("n", F.lit(0).cast("long")).alias("encounter_count"), F.coalesce("p", F.array().cast("array<string>")).alias("priorities"))


@query("WITH " + _FACET_DOCS + " SELECT person_id, segment, nation, balance, encounter_count, array_to_string(priorities, ',') AS priorities FROM docs")
def facet_documents(spark, sf):
    return _facet_docs(spark, sf).withColumn("priorities", F.array_join("priorities", ","))


@query("WITH " + _FACET_DOCS + " SELECT 'segment' AS facet, segment AS value, count(*) AS n FROM docs GROUP BY ALL UNION ALL SELECT 'nation', nation, count(*) FROM docs GROUP BY ALL UNION ALL SELECT 'priorities', p, count(*) FROM (SELECT unnest(priorities) AS p FROM docs) GROUP BY ALL")
def facet_distribution(spark, sf):
    return facets.distribution(_facet_docs(spark, sf), ("segment", "nation", "priorities"))


@query("WITH " + _FACET_DOCS + " SELECT person_id, nation, balance, encounter_count FROM docs WHERE segment IN ('BUILDING', 'MACHINERY') AND list_has_any(priorities, ['1-URGENT', '2-HIGH']) AND balance >= 100 AND encounter_count <= 20 ORDER BY balance DESC, person_id LIMIT 50")
def facet_filter_sort(spark, sf):
    found = facets.search(_facet_docs(spark, sf), {"segment": ["BUILDING", "MACHINERY"], "priorities": ["1-URGENT", "2-HIGH"], "nation": None}, {"balance": (100, None), "encounter_count": (0, 20)}, "balance:desc", 50)
    return found.select("person_id", "nation", "balance", "encounter_count")


# ---- hierarchy

_TREE = """concepts AS (SELECT 'PART/' || p_partkey AS code, p_name AS description FROM part UNION ALL SELECT DISTINCT 'BRAND/' || p_brand, p_brand FROM part UNION ALL SELECT DISTINCT 'TYPE/' || p_type, p_type FROM part),
edges AS (SELECT DISTINCT 'PART/' || p_partkey AS child, 'BRAND/' || p_brand AS parent FROM part UNION SELECT DISTINCT 'BRAND/' || p_brand, 'TYPE/' || p_type FROM part)"""


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    p, b, t = F.concat(F.lit("PART/"), F.col("p_partkey").cast("string")), F.concat(F.lit("BRAND/"), "p_brand"), F.concat(F.lit("TYPE/"), "p_type")
    concepts = part.select(p.alias("code"), F.col("p_name").alias("description")).union(part.select(b, "p_brand").distinct()).union(part.select(t, "p_type").distinct())
    return concepts, part.select(p.alias("child"), b.alias("parent")).union(part.select(b, t)).distinct()


@query("WITH " + _TREE + " SELECT code, array_to_string(list_sort(list(parent)), ',') AS parents FROM concepts LEFT JOIN edges ON code = child WHERE child IS NOT NULL GROUP BY code")
def concept_parents(spark, sf):
    return ontology.parents_of(_tree(spark, sf)[1]).select("code", F.array_join("parents", ",").alias("parents"))


@query("WITH " + _TREE + " SELECT parent AS code, count(*) AS n_children, min(child) AS first_child FROM edges GROUP BY parent")
def concept_children(spark, sf):
    return ontology.children_of(_tree(spark, sf)[1]).select("code", F.size("children").cast("long").alias("n_children"), F.get("children", F.lit(0)).alias("first_child"))


@query("WITH RECURSIVE " + _TREE + ", a AS (SELECT 'PART/' || p_partkey AS root, 'PART/' || p_partkey AS code FROM part UNION SELECT root, parent FROM a JOIN edges ON code = child) SELECT root, a.code, coalesce(description, a.code) AS description FROM a LEFT JOIN concepts c ON c.code = a.code")
def ancestor_closure(spark, sf):
    concepts, edges = _tree(spark, sf)
    return ontology.closure(concepts.where("code like 'PART/%'"), edges, concepts)[0].select("root", "code", "description")


@query("WITH RECURSIVE " + _TREE + ", a AS (SELECT 'TYPE/' || p_type AS root, 'TYPE/' || p_type AS code FROM part UNION SELECT root, child FROM a JOIN edges ON code = parent WHERE child LIKE 'BRAND/%') SELECT root, child, parent FROM a JOIN edges ON code = parent WHERE child LIKE 'BRAND/%'")
def descendant_links(spark, sf):
    concepts, edges = _tree(spark, sf)
    return ontology.closure(concepts.where("code like 'TYPE/%'"), edges, concepts, up=False, vocabularies=["BRAND"])[1].select("root", "child", "parent")


@query("WITH " + _TREE + ", q AS (SELECT 'PART/' || p_partkey AS code FROM part UNION ALL SELECT 'NONE/1') SELECT q.code, coalesce(description, '') AS description, split_part(q.code, '/', 1) AS vocabulary, description IS NOT NULL AS found, coalesce(n, 0) AS n_parents FROM q LEFT JOIN concepts c ON c.code = q.code LEFT JOIN (SELECT child, count(*) AS n FROM edges GROUP BY child) e ON e.child = q.code")
def code_metadata(spark, sf):
    concepts, edges = _tree(spark, sf)
    codes = table(spark, sf, "part").select(F.concat(F.lit("PART/"), F.col("p_partkey").cast("string")).alias("code")).union(spark.range(1).select(F.lit("NONE/1")))
    found = ontology.metadata(codes, concepts, edges)
    return found.select("code", F.coalesce("description", F.lit("")).alias("description"), "vocabulary", "found", F.coalesce(F.size("parents"), F.lit(0)).cast("long").alias("n_parents")).withColumn("n_parents", F.greatest("n_parents", F.lit(0)))


# ---- sampling


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= 20")
def stratified_sample(spark, sf):
    return sampling.stratified(table(spark, sf, "documents"), ["lang"], 20, 42, "doc_id").select("doc_id", "lang")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def simple_sample(spark, sf):
    return sampling.simple(table(spark, sf, "documents"), 100, 7, "doc_id").select("doc_id")


_BY_LANG = "rows AS (SELECT l.doc_id, lang, quality AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.col("quality").alias("label"))


@query("WITH " + _BY_LANG + ", c AS (SELECT lang, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM rows GROUP BY lang), p AS (SELECT *, least(pos, CAST(floor(30 * pos / (pos + neg) + 0.5) AS BIGINT)) AS p FROM c), q AS (SELECT *, least(neg, 30 - p) AS q FROM p), z AS (SELECT lang, least(pos, 30 - q) AS p, q FROM q) SELECT doc_id, r.lang, label FROM rows r JOIN z USING (lang) QUALIFY row_number() OVER (PARTITION BY r.lang, label ORDER BY md5('3:' || doc_id), doc_id) <= CASE WHEN label = 1 THEN p ELSE q END")
def ratio_sample(spark, sf):
    rows = _by_lang(spark, sf)
    return sampling.by_quota(rows, sampling.ratio_quotas(rows, "lang", "label", 30), ["lang", "label"], 3, "doc_id").select("doc_id", "lang", "label")


@query("WITH " + _BY_LANG + " SELECT doc_id, lang, label FROM rows QUALIFY row_number() OVER (PARTITION BY lang, label ORDER BY md5('9:' || doc_id), doc_id) <= 5")
def balanced_sample(spark, sf):
    return sampling.balanced(_by_lang(spark, sf), "lang", "label", 10, 9, "doc_id").select("doc_id", "lang", "label")


@query("WITH " + _BY_LANG + " SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('5:' || doc_id), doc_id) <= 4 THEN 1 - label ELSE label END AS label FROM rows")
def label_flip(spark, sf):
    return sampling.flipped(_by_lang(spark, sf), "label", 4, 5, "lang", "doc_id").select("doc_id", "label")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_landmark(spark, sf):
    return sampling.latest_landmark(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, event_id) = 1")
def first_row_per_key(spark, sf):
    return sampling.first_per_key(table(spark, sf, "events"), ["user_id"], F.desc(F.col("event_type") == "purchase"), "event_id").select("user_id", "event_id")


# ---- metrics


def _results(spark: SparkSession, sf: str, variant: int) -> DataFrame:
    """Made answers: a variant is wrong where the hash of the id and the variant says so, and unparsed now and then."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{variant}:"), F.col("doc_id").cast("string"))), 1, 4), 16, 10).cast("int")
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn("h", h)
    return rows.select("doc_id", F.col("lang").alias("task"), F.col("quality").alias("label"), F.when(F.col("h") % 10 == 0, None).when(F.col("h") % (4 + variant) == 1, 1 - F.col("quality")).otherwise(F.col("quality")).alias("pred"))


def _made(variant: int) -> str:
    h = f"CAST(('0x' || substr(md5('{variant}:' || l.doc_id), 1, 4)) AS INTEGER)"
    return f"v{variant} AS (SELECT l.doc_id, lang AS task, quality AS label, CASE WHEN {h} % 10 = 0 THEN NULL WHEN {h} % {4 + variant} = 1 THEN 1 - quality ELSE quality END AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


_ACC = """SELECT task, count(*) AS n, count(pred) AS n_parsed, count(*) FILTER (label = pred) AS n_right, round(count(*) FILTER (label = pred) / count(*), 6) AS accuracy, round(count(*) FILTER (label = pred) / nullif(count(pred), 0), 6) AS accuracy_parsed,
round((count(*) FILTER (label = 1 AND pred = 1) / nullif(count(*) FILTER (label = 1 AND pred IS NOT NULL), 0) + count(*) FILTER (label = 0 AND pred = 0) / nullif(count(*) FILTER (label = 0 AND pred IS NOT NULL), 0)) / 2, 6) AS balanced_accuracy FROM v1 GROUP BY task"""


@query("WITH " + _made(1) + " " + _ACC)
def accuracy_by_task(spark, sf):
    return metrics.accuracy(_results(spark, sf, 1), ["task"]).select("task", "n", "n_parsed", "n_right", _six("accuracy"), _six("accuracy_parsed"), _six("balanced_accuracy"))


@query("WITH " + _made(1) + ", " + _made(2) + " SELECT v1.task, count(*) AS n, count(*) FILTER (v1.pred IS DISTINCT FROM v2.pred) AS n_flip, count(*) FILTER (coalesce(v1.pred <> v1.label, true) AND coalesce(v2.pred = v1.label, false)) AS n_fix, count(*) FILTER (coalesce(v1.pred = v1.label, false) AND coalesce(v2.pred <> v1.label, true)) AS n_hurt FROM v1 JOIN v2 ON v1.doc_id = v2.doc_id GROUP BY ALL")
def paired_flip_fix_hurt(spark, sf):
    found = metrics.paired(_results(spark, sf, 1), _results(spark, sf, 2), ["doc_id", "task"], ["task"])
    return found.select("task", "n", "n_flip", "n_fix", "n_hurt")


@query("WITH " + ", ".join(map(_made, (1, 2, 3))) + ", a AS (" + " UNION ALL ".join(f"SELECT 'v{v}' AS variant, task, round(count(*) FILTER (label = pred) / count(*), 6) AS acc FROM v{v} GROUP BY task" for v in (1, 2, 3)) + "), p AS (SELECT task, max(acc) FILTER (variant = 'v1') AS v1, max(acc) FILTER (variant = 'v2') AS v2, max(acc) FILTER (variant = 'v3') AS v3 FROM a GROUP BY task) SELECT *, CASE WHEN (v1 = greatest(v1, v2, v3))::INT + (v2 = greatest(v1, v2, v3))::INT + (v3 = greatest(v1, v2, v3))::INT > 1 THEN 'tie' WHEN v1 = greatest(v1, v2, v3) THEN 'v1' WHEN v2 = greatest(v1, v2, v3) THEN 'v2' ELSE 'v3' END AS best FROM p")
def variant_matrix_best(spark, sf):
    each = [metrics.accuracy(_results(spark, sf, v), ["task"]).select("task", F.lit(f"v{v}").alias("variant"), _six("accuracy")) for v in (1, 2, 3)]
    return metrics.best_variant(each[0].union(each[1]).union(each[2]), "task", "variant", "accuracy", ["v1", "v2", "v3"])


@query("WITH " + _made(1) + ", " + _made(2) + " SELECT v1.task, count(*) AS n, count(*) FILTER (v1.pred <> v2.pred) AS n_differ, round(100 * count(*) FILTER (v1.pred <> v2.pred) / count(*), 2) AS pct_differ FROM v1 JOIN v2 USING (doc_id) WHERE v1.pred IS NOT NULL AND v2.pred IS NOT NULL GROUP BY ALL")
def tool_disagreement(spark, sf):
    rows = _results(spark, sf, 1).join(_results(spark, sf, 2).select("doc_id", F.col("pred").alias("other")), "doc_id")
    return metrics.disagreement(rows, "task", "pred", "other")


@query("WITH " + _made(1) + " SELECT task, count(*) AS n, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM v1 GROUP BY task")
def class_balance(spark, sf):
    return metrics.class_balance(_results(spark, sf, 1), "task", "label")


_PLACES = "WITH r AS (SELECT lang, n_chars AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS k FROM documents) "


@query(_PLACES + "SELECT lang, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 2) AS mean, max(v) FILTER (i = k // 2) AS median, max(v) FILTER (i = CAST(floor(0.25 * k) AS BIGINT)) AS p25, max(v) FILTER (i = CAST(floor(0.75 * k) AS BIGINT)) AS p75, max(v) FILTER (i = CAST(floor(0.9 * k) AS BIGINT)) AS p90 FROM r GROUP BY lang")
def distribution_summary(spark, sf):
    return metrics.distribution(table(spark, sf, "documents"), ["lang"], "n_chars")


@query(_PLACES + "SELECT lang, max(v) FILTER (i = k // 2) AS median, max(v) FILTER (i = greatest(0, CAST(floor(k * 0.1) AS BIGINT) - 1)) AS p10, max(v) FILTER (i = least(k - 1, CAST(floor(k * 0.9) AS BIGINT))) AS p90, CAST(sum(v) AS BIGINT) AS total FROM r GROUP BY lang")
def token_summary(spark, sf):
    return metrics.summary(table(spark, sf, "documents"), ["lang"], "n_chars").select("lang", "median", "p10", "p90", "total")


@query("SELECT CASE WHEN n_chars <= 500 THEN '(0, 500]' WHEN n_chars <= 2000 THEN '(500, 2000]' WHEN n_chars <= 8000 THEN '(2000, 8000]' ELSE '> 8000' END AS bin, count(*) AS n FROM documents GROUP BY 1")
def histogram_bins(spark, sf):
    return metrics.histogram(table(spark, sf, "documents"), "n_chars", [0, 500, 2000, 8000])


@query("SELECT count(*) AS n, round(count(*) FILTER (greatest(1, length(text) // 4) <= 512) / count(*), 6) AS share_512, round(count(*) FILTER (greatest(1, length(text) // 4) <= 4096) / count(*), 6) AS share_4096 FROM documents")
def context_coverage(spark, sf):
    rows = table(spark, sf, "documents").select(estimated_tokens(F.col("text")).alias("t"))
    return metrics.coverage(rows, "t", (512, 4096)).select("n", _six("share_512"), _six("share_4096"))


@query("SELECT cap, round(avg(least(n_chars, cap)), 6) AS mean_kept, round(avg(greatest(n_chars - cap, 0)), 6) AS mean_cut, round(100.0 * count(*) FILTER (n_chars > cap) / count(*), 6) AS pct_cut FROM documents, (SELECT unnest([1000, 4000, 16000]) AS cap) GROUP BY cap")
def truncation_impact(spark, sf):
    return metrics.truncation(table(spark, sf, "documents"), "n_chars", [1000, 4000, 16000]).select("cap", _six("mean_kept"), _six("mean_cut"), _six("pct_cut"))


# ---- activity


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bin, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def event_frequency_pivot(spark, sf):
    return activity.frequency(_events(spark, sf), "day", ["click", "error", "purchase", "signup", "view"]).withColumn("bin", F.date_format("bin", "yyyy-MM-dd"))


@query("WITH b AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1), c AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM b) SELECT strftime(h, '%Y-%m-%d %H') AS bin, coalesce(n, 0) AS n FROM c LEFT JOIN b USING (h)")
def hourly_totals(spark, sf):
    return activity.totals(_events(spark, sf), "hour").withColumn("bin", F.date_format("bin", "yyyy-MM-dd HH"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS bin, CAST(sum(greatest(1, length(props) // 4)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def daily_token_totals(spark, sf):
    return activity.token_totals(_events(spark, sf), "content").withColumn("bin", F.date_format("bin", "yyyy-MM-dd"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bin, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf):
    """The events as a stream, all that is there in one go; its final counts."""
    import uuid

    from chartspan.streaming.ingest import counted, current_counts, windowed_counts

    shape = table(spark, sf, "events").schema
    rows = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    counted(windowed_counts(rows), f"{path}/counts", f"{path}/checkpoint").awaitTermination()
    return current_counts(spark, f"{path}/counts").select(F.date_format("start", "yyyy-MM-dd HH").alias("bin"), "event_type", "n")


@query("SELECT event_id, CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS answer, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS positive FROM events")
def answer_parsing(spark, sf):
    said = F.when(F.col("amount") > 50, "I think the answer is Yes.").otherwise('{"outcome": "False"}')
    rows = _events(spark, sf).select("event_id", labels.binary(said).alias("answer"), labels.binarised(F.when(F.col("event_type") == "error", "0").otherwise("2"), "categorical").alias("positive"))
    return rows
