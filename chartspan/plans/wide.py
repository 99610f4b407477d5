"""Queries over structures that are made to be asked often: typing errors, reachability, as-of joins, samples, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.functions.text import TERM
from chartspan.operators import events, facets, ordered, prompts, reach, sampling, text_index, typo_search
from chartspan.plans.catalog import _FACET_DOCS, CUTOFF, _events, _facet_docs, query
from chartspan.session import table

# ---- typing errors

#: levenshtein() counts bytes there, so letters of two bytes stand for one symbol each.
_TYPOS = """WITH t AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents), v AS (SELECT DISTINCT term FROM t),
q AS (SELECT item_id AS query, list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 7)[1:3], lambda w: w[1:2] || w[4:]) AS ws FROM benchmark),
w AS (SELECT query, unnest(range(len(ws))) AS pos, unnest(ws) AS word, len(ws) AS n FROM q), d AS (SELECT DISTINCT word, pos = n - 1 AS is_last FROM w),
m AS (SELECT word, is_last, term, least(CASE WHEN abs(length(word) - length(term)) <= 2 AND levenshtein(translate(word, 'ßäçèéêíñóöü', '#$%&*+<=>?@'), translate(term, 'ßäçèéêíñóöü', '#$%&*+<=>?@')) <= CASE WHEN length(word) >= 9 THEN 2 WHEN length(word) >= 5 THEN 1 ELSE 0 END THEN 2 * levenshtein(translate(word, 'ßäçèéêíñóöü', '#$%&*+<=>?@'), translate(term, 'ßäçèéêíñóöü', '#$%&*+<=>?@')) ELSE 99 END,
  CASE WHEN is_last AND starts_with(term, word) AND term <> word THEN 1 ELSE 99 END) AS cost FROM d, v),
h AS (SELECT query, pos, n, doc, min(cost) AS cost FROM w JOIN (SELECT *, is_last AS l FROM m WHERE cost < 99) m ON m.word = w.word AND m.l = (pos = n - 1) JOIN t USING (term) GROUP BY ALL),
g AS (SELECT query, doc, CAST(sum(cost // 2) AS BIGINT) AS edits, CAST(sum(cost % 2) AS BIGINT) AS begun FROM h GROUP BY query, n, doc HAVING count(*) = n)
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY edits, begun, doc) AS INTEGER) AS rank FROM g QUALIFY rank <= 10"""


@query(_TYPOS)
def typo_tolerant_search(spark: SparkSession, sf: str) -> DataFrame:
    """The first three longer words of each benchmark text, misspelt: the third letter of each is missing."""
    long_words = F.slice(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), lambda w: F.length(w) >= 7), 1, 3)
    misspelt = F.array_join(F.transform(long_words, lambda w: F.concat(F.left(w, F.lit(2)), F.substr(w, F.lit(4)))), " ")
    queries = table(spark, sf, "benchmark").select("item_id", misspelt.alias("typed"))
    return typo_search.search(typo_search.build(table(spark, sf, "documents"), "doc_id", "text"), queries, "item_id", "typed", 10)


# ---- what was known at many landmarks a person


@query("""WITH c AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click'), s AS (SELECT user_id, ts, max(event_id) AS event_id FROM c GROUP BY ALL),
x AS (SELECT l.event_id, l.user_id, s.event_id AS last_click FROM events l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts > s.ts),
r AS (SELECT event_id, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS n FROM events)
SELECT x.event_id, x.user_id, last_click, nullif(n, 0) AS n_clicks FROM x JOIN r USING (event_id)""")
def clicks_before_each_event(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of a user is a landmark: the last click strictly before it and how many there were."""
    rows = table(spark, sf, "events")
    clicks = rows.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"), F.lit(1).cast("long").alias("one"))
    return ordered.as_of(rows.select("event_id", "user_id", F.col("ts").alias("at")), clicks, "user_id", "at", "ts", {"last_click": "click"}, {"n_clicks": "one"}, through=False).drop("at")


# ---- deep hierarchies

_HEAP = """e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 0 UNION ALL SELECT 0, 5),
r AS (SELECT child AS code, parent AS reached, 1 AS level FROM e UNION SELECT r.code, e.parent, r.level + 1 FROM r JOIN e ON e.child = r.reached WHERE r.level < 40),
p AS (SELECT code, reached, min(level) AS level FROM r WHERE code <> reached GROUP BY ALL)"""


def _heap(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(edges, concepts): each customer below the one of half its key, and a cycle at the top."""
    people = table(spark, sf, "customer").select("c_custkey")
    key = lambda c: F.concat(F.lit("C/"), c.cast("string"))
    edges = people.where("c_custkey > 0").select(key(F.col("c_custkey")).alias("child"), key(F.expr("c_custkey div 2")).alias("parent"))
    top = people.where("c_custkey = 0").select(F.lit("C/0").alias("child"), F.lit("C/5").alias("parent"))
    return edges.unionByName(top), people.select(key(F.col("c_custkey")).alias("code"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("description"))


@query("WITH RECURSIVE " + _HEAP + " SELECT 'C/' || code AS code, 'C/' || reached AS reached, CAST(level AS INTEGER) AS level FROM p")
def deep_reachability(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's ancestors, about as many levels up as its key has bits, with a cycle at the top."""
    return reach.build(*_heap(spark, sf)).pairs


@query("WITH RECURSIVE " + _HEAP + """, n AS (SELECT code, count(*) + 1 AS n_nodes, max(level) AS depth FROM p GROUP BY code), s AS (SELECT code, reached FROM p UNION SELECT code, code FROM p),
l AS (SELECT s.code, count(*) AS n_links FROM s JOIN e ON e.child = s.reached GROUP BY s.code) SELECT 'C/' || n.code AS root, n_nodes, CAST(depth AS INTEGER) AS depth, n_links FROM n JOIN l USING (code)""")
def deep_subgraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The subgraph of each customer's ancestors, looked up in the index: nodes, depth, links."""
    edges, concepts = _heap(spark, sf)
    nodes, links = reach.closure(reach.build(edges, concepts), concepts.select("code"), concepts)
    n = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("level").alias("depth"))
    return n.join(links.groupBy("root").agg(F.count(F.lit(1)).alias("n_links")), "root")


@query("WITH RECURSIVE " + _HEAP + """ SELECT 'C/' || a.code AS root, 'C/' || a.reached AS code, 'customer ' || a.reached AS description, 'C' AS vocabulary, list_transform(list_sort(list(e.parent)), lambda x: 'C/' || x) AS parents, true AS found
FROM (SELECT code, reached FROM p UNION SELECT code, code FROM p) a JOIN e ON e.child = a.reached GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY a.code, a.reached"))
def subgraph_metadata(spark: SparkSession, sf: str) -> DataFrame:
    edges, concepts = _heap(spark, sf)
    nodes, _ = reach.closure(reach.build(edges, concepts), concepts.select("code"), concepts)
    return reach.metadata_of(nodes, concepts, edges)


# ---- samples


@query("""WITH r AS (SELECT doc_id, lang, n_chars < 1500 OR n_chars > 4000 AS abnormal FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, abnormal ORDER BY md5('17:' || doc_id), doc_id) AS i FROM r)
SELECT doc_id, lang, CASE WHEN abnormal THEN 'true' ELSE 'false' END AS label FROM n WHERE i <= CASE WHEN abnormal THEN 40 ELSE 41 END""")
def balanced_sample_with_names(spark: SparkSession, sf: str) -> DataFrame:
    """Half normal and half abnormal lengths of each language, labelled false and true."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.lit("").alias("label"), "n_chars")
    found = sampling.balanced(rows, "lang", "label", 81, 17, "doc_id", positive=(F.col("n_chars") < 1500) | (F.col("n_chars") > 4000), names=("false", "true"))
    return found.select("doc_id", "lang", "label")


@query("""WITH e AS (SELECT event_id, event_type FROM events), q AS (SELECT event_type, count(*) // 3 AS quota FROM e GROUP BY 1)
SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('23:' || event_id), event_id) AS i FROM e) JOIN q USING (event_type) WHERE i <= quota""")
def third_of_each_kind(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the events of each type: few strata of many rows."""
    rows = table(spark, sf, "events").select("event_id", "event_type")
    quotas = rows.groupBy("event_type").agg(F.expr("count(1) div 3").alias("quota"))
    return sampling.by_quota(rows, quotas, ["event_type"], 23, "event_id")


# ---- stems

@query("""WITH d AS (SELECT 'P/' || p_partkey AS doc, unnest(string_split(regexp_replace(p_name || CASE WHEN p_partkey % 2 = 1 THEN 's' ELSE '' END, '(anvil|bolt|gear|gizmo|plate|ring|rod|widget)s$', '\\1'), ' ')) AS term FROM part),
q AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)), n AS (SELECT count(DISTINCT doc) AS n, count(*) / count(DISTINCT doc) AS avgdl FROM d),
l AS (SELECT doc, count(*) AS len FROM d GROUP BY doc), p AS (SELECT doc, term, count(*) AS tf FROM d GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc AS code, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc), n GROUP BY doc ORDER BY score DESC, code LIMIT 25""")
def code_search_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions of which every other is in the plural, asked in the plural."""
    parts = table(spark, sf, "part").select(F.concat(F.lit("P/"), F.col("p_partkey").cast("string")).alias("code"), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 1, "s").otherwise("")).alias("description"), "p_partkey", "p_name")
    name = parts.orderBy("p_partkey").first()["p_name"]
    return text_index.code_search(parts, f"{name}s", 25, stem=True)


# ---- facets


@query("WITH " + _FACET_DOCS + """, f AS (SELECT *, segment IN ('BUILDING', 'MACHINERY') AS a, list_has_any(priorities, ['1-URGENT', '2-HIGH']) AS b, nation = 'NATION_3' OR nation = 'NATION_7' AS c FROM docs)
SELECT 'segment' AS facet, segment AS value, count(*) AS n FROM f WHERE b AND c GROUP BY ALL UNION ALL SELECT 'nation', nation, count(*) FROM f WHERE a AND b GROUP BY ALL
UNION ALL SELECT 'priorities', p, count(*) FROM (SELECT unnest(priorities) AS p FROM f WHERE a AND c) GROUP BY ALL""")
def facet_counts_disjunctive(spark: SparkSession, sf: str) -> DataFrame:
    chosen = {"segment": ["BUILDING", "MACHINERY"], "priorities": ["1-URGENT", "2-HIGH"], "nation": ["NATION_3", "NATION_7"]}
    return facets.disjunctive(_facet_docs(spark, sf), chosen, ("segment", "nation", "priorities"))


# ---- texts and events


@query("""WITH s AS (SELECT item_id, text, list_filter(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM benchmark),
c AS (SELECT *, len(s) AS n, len(list_filter(s, lambda x: contains(x, 'la') OR contains(x, 'der'))) AS r, len(list_filter(s, lambda x: contains(x, 'en') AND NOT (contains(x, 'la') OR contains(x, 'der')))) AS p,
  regexp_matches(text, '[0-9]') AS q, contains(text, 'des') AS t FROM s), d AS (SELECT *, CASE WHEN n > 0 THEN round(p / n, 3) ELSE 1.0 END AS share FROM c)
SELECT item_id, CAST(n AS INTEGER) AS n_sentences, CAST(r AS INTEGER) AS n_result, CAST(p AS INTEGER) AS n_procedure_only, share AS procedure_only, q AS has_quantity, t AS has_trajectory, r >= 2 AND share <= 0.5 AND (q OR t) AS passes FROM d""")
def text_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", prompts.text_quality(F.col("text"), "en", "la|der", "[0-9]", "des").alias("q")).select("item_id", "q.*")


@query(f"SELECT event_id, user_id AS person_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '{CUTOFF}' AND event_type IN ('click', 'error') ORDER BY ts DESC, event_id LIMIT 120")
def latest_events_before_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Filters and order together: a range that ends at the cutoff, some types, latest first, the first 120."""
    f = events.Filters(start="2024-01-02 00:00:00", end=CUTOFF, event_types=["click", "error"], sort_by="date_desc", max_results=120)
    rows = _events(spark, sf).withColumn("score", F.lit(1.0))
    return events.ordered(events.filtered(rows, f), f).select("event_id", "person_id", "event_type")
