"""Queries through the readers and writers: what a query makes of the given tables is written to the shared folder in the format of the
source, read back by the library and compared with the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.operators import cohort, ontology, reach
from chartspan.plans.catalog import query
from chartspan.plans.wide import _HEAP, _heap
from chartspan.session import shared_dir, table
from chartspan.sources import mutable, tables


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


_TASKS = """l AS (SELECT 'urgent' AS task, CAST(o_custkey AS VARCHAR) AS patient_id, strftime(o_orderdate, '%Y-%m-%d') AS prediction_time, CASE WHEN o_orderpriority LIKE '1%' THEN 'true' ELSE 'false' END AS label FROM orders
UNION ALL SELECT 'costly', CAST(o_custkey AS VARCHAR), NULL, CASE WHEN o_totalprice > 200000 THEN '1' ELSE '0' END FROM orders)"""


def _label_files(spark: SparkSession, sf: str) -> DataFrame:
    """Two tasks' label files, one with times and its label in `value`, one without times and with `label`."""
    orders, path = table(spark, sf, "orders"), _folder(spark)
    person = F.col("o_custkey").cast("string").alias("patient_id")
    orders.select(person, F.date_format("o_orderdate", "yyyy-MM-dd").alias("prediction_time"), F.when(F.startswith("o_orderpriority", F.lit("1")), "true").otherwise("false").alias("value")).write.csv(f"{path}/urgent", header=True)
    orders.select(person, F.when(F.col("o_totalprice") > 200000, "1").otherwise("0").alias("label")).write.csv(f"{path}/costly", header=True)
    return tables.read_labels(spark, {"urgent": f"{path}/urgent", "costly": f"{path}/costly"})


@query("WITH " + _TASKS + " SELECT * FROM l")
def label_files(spark: SparkSession, sf: str) -> DataFrame:
    return _label_files(spark, sf).select("task", "patient_id", "prediction_time", "label")


@query("WITH " + _TASKS + " SELECT patient_id, min(task) AS task FROM l GROUP BY patient_id")
def label_file_patients(spark: SparkSession, sf: str) -> DataFrame:
    return tables.distinct_patients(_label_files(spark, sf)).select("patient_id", F.col("first.task").alias("task"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS person_id, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE '2020-01-0' || (c_custkey % 9 + 1) END AS cutoff_date FROM customer WHERE c_mktsegment <> 'BUILDING'")
def cohort_file(spark: SparkSession, sf: str) -> DataFrame:
    """A cohort file with blank persons, blank cutoffs and each person twice."""
    people, path = table(spark, sf, "customer"), _folder(spark)
    person = F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_custkey").cast("string"))
    cutoff = F.when(F.col("c_custkey") % 4 == 1, " ").otherwise(F.concat(F.lit("2020-01-0"), (F.col("c_custkey") % 9 + 1).cast("string")))
    rows = people.select(person.alias("person_id"), cutoff.alias("embed_time")).orderBy("person_id")
    rows.unionByName(rows.withColumn("embed_time", F.lit("later"))).coalesce(1).write.csv(path, header=True)
    return tables.read_cohort_records(spark, path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS patient_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def split_file_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the test split of a split file."""
    path = _folder(spark)
    table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), F.when(F.col("c_mktsegment") == "BUILDING", " Test ").otherwise("train").alias("split")).write.csv(path, header=True)
    return tables.test_ids(spark.read.csv(path, header=True))


@query("SELECT event_id, CASE WHEN value > 50 THEN 'yes' END AS pred, CASE event_type WHEN 'error' THEN '[ERROR] none' WHEN 'click' THEN NULL ELSE 'raw' END AS raw FROM events WHERE (value > 50 OR event_type <> 'click') AND event_type <> 'error'")
def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Results appended in two overlapping batches: each key once, without the error reports and the empty ones."""
    path = _folder(spark)
    raw = F.when(F.col("event_type") == "error", "[ERROR] none").when(F.col("event_type") != "click", "raw")
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("value") > 50, "yes").alias("pred"), raw.alias("raw"))
    half = table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2
    tables.append_results(rows.where(F.col("event_id") <= half), path, ["event_id"])
    tables.append_results(rows, path, ["event_id"])
    return tables.usable_results(tables.read_results(spark, path).select("event_id", "pred", "raw"))


@query("WITH e AS (SELECT 'C/' || c_custkey AS child, 'C/' || (c_custkey // 2) AS parent FROM customer WHERE c_custkey > 0 UNION ALL SELECT 'C/0', 'C/5') SELECT child, parent, d.c_name AS description FROM e JOIN customer d ON 'C/' || d.c_custkey = child")
def ontology_files(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions and parents as the vocabulary's Parquet, read back as concepts and edges."""
    edges, path = _heap(spark, sf)[0], _folder(spark)
    names = table(spark, sf, "customer").select(F.concat(F.lit("C/"), F.col("c_custkey").cast("string")).alias("code"), F.col("c_name").alias("description"))
    tables.write_vocabulary(names, ontology.parents_of(edges), path)
    concepts, found = tables.read_ontology(spark, path)
    return found.join(concepts.withColumnRenamed("code", "child"), "child")


@query("SELECT CAST(p_partkey AS BIGINT) AS concept_id, p_brand || '/' || p_partkey AS code, p_name AS description, p_size % 3 = 0 AS is_non_standard FROM part WHERE p_size % 10 <> 0")
def vocabulary_files(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot's CONCEPT file: tab-separated text with names in quotes that are part of nothing, invalid rows left out."""
    part, path = table(spark, sf, "part"), _folder(spark)
    rows = part.select(
        F.col("p_partkey").cast("string").alias("concept_id"), F.col("p_brand").alias("vocabulary_id"), F.col("p_partkey").cast("string").alias("concept_code"), F.col("p_name").alias("concept_name"),
        F.when(F.col("p_size") % 10 == 0, "D").alias("invalid_reason"), F.when(F.col("p_size") % 3 != 0, "S").alias("standard_concept"),
    )
    rows.write.csv(f"{path}/CONCEPT.csv", sep="\t", header=True, quote="", emptyValue="")
    return ontology.coded(tables.read_vocabulary(spark, path, "CONCEPT"))


@query("SELECT p_brand || '/' || p_partkey AS code, p_name AS description FROM part")
def custom_concept_file(spark: SparkSession, sf: str) -> DataFrame:
    """Custom concepts as a gzipped CSV."""
    path = _folder(spark)
    table(spark, sf, "part").select(F.col("p_brand").alias("vocabulary_id"), F.col("p_partkey").alias("concept_code"), F.col("p_name").alias("concept_name")).write.csv(path, header=True, compression="gzip")
    return tables.read_custom_concepts(spark, path)


@query("WITH RECURSIVE " + _HEAP + """, s AS (SELECT code, reached FROM p UNION SELECT code, code FROM p)
SELECT 'C/' || code AS root, count(DISTINCT reached) AS node_count, count(*) AS edge_count FROM s JOIN e ON e.child = s.reached GROUP BY code""")
def subgraph_counts(spark: SparkSession, sf: str) -> DataFrame:
    edges, concepts = _heap(spark, sf)
    return ontology.closure_counts(*reach.closure(reach.build(edges, concepts), concepts.select("code"), concepts))


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def mutable_table(spark: SparkSession, sf: str) -> DataFrame:
    """Events put into a key-value table in five batches, out of order: of each user and type the last one stays."""
    store = mutable.MutableTable(spark, _folder(spark), ["user_id", "event_type"], "event_id", buckets=16)
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    ends = rows.agg(F.max("event_id")).first()[0] or 0
    for k in (3, 0, 4, 1, 2):
        store.put(rows.where((F.col("event_id") >= k * ends / 5) & ((F.col("event_id") < (k + 1) * ends / 5) | F.lit(k == 4))))
    return store.rows()


@query("WITH i AS (SELECT doc_id, lang AS task, quality AS label, source AS split FROM labels JOIN documents USING (doc_id)) SELECT split, task, count(DISTINCT doc_id) AS n FROM i WHERE label = 1 GROUP BY ALL")
def eligible_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Positive items of persons that have a state, per split and task."""
    docs = table(spark, sf, "documents")
    items = docs.join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("person_id"), F.lit("t").alias("embed_time"), F.col("lang").alias("task"), F.col("quality").alias("label"), F.col("source").alias("split"))
    states = docs.select(F.col("doc_id").alias("person_id"), F.lit("t").alias("embed_time"), F.lit("").alias("split"), F.col("text").alias("vignette"))
    found = cohort.joined(cohort.latest_items(items.withColumn("_row", F.lit(1))).where("label = 1"), cohort.checked(states))
    return found.groupBy("split", "task").agg(F.countDistinct("person_id").alias("n"))
