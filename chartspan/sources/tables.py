"""Readers and writers of vocabulary snapshots, cohort records, label files, results and key-value caches."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartspan.functions.text import blank_to_null
from chartspan.session import or_none, written


def read_vocabulary(spark: SparkSession, path: str, name: str) -> DataFrame:
    """CONCEPT, CONCEPT_RELATIONSHIP or CONCEPT_ANCESTOR of a snapshot: tab-separated, quotes literal, all strings.

    path is a folder, one that holds a single folder with the files, or a ZIP. A ZIP is unpacked by the driver into a folder beside it,
    which takes its name only when it is whole; where executors don't share the driver's disks, unpack it into a shared folder
    first."""
    if re.match(r"[a-z][a-z0-9+.-]+://", path):
        return spark.read.csv(f"{path.rstrip('/')}/{name}.csv", sep="\t", header=True, quote="", inferSchema=False)
    at = Path(path)
    if at.suffix.lower() == ".zip":
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster a ZIP has to be unpacked into a shared folder first")
        out = at.with_suffix("")
        if not out.exists():
            part = Path(tempfile.mkdtemp(dir=at.parent))
            with zipfile.ZipFile(at) as z:
                z.extractall(part)
            part.rename(out)
        at = out
    if at.is_dir() and not (at / f"{name}.csv").exists():
        at = next((p.parent for p in sorted(at.glob(f"*/{name}.csv"))), at)
    return spark.read.csv(f"{at}/{name}.csv", sep="\t", header=True, quote="", inferSchema=False)


def read_custom_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(code, description) from a CSV, gzipped or not, of vocabulary_id, concept_code, concept_name."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.concat("vocabulary_id", F.lit("/"), "concept_code").alias("code"), F.col("concept_name").alias("description"))


def _in_file_order(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows with `_row`, their order: by file, by the split's place in the file, and by the row's place in the split."""
    rows = spark.read.csv(path, header=True, **options)
    names = rows.columns
    return rows.select(*names, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).alias("_row"))


def cohort_records(rows: DataFrame, person_col: str = "person_id", cutoff_col: str | None = "embed_time", complete: bool = False, order: str = "_row") -> DataFrame:
    """(person_id, cutoff_date): the first row of each person by `order`; blank persons go, a blank cutoff is null. With
    `complete`, persons with a blank in any column of any row go too."""
    rows = rows.withColumn(person_col, blank_to_null(F.col(person_col))).where(F.col(person_col).isNotNull())
    if complete:
        blank = F.exists(F.array(*[blank_to_null(F.col(c).cast("string")) for c in rows.columns if c != order]), lambda x: x.isNull())
        rows = rows.join(rows.where(blank).select(person_col).distinct(), person_col, "left_anti")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(person_col).orderBy(order))).where("_n = 1")
    cutoff = blank_to_null(F.col(cutoff_col)) if cutoff_col else F.lit(None).cast("string")
    return first.select(F.col(person_col).alias("person_id"), cutoff.alias("cutoff_date"))


def read_cohort_records(spark: SparkSession, path: str, **options) -> DataFrame:
    return cohort_records(_in_file_order(spark, path), **options)


def read_labels(spark: SparkSession, paths: dict[str, str], per_task: int | None = None) -> DataFrame:
    """(task, patient_id, prediction_time, label, _row) over tasks' CSV files; the label is in `value`, else in `label`."""
    out = None
    for task, path in paths.items():
        rows = _in_file_order(spark, path)
        label = "value" if "value" in rows.columns else "label"
        time = F.col("prediction_time") if "prediction_time" in rows.columns else F.lit(None).cast("string")
        rows = rows.select(F.lit(task).alias("task"), F.col("patient_id").cast("string").alias("patient_id"), time.alias("prediction_time"), F.col(label).cast("string").alias("label"), "_row")
        if per_task:
            rows = rows.orderBy("_row").limit(per_task)
        out = rows if out is None else out.unionByName(rows)
    return out


def distinct_patients(labels: DataFrame) -> DataFrame:
    return labels.groupBy("patient_id").agg(F.min(F.struct("task", "_row")).alias("first")).select("patient_id", "first")


def test_ids(splits: DataFrame) -> DataFrame:
    """Ids of the test split; the id is in the first there is of patient_id, subject_id and person_id."""
    name = next(c for c in ("patient_id", "subject_id", "person_id") if c in splits.columns)
    return splits.where(F.lower(F.trim("split")) == "test").select(F.col(name).cast("string").alias("patient_id")).distinct()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def usable_results(rows: DataFrame, answer: str = "pred", raw: str = "raw") -> DataFrame:
    """Rows with an answer, parsed or raw, that is no error report."""
    return rows.where((F.col(answer).isNotNull() | F.col(raw).isNotNull()) & ~F.coalesce(F.col(raw).startswith("[ERROR"), F.lit(False)))


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Files of JSON arrays laid out as <task>/<split>.json, with both as columns."""
    rows = spark.read.option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    return rows.withColumns({"task": F.regexp_extract("_file", r"([^/]+)/[^/]+\.json$", 1), "split": F.regexp_extract("_file", r"([^/]+)\.json$", 1)}).drop("_file")


def newest(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The path of the file that was changed last."""
    row = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.max(F.struct("modificationTime", "path")).alias("m")).first()
    return row["m"]["path"] if row["m"] else None


def write_vocabulary(descriptions: DataFrame, parents: DataFrame, path: str) -> None:
    """descriptions(code, description) and parents(code, parents array) as zstd Parquet."""
    descriptions.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/descriptions.parquet")
    parents.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/parents.parquet")


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(concepts(code, description), edges(child, parent)) of what write_vocabulary() wrote."""
    parents = spark.read.parquet(f"{path}/parents.parquet").select(F.col("code").alias("child"), F.explode("parents").alias("parent"))
    return spark.read.parquet(f"{path}/descriptions.parquet"), parents


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed job still has to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def append_results(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends to a JSON folder the rows whose keys it lacks."""
    done = or_none(lambda: rows.sparkSession.read.schema(rows.schema).json(path))
    rows = rows if done is None else pending(rows, done, keys)
    rows.write.mode("append").json(path)


def upsert(store: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Key-value put: of each key the row that is last by `order` over both tables."""
    both = store.unionByName(fresh, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def cache_stats(store: DataFrame, group: str = "model", at: str = "created_at") -> DataFrame:
    return store.groupBy(group).agg(F.count(F.lit(1)).alias("n_entries"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def reingested(requests: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """requests(request_id, system, user, value) filled from outputs(request_id, system, user, text): by id, else by content.
    A value that isn't blank stays unless force."""
    by_id = outputs.where("request_id is not null").groupBy("request_id").agg(F.min("text").alias("_by_id"))
    key = F.sha2(F.concat_ws("\u0001", F.coalesce("system", F.lit("")), F.coalesce("user", F.lit(""))), 256)
    by_content = outputs.withColumn("_key", key).groupBy("_key").agg(F.min("text").alias("_by_content"))
    found = requests.withColumn("_key", key).join(by_id, "request_id", "left").join(by_content, "_key", "left")
    new = F.coalesce("_by_id", "_by_content")
    old = blank_to_null(F.col("value"))
    return found.withColumn("value", F.coalesce(new, old) if force else F.coalesce(old, new)).drop("_key", "_by_id", "_by_content")


def model_text(rows: DataFrame, response: str = "response", status: str = "status") -> DataFrame:
    """rows without failed ones, with `text`: the first part of the first candidate that is no thought."""
    schema = "struct<candidates: array<struct<content: struct<parts: array<struct<text: string, thought: boolean>>>>>>"
    parts = F.get(F.from_json(response, schema)["candidates"], F.lit(0))["content"]["parts"]
    spoken = F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False)) & p["text"].isNotNull())
    ok = F.col(status).isNull() | (F.trim(F.col(status)) == "")
    return rows.where(ok).withColumn("text", F.get(spoken, F.lit(0))["text"])


#: The records of a cohort store.
STATES = "person_id string, embed_time string, split string, vignette string, task_vignettes map<string,string>"
ITEMS = "person_id string, embed_time string, task string, question string, label int, label_description string, split string"


def write_cohort(states: DataFrame, items: DataFrame, path: str) -> None:
    """Both tables as JSON lines; the commit protocol shows a table when it is whole."""
    states.write.mode("overwrite").json(f"{path}/states")
    items.write.mode("overwrite").json(f"{path}/items")


def read_cohort(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(states, items) of what write_cohort() wrote, typed."""
    return spark.read.schema(STATES).json(f"{path}/states"), spark.read.schema(ITEMS).json(f"{path}/items")


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A small result, as a metric or a sample, as one CSV file with a header, in order; larger ones are written by Spark as they are."""
    (rows.orderBy(*order) if order else rows).coalesce(1).write.mode("overwrite").csv(path, header=True)


def cached_by_key(wanted: DataFrame, path: str, keys: list[str], make) -> DataFrame:
    """The rows of a cache at path for the keys in wanted; make(DataFrame of the missing keys) gives what it lacks, and that is appended.
    So contexts and events of (person_id, prediction_time, task) are made once."""
    spark = wanted.sparkSession
    asked = wanted.select(*keys).distinct()
    known = or_none(lambda: spark.read.parquet(path))
    missing = asked if known is None else pending(asked, known, keys)
    make(written(missing, "missing-keys")).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(asked, keys, "left_semi")
