from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.session import or_none, removed
from chartspan.sources import timelines


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (person_id, path, xml, size) as files come into the folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.xml").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("person_id"), "path", F.decode("content", "UTF-8").alias("xml"), F.col("length").alias("size"))


def ingest(documents: DataFrame, out: str, checkpoint: str, known: DataFrame | None = None):
    """Starts a query that appends each batch's events to Parquet at `out`, partitioned by batch so that a batch that is run
    again replaces itself. A person's first document counts; which one of a single batch is open. The persons seen are the
    stream's keyed state in `checkpoint`, so a batch costs its own documents, however many were loaded before, and a restart
    goes on where it stopped. known(person_id): persons that another way has loaded."""
    if known is not None:
        documents = documents.join(known.select("person_id").distinct(), "person_id", "left_anti")

    def one(batch: DataFrame, number: int) -> None:
        timelines.events(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.dropDuplicates(["person_id"]).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, end, kind, n) over event time; events of windows that the watermark has passed are dropped, and these windows' state
    goes. Works on streams and on tables, which know no lateness."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def counted(counts: DataFrame, out: str, checkpoint: str, compact_every: int | None = None):
    """Writes what each batch changes as Parquet to `out`, in a folder of the batch's number, so that a batch that is run again replaces
    itself and readers never meet a half-written table. State and progress are in `checkpoint`, a shared folder, so that a lost
    executor or a restart costs a batch at most. Ends when all that is there has been read. compact_every: see compact()."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if compact_every and number % compact_every == compact_every - 1:
            compact(batch.sparkSession, out, [c for c in batch.columns if c != "n"], number)

    return counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folded(spark: SparkSession, out: str) -> int:
    """The last batch that a whole base holds; -1 without one."""
    marks = or_none(lambda: spark.read.schema("upto long").json(f"{out}-base/whole/*"))
    return -1 if marks is None else marks.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]


def _rows(spark: SparkSession, out: str) -> DataFrame:
    """The base and the batches after it."""
    upto = _folded(spark, out)
    fresh = or_none(lambda: spark.read.parquet(out).where(F.col("batch") > upto))
    base = spark.read.parquet(f"{out}-base/upto={upto}").withColumn("batch", F.lit(upto)) if upto >= 0 else None
    return fresh if base is None else base if fresh is None else base.unionByName(fresh.withColumn("batch", F.col("batch").cast("int")))


def compact(spark: SparkSession, out: str, keys: list[str], upto: int) -> None:
    """Folds the batches up to this one into a base, a row for each key, so that reading costs the keys there are and a few batches. The
    mark that calls the base whole comes last; then what it holds is deleted. Run again, it finds the mark and only deletes."""
    if _folded(spark, out) < upto:
        held = _rows(spark, out).where(F.col("batch") <= upto)
        held.groupBy(*keys).agg(F.max_by("n", "batch").alias("n")).write.mode("overwrite").parquet(f"{out}-base/upto={upto}")
        spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").json(f"{out}-base/whole/{upto}")
    marks = spark.read.schema("upto long").json(f"{out}-base/whole/*")
    older = sorted(r["upto"] for r in marks.where(F.col("upto") < upto).collect())  # one, as a rule
    for batch in range(max(older, default=-1) + 1, upto + 1):
        removed(spark, f"{out}/batch={batch}")
    for mark in older:
        removed(spark, f"{out}-base/whole/{mark}")
        removed(spark, f"{out}-base/upto={mark}")


def current_counts(spark: SparkSession, out: str, keys: tuple[str, ...] = ("start", "end", "event_type")) -> DataFrame:
    """The counts as they stand: of each key the row of the last batch that changed it. A read that a compaction overtakes fails for
    want of a file and is to be repeated."""
    return _rows(spark, out).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
