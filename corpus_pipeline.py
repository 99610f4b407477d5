"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; all but the last return
the columns of documents. Every stage's result is written as Parquet in the shared folder and read again as the next one's docs.

All stages: a null text counts as empty (and stays null where a stage gives texts); very long texts are read whole; rows with a null id
and repeated rows are rows like any other; extra columns stay, whatever their names, up to the last stage; an empty table
gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.llm import mixing, personal_data, quality_rules, sentencepieces, simhash
from chartspan.llm.common import written

TOKENIZER = "piece_bpe_32k.model"
#: Characters of a file of the mix, about: the number of files grows with the input, not their size.
FILE_CHARS = 1 << 26
#: Rows of an Arrow batch, whose texts the executor and the Python worker both hold, where the session leaves Spark's default.
BATCH_ROWS, BATCH_SETTING, SPARK_DEFAULT = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of BATCH_ROWS. A limit that the session has set itself stays."""
    if spark.conf.get(BATCH_SETTING) == SPARK_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject: too short, repetitive, or mostly boilerplate by lines. The field is fitted on
    those of docs that have labels; an id labelled both ways is bad. Null and empty texts go. Without labels, the default field."""
    _small_batches(spark)
    field = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest id; of different texts under one id, each group keeps
    its own, and of repeated rows one stays. Null, empty and blank texts are near-duplicates of each other."""
    _small_batches(spark)
    return simhash.one_of_each(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars, where docs has it, follows. Every row stays."""
    _small_batches(spark)
    clean = personal_data.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights as flat as they can be with none over twice as often in as another; every document at least once.

    The rows come in the mix's order: a partition holds a stretch of it, written as one file, in order of number and, within
    it, of row. Rows of one place, which are those of one id and text, come in any order. Null sources are one source.
    """
    out = mixing.mix(docs, repeats=2.0)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    files = 1 + 2 * chars // FILE_CHARS  # the mix may hold a document twice
    return out.repartitionByRange(files, F.col("mix_slot"), F.col("mix_epoch")).sortWithinPartitions("mix_slot", "mix_epoch").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token counts and digests of their ids, a row for each time that a document is in the mix, with its place there:
    mix_part, the number of the mix's file, and mix_row, the row in it. Both are null where docs isn't a table of files."""
    _small_batches(spark)
    try:
        place = docs.select(F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).alias("f"), F.col("_metadata.row_index").alias("r"), F.struct("doc_id").alias("d"), "text")
    except AnalysisException:
        place = docs.select(F.lit(None).cast("string").alias("f"), F.lit(None).cast("long").alias("r"), F.struct("doc_id").alias("d"), "text")
    found = sentencepieces.summary(place.select(F.struct("d", "f", "r").alias("doc_id"), "text"), public_tokenizers.path(TOKENIZER))
    part = F.expr("try_cast(doc_id.f as int)").alias("mix_part")
    return found.select(F.col("doc_id.d.doc_id").alias("doc_id"), part, F.col("doc_id.r").alias("mix_row"), *(c for c in found.columns if c != "doc_id"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("personal_data", personal), ("mixing", mixed), ("sentencepiece", encoded)]

#: SQL can't state the results of a fitted field, of reachability at a bit distance, or of a tokenizer: brute force tests do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
