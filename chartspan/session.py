"""The session that tests, bench and examples use; a cluster brings its own."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "chartspan", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, UTC, Arrow; what the caller gives in conf (with _ for .) comes on top."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # streams' keyed state lies on disk and is written by its changes, so that it may outgrow memory
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='chartspan-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all tasks run in the driver, as in tests, a
    temporary one will do; elsewhere its want is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (found or _own_dir()).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read back: they are computed once, lineage ends there, and the
    planner knows their size. The folder goes when the application ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    file_system, at = _hadoop(df.sparkSession, path)
    file_system.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration()), at


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written and nothing reads any more."""
    file_system, at = _hadoop(spark, path)
    file_system.delete(at, True)


def or_none(read) -> DataFrame | None:
    """What read() gives, or None where there is no such path or nothing in it; any other error is one."""
    try:
        return read()
    except AnalysisException as e:
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return None
