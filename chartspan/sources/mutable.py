"""A key-value table that changes: rows lie in buckets by a hash of their key, and a put writes the buckets that it touches.

A put is a version of its own: its rows go to a folder of the version, by bucket, and a list that names the versions of every bucket
comes last, which makes the put whole. A bucket of more than MERGE versions is written anew as one in the same put. So a put
costs its own rows and now and then the buckets they fall in, a get reads the buckets of its keys, and nothing reads the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.session import or_none, removed, written

#: Versions that a bucket may consist of.
MERGE = 4


@dataclass
class MutableTable:
    """keys: the key's columns; order: of a key's rows the last by this column counts, of equal ones the later put's. One writer at a time;
    readers see whole puts alone."""

    spark: SparkSession
    path: str
    keys: list[str]
    order: str
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _lists(self) -> DataFrame | None:
        return or_none(lambda: self.spark.read.schema("version long, bucket int, versions array<long>").json(f"{self.path}/lists/*"))

    def _state(self) -> tuple[int, dict[int, list[int]]]:
        """(version, versions of each bucket) of the last whole put."""
        rows = self._lists()
        newest = None if rows is None else rows.agg(F.max("version")).first()[0]
        if newest is None:
            return 0, {}
        return newest, {r["bucket"]: list(r["versions"]) for r in rows.where(F.col("version") == newest).collect()}  # a row a bucket

    def _read(self, held: dict[int, list[int]]) -> DataFrame | None:
        """The rows of the buckets, each key's last one."""
        at = [f"{self.path}/data/_version={v}/_bucket={b}" for b, versions in held.items() for v in versions]
        if not at:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*at)
        names = [c for c in rows.columns if c not in ("_version", "_bucket")]
        last = F.max_by(F.struct(*names), F.struct(self.order, "_version")).alias("row")
        return rows.groupBy("_bucket", *self.keys).agg(last).select(*(F.col("row")[c].alias(c) for c in names))

    def rows(self) -> DataFrame | None:
        """The whole table; None before the first put."""
        return self._read(self._state()[1])

    def get(self, wanted: DataFrame) -> DataFrame | None:
        """The rows of the keys in wanted; only their buckets are read."""
        asked = wanted.select(*self.keys).distinct()
        held = self._state()[1]
        some = {r[0] for r in asked.select(self._bucket()).distinct().collect()}  # as many as buckets
        found = self._read({b: v for b, v in held.items() if b in some})
        return found if found is None else found.join(asked, self.keys, "left_semi")

    def put(self, fresh: DataFrame) -> int:
        """Writes fresh rows, of one schema with the table; returns the version. Of fresh rows of one key the last by `order` counts."""
        version, held = self._state()
        version += 1
        # what a failed put has left is written over
        fresh = written(fresh.withColumn("_bucket", self._bucket()), "put")
        touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # as many as buckets
        full = {b: held[b] for b in touched if len(held.get(b, [])) >= MERGE}
        last = F.max_by(F.struct(*fresh.columns), F.struct(self.order)).alias("row")
        new = fresh.groupBy("_bucket", *self.keys).agg(last).select("row.*")
        old = self._read(full)
        if old is not None:  # these buckets become one version; a fresh row of equal order wins
            both = new.withColumn("_fresh", F.lit(1)).unionByName(old.withColumns({"_bucket": self._bucket(), "_fresh": F.lit(0)}))
            best = F.max_by(F.struct(*new.columns), F.struct(self.order, "_fresh")).alias("row")
            new = both.groupBy("_bucket", *self.keys).agg(best).select("row.*")
        new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/_version={version}")
        lists = {b: [version] if b in full else [*held.get(b, []), version] for b in touched}
        listed = [(version, b, v) for b, v in (held | lists).items()] or [(version, None, [])]
        self.spark.createDataFrame(listed, "version long, bucket int, versions array<long>").coalesce(1).write.mode("overwrite").json(f"{self.path}/lists/{version}")
        if version > 2:  # a reader of the last list may still be at it
            removed(self.spark, f"{self.path}/lists/{version - 2}")
        return version

    def vacuum(self) -> int:
        """Deletes the versions that no bucket consists of any more, while nobody reads; returns how many."""
        version, held = self._state()
        used = {v for versions in held.values() for v in versions}
        known = or_none(lambda: self.spark.read.parquet(f"{self.path}/data"))
        gone = [r[0] for r in known.select("_version").distinct().collect() if r[0] not in used and r[0] <= version] if known is not None else []
        for v in gone:
            removed(self.spark, f"{self.path}/data/_version={v}")
        return len(gone)
