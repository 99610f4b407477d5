"""Event counts over time, for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspan.functions.text import estimated_tokens


def frequency(rows: DataFrame, unit: str = "day", types: list[str] | None = None) -> DataFrame:
    """(bin, a count for each type): day, hour or minute bins, zero where a type has none. Without `types` they are looked up."""
    binned = rows.where("ts is not null").withColumn("bin", F.date_trunc(unit, "ts"))
    return binned.groupBy("bin").pivot("event_type", types).count().na.fill(0)


def totals(rows: DataFrame, unit: str = "day") -> DataFrame:
    """(bin, n) for every period from the first to the last event, empty ones too."""
    binned = rows.where("ts is not null").groupBy(F.date_trunc(unit, "ts").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    span = binned.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a is not null")
    calendar = span.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("bin"))
    return calendar.join(binned, "bin", "left").na.fill({"n": 0})


def token_totals(rows: DataFrame, text: str, unit: str = "day") -> DataFrame:
    return rows.where("ts is not null").groupBy(F.date_trunc(unit, "ts").alias("bin")).agg(F.sum(estimated_tokens(F.col(text))).alias("tokens"))
