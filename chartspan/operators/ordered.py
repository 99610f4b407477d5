"""Running values along an order, however many rows a key has.

A window over a key is one task's work. Here all rows are put in order by range, so that a key's rows may lie in several parts; what a
part adds is worked out within it, and a small table of (part, key) carries it on to the next. One sort of the rows, one join on
(part, key), which no key makes large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.session import written

PLACE_BITS = 33


def in_order(df: DataFrame, *by: Column | str) -> DataFrame:
    """df written in order, with _part and _place: all rows of a part come before those of the next, and places number the rows of a part.
    However many rows a key has, they lie in parts of about one size (rows that are equal in all of `by` stay together)."""
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(parts.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place")), "in-order")


def carried(rows: DataFrame, key: list[str], **values: tuple[Column, str]) -> DataFrame:
    """rows of in_order(), sorted by `key` first, with a column more for each value: along its key up to and with the row itself, the
    `last` one that isn't null, or the `sum` of those that aren't (null before the first)."""
    here, earlier = ["_part", *key], Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*here).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    # a last value goes by its place, so that it may be null within
    held = rows.withColumns({f"_v_{n}": F.when(c.isNotNull(), F.struct(F.col("_place"), c.alias("v"))) if how == "last" else c for n, (c, how) in values.items()})
    local = {f"_l_{n}": (F.last(f"_v_{n}", ignorenulls=True) if how == "last" else F.sum(f"_v_{n}")).over(so_far) for n, (_, how) in values.items()}
    ends = held.groupBy(*here).agg(*((F.max(f"_v_{n}") if how == "last" else F.sum(f"_v_{n}")).alias(f"_e_{n}") for n, (_, how) in values.items()))
    over = {f"_c_{n}": (F.last(f"_e_{n}", ignorenulls=True) if how == "last" else F.sum(f"_e_{n}")).over(earlier) for n, (_, how) in values.items()}
    ends = ends.select(*here, *(c.alias(n) for n, c in over.items()))
    met = held.withColumns(local).join(ends.withColumnsRenamed({k: f"_k_{k}" for k in here}), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in here])
    out = {n: F.coalesce(f"_l_{n}", f"_c_{n}")["v"] if how == "last" else F.when(F.col(f"_l_{n}").isNull() & F.col(f"_c_{n}").isNull(), None).otherwise(F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))) for n, (_, how) in values.items()}
    return met.select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def as_of(landmarks: DataFrame, events: DataFrame, key: str, at: str, ts: str, last: dict[str, str] | None = None, sums: dict[str, str] | None = None, through: bool = True) -> DataFrame:
    """landmarks with what was known at each: of the key's events at or before `at` (strictly before it unless `through`) the `last` one's
    columns, and `sums` over all of them, both {new name: column of events}; null where there is nothing. Events of one time are in
    order of the columns asked for, so the last one doesn't depend on the rows' order. Landmarks without a key or time get nulls.

    Landmarks and events are put in order together and the events' values carried on to the landmarks, so what is shuffled is each once,
    whatever the number of landmarks of a key and of a key's events: no landmark copies its key's events.
    """
    last, sums = last or {}, sums or {}
    asked = F.struct(*landmarks.columns)
    order = [c for c in dict.fromkeys([*last.values(), *sums.values()])]
    known = F.struct(*order) if order else F.struct(F.lit(1).alias("_"))
    own = landmarks.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1 if through else 0).alias("_turn"), asked.alias("_asked"), F.lit(None).cast(events.select(known.alias("k")).schema["k"].dataType).alias("_known"))
    theirs = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("_key"), F.col(ts).alias("_at"), F.lit(0 if through else 1).alias("_turn"), F.lit(None).cast(landmarks.select(asked.alias("a")).schema["a"].dataType).alias("_asked"), known.alias("_known"))
    rows = in_order(own.unionByName(theirs), "_key", "_at", "_turn", "_known")
    values = {f"last_{n}": (F.col("_known"), "last") for n in ["all"] if last} | {f"sum_{n}": (F.col("_known")[c], "sum") for n, c in sums.items()}
    found = carried(rows, ["_key"], **values).where("_asked is not null")
    there = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    columns = [F.when(there, F.col("last_all")[c]).alias(n) for n, c in last.items()] + [F.when(there, F.col(f"sum_{n}")).alias(n) for n in sums]
    return found.select(*(F.col("_asked")[c].alias(c) for c in landmarks.columns), *columns)
