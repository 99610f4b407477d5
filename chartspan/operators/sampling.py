"""Seeded samples: the order within a stratum is a hash of seed and id, the same in any engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bits of a draw that rows are counted by, a multiple of four.
BITS = 12


def draw(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def simple(rows: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    return rows.orderBy(draw(seed, id_col), id_col).limit(n)


def shuffled(rows: DataFrame, seed: int, id_col: str) -> DataFrame:
    return rows.orderBy(draw(seed, id_col), id_col)


def _ranked(rows: DataFrame, strata: list[str], seed: int, ids: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*strata).orderBy(draw(seed, *ids), *ids)
    return rows.withColumn("_n", F.row_number().over(w))


def stratified(rows: DataFrame, strata: list[str], n: int, seed: int, *ids: str) -> DataFrame:
    """n of each stratum, all of one that is smaller."""
    return _ranked(rows, strata, seed, ids).where(F.col("_n") <= n).drop("_n")


def cuts(rows: DataFrame, quotas: DataFrame, strata: list[str], seed: int, *ids: str) -> DataFrame:
    """(strata..., cut): the draw and ids of the last row that each stratum's quota lets in; null where all rows fit.

    Draws are counted by their first BITS bits, which tells in which of these buckets a quota ends; only the rows of that one bucket are
    put in order. So no task orders a stratum, however large it is: what is left of it is one part in 2 ** BITS."""
    drawn = rows.select(*strata, F.struct(draw(seed, *ids).alias("d"), *ids).alias("_at"))
    drawn = drawn.withColumn("_bucket", F.conv(F.left("_at.d", F.lit(BITS // 4)), 16, 10).cast("int"))
    counts = drawn.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_k")).join(quotas, strata)
    up_to = F.sum("_k").over(Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = counts.withColumn("_up", up_to).where("_up >= quota").groupBy(*strata).agg(F.min(F.struct("_bucket", (F.col("quota") - F.col("_up") + F.col("_k")).alias("room"))).alias("e"))
    ends = ends.select(*strata, "e._bucket", "e.room")
    last = drawn.join(ends, [*strata, "_bucket"]).withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy("_at"))).where("_n <= room").groupBy(*strata).agg(F.max("_at").alias("cut"))
    # a quota of nothing lets nothing in, which no row's draw can tell
    return quotas.where("quota > 0").join(last, strata, "left").select(*strata, "cut")


def _within(seed: int, ids: tuple[str, ...]) -> Column:
    return F.col("cut").isNull() | (F.struct(draw(seed, *ids).alias("d"), *ids) <= F.col("cut"))


def by_quota(rows: DataFrame, quotas: DataFrame, strata: list[str], seed: int, *ids: str) -> DataFrame:
    """quotas(strata..., quota): so many of each, the first by their draw; rows that share their ids come in together. One row of cuts()
    for each stratum meets the rows."""
    met = rows.join(cuts(rows, quotas, strata, seed, *ids), strata)
    return met.where(_within(seed, ids)).select(*rows.columns)


def ratio_quotas(rows: DataFrame, group: str, label: str, n: int) -> DataFrame:
    """(group, label, quota) for labels 0 and 1: n places by each group's own ratio, rounded; what one label lacks the other gets."""
    counts = rows.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    want = F.floor(F.lit(n) * F.col("pos") / (F.col("pos") + F.col("neg")) + 0.5)
    pos = F.least(F.col("pos"), want)
    neg = F.least(F.col("neg"), n - pos)
    both = counts.select(group, F.least("pos", n - neg).alias("p"), neg.alias("q"))
    return both.select(group, F.explode(F.array(F.struct(F.lit(1).alias(label), F.col("p").alias("quota")), F.struct(F.lit(0).alias(label), F.col("q").alias("quota")))).alias("m")).select(group, "m.*")


def balanced(rows: DataFrame, group: str, label: str, n: int, seed: int, *ids: str, positive: Column | None = None, names: tuple[object, object] | None = None) -> DataFrame:
    """n // 2 positives and the rest negatives of each group, or as many as there are. Positives have label 1, or are told by `positive`;
    with names, (negative, positive), these are written in place of the labels. What isn't known to be positive is negative."""
    side = F.coalesce(F.col(label) == 1 if positive is None else positive, F.lit(False))
    sided = rows.withColumn("_side", side)
    quotas = sided.select(group, "_side").distinct().withColumn("quota", F.when(F.col("_side"), n // 2).otherwise(n - n // 2))
    out = by_quota(sided, quotas, [group, "_side"], seed, *ids)
    return (out if names is None else out.withColumn(label, F.when(F.col("_side"), names[1]).otherwise(names[0]))).drop("_side")


def even_quotas(rows: DataFrame, group: str, n: int) -> DataFrame:
    """(group, quota): n over the groups evenly, the remainder one each to the first by name; an error if a group is short."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("have"))
    k = counts.count()
    at = F.row_number().over(Window.orderBy(group))  # a row per group
    quotas = counts.withColumn("quota", F.lit(n // max(k, 1)) + (at <= n % max(k, 1)).cast("int"))
    short = quotas.where("have < quota").take(1)
    if short:
        raise ValueError(f"{short[0][group]} has {short[0]['have']} rows for {short[0]['quota']} places")
    return quotas.select(group, "quota")


def flipped(rows: DataFrame, label: str, k: int, seed: int, group: str, *ids: str) -> DataFrame:
    """rows with the labels of k of each group's rows turned over."""
    quotas = rows.select(group).distinct().withColumn("quota", F.lit(k))
    known = cuts(rows, quotas, [group], seed, *ids).withColumnRenamed(group, "_group").withColumn("_known", F.lit(True))
    met = rows.join(known, F.col(group) == F.col("_group"), "left")
    turned = F.coalesce(F.col("_known") & _within(seed, ids), F.lit(False))
    return met.withColumn(label, F.when(turned, 1 - F.col(label)).otherwise(F.col(label))).select(*rows.columns)


def first_per_key(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_landmark(rows: DataFrame, person: str, at: str, order: str) -> DataFrame:
    """Of each person the greatest time as text; of equal ones the first row."""
    return first_per_key(rows, [person], F.desc(at), F.asc(order))
