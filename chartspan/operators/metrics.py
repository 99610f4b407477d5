"""Evaluation of paired experiments, distributions and histograms. All aggregates are partial sums but for exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, keys: list[str], true: str = "label", pred: str = "pred", small: int = 20) -> DataFrame:
    """Per key: n, parsed, accuracy over all (unparsed ones wrong) and over parsed ones, parse rate, confusion counts, balanced
    accuracy (null if a class is missing), and whether n is small. Labels and predictions are 1 and 0."""
    t, p = F.col(true), F.col(pred)
    right = F.count_if(t == p)
    n, parsed = F.count(F.lit(1)), F.count(p)
    tp, tn = F.count_if((t == 1) & (p == 1)), F.count_if((t == 0) & (p == 0))
    fp, fn = F.count_if((t == 0) & (p == 1)), F.count_if((t == 1) & (p == 0))
    out = rows.groupBy(*keys).agg(n.alias("n"), parsed.alias("n_parsed"), right.alias("n_right"), tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"))
    c = F.col
    tpr, tnr = F.try_divide(c("tp"), c("tp") + c("fn")), F.try_divide(c("tn"), c("tn") + c("fp"))
    return out.withColumns({
        "accuracy": c("n_right") / c("n"), "accuracy_parsed": F.try_divide(c("n_right"), c("n_parsed")), "parse_rate": c("n_parsed") / c("n"), "balanced_accuracy": (tpr + tnr) / 2, "small_n": c("n") < small,
    })


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def paired(base: DataFrame, other: DataFrame, keys: list[str], group: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Per group over the keys in both: n, flips, fixes (wrong, then right), hurts (right, then wrong), delta of accuracy."""
    a = base.select(*keys, F.col(label).alias("_t"), F.col(pred).alias("_a"))
    b = other.select(*keys, F.col(pred).alias("_b"))
    right = lambda c: F.coalesce(F.col(c) == F.col("_t"), F.lit(False))
    rows = a.join(b, keys)
    out = rows.groupBy(*group) if group else rows.groupBy()
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_flip"), F.count_if(~right("_a") & right("_b")).alias("n_fix"), F.count_if(right("_a") & ~right("_b")).alias("n_hurt"),
    ).withColumn("delta", (F.col("n_fix") - F.col("n_hurt")) / F.col("n"))


def best_variant(per_task: DataFrame, task: str, variant: str, value: str, variants: list[str]) -> DataFrame:
    """A row per task with a column for each variant and `best`, which is `tie` where several share the maximum."""
    wide = per_task.groupBy(task).pivot(variant, variants).agg(F.max(value))
    most = F.greatest(*variants) if len(variants) > 1 else F.col(variants[0])
    hits = F.filter(F.array(*[F.when(F.col(v) == most, F.lit(v)) for v in variants]), lambda v: v.isNotNull())
    return wide.withColumn("best", F.when(F.size(hits) > 1, "tie").otherwise(F.get(hits, F.lit(0))))


def disagreement(rows: DataFrame, task: str, a: str, b: str) -> DataFrame:
    differ = F.count_if(F.col(a) != F.col(b))
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(task).agg(F.count(F.lit(1)).alias("n"), differ.alias("n_differ")).withColumn("pct_differ", F.round(100 * F.col("n_differ") / F.col("n"), 2))


def class_balance(rows: DataFrame, task: str, label: str) -> DataFrame:
    return rows.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))


def _at_rank(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A row for each distinct value of a key, with `_c`, how often it is there, `_i`, its first place in ascending order from 0,
    and `_k`, how many values the key has. Counting comes before the window, so a hot key costs its distinct values, not its rows."""
    each = Window.partitionBy(*keys)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return counts.withColumns({"_i": F.sum("_c").over(each.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c"), "_k": F.sum("_c").over(each)})


def _pick(value: str, at: Column) -> Column:
    return F.max(F.when((F.col("_i") <= at) & (at < F.col("_i") + F.col("_c")), F.col(value)))


def _mean(value: str) -> Column:
    return F.round(F.sum(F.col(value) * F.col("_c")) / F.sum("_c"), 2)


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, max, mean, and median, p25, p75, p90 as the values at place int(q * n); p25 and p75 need four values, p90 ten,
    else the extremes stand for them."""
    k = F.col("_k")
    at = lambda q: _pick(value, F.floor(k * q))
    low, high = F.min(value), F.max(value)
    n = F.sum("_c")
    return _at_rank(rows, keys, value).groupBy(*keys).agg(
        n.alias("n"), low.alias("min"), high.alias("max"), _mean(value).alias("mean"), at(0.5).alias("median"),
        F.when(n >= 4, at(0.25)).otherwise(low).alias("p25"), F.when(n >= 4, at(0.75)).otherwise(high).alias("p75"), F.when(n >= 10, at(0.9)).otherwise(high).alias("p90"),
    )


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As distribution(), with p10 at place int(n / 10) - 1 (the first at least), p90 at int(0.9 * n), and the total."""
    k = F.col("_k")
    return _at_rank(rows, keys, value).groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), _mean(value).alias("mean"), _pick(value, F.floor(k * 0.5)).alias("median"),
        _pick(value, F.greatest(F.lit(0), F.floor(k * 0.1) - 1)).alias("p10"), _pick(value, F.least(k - 1, F.floor(k * 0.9))).alias("p90"), F.sum(F.col(value) * F.col("_c")).alias("total"),
    )


def nearest_rank(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The value at place ceil(q * n), counted from 1."""
    return _at_rank(rows, keys, value).groupBy(*keys).agg(_pick(value, F.greatest(F.lit(0), F.ceil(F.col("_k") * q) - 1)).alias("value"))


def interpolated(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The value at place q * (n - 1), counted from 0, between its neighbours in proportion. Values are counted, not gathered."""
    at = (F.col("_k") - 1) * q
    low, high = _pick(value, F.floor(at)), _pick(value, F.ceil(at))
    share = F.max(at - F.floor(at))
    return _at_rank(rows, keys, value).groupBy(*keys).agg((low + (high - low) * share).cast("double").alias("value"))


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n): right-closed bins, the first open below, and one beyond the last edge."""
    label = None
    for low, high in zip(edges, edges[1:]):
        hit = F.col(value) <= high
        label = F.when(hit, f"({low}, {high}]") if label is None else label.when(hit, f"({low}, {high}]")
    label = label.otherwise(f"> {edges[-1]}") if label is not None else F.lit(f"> {edges[-1]}")
    return rows.where(F.col(value).isNotNull()).groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage(rows: DataFrame, value: str, limits: tuple[int, ...] = (4096, 32768)) -> DataFrame:
    """One row: the share of values up to each limit."""
    return rows.agg(F.count(value).alias("n"), *[(F.count_if(F.col(value) <= x) / F.count(value)).alias(f"share_{x}") for x in limits])


def truncation(rows: DataFrame, value: str, caps: list[int]) -> DataFrame:
    """Per cap: the mean kept, the mean cut off, and the percentage of rows that lose something. One pass."""
    each = rows.select(F.col(value).alias("v"), F.explode(F.array(*map(F.lit, caps))).alias("cap"))
    return each.groupBy("cap").agg(F.avg(F.least("v", "cap")).alias("mean_kept"), F.avg(F.greatest(F.col("v") - F.col("cap"), F.lit(0))).alias("mean_cut"), (100 * F.avg((F.col("v") > F.col("cap")).cast("int"))).alias("pct_cut"))


def bootstrap_auc(rows: DataFrame, label: str, score: str, id_col: str, n: int = 100, seed: int = 0) -> DataFrame:
    """One row: the mean and the 2.5 and 97.5 percentiles of the AUC over n resamples. A resample weighs each row by a Poisson(1)
    draw, so resamples are made where the rows lie; the AUC is the rank sum with midranks, weights and all."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "rep", id_col), F.lit(1 << 30)) + 0.5) / (1 << 30)
    weight, p, total = F.lit(0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 8):
        weight = F.when(u > total, k).otherwise(weight)
        p /= k
        total += p
    reps = rows.select(F.col(id_col), F.col(label).alias("y"), F.col(score).alias("s"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rep")).withColumn("w", weight)
    sums = reps.where("w > 0").groupBy("rep", "s").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = sums.withColumn("won", F.col("pos") * (below + F.col("neg") / 2)).groupBy("rep").agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))
    return auc.agg(F.avg("auc").alias("auc"), F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))


def cohort_counts(items: DataFrame) -> DataFrame:
    """(split, task, label, n, n_persons)."""
    return items.groupBy("split", "task", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("n_persons"))


def several_landmarks(items: DataFrame) -> DataFrame:
    """One row: how many persons have more than one landmark."""
    return items.groupBy("person_id").agg(F.countDistinct("embed_time").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_persons"))


def items_per_task(items: DataFrame) -> DataFrame:
    """One row: the least, the median and the most items of a task. Tasks are counted first, so what is ordered is a row a task."""
    return items.groupBy("task").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"))


def schema_ratio(rows: DataFrame, task: str, schema: str, value: str, missing: str) -> DataFrame:
    """(task, n, value_ratio, missing_ratio): per task the mean share of values in a prompt's characters, v / (s + v + 1), and of missing
    fields, over columns that hold the sizes of either and the share."""
    ratio = F.col(value) / (F.col(schema) + F.col(value) + 1)
    return rows.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.avg(ratio).alias("value_ratio"), F.avg(missing).alias("missing_ratio"))


def with_tool(rows: DataFrame, tool: DataFrame, keys: list[str], value: str = "value", to: str = "tool") -> DataFrame:
    """rows with a tool's value for the same keys, null where it has none; of a key's repeated values the least."""
    return rows.join(tool.groupBy(*keys).agg(F.min(value).alias(to)), keys, "left")


def three_ways(rows: DataFrame, task: str, label: str, a: str, b: str, c: str) -> DataFrame:
    """(task, n, right_a, right_b, right_c, only_a, only_b, only_c, all_right, none_right) over rows of three answers; no answer is wrong."""
    right = [F.coalesce(F.col(x) == F.col(label), F.lit(False)) for x in (a, b, c)]
    only = [right[i] & ~right[(i + 1) % 3] & ~right[(i + 2) % 3] for i in range(3)]
    names = ("a", "b", "c")
    return rows.groupBy(task).agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(r).alias(f"right_{n}") for r, n in zip(right, names)), *(F.count_if(o).alias(f"only_{n}") for o, n in zip(only, names)),
        F.count_if(right[0] & right[1] & right[2]).alias("all_right"), F.count_if(~right[0] & ~right[1] & ~right[2]).alias("none_right"),
    )
