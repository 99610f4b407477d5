"""Event retrieval: filters, ranked encounters, history, sorting. Event rows have person_id, event_id, ts, event_type, attrs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Filters:
    """What a search keeps. The time range counts only with both ends; an end of a date alone is its midnight."""

    start: str | None = None
    end: str | None = None
    max_encounters: int | None = None
    event_types: list[str] | None = None
    attributes: dict[str, object] = field(default_factory=dict)
    exclude_empty: bool = False
    min_length: int | None = None
    max_results: int | None = None
    sort_by: str = "relevance"


def in_range(f: Filters) -> Column | None:
    if not (f.start and f.end):
        return None
    return F.col("ts").between(F.to_timestamp_ntz(F.lit(f.start)), F.to_timestamp_ntz(F.lit(f.end)))


def has_attribute(name: str, wanted: object) -> Column:
    """Equality or membership without regard to case; a compiled pattern matches anywhere in the value."""
    value = F.coalesce(F.col("attrs")[name], F.lit(""))
    if isinstance(wanted, str):
        return F.lower(value) == wanted.lower()
    if isinstance(wanted, (list, tuple, set)):
        return F.lower(value).isin([str(v).lower() for v in wanted])
    return value.rlike(wanted.pattern)


def top_encounters(rows: DataFrame, n: int, encounter: Column | None = None) -> DataFrame:
    """The rows of the n encounters of best single score, with `enc_rank` to order by; rows without an encounter are one."""
    name = F.coalesce(F.col("attrs")["encounter_id"], F.lit("unknown")) if encounter is None else encounter
    rows = rows.withColumn("_enc", name)
    best = rows.groupBy("_enc").agg(F.max("score").alias("_best")).orderBy(F.desc("_best"), "_enc").limit(n)
    ranked = best.withColumn("enc_rank", F.row_number().over(Window.orderBy(F.desc("_best"), "_enc")))  # n rows
    return rows.join(F.broadcast(ranked), "_enc").drop("_enc", "_best")


def filtered(rows: DataFrame, f: Filters) -> DataFrame:
    """In this order: time, encounters, types, attributes, empty, length. Limiting encounters comes before the types."""
    if (c := in_range(f)) is not None:
        rows = rows.where(c)
    if f.max_encounters:
        rows = top_encounters(rows, f.max_encounters)
    if f.event_types:
        rows = rows.where(F.col("event_type").isin(list(f.event_types)))
    for name, wanted in f.attributes.items():
        rows = rows.where(has_attribute(name, wanted))
    if f.exclude_empty:
        rows = rows.where(F.length(F.trim("content")) > 0)
    if f.min_length:
        rows = rows.where(F.length("content") >= f.min_length)
    return rows


def ordered(rows: DataFrame, f: Filters, tie: str = "event_id") -> DataFrame:
    """By relevance, date_asc or date_desc (what has no date counts as the earliest), then the limit; none for 0 or None."""
    score = F.desc("score")
    ranks = [F.asc("enc_rank")] if "enc_rank" in rows.columns else []
    by = {"relevance": [*ranks, score, tie], "date_asc": [F.asc_nulls_first("ts"), score, tie], "date_desc": [F.desc_nulls_last("ts"), score, tie]}[f.sort_by]
    rows = rows.orderBy(*by)
    return rows.limit(f.max_results) if f.max_results else rows


def by_type(rows: DataFrame, event_type: str, f: Filters | None = None, person_id: object = None) -> DataFrame:
    """Events of a type with score 1, filtered, ordered and limited."""
    f = f or Filters()
    rows = rows.where(F.col("event_type") == event_type)
    if person_id is not None:
        rows = rows.where(F.col("person_id") == person_id)
    return ordered(filtered(rows.withColumn("score", F.lit(1.0)), f), f)


def history(rows: DataFrame, attributes: dict[str, object], event_type: str = "measurement", f: Filters | None = None, person_id: object = None) -> DataFrame:
    """Dated events of the type with the attributes, by time. A limit applies before the attributes; patterns are ignored."""
    found = by_type(rows, event_type, f, person_id)
    for name, wanted in attributes.items():
        if isinstance(wanted, (str, list)):
            found = found.where(has_attribute(name, wanted))
    return found.where("ts is not null").orderBy("ts", "event_id")


def search(rows: DataFrame, scores: DataFrame, f: Filters | None = None) -> DataFrame:
    """rows with the scores(event_id, score) of a query, zero where there is none; filtered, ordered, limited."""
    f = f or Filters()
    scored = rows.join(scores, "event_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ordered(filtered(scored, f), f)


def containing(rows: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    return rows.where(F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(q)) | F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(q)))


def first_per_person(rows: DataFrame, k: int, order: str = "flat_idx") -> DataFrame:
    w = Window.partitionBy("person_id").orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def snippets(rows: DataFrame, most: int = 200) -> DataFrame:
    """Evidence lines: time, type, name and the start of the text, keyed by person and event."""
    text = F.left(F.coalesce("text_all", F.lit("")), F.lit(most))
    line = F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm"), "event_type", "name", F.nullif(text, F.lit("")))
    return rows.select("person_id", F.concat("person_id", F.lit(":"), "event_id").alias("event_key"), line.alias("snippet"))
