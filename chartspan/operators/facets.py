"""Faceted search: one flat document per person, filters, distributions, sorting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspan.functions.text import blank_to_null, title_case
from chartspan.operators import typo_search
from chartspan.operators.context import normalised_gender
from chartspan.session import written

FACETS = ("gender", "race", "ethnicity", "insurance_type", "age_range", "diagnosis_codes", "medication_codes", "departments")


def age_range(age: Column) -> Column:
    return F.when(age < 18, "0-17").when(age < 35, "18-34").when(age < 50, "35-49").when(age < 65, "50-64").when(age.isNotNull(), "65+")


def normalised_ethnicity(c: Column) -> Column:
    low = F.lower(c)
    return F.when(blank_to_null(c).isNull(), None).when(F.contains(low, F.lit("not hispanic")), "Non-Hispanic").when(F.contains(low, F.lit("hispanic")), "Hispanic").otherwise(title_case(c))


def first_insurance(c: Column) -> Column:
    return F.when(blank_to_null(c).isNotNull(), F.trim(F.split_part(c, F.lit("|"), F.lit(1))))


def documents(rows: DataFrame, persons: DataFrame) -> DataFrame:
    """One row per person: demographics of the last encounter that has them, distinct codes without their vocabulary,
    departments, and how many encounters have events."""
    suffix = F.regexp_extract("code", "([^/]*)$", 1)
    codes = rows.where("corrupt is null").groupBy("person_id").agg(
        F.array_sort(F.collect_set(F.when((F.col("attrs")["type"] == "condition") & (F.col("code") != ""), suffix))).alias("diagnosis_codes"),
        F.array_sort(F.collect_set(F.when((F.col("attrs")["type"] == "drug_exposure") & (F.col("code") != ""), suffix))).alias("medication_codes"),
        F.array_sort(F.collect_set(F.when((F.col("attrs")["type"] == "visit_detail") & (F.col("name") != ""), F.col("name")))).alias("departments"),
    )
    last = lambda c, when: F.max_by(c, F.when(when, F.col("enc_idx")))
    demo, person = F.col("has_demographics"), F.col("has_person")
    people = persons.where("corrupt is null").groupBy("person_id").agg(
        last(normalised_gender(F.col("gender")), demo).alias("gender"),
        last(F.coalesce(blank_to_null(F.col("race")), F.lit("Unknown")), demo).alias("race"),
        last(normalised_ethnicity(F.col("ethnicity")), demo).alias("ethnicity"),
        last(F.col("age_years").try_cast("int"), person & (F.col("age_years") != "")).alias("age"),
        last(first_insurance(F.col("payerplan")), person).alias("insurance_type"),
        F.count_if("has_events").alias("encounter_count"),
    )
    found = people.join(codes, "person_id", "left").withColumn("age_range", age_range(F.col("age")))
    return found.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("diagnosis_codes", "medication_codes", "departments")})


def predicate(docs: DataFrame, filters: dict[str, object]) -> Column:
    """Clauses joined by AND, a list's values by OR; array columns match on overlap; nulls and empty lists are left out."""
    out = F.lit(True)
    for name, wanted in filters.items():
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        values = [v for v in values if v is not None]
        if not values:
            continue
        many = isinstance(docs.schema[name].dataType, T.ArrayType)
        out &= F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if many else F.col(name).isin(values)
    return out


def mentions(docs: DataFrame, query: str) -> Column:
    """Whether every word of the query begins a word in some field; no typos are forgiven."""
    fields = [F.col(c) if isinstance(t, T.StringType) else F.array_join(c, " ") for c, t in ((f.name, f.dataType) for f in docs.schema) if isinstance(t, (T.StringType, T.ArrayType))]
    words = F.split(F.lower(F.concat_ws(" ", *fields)), r"[^\p{L}\p{N}]+")
    out = F.lit(True)
    for q in re.findall(r"[^\W_]+", query.lower()):
        out &= F.exists(words, lambda w: w.startswith(q))  # noqa: B023
    return out


def text_hits(docs: DataFrame, query: str, key: str = "person_id") -> DataFrame:
    """(key, rank) of the documents that hold all words of the query in some field: typing errors are forgiven by a word's length, and
    a word may be only begun; fewest errors first."""
    fields = [f.name for f in docs.schema if f.name != key and isinstance(f.dataType, (T.StringType, T.ArrayType))]
    asked = docs.sparkSession.range(1).select("id", F.lit(query).alias("q"))
    return typo_search.search(typo_search.build(written(docs.select(key, *fields), "facet-texts"), key, *fields), asked, "id", "q", None, all_begun=True).select(F.col("doc").alias(key), "rank")


def in_bounds(name: str, low: float | None = None, high: float | None = None) -> Column:
    """Bounds of zero or less are no bounds."""
    out = F.lit(True)
    if low and low > 0:
        out &= F.col(name) >= low
    if high and high > 0:
        out &= F.col(name) <= high
    return out


def distribution(docs: DataFrame, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, n): one pass over the documents, each exploded to its facet values."""
    arrays = [c for c in facets if isinstance(docs.schema[c].dataType, T.ArrayType)]
    value = lambda c: F.col(c) if c in arrays else F.array(F.col(c).cast("string"))

    def pair(c: str) -> Column:
        return F.transform(value(c), lambda v: F.struct(F.lit(c).alias("facet"), v.alias("value")))

    pairs = [pair(c) for c in facets]
    rows = docs.select(F.explode(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<facet:string,value:string>>")) for p in pairs]))).alias("m"))
    return rows.select("m.*").where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def disjunctive(docs: DataFrame, filters: dict[str, object], facets: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, n): each facet's values among the documents that fit all filters but the facet's own, so that a chosen value's
    siblings keep their counts. One pass: a document knows which filters it fails, and counts for every facet if that is none,
    for one facet if that one alone fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(predicate(docs, {c: v}), F.lit(False)), F.lit(c)) for c, v in filters.items()] or [F.lit(None).cast("string")]), lambda c: c.isNotNull())
    arrays = [c for c in facets if isinstance(docs.schema[c].dataType, T.ArrayType)]
    rows = docs.withColumn("_failed", failed).where(F.size("_failed") <= 1)
    value = lambda c: F.col(c) if c in arrays else F.array(F.col(c).cast("string"))
    counts = lambda c: (F.size("_failed") == 0) | F.array_contains("_failed", c)
    pair = lambda c: F.transform(F.when(counts(c), value(c)), lambda v: F.struct(F.lit(c).alias("facet"), v.alias("value")))
    none = F.array().cast("array<struct<facet:string,value:string>>")
    each = rows.select(F.explode(F.flatten(F.array(*[F.coalesce(pair(c), none) for c in facets]))).alias("m"))
    return each.select("m.*").where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def search(docs: DataFrame, filters: dict[str, object] | None = None, bounds: dict[str, tuple] | None = None, sort: str | None = None, limit: int = 20, tie: str = "person_id") -> DataFrame:
    """sort: a column, with :desc behind it for the other order."""
    rows = docs.where(predicate(docs, filters or {}))
    for name, (low, high) in (bounds or {}).items():
        rows = rows.where(in_bounds(name, low, high))
    if sort:
        name, _, way = sort.partition(":")
        rows = rows.orderBy(F.desc(name) if way == "desc" else F.asc(name), tie)
    else:
        rows = rows.orderBy(tie)
    return rows.limit(limit)


def upserted(index: DataFrame, fresh: DataFrame, reset: bool = False, key: str = "person_id") -> DataFrame:
    """The index with the fresh documents in place of those of the same person; with reset the fresh ones alone."""
    return fresh if reset else index.join(fresh.select(key), key, "left_anti").unionByName(fresh)
