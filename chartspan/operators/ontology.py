"""Concept hierarchies: building edges from a vocabulary snapshot, lookups, cycle-safe closures."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.functions.text import vocabulary_of
from chartspan.session import shared_dir, written


def coded(concepts: DataFrame, ignore_invalid: bool = True) -> DataFrame:
    """CONCEPT rows with code (vocabulary/code, null if either is), concept_id as long and is_non_standard."""
    rows = concepts.where(F.coalesce("invalid_reason", F.lit("")) == "") if ignore_invalid else concepts
    return rows.select(
        F.col("concept_id").try_cast("long").alias("concept_id"), F.concat("vocabulary_id", F.lit("/"), "concept_code").alias("code"), F.col("concept_name").alias("description"), F.col("standard_concept").isNull().alias("is_non_standard")
    )


def descriptions(rows: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """(code, description): codes and their OMOP_CONCEPT_ID aliases; of a repeated code the least id. Custom ones win."""
    first = rows.where("code is not null").groupBy("code").agg(F.min_by("description", "concept_id").alias("description"))
    alias = rows.where("concept_id is not null").groupBy(F.concat(F.lit("OMOP_CONCEPT_ID/"), F.col("concept_id").cast("string")).alias("code")).agg(F.max_by("description", "code").alias("description"))
    base = first.unionByName(alias)
    if custom is None:
        return base
    extra = custom.select("code", F.col("description").alias("_own"))
    return base.join(extra, "code", "full").select("code", F.coalesce("_own", "description").alias("description"))


def edges(rows: DataFrame, relationships: DataFrame, ancestors: DataFrame, custom: DataFrame | None = None, replace: bool = True) -> DataFrame:
    """(child, parent, kind) without repeats: non-standard concepts to what they map to, and direct ancestors.

    custom (child, parent) replaces a child's parents, or with replace=False joins them. Concept tables are joined by id on both
    sides; Spark broadcasts them where they are small."""
    ids = rows.where("code is not null").groupBy("concept_id").agg(F.max("code").alias("code"), F.max("is_non_standard").alias("non"))
    a, b = ids.select(F.col("concept_id").alias("x"), F.col("code").alias("child"), "non"), ids.select(F.col("concept_id").alias("y"), F.col("code").alias("parent"))
    maps = relationships.where("relationship_id = 'Maps to' and concept_id_1 <> concept_id_2").select(F.col("concept_id_1").try_cast("long").alias("x"), F.col("concept_id_2").try_cast("long").alias("y"))
    direct = ancestors.where("min_levels_of_separation = '1'").select(F.col("descendant_concept_id").try_cast("long").alias("x"), F.col("ancestor_concept_id").try_cast("long").alias("y"))
    found = maps.join(a.where("non"), "x").join(b, "y").select("child", "parent", F.lit("maps_to").alias("kind"))
    found = found.unionByName(direct.join(a, "x").join(b, "y").select("child", "parent", F.lit("ancestor").alias("kind"))).distinct()
    if custom is None:
        return found
    own = custom.select("child", "parent", F.lit("custom").alias("kind")).distinct()
    return (found.join(own.select("child").distinct(), "child", "left_anti") if replace else found).unionByName(own)


def parents_of(edges_: DataFrame) -> DataFrame:
    """(code, parents) with sorted distinct arrays."""
    return edges_.groupBy(F.col("child").alias("code")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def children_of(edges_: DataFrame, with_maps: bool = True) -> DataFrame:
    rows = edges_ if with_maps or "kind" not in edges_.columns else edges_.where("kind <> 'maps_to'")
    return rows.groupBy(F.col("parent").alias("code")).agg(F.array_sort(F.collect_set("child")).alias("children"))


def metadata(codes: DataFrame, concepts: DataFrame, edges_: DataFrame) -> DataFrame:
    """codes(code) with description, vocabulary, parents; `found` says whether the code is known."""
    known = codes.join(concepts, "code", "left").join(parents_of(edges_), "code", "left")
    return known.withColumns({"vocabulary": vocabulary_of(F.col("code"), "Unknown"), "found": F.col("description").isNotNull()})


def _allowed(code: Column, vocabularies: list[str] | None) -> Column:
    if not vocabularies or "*" in vocabularies:
        return F.lit(True)
    return vocabulary_of(code).isin(vocabularies)


def closure(starts: DataFrame, edges_: DataFrame, concepts: DataFrame, up: bool = True, vocabularies: list[str] | None = None, most_levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes(root, code, level, description, is_start), links(root, child, parent)) of all codes that each start reaches.

    starts(code); many at once, told apart by root. A level joins the frontier with the edges and takes off what was seen, so
    cycles end; it goes on until a level finds nothing new. If that takes more than most_levels, it raises: no result is cut.
    Codes that aren't in concepts or in none of the vocabularies are not entered, starts excepted. Each level is a table in the
    shared folder, so lineage stays short however deep the hierarchy."""
    spark = starts.sparkSession
    near, far = ("child", "parent") if up else ("parent", "child")
    known = concepts.select("code").distinct()
    open_ = written(edges_.select("child", "parent").distinct().join(known.withColumnRenamed("code", far), far, "left_semi").where(_allowed(F.col(far), vocabularies)), "open-edges")
    path, levels = f"{shared_dir(spark)}/closure-{uuid.uuid4().hex}", []
    frontier = starts.select(F.col("code").alias("root"), "code", F.lit(0).alias("level")).distinct()
    shape = frontier.schema
    read = lambda: spark.read.schema(shape).parquet(*levels)
    while True:
        at = f"{path}/{len(levels)}"
        frontier.write.parquet(at)
        frontier = spark.read.schema(shape).parquet(at)
        if levels and frontier.isEmpty():
            break
        if most_levels is not None and len(levels) > most_levels:
            raise ValueError(f"more than {most_levels} levels")
        levels.append(at)
        step = frontier.select("root", F.col("code").alias(near)).join(open_, near).select("root", F.col(far).alias("code")).distinct()
        frontier = step.join(read().select("root", "code"), ["root", "code"], "left_anti").withColumn("level", F.lit(len(levels)))
    seen = read()
    nodes = seen.join(concepts, "code", "left").select("root", "code", "level", F.coalesce("description", "code").alias("description"), (F.col("level") == 0).alias("is_start"))
    links = seen.select("root", F.col("code").alias(near)).join(open_, near).select("root", "child", "parent").distinct()
    return nodes, links


def closure_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    n = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("node_count"))
    e = links.groupBy("root").agg(F.count(F.lit(1)).alias("edge_count"))
    return n.join(e, "root", "left").na.fill({"edge_count": 0})
