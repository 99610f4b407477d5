"""Patient timelines: one XML file per person to event rows."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chartspan.functions.times import parsed

S, I = T.StringType(), T.IntegerType()
EVENT = T.StructType([
    T.StructField("person_id", S), T.StructField("event_id", S), T.StructField("visit_event_id", S),
    T.StructField("enc_idx", I), T.StructField("ent_idx", I), T.StructField("ev_idx", I), T.StructField("flat_idx", I),
    T.StructField("ts_raw", S), T.StructField("event_type", S), T.StructField("code", S), T.StructField("name", S),
    T.StructField("value", S), T.StructField("unit", S), T.StructField("unit_source_value", S),
    T.StructField("text_all", S), T.StructField("content", S), T.StructField("attrs", T.MapType(S, S)), T.StructField("corrupt", S),
])
PERSON = T.StructType([
    T.StructField("person_id", S), T.StructField("enc_idx", I), T.StructField("has_events", T.BooleanType()), T.StructField("has_person", T.BooleanType()), T.StructField("has_demographics", T.BooleanType()),
    T.StructField("birthdate", S), T.StructField("age_years", S), T.StructField("gender", S), T.StructField("race", S), T.StructField("ethnicity", S), T.StructField("payerplan", S), T.StructField("corrupt", S),
])


#: Parsed rows, and characters of the documents behind them, that a task holds before it passes them on.
ROWS, CHARS = 1024, 1 << 22


def read_documents(spark: SparkSession, path: str, person_ids: list[str] | None = None) -> DataFrame:
    """(person_id, path, xml, size) of a folder, a glob or a file; the id is the file's stem. Of person_ids, only their files are listed
    and read: the ids become the pattern of names."""
    names = "*" if person_ids is None else "{" + ",".join(re.sub(r"([\\*?\[\]{},])", r"\\\1", str(p)) for p in person_ids) + "}"
    docs = spark.read.format("binaryFile").option("pathGlobFilter", f"{names}.xml").load(path)
    return docs.select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("person_id"), "path", F.decode("content", "UTF-8").alias("xml"), F.col("length").alias("size"))


def _first(*values: str | None) -> str | None:
    return next((v for v in values if v), None)


def _rows(person: str, xml: str, tag: str) -> Iterator[dict]:
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        yield {"person_id": person, "corrupt": str(e)}
        return
    parents = {child: up for up in root.iter() for child in up}
    place = {}
    for a, enc in enumerate(root.findall("encounter")):
        for b, entry in enumerate(enc.findall("events/entry")):
            place[entry] = (a, b, -1)
            for c, event in enumerate(entry.findall("event")):
                place[event] = (a, b, c)
    for i, elem in enumerate(root.iter(tag)):
        entry = elem if elem.tag == "entry" else parents.get(elem)
        a, b, c = place.get(elem, (None, None, None))
        at = elem.attrib
        yield {
            "person_id": person, "event_id": f"{person}_{tag}_{i}", "visit_event_id": None if a is None else f"{person}_enc{a}_ent{b}_ev{c}",
            "enc_idx": a, "ent_idx": b, "ev_idx": c, "flat_idx": i,
            "ts_raw": at.get("timestamp") or (entry.get("timestamp") if entry is not None else None),
            "event_type": _first(at.get("type"), at.get("category"), elem.tag), "code": at.get("code"), "name": at.get("name"),
            "value": (elem.text or "").strip() or None, "unit": _first(at.get("unit"), at.get("unit_source_value"), at.get("units")), "unit_source_value": at.get("unit_source_value"),
            "text_all": "".join(elem.itertext()).strip(), "content": ET.tostring(elem, encoding="unicode").strip(), "attrs": dict(at), "corrupt": None,
        }


def _people(person: str, xml: str) -> Iterator[dict]:
    try:
        found = ET.fromstring(xml).findall("encounter")
    except ET.ParseError as e:
        yield {"person_id": person, "corrupt": str(e)}
        return
    paths = {"birthdate": "birthdate", "age_years": "age/years", "gender": "demographics/gender", "race": "demographics/race", "ethnicity": "demographics/ethnicity", "payerplan": "payerplan"}
    for a, enc in enumerate(found):
        who = enc.find("person")
        held = {c: who.findtext(p) for c, p in paths.items()} if who is not None else {}
        yield {"person_id": person, "enc_idx": a, "has_events": enc.find("events") is not None, "has_person": who is not None, "has_demographics": who is not None and who.find("demographics") is not None} | held


def _parsed(batches: Iterator[pa.RecordBatch], rows_of: Callable[[str, str], Iterator[dict]], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of the documents. Beside the batch that Spark hands over, whose bytes it bounds, a task holds one document and few rows,
    however many documents come in a batch."""
    rows, chars = [], 0
    for batch in batches:
        for person, xml in zip(batch["person_id"], batch["xml"]):
            text = xml.as_py() or ""
            chars += len(text)
            for row in rows_of(person.as_py(), text):
                rows.append(row)
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)
                    rows, chars = [], 0
            if rows and chars >= CHARS:
                yield pa.RecordBatch.from_pylist(rows, schema=shape)
                rows, chars = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=shape)


def events(documents: DataFrame, tag: str = "event") -> DataFrame:
    """A row per element of the tag in document order, with its place and all attributes; a file that is no XML gives one row
    with `corrupt` set. Documents are parsed where they lie, one at a time."""

    shape = to_arrow_schema(EVENT)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parsed(batches, lambda person, xml: (row | {"attrs": list(row.get("attrs", {}).items())} for row in _rows(person, xml, tag)), shape)

    return documents.select("person_id", "xml").mapInArrow(parse, EVENT).withColumn("ts", parsed(F.col("ts_raw")))


def persons(documents: DataFrame) -> DataFrame:
    """A row per encounter: whether it has events, and the person block as it stands there."""

    shape = to_arrow_schema(PERSON)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parsed(batches, _people, shape)

    return documents.select("person_id", "xml").mapInArrow(parse, PERSON)


def linked(rows: DataFrame) -> DataFrame:
    """Events with the ids of the ones before and after in their document."""
    w = Window.partitionBy("person_id").orderBy("flat_idx")
    return rows.withColumns({"prev_id": F.lag("event_id").over(w), "next_id": F.lead("event_id").over(w)})


def append_new(store: DataFrame, fresh: DataFrame, key: str = "person_id") -> DataFrame:
    """The rows of fresh whose key the store lacks: loading a document twice adds nothing."""
    return fresh.join(store.select(key).distinct(), key, "left_anti")


def store_stats(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents, persons, events, event types, dated events, bytes."""
    of_events = rows.where("corrupt is null").agg(F.count("event_id").alias("n_events"), F.countDistinct("person_id").alias("n_persons"), F.countDistinct("event_type").alias("n_types"), F.count("ts").alias("n_dated"))
    return of_events.join(F.broadcast(documents.agg(F.count(F.lit(1)).alias("n_documents"), F.sum("size").alias("n_bytes"))))
