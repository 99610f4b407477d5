from __future__ import annotations

import datetime as dt
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartspan.operators import context, events, facets
from chartspan.sources import timelines

P1 = """<ROOT person_id="p1">
  <encounter>
    <person><birthdate>1960-02-29</birthdate><age><years>63</years></age>
      <demographics><gender>FEMALE</gender><race>Asian</race><ethnicity>Not Hispanic or Latino</ethnicity></demographics><payerplan>MEDICARE | OTHER</payerplan></person>
    <events>
      <entry timestamp="2023-01-15 10:00">
        <event type="measurement" code="LOINC/8867-4" name="Heart rate" units="/min">72</event>
        <event type="note" code="STANFORD_NOTE/x" name="note" note_title="progress notes" note_id="9">body <b>mixed</b>  tail</event>
        <event type="note" code="STANFORD_NOTE/y" name="letter" note_title="letter">no</event>
        <event type="condition" code="ICD10CM/E11.9" name="Type 2 diabetes"/>
      </entry>
    </events>
  </encounter>
  <encounter><person><demographics><gender>x-ray o'neil</gender></demographics></person></encounter>
  <encounter>
    <events>
      <entry timestamp="2023-02-01T08:30:15.5Z"><event type="drug_exposure" code="RxNorm/866508" name="metoprolol" unit_source_value="mg">50</event></entry>
      <entry timestamp="2023-02-02"><event type="visit_detail" name="Cardiology"/></entry>
      <entry><event type="measurement" code="LOINC/1" name="undated">1</event></entry>
    </events>
  </encounter>
  <encounter><events><entry timestamp="2023-02-02 00:00"><event type="condition" code="SNOMED/1" name="é tie"/></entry></events></encounter>
</ROOT>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("xml")
    (d / "p1.xml").write_text(P1, encoding="utf-8")
    (d / "p2.xml").write_text("<ROOT><encounter>", encoding="utf-8")
    (d / "p3.xml").write_text("<ROOT><encounter><events><entry timestamp='garbage'><event type='a' name='b'/></entry></events></encounter></ROOT>", encoding="utf-8")
    return str(d)


@pytest.fixture(scope="module")
def rows(spark, folder):
    return timelines.events(timelines.read_documents(spark, folder)).cache()


def at(spark, person, *cutoffs):
    return spark.createDataFrame([(person, dt.datetime.fromisoformat(c)) for c in cutoffs], "person_id string, cutoff timestamp_ntz")


def test_events_in_document_order(rows):
    got = rows.where("person_id = 'p1'").orderBy("flat_idx").collect()
    assert [r.visit_event_id for r in got][:2] == ["p1_enc0_ent0_ev0", "p1_enc0_ent0_ev1"]
    assert [r.enc_idx for r in got] == [0, 0, 0, 0, 2, 2, 2, 3]
    assert got[0].unit == "/min" and got[0].value == "72" and got[1].text_all == "body mixed  tail" and got[1].attrs["note_id"] == "9"
    assert got[4].ts == dt.datetime(2023, 2, 1, 8, 30, 15, 500000) and got[4].unit == "mg" and got[6].ts is None
    assert rows.where("person_id = 'p2'").first().corrupt
    assert rows.where("person_id = 'p3'").first().ts is None


def test_entries_and_links(spark, folder, rows):
    docs = timelines.read_documents(spark, folder, ["p1"])
    assert docs.count() == 1 and timelines.read_documents(spark, folder, ["p1", "p3", "p[9"]).count() == 2 and timelines.read_documents(spark, folder, []).count() == 0
    assert timelines.events(docs, "entry").count() == 5
    got = timelines.linked(rows.where("person_id = 'p1'")).orderBy("flat_idx").collect()
    assert got[0].prev_id is None and got[0].next_id == got[1].event_id and got[-1].next_id is None
    assert timelines.append_new(rows, rows).count() == 0
    assert timelines.store_stats(rows, timelines.read_documents(spark, folder)).first().n_documents == 3


def test_cutoff_modes(spark, rows):
    mark = at(spark, "p1", "2023-02-02T00:00:00")
    assert context.at_landmarks(rows, mark, "before").count() == 5
    assert context.at_landmarks(rows, mark, "through").count() == 7
    assert context.at_landmarks(rows, mark, "through_day").count() == 8
    one = context.single_visit(rows, mark)
    assert {r.enc_idx for r in one.collect()} == {2} and one.count() == 2  # of two with the same latest time the first
    assert {r.enc_idx for r in context.last_encounters(rows, mark, 2).collect()} == {2, 3}


def test_context_text(spark, rows):
    mark = at(spark, "p1", "2023-02-03T00:00:00")
    text = context.delta_encoded(context.at_landmarks(rows, mark, "before").where("enc_idx >= 2")).first().context
    assert text == "2023-02-01 08:30\nRxNorm/866508 | metoprolol | 50 mg\n2023-02-02\n| Cardiology\nSNOMED/1 | é tie"
    lab = context.delta_encoded(context.at_landmarks(rows, mark, "before").where("enc_idx = 0"), lab=True, with_key=True).first().context
    assert lab.startswith("2023-01-15\nLOINC/8867-4 | Heart rate | 72 [[p1:p1_event_0]]\n")


def test_linearised(spark, rows):
    mark = at(spark, "p1", "2023-01-20T00:00:00")
    text = context.linearised(rows, mark, keep=context.allowed()).first().text
    assert text.split("\n") == ["[2023-01-15 10:00] measurement | LOINC/8867-4 | Heart rate | 72", "[2023-01-15 10:00] note | STANFORD_NOTE/x | note | body mixed tail", "[UNK_TIME] measurement | LOINC/1 | undated | 1"]


def test_demographics(spark, folder):
    people = timelines.persons(timelines.read_documents(spark, folder))
    got = {r.cutoff.year: r.demographics for r in context.demographics(people, at(spark, "p1", "2023-02-28T00:00:00", "1950-01-01T00:00:00")).collect()}
    assert got[2023] == "PATIENT DEMOGRAPHICS AT PREDICTION TIME:\nAge: 62 years\nSex: female\nRace: Asian\nEthnicity: Not Hispanic or Latino\n"
    assert "Age" not in got[1950]


def test_compact(spark, rows):
    mark = at(spark, "p1", "2023-02-01T12:00:00")
    got = {r.event_id: r.when for r in context.compact(rows, mark).collect()}
    assert got["p1_event_0"] == "-1y 347d 22h 0m" and "p1_event_7" not in got and "p1_event_4" in got
    compat = {r.event_id: r.when for r in context.compact(rows, mark, compat=True).collect()}
    assert compat["p1_event_5"] == "2023-02-02"
    assert "note_id" not in context.compact(rows, mark).where("event_id = 'p1_event_1'").first().attrs
    assert {r.enc_idx for r in context.compact(rows, at(spark, "p1", "2023-03-01T00:00:00"), most_bytes=150).collect()} == {3}


def test_facets(spark, folder, rows):
    docs = facets.documents(rows, timelines.persons(timelines.read_documents(spark, folder)))
    p1 = docs.where("person_id = 'p1'").first()
    assert (p1.gender, p1.race, p1.ethnicity, p1.age, p1.age_range, p1.insurance_type) == ("X-Ray O'Neil", "Unknown", None, 63, "50-64", None)
    assert p1.diagnosis_codes == ["1", "E11.9"] and p1.medication_codes == ["866508"] and p1.departments == ["Cardiology"] and p1.encounter_count == 3
    assert facets.search(docs, {"diagnosis_codes": ["E11.9"], "gender": []}).count() == 1
    assert facets.upserted(docs, docs).count() == docs.count()
    got = {(r.facet, r.value): r.n for r in facets.distribution(docs).collect()}
    assert got["departments", "Cardiology"] == 1 and got["age_range", "50-64"] == 1


def test_search_filters(spark, rows):
    base = rows.where("person_id = 'p1'")
    assert events.history(base, {"name": "HEART rate"}).count() == 1
    assert events.by_type(base, "measurement", events.Filters(start="2023-01-01")).count() == 2  # one end is none
    assert events.by_type(base, "measurement", events.Filters(start="2023-01-01", end="2023-01-15")).count() == 0  # its midnight
    scores = base.select("event_id").limit(0).withColumn("score", F.lit(1.0))
    assert events.search(base, scores, events.Filters(max_results=3, sort_by="date_asc")).first().ts is None


def test_engine(spark, folder, tmp_path):
    from chartspan.engine import Engine
    from tests.test_library import vocabulary

    (tmp_path / "v").mkdir()
    vocabulary(tmp_path / "v")
    (tmp_path / "t.csv").write_text("patient_id,prediction_time,value\np1,2023-01-01,True\np1,2023-02-01,False\n")
    e = Engine.open(spark, folder, str(tmp_path / "v"), label_files={"t": str(tmp_path / "t.csv")}).materialised(str(tmp_path / "store"))
    e.register()
    assert spark.sql("select count(*) from events where person_id = 'p1'").first()[0] == 8
    hits = e.search_patient_events("metoprolol", "p1", events.Filters(max_results=2)).collect()
    assert hits[0].event_id == "p1_event_4" and hits[0].score > 0 and hits[1].score == 0
    assert e.search_patient_events("metoprolol").count() == 9 and e.get_events_by_type("condition").count() == 2
    assert e.get_historical_values({"code": "LOINC/8867-4"}).first().value == "72"
    assert e.get_patient_event("p1_event_0").first().name == "Heart rate" and e.list_node_ids("p1").count() == 8 and e.list_patients().count() == 3
    assert e.load_timelines(folder).documents.count() == 3 and e.get_patient_timeline("p1").first().n_chars == len(P1)
    assert [r.found for r in e.get_code_metadata("SNOMED/123456", "X/1").orderBy("code").collect()] == [True, False]
    assert e.get_ancestor_subgraph("ICD10CM/E11.9")[0].count() == 3 and e.get_descendant_subgraph("SNOMED/123456")[0].count() == 3
    assert e.search_codes("one", 5).first().code == "OMOP_CONCEPT_ID/1"
    found, counts = e.search_patients({"diagnosis_codes": ["E11.9"]}, query="cardio o'neil")
    assert found.first().person_id == "p1" and counts.where("facet = 'departments'").first().n == 1
    assert e.get_task_prediction("p1", "t").first().prediction == "yes" and e.get_task_prediction("p9", "t").first().prediction is None
    assert "metoprolol" in e.patient_context(at(spark, "p1", "2023-02-02T00:00:00"), single_visit=True).first().context


def test_engine_keeps_its_indexes(spark, folder, tmp_path, monkeypatch):
    """Answers over kept indexes are those without; a second engine builds nothing."""
    from chartspan.engine import Engine
    from chartspan.operators import reach, text_index

    documents = timelines.read_documents(spark, folder)
    concepts = spark.createDataFrame([("A/1", "Fractured bones"), ("A/2", "a bone"), ("B/3", "skin")], "code string, description string")
    edges = spark.createDataFrame([("A/1", "A/2"), ("A/2", "B/3"), ("B/3", "A/1")], "child string, parent string")
    plain = Engine(spark, documents, concepts, edges)

    def answers(e):
        hits = [(x.event_id, round(x.score, 9)) for x in e.search_patient_events("metoprolol").collect()]
        codes = [[tuple(x) for x in e.search_codes("bones", 5, stem).collect()] for stem in (False, True)]
        graphs = [[sorted(map(tuple, df.collect())) for df in f("A/1", v)] for f in (e.get_ancestor_subgraph, e.get_descendant_subgraph) for v in (None, ["A"])]
        return hits, codes, graphs

    want = answers(plain)
    assert len(want[1][0]) == 1 and len(want[1][1]) == 2
    assert answers(Engine(spark, documents, concepts, edges, index_path=str(tmp_path / "kept"))) == want
    built = []
    for module in (text_index, reach):
        monkeypatch.setattr(module, "build", lambda *a, f=module.build, **k: built.append(k) or f(*a, **k))
    again = Engine(spark, documents, concepts, edges, index_path=str(tmp_path / "kept"))
    assert answers(again) == want and built == []
    more = Engine(spark, documents, concepts.union(spark.createDataFrame([("C/4", "bones")], concepts.schema)), edges, index_path=str(tmp_path / "kept"))
    assert len(more.search_codes("bones", 5).collect()) == 2 and len(built) == 1


def test_sampled_cosines(spark):
    from chartspan.operators import text_index

    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "x y z") for i in range(40)], "id int, t string")
    got = text_index.sampled_cosines(text_index.build(docs, "id", "t"), 20).collect()
    assert 10 <= len(got) <= 20 and all(abs(r.cosine - ((r.a - r.b) % 2 == 0)) < 1e-9 for r in got)


class Asked:
    """In a DataFrame's place: keeps the function that rows would be mapped by."""

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        self.f = f
        return self

    def withColumn(self, *_):
        return self


@pytest.mark.parametrize("read", [timelines.events, timelines.persons])
def test_a_batch_of_many_documents_is_parsed_in_little_memory(spark, read):
    day = "<encounter><person><birthdate>1950-01-01</birthdate></person><events><entry timestamp='2024-01-01 00:00:00'><event type='note'>" + "x" * 600 + "</event></entry></events></encounter>"
    batch = pa.RecordBatch.from_pydict({"person_id": [f"p{i}" for i in range(1500)], "xml": ["<ROOT>" + 20 * day + "</ROOT>"] * 1500})
    parse = read(Asked()).f
    tracemalloc.start()
    n = sum(out.num_rows for out in parse(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 30_000 and peak < 12e6, peak
