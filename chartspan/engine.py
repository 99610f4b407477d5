"""One object over a corpus: the query tools as methods that return DataFrames, and temp views for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.operators import context, events, facets, labels, ontology, reach, text_index
from chartspan.sources import tables, timelines


class Engine:
    """Documents, their events and persons, a concept hierarchy and task labels; whatever a tool doesn't need may be missing."""

    def __init__(self, spark: SparkSession, documents: DataFrame, concepts: DataFrame | None = None, edges: DataFrame | None = None, task_labels: DataFrame | None = None, index_path: str | None = None):
        """index_path: a shared folder in which the indexes of events, concepts and the hierarchy are kept from one question to the next."""
        self.index_path, self._indexes = index_path, {}
        self.spark, self.documents, self.concepts, self.edges, self.task_labels = spark, documents, concepts, edges, task_labels
        self.events = timelines.events(documents)
        self.persons = timelines.persons(documents)
        self._parsed = False

    @classmethod
    def open(cls, spark: SparkSession, corpus: str, vocabulary: str | None = None, ignore_invalid: bool = True, label_files: dict[str, str] | None = None) -> Engine:
        """corpus: a folder of XML files; vocabulary: a snapshot's folder or ZIP; label_files: CSV files by task."""
        concepts = edges = None
        if vocabulary:
            rows = ontology.coded(tables.read_vocabulary(spark, vocabulary, "CONCEPT"), ignore_invalid)
            concepts = ontology.descriptions(rows)
            edges = ontology.edges(rows, tables.read_vocabulary(spark, vocabulary, "CONCEPT_RELATIONSHIP"), tables.read_vocabulary(spark, vocabulary, "CONCEPT_ANCESTOR"))
        marks = tables.read_labels(spark, label_files) if label_files else None
        return cls(spark, timelines.read_documents(spark, corpus), concepts, edges, marks)

    def materialised(self, path: str) -> Engine:
        """The same engine over Parquet written once: events clustered by person, so that a person's queries prune files."""
        self.events.repartitionByRange("person_id").sortWithinPartitions("person_id", "flat_idx").write.mode("overwrite").parquet(f"{path}/events")
        self.persons.write.mode("overwrite").parquet(f"{path}/persons")
        self.events, self.persons = self.spark.read.parquet(f"{path}/events"), self.spark.read.parquet(f"{path}/persons")
        self._parsed = True
        return self

    def register(self) -> None:
        """Temp views events, persons, documents and, where there are any, concepts, edges and task_labels."""
        for name in ("events", "persons", "documents", "concepts", "edges", "task_labels"):
            if (df := getattr(self, name)) is not None:
                df.createOrReplaceTempView(name)

    def _rows(self, person_id: str | None = None) -> DataFrame:
        """Events that could be parsed; of one person, only that person's document is parsed."""
        if person_id is None:
            return self.events.where("corrupt is null")
        mine = F.col("person_id") == person_id
        return (self.events.where(mine) if self._parsed else timelines.events(self.documents.where(mine))).where("corrupt is null")

    # events

    def search_patient_events(self, query: str, person_id: str | None = None, filters: events.Filters | None = None) -> DataFrame:
        """Ranked by BM25 within the person's events, or within all; events without a term of the query score zero."""
        rows = self._rows(person_id)
        asked = text_index.query_terms(self.spark.range(1).select("id", F.lit(query).alias("q")), "id", "q")
        if self.index_path and person_id is None:
            index = self._kept("events", lambda path: text_index.cached(rows, "event_id", "content", path))
        else:
            index = text_index.build(rows, "event_id", "content", only=asked)
        scores = text_index.bm25(index, asked)
        return events.search(rows, scores.select(F.col("doc").alias("event_id"), "score"), filters)

    def get_events_by_type(self, event_type: str, person_id: str | None = None, filters: events.Filters | None = None) -> DataFrame:
        return events.by_type(self._rows(person_id), event_type, filters)

    def get_historical_values(self, attributes: dict[str, object], person_id: str | None = None, filters: events.Filters | None = None) -> DataFrame:
        return events.history(self._rows(person_id), attributes, "measurement", filters)

    def get_all_patient_events(self, person_id: str) -> DataFrame:
        return self._rows(person_id).orderBy("flat_idx")

    def get_patient_event(self, event_id: str) -> DataFrame:
        return self._rows().where(F.col("event_id") == event_id)

    # store

    def load_timelines(self, path: str) -> Engine:
        """An engine with the documents of the path as well; persons that are there stay as they are."""
        fresh = timelines.append_new(self.documents, timelines.read_documents(self.spark, path))
        return Engine(self.spark, self.documents.unionByName(fresh), self.concepts, self.edges, self.task_labels, self.index_path)

    def get_patient_timeline(self, person_id: str) -> DataFrame:
        return self.documents.where(F.col("person_id") == person_id).select("person_id", "xml", F.length("xml").alias("n_chars"))

    def list_patients(self) -> DataFrame:
        return self.documents.select("person_id").distinct()

    def list_node_ids(self, person_id: str | None = None) -> DataFrame:
        return self._rows(person_id).select("event_id").distinct()

    def get_document_store_stats(self) -> DataFrame:
        return timelines.store_stats(self.events, self.documents)

    # concepts

    def get_code_metadata(self, *codes: str) -> DataFrame:
        return ontology.metadata(self.spark.createDataFrame([(c,) for c in codes], "code string"), self.concepts, self.edges)

    def _closure(self, code: str, vocabularies: list[str] | None, up: bool) -> tuple[DataFrame, DataFrame]:
        start = self.spark.createDataFrame([(code,)], "code string")
        if not self.index_path or vocabularies:
            return ontology.closure(start, self.edges, self.concepts, up, vocabularies)
        return reach.closure(self._kept(f"{'above' if up else 'below'}", lambda path: self._reach(path, up)), start, self.concepts)

    def _kept(self, name: str, make):
        """An index of this engine, looked for on the disk once."""
        if name not in self._indexes:
            self._indexes[name] = make(f"{self.index_path}/{name}")
        return self._indexes[name]

    def _reach(self, path: str, up: bool) -> reach.Reach:
        """The stored reachability of these very edges and concepts, or a new one."""
        marks = (text_index.fingerprint(self.edges, "child", "parent").first(), text_index.fingerprint(self.concepts, "code", "code").first())
        at = f"{path}/{'-'.join(str(m['digest'] or 0) + '-' + str(m['check'] or 0) for m in marks)}"
        found = reach.Reach.load(self.spark, at)
        if found is None:
            reach.build(self.edges, self.concepts, up).save(at)
            found = reach.Reach.load(self.spark, at)
        return found

    def get_ancestor_subgraph(self, code: str, vocabularies: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        return self._closure(code, vocabularies, True)

    def get_descendant_subgraph(self, code: str, vocabularies: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        return self._closure(code, vocabularies, False)

    def search_codes(self, query: str, top_k: int = 10, stem: bool = False) -> DataFrame:
        index = self._kept(f"concepts{'-stems' if stem else ''}", lambda path: text_index.cached(self.concepts, "code", "description", path, stem)) if self.index_path else None
        return text_index.code_search(self.concepts, query, top_k, stem, index)

    # persons

    def facet_documents(self) -> DataFrame:
        return facets.documents(self.events, self.persons)

    def search_patients(self, filters: dict[str, object] | None = None, bounds: dict[str, tuple] | None = None, sort: str | None = None, limit: int = 20, query: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(hits, facet distribution of all that match). A query's words may have typing errors; without a sort, fewest errors come first."""
        docs = self.facet_documents()
        docs = docs.where(facets.predicate(docs, filters or {}))
        if not query:
            return facets.search(docs, {}, bounds, sort, limit), facets.distribution(docs)
        hits = docs.join(facets.text_hits(docs, query), "person_id")
        found = facets.search(hits, {}, bounds, sort, limit, "person_id" if sort else "rank")
        return found.drop("rank"), facets.distribution(hits.drop("rank"))

    def get_task_prediction(self, person_id: str, task: str) -> DataFrame:
        return labels.label_for(self.task_labels.where(F.col("task") == task), self.spark.createDataFrame([(person_id,)], "patient_id string"))

    def patient_context(self, landmarks: DataFrame, lab: bool = False, with_key: bool = True, max_tokens: int | None = None, single_visit: bool = False) -> DataFrame:
        rows = context.single_visit(self._rows(), landmarks) if single_visit else context.at_landmarks(self._rows(), landmarks, "before")
        return context.delta_encoded(rows, lab, with_key, max_tokens)
