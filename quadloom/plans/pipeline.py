"""Stages over quads, the pipeline that runs them for datasets, and what it remembers.

A stage is readers (queries or functions from quads to quads) and transforms
of their union; batches of bindings disappear into the plan. A run goes over
datasets one by one on the driver and does everything else in Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.values import now_iso
from quadloom.operators import quads as Q
from quadloom.plans import sparql
from quadloom.plans.tables import checkpointed
from quadloom.sources.tables import QUAD_COLUMNS, RDF_TYPE, XSD

PROV = "http://www.w3.org/ns/prov#"


class NotSupported(Exception):
    """A reader cannot serve a dataset: it is left out, and a stage without readers is skipped."""


@dataclass(frozen=True)
class Dataset:
    iri: str
    graph: str | None = None
    subject_filter: str = ""
    fingerprint: str | None = None


Reader = Callable[[DataFrame, Dataset], DataFrame]
Transform = Callable[[DataFrame, Dataset], DataFrame]
Validator = Callable[[DataFrame, Dataset], DataFrame]  # the rows at fault


def sparql_reader(text: str, dedupe: bool = False) -> Reader:
    """A CONSTRUCT over a dataset's quads; #subjectFilter# and ?dataset are filled in."""

    def read(quads: DataFrame, dataset: Dataset) -> DataFrame:
        out = sparql.run(Q.in_graph(quads, dataset.graph), text, dataset.iri, dataset.subject_filter)
        out = out.withColumns({c: F.lit(None).cast("string") for c in QUAD_COLUMNS if c not in out.columns})
        out = out.withColumn("dataset", F.lit(dataset.iri)).select(*QUAD_COLUMNS)
        return Q.dedupe(out) if dedupe else out

    return read


def file_reader(path: str, dedupe: bool = False) -> Reader:
    with open(path) as f:
        return sparql_reader(f.read(), dedupe)


@dataclass(frozen=True)
class Stage:
    name: str
    readers: tuple[Reader, ...]
    transforms: tuple[Transform, ...] = ()
    before_write: tuple[Transform, ...] = ()
    validator: Validator | None = None
    #: What a failed validation does: "write" all the same, "skip" the subjects at fault, or "halt".
    on_invalid: str = "write"
    expects_output: bool = False
    #: Whether what was made is described with the times at which its making began and ended.
    provenance: bool = False
    #: Stages that read what this one made.
    children: tuple[Stage, ...] = ()

    def run(self, quads: DataFrame, dataset: Dataset, tell: Callable[..., None] = lambda *what: None) -> DataFrame:
        """The stage's quads, made and written to the shared folder: what fails at run time fails here."""
        began, parts = now_iso(), []
        for reader in self.readers:
            try:
                parts.append(reader(quads, dataset))
            except NotSupported:
                continue
        if not parts:
            raise NotSupported(self.name)
        out = reduce(DataFrame.unionByName, parts)
        for transform in (*self.transforms, *self.before_write):
            out = transform(out, dataset)
        out = checkpointed(out)
        if self.validator:
            faults = checkpointed(self.validator(out, dataset))
            if n := faults.count():
                tell("invalid", dataset.iri, self.name, n)
                if self.on_invalid == "halt":
                    raise ValueError(f"stage {self.name}: the output is not valid")
                if self.on_invalid == "skip":
                    out = out.join(faults.select(F.col("focus").alias("s")).distinct(), "s", "left_anti").select(*out.columns)
        if self.expects_output and out.isEmpty():
            raise ValueError(f"stage {self.name}: no output")
        made = [child.run(out, dataset, tell) for child in self.children]
        if self.provenance:
            out = provenance(self.name, began)(out, dataset)
        return reduce(DataFrame.unionByName, made, out)


def provenance(stage: str, started: str | None = None) -> Transform:
    """Adds what made a dataset: an entity, its activity, and when that began and ended."""

    def add(quads: DataFrame, dataset: Dataset) -> DataFrame:
        began, ended = started or now_iso(), now_iso()
        row = quads.sparkSession.range(1).select(F.lit(dataset.iri).alias("d"), F.concat(F.lit(f"{dataset.iri}/.well-known/prov#activity-"), F.md5(F.lit(stage))).alias("a"))
        made = Q.construct(row, [
            (F.col("d"), RDF_TYPE, ("iri", f"{PROV}Entity")), (F.col("d"), f"{PROV}wasGeneratedBy", ("iri", F.col("a"))), (F.col("a"), RDF_TYPE, ("iri", f"{PROV}Activity")),
            (F.col("a"), f"{PROV}startedAtTime", F.lit(began)), (F.col("a"), f"{PROV}endedAtTime", F.lit(ended)),
        ])
        made = made.withColumn("o_dt", F.when(F.col("o_kind") == "literal", F.lit(f"{XSD}dateTime"))).withColumn("dataset", F.lit(dataset.iri))
        return quads.unionByName(made)

    return add


def normalization(aliases: dict[str, str]) -> Transform:
    return lambda quads, dataset: Q.normalize_namespaces(quads, aliases)


def guard_blank_nodes() -> Transform:
    return lambda quads, dataset: Q.assert_no_blank_nodes(quads)


class ProcessingRecords:
    """What was processed: one row for each pipeline and dataset, kept in a folder of versions."""

    SCHEMA = "pipeline string, dataset string, source_fingerprint string, pipeline_version string, generated_at string, status string"

    def __init__(self, spark: SparkSession, path: str, pipeline: str):
        from quadloom.sinks import VersionedTable

        self.spark, self.pipeline = spark, pipeline
        self.table = VersionedTable(spark, path)

    def all(self) -> DataFrame:
        found = self.table.read()
        return self.spark.createDataFrame([], self.SCHEMA) if found is None else found

    def records(self) -> DataFrame:
        return self.all().where(F.col("pipeline") == self.pipeline)

    def gate(self, datasets: DataFrame, version: str) -> DataFrame:
        """Of datasets (dataset, fingerprint) those to process."""
        from quadloom.functions.values import should_reprocess

        held = self.records().select(F.col("dataset").alias("__d"), "source_fingerprint", "pipeline_version", "status")
        joined = datasets.join(held, F.col("dataset") == F.col("__d"), "left")
        return joined.where(should_reprocess(F.col("fingerprint"), F.lit(version), F.col("source_fingerprint"), F.col("pipeline_version"), F.col("status"))).select(*datasets.columns)

    def record(self, rows: list[tuple]) -> None:
        """(dataset, fingerprint, version, status), each in place of its dataset's row."""
        new = self.spark.createDataFrame([(self.pipeline, d, f, v, now_iso(), s) for d, f, v, s in rows], self.SCHEMA)
        old = self.all().join(new.select("pipeline", "dataset"), ["pipeline", "dataset"], "left_anti")
        self.table.write(old.unionByName(new))


@dataclass
class Reporter:
    """What happened in a run; hooks may be added by name."""

    hooks: dict[str, list[Callable]] = field(default_factory=dict)
    events: list[tuple] = field(default_factory=list)

    def on(self, name: str, hook: Callable) -> None:
        self.hooks.setdefault(name, []).append(hook)

    def tell(self, name: str, *what) -> None:
        self.events.append((name, *what))
        for hook in self.hooks.get(name, ()):
            hook(*what)


class EmptySelection(Exception):
    """No dataset was selected: the run is given up and the writer keeps what it has."""


@dataclass
class Pipeline:
    name: str
    stages: tuple[Stage, ...]
    version: str = "1"
    before_dataset_write: tuple[Transform, ...] = ()
    records: ProcessingRecords | None = None
    reporter: Reporter = field(default_factory=Reporter)

    def run(self, datasets: list[Dataset], quads: Callable[[Dataset], DataFrame], writer) -> None:
        """Process datasets into a writer: each dataset's failures stay its own; all or nothing is committed."""
        if not datasets:
            writer.abandon()
            raise EmptySelection(self.name)
        wanted = self._changed(datasets)
        writer.open([d.iri for d in datasets])
        outcomes = []
        try:
            for dataset in datasets:
                if dataset.iri not in wanted:
                    self.reporter.tell("skipped", dataset.iri)
                    continue
                outcomes.append((dataset.iri, dataset.fingerprint, self.version, self._process(dataset, quads(dataset), writer)))
        except BaseException:
            writer.abort()
            raise
        writer.commit()
        if self.records and outcomes:
            self.records.record(outcomes)

    def _changed(self, datasets: list[Dataset]) -> set[str]:
        if self.records is None:
            return {d.iri for d in datasets}
        rows = self.records.spark.createDataFrame([(d.iri, d.fingerprint) for d in datasets], "dataset string, fingerprint string")
        return {r.dataset for r in self.records.gate(rows, self.version).collect()}  # the selected datasets' names, at most

    def _process(self, dataset: Dataset, quads: DataFrame, writer) -> str:
        failed = 0
        parts = []
        for stage in self.stages:
            try:
                parts.append(stage.run(quads, dataset, self.reporter.tell))
                self.reporter.tell("stage", dataset.iri, stage.name)
            except NotSupported:
                self.reporter.tell("stage_skipped", dataset.iri, stage.name)
            except Exception as e:  # the dataset's other stages still run
                failed += 1
                self.reporter.tell("stage_failed", dataset.iri, stage.name, str(e))
        if parts:
            out = reduce(DataFrame.unionByName, parts)
            for transform in self.before_dataset_write:
                out = transform(out, dataset)
            try:
                writer.write(dataset.iri, out)
            except Exception as e:
                failed += 1
                writer.reset(dataset.iri)
                self.reporter.tell("write_failed", dataset.iri, str(e))
        writer.flush(dataset.iri, failed == 0)
        return "failure" if failed else "success"


def combine(*writers):
    """One writer that passes everything to several; what one has opened is aborted if another cannot open."""
    from quadloom.sinks import Tee

    return Tee(list(writers))
