"""Writers: all-or-nothing runs over files, tables and search indexes.

A run opens, writes dataset by dataset, as often as it likes, flushes each with
its outcome, and commits or aborts; reset takes back one dataset's rows of this
run. What is written is staged first: nothing that was there changes before commit.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators.quads import dedupe, serialize
from quadloom.plans.tables import Files


class VersionedTable:
    """A table as a folder of versions: the newest version with a marker holds. Old ones may be kept."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 1):
        self.spark, self.path, self.keep, self.files = spark, path.rstrip("/"), keep, Files(spark)

    def versions(self) -> list[str]:
        return self.files.names(f"{self.path}/_committed")

    def read(self) -> DataFrame | None:
        versions = self.versions()
        return self.spark.read.parquet(f"{self.path}/{versions[-1]}") if versions else None

    def new_version(self) -> str:
        return f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, rows: DataFrame) -> str:
        name = self.new_version()
        rows.write.parquet(f"{self.path}/{name}")
        self.swap(name)
        return name

    def swap(self, name: str) -> None:
        """Make a written version the one that holds, and drop those before the kept ones."""
        self.files.create(f"{self.path}/_committed/{name}")
        for old in self.versions()[: -1 - self.keep]:
            self.files.delete(f"{self.path}/_committed/{old}")
            self.files.delete(f"{self.path}/{old}")


class QuadFileWriter:
    """One folder of N-Triples or N-Quads lines for each dataset, swapped in when the run commits; empty output leaves none."""

    def __init__(self, spark: SparkSession, path: str, quads: bool = False, graph: str | None = None, keep_partial: bool = False):
        """keep_partial: what a dataset's other stages made is kept where one of them failed."""
        self.files, self.path, self.quads, self.graph, self.staged, self.keep_partial = Files(spark), path.rstrip("/"), quads, graph, {}, keep_partial

    @staticmethod
    def folder(dataset: str) -> str:
        """A name of its own for each dataset: what may not stand in one is escaped, as _ is, by its code points."""
        return "".join(c if c.isascii() and c.isalnum() or c in "-." else f"_{ord(c):x}_" for c in dataset)

    def open(self, datasets: list[str]) -> None:
        self.run, self.staged = uuid.uuid4().hex, {}

    def write(self, dataset: str, quads: DataFrame) -> None:
        if self.graph is not None:
            quads = quads.withColumn("g", F.lit(self.graph))
        staged = f"{self.path}/_run-{self.run}/{self.folder(dataset)}"
        serialize(quads, self.quads).write.mode("append").text(staged)
        self.staged[dataset] = staged

    def flush(self, dataset: str, ok: bool) -> None:
        if not ok and not self.keep_partial:
            self.reset(dataset)

    def reset(self, dataset: str) -> None:
        if dataset in self.staged:
            self.files.delete(self.staged.pop(dataset))

    def commit(self) -> None:
        for dataset, staged in self.staged.items():
            self.files.rename(staged, f"{self.path}/{self.folder(dataset)}")
        self.abort()

    def abort(self) -> None:
        self.files.delete(f"{self.path}/_run-{self.run}")
        self.staged = {}

    def abandon(self) -> None:
        self.staged = {}


class GraphTableWriter:
    """A table of quads partitioned by graph. A commit replaces the graphs that the run wrote, each by all rows that
    any dataset wrote to it, and no others; graphs of a run without rows stay as they were."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files, self.staged = spark, path.rstrip("/"), Files(spark), {}

    def open(self, datasets: list[str]) -> None:
        self.run, self.staged = uuid.uuid4().hex, {}

    def write(self, dataset: str, quads: DataFrame) -> None:
        staged = f"{self.path}/_run-{self.run}/{QuadFileWriter.folder(dataset)}"
        quads.withColumn("g", F.coalesce("g", F.lit(dataset))).write.mode("append").parquet(staged)
        self.staged[dataset] = staged

    def flush(self, dataset: str, ok: bool) -> None:
        if not ok:
            self.reset(dataset)

    def reset(self, dataset: str) -> None:
        if dataset in self.staged:
            self.files.delete(self.staged.pop(dataset))

    def commit(self) -> None:
        if self.staged:
            rows = self.spark.read.parquet(*self.staged.values())
            # a triple that two datasets wrote to one graph is one; partitions are swapped when the job commits
            dedupe(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("g").parquet(self.path)
        self.abort()

    def abort(self) -> None:
        self.files.delete(f"{self.path}/_run-{self.run}")
        self.staged = {}

    def abandon(self) -> None:
        self.staged = {}


class Tee:
    """Several writers as one. Rows that go to several are computed once for each; a writer that cannot open aborts those before."""

    def __init__(self, writers: list):
        self.writers = writers

    def open(self, datasets: list[str]) -> None:
        opened = []
        try:
            for w in self.writers:
                w.open(datasets)
                opened.append(w)
        except BaseException:
            for w in reversed(opened):
                w.abort()
            raise

    def __getattr__(self, name: str):
        def all_of(*args):
            for w in self.writers:
                getattr(w, name)(*args)

        return all_of


# -- search indexes as tables: id, the document's columns, source and last_seen


def last_wins(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row a key: that of the largest order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def stale(rows: DataFrame, source: str, run: str) -> DataFrame:
    """A source's documents that a run has not seen; never seen counts as not."""
    return rows.where((F.col("source") == source) & ~F.col("last_seen").eqNullSafe(F.lit(run)))


def departed_sources(indexed: DataFrame, selected: DataFrame) -> DataFrame:
    """Sources (source) of indexed documents that are selected no more."""
    return indexed.select("source").distinct().join(selected.select("source").distinct(), "source", "left_anti")


def sweep(rows: DataFrame, selected: DataFrame, finished: DataFrame, run: str) -> DataFrame:
    """What stays: no departed sources, and of finished ones only what the run has seen."""
    kept = rows.join(selected.select("source").distinct(), "source", "left_semi")
    done = finished.select(F.col("source").alias("__done")).distinct()
    marked = kept.join(done, F.col("source") == F.col("__done"), "left")
    return marked.where(F.col("__done").isNull() | F.col("last_seen").eqNullSafe(F.lit(run))).drop("__done").select(*rows.columns)


class IndexLock:
    """One run at a time on an index: a file that names its owner, which a later run takes over after its time.

    A stale lock is set aside by a rename, which only one of several runs can do; the file is then made
    by one of them alone. Only its owner releases a lock.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: float = 600):
        self.files, self.path, self.ttl, self.owner = Files(spark), f"{path.rstrip('/')}/_lock", ttl_seconds, uuid.uuid4().hex

    def acquire(self) -> None:
        if self.files.exists(self.path) and self.files.age_seconds(self.path) > self.ttl:
            self.files.move(self.path, f"{self.path}-stale-{self.owner}")
            self.files.delete(f"{self.path}-stale-{self.owner}")
        if not self.files.create(self.path, self.owner):
            raise RuntimeError("another run holds the index")

    def held(self) -> bool:
        return self.files.text(self.path) == self.owner

    def release(self) -> None:
        if self.held():
            self.files.delete(self.path)


class IndexWriter:
    """Documents of one type into a versioned table.

    rebuild: a new version holds what this run wrote, and the old one stays if
    it fails. In place: the run's documents replace those of their ids, then
    what finished sources no longer have and departed sources goes.
    """

    def __init__(self, spark: SparkSession, path: str, in_place: bool = False):
        self.spark, self.in_place, self.table, self.lock = spark, in_place, VersionedTable(spark, path), IndexLock(spark, path)

    def open(self, sources: list[str]) -> None:
        self.lock.acquire()
        self.run, self.sources, self.parts, self.finished, self.written = uuid.uuid4().hex, sources, {}, [], 0

    def write(self, source: str, documents: DataFrame) -> None:
        """Documents of a source; of one id in several writes the later one holds, of one write the least row."""
        staged = f"{self.table.path}/_run-{self.run}/{self.written}"
        documents.withColumns({"source": F.lit(source), "last_seen": F.lit(self.run), "__seq": F.lit(self.written)}).write.parquet(staged)
        self.parts.setdefault(source, []).append(staged)
        self.written += 1

    def flush(self, source: str, ok: bool) -> None:
        if ok:
            self.finished.append(source)
        elif not self.in_place:
            self.reset(source)

    def reset(self, source: str) -> None:
        for staged in self.parts.pop(source, []):
            self.table.files.delete(staged)

    def _new(self) -> DataFrame:
        paths = [p for parts in self.parts.values() for p in parts]
        rows = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        plain = [c for c, kind in rows.dtypes if c != "__seq" and not kind.startswith("map")]
        # the later write first, then the row's own text, so that the same row wins in every run
        order = F.struct("__seq", F.xxhash64(*plain))
        rest = [c for c in rows.columns if c != "id"]
        return rows.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("id", "r.*").drop("__seq")

    def commit(self) -> None:
        try:
            if not self.lock.held():
                raise RuntimeError("another run has taken the index over")
            old = self.table.read()
            if self.parts:
                new = self._new()
            elif old is None:
                return
            else:
                new = old.limit(0)
            if self.in_place and old is not None:
                named = lambda xs: self.spark.createDataFrame([(x,) for x in xs], "source string")
                new = sweep(upsert(old, new), named(self.sources), named(self.finished), self.run)
            self.table.write(new)
        finally:
            self.abort()

    def abort(self) -> None:
        self.table.files.delete(f"{self.table.path}/_run-{self.run}")
        self.lock.release()

    def abandon(self) -> None:
        pass


class SchemaIndexWriter:
    """A writer of documents of several types, one lane a type.

    components: types that joins connect, each set with what is referred to first; lanes open in that
    order. Each component commits on its own, what refers before what it refers to, and stops at its
    first failure; the other components still commit, then the failures are raised together. Lanes that
    did not commit are aborted and keep what they had.
    """

    def __init__(self, components: list[list[str]], lanes: dict[str, IndexWriter]):
        named = {name for component in components for name in component}
        self.components = [[lanes[n] for n in component if n in lanes] for component in components] + [[lane] for n, lane in lanes.items() if n not in named]
        self.lanes = [lane for component in self.components for lane in component]
        self.by_type, self.live = lanes, []

    def open(self, sources: list[str]) -> None:
        self.live = []
        Tee(self.lanes).open(sources)

    def write(self, source: str, documents: dict[str, DataFrame]) -> None:
        for name, rows in documents.items():
            self.by_type[name].write(source, rows)

    def flush(self, source: str, ok: bool) -> None:
        for lane in self.lanes:
            lane.flush(source, ok)

    def reset(self, source: str) -> None:
        for lane in self.lanes:
            lane.reset(source)

    def commit(self) -> None:
        failures: list[Exception] = []
        for component in self.components:
            try:
                for lane in reversed(component):
                    lane.commit()
                    self.live.append(lane)
            except Exception as e:
                failures.append(e)
        if failures:
            self.abort()
            raise ExceptionGroup("some types were not committed", failures)

    def abort(self) -> None:
        for lane in self.lanes:
            if lane not in self.live:
                lane.abort()

    def abandon(self) -> None:
        pass
