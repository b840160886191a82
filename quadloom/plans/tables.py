"""Versions of tables on shared storage, and lineage cut there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where none is named and all runs on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("executors elsewhere need a shared folder: set spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="quadloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_steps: list[tuple[SparkSession, str]] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; the folder goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/quadloom/step-{uuid.uuid4().hex}"
    _steps.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Hashes up to which they are sent to every executor.
BROADCAST_HASHES = 1_000_000
#: Bytes of the scanned files whose rows are one part of what is dealt.
DEALT_BYTES = 4_000_000


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with equal keys in one part, before any grouping; as they came if the bytes are not known.

    Where few rows of a split share keys, grouping there holds the split and saves nothing.
    """
    n = _parts(df)
    return df.repartition(n, *keys) if n else df


def suspects(keys: DataFrame) -> DataFrame | None:
    """The rows that may have an equal: those whose hash several rows have, found by the hashes alone; None if there are none.

    Equal rows have equal hashes, so none is lost; rows that only share a hash are few, and the caller tells them apart.
    """
    hashed = keys.select(F.xxhash64(*keys.columns).alias("hash"))
    n = _parts(hashed)
    met = checkpointed((hashed.repartition(n, "hash") if n else hashed).groupBy("hash").count().where("count > 1").select("hash"))
    n_met = met.count()
    if not n_met:
        return None
    return keys.join(F.broadcast(met) if n_met <= BROADCAST_HASHES else met, F.xxhash64(*(keys[c] for c in keys.columns)) == met["hash"], "left_semi")


def _parts(df: DataFrame) -> int | None:
    """Parts by the bytes that df's scans read, at most as many as are written without being held; None if the bytes are not known."""
    if df.isStreaming:
        return None
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n_bytes = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if n_bytes >= 1 << 60:  # rows of no file
        return None
    unheld = int(df.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(1, min(unheld, -(-n_bytes // DEALT_BYTES)))


def _remove_steps() -> None:
    for spark, path in _steps:
        try:
            Files(spark).delete(path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


atexit.register(_remove_steps)


class Files:
    """The few file operations that commits need, on whatever store a path names."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def create(self, path: str, text: str = "") -> bool:
        """Make a file; False if it was there."""
        fs, where = self._at(path)
        try:
            out = fs.create(where, False)
        except Py4JJavaError:
            if fs.exists(where):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, path: str) -> str | None:
        """A small file's text; None if there is none."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return None
        held = fs.open(where)
        try:
            return bytes(held.readAllBytes()).decode()
        finally:
            held.close()

    def age_seconds(self, path: str) -> float:
        import time

        fs, where = self._at(path)
        return time.time() - fs.getFileStatus(where).getModificationTime() / 1000

    def rename(self, old: str, new: str) -> None:
        """One folder in place of another, which is set aside until the new one stands."""
        fs, where = self._at(old)
        target, aside = self._at(new)[1], self._at(f"{new}._old-{uuid.uuid4().hex[:8]}")[1]
        had = fs.exists(target)
        if had and not fs.rename(target, aside):
            raise OSError(f"{new} could not be set aside")
        if not fs.rename(where, target):
            if had:
                fs.rename(aside, target)
            raise OSError(f"{old} could not become {new}")
        if had:
            fs.delete(aside, True)

    def move(self, old: str, new: str) -> bool:
        fs, where = self._at(old)
        return fs.rename(where, self._at(new)[1])

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)
