"""Streams of changes: upserts into a versioned table, newest observations, adaptive timeouts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.sinks import VersionedTable, last_wins, upsert


class ChangeLog:
    """A table kept as a version and a log of batches after it: a batch writes its own rows alone.

    Reading takes the newest row of each key. After ``merge_after`` batches the log becomes a new version;
    a batch that is in both changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", order: str = "seq", merge_after: int = 16):
        self.spark, self.path, self.key, self.order, self.merge_after = spark, path.rstrip("/"), key, order, merge_after
        self.base = VersionedTable(spark, f"{self.path}/merged")

    def batches(self) -> list[str]:
        return self.base.files.names(f"{self.path}/log")

    def read(self) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/log/{b}") for b in self.batches()]
        held = self.base.read()
        if held is not None:
            parts.append(held)
        return last_wins(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), self.key, self.order) if parts else None

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add a batch under its number; one that is run again replaces itself."""
        last_wins(rows, self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/log/{batch:012d}")
        if len(done := self.batches()) >= self.merge_after:
            self.base.write(self.read())
            for b in done:
                self.base.files.delete(f"{self.path}/log/{b}")


def upsert_stream(stream: DataFrame, table: VersionedTable | ChangeLog, checkpoint: str, key: str = "id", order: str = "seq"):
    """A query that puts each batch's newest rows in place of a table's; a batch that is run again changes nothing.

    A ChangeLog only grows by each batch; a VersionedTable is written anew by each, so that it reads as a plain table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if isinstance(table, ChangeLog):
            table.append(batch, number)
            return
        new = last_wins(batch, key, order)
        old = table.read()
        if old is not None:  # an older row never replaces a newer one
            newer = old.select(F.col(key).alias("__k"), F.col(order).alias("__o"))
            new = new.join(newer, F.col(key) == F.col("__k"), "left").where(F.col("__o").isNull() | (F.col(order) >= F.col("__o"))).drop("__k", "__o")
            new = upsert(old, new, key)
        table.write(new)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_only(stream: DataFrame, state: DataFrame, key: str = "dataset", mark: str = "fingerprint") -> DataFrame:
    """Rows of a stream whose mark is not the one that a state table holds; without a mark they always pass."""
    held = state.select(F.col(key).alias("__k"), F.col(mark).alias("__m"))
    joined = stream.join(held, (F.col(key) == F.col("__k")) & (F.col(mark) == F.col("__m")), "left")
    return joined.where("__k is null").drop("__k", "__m")


def latest_stream(observations: DataFrame, key: str = "monitor", at: str = "observed_at") -> DataFrame:
    rest = [c for c in observations.columns if c != key]
    return observations.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, "r.*")


class TimeoutState:
    """A time limit for an endpoint: after some timeouts in a row it tightens, on one success it is what it was."""

    def __init__(self, normal: float = 300.0, tight: float = 30.0, after: int = 3):
        self.normal, self.tight, self.after, self.failed = normal, tight, after, 0

    @property
    def limit(self) -> float:
        return self.tight if self.failed >= self.after else self.normal

    def observe(self, outcome: str) -> float:
        """ok resets, timeout counts, error leaves things as they are; the limit for the next request."""
        self.failed = 0 if outcome == "ok" else self.failed + (outcome == "timeout")
        return self.limit


def timeouts(log: DataFrame, normal: float = 300.0, tight: float = 30.0, after: int = 3) -> DataFrame:
    """Of a stream of requests (endpoint, seq, outcome) the limit that follows each."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = TimeoutState(normal, tight, after)
        held.failed = state.get[0] if state.exists else 0
        rows = pd.concat(batches).sort_values("seq")
        limits = [held.observe(x) for x in rows["outcome"]]
        state.update((held.failed,))
        yield pd.DataFrame({"endpoint": key[0], "seq": rows["seq"], "limit_seconds": limits})

    return log.groupBy("endpoint").applyInPandasWithState(step, "endpoint string, seq long, limit_seconds double", "failed int", "append", "NoTimeout")


def timeouts_batch(log: DataFrame, tight_after: int = 3, normal: float = 300.0, tight: float = 30.0) -> DataFrame:
    """The same over a finished log, in window functions: timeouts since an endpoint's last success."""
    from pyspark.sql import Window as W

    order = W.partitionBy("endpoint").orderBy("seq")
    runs = log.withColumn("__run", F.sum((F.col("outcome") == "ok").cast("int")).over(order))
    failed = F.sum((F.col("outcome") == "timeout").cast("int")).over(W.partitionBy("endpoint", "__run").orderBy("seq"))
    limit = F.when((F.col("outcome") != "ok") & (failed >= tight_after), tight).otherwise(normal)
    return runs.select("endpoint", "seq", limit.cast("double").alias("limit_seconds"))
