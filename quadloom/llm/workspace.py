"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The text that goes to a Python worker at once; the session's own setting holds if it is less.
BATCH_BYTES = 16 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("executors elsewhere need a shared folder: set spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="quadloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quadloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path, writer = new_path(spark, name), df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(*df.columns)


#: Rows of a key beyond which a join deals them, and copies of the other side's row, to several tasks.
HOT_ROWS = 1 << 20


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The inner join of many rows a key with one row (or few) a key; hot (key, n): keys with n > HOT_ROWS rows in ``many``.

    hot holds fewer keys than ``many`` has rows by HOT_ROWS, so it is sent everywhere; rows of such a
    key are dealt by a hash of all their columns to n / HOT_ROWS tasks.
    """
    copies = F.broadcast(hot.select(F.col(key), F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("__copies")))
    plain = [c for c, kind in many.dtypes if not kind.startswith("map")]
    left = many.join(copies, key, "left").withColumn("__copy", F.pmod(F.xxhash64(*plain), F.coalesce("__copies", F.lit(1)).cast("long")).cast("int")).drop("__copies")
    right = one.join(copies, key, "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))).drop("__copies")
    return left.join(right, [key, "__copy"]).drop("__copy")


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df through a function of Arrow batches, in batches of bounded bytes; workers give memory back when a partition ends."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = str(conf.get(name, "64m")).rstrip("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidied, schema)


def give_back() -> None:
    """Free memory that this process holds but does not use goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it keeps
        return


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


atexit.register(_remove_written)
