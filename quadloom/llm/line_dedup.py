"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of ASCII white space at both ends, with A-Z
lower-cased, hashed to 128 bits. A key of at least ``min_chars`` code points
that ``min_docs`` documents hold is common: its lines go, except in the
largest doc_id that holds it.

``LineIndex`` holds logs of parquet files, to which every change adds a part,
and a table that changes rewrite:

* ``inserted`` (doc_id, k1, k2, seq) and ``removed`` (doc_id, seq): the postings,
  which document holds which key, are what was inserted and not removed later;
* ``counted`` (k1, k2, refs, keeper, seq): exact reference counts. A change adds
  one row for each key that it touches: by how much its number of holders
  changes, and the largest holder from then on;
* ``filters`` (shard, known, common): two cuckoo filters of each shard, of all
  its keys and of its common ones.

Inserts go through the ``known`` filters: a key that its shard's filter does
not hold is new and needs no look at the counts; only the others are joined
with them. A key whose count falls to zero leaves its filter, one whose count
falls below ``min_docs`` leaves the ``common`` filter, so a delete takes back
exactly what the insert did. Inserting a document twice changes nothing. Logs
are merged after ``LEVELS`` changes. When keys outgrow the filters, more and
larger ones are made from the exact counts, with room for as many keys again.

Lines are judged through the ``common`` filters; what passes is joined with
the exact counts. A shard whose common keys have many holders is probed by as
many tasks as that takes, each with its own copy of the filter and the counts.

Defined results: null or empty text is one empty line; rows that repeat a
doc_id are one document whose lines are judged alike; a null doc_id is no
document, so its lines are never counted nor dropped; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quadloom.llm.cuckoo import ShardFilter
from quadloom.llm.workspace import mapped, materialize

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys that a shard is planned for at most, and at least if that gives every partition a shard.
SHARD_KEYS, LEAST_SHARD_KEYS = 1 << 18, 1 << 12
#: Holders of common keys that one copy of a shard is probed for, and shards that may have several copies:
#: beyond it copies get larger, so that the table of shards with copies can be sent everywhere.
COPY_ROWS, COPIED_SHARDS = 1 << 20, 100_000
#: Changes after which the logs are merged.
LEVELS = 8

_POSTINGS = "doc_id long, k1 long, k2 long, seq int"
_REMOVED = "doc_id long, seq int"
_COUNTED = "k1 long, k2 long, refs long, keeper long, seq int"
_FILTERS = "shard int, known binary, common binary"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key; None if the key is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def line_pairs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k1, k2), one row for each document and long key, repeated only where a doc_id is."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, counts = batch.column(0), [], []
            for text in _texts(batch.column(1)):
                found = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                keys.extend(found)
                counts.append(len(found))
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            docs_of = np.repeat(ids.to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([pa.array(docs_of, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "k1", "k2"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, pairs, "doc_id long, k1 long, k2 long")


def _shard(n_shards: int):
    return F.pmod(F.col("k2"), F.lit(n_shards)).cast("int")


def _dealt(keys: DataFrame, filters: DataFrame, parts: int) -> DataFrame:
    """Rows of filters (shard, copy, blobs) and keys (shard, copy, longs) by shard and copy, each filter before its keys."""
    names, blobs = ([c for c in df.columns if c not in ("shard", "copy")] for df in (keys, filters))
    lead = filters.select("shard", "copy", *(F.lit(None).cast("long").alias(c) for c in names), *blobs)
    both = lead.unionByName(keys.select("shard", "copy", *names, *(F.lit(None).cast("binary").alias(c) for c in blobs)))
    return both.repartition(parts, "shard", "copy").sortWithinPartitions("shard", "copy", F.col(blobs[0]).isNull())


def _shards(batches: Iterator[pa.RecordBatch], blob: str) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """Of dealt rows: (shard and copy, whether it is a filter's row, rows)."""
    for batch in batches:
        shard, copy = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("shard", "copy"))
        has_blob = batch.column(batch.schema.get_field_index(blob)).is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1]) | has_blob[:-1]]) if len(shard) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(shard)], strict=True):
            yield (int(shard[lo]), int(copy[lo])), bool(has_blob[lo]), batch.slice(int(lo), int(hi - lo))


def _longs(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy()


def _tested(keys: DataFrame, filters: DataFrame, parts: int) -> DataFrame:
    """keys (shard, copy, k1, ...longs) with ``known``: whether the blob of filters (shard, copy, blob) holds k1."""
    names = [c for c in keys.columns if c != "copy"]
    schema = "shard int, " + ", ".join(f"{c} long" for c in names[1:]) + ", known boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ShardFilter()
        for where, is_filter, rows in _shards(batches, "blob"):
            if where != at:
                at, held = where, ShardFilter()
            if is_filter:
                held = ShardFilter.from_bytes(rows.column(rows.schema.get_field_index("blob"))[0].as_py())
            else:
                known = pa.array(held.contains(_longs(rows, "k1")))
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), known], [*names, "known"])

    return mapped(_dealt(keys, filters, parts), run, schema)


def _updated(changed: DataFrame, filters: DataFrame, min_docs: int, planned: int, parts: int) -> DataFrame:
    """The filters after changes (shard, k1, before, after) of counts; new ones are made for ``planned`` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, common = None, None, None
        for where, is_filter, rows in _shards(batches, "known"):
            if where != at:
                if at is not None:
                    yield _row(at[0], known, common)
                at, known, common = where, ShardFilter(planned), ShardFilter(max(1, planned // min_docs))
            if is_filter:
                known, common = (ShardFilter.from_bytes(rows.column(rows.schema.get_field_index(c))[0].as_py()) for c in ("known", "common"))
                continue
            k1, before, after = (_longs(rows, c) for c in ("k1", "before", "after"))
            known.delete(k1[(before > 0) & (after == 0)])
            common.delete(k1[(before >= min_docs) & (after < min_docs)])
            known.insert(k1[(before == 0) & (after > 0)])
            common.insert(k1[(before < min_docs) & (after >= min_docs)])
        if at is not None:
            yield _row(at[0], known, common)

    def _row(shard: int, known: ShardFilter, common: ShardFilter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([f.to_bytes()], pa.binary()) for f in (known, common))], ["shard", "known", "common"])

    return materialize(mapped(_dealt(changed, filters, parts), run, _FILTERS), "filters")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class LineIndex:
    """A reversible index of long lines; every change gives a new one and leaves this as it is."""

    def __init__(self, spark: SparkSession, min_chars: int, min_docs: int, n_shards: int, planned: int):
        self.spark, self.min_chars, self.min_docs, self.n_shards, self.planned = spark, min_chars, min_docs, n_shards, planned
        self.inserted: list[DataFrame] = []
        self.removed: list[DataFrame] = []
        self.counted: list[DataFrame] = []
        self.filters = spark.createDataFrame([], _FILTERS)
        self.n_keys = self.seq = 0

    @classmethod
    def empty(cls, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_shards: int = 1) -> LineIndex:
        """n_shards: the least number of shards."""
        return cls(spark, min_chars, min_docs, n_shards, 0)

    def _next(self) -> LineIndex:
        out = LineIndex(self.spark, self.min_chars, self.min_docs, self.n_shards, self.planned)
        out.inserted, out.removed, out.counted, out.filters = [*self.inserted], [*self.removed], [*self.counted], self.filters
        out.n_keys, out.seq = self.n_keys, self.seq + 1
        return out

    @property
    def postings(self) -> DataFrame:
        """(doc_id, k1, k2, seq): which document holds which key now."""
        if not self.inserted:
            return self.spark.createDataFrame([], _POSTINGS)
        rows = _union(self.inserted)
        if not self.removed:
            return rows
        gone = _union(self.removed).groupBy("doc_id").agg(F.max("seq").alias("gone"))
        return rows.join(gone, "doc_id", "left").where("gone is null or seq > gone").drop("gone")

    @property
    def refs(self) -> DataFrame:
        """(k1, k2, refs, keeper): the number of documents that hold a key now, and the largest of them."""
        if not self.counted:
            return self.spark.createDataFrame([], _COUNTED).drop("seq")
        rows = _union(self.counted)
        if len(self.counted) > 1:
            rows = rows.groupBy("k1", "k2").agg(F.sum("refs").alias("refs"), F.max_by("keeper", "seq").alias("keeper"))
        return rows.select("k1", "k2", "refs", "keeper").where("refs > 0")

    def insert(self, docs: DataFrame) -> LineIndex:
        out, first = self._next(), not self.counted
        new = line_pairs(docs, self.min_chars).dropDuplicates(["k1", "k2", "doc_id"])
        if not first:
            new = new.join(self.postings, ["k1", "k2", "doc_id"], "left_anti")
        new = materialize(new.select("doc_id", "k1", "k2", F.lit(out.seq).alias("seq")), "postings")
        out.inserted.append(new)
        delta = new.groupBy("k1", "k2").agg(F.count("*").alias("more"), F.max("doc_id").alias("later"))
        if first:  # every key is new
            changed = delta.select("k1", "k2", F.lit(0).cast("long").alias("before"), F.col("more").alias("after"), F.col("later").alias("keeper"))
        else:
            keys = materialize(delta, "delta").select(_shard(self.n_shards).alias("shard"), F.lit(0).alias("copy"), "k1", "k2", "more", "later")
            filters = self.filters.select("shard", F.lit(0).alias("copy"), F.col("known").alias("blob"))
            tested = materialize(_tested(keys, filters, max(_parts(self.spark), self.n_shards)), "tested")
            # a key that the filter held by chance alone has no count
            met = tested.where("known").join(self.refs, ["k1", "k2"], "left").withColumn("before", F.coalesce("refs", F.lit(0)))
            met = met.select("k1", "k2", "before", (F.col("before") + F.col("more")).alias("after"), F.greatest("keeper", "later").alias("keeper"))
            fresh = tested.where("not known").select("k1", "k2", F.lit(0).cast("long").alias("before"), F.col("more").alias("after"), F.col("later").alias("keeper"))
            changed = met.unionByName(fresh)
        return out._changed(changed)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents out; doc_ids has a column doc_id, unknown ones count for nothing."""
        out = self._next()
        ids = materialize(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("seq", F.lit(out.seq)), "removed")
        out.removed.append(ids)
        gone = self.postings.join(ids.select("doc_id"), "doc_id", "left_semi")
        touched = materialize(gone.groupBy("k1", "k2").agg(F.count("*").alias("less"), F.max("doc_id").alias("last")), "touched")
        # the largest holder by key, summed up before the join: no key is too frequent for it
        later = out.postings.groupBy("k1", "k2").agg(F.max("doc_id").alias("next"))
        held = self.refs.join(touched, ["k1", "k2"]).join(later, ["k1", "k2"], "left")
        return out._changed(held.select("k1", "k2", F.col("refs").alias("before"), (F.col("refs") - F.col("less")).alias("after"), F.coalesce("next", "keeper").alias("keeper")))

    def _changed(self, changed: DataFrame) -> LineIndex:
        """Log a change (k1, k2, before, after, keeper) of counts and bring the filters up to date."""
        changed = materialize(changed, "changed")
        self.counted.append(changed.select("k1", "k2", (F.col("after") - F.col("before")).alias("refs"), "keeper", F.lit(self.seq).alias("seq")))
        came, went = changed.agg(F.count_if(F.expr("before = 0 and after > 0")), F.count_if(F.expr("before > 0 and after = 0"))).first()
        self.n_keys += came - went
        if len(self.counted) > LEVELS:
            self._merge()
        parts, filters, rows = _parts(self.spark), self.filters, changed
        if self.n_keys > self.n_shards * self.planned:  # larger filters, from the exact counts
            room = 2 * self.n_keys
            self.n_shards = max(self.n_shards, -(-room // SHARD_KEYS), min(parts, -(-room // LEAST_SHARD_KEYS)))
            self.planned = -(-room // self.n_shards)
            filters, rows = self.filters.limit(0), self.refs.select("k1", "k2", F.lit(0).cast("long").alias("before"), F.col("refs").alias("after"))
        zero = F.lit(0).alias("copy")
        rows = rows.select(_shard(self.n_shards).alias("shard"), zero, "k1", "before", "after")
        self.filters = _updated(rows, filters.select("shard", zero, "known", "common"), self.min_docs, self.planned, max(parts, self.n_shards))
        return self

    def _merge(self) -> None:
        """One part for each log, of what holds now."""
        self.counted = [materialize(self.refs.withColumn("seq", F.lit(self.seq)), "counted")]
        self.inserted, self.removed = [materialize(self.postings, "postings")], []

    def common(self) -> DataFrame:
        return self.refs.where(F.col("refs") >= self.min_docs)

    def doomed(self, pairs: DataFrame) -> DataFrame:
        """(doc_id, k1, k2) of the pairs whose lines go: through the filters of common keys, then by the exact counts."""
        common = self.common() if len(self.counted) < 2 else materialize(self.common(), "common")
        shard, parts = _shard(self.n_shards).alias("shard"), max(_parts(self.spark), self.n_shards)
        loads = materialize(common.groupBy(shard).agg(F.sum("refs").alias("rows")), "loads")
        most = max(COPY_ROWS, -(-(loads.agg(F.sum("rows")).first()[0] or 0) // COPIED_SHARDS))
        # fewer than COPIED_SHARDS rows: each stands for more than most holders
        copies = F.broadcast(loads.where(F.col("rows") > most).select("shard", F.ceil(F.col("rows") / most).cast("int").alias("copies")))

        def copied(df: DataFrame) -> DataFrame:
            return df.join(copies, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")

        filters = copied(self.filters.select("shard", F.col("common").alias("blob")))
        keys = pairs.select(shard, "k1", "k2", "doc_id").join(copies, "shard", "left")
        copy = F.pmod(F.xxhash64("doc_id"), F.coalesce("copies", F.lit(1)).cast("long")).cast("int")
        keys = keys.select("shard", copy.alias("copy"), "k1", "k2", "doc_id")
        passed = _tested(keys, filters, parts).where("known").join(copies, "shard", "left").select("k1", "k2", "doc_id", copy.alias("copy"))
        exact = copied(common.select(shard, "k1", "k2", "keeper")).drop("shard")
        return passed.join(exact, ["k1", "k2", "copy"]).where("doc_id <> keeper").select("doc_id", "k1", "k2")

    def apply(self, docs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """docs without their doomed lines, with n_lines and n_dropped added (or replaced)."""
        pairs = line_pairs(docs, self.min_chars).distinct() if pairs is None else pairs
        doomed = self.doomed(pairs).groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("__doomed"))
        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "__doomed")]
        held = docs.select(*names).join(doomed.withColumnRenamed("doc_id", "__doc"), F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
        return _drop_lines(held, names, self.min_chars)


def _drop_lines(held: DataFrame, names: list[str], min_chars: int) -> DataFrame:
    schema = StructType([*held.select(*names).schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lines_in, dropped = [], [], []
            keys = batch.column(len(names)).to_pylist()
            for text, doomed in zip(_texts(batch.column(at)), keys, strict=True):
                lines = text.split(b"\n")
                lines_in.append(len(lines))
                if doomed:
                    gone = {np.array([x["k1"], x["k2"]], np.int64).tobytes() for x in doomed}
                    lines = [x for x in lines if line_key(x, min_chars) not in gone]
                dropped.append(lines_in[-1] - len(lines))
                out.append(b"\n".join(lines) if doomed else text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines_in, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return mapped(held, run, schema)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Index docs from nothing and drop their common lines: docs with new text, n_lines and n_dropped."""
    index = LineIndex.empty(docs.sparkSession, min_chars, min_docs).insert(docs)
    return index.apply(docs, index.postings)
