"""Token counts: rollups that signed deltas keep up to date.

A ledger is a folder. Each batch of events (insert, revise, delete) is
committed once under its own id:

* ``docs/<attempt>/bucket=<b>``: signed rows (doc_id, tokenizer, source, lang,
  n_tokens, n_chars, sign) by a hash of doc_id;
* ``deltas/<attempt>``: their sums by source, lang and tokenizer version;
* ``log/<number>``: a small file that names batch and attempt. It is made last
  and only if no other commit made it first; one that comes second is computed
  anew upon what the first left. What no log entry names does not count.

So replays change nothing, a run that broke off leaves nothing that counts, and
two writers never mix. Totals add up ``deltas`` alone. A delete or revision
subtracts the very counts that the document's own rows in ``docs`` hold,
whatever tokenizer is in use now; to find them, the rows of its buckets are
joined before they are summed up. After ``MERGE_AFTER`` batches a log entry
merges them: rows that cancel out go, and later commits read one part.

Defined results: null text counts nothing but its document; null source and
lang are groups of their own; a null doc_id is no document and is left out; a
null op is an insert, and an insert of a known document revises it; an event of
another op changes nothing. Of events of one batch that repeat a doc_id, the
one of the largest ``seq`` holds (a null one is the least), then of the largest
counts, then of the largest op, source and lang. Deleting an unknown document
changes nothing; empty tables commit an empty batch; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quadloom.llm.pieces import slices
from quadloom.llm.workspace import mapped, materialize

#: Counts the tokens of each text of a list; made once for each worker.
Counter = Callable[[list[str]], "np.ndarray"]

KEYS = ["source", "lang", "tokenizer"]
_DOC = "doc_id long, tokenizer string, source string, lang string, n_tokens long, n_chars long, sign int, bucket int"
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
_SUMS = ("n_docs", "n_tokens", "n_chars")
#: Parts of a batch's rows by doc_id, and batches after which a commit merges them.
BUCKETS, MERGE_AFTER = 16, 16


def piece_counter(model_path: Callable[[], str]) -> Callable[[], Counter]:
    """Tokens of a sentencepiece model, without an end id."""

    def make() -> Counter:
        from quadloom.llm.pieces import piece_table

        table = piece_table(model_path())
        return lambda texts: np.array([len(x) // 4 for x in table.encode(texts, False)], np.int64)

    return make


def rank_counter(rank_path: Callable[[], str], pattern: str) -> Callable[[], Counter]:
    """Tokens of a byte-level BPE given as ranks."""

    def make() -> Counter:
        import base64

        import tiktoken

        with open(rank_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: np.array([len(coder.encode_ordinary(x)) for x in texts], np.int64)

    return make


_made: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizers: dict[str, Callable[[], Counter]], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs and n_tokens_<i> for the i-th tokenizer, n_chars; the text goes no further."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    versions = list(tokenizers)
    added = [*(f"n_tokens_{i}" for i in range(len(versions))), "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in versions:
            if v not in _made:
                _made[v] = tokenizers[v]()
        for part in (part for batch in batches for part in slices(batch, len(keep))):
            texts = [x or "" for x in part.column(len(keep)).to_pylist()]
            counts = [pa.array(_made[v](texts), pa.int64()) for v in versions]
            chars = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *counts, chars], [*keep, *added])

    return mapped(rows, run, StructType([*rows.schema.fields[:-1], *(StructField(c, LongType()) for c in added)]))


def _batches(log: list[dict]) -> list[str]:
    return [b for entry in log for b in (entry["merged"] if "merged" in entry else [entry["batch"]])]


class TokenLedger:
    """The rollup kept in a folder."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, Callable[[], Counter]], buckets: int = BUCKETS):
        """buckets: parts of a batch's rows; a folder keeps the number that it began with."""
        self.spark, self.path, self.tokenizers, self.buckets = spark, path.rstrip("/"), tokenizers, buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _log(self) -> list[dict]:
        """The entries that count: the last merge, if there is one, and what came after it."""
        fs, where = self._fs(f"{self.path}/log")
        names = sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []
        out: list[dict] = []
        for name in reversed(names):
            with_file = fs.open(self._fs(f"{self.path}/log/{name}")[1])
            entry = json.loads(bytes(with_file.readAllBytes()).decode()) | {"number": int(name)}
            with_file.close()
            out.insert(0, entry)
            if "merged" in entry:
                break
        return out

    def _append(self, number: int, entry: dict) -> bool:
        """Make the log's next file; False if another commit made it first."""
        fs, where = self._fs(f"{self.path}/log/{number:012d}")
        try:
            out = fs.create(where, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or fs.exists(where):
                return False
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def committed(self) -> list[str]:
        """The ids of the batches that count."""
        return _batches(self._log())

    def _read(self, kind: str, schema: str, log: list[dict]) -> DataFrame:
        paths = [f"{self.path}/{kind}/{entry['attempt']}" for entry in log]
        rows = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], schema)

    def documents(self, among: DataFrame | None = None, log: list[dict] | None = None) -> DataFrame:
        """What counts now: (doc_id, tokenizer, source, lang, n_tokens, n_chars), of the documents (doc_id) given or of all."""
        rows = self._read("docs", _DOC, self._log() if log is None else log)
        if among is not None:  # few buckets are read for few documents
            rows = rows.join(among.select("doc_id", self._bucket()), ["doc_id", "bucket"], "left_semi")
        keys = ["doc_id", "tokenizer", "source", "lang", "n_tokens", "n_chars"]
        return rows.groupBy(*keys).agg(F.sum("sign").alias("__held")).where("__held > 0").drop("__held")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, signed: DataFrame, attempt: str) -> None:
        rows = signed.withColumn("bucket", self._bucket())
        rows.write.partitionBy("bucket").parquet(f"{self.path}/docs/{attempt}")
        written = self.spark.read.schema(_DOC).parquet(f"{self.path}/docs/{attempt}")
        sums = [F.sum(x).alias(c) for c, x in zip(_SUMS, (F.col("sign").cast("long"), F.col("sign") * F.col("n_tokens"), F.col("sign") * F.col("n_chars")), strict=True)]
        written.groupBy(*KEYS).agg(*sums).write.parquet(f"{self.path}/deltas/{attempt}")

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Apply events (doc_id, text, source, lang; op and seq if given) once; False if it was committed before."""
        if batch_id in self.committed():
            return False
        last = materialize(self._last_events(events), "events")
        while True:
            log = self._log()
            if batch_id in _batches(log):
                return False
            versions = F.array(*(F.struct(F.lit(v).alias("tokenizer"), F.col(f"n_tokens_{i}").alias("n_tokens")) for i, v in enumerate(self.tokenizers)))
            plus = last.where("op <> 'delete'").select("doc_id", "source", "lang", "n_chars", F.explode(versions).alias("v"))
            signed = plus.select("doc_id", "v.tokenizer", "source", "lang", "v.n_tokens", "n_chars", F.lit(1).alias("sign"))
            if log:
                signed = signed.unionByName(self.documents(last, log).withColumn("sign", F.lit(-1)))
            attempt = uuid.uuid4().hex
            self._write(signed, attempt)
            if self._append(log[-1]["number"] + 1 if log else 0, {"batch": batch_id, "attempt": attempt}):
                break
        if len(log) >= MERGE_AFTER:
            self.merge()
        return True

    def _last_events(self, events: DataFrame) -> DataFrame:
        """The event of each document that holds, counted."""
        events = events.withColumns({c: v for c, v in {"op": F.lit("insert"), "seq": F.lit(0).cast("long")}.items() if c not in events.columns})
        op = F.coalesce(F.col("op").cast("string"), F.lit("insert")).alias("op")
        events = events.where("doc_id is not null").select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), op,
            F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text",
        ).where("op in ('insert', 'revise', 'delete')").withColumn("text", F.when(F.col("op") != "delete", F.col("text")))
        counted = count_tokens(events, self.tokenizers, ["doc_id", "seq", "op", "source", "lang"])
        counts = [c for c in counted.columns if c.startswith("n_")]
        return counted.groupBy("doc_id").agg(F.max(F.struct("seq", *counts, "op", "source", "lang")).alias("e")).select("doc_id", "e.*")

    def merge(self) -> None:
        """One part for all batches; rows that cancel out go. If another commit comes first, the next one merges."""
        log = self._log()
        attempt = uuid.uuid4().hex
        self._write(self.documents(log=log).withColumn("sign", F.lit(1)), attempt)
        self._append(log[-1]["number"] + 1 if log else 0, {"merged": _batches(log), "attempt": attempt})

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_chars); groups that came to nothing are gone."""
        deltas = self._read("deltas", _DELTA, self._log())
        return deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in _SUMS)).where("n_docs <> 0")
