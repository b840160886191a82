"""SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece of a model holds a white-space marker after another character,
no merge can cross the start of a marked word: encoding splits exactly at
those places. So each distinct marked word is segmented once, kept in a table,
and a text's ids are the table's ids joined by position. A model for which
this does not hold, or that rewrites its input, is refused.

The table lives in a Python worker and serves all its batches, which are dealt
with in slices of ``SLICE_BYTES``. It is emptied after a slice that leaves it
with more than ``TABLE_WORDS`` words, so its memory is bounded by these two
and the longest text; results do not depend on either.

Defined results: null text is empty; empty text has only the end id, if one is
asked for; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quadloom.llm.workspace import mapped

MARK = "▁"
TABLE_WORDS = 300_000
SLICE_BYTES = 4 << 20

_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")
_loaded: dict[str, PieceTable] = {}


class PieceTable:
    """A model and the ids of the marked words met so far."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        raw = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            raw.ParseFromString(f.read())
        spec = raw.normalizer_spec
        crossing = any(MARK in p.piece.lstrip(MARK) for p in raw.pieces)
        if crossing or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or raw.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model's pieces can cross white-space markers, or it rewrites its input")
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.end = np.array([self.model.eos_id()], np.int32).tobytes()
        self.lone_mark = np.array([self.model.piece_to_id(MARK)], np.int32).tobytes()
        self.marked = np.array([p.piece.startswith(MARK) for p in raw.pieces])
        self.table: dict[str, bytes] = {}

    def _segment(self, chunks: list[str]) -> None:
        """Put the ids of chunks into the table.

        Those with one marker go through the model side by side in one text: their ids part where a
        marked piece starts. The model puts a text's first marker back itself.
        """
        single = [c for c in chunks if len(c) > 1 and c[1] != MARK]
        for lo in range(0, len(single), 4096):
            some = single[lo : lo + 4096]
            ids = np.array(self.model.encode("".join(some)[1:], num_threads=1), np.int32)
            raw, cuts = ids.tobytes(), [*(4 * np.flatnonzero(self.marked[ids])).tolist(), 4 * len(ids)]
            self.table.update(zip(some, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        for c in chunks:
            if len(c) == 1:
                self.table[c] = self.lone_mark
            elif c[1] == MARK:
                self.table[c] = np.array(self.model.encode(c[1:], num_threads=1), np.int32).tobytes()

    def encode(self, texts: list[str], end: bool) -> list[bytes]:
        """The ids of each text as the bytes of 32-bit integers."""
        chunked = [_CHUNKS.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        table = self.table
        self._segment([c for c in set().union(*chunked) if c not in table])
        tail = self.end if end else b""
        out = [b"".join([table[c] for c in chunks]) + tail for chunks in chunked]
        if len(table) > TABLE_WORDS:
            table.clear()
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids)


def piece_table(model_path: str) -> PieceTable:
    """The worker's table for a model."""
    if model_path not in _loaded:
        _loaded[model_path] = PieceTable(model_path)
    return _loaded[model_path]


def _id_lists(encoded: list[bytes]) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(encoded), np.int32)
    offsets = np.r_[0, np.cumsum([len(x) // 4 for x in encoded])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), flat, offsets


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, so that ids and texts of few rows are held at once."""
    sizes = np.array([len(x) if x is not None else 0 for x in batch.column(column).cast(pa.binary()).to_pylist()], np.int64)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
        yield batch.slice(int(lo), int(hi - lo))


def encode(docs: DataFrame, model_path: str | Callable[[], str], end: bool = True, decoded: bool = False) -> DataFrame:
    """docs with ``ids`` (array<int>) and, if asked, ``decoded``: the model's decode of those ids.

    model_path: a path that every executor has, or a function that names it there.
    """
    added = ["ids", "decoded"] if decoded else ["ids"]
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    fields = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())][: len(added)]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_path if isinstance(model_path, str) else model_path())
        for batch in batches:
            for part in slices(batch, at):
                encoded = table.encode([x or "" for x in part.column(at).to_pylist()], end)
                lists, flat, offsets = _id_lists(encoded)
                columns = [*part.columns, lists]
                if decoded:
                    columns.append(pa.array([table.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return mapped(rows, run, StructType([*rows.schema.fields, *fields]))


def decode(rows: DataFrame, model_path: str | Callable[[], str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids decode to null."""
    names = [c for c in rows.columns if c != out]
    kept = rows.select(*names)
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_path if isinstance(model_path, str) else model_path())
        for batch in batches:
            texts = [None if x is None else table.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return mapped(kept, run, StructType([*kept.schema.fields, StructField(out, StringType())]))
