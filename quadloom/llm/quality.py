"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Words are runs of anything but ASCII white space. For each n-gram length a
polynomial hash rolls over the word ids of a text in numpy; windows whose hash
is found twice or more are compared word by word before they count, so a hash
collision never changes a result. Coverage counts each character once, however
many repeated windows lie over it. Limits depend on a text's length: what is
chance in a short text, a pair of words or a line said twice, is a small share
of a long one.

Defined results: null text has no words and is rejected, as empty text is;
repeated rows are judged one by one; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadloom.llm.workspace import mapped

MIN_WORDS = 10
BASE_WINDOW = 5
BASE_REPEAT_PERCENT = 20
#: The largest share of word characters that repeated n-grams may cover, by n: (of long texts, of short ones).
#: The first kind asks for the most frequent n-gram alone, the second for all that repeat. The former are the
#: published limits, which lie well below the base rule's; ``limit`` says what lies between.
TOP_NGRAM_SHARE = {2: (0.20, 0.30), 3: (0.18, 0.27), 4: (0.16, 0.24)}
DUP_NGRAM_SHARE = {5: (0.15, 0.25), 6: (0.14, 0.24), 7: (0.13, 0.23), 8: (0.12, 0.22), 9: (0.11, 0.21), 10: (0.10, 0.20)}
#: Words that a clean text of any length repeats: one line of ten words, say at its head and its foot.
LINE_WORDS = 20
#: The largest share of lines, and of their characters: (if two lines or more repeat, if one does).
DUP_LINE_SHARE = (0.30, 0.50)
DUP_LINE_CHAR_SHARE = (0.20, 0.40)

_ROLL = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_STARTS = np.ones(256, bool)
_STARTS[0x80:0xC0] = False

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, top_share double, dup_share double, dup_line_share double, dup_line_char_share double, kept boolean"


def repeated_windows(ids: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Which windows of n ids are found twice or more, and a start of the most frequent (-1: none repeats)."""
    count = len(ids) - n + 1
    if count < 2:
        return np.zeros(max(count, 0), bool), -1
    windows = np.lib.stride_tricks.sliding_window_view(ids, n)
    rolled = np.zeros(count, np.uint64)
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    spread ^= spread >> np.uint64(32)
    for i in range(n):
        rolled = rolled * _ROLL + spread[i : i + count]
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return np.zeros(count, bool), -1
    if not (windows[order[1:][same]] == windows[order[:-1][same]]).all():  # a collision: rank the windows exactly
        _, group = np.unique(windows, axis=0, return_inverse=True)
        group = group.ravel()
        order = np.argsort(group, kind="stable")
        same = group[order][1:] == group[order][:-1]
    found = np.zeros(count, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    start = np.flatnonzero(np.r_[True, ~same])
    size = np.diff(np.r_[start, count])
    best = start[size == size.max()]
    return found, int(order[best].min())


def covered(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words lie in a window of n that starts at one of the marked places."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def limit(shares: tuple[float, float], by_chance: int, n_words: int) -> float:
    """The share that so many words repeated by chance make of the text, within the limits of long and short texts."""
    return min(shares[1], max(shares[0], by_chance / n_words))


def measure(text: bytes) -> tuple:
    """The METRICS of a text in UTF-8."""
    words = text.split()
    n_words = len(words)
    raw = np.frombuffer(text, np.uint8)
    word_chars = int((_STARTS[raw] & ~_SPACE[raw]).sum())
    n_symbols = int(_SYMBOL[raw].sum())
    seen: set[bytes] = set()
    n_lines = n_dup = dup_chars = line_chars = 0
    for line in text.split(b"\n"):
        if not line or line.isspace():
            continue
        n_lines += 1
        line_chars += len(line)
        if line in seen:
            n_dup += 1
            dup_chars += len(line)
        seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n_words)
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    total = max(1, int(lengths.sum()))
    n_repeat, top_over, dup_over, top_share, dup_share = 0, False, False, 0.0, 0.0
    for n in sorted({BASE_WINDOW, *TOP_NGRAM_SHARE, *DUP_NGRAM_SHARE}):
        found, best = repeated_windows(ids, n)
        if best < 0:
            break  # longer windows do not repeat either
        inside = covered(found, n, n_words)
        if n == BASE_WINDOW:
            n_repeat = int(inside.sum())
        if n in TOP_NGRAM_SHARE:
            windows = np.lib.stride_tricks.sliding_window_view(ids, n)
            share = float(lengths[covered((windows == ids[best : best + n]).all(1), n, n_words)].sum() / total)
            top_share, top_over = max(top_share, share), top_over or share > limit(TOP_NGRAM_SHARE[n], 2 * n, n_words)
        if n in DUP_NGRAM_SHARE:
            share = float(lengths[inside].sum() / total)
            dup_share, dup_over = max(dup_share, share), dup_over or share > limit(DUP_NGRAM_SHARE[n], LINE_WORDS, n_words)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > BASE_REPEAT_PERCENT * n_words
    line_share, line_char_share = n_dup / max(1, n_lines), dup_chars / max(1, line_chars)
    kept = not (base_failed or top_over or dup_over or line_share > DUP_LINE_SHARE[n_dup < 2] or line_char_share > DUP_LINE_CHAR_SHARE[n_dup < 2])
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, top_share, dup_share, line_share, line_char_share, kept


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs with METRICS added; columns of those names are replaced."""
    added = [x.split()[0] for x in METRICS.split(", ")]
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    schema = StructType(list(rows.schema.fields))
    for x in METRICS.split(", "):
        schema = schema.add(*x.split())
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        for batch in batches:
            found = [measure(x or b"") for x in batch.column(at).cast(pa.binary()).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in added]
            arrays = [pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, METRICS.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*names, *added])

    return mapped(rows, run, schema)
