"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations that are learned (iterative
quantisation) on a bounded sample. A code is split into ``tables`` substrings of
``bits`` bits, and each of them is an index: entries (substring, value, id). A
query probes every value within ``radius`` bits of its own in every substring.
By the pigeonhole principle that retrieves each code within Hamming radius
``tables * (radius + 1) - 1`` of the whole, and farther ones the likelier the
nearer they are. What is retrieved is checked by the first ``CHECK_BITS`` bits
of the code, then ranked by the distance of the original vectors in double
precision. A query that finds fewer than k candidates is compared with all rows.

``plan`` chooses bits, radius and tables by the sample: of all settings whose
recall, for sampled queries among sampled rows, reaches ``target``, the one
of the least work for so many rows and queries. Of the sample only as many nearest
rows count as stand for k of all rows, one at least. Where neighbours are
near, few probes of few tables are enough; where they are hardly nearer than
any other row, as among random vectors, the plan says so by the share of rows
that it expects to retrieve (``Plan.share``).

Where a query is expected to retrieve ``CANDIDATES`` rows at most, the index is
one table: entries travel packed, by substring and the leading bits of its
value; a part that many rows share is split further by a hash of the id, and
queries go to the parts that hold values they probe. What is shuffled grows
with rows, queries and what is retrieved. Where a query retrieves more, as no
code tells its neighbours from the rest, pairs would be most of all rows times
queries: then rows are dealt to blocks of ``BLOCK_NUMBERS`` components, each
with all substrings' entries of its own, every block is probed by every query,
and only its k nearest leave it. Both ways find the same. Rows of one
vector are one entry: no query can have more than the k + 1 least of their ids
among its nearest.

Only the rotations, the plan and the radius of the check come from the sample,
of ``SAMPLE`` rows at most (those of the least hash of their ids) and
``SAMPLE_NUMBERS`` components, and of ``SAMPLE_QUERIES`` queries; every row is indexed.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component take no part, nor do rows without an id. Vectors of
different lengths have no distance, so each length is searched on its own. Rows
that repeat an id are candidates each; a query that repeats is asked once, with
the least vector. Ties go to the smaller id. Fewer candidates than k: all of
them. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadloom.llm.workspace import mapped, materialize

SAMPLE, SAMPLE_NUMBERS, SAMPLE_QUERIES = 16384, 1 << 23, 512
TARGET = 0.93
#: Bits of the code that retrieved rows are checked by, and the share of the sample's neighbours that must pass.
CHECK_BITS, CHECK_SHARE = 256, 0.995
#: Settings that a plan chooses from.
TABLE_BITS, RADII, MOST_TABLES = range(8, 21, 2), range(4), 512
#: The work of an entry, a probe and a candidate, in the plan's terms.
ENTRY_COST, PROBE_COST, CANDIDATE_COST = 1.0, 0.3, 60.0
#: Entries of one part of an index, vectors whose entries are packed at once, and probes that are looked up at once.
PART_ROWS, PACKED_ROWS, PROBES = 1 << 21, 4096, 1 << 20
#: Rows that a query may be expected to retrieve from one table of entries; components of a block, its least rows, and queries at once.
CANDIDATES, BLOCK_NUMBERS, LEAST_BLOCK_ROWS, BLOCK_QUERIES = 500, 1 << 24, 1024, 512
#: Queries whose vectors are sent to every executor: up to so many components.
BROADCAST_NUMBERS = 1 << 22
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Plan(NamedTuple):
    """How codes are made and searched."""

    mean: np.ndarray
    turn: np.ndarray  # a column for each bit
    bits: int  # of a substring
    radius: int
    tables: int
    check: int  # the radius of CHECK_BITS bits
    share: float  # of rows that a query is expected to retrieve
    recall: float  # of the sample's neighbours

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.mean) @ self.turn > 0

    def values(self, signs: np.ndarray) -> np.ndarray:
        """A column for each substring's values."""
        parts = signs[:, : self.tables * self.bits].reshape(-1, self.bits).astype(np.float32)
        return (parts @ (2.0 ** np.arange(self.bits)).astype(np.float32)).astype(np.uint32).reshape(len(signs), self.tables)

    def checked(self, signs: np.ndarray) -> np.ndarray:
        return np.packbits(signs[:, :CHECK_BITS], axis=1).view(np.int64)


def masks(bits: int, radius: int) -> np.ndarray:
    """All values with at most ``radius`` of ``bits`` bits set."""
    values = np.arange(1 << bits, dtype=np.uint32)
    return values[_POPCOUNT[values.view(np.uint8).reshape(-1, 4)].sum(1) <= radius]


def _rotations(sample: np.ndarray, bits: int) -> np.ndarray:
    """As many random rotations as bits need, each turned so that signs lose least; many are turned less often than few."""
    n, d = sample.shape
    few, turns = sample[:2048], []
    rounds = max(1, min(64, int(2e10 / d**3)) // -(-bits // d))
    for start in range(-(-bits // d)):
        turn = np.linalg.qr(np.random.default_rng(start).normal(size=(d, d)))[0]
        for _ in range(rounds if n > d else 0):
            u, _, v = np.linalg.svd(np.where(few @ turn > 0, 1.0, -1.0).T @ few)
            turn = (u @ v).T
        turns.append(turn)
    return np.hstack(turns)[:, :bits]


def _within(bits: int, radius: int, apart: np.ndarray) -> np.ndarray:
    """The chance that so many bits differ in at most ``radius``, by the share of all bits that differ."""
    return sum(math.comb(bits, i) * apart**i * (1 - apart) ** (bits - i) for i in range(radius + 1))


def plan(sample: np.ndarray, asked: np.ndarray, own: np.ndarray, k: int, n_rows: int, n_queries: int, target: float = TARGET, at_once: int | None = None) -> Plan:
    """A plan by sampled rows and queries; own (query, row): which of them are one id; at_once: the rows of one index, by default all."""
    n, d = sample.shape
    mean = sample.mean(0)
    all_rows = Plan(mean, _rotations(sample - mean, CHECK_BITS), 8, 8, 1, CHECK_BITS, 1.0, 1.0)
    if n < 2 or not len(asked):
        return all_rows
    signs = np.where(all_rows.signs(sample), 1.0, -1.0).astype(np.float32)
    ask_signs = np.where(all_rows.signs(asked), 1.0, -1.0).astype(np.float32)
    apart = np.rint((CHECK_BITS - ask_signs @ signs.T) / 2).astype(int)
    far = (asked**2).sum(1)[:, None] + (sample**2).sum(1)[None, :] - 2 * asked @ sample.T
    far[own] = np.inf
    # as many of the sample as stand for k of all rows
    near = np.argsort(far, axis=1)[:, : max(1, min(n - 1, math.ceil(k * n / max(n, n_rows))))]
    found = np.take_along_axis(apart, near, 1).ravel()
    check = int(np.quantile(found, CHECK_SHARE, method="higher"))
    neighbour = found / CHECK_BITS
    other, weight = np.unique(apart, return_counts=True)
    other, weight = other / CHECK_BITS, weight / weight.sum()
    held = at_once or n_rows
    best, chosen = CANDIDATE_COST * held * n_queries, None
    for bits in TABLE_BITS:
        for radius in RADII:
            hit, stray, probes = _within(bits, radius, neighbour), _within(bits, radius, other), len(masks(bits, radius))
            recall = lambda m, hit=hit: float((1 - (1 - hit) ** m).mean())
            if recall(MOST_TABLES) < target:
                continue
            m = 1 + bisect.bisect_left(range(1, MOST_TABLES), True, key=lambda m: recall(m) >= target)
            share = float(((1 - (1 - stray) ** m) * weight).sum())
            work = ENTRY_COST * m * (held + (1 << bits)) + PROBE_COST * m * probes * n_queries + CANDIDATE_COST * share * held * n_queries
            if work < best:
                best, chosen = work, (bits, radius, m, share)
    if chosen is None:
        return all_rows._replace(check=check)
    bits, radius, m, share = chosen
    while True:  # bits are not independent, as the model has it: the codes themselves tell how many tables reach the target
        p = Plan(mean, _rotations(sample - mean, max(CHECK_BITS, m * bits)), bits, radius, m, check, share, 0.0)
        a, b = (p.values(p.signs(x)) for x in (asked, sample[near.ravel()]))
        differ = (np.repeat(a, near.shape[1], axis=0) ^ b).view(np.uint8)
        met = _POPCOUNT[differ].reshape(len(b), m, 4).sum(2) <= radius
        recall = np.logical_or.accumulate(met, axis=1).mean(0)
        if recall[-1] >= target:
            m = int(np.argmax(recall >= target)) + 1
            return p._replace(tables=m, recall=float(recall[m - 1]), turn=p.turn[:, : max(CHECK_BITS, m * bits)])
        if m == MOST_TABLES:
            return all_rows._replace(check=check)
        m = min(MOST_TABLES, m + m // 2 + 1)


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part; vector is an array of doubles."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _coded(rows: DataFrame, p: Plan) -> DataFrame:
    """rows (id, copies, vector) with the checked bits of their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                code = p.checked(p.signs(_matrix(batch.column(2))))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(code.ravel()), code.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "copies", "vector", "code"])

    return mapped(rows, run, "id long, copies long, vector array<double>, code array<long>")


def _hashed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _packed(rows: DataFrame, p: Plan, lead: int, split: dict[tuple[int, int], int], asks: bool) -> DataFrame:
    """Entries of rows (id, vector) by (table, part, piece); of queries, those of every part and piece that they probe."""
    visits = masks(lead, min(p.radius, lead)) if asks else np.zeros(1, np.uint32)
    shift = np.uint32(p.bits - lead)

    def pack(ids: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
        for t in range(p.tables):
            part = (values[:, t] >> shift) if lead else np.zeros(len(ids), np.uint32)
            for visit in visits:
                of = part ^ visit
                order = np.argsort(of, kind="stable")
                ranked = of[order]
                cuts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
                for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    held, at = order[lo:hi], int(ranked[lo])
                    pieces = split.get((t, at), 1)
                    piece = _hashed(ids[held]) % np.uint64(pieces)
                    for i in range(pieces):
                        some = held if asks or pieces == 1 else held[piece == i]
                        if len(some):
                            yield t, at, i, int(asks), ids[some].tobytes(), values[some, t].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), PACKED_ROWS):
                some = batch.slice(lo, PACKED_ROWS)
                ids = some.column(0).to_numpy()
                out = list(pack(ids, p.values(p.signs(_matrix(some.column(1))))))
                kinds = [pa.int32()] * 4 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["tab", "part", "piece", "asks", "ids", "vals"])

    return mapped(rows.select("id", "vector"), run, "tab int, part int, piece int, asks int, ids binary, vals binary")


def _crowded(rows: DataFrame, p: Plan, lead: int) -> dict[tuple[int, int], int]:
    """Into how many pieces parts of far more entries than planned are split: a few of them at most, as each holds many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p.tables, 1 << lead), np.int64)
        for batch in batches:
            if len(batch):
                part = p.values(p.signs(_matrix(batch.column(1)))) >> np.uint32(p.bits - lead)
                for t in range(p.tables):
                    total[t] += np.bincount(part[:, t], minlength=1 << lead)
        t, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(at, pa.int32()), pa.array(total[t, at])], ["tab", "part", "n"])

    counts = mapped(rows.select("id", "vector"), run, "tab int, part int, n long").groupBy("tab", "part").agg(F.sum("n").alias("n"))
    return {(r.tab, r.part): -(-r.n // PART_ROWS) for r in counts.where(F.col("n") > 2 * PART_ROWS).collect()}


class SubstringIndex:
    """Entries of one part of a substring's index, by value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, bits: int, radius: int):
        order = np.argsort(values, kind="stable")
        self.ids, self.starts = ids[order], np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount(values, minlength=1 << bits), out=self.starts[1:])
        self.masks = masks(bits, radius)

    def probe(self, ids: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of all values within the radius, some at a time."""
        for at in range(0, len(ids), step := max(1, PROBES // len(self.masks))):
            probed = values[at : at + step, None] ^ self.masks[None, :]
            lo, hi = self.starts[probed].ravel(), self.starts[probed + 1].ravel()
            held = np.flatnonzero(hi > lo)
            n = (hi - lo)[held]
            ends = np.cumsum(n)
            # in runs of bounded length, however many rows share a value
            for first in range(0, int(ends[-1]) if len(ends) else 0, PROBES):
                spots = np.arange(first, min(first + PROBES, int(ends[-1])))
                run = np.searchsorted(ends, spots, side="right")
                rows = self.ids[lo[held[run]] + spots - (ends[run] - n[run])]
                yield ids[at + held[run] // len(self.masks)], rows


def _retrieved(rows: DataFrame, asked: DataFrame, p: Plan, n_rows: int, parts: int) -> DataFrame:
    """(query_id, id) of all that probing finds, once for each table that finds it."""
    lead = min(p.bits, max(0, math.ceil(math.log2(max(1, n_rows / PART_ROWS)))))
    split = _crowded(rows, p, lead) if n_rows > 2 * PART_ROWS else {}
    both = _packed(rows, p, lead, split, False).unionByName(_packed(asked, p, lead, split, True))
    # a part's rows come before the queries that probe it
    dealt = both.repartition(max(parts, min(p.tables << lead, 16 * parts)), "tab", "part", "piece").sortWithinPartitions("tab", "part", "piece", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, values, built = None, [], [], None
        for batch in batches:
            where, asks, own, held = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)), batch.column(3).to_pylist(), batch.column(4), batch.column(5)
            for i, key in enumerate(where):
                if key != at:
                    at, ids, values, built = key, [], [], None
                own_ids, own_values = np.frombuffer(own[i].as_buffer(), np.int64), np.frombuffer(held[i].as_buffer(), np.uint32)
                if not asks[i]:
                    ids.append(own_ids)
                    values.append(own_values)
                elif ids:
                    built = built or SubstringIndex(np.concatenate(ids), np.concatenate(values), p.bits, p.radius)
                    for q, r in built.probe(own_ids, own_values):
                        other = q != r
                        yield pa.RecordBatch.from_arrays([pa.array(q[other]), pa.array(r[other])], ["query_id", "id"])

    return mapped(dealt, run, "query_id long, id long")


def differing_bits(a: Column, b: Column) -> Column:
    """The number of bits in which two codes differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def _ranked(pairs: DataFrame, rows: DataFrame, asked: DataFrame, n_numbers: int, check: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest rows of each query among its pairs; those beyond the check go first."""
    # one exchange by id serves distinct pairs and the join
    pairs = pairs.repartition("id").dropDuplicates(["id", "query_id"])
    held = pairs.join(rows, "id")
    ask = asked.select(F.col("id").alias("query_id"), F.col("vector").alias("q"), F.col("code").alias("qc"))
    held = held.join(F.broadcast(ask) if n_numbers <= BROADCAST_NUMBERS else ask, "query_id")
    held = held.where(differing_bits(F.col("code"), F.col("qc")) <= check)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                far = np.sqrt(((_matrix(batch.column(3)) - _matrix(batch.column(4))) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(far)], ["query_id", "vec_id", "copies", "score"])

    scored = mapped(held.select("query_id", F.col("id").alias("vec_id"), "copies", "vector", "q"), run, "query_id long, vec_id long, copies long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    near = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    # rows that repeat an id and a vector are candidates each
    each = near.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))).alias("copy"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Block:
    """Rows of a block; their entries are sorted for one substring after the other."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, p: Plan):
        self.ids, self.copies, self.vectors, self.plan = ids, copies, vectors, p
        signs = p.signs(vectors)
        self.code, self.values = p.checked(signs), p.values(signs)

    def retrieved(self, values: np.ndarray) -> np.ndarray:
        """(query, row): what probing every substring finds, as flags."""
        p, hit = self.plan, np.zeros((len(values), len(self.ids)), bool)
        rows = np.arange(len(self.ids))
        for t in range(p.tables):
            index = SubstringIndex(rows, self.values[:, t], p.bits, p.radius)
            for q, r in index.probe(np.arange(len(values)), values[:, t]):
                hit[q, r] = True
        return hit

    def nearest(self, asked: np.ndarray, vectors: np.ndarray, k: int, everything: bool) -> Iterator[tuple[int, int, float]]:
        """(query, id, distance): the k nearest of what each query retrieves, within the check of whole codes."""
        p = self.plan
        signs = p.signs(vectors)
        hit = np.ones((len(asked), len(self.ids)), bool) if everything else self.retrieved(p.values(signs))
        hit &= asked[:, None] != self.ids[None, :]
        code = p.checked(signs)
        for i, query in enumerate(asked):
            rows = np.flatnonzero(hit[i])
            if not everything:
                rows = rows[_POPCOUNT[(self.code[rows] ^ code[i]).view(np.uint8)].reshape(len(rows), -1).sum(1, dtype=np.int64) <= p.check]
            far = np.sqrt(((self.vectors[rows] - vectors[i]) ** 2).sum(1))
            rows = rows[best := np.lexsort((self.ids[rows], far))[:k]]
            each = np.repeat(np.arange(len(rows)), np.minimum(self.copies[rows], k))[:k]
            yield from zip([int(query)] * len(each), self.ids[rows[each]].tolist(), far[best][each].tolist(), strict=True)


def _blocks(n_rows: int, d: int, parts: int) -> int:
    return max(1, -(-n_rows * d // BLOCK_NUMBERS), min(parts, -(-n_rows // LEAST_BLOCK_ROWS)))


def _in_blocks(rows: DataFrame, asked: DataFrame, p: Plan, n_blocks: int, parts: int, k: int, everything: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of what it retrieves, or of all rows."""
    lead = rows.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "copies", "vector")
    probes = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("asks"), "id", "copies", "vector")
    dealt = lead.unionByName(probes).repartition(max(parts, n_blocks), "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, built = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            block, asks, ids, copies = (batch.column(i).to_numpy() for i in range(4))
            vectors, out = _matrix(batch.column(4)), []
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])])
            for lo, hi in zip(cuts, [*cuts[1:], len(block)], strict=True):
                if int(block[lo]) != at:
                    at, held, built = int(block[lo]), [], None
                if not asks[lo]:
                    held.append((ids[lo:hi].copy(), copies[lo:hi].copy(), vectors[lo:hi].copy()))
                elif held or built:
                    if built is None:
                        built, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True)), p), []
                    for i in range(lo, hi, BLOCK_QUERIES):
                        out.extend(built.nearest(ids[i : min(i + BLOCK_QUERIES, hi)], vectors[i : min(i + BLOCK_QUERIES, hi)], k, everything))
            q, v, x = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(x, pa.float64())], ["query_id", "vec_id", "score"])

    near = mapped(dealt, run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _least_ids(table: DataFrame, k: int) -> DataFrame:
    """(id, copies, vector): of rows of one vector the k + 1 least ids, with the number of rows of each."""
    rows = table.groupBy("vector", "id").agg(F.count("*").alias("copies"))
    number = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    return rows.withColumn("number", number).where(F.col("number") <= k + 1).select("id", "copies", "vector")


def search(table: DataFrame, queries: DataFrame, k: int = 10, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of queries (id, vector) its k nearest rows of table (id, vector)."""
    spark, schema = table.sparkSession, "query_id long, rank int, vec_id long, score double"
    table = materialize(table.select("id", "vector"), "vectors")
    asked = materialize(queries.groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    sizes = [r.d for r in asked.select(F.size("vector").alias("d")).distinct().collect()]  # lengths of vectors: a few
    found = [_of_length(table.where(F.size("vector") == d), asked.where(F.size("vector") == d), d, k, target) for d in sorted(sizes)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _drawn(rows: DataFrame, most: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most so many rows, those of the least hash of their ids."""
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "vector").toArrow().combine_chunks()
    return drawn.column(0).to_numpy(), _matrix(drawn.column(1).combine_chunks()) if len(drawn) else np.zeros((0, d))


def _of_length(table: DataFrame, asked: DataFrame, d: int, k: int, target: float) -> DataFrame:
    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(_least_ids(table, k), "rows")
    n_rows, n_asked = rows.count(), asked.count()
    most = max(2, min(SAMPLE, SAMPLE_NUMBERS // d))
    (ids, sample), (ask_ids, ask) = _drawn(rows, most, d), _drawn(asked, min(most, SAMPLE_QUERIES), d)
    seen = (sample if n_rows else np.zeros((1, d)), ask, np.nonzero(ask_ids[:, None] == ids[None, :]), k, n_rows, n_asked, target)
    p, n_blocks = plan(*seen), _blocks(n_rows, d, parts)
    whole = p.share * n_rows <= CANDIDATES
    if not whole:
        p = plan(*seen, at_once=-(-n_rows // n_blocks))
    rows = materialize(_coded(rows, p), "coded")
    asked = materialize(_coded(asked.select("id", F.lit(1).cast("long").alias("copies"), "vector"), p), "asked")
    if whole:
        near = _ranked(_retrieved(rows, asked, p, n_rows, parts), rows, asked, n_asked * d, p.check, k)
    else:
        near = _in_blocks(rows, asked, p, n_blocks, parts, k, everything=p.share == 1)
    near = materialize(near, "near")
    if p.share < 1:  # a query that found too few is compared with all rows
        held = near.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
        least = min(k, table.select("id").distinct().limit(k + 1).count() - 1)
        lacking = materialize(asked.join(held, "id", "left").where(F.coalesce("n", F.lit(0)) < least).select("id", "copies", "vector"), "lacking")
        if not lacking.isEmpty():
            more = _in_blocks(rows, lacking, p, n_blocks, parts, k, everything=True)
            near = near.join(lacking.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    return near.select("query_id", "rank", "vec_id", "score")
