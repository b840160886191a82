"""MinHash near-dedup: weighted signatures by hashed darts, joined by bands.

A document is the multiset of its five-word shingles; words are lower-cased
(A-Z) runs of anything but ASCII white space. Two documents are linked if the
weighted Jaccard similarity of their shingle counts is 0.8 or more; classes
are the connected components of links, named by their least doc_id.

1. ``sketches``: for each document a hash of its words and the band keys of
   its DartMinHash signature. Documents of the same words are one text, whose
   node is the least doc_id of them.
2. Stars: in each bucket (band and key) every text is checked against the
   bucket's least one, each such pair once. Components of what holds.
3. The rest: a bucket that still holds texts of several components, beyond the
   pairs checked, is compared in blocks: the texts of two blocks at a time,
   all similarities by one product of incidence matrices. Only links between
   different components come back, one for each text and block at most.
   Buckets of the same members are compared once. In a bucket of more than
   ``LARGE`` texts only those meet that share one of their rarest shingles: two
   sets of similarity s share one of the first (1 - s) n + 1 of their n shingles
   in any order that both have, here by how many of the bucket hold a shingle.
   So texts that share a template, but not 0.8 of their shingles, rarely meet.
4. Components of all links, and of texts that one doc_id has.

No pair that shares a bucket is left unchecked unless its texts are in one
component already, so classes are those of all such pairs. A large group of
near copies costs one check a text where its members resemble its least one.
A pair of similarity 0.8 shares a bucket with probability 0.998, one of 0.85
with 0.99996.

Defined results: null and empty texts are copies of each other; a text of
fewer than five words is one shingle; rows that repeat a doc_id share a class;
a null doc_id has a null class; very long texts are hashed a slice of a batch at
a time; other columns of the table are ignored, or kept by ``drop_near_dups``.
A bucket's hot key, the least text of many and the centre of a large component
are joined in as many tasks as their rows need (``spread_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadloom.llm import workspace
from quadloom.llm.components import components
from quadloom.llm.darts import band_keys, sketch, strip_hash
from quadloom.llm.pieces import slices
from quadloom.llm.workspace import mapped, materialize, spread_join

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 7
#: Texts and shingles that a block is planned for, and columns of an incidence matrix.
BLOCK_TEXTS, BLOCK_SHINGLES, COLUMNS = 256, 1 << 19, 4096
#: Texts of a bucket beyond which only those that share a rare shingle are compared.
LARGE = 2048

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_strips(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of texts in UTF-8: owner and hash of each shingle's occurrences, sorted, and a hash of each text's words."""
    known: dict[bytes, int] = {}
    counts, keys, numbers = [], [], []
    for text in texts:
        words = text.lower().split()
        keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
        counts.append(len(words))
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    n = np.array(counts, np.int64)
    flat = hashed[np.concatenate(numbers)] if numbers else np.zeros(0, np.uint64)
    start = np.cumsum(n) - n
    windows = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), windows)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + start[owner]
    value = np.zeros(len(owner), np.uint64)
    for i in range(WORDS):
        inside = first + i < (start + n)[owner]
        value = value * _GOLD + np.where(inside, flat[np.minimum(first + i, max(0, len(flat) - 1))] if len(flat) else 0, np.uint64(i))
        value ^= value >> np.uint64(29)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
    run = np.flatnonzero(fresh)
    number = np.arange(len(value)) - np.repeat(run, np.diff(np.r_[run, len(value)]))
    return owner, strip_hash(value, number), keys


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, c1, c2, bands, n): a hash of the words, band keys (empty without words) and the number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 1)):
            texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
            owner, strip, keys = shingle_strips(texts)
            found = band_keys(sketch(len(texts), owner, strip, None, BANDS * ROWS), BANDS)
            n = np.bincount(owner, minlength=len(texts))
            offsets = np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))].astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[n > 0].ravel()))
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1]), bands, pa.array(n.astype(np.int64))], ["doc_id", "c1", "c2", "bands", "n"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, c1 long, c2 long, bands array<long>, n long")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles): the sorted 64-bit hashes of the shingles of the documents that nodes (node) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 1)):
            texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
            owner, strip, _ = shingle_strips(texts)
            strip = strip[np.lexsort((strip, owner))]
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            blobs = [strip[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], ["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # dealt by doc_id at every size, so that each text of a doc_id is left once without another exchange
    rows = rows.join(nodes.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return mapped(rows, run, "node long, shingles binary")


def _resembling(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets reach the similarity."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    # numbers alone rule out pairs before their sets are looked at
    held = pairs.where(F.least("n", "m") >= SIMILARITY * F.greatest("n", "m")).select("u", "v").distinct()
    hot = held.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > workspace.HOT_ROWS)  # the least text of many
    held = spread_join(held.join(a, "u"), b, "v", hot).select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same >= SIMILARITY * (len(both) - same) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return mapped(held, run, "u long, v long")


def _links(nodes: np.ndarray, comps: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different components, of texts of two blocks (side 0 and 1) or of one (all 0): a forest of them."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    fresh = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(sets)),) * 2
    same = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + COLUMNS + 1, COLUMNS))
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[lo:hi], column[lo:hi] - i * COLUMNS] = 1
        same += held[left] @ held[right].T
    total = sizes[left][:, None] + sizes[right][None, :] - same
    x, y = np.nonzero((same >= SIMILARITY * total - 1e-4) & (comps[left][:, None] != comps[right][None, :]))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    out = []
    for i, j in zip(left[x], right[y], strict=True):
        a, b = root(int(comps[i])), root(int(comps[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _in_blocks(rest: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Links (u, v) between components among the members of buckets: (key, node, component, blocks)."""
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = rest.withColumn("block", block)
    # a text of block b meets each block: in the pair (min, max), on the side of its own
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "component")
    dealt = dealt.join(sets, "node").select("key", "i", "j", "side", "node", "component", "shingles")
    dealt = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for key, i, j, side, node, comp, blob in zip(*columns, strict=True):
                if (key, i, j) != at:
                    out.extend(_linked(held))
                    at, held = (key, i, j), []
                held.append((node, comp, side, blob))
            if len(out) > 4096:
                yield _pairs(out)
                out = []
        yield _pairs([*out, *_linked(held)])

    def _linked(held: list) -> list[tuple[int, int]]:
        if len({x[1] for x in held}) < 2:
            return []
        nodes, comps, sides, blobs = zip(*held, strict=True)
        return _links(np.array(nodes), np.array(comps), np.array(sides), [np.frombuffer(x, np.uint64) for x in blobs])

    def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return mapped(dealt, run, "u long, v long")


def _by_rare_shingles(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Of large buckets (key, node, component) smaller ones: the texts that have one shingle among their rarest.

    Two texts of the similarity are in one of them: the order of shingles, by holders in the bucket, is the same for both.
    """

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column(3).to_pylist()], np.int64)
            flat = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
            at = np.repeat(np.arange(len(sizes)), sizes)
            for lo in range(0, len(flat), 1 << 16):
                some = pa.array(at[lo : lo + (1 << 16)])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(some) for i in range(3)), pa.array(sizes[at[lo : lo + (1 << 16)]]), pa.array(flat[lo : lo + (1 << 16)])], ["key", "node", "component", "n", "shingle"])

    held = mapped(rest.select("key", "node", "component").join(sets, "node").select("key", "node", "component", "shingles"), apart, "key long, node long, component long, n long, shingle long")
    held = materialize(held, "shingles")
    holders = held.groupBy("key", "shingle").agg(F.count("*").alias("holders"))
    hot = holders.where(F.col("holders") > workspace.HOT_ROWS).select(F.xxhash64("key", "shingle").alias("pair"), F.col("holders").alias("n"))
    held = spread_join(held.withColumn("pair", F.xxhash64("key", "shingle")), holders.select(F.xxhash64("key", "shingle").alias("pair"), "holders"), "pair", hot)
    first = F.row_number().over(W.partitionBy("key", "node").orderBy("holders", "pair"))
    # 1e-9: as many as the similarity needs, whatever the rounding
    rare = held.withColumn("first", first).where((F.col("first") <= F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1) & (F.col("holders") > 1))
    return materialize(rare.select(F.col("pair").alias("key"), "node", "n", "component"), "rare")


def _compared(named: DataFrame) -> DataFrame:
    """Of buckets (key, node, n, component) those of several components, one of each set of members: (key, size, shingles)."""
    mixed = named.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.sum("n").alias("shingles"), F.count("*").alias("size"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("held"), F.max("node").alias("last"),
    ).where("a < b")
    return mixed.groupBy("held", "size", "last").agg(F.min("key").alias("key"), F.first("shingles").alias("shingles")).select("key", "size", "shingles")


def _members(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, node, component, blocks) of the buckets wanted (key, size, shingles)."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    hot = wanted.where(F.col("size") > workspace.HOT_ROWS).select("key", F.col("size").alias("n"))
    return spread_join(named, wanted.select("key", blocks.alias("blocks")), "key", hot).select("key", "node", "component", "blocks")


def near_dup_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = materialize(sketches(docs), "sketches")
    texts = drawn.groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = materialize(texts, "texts")
    members = texts.select("node", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("size")).where("size > 1")
    buckets = materialize(buckets, "buckets")
    hot = buckets.where(F.col("size") > workspace.HOT_ROWS).select("key", F.col("size").alias("n"))
    shared = materialize(spread_join(members, buckets, "key", hot).select("key", "node", "n", "size", F.col("first.node").alias("least"), F.col("first.n").alias("m")), "shared")
    sets = materialize(shingle_sets(docs, shared.select("node").distinct()), "sets")
    stars = shared.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"), "n", "m").distinct()
    links = _resembling(stars, sets).unionByName(_of_one_document(drawn, texts))
    links = materialize(links, "links")
    first = materialize(components(links), "components")

    named = shared.where("node <> least").join(first.select("node", "component"), "node", "left")
    named = named.select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named")
    mixed = materialize(_compared(named), "mixed")
    rest = _members(named, mixed.where(F.col("size") <= LARGE))
    large = mixed.where(F.col("size") > LARGE)
    if not large.isEmpty():
        rare = _by_rare_shingles(_members(named, large), sets)
        rest = rest.unionByName(_members(rare, _compared(rare)))
    rest = materialize(rest, "rest")
    if not rest.isEmpty():
        more = materialize(_in_blocks(rest, sets, parts), "links")
        first = materialize(components(links.unionByName(more)), "components")
    classes = texts.select("c1", "c2", "node").join(first, "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("class_id"))
    found = drawn.select("doc_id", "c1", "c2").join(classes, ["c1", "c2"]).select("doc_id", "class_id")
    lost = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return found.unionByName(lost)


def _of_one_document(drawn: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between the nodes of the texts that one doc_id has: rows that repeat a doc_id share a class."""
    several = drawn.groupBy("doc_id").agg(F.min(F.struct("c1", "c2")).alias("a"), F.max(F.struct("c1", "c2")).alias("b"), F.count("*").alias("n")).where("a <> b")
    several = materialize(several.select("doc_id", "n"), "repeated")
    held = spread_join(drawn.select("doc_id", "c1", "c2"), several.select("doc_id"), "doc_id", several.where(F.col("n") > workspace.HOT_ROWS))
    nodes = held.distinct().join(texts.select("c1", "c2", "node"), ["c1", "c2"]).select("doc_id", "node").distinct()
    least = nodes.groupBy("doc_id").agg(F.min("node").alias("v"), F.count("*").alias("n"))
    linked = spread_join(nodes, least.select("doc_id", "v"), "doc_id", least.where(F.col("n") > workspace.HOT_ROWS).select("doc_id", "n"))
    return linked.where("node <> v").select(F.col("node").alias("u"), "v")


def drop_near_dups(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one whose doc_id names it. A null doc_id stays.

    Of rows that repeat a doc_id the one of the least columns stays.
    """
    classes = near_dup_classes(docs.select("doc_id", "text"))
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("__kept")).distinct()
    held = docs.join(kept, F.col("doc_id") == F.col("__kept")).drop("__kept")
    plain = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    rank = F.struct(*plain)
    first = held.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), rank).alias("__row")).select("__row.*")
    return first.unionByName(docs.where("doc_id is null"))
