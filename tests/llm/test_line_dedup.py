import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.llm import line_dedup as L
from quadloom.llm.cuckoo import CuckooFilter, ShardFilter

from . import brute

COMMON = "This very common line is long enough to be judged"
WIDE = "é" * 39 + " x"


def rows():
    out = [(i, f"{COMMON}\nown line {i} that is unique and long enough to count\nshort\n  {COMMON.upper()}\t") for i in range(12)]
    out += [(20 + i, f"{WIDE}\n\n{'é' * 39}\n{'é' * 39}") for i in range(6)]
    out += [(40, None), (41, ""), (42, "\n\n"), (43, COMMON + "\n" + "word " * 50_000), (43, COMMON), (44, COMMON + "\r"), (None, COMMON)]
    out += [(50 + i, "Four documents hold this line, which is not enough") for i in range(4)]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string").withColumns({"k1": F.lit("own"), "refs": F.lit(7), "shard": F.lit(None).cast("int")})


def test_equals_brute_force(spark):
    out = L.dedup_lines(frame(spark, rows())).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2], x[3])
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out), key=key) == sorted(brute.line_dedup(rows()), key=key)
    assert {r.k1 for r in out} == {"own"} and {r.refs for r in out} == {7}


def test_empty_table(spark):
    assert L.dedup_lines(frame(spark, [])).collect() == []


def state(index):
    return sorted((r.k1, r.k2, r.refs, r.keeper) for r in index.refs.collect())


def check_filters(index):
    """Each key in its shard's filter, common ones in that of common keys, and nothing else in either."""
    held = {r.shard: (ShardFilter.from_bytes(r.known), ShardFilter.from_bytes(r.common)) for r in index.filters.collect()}
    keys = index.refs.collect()
    for r in keys:
        known, common = held[r.k2 % index.n_shards]
        assert known.contains(np.array([r.k1])).all() and (r.refs < index.min_docs or common.contains(np.array([r.k1])).all())
    assert sum(known.used for known, _ in held.values()) == len(keys) == index.n_keys
    assert sum(common.used for _, common in held.values()) == sum(r.refs >= index.min_docs for r in keys)


def test_delete_takes_back_an_insert(spark):
    first, second = frame(spark, rows()[:10]), frame(spark, rows()[8:])
    one = L.LineIndex.empty(spark, n_shards=3).insert(first)
    two = one.insert(second)
    assert state(two) == state(L.LineIndex.empty(spark, n_shards=3).insert(frame(spark, rows())))
    assert state(two.insert(second)) == state(two)
    gone = two.delete(second.select("doc_id").subtract(first.select("doc_id")))
    assert state(gone) == state(one)
    check_filters(gone)
    assert state(gone.insert(second)) == state(two)


def test_unknown_deletes_change_nothing(spark):
    one = L.LineIndex.empty(spark).insert(frame(spark, rows()))
    assert state(one.delete(spark.createDataFrame([(999,), (None,)], "doc_id long"))) == state(one)


def test_many_changes(spark, monkeypatch):
    """Logs are merged and shards split on the way; what holds is as if only the documents left had ever come."""
    monkeypatch.setattr(L, "LEVELS", 3)
    monkeypatch.setattr(L, "SHARD_KEYS", 8)
    text = lambda i: "\n".join([f"line {i} of its own, which is long enough to be a key", COMMON, f"line {i % 5} that some documents share, long enough"])
    docs = lambda ids: spark.createDataFrame([(i, text(i)) for i in ids], "doc_id long, text string")
    index = L.LineIndex.empty(spark).insert(docs(range(3)))
    for step in range(1, 4):
        index = index.insert(docs(range(step * 6 - 3, step * 12))).delete(docs(range(step * 2, step * 9)).select("doc_id"))
    left = sorted(r.doc_id for r in index.postings.select("doc_id").distinct().collect())
    assert state(index) == state(L.LineIndex.empty(spark).insert(docs(left)))
    assert index.n_shards > 4 and len(index.counted) <= 4
    check_filters(index)
    got = sorted((r.doc_id, r.text) for r in index.apply(docs(left)).collect())
    assert got == sorted((d, t) for d, _, _, t in brute.line_dedup([(i, text(i)) for i in left]))


def test_hot_shards_are_probed_in_copies(spark, monkeypatch):
    monkeypatch.setattr(L, "COPY_ROWS", 3)
    data = [(i, f"{COMMON}\n{COMMON} too {i % 7}") for i in range(60)]
    got = sorted((r.doc_id, r.text) for r in L.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == sorted((d, t) for d, _, _, t in brute.line_dedup(data))


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_filter_holds_what_it_was_given(n):
    hashes = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
    held = ShardFilter(planned=n // 2 + 1)
    for part in np.array_split(hashes, 4):
        held.insert(part)
    again = ShardFilter.from_bytes(held.to_bytes())
    assert again.contains(hashes).all()
    again.delete(hashes[: n // 2])
    assert again.contains(hashes[n // 2 :]).all()
    assert again.used == n - n // 2


def test_deletes_hide_no_other_key():
    hashes = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 200_000)
    held = ShardFilter(planned=120_000)  # the rest is listed
    for part in np.array_split(hashes, 40):
        held.insert(part)
    for part in np.array_split(hashes[::2], 10):
        held.delete(part)
    assert held.contains(hashes[1::2]).all() and held.used == 100_000
    held.insert(hashes[::2])
    assert held.contains(hashes).all() and held.used == 200_000


def test_a_full_filter_is_left_as_it_was():
    small, hashes = CuckooFilter(1), np.arange(100) * 7919
    left = small.insert(hashes)
    held = np.setdiff1d(hashes, left)
    assert len(left) and small.contains(held).all() and small.used == len(held)
