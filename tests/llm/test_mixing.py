import math

import pytest
from pyspark.sql import functions as F

from quadloom.llm import mixing as M

from . import brute


def rows(sizes):
    out = []
    for s, n in sizes.items():
        out += [(len(out) + i, " ".join(["w"] * (1 + (i * 7) % 23)), s) for i in range(n)]
    return out


SIZES = {"big": 3000, "mid": 300, "small": 40, None: 25}


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({"copies": F.lit("old"), "block": F.lit(1), "total": F.lit(2)})


@pytest.mark.parametrize("block_docs", [1024, 8])
def test_copies_equal_brute_force(spark, monkeypatch, block_docs):
    monkeypatch.setattr(M, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(M, "GROUP_BITS", 3)
    data = [*rows(SIZES), (90000, None, "mid"), (90001, "", "mid"), (90002, "x " * 50_000, "big")]
    out = M.mix(frame(spark, data)).collect()
    assert {r.doc_id: r.copies for r in out} == brute.mix(data)
    assert min(r.copies for r in out) >= 1 and max(r.copies for r in out) > 1
    assert all(r.block == 1 and r.total == 2 for r in out)


def test_weights_reach_the_entropy_or_the_pass_limit(spark):
    data = rows(SIZES)
    sources = M.source_totals(M.token_rows(frame(spark, data)))
    a = M.exponent(sources, 0.9)
    weights = [r.weight for r in M.source_budgets(sources, a).collect()]
    assert math.isclose(sum(weights), 1) and math.isclose(-sum(w * math.log(w) for w in weights), 0.9 * math.log(4), abs_tol=1e-3)
    limited = M.exponent(sources, 0.9, max_passes=3.0)
    passes = [r.passes + r.rest / r.total for r in M.source_budgets(sources, limited).collect()]
    assert limited > a and max(passes) <= 3.01 and min(passes) >= 0.999
    budget = 5000
    kept = M.mix(frame(spark, data), budget=budget).withColumn("t", F.col("copies") * F.col("n_tokens")).agg(F.sum("t")).first()[0]
    assert abs(kept - budget) < 4 * 23


def test_realise_and_odd_tables(spark):
    data = rows({"a": 50, "b": 5})
    mixed = M.mix(frame(spark, data))
    real = M.realise(mixed)
    assert real.count() == sum(r.copies for r in mixed.collect()) and "copies" not in real.columns
    assert M.mix(frame(spark, [])).collect() == []
    assert [r.copies for r in M.mix(frame(spark, [(1, None, "s"), (2, "", None)])).collect()] == [1, 1]
    same = M.mix(frame(spark, [(1, "a b", "s"), (1, "a b", "s"), (2, "c", "s")])).collect()
    assert [r.copies for r in same] == [1, 1, 1]


def test_every_copy_has_a_block(spark, monkeypatch):
    """A source's k-th pass at hash h stands at (k + h) / passes, so each block is a sample of the mix."""
    monkeypatch.setattr(M, "OUTPUT_BLOCK_DOCS", 200)
    data = rows(SIZES)
    mixed = M.mix(frame(spark, data))
    real = M.realise(mixed.drop("block", "total")).groupBy("mix_block", "source").count().collect()
    blocks = sorted({r.mix_block for r in real})
    assert blocks == list(range(len(blocks))) and len(blocks) > 10
    of = {(r.mix_block, r.source): r["count"] for r in real}
    total = {s: sum(n for (_, t), n in of.items() if t == s) for s in SIZES}
    for b in blocks:
        for s in ("big", "mid", "small"):
            assert abs(of.get((b, s), 0) - total[s] / len(blocks)) < 6 * (total[s] / len(blocks)) ** 0.5 + 3
    plan, _, n_blocks = M._plan(M.token_rows(frame(spark, data)), M.ENTROPY_SHARE, None, None)
    every = {r.source: r["__all"] for r in plan.collect()}
    place = {r.doc_id: r.h for r in M.token_rows(frame(spark, data)).collect()}
    for r in mixed.collect():
        assert r.mix_blocks == [min(math.floor((k + place[r.doc_id] / 2.0**M.HASH_BITS) / every[r.source] * n_blocks), n_blocks - 1) for k in range(r.copies)]


def test_rows_alone_equal_the_whole(spark):
    data = [*rows(SIZES), (90000, None, "mid"), (None, "a b", None)]
    key = lambda r: (str(r.doc_id), r.source, r.n_tokens, r.weight, r.copies, tuple(r.mix_blocks))
    assert sorted(map(key, M.mixed_rows(frame(spark, data)).collect()), key=str) == sorted(map(key, M.mix(frame(spark, data)).collect()), key=str)


def test_plan_is_native(spark):
    alone = M.mixed_rows(frame(spark, rows({"a": 9})))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in alone and "Arrow" not in alone
    plan = M.mix(frame(spark, rows({"a": 9})))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
