import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.llm import darts
from quadloom.llm import near_dup as N
from quadloom.llm.components import components

from . import brute


def text(seed, n=120):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(words, edits, seed):
    rng, out = random.Random(seed), list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def rows():
    out = [(i, " ".join(text(i))) for i in range(60)]
    out += [(100 + i, " ".join(edited(text(3), i % 7, i))) for i in range(150)]  # near copies of many degrees
    out += [(300 + i, " ".join(text(5)).upper()) for i in range(40)]
    out += [(400, None), (401, ""), (402, " \n\t"), (403, "one two"), (404, "one  TWO"), (405, "one"), (406, " ".join(text(9) * 30)), (407, " ".join(text(9) * 30 + ["x"]))]
    passage = text(77, 60)
    out += [(500 + i, " ".join(passage + text(1000 + i, 60))) for i in range(50)]  # half shared: no copies
    return out


def test_classes_equal_all_pairs(spark):
    data = rows()
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("node", F.lit("own"))
    got = {r.doc_id: r.class_id for r in N.near_dup_classes(frame).collect()}
    assert got == brute.near_classes(data)


def test_stage_keeps_one_of_each(spark):
    data = [*rows(), (3, " ".join(text(3)))]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumns({"lang": F.lit("en"), "__kept": F.lit(1)}).drop("__kept")
    kept = N.drop_near_dups(frame)
    want = brute.near_classes(rows())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert kept.columns == frame.columns


def test_null_ids_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (None, "x"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id) for r in N.near_dup_classes(frame).collect()), key=str) == [(1, 1), (None, None), (None, None)]
    assert N.drop_near_dups(frame).count() == 3
    assert N.near_dup_classes(frame.limit(0)).collect() == []
    assert N.drop_near_dups(frame.limit(0)).collect() == []


@pytest.mark.parametrize("share", [0.95, 0.8, 0.4])
def test_sketches_agree_by_weighted_similarity(share):
    rng = np.random.default_rng(3)
    h, a = rng.integers(0, 2**63, 300).astype(np.uint64), rng.uniform(0.1, 3, 300)
    b = a * np.where(rng.random(300) < share, 1, rng.uniform(0.05, 2, 300))
    found = [darts.sketch(1, *darts.strips(np.zeros(300, int), h, w), 4096)[0] for w in (a, b)]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((found[0] == found[1]).mean() - want) < 0.04


def test_sketch_is_the_same_alone_and_in_a_batch():
    texts = [b"a", b"", b"a b c d e f g " * 40, b"x y", " ".join(text(1, 3000)).encode()]
    owner, strip, _ = N.shingle_strips(texts)
    all_at_once = darts.sketch(len(texts), owner, strip, None, 182)
    for i, t in enumerate(texts):
        o, s, _ = N.shingle_strips([t])
        assert (darts.sketch(1, o, s, None, 182)[0] == all_at_once[i]).all()
    assert not all_at_once[1].any()


def test_blocks_find_every_component_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**62, 200).astype(np.uint64)
    sets = [np.sort(np.r_[base[:180], rng.integers(0, 2**62, 20).astype(np.uint64)]) for _ in range(6)] + [np.sort(rng.integers(0, 2**62, 50).astype(np.uint64)) for _ in range(3)]
    nodes = np.arange(9)
    links = N._links(nodes, nodes, np.zeros(9, int), sets)
    assert len(links) == 5 and {x for pair in links for x in pair} == set(range(6))
    across = N._links(nodes, nodes, (nodes % 2).astype(int), sets)
    assert all(a % 2 == 0 and b % 2 == 1 for a, b in across) and len(across) == 5


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_rows_that_repeat_a_doc_id_share_a_class(spark):
    a, b, c = (" ".join(text(i)) for i in (1, 2, 3))
    data = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, c), (9, None), (10, None), (11, c)]
    got = {(r.doc_id, r.class_id) for r in N.near_dup_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 8), (10, 8), (11, 8)}


def test_large_buckets_are_compared_by_rare_shingles(spark, monkeypatch):
    """Look-alikes of one template that are no copies, with near copies among them."""
    monkeypatch.setattr(N, "LARGE", 8)
    monkeypatch.setattr(N.workspace, "HOT_ROWS", 16)
    template = text(9, 150)
    data = [(i, " ".join(template + text(100 + i, 48))) for i in range(60)]
    data += [(200 + i, " ".join(edited(template + text(100 + i, 48), 3, i))) for i in range(0, 60, 4)]
    data += [(300 + i, " ".join(edited(text(7, 200), i % 9, i))) for i in range(40)]
    got = {r.doc_id: r.class_id for r in N.near_dup_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute.near_classes(data)


def test_joins_of_hot_keys(spark, monkeypatch):
    from quadloom.llm import workspace

    monkeypatch.setattr(workspace, "HOT_ROWS", 10)
    many = spark.createDataFrame([(i % 3 if i < 30 else 7, i) for i in range(95)], "k long, x long")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c"), (9, "d")], "k long, y string")
    hot = many.groupBy("k").agg(F.count("*").alias("n")).where("n > 10")
    got = sorted((r.k, r.x, r.y) for r in workspace.spread_join(many, one, "k", hot).collect())
    assert got == sorted((r.k, r.x, r.y) for r in many.join(one, "k").collect()) and len(got) == 85
