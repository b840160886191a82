"""Sets of quads: what they keep, and what a task holds of them."""

from quadloom.operators import quads as Q
from quadloom.plans import tables
from quadloom.sources.tables import QUAD_COLUMNS, TERM_COLUMNS, quads_from_tables, repeated_keys

from .graphs import EX, frame, quad

SF = "/root/testdata/sf0.001"


def test_copies_are_dealt_before_they_are_looked_for(spark, monkeypatch):
    """A task holds no quads of its split: below the exchange nothing is grouped."""
    monkeypatch.setattr(tables, "DEALT_BYTES", 10_000)
    t = quads_from_tables(spark, SF, ["orders"])
    found = Q.dedupe(t.unionByName(t))
    above, dealt, below = found._jdf.queryExecution().sparkPlan().toString().partition("Exchange hashpartitioning")
    assert dealt and "HashAggregate" in above and "HashAggregate" not in below
    assert found.count() == t.count() == t.distinct().count()


def test_parts_follow_the_bytes_read_up_to_what_is_written_unheld(spark, monkeypatch):
    t = quads_from_tables(spark, SF, ["orders"])
    monkeypatch.setattr(tables, "DEALT_BYTES", 10_000)
    one, two = tables._parts(t), tables._parts(t.unionByName(t))
    assert 1 < one < two <= 200
    monkeypatch.setattr(tables, "DEALT_BYTES", 1)
    assert tables._parts(t) == 200
    assert tables._parts(frame(spark, quad(EX + "a", EX + "p", "1"))) is None


def test_nulls_are_equal_and_every_column_tells_apart(spark, tmp_path):
    a = quad(EX + "a", EX + "p", "1")
    others = [quad(EX + "a", EX + "p", "1", "nl"), quad(EX + "a", EX + "p", "1", dt="urn:i"), quad(EX + "a", EX + "p", "1", g="urn:g"), quad(EX + "a", EX + "p", "1", dataset="urn:d"), quad("_:a", EX + "p", "1")]
    frame(spark, a, a, a, *others, *others).write.parquet(f"{tmp_path}/q")
    t = spark.read.parquet(f"{tmp_path}/q")
    for x in (t, frame(spark, a, a, a, *others, *others)):
        assert sorted(map(str, Q.dedupe(x).select(*QUAD_COLUMNS).collect())) == sorted(map(str, frame(spark, a, *others).collect()))
        assert Q.dedupe(x.select(*TERM_COLUMNS)).count() == 4
    assert Q.dedupe(t.where("false")).count() == 0


def test_keys_are_dealt_before_the_look_for_repeated_ones(spark, tmp_path, monkeypatch):
    """The look of a session at a table's keys holds no split either, and finds null keys as well."""
    asked = []
    monkeypatch.setattr(tables, "dealt", lambda df, keys, f=tables.dealt: asked.append(keys) or f(df, keys))
    spark.createDataFrame([(1, 1), (1, 2), (1, 1), (None, 3), (None, 3), (None, 4)], "a int, b int").write.parquet(f"{tmp_path}/k")
    assert sorted(map(str, repeated_keys(spark, f"{tmp_path}/k", ["a", "b"]).collect())) == ["Row(a=1, b=1)", "Row(a=None, b=3)"]
    assert asked == [["a", "b"]]


def test_the_look_for_repeated_keys_moves_a_hash_a_row(spark, tmp_path, monkeypatch):
    """Keys are dealt only if their hash is met again, and are told apart themselves: nulls in other places have one hash."""
    written = []
    monkeypatch.setattr(tables, "checkpointed", lambda df, f=tables.checkpointed: written.append(df) or f(df))
    schema, alike = "a int, b int", [(None, 3), (3, None)]
    look = lambda name, rows: (spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}"), repeated_keys(spark, f"{tmp_path}/{name}", ["a", "b"]))[1]
    assert look("none", [(1, 1), (1, 2), (2, 1)]) is None
    (first,) = written
    assert first.columns == ["hash"] and "RepartitionByExpression [hash#" in first._jdf.queryExecution().optimizedPlan().toString()
    assert look("alike", alike) is None and [x.columns for x in written[1:]] == [["hash"], ["a", "b"]]
    monkeypatch.setattr(tables, "BROADCAST_HASHES", 0)
    assert [tuple(r) for r in look("some", [*alike, (1, 1), (3, None)]).collect()] == [(3, None)]
