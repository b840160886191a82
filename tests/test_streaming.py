from quadloom.sinks import VersionedTable
from quadloom.streaming import changes

SCHEMA = "id string, seq long, v string"


def test_upserts_from_a_stream(spark, tmp_path):
    source, table = str(tmp_path / "in"), VersionedTable(spark, str(tmp_path / "t"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        changes.upsert_stream(stream, table, str(tmp_path / "c")).awaitTermination()
        return sorted((r.id, r.seq, r.v) for r in table.read().collect())

    assert arrive(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")) == [("a", 2, "y"), ("b", 1, "z")]
    assert arrive(("a", 1, "late"), ("b", 5, "new"), ("c", 1, "c")) == [("a", 2, "y"), ("b", 5, "new"), ("c", 1, "c")]


def test_a_log_grows_by_its_batches(spark, tmp_path):
    source, log = str(tmp_path / "in"), changes.ChangeLog(spark, str(tmp_path / "t"), merge_after=2)
    assert log.read() is None

    def arrive(*rows):
        spark.createDataFrame(list(rows), SCHEMA).write.mode("append").parquet(source)
        changes.upsert_stream(spark.readStream.schema(SCHEMA).parquet(source), log, str(tmp_path / "c")).awaitTermination()
        return sorted((r.id, r.seq, r.v) for r in log.read().collect()), len(log.batches())

    assert arrive(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")) == ([("a", 2, "y"), ("b", 1, "z")], 1)
    assert arrive(("a", 1, "late"), ("b", 5, "new")) == ([("a", 2, "y"), ("b", 5, "new")], 0)  # merged
    assert arrive(("b", 4, "old"), ("c", 1, "c")) == ([("a", 2, "y"), ("b", 5, "new"), ("c", 1, "c")], 1)
    log.append(spark.createDataFrame([("c", 1, "c")], SCHEMA), 2)  # a batch that is run again
    assert log.read().count() == 3


def test_timeouts_as_a_stream_and_over_a_log(spark, tmp_path):
    log = [("e", i, o) for i, o in enumerate(["timeout", "error", "timeout", "timeout", "ok", "timeout", "ok"])] + [("f", 0, "timeout")]
    schema = "endpoint string, seq long, outcome string"
    spark.createDataFrame(log, schema).write.parquet(str(tmp_path / "in"))
    limits = changes.timeouts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = limits.writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    streamed = sorted(map(tuple, spark.sql("select * from limits").collect()))
    assert streamed == sorted(map(tuple, changes.timeouts_batch(spark.createDataFrame(log, schema)).collect()))
    assert [x[2] for x in streamed if x[0] == "e"] == [300.0, 300.0, 300.0, 30.0, 300.0, 300.0, 300.0]


def test_changed_rows_pass(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "dataset string, fingerprint string")
    state = spark.createDataFrame([("a", "1"), ("b", "1")], "dataset string, fingerprint string")
    assert sorted(r.dataset for r in changes.changed_only(rows, state).collect()) == ["b", "c"]
