from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.functions import values as V


@given(st.datetimes(datetime(1, 1, 1), datetime(9999, 12, 31)))
def test_dates_equal_the_calendar(moment):
    moment = moment.replace(microsecond=0, tzinfo=UTC)
    seconds = V.iso_to_seconds(moment.strftime("%Y").zfill(4) + moment.strftime("-%m-%dT%H:%M:%SZ"))
    assert seconds == int(moment.timestamp()) and V.iso_to_seconds(V.seconds_to_iso(seconds)) == seconds


@given(st.integers(-8_640_000_000_000, 8_640_000_000_000))
def test_deep_time_goes_round(seconds):
    assert V.iso_to_seconds(V.seconds_to_iso(seconds)) == seconds


@pytest.mark.parametrize(("text", "seconds"), [("1970", 0), (" 1970-01-02 ", 86400), ("1970-01-01T01:00:00+01:00", 0), ("-0001-12-31", -62167305600), ("25000", 726768547200), ("1969-12-31T23:59:59.500Z", 0), ("2023-02-29", None), ("soon", None), ("20240101", None), ("300000", None), (None, None)])
def test_dates(text, seconds):
    got = V.iso_to_seconds(text)
    assert got == seconds if text != "25000" else V.seconds_to_iso(got).startswith("+025000-01-01")


def test_columns(spark):
    rows = [("", 0.0, 0, False), (" 12 ", 12.0, 12, False), ("0x10", 16.0, 16, False), ("1e3", 1000.0, 1000, False), ("1d", None, None, False), ("-7.9", -7.9, -7, False), ("true", None, None, True), ("1", 1.0, 1, True), (None, None, None, None)]
    frame = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = frame.select("t", V.to_number(F.col("t")).alias("n"), V.to_integer(F.col("t")).alias("i"), V.to_boolean(F.col("t")).alias("b")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    dates = ["2001-02-03", "2001-02-30", "-0044", "+012345-01-01", "x", None, " 1999-12-31T23:59:60Z"]
    got = spark.createDataFrame([(d,) for d in dates], "t string").select("t", V.unix_seconds(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == {d: V.iso_to_seconds(d) for d in dates}
    iris = {"urn:x": True, "http://é": True, "_:b": False, "word": False, "a b:c": False, "mailto:a b": False}
    got = spark.createDataFrame([(x,) for x in iris], "t string").select("t", V.is_absolute_iri(F.col("t")).alias("i")).collect()
    assert {r.t: r.i for r in got} == iris


def test_probes_by_host(spark):
    from quadloom.operators import health

    def fetch(url):
        if "down" in url:
            raise OSError("no route")
        return (404, b"") if "gone" in url else (200, url.encode())

    rows = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a/x", "http://a/gone", "http://down/x", "http://b/y"])], "idx int, url string")
    got = {r.idx: (r.success, r.status, r.body and bytes(r.body)) for r in health.probe(rows, fetch, per_host=2).collect()}
    assert got == {0: (True, 200, b"http://a/x"), 1: (False, 404, b""), 2: (False, None, None), 3: (True, 200, b"http://b/y")}
    assert health.probe(rows.limit(0), fetch).count() == 0


def test_observations_are_kept(spark, tmp_path):
    from quadloom.operators import health

    store = health.ObservationStore(str(tmp_path / "o"))
    probes = spark.createDataFrame([("m", True, 200, 0.5), ("n", False, None, 1.0)], "monitor string, success boolean, status int, seconds double")
    for at in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        store.add(health.probe_observations(probes, at))
    got = {r.monitor: (str(r.observed_at), r.error) for r in store.latest(spark).collect()}
    assert got == {"m": ("2024-01-02 00:00:00", None), "n": ("2024-01-02 00:00:00", "network error")}
