import time

import pytest
from pyspark.sql import functions as F

from quadloom.operators import health, registry, shapes
from quadloom.plans.pipeline import Dataset, EmptySelection, NotSupported, Pipeline, ProcessingRecords, Stage, guard_blank_nodes, provenance, sparql_reader
from quadloom.sinks import GraphTableWriter, IndexLock, IndexWriter, QuadFileWriter, SchemaIndexWriter, Tee, VersionedTable
from quadloom.sources.tables import RDF_TYPE, XSD

from .graphs import EX, frame, quad

COPY = "CONSTRUCT { ?s ?p ?o } WHERE { #subjectFilter# ?s ?p ?o }"


def source(spark):
    return frame(spark, quad(EX + "a", EX + "p", "x"), quad(EX + "b", EX + "p", "y"), quad(EX + "b", "a", EX + "C"))


def lines(path, dataset):
    return sorted(x for f in (path / QuadFileWriter.folder(dataset)).glob("part*") for x in f.read_text().splitlines())


def test_stage(spark):
    d = Dataset(EX + "d", subject_filter=f"?s a <{EX}C> . ")
    stage = Stage("copy", (sparql_reader(COPY), sparql_reader(COPY, dedupe=True)), children=(Stage("again", (sparql_reader(f"CONSTRUCT {{ ?s <{EX}seen> ?d }} WHERE {{ ?s a ?d }}"),)),))
    out = stage.run(source(spark), Dataset(d.iri, subject_filter=d.subject_filter))
    assert {(r.s[-1], r.p.replace(EX, "")) for r in out.collect()} == {("b", "p"), ("b", RDF_TYPE), ("b", "seen")}

    def refuses(quads, dataset):
        raise NotSupported

    with pytest.raises(NotSupported):
        Stage("none", (refuses,)).run(source(spark), d)
    with pytest.raises(ValueError):
        Stage("empty", (sparql_reader(f"CONSTRUCT {{ ?s ?p ?o }} WHERE {{ ?s <{EX}nope> ?o ; ?p ?o }}"),), expects_output=True).run(source(spark), Dataset("urn:d"))
    shape = shapes.Shape(EX + "C", (shapes.PropertyShape(EX + "q", min_count=1),))
    check = lambda q, _: shapes.violations(q, shape)
    kept = Stage("skip", (sparql_reader(COPY),), validator=check, on_invalid="skip").run(source(spark), Dataset("urn:d"))
    assert {r.s for r in kept.collect()} == {EX + "a"}
    with pytest.raises(ValueError):
        Stage("halt", (sparql_reader(COPY),), validator=check, on_invalid="halt").run(source(spark), Dataset("urn:d"))
    added = provenance("copy", "2024-01-01T00:00:00.000Z")(source(spark), Dataset("urn:d")).where("p like '%startedAtTime'").first()
    assert added.s.startswith("urn:d/.well-known/prov#activity-") and added.o_dt == f"{XSD}dateTime"


def test_runs_are_gated_and_all_or_nothing(spark, tmp_path):
    records = ProcessingRecords(spark, str(tmp_path / "records"), "p")
    writer = QuadFileWriter(spark, str(tmp_path / "out"))
    pipeline = Pipeline("p", (Stage("copy", (sparql_reader(COPY),)),), records=records)
    sets = [Dataset("urn:one", fingerprint="f1"), Dataset("urn:two")]
    pipeline.run(sets, lambda d: source(spark), writer)
    assert len(lines(tmp_path / "out", "urn:one")) == 3 and not list((tmp_path / "out").glob("_run*"))
    pipeline.run(sets, lambda d: source(spark), writer)
    assert pipeline.reporter.events.count(("skipped", "urn:one")) == 1 and ("skipped", "urn:two") not in pipeline.reporter.events
    other = ProcessingRecords(spark, str(tmp_path / "records"), "q")
    assert other.records().count() == 0 and records.records().count() == 2
    bad = Pipeline("p", (Stage("guard", (sparql_reader(COPY),), (guard_blank_nodes(),)), Stage("copy", (sparql_reader(COPY),))), version="2", records=records)
    bad.run(sets[:1], lambda d: frame(spark, quad("_:b", EX + "p", "x")), writer)
    assert records.records().where("dataset = 'urn:one'").first().status == "failure"
    assert len(lines(tmp_path / "out", "urn:one")) == 3  # what a failed dataset had stays
    with pytest.raises(EmptySelection):
        pipeline.run([], lambda d: source(spark), writer)


def test_graph_table_and_tee(spark, tmp_path):
    table = GraphTableWriter(spark, str(tmp_path / "t"))
    held = lambda: {r.g: r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("g").count().collect()}
    table.open([])
    table.write("urn:g1", source(spark))
    table.write("urn:g2", source(spark))
    table.write("urn:g1", source(spark).limit(1))  # a second write adds to the first
    table.write("urn:d3", source(spark).limit(1).withColumn("g", F.lit("urn:g2")))  # another dataset adds to the same graph
    table.commit()
    assert held() == {"urn:g1": 3, "urn:g2": 3}
    table.open([])
    table.write("urn:g1", source(spark).limit(1))
    table.write("urn:g2", source(spark).limit(1))
    assert held() == {"urn:g1": 3, "urn:g2": 3}  # nothing changes before commit
    table.flush("urn:g2", False)
    table.commit()
    assert held() == {"urn:g1": 1, "urn:g2": 3}
    table.open([])
    table.write("urn:g1", source(spark))
    table.abort()
    assert held() == {"urn:g1": 1, "urn:g2": 3}

    class Broken:
        aborted = False

        def open(self, _):
            raise OSError

    class Fine(Broken):
        def open(self, _):
            pass

        def abort(self):
            self.aborted = True

    fine = Fine()
    with pytest.raises(OSError):
        Tee([fine, Broken()]).open([])
    assert fine.aborted


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, v int")


def test_index_in_place_sweeps_what_is_gone(spark, tmp_path):
    index = IndexWriter(spark, str(tmp_path / "i"), in_place=True)

    def run(sources, written, failed=()):
        index.open(sources)
        for s, rows in written.items():
            index.write(s, docs(spark, *rows))
            index.flush(s, s not in failed)
        index.commit()
        return sorted((r.id, r.v, r.source) for r in index.table.read().collect())

    assert run(["s", "t"], {"s": [("1", 1), ("2", 1)], "t": [("3", 1)]}) == [("1", 1, "s"), ("2", 1, "s"), ("3", 1, "t")]
    assert run(["s", "t"], {"s": [("1", 2)]}) == [("1", 2, "s"), ("3", 1, "t")]
    assert run(["s", "t"], {"t": [("4", 1)]}, failed=("t",)) == [("1", 2, "s"), ("3", 1, "t"), ("4", 1, "t")]
    assert run(["t"], {}) == [("3", 1, "t"), ("4", 1, "t")]


def test_index_rebuild_keeps_the_old_until_it_is_done(spark, tmp_path):
    index = IndexWriter(spark, str(tmp_path / "i"))
    for v in (1, 2):
        index.open(["s"])
        index.write("s", docs(spark, ("1", v)))
        index.flush("s", True)
        if v == 1:
            index.commit()
        else:
            index.abort()
    assert [(r.id, r.v) for r in index.table.read().collect()] == [("1", 1)]
    lock = IndexLock(spark, str(tmp_path / "i"))
    lock.acquire()
    with pytest.raises(RuntimeError):
        index.open(["s"])
    other = IndexLock(spark, str(tmp_path / "i"), ttl_seconds=-1)
    other.acquire()
    lock.release()  # it belongs to another now
    assert other.held() and not lock.held()
    other.release()
    two = SchemaIndexWriter([["B", "A"]], {"A": index, "B": IndexWriter(spark, str(tmp_path / "j"))})
    two.open(["s"])
    two.write("s", {"A": docs(spark, ("1", 9)), "B": docs(spark, ("2", 8))})
    two.flush("s", True)
    two.commit()
    assert index.table.read().first().v == 9 and VersionedTable(spark, str(tmp_path / "j")).read().first().v == 8


def test_registry(spark):
    d, dist = EX + "set", EX + "dist"
    t = frame(
        spark, quad(d, "a", registry.DCAT + "Dataset"), quad(d, registry.DCT + "title", "Titel", "nl"), quad(d, registry.DCT + "title", "Title", "en"), quad(d, registry.DCT + "publisher", EX + "org"),
        quad(EX + "org", registry.FOAF_NAME, "Org"), quad(d, registry.DCT + "license", "http://cc"), quad(d, registry.DCAT + "distribution", dist), quad(dist, registry.DCAT + "accessURL", "http://x/dump.nt.gz"),
        quad(dist, registry.DCAT + "mediaType", "application/n-triples+gzip"), quad(dist, registry.DCAT + "byteSize", "1000"), quad(dist, registry.DCT + "modified", "2024-06-01T00:00:00.000Z"),
    )
    row = registry.datasets(t).first()
    assert row.title == {"nl": "Titel", "en": "Title"} and row.publisher.iri == EX + "org" and row.publisher.name == {"und": "Org"} and row.creator is None
    one = registry.distributions(t).first()
    assert (one.media_type, one.byte_size, one.sparql, one.fingerprint) == ("application/n-triples", 1000, False, "2024-06-01T00:00:00.000Z|1000")
    assert registry.select_datasets(registry.datasets(t), publisher=EX + "org").count() == 1 and registry.select_datasets(registry.datasets(t), iris=[]).count() == 0


def test_manifests_and_reports(spark):
    ok = '{"@context": "http://iiif.io/api/presentation/3/context.json", "id": "urn:m", "type": "Manifest"}'
    bodies = [("a", 200, ok), ("b", 404, ""), ("c", 200, "<html>"), ("d", 200, "{}"), ("e", 200, ok.replace("Manifest", "Canvas")), ("f", None, None), ("g", 200, " "), ("h", 200, ok.replace('"id": "urn:m", ', "")), ("i", 200, ok.replace("3/", "2/"))]
    got = {r.url: r.outcome for r in health.classify_manifests(spark.createDataFrame(bodies, "url string, status int, body string")).collect()}
    assert got == {"a": "manifest-3", "b": "http-error", "c": "not-json", "d": "not-iiif", "e": "not-a-manifest", "f": "network-error", "g": "empty", "h": "no-id", "i": "manifest-2"}
    probes = spark.createDataFrame([("urn:d", "urn:u1", True, 200, 5), ("urn:d", "urn:u2", False, None, None)], "dataset string, url string, success boolean, status int, triples long")
    assert {(r.p.split("/")[-1], r.o) for r in health.report_quads(probes).collect()} >= {("result", "ok"), ("error", "network"), ("target", "urn:u2"), ("void#triples", "5")}
    verdicts = health.probe_verdicts(probes.withColumns({"parsed": F.lit(None).cast("boolean"), "empty": F.lit(False)}))
    assert sorted(r.verdict for r in verdicts.collect()) == ["unknown", "unknown"]


def test_shapes(spark):
    t = frame(spark, quad(EX + "1", "a", EX + "P"), quad(EX + "1", EX + "name", "x"), quad(EX + "2", "a", EX + "P"), quad(EX + "2", EX + "name", "x", "nl"), quad(EX + "2", EX + "at", EX + "1"), quad(EX + "2", EX + "at", EX + "9"))
    shape = shapes.Shape(EX + "P", (shapes.PropertyShape(EX + "name", min_count=1, max_count=1, datatype=f"{XSD}string"), shapes.PropertyShape(EX + "at", class_iri=EX + "P", node_kind="iri", severity="Warning"), shapes.PropertyShape(EX + "name", pattern="^y", severity="Info")))
    found = shapes.violations(t, shape)
    assert sorted((r.focus[-1], r.constraint, r.severity) for r in found.collect()) == [("1", "pattern", "Info"), ("2", "class", "Warning"), ("2", "datatype", "Violation"), ("2", "pattern", "Info")]
    assert tuple(shapes.conforms(found).first()) == (False, 4, 1) and shapes.conforms(found.limit(0)).first().conforms


def test_several_writes_of_one_source(spark, tmp_path):
    index = IndexWriter(spark, str(tmp_path / "i"))
    index.open(["s", "t"])
    index.write("s", docs(spark, ("1", 1), ("2", 1)))
    index.write("s", docs(spark, ("2", 2), ("3", 2)))
    index.write("t", docs(spark, ("3", 3), ("4", 3), ("4", 3)))
    index.commit()
    assert sorted((r.id, r.v, r.source) for r in index.table.read().collect()) == [("1", 1, "s"), ("2", 2, "s"), ("3", 3, "t"), ("4", 3, "t")]
    files = QuadFileWriter(spark, str(tmp_path / "q"))
    files.open([])
    for dataset in ("http://x/a", "http://x_a", "http://x/a"):
        files.write(dataset, source(spark).limit(2))
    files.commit()
    assert len(lines(tmp_path / "q", "http://x/a")) == 4 and len(lines(tmp_path / "q", "http://x_a")) == 2


def test_a_lane_that_fails_leaves_no_lock(spark, tmp_path):
    lanes = {name: IndexWriter(spark, str(tmp_path / name)) for name in "ABCD"}
    writer = SchemaIndexWriter([["B", "C"], ["A"]], lanes)  # C refers to B
    writer.open(["s"])
    writer.write("s", {name: docs(spark, ("1", 1)) for name in "ABCD"})
    lanes["C"].table.write = lambda rows: (_ for _ in ()).throw(OSError("full"))
    with pytest.raises(ExceptionGroup):
        writer.commit()
    assert lanes["A"].table.read().count() == 1 and lanes["D"].table.read().count() == 1 and lanes["B"].table.read() is None
    assert not any(lane.table.files.exists(lane.lock.path) for lane in lanes.values())


def test_a_stage_that_fails_at_run_time_costs_only_itself(spark, tmp_path):
    broken = lambda quads, dataset: quads.withColumn("o", F.raise_error(F.concat(F.lit("no "), F.col("o"))).cast("string"))
    writer = QuadFileWriter(spark, str(tmp_path / "out"))
    pipeline = Pipeline("p", (Stage("broken", (sparql_reader(COPY),), (broken,)), Stage("copy", (sparql_reader(COPY),))))
    pipeline.run([Dataset("urn:one")], lambda d: source(spark), writer)
    assert [e[0] for e in pipeline.reporter.events] == ["stage_failed", "stage"]
    kept = QuadFileWriter(spark, str(tmp_path / "kept"), keep_partial=True)
    Pipeline("p", pipeline.stages).run([Dataset("urn:one")], lambda d: source(spark), kept)
    assert len(lines(tmp_path / "kept", "urn:one")) == 3


def test_validation_reports_and_writes(spark, tmp_path):
    faults = lambda quads, dataset: quads.limit(1).select(F.col("s").alias("focus"))
    for mode, n in (("write", 3), ("skip", 0)):
        writer = QuadFileWriter(spark, str(tmp_path / mode))
        pipeline = Pipeline("p", (Stage("copy", (sparql_reader(COPY),), validator=faults, on_invalid=mode),))
        pipeline.run([Dataset("urn:one")], lambda d: source(spark), writer)
        assert ("invalid", "urn:one", "copy", 1) in pipeline.reporter.events


def test_activity_times_are_around_the_work(spark, tmp_path):
    slow = lambda quads, dataset: (time.sleep(1.1), quads)[1]
    stage = Stage("copy", (sparql_reader(COPY),), (slow,), provenance=True)
    out = stage.run(source(spark), Dataset("urn:one")).where(F.col("p").endswith("AtTime")).collect()
    times = {r.p.rpartition("#")[2]: r.o for r in out}
    assert len(times) == 2 and times["startedAtTime"] < times["endedAtTime"]
