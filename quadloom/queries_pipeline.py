"""Pipeline, sink, health and shape queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.values import should_reprocess, skolem_iri, source_fingerprint
from quadloom.operators import health, shapes
from quadloom.operators.quads import serialize
from quadloom.plans.pipeline import Dataset, Stage, normalization, sparql_reader
from quadloom.search.project import key_of
from quadloom.sinks import departed_sources, last_wins, sweep, upsert
from quadloom.sources.rdf import parse_lines
from quadloom.sources.tables import BASE, XSD, quads_from_tables, table
from quadloom.streaming.changes import timeouts_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add




def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("monitor"), "event_type", "event_id", F.col("ts").alias("observed_at"))


@_register("SELECT user_id AS monitor, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("monitor", "observed_at", "event_id", "event_type")
    return health.latest(rows).select("monitor", "event_type", "event_id")


@_register("SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq FROM events GROUP BY user_id")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    old = last_wins(rows.where("seq % 2 = 0"))
    new = last_wins(rows)
    return upsert(old, new).select("id", "event_type", "seq")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).when(F.col("doc_id") % 3 == 1, F.lit("run")).alias("last_seen"))


@_register("SELECT CAST(doc_id AS VARCHAR) AS id, source FROM documents WHERE source < 'src5' AND (source >= 'src2' OR doc_id % 3 = 1)")
def sweep_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _indexed(spark, sf_dir)
    named = rows.select("source").distinct()
    return sweep(rows, named.where("source < 'src5'"), named.where("source < 'src2'"), "run").select("id", "source")


@_register("SELECT DISTINCT source FROM documents WHERE source >= 'src5'")
def departed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _indexed(spark, sf_dir)
    return departed_sources(rows, rows.where("source < 'src5'"))


@_register("SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') || '|' || o_custkey AS fingerprint, NOT (o_orderkey % 2 = 0 AND o_orderstatus = 'F') AS again FROM orders")
def reprocess_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", source_fingerprint(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey"), F.lit(False)).alias("f"))
    stored = F.when(F.col("o_orderkey") % 2 == 0, F.col("f"))
    status = F.when(F.col("o_orderstatus") == "F", F.lit("success")).otherwise(F.lit("failure"))
    return rows.select(F.col("o_orderkey").alias("k"), F.col("f").alias("fingerprint"), should_reprocess(F.col("f"), F.lit("1"), stored, F.lit("1"), status).alias("again"))


@_register("""
    WITH v AS (SELECT user_id, event_id, event_type = 'purchase' AS deep, event_type <> 'error' AS ok FROM events WHERE event_type IN ('purchase', 'error')),
    last AS (SELECT user_id, arg_max(ok, (deep, event_id)) AS ok FROM v GROUP BY user_id)
    SELECT DISTINCT e.user_id AS source, CASE WHEN e.user_id % 7 = 0 THEN 'unreachable' WHEN ok THEN 'usable' WHEN NOT ok THEN 'invalid' ELSE 'unverified' END AS usability FROM events e LEFT JOIN last USING (user_id)""")
def usability_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    reach = events.select(F.col("user_id").alias("source"), (F.col("user_id") % 7 != 0).alias("reachable"), F.lit("f").alias("fingerprint")).distinct()
    verdict = F.when(F.col("event_type") == "error", "invalid").otherwise("valid")
    verdicts = events.where(F.col("event_type").isin("purchase", "error")).select(F.col("user_id").alias("source"), verdict.alias("verdict"), (F.col("event_type") == "purchase").alias("deep"), F.col("event_id").alias("ordinal"), F.lit("f").alias("fingerprint"))
    return health.usability(reach, verdicts).select("source", "usability")


@_register("""
    WITH x AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
    y AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS failed FROM x)
    SELECT CAST(user_id AS VARCHAR) AS endpoint, event_id AS seq, CASE WHEN event_type <> 'view' AND failed >= 2 THEN 30.0 ELSE 300.0 END::DOUBLE AS limit_seconds FROM y""")
def adaptive_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "error", "timeout").otherwise("error")
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("endpoint"), F.col("event_id").alias("seq"), outcome.alias("outcome"))
    return timeouts_batch(log, 2)


_SHAPE = shapes.Shape(f"{BASE}class/Part", (
    shapes.PropertyShape(f"{BASE}prop/p_name", min_count=1, max_count=1, datatype=f"{XSD}string"), shapes.PropertyShape(f"{BASE}prop/p_size", datatype=f"{XSD}string", severity="Warning"),
    shapes.PropertyShape(f"{BASE}prop/p_color", min_count=1), shapes.PropertyShape(f"{BASE}prop/p_brand", in_values=("Brand#11", "Brand#5"), severity="Info"),
))


@_register(f"SELECT '{BASE}part/' || p_partkey AS focus, '{BASE}prop/p_color' AS path, 'minCount' AS \"constraint\", '0' AS value, 'Violation' AS severity FROM part")
def shacl_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.violations(quads_from_tables(spark, sf_dir, ["part"]), _SHAPE).where("constraint in ('minCount', 'maxCount')")


@_register(f"SELECT '{BASE}part/' || p_partkey AS focus, '{BASE}prop/p_size' AS path, CAST(p_size AS VARCHAR) AS value, 'Warning' AS severity FROM part")
def shacl_datatype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.violations(quads_from_tables(spark, sf_dir, ["part"]), _SHAPE).where("constraint = 'datatype'").drop("constraint")


@_register("SELECT 'Violation' AS severity, count(*) AS results FROM part UNION ALL SELECT 'Warning', count(*) FROM part UNION ALL SELECT 'Info', count(*) FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#5')")
def shacl_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.by_severity(shapes.violations(quads_from_tables(spark, sf_dir, ["part"]), _SHAPE))


@_register("SELECT 'urn:holds' AS p, count(*) AS n FROM nation UNION ALL SELECT 'https://schema.org/name', count(DISTINCT n_regionkey) FROM nation")
def stage_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"PREFIX t: <{BASE}prop/> CONSTRUCT {{ ?r <urn:holds> ?n ; <http://schema.org/name> ?name }} WHERE {{ #subjectFilter# \n ?n t:n_regionkey ?r . ?r t:r_name ?name }}"
    stage = Stage("regions", (sparql_reader(text), sparql_reader(text)), transforms=(normalization({"http://schema.org/": "https://schema.org/"}), lambda q, d: q.distinct()))
    out = stage.run(quads_from_tables(spark, sf_dir, ["nation", "region"]), Dataset(f"{BASE}dataset"))
    return out.groupBy("p").agg(F.count("*").alias("n"))


@_register(f"SELECT '{BASE}nation/' || n_nationkey AS s, n_name AS name, '{BASE}graph/nation' AS g FROM nation")
def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = serialize(quads_from_tables(spark, sf_dir, ["nation"]), graph=True)
    return parse_lines(lines).where(F.col("p") == f"{BASE}prop/n_name").select("s", F.col("o").alias("name"), "g")


@_register("SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def ntriples_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = serialize(quads_from_tables(spark, sf_dir, ["documents"]))
    texts = parse_lines(lines).where(F.col("p").rlike("^https?://schema.org/text$"))
    return texts.select(F.regexp_extract("s", "([0-9]+)$", 1).cast("long").alias("doc_id"), F.md5("o").alias("text_md5"), F.col("o_lang").alias("lang"))


@_register(f"SELECT c_custkey AS k, '{BASE}key/' || least(c_nationkey % 5, 3) AS doc_key, '{BASE}customer-' || md5(c_name) AS skolem FROM customer")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    key = lambda x: F.concat(F.lit(f"{BASE}key/"), x.cast("string"))
    candidates = F.array(F.lit("not an iri"), key(F.lit(3)), key(F.col("c_nationkey") % 5))
    return rows.select(F.col("c_custkey").alias("k"), key_of(candidates, F.lit("urn:node")).alias("doc_key"), skolem_iri(F.lit(f"{BASE}customer"), F.md5("c_name")).alias("skolem"))


@_register("SELECT CAST(user_id AS VARCHAR) AS dataset, arg_min('urn:' || event_id, event_id) AS url FROM events WHERE event_type IN ('view', 'click') AND event_id % 2 = 0 GROUP BY user_id")
def choose_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    probes = events.select(F.col("user_id").cast("string").alias("dataset"), F.col("event_id").alias("idx"), F.concat(F.lit("urn:"), "event_id").alias("url"), F.col("event_type").isin("view", "click").alias("success"), (F.col("event_id") % 2 == 0).alias("sparql"))
    return health.choose_endpoint(probes)
