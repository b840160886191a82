"""Source health: probe results to verdicts, usability, and which distribution to use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def choose_endpoint(probes: DataFrame) -> DataFrame:
    """Of probes (dataset, idx, url, success, sparql) each dataset's first working endpoint in declared order."""
    held = probes.where("success and sparql")
    return held.groupBy("dataset").agg(F.min_by("url", "idx").alias("url"))


def probe_verdicts(probes: DataFrame) -> DataFrame:
    """A verdict for each probe (…, success, status, parsed, empty): valid, invalid or unknown, and whether content was looked at."""
    verdict = F.when(~F.col("success"), F.when(F.coalesce(F.col("status"), F.lit(0)).between(400, 499), "invalid").otherwise("unknown"))
    verdict = verdict.when(F.col("parsed").isNull(), "unknown").when(F.col("parsed") & ~F.coalesce("empty", F.lit(False)), "valid").otherwise("invalid")
    return probes.withColumn("verdict", verdict).withColumn("deep", F.lit(False))


def import_verdicts(imports: DataFrame) -> DataFrame:
    """A verdict for each import (…, triples, failed): whole content was read, so it is deep."""
    verdict = F.when(F.col("failed"), "invalid").when(F.coalesce(F.col("triples"), F.lit(0)) > 0, "valid").otherwise("invalid")
    return imports.withColumn("verdict", verdict).withColumn("deep", F.lit(True))


def usability(reach: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Sources (source, reachable, fingerprint) with whether they can be used.

    The verdict that counts was made on the same fingerprint; a deep one beats
    a shallow one, then the later (ordinal). Unreachable sources are not usable,
    those without a verdict are as far as is known.
    """
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("deep"), F.desc("ordinal")))
    same = verdicts.join(reach.select("source", F.col("fingerprint").alias("__f")), "source").where(F.col("fingerprint") == F.col("__f"))
    last = same.withColumn("__rank", rank).where("__rank = 1").select("source", "verdict")
    joined = reach.join(last, "source", "left")
    usable = F.when(~F.col("reachable"), "unreachable").when(F.col("verdict") == "invalid", "invalid").when(F.col("verdict") == "valid", "usable").otherwise("unverified")
    return joined.select("source", "reachable", usable.alias("usability"))


def latest(observations: DataFrame, key: str = "monitor", at: str = "observed_at") -> DataFrame:
    """Each monitor's newest observation: one aggregate with a partial step, no sort of a monitor's history."""
    rest = [c for c in observations.columns if c != key]
    tie = F.struct(at, *[c for c in rest if c != at])
    return observations.groupBy(key).agg(F.max_by(F.struct(*rest), tie).alias("r")).select(key, "r.*")


def report_quads(probes: DataFrame) -> DataFrame:
    """Probe results (dataset, url, success, status, triples) as triples."""
    from quadloom.operators.quads import construct
    from quadloom.sources.tables import RDF_TYPE

    schema = "https://schema.org/"
    action = F.concat(F.col("dataset"), F.lit("/.well-known/probe#"), F.md5("url"))
    return construct(probes.withColumn("action", action), [
        (F.col("action"), RDF_TYPE, ("iri", f"{schema}Action")), (F.col("action"), f"{schema}target", ("iri", F.col("url"))),
        (F.col("action"), f"{schema}result", F.when(F.col("success"), F.lit("ok"))), (F.col("action"), f"{schema}error", F.when(~F.col("success"), F.coalesce(F.col("status").cast("string"), F.lit("network")))),
        (F.col("url"), "http://rdfs.org/ns/void#triples", F.col("triples")),
    ])


def classify_manifests(bodies: DataFrame) -> DataFrame:
    """Manifest bodies (url, status, body) by what they are: a IIIF manifest of version 2 or 3, or why not."""
    doc = F.try_parse_json("body")
    context = F.coalesce(F.try_variant_get(doc, "$['@context']", "string"), F.lit(""))
    kind = F.coalesce(F.try_variant_get(doc, "$.type", "string"), F.try_variant_get(doc, "$['@type']", "string"))
    held = F.coalesce(F.try_variant_get(doc, "$.id", "string"), F.try_variant_get(doc, "$['@id']", "string"))
    outcome = (
        F.when(F.col("status").isNull(), "network-error")
        .when(F.col("status") >= 400, "http-error")
        .when(F.col("body").isNull() | (F.trim("body") == ""), "empty")
        .when(doc.isNull(), "not-json")
        .when(~F.contains(context, F.lit("iiif.io/api/presentation/")), "not-iiif")
        .when(~F.coalesce(kind, F.lit("")).isin("Manifest", "sc:Manifest"), "not-a-manifest")
        .when(held.isNull(), "no-id")
        .otherwise(F.when(F.contains(context, F.lit("presentation/3")), "manifest-3").otherwise("manifest-2"))
    )
    return bodies.select("url", outcome.alias("outcome"))


class ObservationStore:
    """Observations (monitor, observed_at, …) kept as a table that only grows; the newest of each monitor is a query."""

    def __init__(self, path: str):
        self.path = path

    def add(self, observations: DataFrame) -> None:
        observations.write.mode("append").parquet(self.path)

    def latest(self, spark) -> DataFrame:
        return latest(spark.read.parquet(self.path))


def probe_observations(probes: DataFrame, observed_at: str) -> DataFrame:
    """Probe results (monitor, success, status, seconds) as observations at a time."""
    message = F.when(~F.col("success"), F.coalesce(F.concat(F.lit("HTTP "), F.col("status").cast("string")), F.lit("network error")))
    return probes.select("monitor", F.lit(observed_at).cast("timestamp").alias("observed_at"), "success", "seconds", message.alias("error"))


def probe(distributions: DataFrame, fetch, per_host: int = 4) -> DataFrame:
    """distributions (…, url) with success, status, seconds and a body's first bytes, by ``fetch(url) -> (status, body)``.

    Each host's urls go to ``per_host`` tasks at most, so no host is asked by more at once; rows keep
    their own order column, if they have one. A fetch that raises is a network error: no status.
    """
    from collections.abc import Iterator

    import pandas as pd

    rows = distributions.withColumns({"__host": F.parse_url(F.col("url"), F.lit("HOST")), "__lane": F.pmod(F.xxhash64("url"), F.lit(per_host))})
    names = distributions.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            found = []
            for url in batch["url"]:
                began = time.monotonic()
                try:
                    status, body = fetch(url)
                except Exception:  # whatever the network says
                    status, body = None, None
                found.append((status is not None and 200 <= status < 300, status, time.monotonic() - began, body))
            made = pd.DataFrame(found, columns=["success", "status", "seconds", "body"], index=batch.index)
            yield pd.concat([batch[names], made.astype({"status": "Int32"})], axis=1)

    schema = distributions.schema.simpleString()[7:-1]
    return rows.repartition("__host", "__lane").select(*names).mapInPandas(run, f"{schema}, success:boolean, status:int, seconds:double, body:binary".replace("struct<", ""))


def file_fetch(bound: int = 256 << 10, timeout: float = 5.0):
    """A fetch by urllib: the status and at most ``bound`` bytes."""

    def fetch(url: str) -> tuple[int, bytes]:
        from urllib.request import urlopen

        with urlopen(url, timeout=timeout) as held:
            return getattr(held, "status", None) or 200, held.read(bound)

    return fetch


def import_plan(distributions: DataFrame, strategy: str) -> DataFrame:
    """(dataset, how, url): of probed distributions (dataset, idx, url, sparql, success) what a strategy takes.

    sparql: the first working endpoint; import: the first working dump; sparqlWithImportFallback: a working
    endpoint, else a dump. A dataset without any has no row.
    """
    if strategy not in ("sparql", "import", "sparqlWithImportFallback"):
        raise ValueError(f"no strategy {strategy!r}")
    held = distributions.where("success").withColumn("how", F.when(F.col("sparql"), "sparql").otherwise("import"))
    if strategy != "sparqlWithImportFallback":
        held = held.where(F.col("how") == strategy)
    first = F.struct((F.col("how") == "import").alias("later"), "idx")
    return held.groupBy("dataset").agg(F.min_by(F.struct("how", "url"), first).alias("x")).select("dataset", "x.*")
