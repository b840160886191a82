"""Dataset registries: descriptions in quads to one row a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.values import is_sparql, mime_type, source_fingerprint
from quadloom.operators.quads import instances

DCAT = "http://www.w3.org/ns/dcat#"
DCT = "http://purl.org/dc/terms/"
FOAF_NAME = "http://xmlns.com/foaf/0.1/name"


def _texts(quads: DataFrame, p: str, name: str) -> DataFrame:
    """(s, name): a map from language to the first text of it."""
    first = quads.where(F.col("p") == p).groupBy("s", F.coalesce("o_lang", F.lit("und")).alias("lang")).agg(F.min("o").alias("o"))
    return first.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "o")))).alias(name))


def _values(quads: DataFrame, p: str, name: str, one: bool) -> DataFrame:
    held = quads.where(F.col("p") == p).groupBy("s")
    return held.agg((F.min("o") if one else F.array_sort(F.collect_set("o"))).alias(name))


def distributions(quads: DataFrame) -> DataFrame:
    """(iri, dataset, access_url, media_type, byte_size, compress_format, conforms_to, modified, sparql, fingerprint)."""
    links = quads.where(F.col("p") == f"{DCAT}distribution").select(F.col("s").alias("dataset"), F.col("o").alias("s"))
    fields = {"access_url": f"{DCAT}accessURL", "download_url": f"{DCAT}downloadURL", "media_type": f"{DCAT}mediaType", "byte_size": f"{DCAT}byteSize", "compress_format": f"{DCAT}compressFormat", "conforms_to": f"{DCT}conformsTo", "modified": f"{DCT}modified"}
    own = quads.join(links.select("s").distinct(), "s", "left_semi").where(F.col("p").isin(list(fields.values())))
    wide = own.groupBy("s").agg(*(F.min(F.when(F.col("p") == p, F.col("o"))).alias(n) for n, p in fields.items()))
    sparql = is_sparql(F.col("media_type"), F.col("conforms_to"))
    media: Column = F.regexp_replace(mime_type(F.col("media_type")), "^https?://www.iana.org/assignments/media-types/", "")
    return links.join(wide, "s", "left").select(
        F.col("s").alias("iri"), "dataset", F.coalesce("access_url", "download_url").alias("access_url"), media.alias("media_type"), F.col("byte_size").try_cast("long").alias("byte_size"),
        "compress_format", "conforms_to", "modified", sparql.alias("sparql"), source_fingerprint(F.col("modified"), F.col("byte_size"), sparql).alias("fingerprint"),
    )


def datasets(quads: DataFrame, class_iri: str = f"{DCAT}Dataset") -> DataFrame:
    """(iri, title, description, language, license, creator, publisher, distributions)."""
    out = instances(quads, class_iri)
    for p, name in ((f"{DCT}title", "title"), (f"{DCT}description", "description")):
        out = out.join(_texts(quads, p, name), "s", "left")
    out = out.join(_values(quads, f"{DCT}language", "language", False), "s", "left").join(_values(quads, f"{DCT}license", "license", True), "s", "left")
    names = _texts(quads, FOAF_NAME, "name").withColumnRenamed("s", "agent")
    for role, one in (("creator", False), ("publisher", True)):
        agents = quads.where(F.col("p") == f"{DCT}{role}").select("s", F.col("o").alias("agent")).join(names, "agent", "left")
        ranked = F.array_sort(F.collect_set("agent"))
        held = agents.groupBy("s").agg(ranked.alias("order"), F.collect_list(F.struct("agent", "name")).alias("all"))
        structs = F.transform("order", lambda a: F.struct(a.alias("iri"), F.element_at(F.filter("all", lambda x: x["agent"] == a), 1)["name"].alias("name")))
        out = out.join(held.select("s", (F.try_element_at(structs, F.lit(1)) if one else structs).alias(role)), "s", "left")
    dumps = distributions(quads)
    listed = dumps.groupBy(F.col("dataset").alias("s")).agg(F.array_sort(F.collect_list(F.struct("access_url", "media_type", "byte_size", "compress_format", "conforms_to", "modified"))).alias("distributions"))
    return out.join(listed, "s", "left").withColumnRenamed("s", "iri")


def select_datasets(found: DataFrame, iris: list[str] | None = None, publisher: str | None = None, license_iri: str | None = None) -> DataFrame:
    """Datasets that meet all given criteria."""
    if iris is not None:
        found = found.where(F.col("iri").isin(iris))
    if publisher is not None:
        found = found.where(F.col("publisher.iri") == publisher)
    return found if license_iri is None else found.where(F.col("license") == license_iri)
