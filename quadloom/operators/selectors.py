"""Selectors: what a stage runs for - items of a query, classes, properties, a registry's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.void import types
from quadloom.plans import sparql


def items(quads: DataFrame, query: str, max_results: int | None = None) -> DataFrame:
    """The rows of a SELECT in which every variable is bound to an IRI, in the query's order, at most ``max_results``."""
    rows = sparql.run(quads, query, terms=True)
    names = [c for c in rows.columns if f"{c}__kind" in rows.columns]
    for n in names:
        rows = rows.where(F.col(f"{n}__kind") == "iri")
    rows = rows.select(*names)
    return rows if max_results is None else rows.limit(max_results)


def classes(t: DataFrame) -> DataFrame:
    """(class): all classes in use."""
    return types(t).select("class").distinct()


def properties(t: DataFrame) -> DataFrame:
    """(property): all properties in use."""
    return t.select(F.col("p").alias("property")).distinct()


def registry_source(quads: DataFrame, dataset: str) -> DataFrame:
    """What a registry says of a dataset: the graph that is named after it."""
    return quads.where(F.col("g") == sparql.assert_safe_iri(dataset))


def probed_distributions(distributions: DataFrame, probes: DataFrame) -> DataFrame:
    """Distributions (dataset, idx, url, …) with the results of the probes of their url; without one they have nulls."""
    own = [c for c in probes.columns if c not in distributions.columns]
    return distributions.join(probes.select(F.col("url").alias("__url"), *own), F.col("url") == F.col("__url"), "left").drop("__url")
