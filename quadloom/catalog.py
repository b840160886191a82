"""All queries of the engine by name."""

from __future__ import annotations

from quadloom import queries as graph
from quadloom import queries_more as more
from quadloom import queries_pipeline as pipeline
from quadloom import queries_search as search
from quadloom import queries_sparql as sparql


def queries() -> dict[str, graph.Query]:
    return graph.QUERIES | sparql.QUERIES | more.QUERIES | search.QUERIES | pipeline.QUERIES


def oracle_sql() -> dict[str, str]:
    return graph.ORACLE_SQL | sparql.ORACLE_SQL | more.ORACLE_SQL | search.ORACLE_SQL | pipeline.ORACLE_SQL
