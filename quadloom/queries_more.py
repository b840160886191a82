"""Queries of shapes, selectors, all statistics at once, Turtle and import plans, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.values import first_by_path, most_recent
from quadloom.operators import health, selectors, shapes
from quadloom.operators import quads as Q
from quadloom.operators import void as V
from quadloom.operators.shapes import PropertyShape, Shape
from quadloom.queries import DATASET, Query, _p, _quads_sql
from quadloom.search.query import SearchQuery
from quadloom.sources.tables import BASE, RDF_TYPE, quads_from_tables, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_PROP, _CLASS, _BUILDING = f"{BASE}prop/", f"{BASE}class/", "'BUILDING'"


def _register(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _shacl(name: str, tables: list[str], shape: Shape, sql: str) -> None:
    """sql: (focus, path, constraint, value) of the violations."""
    QUERIES[name] = lambda spark, sf_dir: shapes.violations(quads_from_tables(spark, sf_dir, tables), shape).select("focus", "path", "constraint", "value")
    ORACLE_SQL[name] = _quads_sql(*tables) + sql


def _row(focus: str, path: str | None, constraint: str, value: str) -> str:
    path = "NULL" if path is None else f"'{path}'"
    return f"SELECT {focus} AS focus, {path} AS path, '{constraint}' AS \"constraint\", {value} AS value"


_shacl(
    "shacl_lengths", ["supplier"], Shape(f"{_CLASS}Supplier", (PropertyShape(f"{_PROP}s_name", min_length=11, max_length=11),)),
    " UNION ALL ".join(f"{_row('s', f'{_PROP}s_name', name, 'o')} FROM q WHERE p = {_p('s_name')} AND length(o) {op} 11" for name, op in (("minLength", "<"), ("maxLength", ">"))),
)
_shacl(
    "shacl_ranges", ["part"], Shape(f"{_CLASS}Part", (PropertyShape(f"{_PROP}p_size", min_inclusive=5, max_exclusive=40),)),
    " UNION ALL ".join(f"{_row('s', f'{_PROP}p_size', name, 'o')} FROM q WHERE p = {_p('p_size')} AND CAST(o AS INT) {op}" for name, op in (("minInclusive", "< 5"), ("maxExclusive", ">= 40"))),
)
_shacl(
    "shacl_languages", ["documents"], Shape(f"{_CLASS}Document", (PropertyShape("https://schema.org/text", language_in=("en", "de")),)),
    f"{_row('s', 'https://schema.org/text', 'languageIn', 'o')} FROM q WHERE p = 'https://schema.org/text' AND o_lang NOT IN ('en', 'de')",
)
_shacl(
    "shacl_has_value", ["customer"], Shape(f"{_CLASS}Customer", (PropertyShape(f"{_PROP}c_mktsegment", has_value="BUILDING"),)),
    f"{_row('s', f'{_PROP}c_mktsegment', 'hasValue', _BUILDING)} FROM q WHERE p = {_p('c_mktsegment')} AND o <> 'BUILDING'",
)
_shacl(
    "shacl_class", ["orders", "customer"], Shape(f"{_CLASS}Order", (PropertyShape(f"{_PROP}o_custkey", class_iri=f"{_CLASS}Supplier"),)),
    f"{_row('s', f'{_PROP}o_custkey', 'class', 'o')} FROM q WHERE p = {_p('o_custkey')}",
)
_shacl(
    "shacl_node", ["orders", "customer"], Shape(f"{_CLASS}Order", (PropertyShape(f"{_PROP}o_custkey", node=Shape(None, (PropertyShape(f"{_PROP}c_mktsegment", in_values=("BUILDING",)),))),)),
    f"{_row('a.s', f'{_PROP}o_custkey', 'node', 'a.o')} FROM q a JOIN q b ON a.o = b.s AND b.p = {_p('c_mktsegment')} AND b.o <> 'BUILDING' WHERE a.p = {_p('o_custkey')}",
)
_shacl(
    "shacl_qualified", ["orders", "customer"],
    Shape(f"{_CLASS}Customer", (PropertyShape(f"^{_PROP}o_custkey", qualified=Shape(None, (PropertyShape(f"{_PROP}o_orderstatus", in_values=("F",)),)), qualified_min=4, qualified_max=9),)),
    f"{_row('c', f'^{_PROP}o_custkey', 'qualifiedMinCount', 'n')} FROM k WHERE CAST(n AS INT) < 4 UNION ALL {_row('c', f'^{_PROP}o_custkey', 'qualifiedMaxCount', 'n')} FROM k WHERE CAST(n AS INT) > 9",
)
ORACLE_SQL["shacl_qualified"] = _quads_sql("orders", "customer").rstrip() + (
    f", k AS (SELECT t.s AS c, CAST(count(b.s) AS VARCHAR) AS n FROM ty t LEFT JOIN (SELECT a.s, a.o FROM q a JOIN q z ON a.s = z.s AND z.p = {_p('o_orderstatus')} AND z.o = 'F' WHERE a.p = {_p('o_custkey')}) b ON t.s = b.o WHERE t.class = '{_CLASS}Customer' GROUP BY t.s) "
    + f"{_row('c', f'^{_PROP}o_custkey', 'qualifiedMinCount', 'n')} FROM k WHERE CAST(n AS INT) < 4 UNION ALL {_row('c', f'^{_PROP}o_custkey', 'qualifiedMaxCount', 'n')} FROM k WHERE CAST(n AS INT) > 9"
)
_LONG = f"{_PROP}c_nationkey/{_PROP}n_regionkey/{_PROP}r_name"
_shacl(
    "shacl_path", ["customer", "nation", "region"], Shape(f"{_CLASS}Customer", (PropertyShape(_LONG, in_values=("ASIA", "EUROPE"), min_count=1),)),
    f"{_row('a.s', _LONG, 'in', 'c.o')} FROM q a JOIN q b ON a.o = b.s AND b.p = {_p('n_regionkey')} JOIN q c ON b.o = c.s AND c.p = {_p('r_name')} WHERE a.p = {_p('c_nationkey')} AND c.o NOT IN ('ASIA', 'EUROPE')",
)
_shacl(
    "shacl_closed", ["region"], Shape(f"{_CLASS}Region", (PropertyShape(f"{_PROP}r_name"),), closed=(RDF_TYPE,)),
    f"SELECT s AS focus, p AS path, 'closed' AS \"constraint\", o AS value FROM q WHERE p = {_p('r_regionkey')}",
)
_small, _brand = Shape(None, (PropertyShape(f"{_PROP}p_size", max_inclusive=10),)), Shape(None, (PropertyShape(f"{_PROP}p_brand", in_values=("Brand#11", "Brand#12", "Brand#13")),))
_SIZE_BRAND = f"(SELECT a.s, TRY_CAST(a.o AS INT) <= 10 AS x, b.o IN ('Brand#11', 'Brand#12', 'Brand#13') AS y FROM q a JOIN q b ON a.s = b.s AND b.p = {_p('p_brand')} WHERE a.p = {_p('p_size')})"
_shacl(
    "shacl_logic", ["part"], Shape(f"{_CLASS}Part", all_of=(_small, _brand), any_of=(_small, _brand), one_of=(_small, _brand), none_of=(_small,)),
    " UNION ALL ".join(f"{_row('s', None, name, 's')} FROM {_SIZE_BRAND} WHERE {wrong}" for name, wrong in (("and", "NOT (x AND y)"), ("or", "NOT (x OR y)"), ("xone", "x = y"), ("not", "x"))),
)
_shacl(
    "shacl_less_than", ["lineitem"], Shape(f"{_CLASS}LineItem", (PropertyShape(f"{_PROP}l_linenumber", less_than=f"{_PROP}l_quantity"),)),
    f"SELECT DISTINCT * FROM ({_row('a.s', f'{_PROP}l_linenumber', 'lessThan', 'a.o')} FROM q a JOIN q b ON a.s = b.s AND b.p = {_p('l_quantity')} WHERE a.p = {_p('l_linenumber')} AND CAST(a.o AS DOUBLE) >= CAST(b.o AS DOUBLE))",
)


@_register(_quads_sql("part") + f"SELECT p, count(*) AS n FROM (SELECT unnest(['result', 'type', 'focusNode', 'resultPath', 'value', 'sourceConstraintComponent', 'resultSeverity']) AS p FROM q WHERE p = {_p('p_size')} AND CAST(o AS INT) > 40 UNION ALL SELECT 'type' WHERE EXISTS (SELECT 1 FROM q WHERE p = {_p('p_size')} AND CAST(o AS INT) > 40)) GROUP BY p")
def shacl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shapes.violations(quads_from_tables(spark, sf_dir, ["part"]), Shape(f"{_CLASS}Part", (PropertyShape(f"{_PROP}p_size", max_inclusive=40),)))
    return shapes.report_quads(found, DATASET).select(F.regexp_extract("p", "([A-Za-z]+)$", 1).alias("p")).groupBy("p").agg(F.count("*").alias("n"))


@_register(_quads_sql("customer", "nation", "region") + f"SELECT s, p, o FROM q WHERE s IN (SELECT s FROM (SELECT s FROM ty WHERE class = '{_CLASS}Customer' ORDER BY s LIMIT 5) UNION SELECT a.o FROM q a JOIN (SELECT s FROM ty WHERE class = '{_CLASS}Customer' ORDER BY s LIMIT 5) c ON a.s = c.s AND a.p = {_p('c_nationkey')} UNION SELECT b.o FROM q a JOIN (SELECT s FROM ty WHERE class = '{_CLASS}Customer' ORDER BY s LIMIT 5) c ON a.s = c.s AND a.p = {_p('c_nationkey')} JOIN q b ON a.o = b.s AND b.p = {_p('n_regionkey')})")
def shape_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = Shape(f"{_CLASS}Customer", (PropertyShape(f"{_PROP}c_nationkey", node=Shape(None, (PropertyShape(f"{_PROP}n_regionkey"),))),))
    return shapes.sample_quads(quads_from_tables(spark, sf_dir, ["customer", "nation", "region"]), shape, 5).select("s", "p", "o")


@_register(_quads_sql() + "SELECT DISTINCT class FROM ty")
def class_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.classes(quads_from_tables(spark, sf_dir))


@_register(_quads_sql() + "SELECT DISTINCT p AS property FROM q")
def property_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.properties(quads_from_tables(spark, sf_dir))


@_register(_quads_sql("customer") + f"SELECT o AS x FROM q WHERE p = {_p('c_nationkey')} ORDER BY s LIMIT 7")
def item_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"SELECT ?x {{ ?c <{_PROP}c_nationkey>|<{_PROP}c_name> ?x }} ORDER BY ?c"
    return selectors.items(quads_from_tables(spark, sf_dir, ["customer"]), text, 7)


@_register(_quads_sql("nation", "region") + f"SELECT s, p, o FROM q WHERE g = '{BASE}graph/region'")
def registry_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.registry_source(quads_from_tables(spark, sf_dir, ["nation", "region"]), f"{BASE}graph/region").select("s", "p", "o")


_TERM = "(o, o_kind, coalesce(o_dt, ''), coalesce(o_lang, ''))"


@_register(
    _quads_sql("customer", "nation", "documents") + f"SELECT 'triples' AS name, '' AS key, count(*) AS n FROM q UNION ALL SELECT 'entities', class, count(*) FROM ty GROUP BY class UNION ALL SELECT 'subjects', class || ' ' || p, count(DISTINCT s) FROM q JOIN ty USING (s) GROUP BY class, p "
    f"UNION ALL SELECT 'objects', class || ' ' || p, count(DISTINCT {_TERM}) FROM q JOIN ty USING (s) GROUP BY class, p UNION ALL SELECT 'datatypes', class || ' ' || p || ' ' || o_dt, count(*) FROM q JOIN ty USING (s) WHERE o_kind = 'literal' GROUP BY class, p, o_dt "
    "UNION ALL SELECT 'classes', a.class || ' ' || p || ' ' || b.class, count(*) FROM q JOIN ty a ON q.s = a.s JOIN ty b ON q.o = b.s WHERE o_kind = 'iri' GROUP BY a.class, p, b.class"
)
def void_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.statistics(quads_from_tables(spark, sf_dir, ["customer", "nation", "documents"]))
    part = lambda name, source, keys, n: found[source].select(F.lit(name).alias("name"), F.concat_ws(" ", *keys).alias("key") if keys else F.lit("").alias("key"), F.col(n).alias("n"))
    out = part("triples", "triples", [], "triples")
    for name, source, keys, n in (
        ("entities", "class_partitions", ["class"], "entities"), ("subjects", "class_property_subjects", ["class", "p"], "entities"), ("objects", "class_property_objects", ["class", "p"], "distinct_objects"),
        ("datatypes", "class_property_datatypes", ["class", "p", "datatype"], "triples"), ("classes", "class_property_object_classes", ["class", "p", "object_class"], "triples"),
    ):
        out = out.unionByName(part(name, source, keys, n))
    return out


_VOID = "http://rdfs.org/ns/void#"
_CANON = "CASE WHEN {0} LIKE 'http://schema.org/%' THEN 'https://schema.org/' || substr({0}, 19) ELSE {0} END"


@_register(
    _quads_sql("documents").rstrip() + f", n AS (SELECT {_CANON.format('class')} AS class, {_CANON.format('p')} AS p, CAST(sum(n) AS BIGINT) AS n FROM (SELECT class, p, count(DISTINCT {_TERM}) AS n FROM q JOIN ty USING (s) GROUP BY class, p) GROUP BY 1, 2), "
    f"m AS (SELECT *, '{DATASET}/.well-known/void#class-' || md5(class) AS c, '{DATASET}/.well-known/void#class-property-' || md5(class || p) AS cp FROM n) "
    f"SELECT '{DATASET}' AS s, '{_VOID}classPartition' AS p, c AS o FROM m UNION SELECT c, '{_VOID}class', class FROM m UNION SELECT c, '{_VOID}propertyPartition', cp FROM m UNION SELECT cp, '{_VOID}property', p FROM m UNION SELECT cp, '{_VOID}distinctObjects', CAST(n AS VARCHAR) FROM m"
)
def void_partition_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.class_property_objects(quads_from_tables(spark, sf_dir, ["documents"]))
    return V.partition_chain(found, DATASET, "distinct_objects", aliases=V.SCHEMA_ORG).select("s", "p", "o")


@_register(
    "SELECT '<urn:tpch:region/' || r_regionkey || '>' AS s, '<urn:tpch:region/' || r_regionkey || '> a c:Region ;\n    t:r_name \"' || r_name || '\" ;\n    t:r_regionkey \"' || r_regionkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer> .' AS value FROM region"
)
def turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.turtle(quads_from_tables(spark, sf_dir, ["region"]), {"t": _PROP, "c": _CLASS})


@_register("SELECT CAST(user_id AS VARCHAR) AS dataset, CASE WHEN min(event_id) FILTER (WHERE event_type = 'purchase') IS NULL THEN 'import' ELSE 'sparql' END AS how, 'urn:e/' || coalesce(min(event_id) FILTER (WHERE event_type = 'purchase'), min(event_id) FILTER (WHERE event_type = 'view')) AS url FROM events WHERE event_type IN ('purchase', 'view') GROUP BY user_id")
def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("dataset"), F.col("event_id").alias("idx"), F.concat(F.lit("urn:e/"), F.col("event_id").cast("string")).alias("url"),
        (F.col("event_type") == "purchase").alias("sparql"), F.col("event_type").isin("purchase", "view").alias("success"),
    )
    return health.import_plan(rows, "sparqlWithImportFallback")


@_register("SELECT CAST(o_orderkey AS VARCHAR) AS id, greatest(strftime(o_orderdate, '%Y-%m-%d'), '1995-06-01') AS latest FROM orders")
def most_recent_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").cast("string").alias("id"), most_recent(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1995-06-01"), F.lit("no date")).alias("latest"))


@_register("SELECT event_type AS path, min(event_id) AS first_id, min(CASE WHEN value > 50 THEN event_id END) AS first_large FROM events GROUP BY event_type")
def properties_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("event_id").alias("ord"), F.col("event_id").alias("first_id"), F.when(F.col("value") > 50, F.col("event_id")).alias("first_large"))
    return first_by_path(rows)


def _search(name: str, q: SearchQuery, sql: str, synonyms: list[set[str]] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quadloom.queries_search import engine
        from quadloom.search.engine import SearchEngine

        held = engine(spark, sf_dir)
        return SearchEngine(held.schema, held.tables, synonyms).hits("Part", q).select("id")

    QUERIES[name], ORACLE_SQL[name] = run, sql


_WORDS = "regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')"
_search("search_prefix", SearchQuery(text="cold wid", prefix=True, limit=100), f"SELECT '{BASE}part/' || p_partkey AS id FROM part WHERE list_contains({_WORDS}, 'cold') AND len(list_filter({_WORDS}, lambda x: x LIKE 'wid%')) > 0 ORDER BY 1 LIMIT 100")
_search("search_synonyms", SearchQuery(text="gizmo", limit=100), f"SELECT '{BASE}part/' || p_partkey AS id FROM part WHERE list_has_any({_WORDS}, ['gizmo', 'widget', 'bolt']) ORDER BY 1 LIMIT 100", [{"Gizmo", "widget", "bolt"}])
