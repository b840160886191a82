"""SPARQL queries on data where kinds, datatypes and graphs clash, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.plans import sparql
from quadloom.queries import Query, _p, _quads_sql
from quadloom.sources.tables import BASE, QUAD_COLUMNS, XSD, quads_from_tables

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_PREFIX = f"PREFIX t: <{BASE}prop/> PREFIX c: <{BASE}class/> PREFIX s: <https://schema.org/> PREFIX xsd: <{XSD}> "
NOTE = f"{BASE}prop/note"


def _quads(spark: SparkSession, sf_dir: str, tables: list[str]) -> DataFrame:
    """The tables' quads; "twins" adds each customer's nation as a text, "copies" nations in a second graph."""
    t = quads_from_tables(spark, sf_dir, [n for n in tables if n not in ("twins", "copies")])
    extra = []
    if "twins" in tables:
        named = t.where(F.col("p") == f"{BASE}prop/c_nationkey")
        extra.append(named.withColumns({"p": F.lit(NOTE), "o_kind": F.lit("literal"), "o_dt": F.lit(f"{XSD}string")}))
    if "copies" in tables:
        extra.append(t.where(F.col("g") == f"{BASE}graph/nation").withColumn("g", F.lit(f"{BASE}graph/copy")))
    return reduce(DataFrame.unionByName, extra, t).select(*QUAD_COLUMNS)


def _with_sql(tables: list[str]) -> str:
    """A CTE x: the same quads in SQL."""
    parts = ["SELECT s, s_kind, p, o, o_kind, o_dt, o_lang, g FROM q"]
    if "twins" in tables:
        parts.append(f"SELECT s, s_kind, '{NOTE}', o, 'literal', '{XSD}string', NULL, g FROM q WHERE p = {_p('c_nationkey')}")
    if "copies" in tables:
        parts.append(f"SELECT s, s_kind, p, o, o_kind, o_dt, o_lang, '{BASE}graph/copy' FROM q WHERE g = '{BASE}graph/nation'")
    return _quads_sql(*(n for n in tables if n not in ("twins", "copies"))).rstrip() + f", x AS ({' UNION ALL '.join(parts)}) "


def _add(name: str, tables: list[str], text: str, sql: str, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: sparql.run(_quads(spark, sf_dir, tables), _PREFIX + text, **options)
    ORACLE_SQL[name] = _with_sql(tables) + sql


_add(
    "sparql_term_join", ["customer", "nation", "twins"],
    "SELECT ?customer ?name { ?customer t:c_nationkey|t:note ?n . ?n t:n_name ?name }",
    f"SELECT a.s AS customer, b.o AS name FROM x a JOIN x b ON a.o = b.s AND a.o_kind = 'iri' AND b.p = {_p('n_name')} WHERE a.p IN ({_p('c_nationkey')}, '{NOTE}')",
)
_add(
    "sparql_term_equality", ["customer", "twins"],
    "SELECT ?same (COUNT(*) AS ?n) { ?c t:c_nationkey ?a ; t:note ?b . BIND(IF(?a = ?b, 'same', IF(SAMETERM(STR(?a), ?b), 'text', 'other')) AS ?same) } GROUP BY ?same",
    f"SELECT 'text' AS same, CAST(count(*) AS VARCHAR) AS n FROM x WHERE p = {_p('c_nationkey')} HAVING count(*) > 0",
)
_add(
    "sparql_in_list", ["customer", "twins"],
    "SELECT ?c ?v { ?c t:c_nationkey|t:note ?v FILTER(?v IN (<urn:tpch:nation/3>, 'urn:tpch:nation/4')) }",
    f"SELECT s AS c, o AS v FROM x WHERE p IN ({_p('c_nationkey')}, '{NOTE}') AND (o = '{BASE}nation/3' AND o_kind = 'iri' OR o = '{BASE}nation/4' AND o_kind = 'literal')",
)
_add(
    "sparql_arithmetic", ["part"],
    "SELECT ?part (?size + 2 * 3 - 1 AS ?more) (?size / 4 AS ?quarter) (-?size AS ?less) { ?part t:p_size ?size }",
    f"SELECT s AS part, CAST(CAST(o AS INT) + 5 AS VARCHAR) AS more, rtrim(rtrim(CAST(CAST(CAST(o AS DECIMAL(18,2)) / 4 AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') AS quarter, CAST(-CAST(o AS INT) AS VARCHAR) AS less FROM q WHERE p = {_p('p_size')}",
)
_add(
    "sparql_compare", ["lineitem"],
    "SELECT (COUNT(*) AS ?n) { ?l t:l_quantity ?q ; t:l_linenumber ?k . FILTER(?q < ?k) }",
    f"SELECT CAST(count(*) AS VARCHAR) AS n FROM q a JOIN q b ON a.s = b.s AND b.p = {_p('l_linenumber')} WHERE a.p = {_p('l_quantity')} AND CAST(a.o AS DOUBLE) < CAST(b.o AS DOUBLE)",
)
_add(
    "sparql_min_max", ["part", "customer"],
    "SELECT ?p (MIN(?v) AS ?least) (MAX(?v) AS ?most) { VALUES ?p { t:p_size t:c_acctbal t:c_mktsegment } ?s ?p ?v } GROUP BY ?p",
    f"SELECT p, CASE WHEN any_value(o_dt) LIKE '%string' THEN min(o) ELSE arg_min(o, CAST(o AS DOUBLE)) END AS least, CASE WHEN any_value(o_dt) LIKE '%string' THEN max(o) ELSE arg_max(o, CAST(o AS DOUBLE)) END AS most "
    f"FROM (SELECT p, o, o_dt, TRY_CAST(o AS DOUBLE) AS v FROM q WHERE p IN ({_p('p_size')}, {_p('c_acctbal')}, {_p('c_mktsegment')})) GROUP BY p".replace("CAST(o AS DOUBLE))", "v)"),
)
_add(
    "sparql_having", ["orders"],
    "SELECT ?customer (COUNT(?order) AS ?orders) (SUM(?price) AS ?total) { ?order t:o_custkey ?customer ; t:o_totalprice ?price } GROUP BY ?customer HAVING (COUNT(?order) > 12) (AVG(?price) > 1000)",
    f"SELECT a.o AS customer, CAST(count(*) AS VARCHAR) AS orders, rtrim(rtrim(CAST(sum(CAST(b.o AS DECIMAL(18,2))) AS VARCHAR), '0'), '.') AS total FROM q a JOIN q b ON a.s = b.s AND b.p = {_p('o_totalprice')} WHERE a.p = {_p('o_custkey')} "
    "GROUP BY a.o HAVING count(*) > 12 AND avg(CAST(b.o AS DOUBLE)) > 1000",
)
_add(
    "sparql_group_expression", ["orders"],
    "SELECT ?year (COUNT(*) * 2 AS ?twice) { ?order t:o_orderdate ?day } GROUP BY (YEAR(?day) AS ?year)",
    f"SELECT substr(o, 1, 4) AS year, CAST(2 * count(*) AS VARCHAR) AS twice FROM q WHERE p = {_p('o_orderdate')} GROUP BY 1",
)
_add(
    "sparql_aggregate_expression", ["orders"],
    "SELECT ?status (MAX(?price) - MIN(?price) AS ?spread) { ?order t:o_orderstatus ?status ; t:o_totalprice ?price } GROUP BY ?status",
    f"SELECT a.o AS status, rtrim(rtrim(CAST(max(CAST(b.o AS DECIMAL(18,2))) - min(CAST(b.o AS DECIMAL(18,2))) AS VARCHAR), '0'), '.') AS spread FROM q a JOIN q b ON a.s = b.s AND b.p = {_p('o_totalprice')} WHERE a.p = {_p('o_orderstatus')} GROUP BY 1",
)
_add(
    "sparql_group_concat", ["nation", "region"],
    "SELECT ?region (GROUP_CONCAT(DISTINCT ?name; SEPARATOR='|') AS ?names) (SAMPLE(?name) AS ?one) { ?n t:n_regionkey/t:r_name ?region ; t:n_name ?name } GROUP BY ?region",
    f"SELECT c.o AS region, string_agg(DISTINCT a.o, '|' ORDER BY a.o) AS names, min(a.o) AS one FROM q a JOIN q b ON a.s = b.s AND b.p = {_p('n_regionkey')} JOIN q c ON b.o = c.s AND c.p = {_p('r_name')} WHERE a.p = {_p('n_name')} GROUP BY 1",
)
_add(
    "sparql_order_expression", ["customer"],
    "SELECT ?customer ?balance { ?customer t:c_acctbal ?balance } ORDER BY DESC(ABS(?balance)) ?customer LIMIT 12 OFFSET 3",
    f"SELECT s AS customer, o AS balance FROM q WHERE p = {_p('c_acctbal')} ORDER BY abs(CAST(o AS DOUBLE)) DESC, s LIMIT 12 OFFSET 3",
)
_add(
    "sparql_from_two", ["nation", "region", "copies"],
    f"SELECT ?p (COUNT(*) AS ?n) FROM <{BASE}graph/nation> FROM <{BASE}graph/copy> {{ ?s ?p ?o }} GROUP BY ?p",
    f"SELECT p, CAST(count(*) AS VARCHAR) AS n FROM (SELECT DISTINCT s, p, o FROM x WHERE g IN ('{BASE}graph/nation', '{BASE}graph/copy')) GROUP BY p",
)
_add(
    "sparql_graph_variable", ["nation", "region", "copies"],
    "SELECT ?g ?name ?region { GRAPH ?g { ?n t:n_name ?name ; t:n_regionkey ?r } ?r t:r_name ?region }",
    f"SELECT a.g, a.o AS name, c.o AS region FROM x a JOIN x b ON a.s = b.s AND a.g = b.g AND b.p = {_p('n_regionkey')} JOIN (SELECT DISTINCT s, p, o FROM x) c ON b.o = c.s AND c.p = {_p('r_name')} WHERE a.p = {_p('n_name')}",
)
_add(
    "sparql_from_named", ["nation", "region", "copies"],
    f"SELECT ?g (COUNT(*) AS ?n) FROM <{BASE}graph/region> FROM NAMED <{BASE}graph/copy> {{ ?r t:r_name ?region GRAPH ?g {{ ?nation t:n_regionkey ?r }} }} GROUP BY ?g",
    f"SELECT '{BASE}graph/copy' AS g, CAST(count(*) AS VARCHAR) AS n FROM q WHERE p = {_p('n_regionkey')} HAVING count(*) > 0",
)
_add(
    "sparql_optional_filter", ["customer", "orders"],
    "SELECT ?customer ?order { ?customer t:c_acctbal ?b OPTIONAL { ?order t:o_custkey ?customer ; t:o_totalprice ?price FILTER(?price > ?b * 40) } }",
    f"SELECT a.s AS customer, b.s AS \"order\" FROM q a LEFT JOIN (SELECT y.o AS c, y.s, z.o AS price FROM q y JOIN q z ON y.s = z.s AND z.p = {_p('o_totalprice')} WHERE y.p = {_p('o_custkey')}) b "
    f"ON a.s = b.c AND CAST(b.price AS DOUBLE) > 40 * CAST(a.o AS DOUBLE) WHERE a.p = {_p('c_acctbal')}",
)
_add(
    "sparql_optional_chain", ["customer", "orders", "nation"],
    "SELECT ?customer ?x { ?customer a c:Customer OPTIONAL { ?order t:o_custkey ?customer ; t:o_orderstatus 'P' BIND(?order AS ?x) } OPTIONAL { ?customer t:c_nationkey ?x } }",
    f"SELECT a.s AS customer, coalesce(b.s, n.o) AS x FROM ty a LEFT JOIN (SELECT y.s, y.o FROM q y JOIN q z ON y.s = z.s AND z.p = {_p('o_orderstatus')} AND z.o = 'P' WHERE y.p = {_p('o_custkey')}) b ON a.s = b.o "
    f"JOIN q n ON a.s = n.s AND n.p = {_p('c_nationkey')} WHERE a.class = '{BASE}class/Customer'",
)
_add(
    "sparql_exists_outer", ["orders"],
    "SELECT ?order { ?order t:o_totalprice ?price ; t:o_custkey ?c FILTER NOT EXISTS { ?other t:o_custkey ?c ; t:o_totalprice ?more FILTER(?more > ?price) } }",
    f"SELECT s AS \"order\" FROM (SELECT a.s, CAST(a.o AS DOUBLE) AS v, max(CAST(a.o AS DOUBLE)) OVER (PARTITION BY b.o) AS m FROM q a JOIN q b ON a.s = b.s AND b.p = {_p('o_custkey')} WHERE a.p = {_p('o_totalprice')}) WHERE v = m",
)
_add(
    "sparql_exists_or", ["customer", "orders"],
    "SELECT ?customer { ?customer t:c_mktsegment ?m FILTER(?m = 'BUILDING' || EXISTS { ?o t:o_custkey ?customer ; t:o_orderstatus 'P' }) }",
    f"SELECT s AS customer FROM q WHERE p = {_p('c_mktsegment')} AND (o = 'BUILDING' OR s IN (SELECT y.o FROM q y JOIN q z ON y.s = z.s AND z.p = {_p('o_orderstatus')} AND z.o = 'P' WHERE y.p = {_p('o_custkey')}))",
)
_add(
    "sparql_exists_unshared", ["region"],
    "SELECT ?r { ?r t:r_name ?name FILTER EXISTS { ?x t:r_name 'ASIA' } FILTER NOT EXISTS { ?y t:r_name 'NOWHERE' } }",
    f"SELECT s AS r FROM q WHERE p = {_p('r_name')}",
)
_add(
    "sparql_minus_rows", ["customer", "orders"],
    "SELECT ?customer { ?customer a c:Customer MINUS { ?order t:o_custkey ?customer ; t:o_orderpriority '1-URGENT' } }",
    f"SELECT s AS customer FROM ty WHERE class = '{BASE}class/Customer' AND s NOT IN (SELECT y.o FROM q y JOIN q z ON y.s = z.s AND z.p = {_p('o_orderpriority')} AND z.o = '1-URGENT' WHERE y.p = {_p('o_custkey')})",
)
_add(
    "sparql_path_optional", ["nation", "region"],
    "SELECT ?n ?x { ?n a c:Nation ; t:n_regionkey? ?x }",
    f"SELECT s AS n, s AS x FROM ty WHERE class = '{BASE}class/Nation' UNION ALL SELECT s, o FROM q WHERE p = {_p('n_regionkey')}",
)
_add(
    "sparql_path_negated", ["nation", "region"],
    "SELECT ?n ?o { ?n a c:Nation ; !(a|t:n_name|t:n_nationkey) ?o }",
    f"SELECT s AS n, o FROM q WHERE p = {_p('n_regionkey')}",
)
_add(
    "sparql_path_seeded", ["customer", "nation", "region"],
    "SELECT ?who { ?who (t:c_nationkey|t:n_regionkey)+ <urn:tpch:region/2> }",
    f"SELECT s AS who FROM q WHERE p = {_p('n_regionkey')} AND o = '{BASE}region/2' UNION ALL SELECT a.s FROM q a JOIN q b ON a.o = b.s AND b.p = {_p('n_regionkey')} AND b.o = '{BASE}region/2' WHERE a.p = {_p('c_nationkey')}",
)
_add(
    "sparql_path_star", ["nation", "region"],
    "SELECT ?n ?x { ?n t:n_name 'NATION_3' ; t:n_regionkey* ?x }",
    f"SELECT s AS n, s AS x FROM q WHERE p = {_p('n_name')} AND o = 'NATION_3' UNION ALL SELECT a.s, b.o FROM q a JOIN q b ON a.s = b.s AND b.p = {_p('n_regionkey')} WHERE a.p = {_p('n_name')} AND a.o = 'NATION_3'",
)
_add(
    "sparql_text_functions", ["supplier"],
    "SELECT ?s (STRBEFORE(?name, '#') AS ?before) (STRAFTER(?name, '#') AS ?after) (SUBSTR(?name, 2, 4) AS ?part) (REPLACE(?name, 'SUPP', 'x', 'i') AS ?other) (SHA1(?name) AS ?mark) (ENCODE_FOR_URI(?name) AS ?code) { ?s t:s_name ?name }",
    f"SELECT s, CASE WHEN contains(o, '#') THEN split_part(o, '#', 1) ELSE '' END AS before, CASE WHEN contains(o, '#') THEN substr(o, instr(o, '#') + 1) ELSE '' END AS after, substr(o, 2, 4) AS part, regexp_replace(o, 'SUPP', 'x', 'gi') AS other, sha1(o) AS mark, url_encode(o) AS code FROM q WHERE p = {_p('s_name')}",
)
_add(
    "sparql_number_functions", ["customer"],
    "SELECT ?c (ROUND(?b) AS ?round) (CEIL(?b) AS ?up) (FLOOR(?b) AS ?down) (xsd:integer(?b) AS ?cut) (ISNUMERIC(?b) AS ?number) { ?c t:c_acctbal ?b }",
    f"SELECT s AS c, CAST(CAST(floor(CAST(o AS DECIMAL(18,2)) + 0.5) AS BIGINT) AS VARCHAR) AS round, CAST(CAST(ceil(CAST(o AS DECIMAL(18,2))) AS BIGINT) AS VARCHAR) AS up, CAST(CAST(floor(CAST(o AS DECIMAL(18,2))) AS BIGINT) AS VARCHAR) AS down, regexp_replace(o, '\\..*$', '') AS cut, 'true' AS number FROM q WHERE p = {_p('c_acctbal')}",
)
_add(
    "sparql_dates", ["orders"],
    "SELECT ?month (COUNT(*) AS ?n) { ?o t:o_orderdate ?d FILTER(?d >= '1995-01-01'^^xsd:date && ?d < '1997-01-01'^^xsd:date) BIND(MONTH(?d) AS ?month) } GROUP BY ?month",
    f"SELECT CAST(CAST(substr(o, 6, 2) AS INT) AS VARCHAR) AS month, CAST(count(*) AS VARCHAR) AS n FROM q WHERE p = {_p('o_orderdate')} AND o >= '1995-01-01' AND o < '1997-01-01' GROUP BY 1",
)
_add(
    "sparql_languages", ["documents"],
    "SELECT ?tag (COUNT(*) AS ?n) { ?d s:text ?text FILTER(LANGMATCHES(LANG(?text), 'en') || LANG(?text) = 'de') BIND(UCASE(LANG(?text)) AS ?tag) } GROUP BY ?tag",
    "SELECT upper(o_lang) AS tag, CAST(count(*) AS VARCHAR) AS n FROM q WHERE p = 'https://schema.org/text' AND o_lang IN ('en', 'de') GROUP BY 1",
)
_add(
    "sparql_values_after", ["nation"],
    "SELECT ?n ?name ?mark { ?n t:n_name ?name } VALUES (?name ?mark) { ('NATION_3' 1) ('NATION_7' UNDEF) ('NATION_7' 2) }",
    f"SELECT s AS n, o AS name, mark FROM q JOIN (VALUES ('NATION_3', '1'), ('NATION_7', NULL), ('NATION_7', '2')) v(name, mark) ON q.o = v.name WHERE p = {_p('n_name')}",
)
_add(
    "sparql_distinct", ["customer", "twins"],
    "SELECT DISTINCT ?n { ?c t:c_nationkey|t:note ?n } ORDER BY ?n",
    f"SELECT o AS n FROM (SELECT DISTINCT o, o_kind FROM x WHERE p IN ({_p('c_nationkey')}, '{NOTE}'))",
)
_add(
    "sparql_describe", ["nation", "region"],
    "DESCRIBE ?r <urn:tpch:nation/3> { ?r t:r_name 'ASIA' }",
    f"SELECT s, s_kind, p, o, o_kind, o_dt, o_lang FROM q WHERE s = '{BASE}nation/3' OR s IN (SELECT s FROM q WHERE p = {_p('r_name')} AND o = 'ASIA')",
)
_add(
    "sparql_dataset_variable", ["nation"],
    "CONSTRUCT { ?dataset <urn:holds> ?n } WHERE { ?n a c:Nation }",
    f"SELECT '{BASE}dataset' AS s, 'iri' AS s_kind, 'urn:holds' AS p, s AS o, 'iri' AS o_kind, NULL AS o_dt, NULL AS o_lang FROM ty WHERE class = '{BASE}class/Nation'",
    dataset=f"{BASE}dataset",
)


def sparql_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads after a graph is cleared and data go and come."""
    text = _PREFIX + f"CLEAR GRAPH <urn:tpch:graph/copy> ; DELETE DATA {{ GRAPH <urn:tpch:graph/region> {{ <urn:tpch:region/1> t:r_name 'AMERICA' . <urn:tpch:region/2> t:r_name <urn:ASIA> }} }} ; INSERT DATA {{ GRAPH <urn:tpch:graph/region> {{ <urn:tpch:region/1> t:r_name 'AMERICAS' ; a c:Region }} <urn:a> <urn:b> 1 }}"
    return sparql.updated(_quads(spark, sf_dir, ["nation", "region", "copies"]), text).select("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", "g")


QUERIES["sparql_update"] = sparql_update
ORACLE_SQL["sparql_update"] = _quads_sql("nation", "region") + (
    f"SELECT * FROM q WHERE NOT (s = '{BASE}region/1' AND p = {_p('r_name')} AND o = 'AMERICA') "
    f"UNION ALL SELECT '{BASE}region/1', 'iri', {_p('r_name')}, 'AMERICAS', 'literal', '{XSD}string', NULL, '{BASE}graph/region' UNION ALL SELECT 'urn:a', 'iri', 'urn:b', '1', 'literal', '{XSD}integer', NULL, NULL"
)
