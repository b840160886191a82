"""Search, facet and projection queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.text import fold, fold_western
from quadloom.functions.values import to_boolean, to_integer, to_number, unix_seconds
from quadloom.search.engine import SearchEngine
from quadloom.search.project import project
from quadloom.search.query import Criterion, Filter, SearchQuery, Sort, where, where_from_dict
from quadloom.search.schema import Field, Key, Range, SearchSchema, SearchType
from quadloom.sources.tables import BASE, iri, quads_from_tables, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SIZES = (Range("small", None, 10), Range("medium", 10, 30), Range("large", 30, None), Range("teens", 10, 20))
_NAME = Field("name", "text", path=(f"{BASE}prop/x",), output=True, searchable=3, sortable=True, locales=("en",))
SCHEMA = SearchSchema((
    SearchType("Region", (Field("label", "keyword", output=True, filterable=True),), class_iri=f"{BASE}class/Region"),
    SearchType("Nation", (Field("label", "keyword", output=True, filterable=True), Field("region", "reference", ref="Region", label_source=True, joinable=True, output=True)), class_iri=f"{BASE}class/Nation"),
    SearchType("Customer", (
        _NAME, Field("segment", "keyword", output=True, filterable=True, facetable=True), Field("balance", "number", filterable=True, output=True),
        Field("nation", "reference", ref="Nation", label_source=True, joinable=True, facetable=True, filterable=True, output=True),
    ), class_iri=f"{BASE}class/Customer"),
    SearchType("Order", (
        Field("status", "keyword", output=True, filterable=True, facetable=True), Field("priority", "keyword", output=True, filterable=True, facetable=True, searchable=2),
        Field("placed", "date", output=True, filterable=True, sortable=True), Field("urgent", "boolean", output=True, filterable=True, facetable=True),
        Field("customer", "reference", ref="Customer", label_source=True, joinable=True, output=True),
    ), class_iri=f"{BASE}class/Order"),
    SearchType("Part", (
        _NAME, Field("brand", "keyword", output=True, filterable=True, facetable=True), Field("words", "keyword", array=True, filterable=True, facetable=True),
        Field("size", "integer", output=True, filterable=True, sortable=True, facetable=True, facet_ranges=SIZES),
    ), class_iri=f"{BASE}class/Part"),
))


def _named(rows: DataFrame, column: str) -> DataFrame:
    folded = fold(F.col(column))
    return rows.withColumns({"name": F.create_map(F.lit("en"), F.col(column)), "name_search_en": folded, "name_sort_en": folded})


def engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    read = lambda name: table(spark, sf_dir, name)
    orders = read("orders").select(
        iri("orders", F.col("o_orderkey")).alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)").alias("placed"), F.col("o_orderpriority").startswith("1").alias("urgent"), iri("customer", F.col("o_custkey")).alias("customer"),
    )
    customers = read("customer").withColumns({"id": iri("customer", F.col("c_custkey")), "segment": F.col("c_mktsegment"), "balance": F.col("c_acctbal"), "nation": iri("nation", F.col("c_nationkey"))})
    parts = read("part").withColumns({"id": iri("part", F.col("p_partkey")), "brand": F.col("p_brand"), "words": F.split("p_type", " "), "size": F.col("p_size").cast("long")})
    names = ["name", "name_search_en", "name_sort_en"]
    return SearchEngine(SCHEMA, {
        "Region": read("region").select(iri("region", F.col("r_regionkey")).alias("id"), F.col("r_name").alias("label")),
        "Nation": read("nation").select(iri("nation", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("label"), iri("region", F.col("n_regionkey")).alias("region")),
        "Customer": _named(customers, "c_name").select("id", *names, "segment", "balance", "nation"),
        "Order": orders,
        "Part": _named(parts, "p_name").select("id", *names, "brand", "words", "size"),
    })


def _hits(name: str, type_name: str, q: SearchQuery, columns: list[str], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).hits(type_name, q).select(*columns)
    ORACLE_SQL[name] = sql


def _total(name: str, type_name: str, q: SearchQuery, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).total(type_name, q)
    ORACLE_SQL[name] = sql


def _facets(name: str, type_name: str, q: SearchQuery, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).facets(type_name, q)
    ORACLE_SQL[name] = sql


_O = f"'{BASE}orders/' || o_orderkey AS id"
_hits("search_browse", "Order", SearchQuery(limit=15), ["id", "status", "priority"], f"SELECT {_O}, o_orderstatus AS status, o_orderpriority AS priority FROM orders ORDER BY id LIMIT 15")
_hits("search_text", "Part", SearchQuery(text="Lärge bolt", limit=50), ["id"], f"SELECT '{BASE}part/' || p_partkey AS id FROM part WHERE list_has_all(string_split(lower(p_name), ' '), ['large', 'bolt']) ORDER BY id LIMIT 50")
_hits("search_where_in", "Order", SearchQuery(where=where(Criterion("priority", in_=("1-URGENT", "2-HIGH")), Criterion("status", in_=("F",))), limit=100), ["id", "priority"], f"SELECT {_O}, o_orderpriority AS priority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' ORDER BY id LIMIT 100")
_total("search_where_in_array", "Part", SearchQuery(where=where(Criterion("words", in_=("STEEL", "BRASS")))), "SELECT count(*) AS total FROM part WHERE list_has_any(string_split(p_type, ' '), ['STEEL', 'BRASS'])")
_total("search_where_range", "Part", SearchQuery(where=where(Criterion("size", range_=(10, 20)))), "SELECT count(*) AS total FROM part WHERE p_size BETWEEN 10 AND 20")
_total("search_where_range_open", "Part", SearchQuery(where=where(Criterion("size", range_=(None, 7)))), "SELECT count(*) AS total FROM part WHERE p_size <= 7")
_total("search_where_date", "Order", SearchQuery(where=where(Criterion("placed", range_=("1995-01-01", "1996-06-30")))), "SELECT count(*) AS total FROM orders WHERE epoch(o_orderdate) BETWEEN epoch(TIMESTAMP '1995-01-01') AND epoch(TIMESTAMP '1996-06-30')")
_total("search_where_is", "Order", SearchQuery(where=where(Criterion("urgent", is_=True))), "SELECT count(*) AS total FROM orders WHERE o_orderpriority LIKE '1%'")
_total("search_where_or", "Order", SearchQuery(where=where(Filter((Criterion("status", in_=("P",)), Criterion("urgent", is_=True))))), "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority LIKE '1%'")
_total("search_where_nested", "Order", SearchQuery(where=where_from_dict({"or": [{"status": {"in": ["O"]}}, {"urgent": {"is": True}}], "customer": {"where": {"segment": {"in": ["BUILDING"]}}}}, frozenset({"customer"}))), "SELECT count(*) AS total FROM orders WHERE (o_orderstatus = 'O' OR o_orderpriority LIKE '1%') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_hits("search_id_lookup", "Order", SearchQuery(where=where(Criterion("id", in_=(f"{BASE}orders/1", f"{BASE}orders/7", f"{BASE}orders/none")))), ["id", "status"], f"SELECT {_O}, o_orderstatus AS status FROM orders WHERE o_orderkey IN (1, 7)")
_total("search_vacuous", "Order", SearchQuery(where=where(Filter((Criterion("status", in_=()), Criterion("urgent", is_=True))), Criterion("placed", range_=(None, None)))), "SELECT count(*) AS total FROM orders")
_total("search_unsatisfiable", "Order", SearchQuery(where=where(Criterion("id", in_=()))), "SELECT count(*) AS total FROM orders WHERE false")
_total("search_join_1", "Order", SearchQuery(where=where(Criterion("segment", in_=("MACHINERY",), on=("customer",)))), "SELECT count(*) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
_total("search_join_3", "Order", SearchQuery(where=where(Criterion("label", in_=("ASIA",), on=("customer", "nation", "region")))), "SELECT count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_total("search_join_in_or", "Order", SearchQuery(where=where(Filter((Criterion("label", in_=("EUROPE",), on=("customer", "nation", "region")), Criterion("status", in_=("P",)))))), "SELECT count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' OR o_orderstatus = 'P'")
_hits("search_sort_localized", "Part", SearchQuery(order_by=(Sort("name", True),), locale="nl", limit=12), ["id", "size"], f"SELECT '{BASE}part/' || p_partkey AS id, p_size AS size FROM part ORDER BY lower(p_name) DESC, id LIMIT 12".replace("p_size AS", "CAST(p_size AS BIGINT) AS"))
_hits("search_page", "Order", SearchQuery(order_by=(Sort("placed"),), limit=10, offset=25), ["id", "placed"], f"SELECT {_O}, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS placed FROM orders ORDER BY placed, id LIMIT 10 OFFSET 20")

_facets("facet_plain", "Order", SearchQuery(where=where(Criterion("placed", range_=("1996-01-01", None))), facets=("status", "priority")), """
    SELECT 'status' AS field, o_orderstatus AS value, count(*) AS count, NULL::DOUBLE AS min, NULL::DOUBLE AS max FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 2
    UNION ALL SELECT 'priority', o_orderpriority, count(*), NULL, NULL FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 2""")
_facets("facet_array", "Part", SearchQuery(facets=("words",)), "SELECT 'words' AS field, w AS value, count(*) AS count, NULL::DOUBLE AS min, NULL::DOUBLE AS max FROM (SELECT unnest(list_distinct(string_split(p_type, ' '))) AS w FROM part) GROUP BY w ORDER BY count DESC, value LIMIT 10")
_facets("facet_range", "Part", SearchQuery(facets=("size",)), """
    SELECT 'size' AS field, b.key AS value, count(*) AS count, b.lo::DOUBLE AS min, b.hi::DOUBLE AS max
    FROM part JOIN (VALUES ('small', NULL, 10), ('medium', 10, 30), ('large', 30, NULL), ('teens', 10, 20)) b(key, lo, hi) ON (b.lo IS NULL OR p_size >= b.lo) AND (b.hi IS NULL OR p_size < b.hi) GROUP BY ALL""")
_facets("facet_boolean", "Order", SearchQuery(facets=("urgent",)), "SELECT 'urgent' AS field, CASE WHEN o_orderpriority LIKE '1%' THEN 'true' ELSE 'false' END AS value, count(*) AS count, NULL::DOUBLE AS min, NULL::DOUBLE AS max FROM orders GROUP BY 2")
_facets("facet_skip_own", "Order", SearchQuery(where=where(Criterion("status", in_=("F",)), Criterion("urgent", is_=True), Criterion("segment", in_=("BUILDING",), on=("customer",))), facets=("status", "priority")), """
    WITH x AS (SELECT *, o_orderstatus = 'F' AS a, o_orderpriority LIKE '1%' AS b, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS c FROM orders)
    SELECT 'status' AS field, o_orderstatus AS value, count(*) AS count, NULL::DOUBLE AS min, NULL::DOUBLE AS max FROM x WHERE b AND c GROUP BY 2
    UNION ALL SELECT 'priority', o_orderpriority, count(*), NULL, NULL FROM x WHERE a AND b AND c GROUP BY 2""")


def _register(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@_register(f"SELECT '{BASE}nation/' || n_nationkey AS value, n_name AS label, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY count DESC, value LIMIT 10")
def facet_reference_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    buckets = e.facets("Customer", SearchQuery(facets=("nation",))).select("value", "count", F.col("value").alias("nation"))
    return e.labels(buckets, SCHEMA.type("Customer").field("nation"), "label").select("value", F.col("nation_label").alias("label"), "count")


@_register(f"SELECT {_O}, '{BASE}customer/' || o_custkey AS customer, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY id LIMIT 20")
def lookup_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir).hits("Order", SearchQuery(resolve=(("customer", ("segment",)),)))
    return rows.select("id", F.col("customer.id").alias("customer"), F.col("customer.segment").alias("segment"))


@_register(f"SELECT '{BASE}nation/' || n_nationkey AS id, r_name AS region_label FROM nation JOIN region ON n_regionkey = r_regionkey")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return e.labels(e.tables["Nation"], SCHEMA.type("Nation").field("region"), "label").select("id", "region_label")


# -- projection

def _prop(name: str) -> str:
    return f"{BASE}prop/{name}"


_ORDER = SearchType("Order", (
    Field("status", "keyword", path=(_prop("o_orderstatus"),), output=True), Field("placed", "date", path=(_prop("o_orderdate"),), output=True),
    Field("total", "number", path=(_prop("o_totalprice"),), output=True), Field("whole", "integer", path=(_prop("o_totalprice"),), output=True),
    Field("customer", "reference", path=(_prop("o_custkey"),), ref="Customer", output=True), Field("segment", "keyword", path=(_prop("o_custkey"), _prop("c_mktsegment")), output=True),
), class_iri=f"{BASE}class/Order")
_CUSTOMER = SearchType("Customer", (
    Field("name", "keyword", path=(_prop("c_name"),), output=True), Field("orders", "reference", path=(f"^{_prop('o_custkey')}",), array=True, output=True),
    Field("upper", "keyword", output=True, derive=lambda doc, context: F.upper(doc["name"])), Field("dataset", "keyword", output=True, from_value="dataset"),
    Field("hidden", "keyword", path=(_prop("c_mktsegment"),)),
), class_iri=f"{BASE}class/Customer")
_NATION = SearchType("Nation", (Field("label", "keyword", path=(_prop("n_name"),), output=True), Field("place", "reference", path=(_prop("n_regionkey"),), ref="Region", inline=True, output=True)), class_iri=f"{BASE}class/Nation")
_REGION = SearchType("Region", (Field("label", "keyword", path=(_prop("r_name"),), output=True),))
_DOCUMENT = SearchType("CreativeWork", (Field("text", "text", path=("https://schema.org/text|http://schema.org/text",), output=True, sortable=True, locales=("en",)), Field("source", "keyword", path=(_prop("source"),), output=True)), class_iri=f"{BASE}class/Document")
_KEYED = SearchType("Supplier", (Field("nation", "reference", path=(_prop("s_nationkey"),), array=True, output=True), Field("name", "keyword", path=(_prop("s_name"),), output=True)), class_iri=f"{BASE}class/Supplier", key=Key("nation"))
_PROJECTED = SearchSchema((_ORDER, _CUSTOMER, _NATION, _REGION, _DOCUMENT, _KEYED))


@_register(f"SELECT {_O}, o_orderstatus AS status, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS placed, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total, CAST(trunc(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) AS whole, '{BASE}customer/' || o_custkey AS customer, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(quads_from_tables(spark, sf_dir, ["orders", "customer"]), _PROJECTED, _ORDER)


@_register(f"SELECT '{BASE}customer/' || c_custkey AS id, c_name AS name, upper(c_name) AS upper, '{BASE}dataset' AS dataset, count(o_orderkey) AS n_orders, min('{BASE}orders/' || o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def project_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = project(quads_from_tables(spark, sf_dir, ["customer", "orders"]), _PROJECTED, _CUSTOMER, dataset=f"{BASE}dataset")
    return docs.select("id", "name", "upper", "dataset", F.coalesce(F.size(F.coalesce("orders", F.array())), F.lit(0)).cast("long").alias("n_orders"), F.array_min("orders").alias("first_order"))


@_register(f"SELECT '{BASE}nation/' || n_nationkey AS id, n_name AS label, '{BASE}region/' || n_regionkey AS place_id, r_name AS place_label FROM nation JOIN region ON n_regionkey = r_regionkey")
def project_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = project(quads_from_tables(spark, sf_dir, ["nation", "region"]), _PROJECTED, _NATION)
    return docs.select("id", "label", F.col("place.id").alias("place_id"), F.col("place.label").alias("place_label"))


@_register(f"SELECT '{BASE}documents/' || doc_id AS id, source, lang, md5(text) AS text_md5, CASE WHEN lang = 'en' THEN md5(replace(translate(lower(text), 'áàâäãåāéèêëēíìîïīóòôöõōúùûüūýÿñçšž', 'aaaaaaaeeeeeiiiiioooooouuuuuyyncsz'), 'ß', 'ss')) END AS sort_md5 FROM documents")
def project_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = project(quads_from_tables(spark, sf_dir, ["documents"]), _PROJECTED, _DOCUMENT)
    return docs.select("id", "source", F.map_keys("text")[0].alias("lang"), F.md5(F.map_values("text")[0]).alias("text_md5"), F.md5("text_sort_en").alias("sort_md5"))


@_register(f"SELECT '{BASE}nation/' || s_nationkey AS id, count(*) > 0 AS held FROM supplier GROUP BY s_nationkey")
def project_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(quads_from_tables(spark, sf_dir, ["supplier"]), _PROJECTED, _KEYED).select("id", F.col("name").isNotNull().alias("held"))


@_register("SELECT o_orderkey AS k, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS seconds, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 3661 AS offset_seconds FROM orders")
def project_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), unix_seconds(day).alias("seconds"), unix_seconds(F.concat(F.lit(" "), day, F.lit("T02:01:01.500+01:00 "))).alias("offset_seconds"))


@_register("SELECT part.p_partkey AS k, p_size AS whole, CAST(p_size AS DOUBLE) / 10 AS n, p_size > 20 AS flag FROM part")
def coerce_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    padded = F.concat(F.lit(" "), size, F.lit(".9 "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), to_integer(padded).cast("int").alias("whole"), to_number(F.concat(size, F.lit("e-1"))).alias("n"), to_boolean(F.when(F.col("p_size") > 20, "1").otherwise("no")).alias("flag"))


@_register("SELECT doc_id, md5(replace(translate(lower(text), 'áàâäãåāéèêëēíìîïīóòôöõōúùûüūýÿñçšž', 'aaaaaaaeeeeeiiiiioooooouuuuuyyncsz'), 'ß', 'ss')) AS folded FROM documents")
def fold_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))
