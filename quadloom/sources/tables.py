"""Quads from relational tables, and the tables themselves."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = f"{RDF}type"
LANG_STRING = f"{RDF}langString"
BASE = "urn:tpch:"
#: A quad: a term is its text, its kind (iri, bnode, literal) and, for literals, datatype and language.
QUAD_COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", "g", "dataset"]
TERM_COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]

#: Table: its class, the columns of its key, and foreign keys as column: table.
TABLES = {
    "region": ("Region", ["r_regionkey"], {}),
    "nation": ("Nation", ["n_nationkey"], {"n_regionkey": "region"}),
    "customer": ("Customer", ["c_custkey"], {"c_nationkey": "nation"}),
    "supplier": ("Supplier", ["s_suppkey"], {"s_nationkey": "nation"}),
    "part": ("Part", ["p_partkey"], {}),
    "orders": ("Order", ["o_orderkey"], {"o_custkey": "customer"}),
    "lineitem": ("LineItem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "documents": ("Document", ["doc_id"], {}),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iri(table_name: str, *keys: Column) -> Column:
    return F.concat(F.lit(f"{BASE}{table_name}/"), F.concat_ws("-", *(k.cast("string") for k in keys)))


def _object(column: str, kind: str) -> tuple[Column, str | None]:
    """A column's value as text, and its datatype."""
    if kind in ("int", "bigint"):
        return F.col(column).cast("string"), f"{XSD}integer"
    if kind == "double":
        return F.col(column).cast("decimal(18,2)").cast("string"), f"{XSD}decimal"
    if kind.startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd"), f"{XSD}date"
    return F.col(column), f"{XSD}string"


#: Keys of a table that several rows share, by session and path: what a look at the key columns once found.
_repeated: dict[tuple[str, str], DataFrame | None] = {}
#: Repeated keys up to which they are sent to every executor.
BROADCAST_KEYS = 1_000_000


def repeated_keys(spark: SparkSession, path: str, key: list[str]) -> DataFrame | None:
    """The keys that several rows of a table share; None if there are none. Only the key columns are read, once a session."""
    at = (spark.sparkContext.applicationId, path)
    if at not in _repeated:
        from quadloom.plans.tables import checkpointed, dealt, suspects

        rows = suspects(spark.read.parquet(path).select(*key))
        found = None if rows is None else checkpointed(dealt(rows, key).groupBy(*key).count().where("count > 1").select(*key))
        n = 0 if found is None else found.count()
        _repeated[at] = None if n == 0 else F.broadcast(found) if n <= BROADCAST_KEYS else found
    return _repeated[at]


class Part(NamedTuple):
    """The triples of one column: one a row at most."""

    p: str
    o: Column
    kind: str
    dt: str | None
    lang: Column
    #: What it reads besides the key.
    columns: list[str]
    #: What tells objects apart before they are text: an integer (i, one text each), a day (t), a number (d) or the text itself (v).
    raw: tuple[str, Column]
    #: The table whose rows the objects are; None: they are no subjects.
    target: str | None = None

    @property
    def present(self) -> Column:
        """Whether a row has the triple, without making the text where a number tells."""
        kind, value = self.raw
        if kind == "i" and self.target:
            return F.lit(True)  # without a key it is the IRI of none
        # numbers that surely are decimals of that size need no cast
        return F.when(F.abs(value) < 1e15, True).otherwise(value.cast("decimal(18,2)").isNotNull()) if kind == "d" else value.isNotNull()


class TableRows(NamedTuple):
    """A table as entities: a row is a subject, its columns are properties."""

    name: str
    path: str
    rows: DataFrame
    key: list[str]
    subject: Column
    parts: list[Part]
    #: The classes of a row, each with its condition (None: every row).
    classes: list[tuple[str, Column | None]]

    @property
    def space(self) -> str | None:
        """The namespace of all its subjects: integers and what joins them end none; None for keys of other kinds."""
        return f"{BASE}{self.name}/" if all(kind in ("int", "bigint") for column, kind in self.rows.dtypes if column in self.key) else None

    def split(self) -> tuple[DataFrame, DataFrame | None]:
        """The rows that have a key to themselves, and those that share one (None: there are none)."""
        # lineitem alone has no key of its own
        repeated = repeated_keys(self.rows.sparkSession, self.path, self.key) if self.name == "lineitem" else None
        return (self.rows, None) if repeated is None else (self.rows.join(repeated, self.key, "left_anti"), self.rows.join(repeated, self.key, "left_semi"))

    def projected(self, held: DataFrame, x: Part) -> DataFrame:
        out = held.select(self.subject.alias("s"), F.lit("iri").alias("s_kind"), F.lit(x.p).alias("p"), x.o.alias("o"), F.lit(x.kind).alias("o_kind"), F.lit(x.dt).cast("string").alias("o_dt"), x.lang.alias("o_lang"), F.lit(f"{BASE}graph/{self.name}").alias("g"), F.lit(f"{BASE}dataset").alias("dataset"))
        return out.where("o is not null").select(*QUAD_COLUMNS)

    def merged(self, again: DataFrame) -> list[DataFrame]:
        """The quads of rows that share keys, a set."""
        return [self.projected(again.select(*dict.fromkeys([*self.key, *x.columns])).distinct(), x) for x in self.parts]


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> TableRows:
    """One type triple a row and one triple for each column that is not null; foreign keys are IRIs.

    A document has a second type and language-tagged text under one of the two spellings of the
    schema.org namespace (by the parity of its id), and a license.
    """
    rows = table(spark, sf_dir, name)
    class_name, key, foreign = TABLES[name]
    null = F.lit(None).cast("string")

    def of_text(p: str, o: Column, kind: str, dt: str | None, lang: Column, columns: list[str], target: str | None = None) -> Part:
        return Part(p, o, kind, dt, lang, columns, ("v", o.cast("string")), target)

    parts = [of_text(RDF_TYPE, F.lit(f"{BASE}class/{class_name}"), "iri", None, null, [])]
    classes: list[tuple[str, Column | None]] = [(f"{BASE}class/{class_name}", None)]
    for column, kind in rows.dtypes:
        p = f"{BASE}prop/{column}"
        if column in foreign:
            x = of_text(p, iri(foreign[column], F.col(column)), "iri", None, null, [column], foreign[column])
        elif (name, column) not in (("documents", "text"), ("documents", "lang")):
            o, dt = _object(column, kind)
            x = of_text(p, o, "literal", dt, null, [column])
        else:
            continue
        if kind in ("int", "bigint"):
            x = x._replace(raw=("i", F.col(column).cast("bigint")))
        elif kind == "double" and column not in foreign:
            x = x._replace(raw=("d", F.col(column)))
        elif kind.startswith("timestamp") and column not in foreign:
            x = x._replace(raw=("t", F.unix_date(F.col(column).cast("date")).cast("bigint")))
        parts.append(x)
    if name == "documents":
        for parity, space in enumerate(("https://schema.org/", "http://schema.org/")):
            own = F.col("doc_id") % 2 == parity
            classes.append((f"{space}CreativeWork", own))
            parts += [
                of_text(RDF_TYPE, F.when(own, F.lit(f"{space}CreativeWork")), "iri", None, null, []),
                of_text(f"{space}text", F.when(own, F.col("text")), "literal", LANG_STRING, F.col("lang"), ["text", "lang"]),
                of_text(f"{space}license", F.when(own, F.concat(F.lit(f"{BASE}license/"), F.col("lang"))), "iri", None, null, ["lang"]),
            ]
    return TableRows(name, f"{sf_dir}/{name}.parquet", rows, key, iri(name, *(F.col(k) for k in key)), parts, classes)


def table_quads(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The quads of a table's rows.

    Each column is a projection of its own with constant predicate, kind and datatype: a filter on
    these leaves out whole projections while planning, and a scan reads the key and one column.
    Rows that share a key merge, as a set of triples does; only they are made distinct.
    """
    x = table_rows(spark, sf_dir, name)
    once, again = x.split()
    return reduce(DataFrame.unionByName, [x.projected(once, p) for p in x.parts] + ([] if again is None else x.merged(again)))


def quads_from_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """The quads of the tables, a set."""
    return reduce(DataFrame.unionByName, [table_quads(spark, sf_dir, n) for n in names or list(TABLES)])
