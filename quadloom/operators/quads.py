"""Operators on quads: set semantics, scoping, rewriting, blank nodes, serialising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.plans.tables import dealt
from quadloom.sources.tables import LANG_STRING, QUAD_COLUMNS, TERM_COLUMNS, XSD


def dedupe(quads: DataFrame) -> DataFrame:
    """Triples as a set.

    Quads are dealt by all their columns first: copies come from different scans, so a task that looks for them in its own
    split would hold all of it and find few. The dealing holds no rows, and its parts are as many as the files' bytes ask for.
    """
    keys = TERM_COLUMNS + [c for c in ("g", "dataset") if c in quads.columns]
    return dealt(quads, keys).dropDuplicates(keys)


def in_graph(quads: DataFrame, graph: str | None) -> DataFrame:
    return quads if graph is None else quads.where(F.col("g") == graph)


def of_subjects(quads: DataFrame, subjects: DataFrame) -> DataFrame:
    """The triples of the subjects (column s): a subject filter, before any aggregate."""
    return quads.join(subjects.select("s").distinct(), "s", "left_semi")


def bind(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Rows whose shared columns are among values: a semi join, which Catalyst pushes below aggregates."""
    shared = [c for c in values.columns if c in rows.columns]
    return rows.join(values.select(*shared).distinct(), shared, "left_semi")


def canonical_iri(column: Column, aliases: dict[str, str]) -> Column:
    """The first alias namespace that a text starts with gives way to its canonical one."""
    out = F.when(F.lit(False), column)
    for alias, canonical in aliases.items():
        out = out.when(column.startswith(alias), F.concat(F.lit(canonical), F.substring(column, len(alias) + 1, 1 << 30)))
    return out.otherwise(column)


def alias_variants(iri: str, aliases: dict[str, str]) -> list[str]:
    """All spellings of an IRI: its own, the canonical one, and each alias of that."""
    own = next((c + iri[len(a) :] for a, c in aliases.items() if iri.startswith(a)), iri)
    out = [iri, own] + [a + own[len(c) :] for a, c in aliases.items() if own.startswith(c)]
    return list(dict.fromkeys(out))


def normalize_namespaces(quads: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Subjects, predicates and objects that are IRIs in the canonical namespaces."""
    return quads.withColumns(
        {
            "s": F.when(F.col("s_kind") == "iri", canonical_iri(F.col("s"), aliases)).otherwise(F.col("s")),
            "p": canonical_iri(F.col("p"), aliases),
            "o": F.when(F.col("o_kind") == "iri", canonical_iri(F.col("o"), aliases)).otherwise(F.col("o")),
        }
    )


def _escaped(text: Column) -> Column:
    pairs = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), pairs, text)


def term_text(value: Column, kind: Column, dt: Column | None = None, lang: Column | None = None) -> Column:
    """A term in N-Triples."""
    node = F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "bnode", F.concat(F.lit("_:"), value))
    if dt is None:
        return node
    quoted = F.concat(F.lit('"'), _escaped(value), F.lit('"'))
    tagged = F.concat(quoted, F.lit("@"), lang)
    typed = F.when(dt.isNull() | (dt == f"{XSD}string"), quoted).otherwise(F.concat(quoted, F.lit("^^<"), dt, F.lit(">")))
    return node.otherwise(F.when(lang.isNotNull() & (lang != ""), tagged).otherwise(typed))


def serialize(quads: DataFrame, graph: bool = False) -> DataFrame:
    """One column ``value``: N-Triples lines, or N-Quads with graph."""
    parts = [term_text(F.col("s"), F.col("s_kind")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), term_text(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))]
    if graph:
        parts.append(F.when(F.col("g").isNotNull(), F.concat(F.lit("<"), F.col("g"), F.lit(">"))))
    return quads.select(F.concat(F.concat_ws(" ", *parts), F.lit(" .")).alias("value"))


def turtle(quads: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(s, value): Turtle, one block a subject; prefixes (name: namespace) stand first in each file that is made of it."""
    def short(iri: Column) -> Column:
        out = F.when(F.lit(False), iri)
        for name, space in (prefixes or {}).items():
            local = F.substring(iri, len(space) + 1, 1 << 30)
            out = out.when(iri.startswith(space) & local.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(f"{name}:"), local))
        return out.otherwise(F.concat(F.lit("<"), iri, F.lit(">")))

    from quadloom.sources.tables import RDF_TYPE

    p = F.when(F.col("p") == RDF_TYPE, "a").otherwise(short(F.col("p")))
    o = F.when(F.col("o_kind") == "iri", short(F.col("o"))).otherwise(term_text(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")))
    s = F.when(F.col("s_kind") == "bnode", F.concat(F.lit("_:"), F.col("s"))).otherwise(short(F.col("s")))
    rows = quads.select(s.alias("s"), p.alias("p"), o.alias("o")).distinct()
    each = rows.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), ", ").alias("os"))
    return each.groupBy("s").agg(F.concat(F.col("s"), F.lit(" "), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "os"))), " ;\n    "), F.lit(" .")).alias("value"))


def turtle_head(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {name}: <{space}> .\n" for name, space in prefixes.items())


def skolemize(quads: DataFrame) -> DataFrame:
    """Blank nodes become IRIs under their dataset: a fingerprint of its blank triples, then the label.

    The fingerprint is a sum of line hashes, so it needs no order and no list of a dataset's lines.
    """
    line = F.concat_ws(" ", F.coalesce(F.col("dataset"), F.lit("")), "s", "p", "o", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit("")))
    has_blank = (F.col("s_kind") == "bnode") | (F.col("o_kind") == "bnode")
    marks = quads.where(has_blank).groupBy("dataset").agg(F.sum(F.xxhash64(line).cast("decimal(38,0)")).cast("string").alias("__mark"))
    held = quads.join(marks.withColumnRenamed("dataset", "__d"), F.col("dataset").eqNullSafe(F.col("__d")), "left").drop("__d")

    def named(value: str, kind: str) -> Column:
        label = F.md5(F.concat_ws("-", F.coalesce(F.col("__mark"), F.lit("")), F.col(value)))
        return F.when(F.col(kind) == "bnode", F.concat(F.coalesce(F.col("dataset"), F.lit("urn:dataset")), F.lit("/.well-known/genid/"), label)).otherwise(F.col(value))

    iri_kind = lambda kind: F.when(F.col(kind) == "bnode", F.lit("iri")).otherwise(F.col(kind))
    out = held.select(*[c for c in quads.columns if c not in ("s", "o", "s_kind", "o_kind")], named("s", "s_kind").alias("s"), named("o", "o_kind").alias("o"), iri_kind("s_kind").alias("s_kind"), iri_kind("o_kind").alias("o_kind"))
    return out.select(*quads.columns)


def blank_nodes(quads: DataFrame) -> DataFrame:
    return quads.where((F.col("s_kind") == "bnode") | (F.col("o_kind") == "bnode"))


def assert_no_blank_nodes(quads: DataFrame) -> DataFrame:
    """quads as they are; a blank node fails the job that meets it."""
    message = F.concat(F.lit("blank node in triple of "), F.col("s"))
    checked = F.when((F.col("s_kind") == "bnode") | (F.col("o_kind") == "bnode"), F.raise_error(message).cast("string")).otherwise(F.col("s"))
    return quads.withColumn("s", checked)


def instances(quads: DataFrame, class_iri: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Subjects (s) of a class in any spelling, blank nodes left out."""
    from quadloom.sources.tables import RDF_TYPE

    wanted = alias_variants(class_iri, aliases or {})
    return quads.where((F.col("p") == RDF_TYPE) & F.col("o").isin(wanted) & (F.col("s_kind") == "iri")).select("s").distinct()


def construct(rows: DataFrame, template: list[tuple]) -> DataFrame:
    """A CONSTRUCT template: (subject, predicate, object) of columns or IRIs; a row with an unbound term skips that triple.

    An object may be a Column (a literal) or ("iri", Column or text).
    """
    made = []
    for s, p, o in template:
        kind, value = ("iri", o[1]) if isinstance(o, tuple) else ("literal", o)
        text = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(x)
        made.append(F.struct(text(s).alias("s"), text(p).alias("p"), text(value).alias("o"), F.lit(kind).alias("o_kind")))
    out = rows.select(F.explode(F.array(*made)).alias("t")).select("t.*").where("s is not null and p is not null and o is not null").distinct()
    null = F.lit(None).cast("string")
    dt = F.when(F.col("o_kind") == "literal", F.when(F.col("o").rlike("^[0-9]+$"), F.lit(f"{XSD}integer")).otherwise(F.lit(f"{XSD}string")))
    return out.select("s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", dt.alias("o_dt"), null.alias("o_lang"), null.alias("g"), null.alias("dataset")).select(*QUAD_COLUMNS)


__all__ = ["LANG_STRING", "alias_variants", "assert_no_blank_nodes", "bind", "blank_nodes", "canonical_iri", "construct", "dedupe", "in_graph", "instances", "normalize_namespaces", "of_subjects", "serialize", "skolemize", "term_text"]
