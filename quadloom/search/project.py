"""Quads to documents: one row for each root of a type, by its declaration.

The fields of one step share one select of the quads and one grouping by root;
each longer path is a chain of joins of its own. So fields never multiply each other. "First" is the least by (ordinal, text): quads
carry an ordinal column ``ord`` or are ordered by their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.text import fold
from quadloom.functions.values import is_absolute_iri, language_tag, to_boolean, to_integer, to_number, unix_seconds
from quadloom.operators.quads import instances
from quadloom.search.schema import Field, SearchSchema, SearchType


def with_order(quads: DataFrame) -> DataFrame:
    return quads if "ord" in quads.columns else quads.withColumn("ord", F.lit(0))


def follow(quads: DataFrame, roots: DataFrame, path: tuple[str, ...]) -> DataFrame:
    """(root, value, kind, dt, lang, ord) at the end of a path; a step that starts with ^ goes backwards, p|q takes either."""
    at = roots.select(F.col("root"), F.col("root").alias("node"))
    for i, step in enumerate(path):
        back, names = step.startswith("^"), step.removeprefix("^").split("|")
        hop = quads.where(F.col("p").isin(names))
        if back:
            hop = hop.select(F.col("o").alias("__from"), F.col("s").alias("value"), F.col("s_kind").alias("kind"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"), "ord")
        else:
            hop = hop.select(F.col("s").alias("__from"), F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"), "ord")
        at = at.join(hop, F.col("node") == F.col("__from"))
        last = i == len(path) - 1
        at = at.select("root", "value", "kind", "dt", "lang", "ord") if last else at.select("root", F.col("value").alias("node"))
    return at.distinct()


def key_of(candidates: Column, node: Column, pick=None) -> Column:
    """A document's key: of its distinct absolute IRIs in order, the picked or the first; else its own IRI."""
    held = F.array_sort(F.array_distinct(F.filter(candidates, is_absolute_iri)))
    chosen = F.try_element_at(held, F.lit(1)) if pick is None else pick(held)
    return F.coalesce(F.when(F.array_contains(held, chosen), chosen), node)


def _entry(f: Field) -> Column:
    """(ord, value, lang) of a row of ``follow`` as a field has it, transformed; null if it is none. Of a reference only absolute IRIs."""
    value = F.col("value") if f.transform is None else f.transform(F.col("value"))
    ok = value.isNotNull()
    if f.kind == "reference" and not f.inline:
        ok = ok & (F.col("kind") != "bnode") & is_absolute_iri(value)
    return F.when(ok, F.struct("ord", value.alias("value"), F.coalesce(language_tag(F.lower("lang")), F.lit("und")).alias("lang")))


def _values(rows: DataFrame, f: Field) -> DataFrame:
    """(root, values): the field's texts in order."""
    rows = rows.select("root", _entry(f).alias("entry")).where("entry is not null")
    return rows.groupBy("root").agg(F.array_sort(F.collect_set("entry")).alias("values"))


def _one_step(quads: DataFrame, fields: list[Field]) -> DataFrame:
    """(root, a list for each field): what stands one step from a node, by one select and one grouping."""
    names = [f.path[0].split("|") for f in fields]
    rows = quads.where(F.col("p").isin(sorted({n for x in names for n in x})))
    rows = rows.select(F.col("s").alias("root"), "p", F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_lang").alias("lang"), "ord")
    rows = rows.select("root", *(F.when(F.col("p").isin(x), _entry(f)).alias(f"__v_{f.name}") for f, x in zip(fields, names, strict=True)))
    held = rows.groupBy("root").agg(*(F.array_sort(F.collect_set(f"__v_{f.name}")).alias(f"__v_{f.name}") for f in fields))
    return held.select("root", *(F.when(F.size(f"__v_{f.name}") > 0, F.col(f"__v_{f.name}")).alias(f"__v_{f.name}") for f in fields))


def _columns(f: Field, values: str = "values") -> dict[str, Column]:
    """A field's columns from its sorted values."""
    texts = F.transform(values, lambda x: x["value"])
    first = F.try_element_at(texts, F.lit(1))
    if f.kind == "text":
        langs = F.array_distinct(F.transform(values, lambda x: x["lang"]))
        of = lambda lang: F.filter(values, lambda x: x["lang"] == lang)
        shown = F.map_from_entries(F.transform(langs, lambda lang: F.struct(lang.alias("key"), F.element_at(F.filter(values, lambda x: x["lang"] == lang), 1)["value"].alias("value"))))
        out = {f.name: shown}
        for x in f.locales:
            all_of = F.transform(of(F.lit(x)), lambda v: v["value"])
            if f.searchable:
                out[f"{f.name}_search_{x}"] = F.when(F.size(all_of) > 0, fold(F.trim(F.array_join(all_of, " "))))
            if f.sortable:
                out[f"{f.name}_sort_{x}"] = F.when(F.size(all_of) > 0, fold(F.try_element_at(all_of, F.lit(1))))
        return out
    if f.kind in ("keyword", "reference"):
        return {f.name: F.array_distinct(texts) if f.array else first}
    convert = {"integer": to_integer, "number": to_number, "boolean": to_boolean, "date": unix_seconds}[f.kind]
    if f.array:
        if f.kind == "date":  # a Pandas UDF does not run inside a list
            raise ValueError("a date field holds one date")
        return {f.name: F.array_compact(F.transform(texts, convert))}
    return {f.name: convert(first)}


def project(quads: DataFrame, schema: SearchSchema, search_type: SearchType, roots: DataFrame | None = None, dataset: str | None = None) -> DataFrame:
    """The documents of a type: ``id`` and a column for each field that has a role.

    roots (root): default the IRIs of the type's class. A keyed type has one
    document for each key, of the roots that share it the least.
    """
    quads = with_order(quads)
    if roots is None:
        roots = instances(quads, search_type.class_iri).select(F.col("s").alias("root"))
    out = roots.select("root").distinct()
    near = [f for f in search_type.fields if f.path and not f.from_value and not f.inline and len(f.path) == 1 and not f.path[0].startswith("^") and not (f.ref and schema.type(f.ref).key)]
    if near:
        out = out.join(_one_step(quads, near), "root", "left")
    for f in search_type.fields:
        if f in near:
            out = out.withColumns(_columns(f, f"__v_{f.name}"))
        elif f.from_value:
            out = out.withColumn(f.name, F.lit(dataset))
        elif f.path and f.inline:
            out = out.join(_inline(quads, schema, f, roots), "root", "left")
        elif f.path:
            held = _values(follow(quads, roots, f.path), f)
            target = schema.type(f.ref) if f.ref else None
            if target and target.key:
                held = _rekeyed(quads, held, target)
            out = out.join(held.select("root", *(c.alias(n) for n, c in _columns(f).items())), "root", "left")
    out = out.drop(*(f"__v_{f.name}" for f in near))
    for f in search_type.fields:
        if f.derive:
            value = f.derive({name: F.col(name) for name in out.columns}, {"dataset": F.lit(dataset)})
            if f.kind == "reference":
                value = F.when(is_absolute_iri(value), value)
            out = out.withColumn(f.name, value)
    key = F.col("root") if search_type.key is None else key_of(F.coalesce(F.col(search_type.key.field), F.array().cast("array<string>")), F.col("root"), search_type.key.pick)
    out = out.withColumn("id", key)
    roles = [f for f in search_type.fields if not f.internal]
    kept = [c for c in out.columns if any(c == f.name or c.startswith((f"{f.name}_search_", f"{f.name}_sort_")) for f in roles)]
    if search_type.key is None:
        return out.select("id", *kept)
    plain = F.struct("root")
    return out.groupBy("id").agg(F.min_by(F.struct(*kept), plain).alias("d")).select("id", "d.*")


def _rekeyed(quads: DataFrame, held: DataFrame, target: SearchType) -> DataFrame:
    """References into a keyed type by its documents' keys."""
    single = held.select("root", F.explode("values").alias("x")).select("root", "x.ord", "x.value", "x.lang")
    nodes = single.select(F.col("value").alias("root")).distinct()
    field = target.field(target.key.field)
    keys = follow(quads, nodes, field.path)
    keys = keys.groupBy("root").agg(F.collect_set("value").alias("c")).select(F.col("root").alias("__n"), key_of(F.col("c"), F.col("root"), target.key.pick).alias("__k"))
    named = single.join(keys, F.col("value") == F.col("__n"), "left").select("root", "ord", F.coalesce("__k", "value").alias("value"), "lang")
    return named.groupBy("root").agg(F.array_sort(F.collect_set(F.struct("ord", "value", "lang"))).alias("values"))


def _inline(quads: DataFrame, schema: SearchSchema, f: Field, roots: DataFrame) -> DataFrame:
    """(root, field): the referents' documents as structs; referents without any value go."""
    target = schema.type(f.ref)
    links = follow(quads, roots, f.path).select("root", F.col("value").alias("__ref"), "ord")
    docs = project(quads, schema, target, links.select(F.col("__ref").alias("root")).distinct())
    fields = [c for c in docs.columns if c != "id"]
    filled = reduce(Column.__or__, [F.col(c).isNotNull() for c in fields]) if fields else F.lit(True)
    docs = docs.where(filled).select(F.col("id").alias("__ref"), F.struct("id", *fields).alias("d"))
    joined = links.join(docs, "__ref")
    if f.array:
        order = F.array_sort(F.collect_list(F.struct("ord", "__ref", "d")), lambda a, b: F.when(F.struct(a["ord"], a["__ref"]) < F.struct(b["ord"], b["__ref"]), -1).when(F.struct(a["ord"], a["__ref"]) > F.struct(b["ord"], b["__ref"]), 1).otherwise(0))
        return joined.groupBy("root").agg(F.transform(order, lambda x: x["d"]).alias(f.name))
    return joined.groupBy("root").agg(F.min_by("d", F.struct("ord", "__ref")).alias(f.name))
