"""Shapes: what subjects of a class must look like, checked as aggregates, and samples of them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadloom.operators.quads import instances
from quadloom.operators.void import types
from quadloom.sources.tables import RDF, RDF_TYPE

SH = "http://www.w3.org/ns/shacl#"


@dataclass(frozen=True)
class PropertyShape:
    path: str
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    class_iri: str | None = None
    node_kind: str | None = None  # iri, bnode, literal
    in_values: tuple[str, ...] = ()
    pattern: str | None = None
    severity: str = "Violation"
    min_length: int | None = None
    max_length: int | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    min_exclusive: float | None = None
    max_exclusive: float | None = None
    language_in: tuple[str, ...] = ()
    unique_lang: bool = False
    has_value: str | None = None
    #: The value's own shape, or that of at least so many of the values.
    node: Shape | None = None
    qualified: Shape | None = None
    qualified_min: int | None = None
    qualified_max: int | None = None
    equals: str | None = None
    disjoint: str | None = None
    less_than: str | None = None


@dataclass(frozen=True)
class Shape:
    """What nodes must look like: those of a class, those that are subjects or objects of a property, or the ones named."""

    target_class: str | None
    properties: tuple[PropertyShape, ...] = ()
    #: Predicates that a closed shape admits besides its own; None: the shape is open.
    closed: tuple[str, ...] | None = None
    all_of: tuple[Shape, ...] = ()
    any_of: tuple[Shape, ...] = ()
    one_of: tuple[Shape, ...] = ()
    none_of: tuple[Shape, ...] = ()
    target_subjects_of: str | None = None
    target_objects_of: str | None = None
    target_nodes: tuple[str, ...] = ()
    severity: str = "Violation"


def sample_subjects(t: DataFrame, n: int, exclude: DataFrame | None = None) -> DataFrame:
    """(class, s): the first n subjects of each class by their text; exclude (s) takes some out.

    The rank is per class within each partition first, so a large class is cut before it is shuffled.
    """
    named = types(t.where("s_kind = 'iri'"))
    if exclude is not None:
        named = named.join(exclude.select("s").distinct(), "s", "left_anti")
    rank = F.row_number().over(W.partitionBy("class").orderBy("s"))
    return named.distinct().withColumn("n", rank).where(F.col("n") <= n).drop("n")


SCHEMA = "focus string, path string, constraint string, value string, severity string"


def targets(t: DataFrame, shape: Shape, aliases: dict[str, str] | None = None) -> DataFrame:
    """(focus): the nodes that a shape is for."""
    parts = []
    if shape.target_class:
        parts.append(instances(t, shape.target_class, aliases).select(F.col("s").alias("focus")))
    if shape.target_subjects_of:
        parts.append(t.where(F.col("p") == shape.target_subjects_of).select(F.col("s").alias("focus")))
    if shape.target_objects_of:
        parts.append(t.where((F.col("p") == shape.target_objects_of) & (F.col("o_kind") != "literal")).select(F.col("o").alias("focus")))
    if shape.target_nodes:
        parts.append(t.sparkSession.createDataFrame([(x,) for x in shape.target_nodes], "focus string"))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else t.sparkSession.createDataFrame([], "focus string")


def violations(t: DataFrame, shape: Shape, aliases: dict[str, str] | None = None, focus: DataFrame | None = None) -> DataFrame:
    """(focus, path, constraint, value, severity): one row for each failing value or count; focus: default the shape's targets."""
    focus = targets(t, shape, aliases) if focus is None else focus.select("focus").distinct()
    parts = [x for p in shape.properties for x in _of_property(t, focus, p, aliases)]
    if shape.closed is not None:
        own = [p.path for p in shape.properties] + list(shape.closed)
        other = t.where(~F.col("p").isin(own)).join(focus, F.col("s") == F.col("focus"), "left_semi")
        parts.append(other.select(F.col("s").alias("focus"), F.col("p").alias("path"), F.lit("closed").alias("constraint"), F.col("o").alias("value"), F.lit(shape.severity).alias("severity")))
    fits = lambda x: focus.join(violations(t, x, aliases, focus).select("focus").distinct(), "focus", "left_anti")
    for name, shapes, ok in (
        ("and", shape.all_of, lambda n, of: n == of), ("or", shape.any_of, lambda n, of: n >= 1), ("xone", shape.one_of, lambda n, of: n == 1), ("not", shape.none_of, lambda n, of: n == 0),
    ):
        if shapes:
            met = reduce(DataFrame.unionByName, [fits(x) for x in shapes]).groupBy("focus").agg(F.count("*").alias("n"))
            n = F.coalesce("n", F.lit(0))
            wrong = focus.join(met, "focus", "left").where(~ok(n, len(shapes)))
            null = F.lit(None).cast("string")
            parts.append(wrong.select("focus", null.alias("path"), F.lit(name).alias("constraint"), F.col("focus").alias("value"), F.lit(shape.severity).alias("severity")))
    return reduce(DataFrame.unionByName, parts) if parts else t.sparkSession.createDataFrame([], SCHEMA)


def _of_property(t: DataFrame, focus: DataFrame, shape: PropertyShape, aliases: dict[str, str] | None = None) -> list[DataFrame]:
    """A path is a property's IRI, ^ and one for its inverse, or several with / between them."""
    values = _along(t, focus, shape.path)

    def report(rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.select("focus", F.lit(shape.path).alias("path"), F.lit(name).alias("constraint"), value.cast("string").alias("value"), F.lit(shape.severity).alias("severity"))

    def counted(rows: DataFrame, least: int | None, most: int | None, names: tuple[str, str]) -> list[DataFrame]:
        n = F.coalesce("n", F.lit(0))
        each = focus.join(rows.groupBy("focus").agg(F.count("*").alias("n")), "focus", "left")
        found = [report(each.where(n < least), names[0], n)] if least is not None else []
        return found + ([report(each.where(n > most), names[1], n)] if most is not None else [])

    out = []
    if shape.min_count is not None or shape.max_count is not None:
        out += counted(values, shape.min_count, shape.max_count, ("minCount", "maxCount"))
    number, length, lang = F.col("o").try_cast("double"), F.length("o"), F.coalesce(F.lower("o_lang"), F.lit(""))
    text = F.col("o_kind") != "bnode"
    tests: list[tuple[str, Column]] = []
    if shape.datatype:
        tests.append(("datatype", (F.col("o_kind") == "literal") & (F.col("o_dt") == shape.datatype)))
    if shape.node_kind:
        tests.append(("nodeKind", F.col("o_kind") == shape.node_kind))
    if shape.in_values:
        tests.append(("in", F.col("o").isin(list(shape.in_values))))
    if shape.pattern:
        tests.append(("pattern", text & F.col("o").rlike(shape.pattern)))
    for name, limit, ok in (
        ("minLength", shape.min_length, lambda x: text & (length >= x)), ("maxLength", shape.max_length, lambda x: text & (length <= x)),
        ("minInclusive", shape.min_inclusive, lambda x: number >= x), ("maxInclusive", shape.max_inclusive, lambda x: number <= x),
        ("minExclusive", shape.min_exclusive, lambda x: number > x), ("maxExclusive", shape.max_exclusive, lambda x: number < x),
    ):
        if limit is not None:
            tests.append((name, ok(limit)))
    if shape.language_in:
        tests.append(("languageIn", reduce(Column.__or__, [(lang == x.lower()) | lang.startswith(f"{x.lower()}-") for x in shape.language_in])))
    out += [report(values.where(~F.coalesce(ok, F.lit(False))), name, F.col("o")) for name, ok in tests]
    if shape.class_iri:
        right = types(t).where(F.col("class") == shape.class_iri).select(F.col("s").alias("o"))
        out.append(report(values.join(right, "o", "left_anti"), "class", F.col("o")))
    if shape.unique_lang:
        twice = values.where(lang != "").groupBy("focus", lang.alias("lang")).count().where("count > 1")
        out.append(report(twice, "uniqueLang", F.col("lang")))
    if shape.has_value is not None:
        out.append(report(focus.join(values.where(F.col("o") == shape.has_value), "focus", "left_anti"), "hasValue", F.lit(shape.has_value)))
    nodes = values.where("o_kind <> 'literal'").select(F.col("o").alias("focus")).distinct()
    if shape.node:
        wrong = violations(t, shape.node, aliases, nodes).select(F.col("focus").alias("o")).distinct()
        out.append(report(values.where("o_kind = 'literal'").unionByName(values.where("o_kind <> 'literal'").join(wrong, "o", "left_semi").select(*values.columns)), "node", F.col("o")))
    if shape.qualified:
        wrong = violations(t, shape.qualified, aliases, nodes).select(F.col("focus").alias("o")).distinct()
        fitting = values.where("o_kind <> 'literal'").join(wrong, "o", "left_anti")
        out += counted(fitting, shape.qualified_min, shape.qualified_max, ("qualifiedMinCount", "qualifiedMaxCount"))
    term = ["focus", "o", "o_kind"]
    if shape.equals:
        other = _along(t, focus, shape.equals)
        out += [report(a.select(*term).join(b.select(*term), term, "left_anti"), "equals", F.col("o")) for a, b in ((values, other), (other, values))]
    if shape.disjoint:
        out.append(report(values.select(*term).join(_along(t, focus, shape.disjoint).select(*term), term, "left_semi"), "disjoint", F.col("o")))
    if shape.less_than:
        other = _along(t, focus, shape.less_than).select("focus", F.col("o").alias("__o"))
        a, b = F.col("o"), F.col("__o")
        less = F.coalesce(a.try_cast("double") < b.try_cast("double"), a < b)
        out.append(report(values.join(other, "focus").where(~less).select("focus", "o").distinct(), "lessThan", F.col("o")))
    return out


def _along(t: DataFrame, focus: DataFrame, path: str) -> DataFrame:
    """(focus, o, o_kind, o_dt, o_lang): the distinct values at the end of a path."""
    at, null = focus.select("focus", F.col("focus").alias("__at")), F.lit(None).cast("string")
    steps = re.split(r"/(?=\^?[A-Za-z][\w+.-]*:)", path)
    for step in steps:
        hop = t.where(F.col("p") == step.removeprefix("^"))
        if step.startswith("^"):
            hop = hop.where("o_kind <> 'literal'").select(F.col("o").alias("__from"), F.col("s").alias("o"), F.col("s_kind").alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"))
        else:
            hop = hop.select(F.col("s").alias("__from"), "o", "o_kind", "o_dt", "o_lang")
        found = at.join(hop, F.col("__at") == F.col("__from")).select("focus", "o", "o_kind", "o_dt", "o_lang").distinct()
        at = found.where("o_kind <> 'literal'").select("focus", F.col("o").alias("__at"))
    return found


def shapes_of(quads: DataFrame) -> list[Shape]:
    """The shapes that RDF states: node shapes with a target; a shapes graph is small, so its triples come to the driver."""
    held: dict[str, dict[str, list]] = {}
    for r in quads.select("s", "p", "o").collect():
        held.setdefault(r.s, {}).setdefault(r.p.removeprefix(SH) if r.p.startswith(SH) else r.p, []).append(r.o)
    of = lambda node, name: held.get(node, {}).get(name, [])
    one = lambda node, name, kind=str: kind(of(node, name)[0]) if of(node, name) else None

    def listed(node: str) -> list[str]:
        out: list[str] = []
        while node and node != f"{RDF}nil" and len(out) <= len(held):
            out += of(node, f"{RDF}first")
            node = next(iter(of(node, f"{RDF}rest")), "")
        return out

    def path(node: str) -> str:
        if inverse := of(node, "inversePath"):
            return f"^{inverse[0]}"
        return "/".join(map(path, listed(node))) if of(node, f"{RDF}first") else node

    def members(node: str, name: str, seen: tuple) -> tuple[Shape, ...]:
        return tuple(shape(x, seen) for head in of(node, name) for x in listed(head))

    def inner(node: str, name: str, seen: tuple) -> Shape | None:
        found = of(node, name)
        return shape(found[0], seen) if found and found[0] not in seen else None  # a shape that holds itself is not followed again

    def property_shape(node: str, seen: tuple) -> PropertyShape:
        kinds = {f"{SH}IRI": "iri", f"{SH}BlankNode": "bnode", f"{SH}Literal": "literal"}
        return PropertyShape(
            path(of(node, "path")[0]), one(node, "minCount", int), one(node, "maxCount", int), one(node, "datatype"), one(node, "class"), kinds.get(one(node, "nodeKind")),
            tuple(x for head in of(node, "in") for x in listed(head)), one(node, "pattern"), (one(node, "severity") or "Violation").removeprefix(SH), one(node, "minLength", int), one(node, "maxLength", int),
            one(node, "minInclusive", float), one(node, "maxInclusive", float), one(node, "minExclusive", float), one(node, "maxExclusive", float),
            tuple(x for head in of(node, "languageIn") for x in listed(head)), one(node, "uniqueLang") == "true", one(node, "hasValue"), inner(node, "node", seen), inner(node, "qualifiedValueShape", seen),
            one(node, "qualifiedMinCount", int), one(node, "qualifiedMaxCount", int), one(node, "equals"), one(node, "disjoint"), one(node, "lessThan"),
        )

    def shape(node: str, seen: tuple = ()) -> Shape:
        seen = (*seen, node)
        properties = tuple(property_shape(x, seen) for x in sorted(of(node, "property")) if x not in seen)
        if of(node, "path"):  # a property shape in place of a node shape
            properties += (property_shape(node, seen),)
        closed = tuple(x for head in of(node, "ignoredProperties") for x in listed(head)) if one(node, "closed") == "true" else None
        none_of = tuple(shape(x, seen) for x in of(node, "not") if x not in seen)
        return Shape(one(node, "targetClass"), properties, closed, members(node, "and", seen), members(node, "or", seen), members(node, "xone", seen), none_of,
                     one(node, "targetSubjectsOf"), one(node, "targetObjectsOf"), tuple(of(node, "targetNode")), (one(node, "severity") or "Violation").removeprefix(SH))

    names = ("targetClass", "targetSubjectsOf", "targetObjectsOf", "targetNode")
    return [shape(node) for node in sorted(held) if any(of(node, x) for x in names)]


def paths_of(shape: Shape) -> list[str]:
    """The paths that a shape looks at, those of the shapes in it continued by /, each once."""
    out: list[str] = []
    for p in shape.properties:
        out.append(p.path)
        out += [f"{p.path}/{x}" for held in (p.node, p.qualified) if held for x in paths_of(held)]
    out += [x for held in (*shape.all_of, *shape.any_of, *shape.one_of) for x in paths_of(held)]
    return list(dict.fromkeys(out))


def sample_quads(t: DataFrame, shape: Shape, n: int) -> DataFrame:
    """The triples of the first n targets, and those of every node on the way along the shape's paths."""
    focus = targets(t, shape).orderBy("focus").limit(n)
    nodes = [focus.select(F.col("focus").alias("s"))]
    for path in paths_of(shape):
        steps = re.split(r"/(?=\^?[A-Za-z][\w+.-]*:)", path)
        for i in range(1, len(steps) + 1):
            nodes.append(_along(t, focus, "/".join(steps[:i])).where("o_kind <> 'literal'").select(F.col("o").alias("s")))
    return t.join(reduce(DataFrame.unionByName, nodes).distinct(), "s", "left_semi").select(*t.columns)


def report_quads(found: DataFrame, dataset: str) -> DataFrame:
    """A validation report as triples without blank nodes: a result's IRI is a digest of what it says."""
    from quadloom.operators.quads import construct

    said = F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in ("focus", "path", "constraint", "value", "severity")))
    rows = found.withColumns({"report": F.lit(f"{dataset}/.well-known/shacl#report"), "result": F.concat(F.lit(f"{dataset}/.well-known/shacl#result-"), F.md5(said))})
    result = F.col("result")
    component = F.concat(F.lit(SH), F.upper(F.substring("constraint", 1, 1)), F.expr("substring(constraint, 2)"), F.lit("ConstraintComponent"))
    return construct(rows, [
        (F.col("report"), RDF_TYPE, ("iri", f"{SH}ValidationReport")), (F.col("report"), f"{SH}result", ("iri", result)), (result, RDF_TYPE, ("iri", f"{SH}ValidationResult")),
        (result, f"{SH}focusNode", ("iri", F.col("focus"))), (result, f"{SH}resultPath", ("iri", F.col("path"))), (result, f"{SH}value", F.col("value")),
        (result, f"{SH}sourceConstraintComponent", ("iri", component)), (result, f"{SH}resultSeverity", ("iri", F.concat(F.lit(SH), F.col("severity")))),
    ])


def conforms(found: DataFrame, disallows: tuple[str, ...] = ("Violation",)) -> DataFrame:
    """One row: whether nothing of a disallowed severity was found, and how many were of each kind."""
    wrong = F.col("severity").isin(list(disallows))
    return found.agg((F.count_if(wrong) == 0).alias("conforms"), F.count("*").alias("results"), F.count_if(wrong).alias("violations"))


def by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("results"))
