"""Search declarations: types, their fields, and what is wrong with them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructField, StructType

#: The operator that filters each kind, and whether it makes facets and sorts. Fixed values.
KINDS = {
    "text": (None, False, True), "keyword": ("in", True, False), "reference": ("in", True, False), "integer": ("range", True, True),
    "number": ("range", True, True), "date": ("range", True, True), "boolean": ("is", True, False),
}
RESERVED_NAMES = ("id", "and", "or")
PROJECTION_VALUES = ("dataset",)
MAX_JOIN_DEPTH = 3
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_LOCALE = re.compile(r"[A-Za-z0-9-]+\Z")
_RANGED = ("integer", "number", "date")
_STORED: dict[str, DataType] = {"keyword": StringType(), "reference": StringType(), "integer": LongType(), "number": DoubleType(), "date": LongType(), "boolean": BooleanType()}


@dataclass(frozen=True)
class Range:
    """A facet bin: from min, up to but without max; either may be open."""

    key: str
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    path: tuple[str, ...] = ()
    array: bool = False
    output: bool = False
    searchable: int | None = None
    filterable: bool = False
    facetable: bool = False
    sortable: bool = False
    locales: tuple[str, ...] = ()
    facet_ranges: tuple[Range, ...] = ()
    #: Of a reference: the target type's name; surfaced inline, by a label source, or joined.
    ref: str | None = None
    inline: bool = False
    label_source: bool = False
    joinable: bool = False
    transform: Callable | None = None
    derive: Callable | None = None
    from_value: str | None = None

    @property
    def internal(self) -> bool:
        """Without any role: it feeds others and is not kept."""
        return not (self.output or self.searchable or self.filterable or self.facetable or self.sortable or self.joinable)


@dataclass(frozen=True)
class Key:
    """A document's key: a field of candidate IRIs, and which of the sorted ones to take."""

    field: str
    pick: Callable | None = None


@dataclass(frozen=True)
class SearchType:
    name: str
    fields: tuple[Field, ...]
    #: A root type is found by its class; a type without one is only referred to.
    class_iri: str | None = None
    key: Key | None = None

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass(frozen=True)
class Issue:
    type: str
    field: str | None
    reason: str


@dataclass(frozen=True)
class SearchSchema:
    types: tuple[SearchType, ...] = field(default_factory=tuple)

    def type(self, name: str) -> SearchType | None:
        return next((t for t in self.types if t.name == name), None)


def _field_issues(f: Field, search_type: SearchType, schema: SearchSchema) -> list[str]:
    target = schema.type(f.ref) if f.ref else None
    is_ref, is_text = f.kind == "reference", f.kind == "text"
    checks = [
        (not _NAME.match(f.name), "invalid-field-name"),
        (f.kind not in KINDS, "unknown-kind"),
        (any(not _LOCALE.match(x) for x in f.locales), "invalid-locale"),
        (is_ref and (f.inline or f.label_source or f.joinable) and not f.ref, "missing-ref"),
        (is_ref and bool(f.ref) and target is None, "missing-ref-type-name"),
        (not is_ref and bool(f.ref), "ref-not-allowed"),
        (is_text and not f.locales and bool(f.searchable or f.sortable), "text-requires-locales"),
        (not is_text and bool(f.locales), "locales-not-allowed"),
        (bool(f.facet_ranges) and f.kind not in _RANGED, "facet-ranges-not-allowed"),
        (bool(f.searchable) and f.kind not in ("text", "keyword", "reference"), "searchable-not-allowed"),
        (f.transform is not None and f.kind not in ("keyword", "reference"), "transform-not-allowed"),
        (f.derive is not None and bool(f.path), "derive-with-path"),
        (f.from_value is not None and f.kind not in ("keyword", "reference"), "from-not-allowed"),
        (f.from_value is not None and bool(f.path), "from-with-path"),
        (f.from_value is not None and f.derive is not None, "from-with-derive"),
        (f.from_value is not None and f.inline, "from-with-inline-ref"),
        (f.from_value is not None and f.from_value not in PROJECTION_VALUES, "unknown-projection-value"),
        (is_text and f.filterable, "text-not-filterable"),
        (is_text and f.facetable, "text-not-facetable"),
        (f.joinable and not is_ref, "joinable-not-allowed"),
        (f.joinable and is_ref and not f.label_source, "joinable-without-label-source"),
        (f.joinable and f.inline, "joinable-with-inline-ref"),
        (f.name in RESERVED_NAMES, "reserved-field-name"),
    ]
    return [reason for wrong, reason in checks if wrong]


def _key_issues(t: SearchType) -> list[tuple[str, str]]:
    if t.key is None:
        return []
    f = t.field(t.key.field)
    if t.class_iri is None:
        return [(t.key.field, "key-not-allowed")]
    if f is None:
        return [(t.key.field, "key-field-unknown")]
    checks = [
        (f.kind != "reference", "key-field-not-reference"),
        (not f.path, "key-field-without-path"),
        (not f.array, "key-field-not-array"),
        (f.inline, "key-field-inline"),
        (t.key.pick is not None and not callable(t.key.pick), "key-pick-not-a-function"),
    ]
    return [(f.name, reason) for wrong, reason in checks if wrong]


def validate(schema: SearchSchema) -> list[Issue]:
    """Everything that is wrong with a schema's declarations."""
    out = [Issue(name, None, "duplicate-type-name") for name, n in Counter(t.name for t in schema.types).items() if n > 1]
    out += [Issue(iri, None, "duplicate-class") for iri, n in Counter(t.class_iri for t in schema.types if t.class_iri).items() if n > 1]
    for t in schema.types:
        out += [Issue(t.name, name, "duplicate-field-name") for name, n in Counter(f.name for f in t.fields).items() if n > 1]
        out += [Issue(t.name, value, "duplicate-projection-value") for value, n in Counter(f.from_value for f in t.fields if f.from_value).items() if n > 1]
        out += [Issue(t.name, f.name, reason) for f in t.fields for reason in _field_issues(f, t, schema)]
        out += [Issue(t.name, name, reason) for name, reason in _key_issues(t)]
    return out + _cycles(schema, "inline", "inline-cycle") + _cycles(schema, "joinable", "join-cycle") + _double_joins(schema)


def _double_joins(schema: SearchSchema) -> list[Issue]:
    """Two joinable references of a type to one target."""
    return [Issue(t.name, ref, "duplicate-join-target") for t in schema.types for ref, n in Counter(f.ref for f in t.fields if f.joinable).items() if n > 1]


def _edges(schema: SearchSchema, flag: str) -> dict[str, list[str]]:
    return {t.name: [f.ref for f in t.fields if getattr(f, flag) and f.ref and schema.type(f.ref)] for t in schema.types}


def _cycles(schema: SearchSchema, flag: str, reason: str) -> list[Issue]:
    edges = _edges(schema, flag)
    left = {name: set(targets) for name, targets in edges.items()}
    while ready := [name for name, targets in left.items() if not targets & left.keys()]:
        for name in ready:
            del left[name]
    return [Issue(name, None, reason) for name in left]


def inline_depth(schema: SearchSchema, type_name: str) -> int:
    """Hops that framing a type's inline references takes."""
    return max((1 + inline_depth(schema, t) for t in _edges(schema, "inline").get(type_name, [])), default=0)


class JoinGraph:
    """Types and the references that filters may follow."""

    def __init__(self, schema: SearchSchema):
        self.schema, self.edges = schema, _edges(schema, "joinable")

    def resolve(self, type_name: str, on: tuple[str, ...]) -> list[tuple[Field, SearchType]] | None:
        """The hops of a path: its fields and the types they lead to; None if it leads nowhere."""
        hops, at = [], self.schema.type(type_name)
        for name in on:
            f = at.field(name) if at else None
            if f is None or not f.joinable or not f.ref or self.schema.type(f.ref) is None:
                return None
            at = self.schema.type(f.ref)
            hops.append((f, at))
        return hops

    def components(self) -> list[list[str]]:
        """Types that joins connect, each set with what is referred to before what refers to it."""
        group = {t.name: t.name for t in self.schema.types}

        def root(x: str) -> str:
            while group[x] != x:
                x = group[x]
            return x

        for a, targets in self.edges.items():
            for b in targets:
                group[root(a)] = root(b)
        out: dict[str, list[str]] = {}
        for name in self._order():
            out.setdefault(root(name), []).append(name)
        return list(out.values())

    def _order(self) -> list[str]:
        done: list[str] = []

        def visit(name: str) -> None:
            for target in self.edges[name]:
                if target not in done:
                    visit(target)
            if name not in done:
                done.append(name)

        for t in self.schema.types:
            visit(t.name)
        return done


_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+")
#: Irregular and invariant plurals of common type names. Fixed values.
PLURALS = {"person": "people", "child": "children", "man": "men", "woman": "women", "series": "series", "species": "species", "news": "news", "datum": "data", "index": "indices", "people": "people"}


def plural(word: str) -> str:
    if word in PLURALS:
        return PLURALS[word]
    if word.endswith("sis"):
        return word[:-2] + "es"
    if re.search(r"[^aeiou]y\Z", word):
        return word[:-1] + "ies"
    if re.search(r"(?:ss|sh|ch|x|z)\Z", word):
        return word + "es"
    return word if word.endswith("s") else word + "s"


def physical_name(t: SearchType) -> str:
    """The table of a type: its words in lower case, the last in the plural, joined by _."""
    words = _WORD.findall(t.name)
    if not re.fullmatch(r"[A-Za-z0-9 _-]*", t.name) or not words:
        raise ValueError(f"no table name can be made from the type name {t.name!r}")
    words = [w.lower() for w in words]
    return "_".join([*words[:-1], plural(words[-1])])


def document_schema(schema: SearchSchema, t: SearchType) -> StructType:
    """The columns of a type's documents: id, and each field that has a role."""
    fields = [StructField("id", StringType(), False)]
    for f in (f for f in t.fields if not f.internal):
        if f.kind == "text":
            kind: DataType = MapType(StringType(), StringType())
            fields += [StructField(f"{f.name}_search_{x}", StringType()) for x in f.locales if f.searchable]
            fields += [StructField(f"{f.name}_sort_{x}", StringType()) for x in f.locales if f.sortable]
        elif f.inline and f.ref:
            kind = document_schema(schema, schema.type(f.ref))
        else:
            kind = _STORED[f.kind]
        fields.append(StructField(f.name, ArrayType(kind) if f.array and f.kind != "text" else kind))
    return StructType(fields)


class SharedName(ValueError):
    """Two types would share one table."""


def table_names(schema: SearchSchema, given: dict[str, str] | None = None) -> dict[str, str]:
    """The table of each type: the name given or its physical name. Only names that were given may be shared."""
    given = given or {}
    out = {t.name: given.get(t.name) or physical_name(t) for t in schema.types}
    for name, n in Counter(out.values()).items():
        own = [t for t, held in out.items() if held == name]
        if n > 1 and not all(t in given for t in own):
            raise SharedName(f"{', '.join(own)} share the table {name}")
    return out


def sweepable(t: SearchType, source_field: str) -> list[str]:
    """Why documents of a type cannot be swept by the field that names their source; empty if they can."""
    f = next((f for f in t.fields if f.name == source_field), None)
    if f is None:
        return ["missing"]
    checks = {"array": f.array, "transformed": f.transform is not None, "not-facetable": not f.facetable}
    return [reason for reason, wrong in checks.items() if wrong]


def display_fields(f: Field, languages: list[str]) -> dict[str, str]:
    """The columns that show a text field, by language."""
    return {lang: f"{f.name}_search_{lang}" for lang in languages if lang in f.locales}


def result_schema(schema: SearchSchema, t: SearchType) -> StructType:
    """What a search of a type returns: its page of documents, the total and its facets."""
    bucket = StructType([StructField("field", StringType()), StructField("value", StringType()), StructField("count", LongType()), StructField("min", DoubleType()), StructField("max", DoubleType())])
    items = StructType([x for x in document_schema(schema, t).fields if x.name == "id" or any(f.name == x.name and f.output for f in t.fields)])
    return StructType([StructField("items", ArrayType(items)), StructField("total", LongType()), StructField("facets", ArrayType(bucket))])


def load_schema(path: str) -> SearchSchema:
    """The declarations that a Python file holds as ``schema``."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("search_schema", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found = getattr(module, "schema", None)
    if not isinstance(found, SearchSchema):
        raise TypeError(f"{path} holds no schema")
    if issues := validate(found):
        raise ValueError(f"{path}: {issues}")
    return found
