"""The neutral search query, and what is wrong with one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from quadloom.functions.values import iso_to_seconds
from quadloom.search.schema import KINDS, MAX_JOIN_DEPTH, JoinGraph, SearchSchema, SearchType

#: Sorts by how well a document matches the text.
RELEVANCE = "relevance"


@dataclass(frozen=True)
class Criterion:
    """One condition: exactly one of in_, range_ and is_; ``on`` leads to the type that has the field."""

    field: str
    in_: tuple[str, ...] | None = None
    range_: tuple[float | str | None, float | str | None] | None = None
    is_: bool | None = None
    on: tuple[str, ...] = ()

    @property
    def operator(self) -> str:
        return "in" if self.in_ is not None else "range" if self.range_ is not None else "is"

    @property
    def axis(self) -> str:
        return ".".join((*self.on, self.field))


@dataclass(frozen=True)
class Filter:
    """A clause: any of its criteria."""

    any_of: tuple[Criterion, ...]

    @property
    def owned(self) -> str | None:
        """The axis that all of its criteria share."""
        axes = {c.axis for c in self.any_of}
        return axes.pop() if len(axes) == 1 else None


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class SearchQuery:
    text: str = ""
    where: tuple[Filter, ...] = ()
    order_by: tuple[Sort, ...] = ()
    facets: tuple[str, ...] = ()
    #: References whose documents come along, and which of their fields.
    resolve: tuple[tuple[str, tuple[str, ...]], ...] = ()
    locale: str = "en"
    #: Whether the last word of the text may be the beginning of a word.
    prefix: bool = False
    limit: int = 20
    offset: int = 0

    def page_start(self) -> int:
        """Pages are whole: an offset within one is its start."""
        return self.offset // self.limit * self.limit if self.limit else 0


@dataclass(frozen=True)
class QueryIssue:
    part: str
    field: str
    reason: str
    value: str | None = None


def where(*clauses: Criterion | Filter) -> tuple[Filter, ...]:
    return tuple(c if isinstance(c, Filter) else Filter((c,)) for c in clauses)


def page(number: int = 1, per_page: int = 20) -> tuple[int, int]:
    """(limit, offset) of a numbered page."""
    if number < 1 or not 0 <= per_page <= 100:
        raise ValueError("pages count from 1 and hold 0 to 100 documents")
    return per_page, (number - 1) * per_page if per_page else 0


def unsatisfiable(query: SearchQuery) -> bool:
    """A clause that asks for one of no documents."""
    return any(len(f.any_of) == 1 and f.any_of[0].field == "id" and f.any_of[0].in_ == () for f in query.where)


def validate_query(query: SearchQuery, search_type: SearchType, schema: SearchSchema) -> list[QueryIssue]:
    graph = JoinGraph(schema)
    out = [issue for f in query.where for c in f.any_of for issue in _criterion(c, search_type, graph)]
    for name in query.facets:
        f = search_type.field(name)
        if f is None or not f.facetable:
            out.append(QueryIssue("facets", name, "not-facetable" if f else "unknown-field"))
    out += [QueryIssue("orderBy", s.field, "unknown-field") for s in query.order_by if s.field != RELEVANCE and search_type.field(s.field) is None]
    for name, _ in query.resolve:
        f = search_type.field(name)
        if f is None or not (f.kind == "reference" and f.ref and (f.label_source or f.joinable)):
            out.append(QueryIssue("resolve", name, "not-resolvable" if f else "unknown-field"))
    return out


def _criterion(c: Criterion, search_type: SearchType, graph: JoinGraph) -> Iterator[QueryIssue]:
    if len(c.on) > MAX_JOIN_DEPTH:
        yield QueryIssue("where", c.axis, "join-too-deep")
        return
    hops = graph.resolve(search_type.name, c.on)
    if hops is None:
        yield QueryIssue("where", c.axis, "unknown-join")
        return
    at = hops[-1][1] if hops else search_type
    if c.field == "id":
        if c.operator != "in":
            yield QueryIssue("where", c.axis, "operator-mismatch")
        return
    f = at.field(c.field)
    if f is None:
        yield QueryIssue("where", c.axis, "unknown-field")
        return
    if not f.filterable:
        yield QueryIssue("where", c.axis, "not-filterable")
    if KINDS[f.kind][0] != c.operator:
        yield QueryIssue("where", c.axis, "operator-mismatch")
    elif f.kind == "date":
        for bound in c.range_:
            if isinstance(bound, str) and iso_to_seconds(bound) is None:
                yield QueryIssue("where", c.axis, "unparseable-bound", bound)


def where_from_dict(given: dict, joinable: frozenset[str] = frozenset(), on: tuple[str, ...] = ()) -> tuple[Filter, ...]:
    """Clauses from nested conditions: sibling keys are joined by and; ``or`` is one clause; ``and`` is flattened.

    A condition is {"in": [...]}, {"min": a, "max": b}, {"is": flag}, or, for a joinable reference, {"where": {...}}.
    """
    out: list[Filter] = []
    for key, value in given.items():
        if key == "and":
            out += [f for part in value for f in where_from_dict(part, joinable, on)]
        elif key == "or":
            alternatives = [where_from_dict(part, joinable, on) for part in value]
            if any(len(fs) != 1 or len(fs[0].any_of) != 1 for fs in alternatives):
                raise ValueError("an alternative is exactly one criterion")
            out.append(Filter(tuple(fs[0].any_of[0] for fs in alternatives)))
        elif "where" in value:
            if key not in joinable:
                raise ValueError(f"{key} cannot be followed")
            out += where_from_dict(value["where"], joinable, (*on, key))
        elif "in" in value:
            out.append(Filter((Criterion(key, in_=tuple(value["in"]), on=on),)))
        elif "is" in value:
            out.append(Filter((Criterion(key, is_=value["is"], on=on),)))
        else:
            out.append(Filter((Criterion(key, range_=(value.get("min"), value.get("max")), on=on),)))
    return tuple(out)


def language_order(requested: tuple[str, ...], present: list[str]) -> list[str]:
    """Languages as they are shown: the requested ones in their order, the rest by name, those without a language last."""
    rest = sorted(x for x in present if x not in requested and x != "und")
    return [x for x in requested if x in present and x != "und"] + rest + (["und"] if "und" in present else [])


def with_defaults(query: SearchQuery, **defaults) -> SearchQuery:
    """A query whose unset parts are the type's defaults."""
    unset = SearchQuery()
    return replace(query, **{k: v for k, v in defaults.items() if getattr(query, k) == getattr(unset, k)})
