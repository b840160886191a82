"""SPARQL to DataFrame plans: SELECT, CONSTRUCT, ASK and DESCRIBE over a table of quads, and updates of it.

A query text becomes a small algebra (``sparql_parser``) and that becomes one
plan: each triple pattern is a select on the quads, shared variables are join
keys, OPTIONAL a left join, MINUS an anti join, VALUES a filter or a join. A
variable is a column of the term's text with companions ``<v>__kind``,
``<v>__dt`` and ``<v>__lang``; terms are joined by all of them, but a variable
that stands for a subject or predicate somewhere is never a literal, so its
text and kind are enough. Expressions are in ``sparql_values``.

The default graph holds all triples of the table unless FROM names graphs;
triples of several named graphs are a set. GRAPH reaches the graphs of FROM
NAMED, or all where neither is given.

A variable that may be unbound on one side of a join splits that side into its
bound and unbound rows, so that each part has an equi join. Only a left join
whose right side may leave a variable unbound, or both sides may, compares by a
condition; and groups without a shared variable are a product, as the algebra has it.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.operators.quads import dedupe
from quadloom.plans import sparql_values as V
from quadloom.plans.sparql_parser import Group, ParseError, Path, Query, Term, Update, parse, parse_updates
from quadloom.plans.sparql_values import PARTS, Value
from quadloom.sources.tables import LANG_STRING, QUAD_COLUMNS, TERM_COLUMNS

_UNSAFE = re.compile(r"[\x00-\x20<>\"{}|^`\\]")
#: Rows of VALUES up to which they are a condition rather than a join.
VALUES_AS_FILTER = 64


def assert_safe_iri(iri: str) -> str:
    """An IRI that may stand in a query; characters that could end it there are refused."""
    if not iri or _UNSAFE.search(iri):
        raise ParseError(f"not an IRI: {iri!r}")
    return iri


class Rows(NamedTuple):
    """Solutions: their variables that are always bound, that may be bound, and that are never literals."""

    df: DataFrame
    certain: frozenset
    possible: frozenset
    nodes: frozenset


def _null() -> Column:
    return F.lit(None).cast("string")


def held(v: str, prefix: str = "") -> Value:
    """A variable's value in its columns."""
    return Value(*(F.col(f"{prefix}{v}{x}") for x in PARTS))


def _named(v: str, value: Value) -> list[Column]:
    return [c.cast("string").alias(f"{v}{x}") for c, x in zip(value, PARTS, strict=True)]


def _matches(column: str, t: Term) -> Column:
    """Whether a quad's subject or object is a term."""
    if t.kind == "iri":
        return (F.col(column) == t.value) & (F.col(f"{column}_kind") == "iri")
    same = (F.col(column) == t.value) & (F.col(f"{column}_kind") == "literal")
    if t.lang:
        return same & (F.lower(f"{column}_lang") == t.lang.lower())
    plain = F.col(f"{column}_dt") == t.dt
    return same & ((plain | F.col(f"{column}_dt").isNull()) if t.dt == V.STRING else plain) & (F.coalesce(f"{column}_lang", F.lit("")) == "")


class Compiler:
    """Plans over quads."""

    def __init__(self, quads: DataFrame, named: DataFrame | None = None, graph: str | None = None):
        """quads: the default graph; named: quads of named graphs; graph: the variable that their g is bound to."""
        self.quads, self.named, self.graph, self.count = quads, named, graph, 0
        self.spark = quads.sparkSession

    def one(self) -> Rows:
        return Rows(self.spark.range(1).select(F.lit(1).alias("__one")), frozenset(), frozenset(), frozenset())

    # -- patterns

    def triple(self, s: Term, p: Term | Path, o: Term) -> Rows:
        if isinstance(p, Path) and p.op != "iri":
            return self.path(s, p, o)
        rows, columns, names, nodes = self.quads, [], [], set()
        if isinstance(p, Path):
            rows = rows.where(F.col("p") == p.iri)
        elif p.kind != "var":
            rows = rows.where(F.col("p") == p.value)
        if s.kind == "literal":
            rows = rows.where(F.lit(False))
        elif s.kind != "var":
            rows = rows.where(_matches("s", s))
        else:
            columns += _named(s.value, Value(F.col("s"), F.col("s_kind"), _null(), _null()))
            names.append(s.value)
            nodes.add(s.value)
        if isinstance(p, Term) and p.kind == "var":
            if p.value in names:
                rows = rows.where((F.col("p") == F.col("s")) & (F.col("s_kind") == "iri"))
            else:
                columns += _named(p.value, Value(F.col("p"), F.lit("iri"), _null(), _null()))
                names.append(p.value)
                nodes.add(p.value)
        if o.kind != "var":
            rows = rows.where(_matches("o", o))
        elif o.value in names:
            is_s = s.kind == "var" and o.value == s.value
            rows = rows.where((F.col("o") == F.col("s" if is_s else "p")) & (F.col("o_kind") == (F.col("s_kind") if is_s else F.lit("iri"))))
        else:
            columns += _named(o.value, Value(*(F.col(f"o{x}") for x in ("", "_kind", "_dt", "_lang"))))
            names.append(o.value)
        if self.graph:
            if self.graph in names:
                rows = rows.where(F.col("g") == F.col({s.value: "s", o.value: "o"}.get(self.graph, "p")))
            else:
                columns += _named(self.graph, Value(F.col("g"), F.lit("iri"), _null(), _null()))
                names.append(self.graph)
                nodes.add(self.graph)
        bound = frozenset(names)
        return Rows(rows.select(*columns) if columns else rows.select(F.lit(1).alias("__one")), bound, bound, frozenset(nodes))

    def path(self, s: Term, p: Path, o: Term, known: Rows | None = None) -> Rows:
        if p.op == "inv":
            return self.triple(o, p.parts[0], s)
        if p.op == "alt":
            return self.union([self.triple(s, x, o) for x in p.parts])
        if p.op == "seq":
            at, out = s, None
            for i, x in enumerate(p.parts):
                self.count += 1
                to = o if i == len(p.parts) - 1 else Term("var", f"__p{self.count}")
                step = self.triple(at, x, to)
                out = step if out is None else self.join(out, step)
                at = to
            hidden = {n for n in out.possible if n.startswith("__p")}
            return self._without(out, hidden)
        if p.op == "not":
            ahead, back = ([x.iri if x.op == "iri" else x.parts[0].iri for x in p.parts if (x.op == "iri") == forward] for forward in (True, False))
            made = []
            if ahead or not back:
                made.append(Compiler(self.quads.where(~F.col("p").isin(ahead)), None, self.graph).triple(s, Term("var", "__any"), o))
            if back:
                made.append(Compiler(self.quads.where(~F.col("p").isin(back)), None, self.graph).triple(o, Term("var", "__any"), s))
            return self._without(self.union(made), {"__any"})
        if self.graph:
            raise ParseError("a repeated path within GRAPH ?variable is not supported")
        pairs = self.repeated(s, p, o, known)
        return Compiler(pairs).triple(s, Path("iri", [], "path"), o)

    @staticmethod
    def _without(rows: Rows, names: set) -> Rows:
        columns = [f"{n}{x}" for n in names for x in PARTS]
        df = rows.df.drop(*columns)
        return Rows(df if df.columns else rows.df.select(F.lit(1).alias("__one")), rows.certain - names, rows.possible - names, rows.nodes - names)

    def repeated(self, s: Term, p: Path, o: Term, known: Rows | None = None) -> DataFrame:
        """Pairs that a path with +, * or ? connects, as quads of the predicate "path".

        Steps start at what is bound: at the subject, else backwards at the object, else at the nodes
        that the patterns before have found; only what a step finds anew is followed by the next.
        """
        x, y = Term("var", "x"), Term("var", "y")
        edges = self.triple(x, p.parts[0], y).df
        ahead = edges.select(*(c.alias(n) for v, side in (("x", "s"), ("y", "o")) for c, n in zip(held(v), [side, f"{side}_kind", f"{side}_dt", f"{side}_lang"], strict=True)))
        start, end = ["s", "s_kind", "s_dt", "s_lang"], ["o", "o_kind", "o_dt", "o_lang"]
        turned = s.kind == "var" and o.kind != "var" or s.kind == "var" and known is not None and s.value not in known.certain and o.kind == "var" and o.value in known.certain
        if turned:
            ahead = ahead.toDF(*end, *start)
        first = o if turned else s
        seeds = None
        if first.kind != "var":
            seeds = self.spark.range(1).select(*(c.alias(n) for c, n in zip(V.constant(first), start, strict=True)))
        elif known is not None and first.value in known.certain:
            seeds = known.df.select(*(c.cast("string").alias(n) for c, n in zip(held(first.value), start, strict=True))).distinct()
        ahead = ahead.distinct()
        reach = self.closure(ahead, seeds) if p.op != "maybe" else ahead if seeds is None else self._joined_on(ahead, seeds, start)
        if p.op != "plus":
            if seeds is None:
                nodes = [self.quads.select("s", "s_kind", _null().alias("s_dt"), _null().alias("s_lang")), self.quads.select(*(F.col(c).alias(n) for c, n in zip(end, start, strict=True)))]
                if o.kind != "var":  # nodes that no triple holds reach themselves too
                    nodes.append(self.spark.range(1).select(*(c.alias(n) for c, n in zip(V.constant(o), start, strict=True))))
                seeds = reduce(DataFrame.union, nodes).distinct()
            reach = reach.unionByName(seeds.select(*start, *(F.col(a).alias(b) for a, b in zip(start, end, strict=True)))).distinct()
        if turned:
            reach = reach.select(*(F.col(a).alias(b) for a, b in zip([*end, *start], [*start, *end], strict=True)))
        return reach.withColumns({"p": F.lit("path"), "g": _null()})

    @staticmethod
    def _joined_on(rows: DataFrame, seeds: DataFrame, on: list[str]) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(on)]
        return rows.join(seeds.toDF(*(f"__k{i}" for i in range(len(on)))), reduce(Column.__and__, same), "left_semi")

    def closure(self, edges: DataFrame, seeds: DataFrame | None) -> DataFrame:
        """Pairs (start, end) that one or more edges connect, from the seeds or from every start."""
        from quadloom.plans.tables import checkpointed

        start, end = ["s", "s_kind", "s_dt", "s_lang"], ["o", "o_kind", "o_dt", "o_lang"]
        edges = checkpointed(edges)
        hops = edges.select(*(F.col(a).alias(f"__k{i}") for i, a in enumerate(start)), *(F.col(a).alias(f"__o{i}") for i, a in enumerate(end)))
        frontier = edges if seeds is None else self._joined_on(edges, seeds, start)
        frontier = checkpointed(frontier.select(*start, *end))
        found = [frontier]
        while not frontier.isEmpty():
            far = frontier.join(hops, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(end)]))
            far = far.select(*start, *(F.col(f"__o{i}").alias(c) for i, c in enumerate(end))).distinct()
            seen = reduce(DataFrame.union, found).toDF(*(f"__k{i}" for i in range(8)))
            frontier = checkpointed(far.join(seen, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*start, *end])]), "left_anti"))
            found.append(frontier)
        return reduce(DataFrame.union, found)

    # -- joins

    @staticmethod
    def _same(v: str, node: bool) -> Column:
        """Whether a variable is one term on both sides; the right one's columns begin with __r_."""
        if node:
            return (F.col(v) == F.col(f"__r_{v}")) & (F.col(f"{v}__kind") == F.col(f"__r_{v}__kind"))
        a, b = held(v), held(v, "__r_")
        dt = lambda x: F.when(x.kind == "literal", V.datatype(x)).otherwise("")
        lang = lambda x: F.when(x.kind == "literal", V.language(x)).otherwise("")
        return (a.text == b.text) & (a.kind == b.kind) & (dt(a) == dt(b)) & (lang(a) == lang(b))

    def join(self, a: Rows, b: Rows, how: str = "inner", condition=None) -> Rows:
        """condition: of a left join, a function of the joined rows that gives a Column."""
        shared, certain = a.possible & b.possible, a.certain & b.certain
        for v in sorted(shared - certain):
            # split the side that may leave the variable unbound, where the other side binds it or any join is inner
            if v in b.certain and (v not in a.certain):
                return self._split(a, b, v, how, condition, left=True)
            if how == "inner":
                return self._split(a, b, v, how, condition, left=v not in a.certain)
        renamed = {f"{v}{x}": f"__r_{v}{x}" for v in shared for x in PARTS}
        right = b.df.withColumnsRenamed(renamed)
        on = [self._same(v, v in a.nodes or v in b.nodes) for v in sorted(certain)]
        on += [F.col(v).isNull() | F.col(f"__r_{v}").isNull() | self._same(v, False) for v in sorted(shared - certain)]
        if "__one" in a.df.columns and "__one" in right.columns:
            right = right.drop("__one") if len(right.columns) > 1 else right.withColumnRenamed("__one", "__two")
        if condition is not None:
            on.append(condition(Rows(a.df, a.certain, a.possible | b.possible, frozenset())))
        if on:
            out = a.df.join(right, reduce(Column.__and__, on), how)
        else:  # no shared variable: a product, as the algebra has it
            out = a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
        out = out.withColumns({f"{v}{x}": F.when(F.col(v).isNotNull(), F.col(f"{v}{x}")).otherwise(F.col(f"__r_{v}{x}")) for v in sorted(shared - certain) for x in PARTS})
        out = out.drop(*renamed.values(), *(["__one", "__two"] if len(a.possible | b.possible) else ["__two"]))
        nodes = (a.nodes & b.nodes) | (a.nodes - b.possible) | (b.nodes - a.possible) | ((a.nodes | b.nodes) & certain)
        return Rows(out, a.certain | b.certain if how == "inner" else a.certain, a.possible | b.possible, frozenset(nodes))

    def _split(self, a: Rows, b: Rows, v: str, how: str, condition, left: bool) -> Rows:
        """A join in two parts: by rows of one side that bind a variable and by those that do not."""
        side = a if left else b
        bound = side._replace(df=side.df.where(F.col(v).isNotNull()), certain=side.certain | {v})
        free = self._without(side._replace(df=side.df.where(F.col(v).isNull())), {v})
        parts = [self.join(x, b, how, condition) if left else self.join(a, x, how, condition) for x in (bound, free)]
        out = self.union(parts)
        return out._replace(certain=a.certain | b.certain if how == "inner" else a.certain)

    def bgp(self, triples: list[tuple], so_far: Rows | None) -> Rows:
        """Triple patterns, each joined as soon as it shares a variable; repeated paths start at what is known."""
        left = list(triples)
        while left:
            known = so_far.possible if so_far else frozenset()
            mentions = lambda t: {x.value for x in t if isinstance(x, Term) and x.kind == "var"}
            ready = [t for t in left if not known or known & mentions(t)] or left
            nxt = next((t for t in ready if not self._repeats(t[1])), ready[0])
            left.remove(nxt)
            made = self.path(*nxt, so_far) if self._repeats(nxt[1]) else self.triple(*nxt)
            so_far = made if so_far is None else self.join(so_far, made)
        return so_far

    @staticmethod
    def _repeats(p: Term | Path) -> bool:
        return isinstance(p, Path) and p.op in ("plus", "star", "maybe")

    # -- groups

    def group(self, g: Group, filters: bool = True) -> Rows:
        out: Rows | None = None
        for kind, x in g.steps:
            if kind == "triples":
                out = self.bgp(x, out)
            elif kind == "union":
                out = self._joined(out, self.union([self.group(p) for p in x]))
            elif kind == "group":
                out = self._joined(out, self.group(x))
            elif kind == "query":
                out = self._joined(out, self.select(x))
            elif kind == "graph":
                out = self._joined(out, self.in_graph(*x))
            elif kind == "optional":
                out = self.optional(out or self.one(), x)
            elif kind == "minus":
                out = self.minus(out or self.one(), self.group(x))
            elif kind == "bind":
                out = self.bind(out or self.one(), *x)
            elif kind == "values":
                out = self.values(out, *x)
        out = out or self.one()
        if filters:
            for e in g.filters:
                out = self.filtered(out, e)
        return out

    def in_graph(self, graph: Term, inner: Group) -> Rows:
        quads = self.quads if self.named is None else self.named
        if graph.kind == "var":
            return Compiler(quads.where("g is not null"), self.named, graph.value).group(inner)
        return Compiler(quads.where(F.col("g") == graph.value), self.named).group(inner)

    def optional(self, out: Rows, inner: Group) -> Rows:
        """A left join; the group's own filters see the variables of both sides."""
        right = self.group(inner, filters=False)
        if not inner.filters:
            return self.join(out, right, "left")
        own = {v for e in inner.filters for v in variables(e)}
        if own <= right.possible and not own & (out.possible - right.certain):
            return self.join(out, reduce(self.filtered, inner.filters, right), "left")
        if any(e[0] == "exists" for e in inner.filters):
            raise ParseError("EXISTS within OPTIONAL cannot refer to outer variables")
        return self.join(out, right, "left", lambda rows: reduce(Column.__and__, [F.coalesce(self.condition(e, rows), F.lit(False)) for e in inner.filters]))

    def _joined(self, a: Rows | None, b: Rows) -> Rows:
        return b if a is None else self.join(a, b)

    @staticmethod
    def union(parts: list[Rows]) -> Rows:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.df for p in parts])
        certain, possible = frozenset.intersection(*(p.certain for p in parts)), frozenset.union(*(p.possible for p in parts))
        literal = {v for p in parts for v in p.possible - p.nodes}
        return Rows(rows, certain, possible, possible - literal)

    def bind(self, out: Rows, name: str, e) -> Rows:
        value = self.value(e, out)
        columns = {f"{name}{x}": F.when(value.text.isNotNull(), c).cast("string") for c, x in zip(value, PARTS, strict=True)}
        return Rows(out.df.withColumns(columns), out.certain, out.possible | {name}, out.nodes - {name})

    def minus(self, a: Rows, b: Rows) -> Rows:
        shared = sorted(a.possible & b.possible)
        if not shared:
            return a
        right = b.df.select(*(F.col(f"{v}{x}").alias(f"__r_{v}{x}") for v in shared for x in PARTS)).distinct()
        certain = a.certain & b.certain
        same = [self._same(v, v in a.nodes or v in b.nodes) if v in certain else F.col(v).isNull() | F.col(f"__r_{v}").isNull() | self._same(v, False) for v in shared]
        on = reduce(Column.__and__, same)
        if not certain & set(shared):  # at least one variable must be bound on both sides
            on = on & reduce(Column.__or__, [F.col(v).isNotNull() & F.col(f"__r_{v}").isNotNull() for v in shared])
        return a._replace(df=a.df.join(right, on, "left_anti"))

    def values(self, out: Rows | None, names: list[str], rows: list[list[Term | None]]) -> Rows:
        plain = all(x is not None for r in rows for x in r)
        distinct = len({tuple(r) for r in rows}) == len(rows)
        if out and plain and distinct and rows and len(rows) <= VALUES_AS_FILTER and set(names) <= out.certain:  # no row is added and none doubled
            met = [reduce(Column.__and__, [V.same_term(held(n), V.constant(x)) for n, x in zip(names, r, strict=True)]) for r in rows]
            return out._replace(df=out.df.where(reduce(Column.__or__, met)))
        schema = ", ".join(f"`{n}{x}` string" for n in names for x in PARTS) or "__one int"
        data = [tuple(y for x in r for y in ((None,) * 4 if x is None else (x.value, x.kind, x.dt, x.lang))) if names else (1,) for r in rows]
        bound = frozenset(n for i, n in enumerate(names) if all(r[i] is not None for r in rows))
        literal = {n for i, n in enumerate(names) if any(r[i] is not None and r[i].kind == "literal" for r in rows)}
        return self._joined(out, Rows(self.spark.createDataFrame(data, schema), bound, frozenset(names), frozenset(names) - literal))

    def filtered(self, out: Rows, e) -> Rows:
        if e[0] == "and":
            return self.filtered(self.filtered(out, e[1]), e[2])
        if e[0] == "not" and e[1][0] == "exists":
            e = ("exists", e[1][1], not e[1][2])
        if e[0] == "exists":
            return self.exists(out, e[1], e[2])
        nested = list(existences(e))
        for i, x in enumerate(nested):  # an EXISTS among other conditions is a flag
            out = self._flagged(out, x, f"__e{i}")
        kept = out.df.where(self.condition(e, out))
        return out._replace(df=kept.drop(*(f"__e{i}" for i in range(len(nested)))))

    def _flagged(self, out: Rows, e: tuple, name: str) -> Rows:
        inner = self.group(e[1])
        shared = sorted(out.certain & inner.certain)
        if not shared or (out.possible & inner.possible) - set(shared):
            raise ParseError("EXISTS among other conditions must share variables that are always bound")
        right = inner.df.select(*(F.col(f"{v}{x}").alias(f"__r_{v}{x}") for v in shared for x in PARTS)).distinct().withColumn(name, F.lit(True))
        df = out.df.join(right, reduce(Column.__and__, [self._same(v, v in out.nodes or v in inner.nodes) for v in shared]), "left")
        self.marks = {**getattr(self, "marks", {}), id(e): name}
        return out._replace(df=df.withColumn(name, F.coalesce(name, F.lit(False))).drop(*(f"__r_{v}{x}" for v in shared for x in PARTS)))

    def exists(self, out: Rows, g: Group, wanted: bool) -> Rows:
        how = "left_semi" if wanted else "left_anti"
        own = {v for e in g.filters for v in variables(e)}
        inner = self.group(g, filters=False)
        if not own - inner.possible:
            inner, conditions = reduce(self.filtered, g.filters, inner), []
        else:  # filters that see the outer variables are conditions of the join
            conditions = g.filters
        shared = sorted(out.possible & inner.possible)
        columns = {f"{v}{x}": f"__r_{v}{x}" for v in shared for x in PARTS}
        if not conditions:
            right = inner.df.select(*(F.col(a).alias(b) for a, b in columns.items())).distinct() if shared else inner.df.select(F.lit(1).alias("__r_one")).limit(1)
        else:
            right = inner.df.withColumnsRenamed(columns)
            right = right.drop("__one")
        certain = out.certain & inner.certain
        on = [self._same(v, v in out.nodes or v in inner.nodes) if v in certain else F.col(v).isNull() | F.col(f"__r_{v}").isNull() | self._same(v, False) for v in shared]
        both = Rows(out.df, out.certain, out.possible | inner.possible, frozenset())
        on += [F.coalesce(self.condition(e, both), F.lit(False)) for e in conditions]
        return out._replace(df=out.df.join(right, reduce(Column.__and__, on, F.lit(True)), how))

    # -- expressions

    def condition(self, e, rows: Rows) -> Column:
        op = e[0]
        if op in ("and", "or"):
            a, b = self.condition(e[1], rows), self.condition(e[2], rows)
            return a & b if op == "and" else a | b
        if op == "not":
            return ~self.condition(e[1], rows)
        if op in ("=", "!="):
            found = V.equal(self.value(e[1], rows), self.value(e[2], rows))
            return found if op == "=" else ~found
        if op in ("<", ">", "<=", ">="):
            return V.compared(op, self.value(e[1], rows), self.value(e[2], rows))
        if op == "in":
            left = self.value(e[1], rows)
            return reduce(Column.__or__, [V.equal(left, self.value(x, rows)) for x in e[2:]], F.lit(False))
        if op == "exists":
            name = getattr(self, "marks", {}).get(id(e))
            if name is None:
                raise ParseError("EXISTS is not supported here")
            return F.col(name) if e[2] else ~F.col(name)
        if op == "call" and e[1] == "BOUND":
            return self.value(e[2], rows).text.isNotNull()
        return V.truth(self.value(e, rows))

    def value(self, e, rows: Rows) -> Value:
        op = e[0]
        if op == "var":
            return held(e[1]) if e[1] in rows.possible else Value(_null(), _null(), _null(), _null())
        if op == "term":
            return V.constant(e[1])
        if op in ("+", "-", "*", "/"):
            return V.arithmetic(op, self.value(e[1], rows), self.value(e[2], rows))
        if op == "neg":
            return V.arithmetic("-", V.constant(Term("literal", "0", V.INTEGER)), self.value(e[1], rows))
        if op == "call" and e[1] not in ("BOUND",):
            if e[1] == "IF":
                return V.either(self.condition(e[2], rows), self.value(e[3], rows), self.value(e[4], rows))
            args = [self.value(x, rows) for x in e[2:]]
            return V.first_of(args) if e[1] == "COALESCE" else V.call(e[1], args)
        if op == "agg":
            raise ParseError("an aggregate cannot stand here")
        return V.literal(self.condition(e, rows).cast("string"), V.BOOLEAN)

    # -- aggregates

    def aggregate(self, e, rows: Rows) -> Column:
        """One column: a struct of a value's parts."""
        _, name, inner, distinct, separator = e
        whole = lambda c: F.struct(c.cast("string").alias("text"), F.lit("literal").alias("kind"), F.lit(V.INTEGER).alias("dt"), _null().alias("lang"))
        if inner is None:
            if not distinct:
                return whole(F.count("*"))
            return whole(F.count_distinct(F.struct(*(F.coalesce(F.col(f"{v}{x}"), F.lit("")) for v in sorted(rows.possible) for x in PARTS))))
        v = self.value(inner, rows)
        term = F.when(v.text.isNotNull(), F.struct(v.text.alias("text"), F.coalesce(v.kind, F.lit("")).alias("kind"), F.when(v.kind == "literal", V.datatype(v)).otherwise("").alias("dt"), F.when(v.kind == "literal", V.language(v)).otherwise("").alias("lang")))
        if name == "COUNT":
            return whole(F.count_distinct(term) if distinct else F.count(v.text))
        parts = F.struct(v.text.alias("text"), v.kind.alias("kind"), v.dt.alias("dt"), v.lang.alias("lang"))
        if name in ("MIN", "MAX", "SAMPLE"):
            key = F.when(v.text.isNotNull(), F.struct(*V.order_key(v)))
            return (F.max_by if name == "MAX" else F.min_by)(F.when(v.text.isNotNull(), parts), key)
        if name == "GROUP_CONCAT":
            texts = F.collect_set(v.text) if distinct else F.collect_list(v.text)
            return F.struct(F.array_join(F.sort_array(texts), separator).alias("text"), F.lit("literal").alias("kind"), F.lit(V.STRING).alias("dt"), _null().alias("lang"))
        # SUM and AVG: an error if one value is no number
        add = F.sum_distinct if distinct else F.sum
        exact = F.when(V.is_number(v), v.text.try_cast("decimal(38,12)"))
        faults = F.count_if(v.text.isNull() | ~V.is_number(v))
        floating = F.count_if(V.is_number(v) & ~v.dt.isin([*V.WHOLE, V.DECIMAL])) > 0
        whole_ones = F.count_if(V.is_number(v) & ~v.dt.isin(V.WHOLE)) == 0
        n = F.count_distinct(exact) if distinct else F.count(exact)
        total, total_floating = F.coalesce(add(exact.cast("decimal(38,6)")), F.lit(0)), add(V.number(v))
        if name == "AVG":
            text = F.when(n == 0, F.lit("0")).when(floating, V.double_text(F.try_divide(total_floating, n))).otherwise(V.decimal_text(F.try_divide(total.cast("decimal(38,12)"), n.cast("decimal(20,0)"))))
            dt = F.when(n == 0, F.lit(V.INTEGER)).when(floating, F.lit(V.DOUBLE)).otherwise(F.lit(V.DECIMAL))
        else:
            text = F.when(floating, V.double_text(total_floating)).otherwise(V.decimal_text(total))
            dt = F.when(floating, F.lit(V.DOUBLE)).when(whole_ones, F.lit(V.INTEGER)).otherwise(F.lit(V.DECIMAL))
        return F.struct(F.when(faults == 0, text).alias("text"), F.lit("literal").alias("kind"), dt.alias("dt"), _null().alias("lang"))

    def grouped(self, q: Query, rows: Rows) -> tuple[Rows, Query]:
        """Rows of the groups, and the query with a variable in place of each aggregate and group expression."""
        replaced: dict = {}
        keys: list[str] = []
        for i, (e, name) in enumerate(q.group_by):
            name = name or f"__g{i}"
            if e != ("var", name):
                rows = self.bind(rows, name, e)
                replaced[repr(e)] = ("var", name)
            if name in rows.possible:
                keys.append(name)
        aggs: dict[str, tuple] = {}

        def without(e):
            if not isinstance(e, tuple) or not e:
                return e
            if repr(e) in replaced:
                return replaced[repr(e)]
            if e[0] == "agg":
                name = aggs.setdefault(repr(e), (f"__a{len(aggs)}", e))[0]
                return ("var", name)
            return (e[0], *(without(x) if isinstance(x, tuple) else x for x in e[1:]))

        changed = Query(q.form, q.where, [(without(e), n) for e, n in q.select], q.star, q.distinct, order=[(without(e), d) for e, d in q.order], having=[without(e) for e in q.having], limit=q.limit, offset=q.offset)
        made = [self.aggregate(e, rows).alias(name) for name, e in aggs.values()]
        df = rows.df.groupBy(*(f"{v}{x}" for v in keys for x in PARTS)).agg(*(made or [F.count("*").alias("__n")]))
        names = [name for name, _ in aggs.values()]
        if names:
            df = df.select(*(f"{v}{x}" for v in keys for x in PARTS), *(F.col(f"{n}.{part}").alias(f"{n}{x}") for n in names for part, x in zip(("text", "kind", "dt", "lang"), PARTS, strict=True)))
        return Rows(df, frozenset(keys) & rows.certain, frozenset([*keys, *names]), frozenset(keys) & rows.nodes), changed

    def select(self, q: Query) -> Rows:
        rows = self.group(q.where)
        if q.group_by or any(has_aggregate(e) for e in [*(e for e, _ in q.select), *q.having, *(e for e, _ in q.order)]):
            rows, q = self.grouped(q, rows)
            for e in q.having:
                rows = self.filtered(rows, e)
        chosen = [n for _, n in q.select] if not q.star else sorted(v for v in rows.possible if not v.startswith("__"))
        for e, name in q.select:  # later expressions may use earlier ones
            if e != ("var", name):
                rows = self.bind(rows, name, e)
        keys = [c for e, d in q.order for c in self._sorted(e, d, rows)]
        columns = [c.cast("string").alias(f"{v}{x}") for v in chosen for c, x in zip(self.value(("var", v), rows), PARTS, strict=True)]
        if q.distinct:
            df = rows.df.select(*columns).distinct()
            if keys:  # only what is selected is left to sort by
                keys = [c for e, d in q.order for c in self._sorted(e, d, rows._replace(possible=frozenset(chosen)))]
                df = df.orderBy(*keys)
        else:
            df = (rows.df.orderBy(*keys) if keys else rows.df).select(*(columns or [F.lit(1).alias("__one")]))
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        names = frozenset(chosen)
        return Rows(df, rows.certain & names, names, rows.nodes & names)

    def _sorted(self, e, descending: bool, rows: Rows) -> list[Column]:
        return [c.desc() if descending else c.asc() for c in V.order_key(self.value(e, rows))]

    # -- forms that give triples

    def construct(self, q: Query) -> DataFrame:
        rows = self.group(q.where)
        df = rows.df
        if q.order:
            df = df.orderBy(*(c for e, d in q.order for c in self._sorted(e, d, rows)))
        df = df.offset(q.offset) if q.offset else df
        rows = rows._replace(df=df if q.limit is None else df.limit(q.limit))
        whole = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(f"{v}{x}"), F.lit("\x00")) for v in sorted(rows.possible) for x in PARTS))) if rows.possible else F.lit("")

        def parts(t: Term | Path) -> Value:
            if isinstance(t, Path):
                return V.constant(Term("iri", t.iri))
            if t.kind == "var" and t.value.startswith("__") and t.value not in rows.possible:  # a blank node of its own for each solution
                return Value(F.concat(F.lit(t.value.strip("_")), whole), F.lit("bnode"), _null(), _null())
            return self.value(("var", t.value), rows) if t.kind == "var" else V.constant(t)

        made = []
        for s, p, o in q.template:
            if isinstance(p, Path) and p.op != "iri":
                raise ParseError("a template holds no paths")
            a, b, c = parts(s), parts(p), parts(o)
            ok = (a.kind != "literal") & (b.kind == "iri") & a.text.isNotNull() & c.text.isNotNull()
            made.append(F.when(ok, F.struct(a.text.alias("s"), a.kind.alias("s_kind"), b.text.alias("p"), c.text.alias("o"), c.kind.alias("o_kind"), c.dt.alias("o_dt"), c.lang.alias("o_lang"))))
        return rows.df.select(F.explode(F.array_compact(F.array(*made))).alias("t")).select("t.*").distinct()

    def describe(self, q: Query) -> DataFrame:
        """All triples of the resources described."""
        parts = [self.spark.range(1).select(F.lit(t.value).alias("__s")) for t in q.described if t.kind == "iri"]
        named = sorted(t.value for t in q.described if t.kind == "var")
        rows = self.group(q.where) if named or q.star else None
        for v in sorted(x for x in rows.possible if not x.startswith("__")) if q.star else named:
            if v in rows.possible:
                parts.append(rows.df.where(F.col(f"{v}__kind").isin("iri", "bnode")).select(F.col(v).alias("__s")))
        if not parts:
            return self.quads.limit(0).select(*TERM_COLUMNS)
        return self.quads.join(reduce(DataFrame.union, parts).distinct(), F.col("s") == F.col("__s"), "left_semi").select(*TERM_COLUMNS).distinct()


def variables(e) -> set[str]:
    """The variables of an expression; those of an EXISTS are its own."""
    if not isinstance(e, tuple) or not e:
        return set()
    if e[0] == "var":
        return {e[1]}
    if e[0] == "exists":
        return set()
    return {v for x in e[1:] for v in variables(x)}


def existences(e):
    """The EXISTS within an expression."""
    if isinstance(e, tuple) and e:
        if e[0] == "exists":
            yield e
        else:
            for x in e[1:]:
                yield from existences(x)


def has_aggregate(e) -> bool:
    return isinstance(e, tuple) and bool(e) and (e[0] == "agg" or any(has_aggregate(x) for x in e[1:]))


def substituted(x, name: str, term: Term):
    """An algebra with a term in place of a variable."""
    if isinstance(x, Term):
        return term if x.kind == "var" and x.value == name else x
    if isinstance(x, tuple):
        if x == ("var", name):
            return ("term", term)
        return tuple(substituted(y, name, term) for y in x)
    if isinstance(x, list):
        return [substituted(y, name, term) for y in x]
    if isinstance(x, Group):
        return Group(substituted(x.triples, name, term), substituted(x.steps, name, term), substituted(x.filters, name, term))
    if isinstance(x, Query):
        changed = {k: substituted(getattr(x, k), name, term) for k in ("where", "template", "described", "having", "order")}
        # a selected or grouped variable keeps its name
        keep = lambda pairs: [(substituted(e, name, term), n) for e, n in pairs]
        return Query(x.form, select=keep(x.select), group_by=keep(x.group_by), star=x.star, distinct=x.distinct, limit=x.limit, offset=x.offset, graphs=x.graphs, named=x.named, **changed)
    return x


def inject_values(q: Query, names: list[str], rows: list[list[str]]) -> Query:
    """Bindings for the innermost sub-select that has the variables, so that it aggregates no more than they ask for."""
    values = ("values", (names, [[Term("iri", assert_safe_iri(x)) for x in r] for r in rows]))

    def inner(group: Group) -> Group:
        for kind, x in group.steps:
            if kind == "query":
                return inner(x.where)
            if kind == "union" and len(x) == 1 and any(k == "query" for k, _ in x[0].steps):
                return inner(x[0])
        return group

    inner(q.where).steps.append(values)
    return q


def run(quads: DataFrame, query: str | Query, dataset: str | None = None, subject_filter: str = "", terms: bool = False) -> DataFrame:
    """A query's rows: variables of a SELECT, triples of a CONSTRUCT or DESCRIBE, one boolean ``answer`` of an ASK.

    ``#subjectFilter#`` in the text gives way to a pattern; ?dataset stands for the dataset's IRI.
    With ``terms`` a SELECT also gives the companions of its variables.
    """
    if isinstance(query, str):
        query = parse(query.replace("#subjectFilter#", subject_filter))
    if dataset is not None:
        query = substituted(query, "dataset", Term("iri", assert_safe_iri(dataset)))
    default, named = quads, None
    if query.graphs or query.named:
        named = quads.where(F.col("g").isin(query.named))
        default = quads.where(F.col("g").isin(query.graphs))
        if len(set(query.graphs)) > 1:  # a triple of two graphs is one triple of their union
            default = dedupe(default.select(*TERM_COLUMNS)).withColumn("g", _null())
    compiler = Compiler(default, named)
    if query.form == "construct":
        return compiler.construct(query)
    if query.form == "describe":
        return compiler.describe(query)
    if query.form == "ask":
        return compiler.group(query.where).df.limit(1).agg((F.count("*") > 0).alias("answer"))
    rows = compiler.select(query)
    names = [n for _, n in query.select] or sorted(rows.possible)
    return rows.df if terms else rows.df.select(*names)


def updated(quads: DataFrame, operations: str | list[Update]) -> DataFrame:
    """Quads (the columns of QUAD_COLUMNS) after the operations of an update, in their order."""
    spark = quads.sparkSession
    for u in parse_updates(operations) if isinstance(operations, str) else operations:
        if u.kind == "clear":
            g = F.col("g")
            quads = quads.where({"default": g.isNotNull(), "named": g.isNull(), "all": F.lit(False)}.get(u.graph, ~g.eqNullSafe(F.lit(u.graph))))
            continue
        part = lambda t: (t.value.removeprefix("__label_") if t.kind == "var" else t.value, "bnode" if t.kind == "var" else t.kind, t.dt, t.lang)
        data = [(part(s)[0], part(s)[1], p, *part(o), g, None) for s, p, o, g in u.quads]
        rows = spark.createDataFrame(data, ", ".join(f"{c} string" for c in QUAD_COLUMNS))
        if u.kind == "insert":
            # data are a set with what is there: only the rows that they repeat go
            quads = _less(quads, rows).unionByName(rows.distinct().select(*QUAD_COLUMNS), allowMissingColumns=True)
        else:
            quads = _less(quads, rows)
    return quads


def _less(quads: DataFrame, rows: DataFrame) -> DataFrame:
    keys = [*TERM_COLUMNS, "g"]
    plain = lambda c, x: F.when(x.isNull(), F.lit(V.STRING)).otherwise(x) if c == "o_dt" else F.coalesce(x, F.lit("")) if c == "o_lang" else x
    on = [plain(c, F.col(c)).eqNullSafe(plain(c, F.col(f"__k_{c}"))) for c in keys]
    return quads.join(rows.distinct().select(*(F.col(c).alias(f"__k_{c}") for c in keys)), reduce(Column.__and__, on), "left_anti")


__all__ = ["LANG_STRING", "Compiler", "Group", "ParseError", "Path", "Query", "Term", "Update", "assert_safe_iri", "inject_values", "parse", "parse_updates", "run", "updated"]
