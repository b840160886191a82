"""SPARQL text to an algebra of small objects: patterns, groups, steps and expressions.

Expressions are tuples: ("var", name), ("term", Term), ("agg", name, argument,
distinct, separator), ("call", name, arguments...), ("exists", Group, wanted),
("and" | "or" | "not" | "neg" | "in" | comparison | arithmetic, arguments...).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urljoin

from quadloom.sources.tables import RDF, RDF_TYPE, XSD

_NAME = r"[A-Za-z_\u00C0-\uFFFD][\w\u00B7.-]*(?<!\.)"
_LOCAL = r"(?:[\w:\u00C0-\uFFFD]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:[\w:\u00B7.\u00C0-\uFFFD-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])*(?:[\w:\u00B7\u00C0-\uFFFD-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]))?"
_TOKEN = re.compile(
    r"\s*(?:\#[^\n]*(?:\n|\Z)"
    r"|(?P<iri><[^<>\"{}|^`\\\s]*>)"
    r"|(?P<var>[?$]\w+)"
    r'|(?P<str>"""(?:"{0,2}(?:[^"\\]|\\.))*"""|' + r"'''(?:'{0,2}(?:[^'\\]|\\.))*'''" + r'|"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*')"
    r"|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)"
    r"|(?P<num>\d+\.?\d*[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?|\d+\.\d+|\d+)"
    rf"|(?P<blank>_:[\w.-]*\w)"
    rf"|(?P<name>(?:{_NAME})?:(?:{_LOCAL})?|{_NAME})"
    r"|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,|/^=<>!*+?-]))",
    re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    kind: str  # var, iri, literal
    value: str
    dt: str | None = None
    lang: str | None = None


@dataclass
class Path:
    op: str  # iri, seq, alt, inv, plus, star, maybe, not
    parts: list
    iri: str | None = None


@dataclass
class Group:
    triples: list[tuple] = field(default_factory=list)
    steps: list[tuple] = field(default_factory=list)  # (kind, payload) in order
    filters: list = field(default_factory=list)


@dataclass
class Query:
    form: str  # select, construct, ask, describe
    where: Group
    select: list = field(default_factory=list)  # (expression, name)
    star: bool = False
    distinct: bool = False
    template: list = field(default_factory=list)
    described: list = field(default_factory=list)
    group_by: list = field(default_factory=list)  # (expression, name)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0
    graphs: list = field(default_factory=list)
    named: list = field(default_factory=list)


@dataclass
class Update:
    """One operation: clear (a graph, "default", "named" or "all"), insert or delete (quads as terms)."""

    kind: str
    graph: str | None = None
    quads: list = field(default_factory=list)  # (s, p, o, graph or None)


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" else _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.DOTALL)


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                if text[at:].strip():
                    raise ParseError(f"cannot read {text[at : at + 30]!r}")
                break
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.at, self.prefixes, self.base, self.blanks = 0, {}, "", 0

    # -- tokens

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        out = self.peek()
        self.at += 1
        return out

    def is_word(self, *words: str) -> bool:
        return self.peek()[0] == "name" and self.peek()[1].upper() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def op(self, *ops: str) -> str | None:
        if self.peek()[0] == "op" and self.peek()[1] in ops:
            return self.next()[1]
        return None

    def need(self, op: str) -> None:
        if not self.op(op):
            raise ParseError(f"{op} expected, {self.peek()[1]!r} found")

    def need_word(self, word: str) -> None:
        if not self.word(word):
            raise ParseError(f"{word} expected, {self.peek()[1]!r} found")

    def variable(self) -> str:
        kind, text = self.next()
        if kind != "var":
            raise ParseError(f"variable expected, {text!r} found")
        return text[1:]

    def number(self) -> int:
        kind, text = self.next()
        if kind != "num" or not text.isdigit():
            raise ParseError(f"number expected, {text!r} found")
        return int(text)

    # -- queries

    def prologue(self) -> None:
        while True:
            if self.word("PREFIX"):
                kind, name = self.next()
                if kind != "name" or not name.endswith(":"):
                    raise ParseError(f"prefix expected, {name!r} found")
                self.prefixes[name[:-1]] = self.iri()
            elif self.word("BASE"):
                self.base = self.iri()
            else:
                return

    def resolved(self, iri: str) -> str:
        """An IRI upon the base; one with a scheme stands for itself."""
        return urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", iri) else iri

    def iri(self) -> str:
        t = self.term()
        if t.kind != "iri":
            raise ParseError(f"IRI expected, {t.value!r} found")
        return t.value

    def query(self) -> Query:
        self.prologue()
        if self.is_word("SELECT"):
            out = self.select_query()
        elif self.word("CONSTRUCT"):
            out = self.construct()
        elif self.word("DESCRIBE"):
            out = self.describe()
        elif self.word("ASK"):
            out = self.rest(Query("ask", Group()))
        else:
            raise ParseError("SELECT, CONSTRUCT, DESCRIBE or ASK expected")
        self.end()
        return out

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise ParseError(f"end expected, {self.peek()[1]!r} found")

    def construct(self) -> Query:
        template: list[tuple] = []
        if self.peek()[1] != "{":  # the short form: what is found is what is made
            q = self.rest(Query("construct", Group()))
            if q.where.filters or any(kind != "triples" for kind, _ in q.where.steps):
                raise ParseError("the short form holds triples alone")
            q.template = [t for _, triples in q.where.steps for t in triples]
            return q
        self.need("{")
        while not self.op("}"):
            self.triples(template)
        return self.rest(Query("construct", Group(), template=template))

    def describe(self) -> Query:
        q = Query("describe", Group())
        while self.peek()[0] in ("var", "iri") or self.peek()[0] == "name" and ":" in self.peek()[1]:
            q.described.append(self.term())
        q.star = bool(self.op("*"))
        self.rest(q, where=False)
        return q

    def select_query(self) -> Query:
        self.need_word("SELECT")
        q = Query("select", Group(), distinct=self.word("DISTINCT", "REDUCED"))
        while self.peek()[0] == "var" or self.peek()[1] in ("(", "*"):
            if self.op("*"):
                q.star = True
            elif self.op("("):
                e = self.expression()
                self.need_word("AS")
                q.select.append((e, self.variable()))
                self.need(")")
            else:
                v = self.variable()
                q.select.append((("var", v), v))
        if not q.select and not q.star:
            raise ParseError("what to select is missing")
        return self.rest(q)

    def rest(self, q: Query, where: bool = True) -> Query:
        while self.word("FROM"):
            (q.named if self.word("NAMED") else q.graphs).append(self.iri())
        if self.word("WHERE") or where or self.peek()[1] == "{":
            q.where = self.group()
        if self.word("GROUP"):
            self.need_word("BY")
            while True:
                if self.op("("):
                    e = self.expression()
                    q.group_by.append((e, self.variable() if self.word("AS") else None))
                    self.need(")")
                elif self.peek()[0] == "var":
                    v = self.variable()
                    q.group_by.append((("var", v), v))
                elif self.peek()[0] in ("iri", "name") and not self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                    q.group_by.append((self.primary(), None))
                else:
                    break
        if self.word("HAVING"):
            while self.peek()[1] == "(" or self.peek()[0] == "name" and not self.is_word("ORDER", "LIMIT", "OFFSET", "VALUES"):
                q.having.append(self.primary())
        if self.word("ORDER"):
            self.need_word("BY")
            while True:
                if self.is_word("ASC", "DESC"):
                    descending = self.next()[1].upper() == "DESC"
                    q.order.append((self.primary(), descending))
                elif self.peek()[0] == "var" or self.peek()[1] == "(" or self.peek()[0] == "name" and not self.is_word("LIMIT", "OFFSET", "VALUES"):
                    q.order.append((self.primary(), False))
                else:
                    break
        while self.is_word("LIMIT", "OFFSET"):
            if self.word("LIMIT"):
                q.limit = self.number()
            elif self.word("OFFSET"):
                q.offset = self.number()
        if self.word("VALUES"):
            q.where = Group(steps=[("group", q.where), ("values", self.values())])
        return q

    # -- patterns

    def group(self) -> Group:
        self.need("{")
        g = Group()
        while not self.op("}"):
            if self.is_word("SELECT"):
                g.steps.append(("query", self.select_query()))
            elif self.word("OPTIONAL"):
                self._flush(g)
                g.steps.append(("optional", self.group()))
            elif self.word("MINUS"):
                self._flush(g)
                g.steps.append(("minus", self.group()))
            elif self.word("FILTER"):
                g.filters.append(self.primary())
            elif self.word("BIND"):
                self._flush(g)
                self.need("(")
                e = self.expression()
                self.need_word("AS")
                g.steps.append(("bind", (self.variable(), e)))
                self.need(")")
            elif self.word("VALUES"):
                self._flush(g)
                g.steps.append(("values", self.values()))
            elif self.word("GRAPH"):
                self._flush(g)
                graph = self.term()
                g.steps.append(("graph", (graph, self.group())))
            elif self.peek()[1] == "{":
                self._flush(g)
                parts = [self.group()]
                while self.word("UNION"):
                    parts.append(self.group())
                g.steps.append(("union", parts))
            else:
                self.triples(g.triples)
            self.op(".")
        self._flush(g)
        return g

    @staticmethod
    def _flush(g: Group) -> None:
        if g.triples:
            g.steps.append(("triples", g.triples))
            g.triples = []

    def values(self) -> tuple[list[str], list[list[Term | None]]]:
        names, rows = [], []
        wrapped = bool(self.op("("))
        if wrapped:
            while not self.op(")"):
                names.append(self.variable())
        else:
            names.append(self.variable())
        self.need("{")
        while not self.op("}"):
            if wrapped:
                self.need("(")
            row = [None if self.word("UNDEF") else self.literal_or_iri() for _ in names]
            if wrapped:
                self.need(")")
            rows.append(row)
        return names, rows

    def literal_or_iri(self) -> Term:
        sign = self.op("+", "-")
        t = self.term()
        return Term("literal", sign + t.value, t.dt) if sign else t

    def blank(self) -> Term:
        self.blanks += 1
        return Term("var", f"__b{self.blanks}")

    def triples(self, out: list) -> None:
        alone = self.peek()[1] in ("[", "(")
        s = self.node(out)
        if alone and self.peek()[1] in (".", "}"):
            self.op(".")
            return
        self.properties(s, out, (".", "}"))
        self.op(".")

    def properties(self, s: Term, out: list, ends: tuple[str, ...]) -> None:
        while True:
            p = self.path()
            while True:
                out.append((s, p, self.node(out)))
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.peek()[1] in ends:
                return

    def node(self, out: list) -> Term:
        if self.op("["):
            s = self.blank()
            if self.peek()[1] != "]":
                self.properties(s, out, ("]",))
            self.need("]")
            return s
        if self.op("("):  # a list of nodes
            first = last = None
            while not self.op(")"):
                cell = self.blank()
                if last is not None:
                    out.append((last, Path("iri", [], f"{RDF}rest"), cell))
                out.append((cell, Path("iri", [], f"{RDF}first"), self.node(out)))
                first, last = first or cell, cell
            if last is None:
                return Term("iri", f"{RDF}nil")
            out.append((last, Path("iri", [], f"{RDF}rest"), Term("iri", f"{RDF}nil")))
            return first
        return self.literal_or_iri()

    def path(self) -> Term | Path:
        if self.peek()[0] == "var":
            return self.term()
        parts = [self.sequence()]
        while self.op("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Path("alt", parts)

    def sequence(self) -> Path:
        parts = [self.step()]
        while self.op("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else Path("seq", parts)

    def step(self) -> Path:
        if self.op("^"):
            return Path("inv", [self.step()])
        if self.op("!"):
            wrapped = bool(self.op("("))
            parts = []
            while True:
                parts.append(Path("inv", [self.predicate()]) if self.op("^") else self.predicate())
                if not (wrapped and self.op("|")):
                    break
            if wrapped:
                self.need(")")
            return Path("not", parts)
        if self.op("("):
            inner = self.path()
            self.need(")")
        else:
            inner = self.predicate()
        if mark := self.op("+", "*", "?"):
            return Path({"+": "plus", "*": "star", "?": "maybe"}[mark], [inner])
        return inner

    def predicate(self) -> Path:
        if self.peek() == ("name", "a"):
            self.next()
            return Path("iri", [], RDF_TYPE)
        return Path("iri", [], self.iri())

    def term(self) -> Term:
        kind, text = self.next()
        if kind == "var":
            return Term("var", text[1:])
        if kind == "iri":
            return Term("iri", self.resolved(text[1:-1]))
        if kind == "blank":
            return Term("var", f"__label_{text[2:]}")
        if kind == "num":
            return Term("literal", text, f"{XSD}{'double' if 'e' in text.lower() else 'decimal' if '.' in text else 'integer'}")
        if kind == "str":
            quotes = 3 if text[:3] in ('"""', "'''") else 1
            value = unescaped(text[quotes:-quotes])
            if self.peek()[0] == "lang":
                return Term("literal", value, f"{RDF}langString", self.next()[1][1:].lower())
            if self.op("^^"):
                return Term("literal", value, self.iri())
            return Term("literal", value, f"{XSD}string")
        if kind == "name" and ":" in text:
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ParseError(f"prefix {prefix!r} is not declared")
            return Term("iri", self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "name" and text in ("true", "false"):
            return Term("literal", text, f"{XSD}boolean")
        raise ParseError(f"term expected, {text!r} found")

    # -- expressions, from the loosest to the tightest

    def expression(self):
        left = self.conjunction()
        while self.op("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.relation()
        while self.op("&&"):
            left = ("and", left, self.relation())
        return left

    def relation(self):
        left = self.sum()
        if found := self.op("=", "!=", "<", ">", "<=", ">="):
            return (found, left, self.sum())
        negated = self.is_word("NOT") and self.peek(1)[1].upper() == "IN" and self.word("NOT")
        if self.word("IN"):
            found = ("in", left, *self.arguments())
            return ("not", found) if negated else found
        return left

    def sum(self):
        left = self.product()
        while found := self.op("+", "-"):
            left = (found, left, self.product())
        return left

    def product(self):
        left = self.unary()
        while found := self.op("*", "/"):
            left = (found, left, self.unary())
        return left

    def unary(self):
        if self.op("!"):
            return ("not", self.unary())
        if self.op("-"):
            return ("neg", self.unary())
        if self.op("+"):
            return self.unary()
        return self.primary()

    def primary(self):
        if self.op("("):
            e = self.expression()
            self.need(")")
            return e
        kind, text = self.peek()
        if kind == "var":
            return ("var", self.variable())
        if kind == "name" and ":" not in text and text not in ("true", "false"):
            return self.call()
        t = self.term()
        if t.kind == "iri" and self.peek()[1] == "(":  # a cast
            return ("call", t.value, *self.arguments())
        return ("term", t)

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.op(")"):
            out.append(self.expression())
            if not self.op(",") and self.peek()[1] != ")":
                raise ParseError(f", or ) expected, {self.peek()[1]!r} found")
        return out

    def call(self):
        name = self.next()[1].upper()
        if name in ("EXISTS", "NOT"):
            if name == "NOT":
                self.need_word("EXISTS")
            return ("exists", self.group(), name == "EXISTS")
        if name not in AGGREGATES:
            return ("call", name, *self.arguments())
        self.need("(")
        distinct, separator = self.word("DISTINCT"), " "
        inner = None if self.op("*") else self.expression()
        if name == "GROUP_CONCAT" and self.op(";"):
            self.need_word("SEPARATOR")
            self.need("=")
            separator = self.term().value
        self.need(")")
        return ("agg", name, inner, distinct, separator)

    # -- updates

    def updates(self) -> list[Update]:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                return out
            if self.word("CLEAR", "DROP"):
                self.word("SILENT")
                if self.word("GRAPH"):
                    out.append(Update("clear", self.iri()))
                elif self.is_word("DEFAULT", "NAMED", "ALL"):
                    out.append(Update("clear", self.next()[1].lower()))
                else:
                    raise ParseError(f"a graph expected, {self.peek()[1]!r} found")
            elif self.is_word("INSERT", "DELETE"):
                kind = self.next()[1].lower()
                self.need_word("DATA")
                out.append(Update(kind, quads=self.data()))
            else:
                raise ParseError(f"CLEAR, DROP, INSERT DATA or DELETE DATA expected, {self.peek()[1]!r} found")
            if not self.op(";"):
                self.end()
                return out

    def data(self) -> list[tuple]:
        self.need("{")
        out: list[tuple] = []
        while not self.op("}"):
            graph, triples = None, []
            if self.word("GRAPH"):
                graph = self.iri()
                self.need("{")
                while not self.op("}"):
                    self.triples(triples)
            else:
                self.triples(triples)
            for s, p, o in triples:
                if isinstance(p, Term) or p.op != "iri" or any(t.kind == "var" and not t.value.startswith("__") for t in (s, o)):
                    raise ParseError("data holds no variables and no paths")
                out.append((s, p.iri, o, graph))
            self.op(".")
        return out


def parse(text: str) -> Query:
    return Parser(text).query()


def parse_updates(text: str) -> list[Update]:
    return Parser(text).updates()
