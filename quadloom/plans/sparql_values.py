"""SPARQL expressions as Spark columns.

A value is a term in four columns: text, kind (iri, bnode, literal), datatype
and language. An error and an unbound variable are a null text, so that errors
pass through functions and three-valued logic is SQL's own.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.plans.sparql_parser import ParseError, Term
from quadloom.sources.tables import LANG_STRING, XSD

PARTS = ("", "__kind", "__dt", "__lang")
STRING, INTEGER, DECIMAL, DOUBLE, BOOLEAN, DATE, DATE_TIME = (f"{XSD}{x}" for x in ("string", "integer", "decimal", "double", "boolean", "date", "dateTime"))
#: Datatypes of whole numbers, and of all numbers. Fixed values.
WHOLE = [f"{XSD}{x}" for x in ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")]
NUMERIC = [*WHOLE, DECIMAL, DOUBLE, f"{XSD}float"]
_BIG = "decimal(38,12)"


def _null() -> Column:
    return F.lit(None).cast("string")


class Value(NamedTuple):
    text: Column
    kind: Column
    dt: Column
    lang: Column


def literal(text: Column, dt: str | Column) -> Value:
    return Value(text.cast("string"), F.lit("literal"), dt if isinstance(dt, Column) else F.lit(dt), _null())


def constant(t: Term) -> Value:
    return Value(F.lit(t.value), F.lit("iri" if t.kind == "iri" else "literal"), F.lit(t.dt).cast("string"), F.lit(t.lang).cast("string"))


def datatype(v: Value) -> Column:
    """A literal's datatype; with a language it is langString, with none stated string."""
    return F.when(F.coalesce(v.lang, F.lit("")) != "", F.lit(LANG_STRING)).otherwise(F.coalesce(v.dt, F.lit(STRING)))


def language(v: Value) -> Column:
    return F.lower(F.coalesce(v.lang, F.lit("")))


def same_term(a: Value, b: Value) -> Column:
    literals = (a.kind != "literal") | (datatype(a) == datatype(b)) & (language(a) == language(b))
    return (a.text == b.text) & (a.kind == b.kind) & literals


def is_number(v: Value) -> Column:
    return (v.kind == "literal") & F.coalesce(v.dt.isin(NUMERIC), F.lit(False)) & v.text.try_cast("double").isNotNull()


def number(v: Value) -> Column:
    """A numeric literal as a double; null for everything else."""
    return F.when(is_number(v), v.text.try_cast("double"))


def is_text(v: Value) -> Column:
    """A string without or with a language."""
    return (v.kind == "literal") & datatype(v).isin(STRING, LANG_STRING)


def moment(v: Value) -> Column:
    """A date or a time as a timestamp; null for everything else."""
    return F.when((v.kind == "literal") & F.coalesce(v.dt.isin(DATE, DATE_TIME), F.lit(False)), v.text.try_cast("timestamp"))


def equal(a: Value, b: Value) -> Column:
    """=: numbers, times and booleans by value, others as terms."""
    x, y, t, u = number(a), number(b), moment(a), moment(b)
    flags = (datatype(a) == BOOLEAN) & (datatype(b) == BOOLEAN)
    by_value = F.when(x.isNotNull() & y.isNotNull(), x == y).when(t.isNotNull() & u.isNotNull() & (a.dt == b.dt), t == u).when(flags, _flag(a) == _flag(b))
    return F.when(a.text.isNull() | b.text.isNull(), F.lit(None)).otherwise(F.coalesce(by_value, same_term(a, b)))


def _flag(v: Value) -> Column:
    return F.when(v.text.isin("true", "1"), F.lit(True)).when(v.text.isin("false", "0"), F.lit(False))


def compared(op: str, a: Value, b: Value) -> Column:
    """<, >, <=, >= of two numbers, times, booleans or strings; an error (null) for other pairs."""
    do = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    x, y, t, u = number(a), number(b), moment(a), moment(b)
    plain = (a.kind == "literal") & (b.kind == "literal") & (datatype(a) == STRING) & (datatype(b) == STRING)
    flags = (datatype(a) == BOOLEAN) & (datatype(b) == BOOLEAN)
    # two whole numbers beyond what doubles tell apart
    whole = F.when(a.dt.isin(WHOLE) & b.dt.isin(WHOLE), do(a.text.try_cast("decimal(38,0)"), b.text.try_cast("decimal(38,0)")))
    return (
        F.when(x.isNotNull() & y.isNotNull(), F.coalesce(whole, do(x, y)))
        .when(t.isNotNull() & u.isNotNull(), do(t, u))
        .when(plain, do(a.text, b.text))
        .when(flags, do(_flag(a).cast("int"), _flag(b).cast("int")))
    )


def truth(v: Value) -> Column:
    """The effective boolean value."""
    dt = datatype(v)
    return F.when(v.kind == "literal", F.when(dt == BOOLEAN, _flag(v)).when(is_number(v), (number(v) != 0) & ~F.isnan(number(v))).when(dt.isin(STRING, LANG_STRING), F.length(v.text) > 0))


def order_key(v: Value) -> list[Column]:
    """Columns that sort terms: unbound, blank nodes, IRIs, numbers, times, other literals."""
    rank = F.when(v.text.isNull(), 0).when(v.kind == "bnode", 1).when(v.kind == "iri", 2).when(number(v).isNotNull(), 3).when(moment(v).isNotNull(), 4).otherwise(5)
    return [rank, F.coalesce(number(v), moment(v).cast("double"), F.lit(0.0)), F.coalesce(v.text, F.lit("")), F.coalesce(language(v), F.lit(""))]


def decimal_text(x: Column) -> Column:
    """A decimal as text, without zeros at its end."""
    text = x.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def double_text(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Numbers: whole with whole stays whole, but for a quotient; a double makes a double; others are decimals."""
    whole = a.dt.isin(WHOLE) & b.dt.isin(WHOLE)
    floating = ~a.dt.isin([*WHOLE, DECIMAL]) | ~b.dt.isin([*WHOLE, DECIMAL])
    both = is_number(a) & is_number(b)
    x, y = number(a), number(b)
    do = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    p, q = a.text.try_cast(_BIG), b.text.try_cast(_BIG)
    exact = do(a.text.try_cast("decimal(38,0)"), b.text.try_cast("decimal(38,0)")).cast("string") if op != "/" else decimal_text(do(p, q))
    text = F.when(both, F.when(floating, double_text(do(x, y))).when(whole, exact).otherwise(decimal_text(do(p, q))))
    return literal(text, F.when(floating, F.lit(DOUBLE)).when(whole & F.lit(op != "/"), F.lit(INTEGER)).otherwise(F.lit(DECIMAL)))


def rounded(v: Value, f) -> Value:
    """A function of a number that keeps its datatype."""
    floating = ~v.dt.isin([*WHOLE, DECIMAL])
    return literal(F.when(is_number(v), F.when(floating, double_text(f(number(v)).cast("double"))).otherwise(decimal_text(f(v.text.try_cast(_BIG))))), F.when(v.dt.isin(WHOLE), F.lit(INTEGER)).otherwise(v.dt))


def like(v: Value, text: Column) -> Value:
    """A text with the datatype and language of a string."""
    return Value(F.when(is_text(v), text), F.lit("literal"), datatype(v), v.lang)


def _strings(a: Value, b: Value) -> Column:
    """Whether two arguments go together: the second has no language or the first's."""
    return is_text(a) & is_text(b) & ((language(b) == "") | (language(a) == language(b)))


def _before(a: Value, b: Value) -> Value:
    at = F.instr(a.text, b.text)
    found = like(a, F.substr(a.text, F.lit(1), at - 1))
    ok = _strings(a, b)
    # where the second does not occur: an empty string without a language
    return Value(F.when(ok, F.when(at > 0, found.text).otherwise("")), found.kind, F.when(at > 0, found.dt).otherwise(F.lit(STRING)), F.when(at > 0, found.lang))


def _after(a: Value, b: Value) -> Value:
    at = F.instr(a.text, b.text)
    found = like(a, F.substr(a.text, at + F.length(b.text)))
    ok = _strings(a, b)
    return Value(F.when(ok, F.when(at > 0, found.text).otherwise("")), found.kind, F.when(at > 0, found.dt).otherwise(F.lit(STRING)), F.when(at > 0, found.lang))


def _concat(values: list[Value]) -> Value:
    if not values:
        return literal(F.lit(""), STRING)
    text = F.concat(*(F.when(is_text(v), v.text) for v in values))
    first = language(values[0])
    shared = reduce(Column.__and__, [language(v) == first for v in values]) & (first != "")
    return Value(text, F.lit("literal"), F.when(shared, F.lit(LANG_STRING)).otherwise(F.lit(STRING)), F.when(shared, values[0].lang))


def _flags(values: list[Value], at: int) -> Column:
    """Regular expression flags as a prefix of the pattern."""
    return F.when(F.length(values[at].text) > 0, F.concat(F.lit("(?"), values[at].text, F.lit(")"))).otherwise("") if len(values) > at else F.lit("")


def _clock(part: str) -> Column:
    return lambda v: F.when(v.dt.isin(DATE, DATE_TIME), F.regexp_extract(v.text, part, 1).try_cast("int"))


def _zone(v: Value) -> Column:
    return F.when(moment(v).isNotNull(), F.regexp_extract(v.text, r"T.*?(Z|[+-]\d\d:\d\d)$", 1))


def _duration(zone: Column) -> Column:
    hours, minutes = F.substr(zone, F.lit(2), F.lit(2)).try_cast("int"), F.substr(zone, F.lit(5), F.lit(2)).try_cast("int")
    signed = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    return F.when(zone == "Z", F.lit("PT0S")).when(zone != "", F.when((hours == 0) & (minutes == 0), F.lit("PT0S")).otherwise(signed))


def _cast(name: str, v: Value) -> Value:
    plain = (v.kind == "literal") & (datatype(v) == STRING)
    from_number, flag = is_number(v), F.when(datatype(v) == BOOLEAN, _flag(v))
    source = F.when(plain | from_number, F.trim(v.text)).when(flag.isNotNull(), F.when(flag, "1").otherwise("0"))
    if name == INTEGER:
        return literal(_whole(plain, source), INTEGER)
    if name == DECIMAL:
        return literal(F.when(~plain | source.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), decimal_text(source.try_cast(_BIG))), DECIMAL)
    if name in (DOUBLE, f"{XSD}float"):
        return literal(double_text(source.try_cast("double")), name)
    if name == BOOLEAN:
        return literal(F.when(flag.isNotNull(), flag).when(from_number, number(v) != 0).when(plain, _flag(v)).cast("string"), BOOLEAN)
    if name == DATE:
        return literal(F.when(v.kind == "literal", F.date_format(v.text.try_cast("date"), "yyyy-MM-dd")), DATE)
    if name == DATE_TIME:
        held = F.when(v.dt == DATE, F.concat(v.text, F.lit("T00:00:00"))).otherwise(v.text)
        return literal(F.when((v.kind == "literal") & v.text.try_cast("timestamp").isNotNull(), held), DATE_TIME)
    raise ParseError(f"function {name} is not known")


def _whole(plain: Column, source: Column) -> Column:
    exact = F.when(source.rlike(r"^[+-]?\d+$"), source.try_cast("decimal(38,0)").cast("string"))
    cut = F.regexp_replace(source.try_cast("decimal(38,12)").cast("string"), r"\..*$", "")
    return F.when(plain, exact).otherwise(F.coalesce(exact, cut))


def call(name: str, args: list[Value]) -> Value:
    """A built-in function of values."""
    a = args[0] if args else None
    b = args[1] if len(args) > 1 else None
    flag = lambda c: literal(c.cast("string"), BOOLEAN)
    bound = lambda c: F.when(a.text.isNotNull(), c)
    if name == f"{XSD}string":
        return literal(a.text, STRING)
    if name.startswith(XSD):
        return _cast(name, a)
    found = {
        "STR": lambda: literal(F.when(a.kind != "bnode", a.text), STRING),
        "IRI": lambda: Value(F.when((a.kind == "iri") | (datatype(a) == STRING), a.text), F.lit("iri"), _null(), _null()),
        "LANG": lambda: literal(F.when(a.kind == "literal", F.coalesce(a.lang, F.lit(""))), STRING),
        "DATATYPE": lambda: Value(F.when(a.kind == "literal", datatype(a)), F.lit("iri"), _null(), _null()),
        "LANGMATCHES": lambda: flag(F.when(b.text == "*", a.text != "").otherwise((F.lower(a.text) == F.lower(b.text)) | F.lower(a.text).startswith(F.concat(F.lower(b.text), F.lit("-"))))),
        "SAMETERM": lambda: flag(F.when(a.text.isNotNull() & b.text.isNotNull(), same_term(a, b))),
        "ISIRI": lambda: flag(bound(a.kind == "iri")),
        "ISBLANK": lambda: flag(bound(a.kind == "bnode")),
        "ISLITERAL": lambda: flag(bound(a.kind == "literal")),
        "ISNUMERIC": lambda: flag(bound(is_number(a))),
        "STRLANG": lambda: Value(F.when(datatype(a) == STRING, a.text), F.lit("literal"), F.lit(LANG_STRING), F.lower(b.text)),
        "STRDT": lambda: Value(F.when(datatype(a) == STRING, a.text), F.lit("literal"), b.text, _null()),
        "BNODE": lambda: Value(F.regexp_replace(F.uuid(), "-", "") if a is None else F.md5(a.text), F.lit("bnode"), _null(), _null()),
        "UUID": lambda: Value(F.concat(F.lit("urn:uuid:"), F.uuid()), F.lit("iri"), _null(), _null()),
        "STRUUID": lambda: literal(F.uuid(), STRING),
        "RAND": lambda: literal(F.rand(), DOUBLE),
        "NOW": lambda: literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), DATE_TIME),
        "ABS": lambda: rounded(a, F.abs),
        "CEIL": lambda: rounded(a, F.ceil),
        "FLOOR": lambda: rounded(a, F.floor),
        "ROUND": lambda: rounded(a, lambda x: F.floor(x + 0.5)),
        "CONCAT": lambda: _concat(args),
        "STRLEN": lambda: literal(F.when(is_text(a), F.length(a.text)), INTEGER),
        "UCASE": lambda: like(a, F.upper(a.text)),
        "LCASE": lambda: like(a, F.lower(a.text)),
        "ENCODE_FOR_URI": lambda: literal(F.when(is_text(a), F.replace(F.replace(F.replace(F.url_encode(a.text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))), STRING),
        "CONTAINS": lambda: flag(F.when(_strings(a, b), F.contains(a.text, b.text))),
        "STRSTARTS": lambda: flag(F.when(_strings(a, b), F.startswith(a.text, b.text))),
        "STRENDS": lambda: flag(F.when(_strings(a, b), F.endswith(a.text, b.text))),
        "STRBEFORE": lambda: _before(a, b),
        "STRAFTER": lambda: _after(a, b),
        "SUBSTR": lambda: like(a, F.substr(a.text, F.greatest(number(b), F.lit(1)).cast("int"), *([F.greatest(number(args[2]) + F.least(number(b) - 1, F.lit(0)), F.lit(0)).cast("int")] if len(args) > 2 else []))),
        "REPLACE": lambda: like(a, F.regexp_replace(a.text, F.concat(_flags(args, 3), b.text), args[2].text)),
        "REGEX": lambda: flag(F.when(is_text(a), F.rlike(a.text, F.concat(_flags(args, 2), b.text)))),
        "YEAR": lambda: literal(_clock(r"^(-?\d+)-")(a), INTEGER),
        "MONTH": lambda: literal(_clock(r"^-?\d+-(\d\d)")(a), INTEGER),
        "DAY": lambda: literal(_clock(r"^-?\d+-\d\d-(\d\d)")(a), INTEGER),
        "HOURS": lambda: literal(_clock(r"T(\d\d)")(a), INTEGER),
        "MINUTES": lambda: literal(_clock(r"T\d\d:(\d\d)")(a), INTEGER),
        "SECONDS": lambda: literal(F.when(a.dt == DATE_TIME, decimal_text(F.regexp_extract(a.text, r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1).try_cast(_BIG))), DECIMAL),
        "TZ": lambda: literal(_zone(a), STRING),
        "TIMEZONE": lambda: literal(_duration(_zone(a)), f"{XSD}dayTimeDuration"),
        "MD5": lambda: literal(F.when(is_text(a), F.md5(a.text)), STRING),
        "SHA1": lambda: literal(F.when(is_text(a), F.sha1(a.text)), STRING),
    }
    for bits in (256, 384, 512):
        found[f"SHA{bits}"] = lambda bits=bits: literal(F.when(is_text(a), F.sha2(a.text, bits)), STRING)
    found["URI"], found["ISURI"] = found["IRI"], found["ISIRI"]
    if name not in found:
        raise ParseError(f"function {name} is not known")
    try:
        return found[name]()
    except (AttributeError, IndexError) as e:
        raise ParseError(f"function {name} lacks arguments") from e


def first_of(values: list[Value]) -> Value:
    """The first value without an error."""
    pick = lambda i: reduce(lambda c, v: c.when(v.text.isNotNull(), v[i]), values[1:], F.when(values[0].text.isNotNull(), values[0][i]))
    return Value(*(pick(i) for i in range(4)))


def either(test: Column, yes: Value, no: Value) -> Value:
    return Value(*(F.when(test, yes[i]).when(~test, no[i]) for i in range(4)))
