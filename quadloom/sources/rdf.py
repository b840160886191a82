"""RDF files as quads: line formats in the JVM, others parsed one file a task."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.sources.tables import LANG_STRING, QUAD_COLUMNS, RDF, RDF_TYPE, XSD

#: Formats by extension and media type, the preferred first.
FORMATS = [("nq", "application/n-quads"), ("nt", "application/n-triples"), ("ttl", "text/turtle"), ("jsonld", "application/ld+json"), ("rdf", "application/rdf+xml"), ("trig", "application/trig")]

_NODE = r"(<[^<>\s]*>|_:[^\s]+)"
# a literal ends at its line's last quote: what may follow it holds none, and no long text is matched step by step
_OBJECT = r'(<[^<>\s]*>|_:[^\s]+|".*"(?:@[A-Za-z0-9-]+|\^\^<[^<>\s]*>)?)'
_LINE = rf"^\s*{_NODE}\s*(<[^<>\s]*>)\s*{_OBJECT}\s*{_NODE}?\s*\.\s*(?:#.*)?$"


def format_for(declared: str | None, name: str | None, served: str | None) -> tuple[str | None, bool]:
    """The format that counts, of what was declared, named and served; and whether declared and served differ."""
    by_type = {t: e for e, t in FORMATS}
    plain = lambda x: by_type.get(re.sub(r"\+(gzip|zip)$", "", (x or "").split(";")[0].strip().lower()))
    ending = re.search(r"\.([a-z]+)(?:\.gz|\.zip)?$", (name or "").lower())
    named = ending[1] if ending and ending[1] in dict(FORMATS) else None
    got = plain(served)
    return got or plain(declared) or named, bool(got and plain(declared) and got != plain(declared))


def preferred(distributions: DataFrame) -> DataFrame:
    """distributions (media_type, compressed, ...) in the order to try: by format, compressed first."""
    rank = F.array_position(F.array(*(F.lit(t) for _, t in FORMATS)), F.col("media_type"))
    return distributions.where(rank > 0).orderBy(rank, F.col("compressed").desc())


def _unescaped(text: Column) -> Column:
    """N-Triples escapes undone; texts without a backslash are left as they are."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))
    single = lambda x: F.element_at(F.create_map(*(F.lit(y) for p in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f")) for y in p)), x)
    code = lambda x: F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
    undone = F.transform(parts, lambda x: F.when(~x.startswith("\\"), x).when(F.lower(x).rlike(r"^\\u[0-9a-f]{4}"), code(x)).otherwise(F.coalesce(single(x), F.substring(x, 2, 1))))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(undone, "")).otherwise(text)


def parse_lines(lines: DataFrame, dataset: str | None = None) -> DataFrame:
    """Quads of N-Triples or N-Quads lines (value); blank and comment lines are nothing, others fail the job."""
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    held = rows.select("value", *(part(i).alias(n) for i, n in enumerate(("s", "p", "o", "g"), 1)))
    held = held.withColumn("s", F.when(F.col("s") != "", F.col("s")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), "value")).cast("string")))
    iri = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    kind = lambda c: F.when(F.col(c).startswith("<"), "iri").when(F.col(c).startswith("_:"), "bnode").when(F.col(c).startswith('"'), "literal")
    text = lambda c: F.when(F.col(c).startswith("<"), iri(c)).when(F.col(c).startswith("_:"), F.substring(c, 3, 1 << 30))
    literal = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^<>\s]*)>)?$'
    lang, dt = (F.regexp_extract("o", literal, i) for i in (2, 3))
    is_literal = F.col("o").startswith('"')
    return held.select(
        text("s").alias("s"), kind("s").alias("s_kind"), iri("p").alias("p"),
        F.when(is_literal, _unescaped(F.regexp_extract("o", literal, 1))).otherwise(text("o")).alias("o"), kind("o").alias("o_kind"),
        F.when(is_literal, F.when(lang != "", F.lit(LANG_STRING)).when(dt != "", dt).otherwise(F.lit(f"{XSD}string"))).alias("o_dt"),
        F.when(is_literal & (lang != ""), F.lower(lang)).alias("o_lang"), text("g").alias("g"), F.lit(dataset).cast("string").alias("dataset"),
    ).select(*QUAD_COLUMNS)


def read_lines(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """N-Triples and N-Quads files, plain or gzipped; plain ones are split."""
    return parse_lines(spark.read.text(path), dataset)


def jsonld_quads(text: str) -> Iterator[tuple]:
    """Quads of JSON-LD with contexts of its own: terms, prefixes, @vocab, @language, typed and tagged values, language maps,
    lists and sets, reversed properties, nested nodes, @graph. A context that lies elsewhere is an error, as its terms would be lost."""
    data, blanks = json.loads(text), iter(range(1 << 60))

    def context_of(given, base: dict) -> dict:
        out = dict(base)
        for c in given if isinstance(given, list) else [given]:
            if isinstance(c, str):
                raise ValueError(f"the context {c} is not part of the document")
            if c is None:
                out = {}
            else:
                out.update(c)
        return out

    def expand(name: str, context: dict, vocab: bool) -> str:
        held = context.get(name) if vocab else None
        held = held.get("@id", held.get("@reverse", name)) if isinstance(held, dict) else held
        if not vocab and context.get("@base") and ":" not in name:
            return urljoin(context["@base"], name)
        if isinstance(held, str) and held != name:
            return expand(held, context, vocab)
        prefix, colon, rest = name.partition(":")
        if colon and isinstance(context.get(prefix), str) and not rest.startswith("//"):
            return expand(context[prefix], context, vocab) + rest
        return name if colon or not vocab else context.get("@vocab", "") + name

    def walk(x, context: dict, graph: str | None) -> Iterator[tuple]:
        if isinstance(x, list):
            for y in x:
                yield from walk(y, context, graph)
            return
        if "@context" in x:
            context = context_of(x["@context"], context)
        own = expand(x["@id"], context, False) if "@id" in x else f"_:b{next(blanks)}"
        if "@graph" in x:
            yield from walk(x["@graph"], context, own if "@id" in x else graph)
        s = (own[2:], "bnode") if own.startswith("_:") else (own, "iri")
        for key, values in x.items():
            if key == "@type":
                for t in values if isinstance(values, list) else [values]:
                    yield (*s, RDF_TYPE, expand(t, context, True), "iri", None, None, graph)
            elif key == "@reverse":
                for inner, nodes in values.items():
                    yield from reversed_from(s, expand(inner, context, True), nodes, context, graph)
            elif not key.startswith("@"):
                p, held = expand(key, context, True), context.get(key)
                held = held if isinstance(held, dict) else {}
                if ":" not in p:
                    continue  # a key that the context gives no IRI
                if "@reverse" in held:
                    yield from reversed_from(s, p, values, context, graph)
                elif held.get("@container") == "@list":
                    yield from value(s, p, {"@list": values}, held, context, graph)
                elif held.get("@container") == "@language":
                    for tag, texts in values.items():
                        for v in texts if isinstance(texts, list) else [texts]:
                            yield from value(s, p, {"@value": v, **({} if tag == "@none" else {"@language": tag})}, held, context, graph)
                else:
                    for v in values if isinstance(values, list) else [values]:
                        yield from value(s, p, v, held, context, graph)

    def reversed_from(s, p, nodes, context, graph):
        for v in nodes if isinstance(nodes, list) else [nodes]:
            v = {"@id": v} if isinstance(v, str) else v if "@id" in v else {**v, "@id": f"_:b{next(blanks)}"}
            own = expand(v["@id"], context, False)
            yield (*((own[2:], "bnode") if own.startswith("_:") else (own, "iri")), p, *s, None, None, graph)
            if len(v) > 1:
                yield from walk(v, context, graph)

    def value(s, p, v, held, context, graph):
        coerced = held.get("@type")
        if v is None or isinstance(v, dict) and "@value" in v and v["@value"] is None:
            return
        if isinstance(v, dict) and "@set" in v:
            for y in v["@set"] if isinstance(v["@set"], list) else [v["@set"]]:
                yield from value(s, p, y, held, context, graph)
            return
        if isinstance(v, dict) and "@list" in v:
            at, q = s, p
            for y in v["@list"] if isinstance(v["@list"], list) else [v["@list"]]:
                cell = (f"b{next(blanks)}", "bnode")
                yield (*at, q, *cell, None, None, graph)
                yield from value(cell, f"{RDF}first", y, held, context, graph)
                at, q = cell, f"{RDF}rest"
            yield (*at, q, f"{RDF}nil", "iri", None, None, graph)
            return
        if isinstance(v, dict) and "@value" not in v:
            v = v if "@id" in v else {**v, "@id": f"_:b{next(blanks)}"}
            o = expand(v["@id"], context, False)
            yield (*s, p, *((o[2:], "bnode") if o.startswith("_:") else (o, "iri")), None, None, graph)
            if len(v) > 1:
                yield from walk(v, context, graph)
            return
        if isinstance(v, str) and coerced in ("@id", "@vocab"):
            o = expand(v, context, coerced == "@vocab")
            yield (*s, p, *((o[2:], "bnode") if o.startswith("_:") else (o, "iri")), None, None, graph)
            return
        plain = isinstance(v, str) and not coerced
        tag = v.get("@language") if isinstance(v, dict) else held.get("@language", context.get("@language")) if plain else None
        dt = v.get("@type") if isinstance(v, dict) else coerced
        raw = v["@value"] if isinstance(v, dict) else v
        kind = "boolean" if isinstance(raw, bool) else "integer" if isinstance(raw, int) else "double" if isinstance(raw, float) else "string"
        shown = str(raw).lower() if isinstance(raw, bool) else str(raw)
        yield (*s, p, shown, "literal", LANG_STRING if tag else expand(dt, context, True) if dt else f"{XSD}{kind}", tag and tag.lower(), graph)

    yield from walk(data, {}, None)


def rdfxml_quads(text: str) -> Iterator[tuple]:
    """Quads of RDF/XML: node and property elements, property attributes, resources, literals, nested nodes,
    rdf:ID, rdf:li, xml:base, and the parse types Resource, Collection and Literal."""
    blanks = iter(range(1 << 60))
    name = lambda tag: "".join(tag[1:].split("}"))
    attribute = lambda e, x: e.get(f"{{{RDF}}}{x}")
    XML = "{http://www.w3.org/XML/1998/namespace}"
    syntax = {f"{RDF}{x}" for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType", "type", "bagID")}

    def subject(e, base) -> tuple[str, str]:
        if (about := attribute(e, "about")) is not None:
            return urljoin(base, about) if base else about, "iri"
        if (own := attribute(e, "ID")) is not None:
            return urljoin(base, f"#{own}") if base else f"#{own}", "iri"
        return attribute(e, "nodeID") or f"b{next(blanks)}", "bnode"

    def described(s, e, lang, base) -> Iterator[tuple]:
        """What attributes say of a node."""
        for key, value in e.attrib.items():
            if key == f"{{{RDF}}}type":
                yield (*s, RDF_TYPE, urljoin(base, value) if base else value, "iri", None, None, None)
            elif key.startswith("{") and not key.startswith(XML) and name(key) not in syntax:
                yield (*s, name(key), value, "literal", LANG_STRING if lang else f"{XSD}string", lang and lang.lower(), None)

    def node(e, s, lang, base) -> Iterator[tuple]:
        lang, base = e.get(f"{XML}lang", lang), e.get(f"{XML}base", base)
        if name(e.tag) != f"{RDF}Description":
            yield (*s, RDF_TYPE, name(e.tag), "iri", None, None, None)
        yield from described(s, e, lang, base)
        yield from properties(s, e, lang, base)

    def properties(s, e, lang, base) -> Iterator[tuple]:
        number = 0
        for child in e:
            p, tag, at = name(child.tag), child.get(f"{XML}lang", lang), child.get(f"{XML}base", base)
            if p == f"{RDF}li":
                number += 1
                p = f"{RDF}_{number}"
            parse = attribute(child, "parseType")
            if parse == "Resource":
                o = (f"b{next(blanks)}", "bnode")
                yield (*s, p, *o, None, None, None)
                yield from properties(o, child, tag, at)
            elif parse == "Collection":
                here, q = s, p
                for inner in child:
                    cell, o = (f"b{next(blanks)}", "bnode"), subject(inner, inner.get(f"{XML}base", at))
                    yield (*here, q, *cell, None, None, None)
                    yield (*cell, f"{RDF}first", *o, None, None, None)
                    yield from node(inner, o, tag, at)
                    here, q = cell, f"{RDF}rest"
                yield (*here, q, f"{RDF}nil", "iri", None, None, None)
            elif parse is not None:
                held = (child.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in child)
                yield (*s, p, held, "literal", f"{RDF}XMLLiteral", None, None)
            elif len(child):
                for inner in child:
                    o = subject(inner, inner.get(f"{XML}base", at))
                    yield (*s, p, *o, None, None, None)
                    yield from node(inner, o, tag, at)
            elif attribute(child, "resource") is not None or attribute(child, "nodeID") is not None or any(True for _ in described(s, child, tag, at)):
                target = attribute(child, "resource")
                o = (urljoin(at, target) if at else target, "iri") if target is not None else (attribute(child, "nodeID") or f"b{next(blanks)}", "bnode")
                yield (*s, p, *o, None, None, None)
                yield from described(o, child, tag, at)
            else:
                dt = attribute(child, "datatype")
                yield (*s, p, child.text or "", "literal", dt or (LANG_STRING if tag else f"{XSD}string"), None if dt else tag and tag.lower(), None)

    root = ET.fromstring(text)
    lang, base = root.get(f"{XML}lang"), root.get(f"{XML}base")
    for e in root if name(root.tag) == f"{RDF}RDF" else [root]:
        yield from node(e, subject(e, e.get(f"{XML}base", base)), lang, base)


def turtle_quads(text: str) -> Iterator[tuple]:
    """Quads of Turtle and TriG: prefixes, base, lists of predicates and objects, blank nodes, collections, graphs."""
    scan = re.compile(
        r"""\s+|\#[^\n]*|(?P<long>\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<iri><[^<>\s]*>)|(?P<dir>@prefix|@base|PREFIX\b|BASE\b)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
        |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<op>\^\^|[\[\](){}.;,])|(?P<name>_:[\w.-]*\w|[\w-]*(?:[\w.-]*[\w-])?:(?:[\w.%-]|\\.)*(?:[\w%-]|\\.)|[\w-]*:|a\b|true\b|false\b|GRAPH\b)""",
        re.VERBOSE | re.DOTALL,
    )
    tokens, at = [], 0
    while at < len(text):
        m = scan.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
    prefixes, base, blanks, i, out, graph = {}, [""], iter(range(1 << 60)), [0], [], [None]
    escapes = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

    def peek() -> tuple:
        return tokens[i[0]] if i[0] < len(tokens) else ("end", "")

    def take() -> tuple:
        i[0] += 1
        return tokens[i[0] - 1]

    def plain(x: str) -> str:
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else escapes.get(m[1], m[1]), x, flags=re.DOTALL)

    def absolute(x: str) -> str:
        return x if re.match(r"[A-Za-z][\w+.-]*:", x) else base[0] + x

    def term() -> tuple:
        kind, x = take()
        none = (None, None)
        if kind == "iri":
            return (absolute(plain(x[1:-1])), "iri", *none)
        if kind in ("str", "long"):
            value = plain(x[3:-3] if kind == "long" else x[1:-1])
            if peek()[0] == "lang":
                return value, "literal", LANG_STRING, take()[1][1:].lower()
            if peek()[1] == "^^":
                take()
                return value, "literal", term()[0], None
            return value, "literal", f"{XSD}string", None
        if kind == "num":
            return x, "literal", XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer"), None
        if x == "[":
            own = (f"b{next(blanks)}", "bnode", *none)
            if peek()[1] != "]":
                predicates(own)
            take()
            return own
        if x == "(":
            items = []
            while peek()[1] != ")":
                items.append(term())
            take()
            head = (f"{RDF}nil", "iri", *none)
            for item in reversed(items):
                own = (f"b{next(blanks)}", "bnode", *none)
                out.append((own, f"{RDF}first", item))
                out.append((own, f"{RDF}rest", head))
                head = own
            return head
        if x in ("true", "false"):
            return x, "literal", f"{XSD}boolean", None
        if x == "a":
            return (RDF_TYPE, "iri", *none)
        if x.startswith("_:"):
            return (x[2:], "bnode", *none)
        prefix, _, local = x.partition(":")
        return (prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", *none)

    def predicates(s: tuple) -> None:
        while True:
            p = term()[0]
            while True:
                out.append((s, p, term()))
                if peek()[1] != ",":
                    break
                take()
            while peek()[1] == ";":
                take()
                ended = peek()[1] in (".", "]", "}", ";", "")
                if ended and peek()[1] != ";":
                    return
            if peek()[1] in (".", "]", "}", ""):
                return

    while peek()[0] != "end":
        if peek()[0] == "dir":
            word = take()[1]
            if word.lstrip("@").lower() == "prefix":
                name = take()[1].rstrip(":")
                prefixes[name] = absolute(take()[1][1:-1])
            else:
                base[0] = take()[1][1:-1]
            if peek()[1] == ".":
                take()
            continue
        if peek()[1] == "}":
            take()
            graph[0] = None
            continue
        if peek()[1] == "GRAPH":
            take()
        if peek()[1] == "{":
            take()
            continue
        s = term()
        if peek()[1] == "{":
            take()
            graph[0] = s[0]
            continue
        if peek()[1] != "." and peek()[1] != "}":
            predicates(s)
        if peek()[1] == ".":
            take()
        for (sv, sk, *_), p, (ov, ok, dt, lang) in out:
            yield sv, sk, p, ov, ok, dt, lang, graph[0]
        out.clear()


_PARSERS = {"jsonld": jsonld_quads, "rdf": rdfxml_quads, "ttl": turtle_quads, "trig": turtle_quads}


def read_files(spark: SparkSession, path: str, kind: str, dataset: str | None = None) -> DataFrame:
    """Files of a format that has no lines to split at, plain or gzipped or zipped: each is parsed by one task."""
    import gzip
    import io
    import zipfile

    parser = _PARSERS[kind]

    def texts(raw: bytes) -> Iterator[str]:
        if raw[:2] == b"\x1f\x8b":
            yield gzip.decompress(raw).decode()
        elif raw[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                # notes for readers may lie beside the data; anything else is data that would be lost
                held = [x for x in z.namelist() if not x.lower().endswith(("/", ".md", ".txt", ".html", ".pdf"))]
                if wrong := [x for x in held if not x.lower().endswith((kind, ".json", ".xml", ".owl"))]:
                    raise ValueError(f"{wrong[0]} in the archive is not {kind}")
                for entry in held:
                    yield z.read(entry).decode()
        else:
            yield raw.decode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path_, raw in zip(files["path"], files["content"], strict=True):
                for n, text in enumerate(texts(raw)):
                    made = pd.DataFrame(list(parser(text)), columns=QUAD_COLUMNS[:-1], dtype=object)
                    tag = f"f{zlib.crc32(f'{path_}#{n}'.encode()):08x}"  # a file's blank nodes are its own
                    for c in ("s", "o"):
                        made[c] = made[c].where(made[f"{c}_kind"] != "bnode", tag + made[c].astype(str))
                    yield made

    schema = ", ".join(f"{c} string" for c in QUAD_COLUMNS[:-1])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, schema).withColumn("dataset", F.lit(dataset).cast("string"))


def read_quads(spark: SparkSession, path: str, kind: str | None = None, dataset: str | None = None) -> DataFrame:
    kind = kind or format_for(None, path, None)[0]
    return read_lines(spark, path, dataset) if kind in ("nt", "nq") else read_files(spark, path, kind, dataset)


def is_fresh(path: str, modified: float | None, size: int | None) -> bool:
    """Whether a local copy is as new as the source (seconds since 1970) and as large; what is not known does not count."""
    import os

    if not os.path.exists(path):
        return False
    held = os.stat(path)
    return held.st_size > 0 and (modified is None or held.st_mtime >= modified) and (size is None or held.st_size == size)


def download(url: str, folder: str, modified: float | None = None, size: int | None = None) -> str:
    """A dump's local copy, fetched if there is no fresh one; it never lies outside the folder and is never empty."""
    import os
    import shutil
    from urllib.parse import quote
    from urllib.request import urlopen

    path = os.path.join(os.path.realpath(folder), quote(url, safe="").replace("..", "%2E%2E")[-200:])
    if os.path.dirname(os.path.realpath(path)) != os.path.realpath(folder):
        raise ValueError(f"{url} leads out of {folder}")
    if is_fresh(path, modified, size):
        return path
    os.makedirs(folder, exist_ok=True)
    part = f"{path}.part"
    with urlopen(url) as source, open(part, "wb") as target:
        shutil.copyfileobj(source, target)
    if os.path.getsize(part) == 0:
        os.remove(part)
        raise ValueError(f"{url} is empty")
    os.replace(part, path)
    return path
