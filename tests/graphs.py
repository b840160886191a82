"""Quads written by hand."""

from quadloom.sources.tables import LANG_STRING, QUAD_COLUMNS, RDF_TYPE, XSD

SCHEMA = ", ".join(f"{c} string" for c in QUAD_COLUMNS)
HTTP, HTTPS, EX = "http://schema.org/", "https://schema.org/", "http://example.org/"


def quad(s, p, o, lang=None, dt=None, g=None, dataset=EX + "dataset"):
    """An object that starts with a scheme is an IRI, with _: a blank node, else a literal."""
    kind = "bnode" if o.startswith("_:") else "iri" if o.startswith(("http:", "https:", "urn:")) and dt is None and lang is None else "literal"
    s_kind = "bnode" if s.startswith("_:") else "iri"
    dt = LANG_STRING if lang else dt or (f"{XSD}string" if kind == "literal" else None)
    return (s.removeprefix("_:"), s_kind, RDF_TYPE if p == "a" else p, o.removeprefix("_:") if kind == "bnode" else o, kind, dt, lang, g, dataset)


def frame(spark, *quads):
    return spark.createDataFrame(list(quads), SCHEMA)


def mixed_namespaces(spark):
    """Works under both spellings of a namespace."""
    w = lambda i: f"{EX}work{i}"
    return frame(
        spark, quad(w(1), "a", HTTP + "CreativeWork"), quad(w(2), "a", HTTP + "CreativeWork"), quad(w(1), HTTP + "name", "A"), quad(w(2), HTTP + "name", "Shared"),
        quad(w(3), "a", HTTPS + "CreativeWork"), quad(w(4), "a", HTTPS + "CreativeWork"), quad(w(3), HTTPS + "name", "Shared"), quad(w(3), HTTPS + "description", "Werk 3", "nl"),
        quad(w(3), HTTPS + "author", EX + "person1"), quad(w(4), HTTPS + "name", "B"), quad(EX + "person1", "a", HTTPS + "Person"),
    )
