import gzip
import zipfile

import pytest

from quadloom.operators.quads import serialize
from quadloom.sources import rdf

from .graphs import EX, frame, quad

TURTLE = """@prefix ex: <http://example.org/> . @base <http://example.org/> .
# a comment
ex:a a ex:Work ; ex:name "Een \\"verhaal\\""@nl , 'x' ; ex:n 1, 2.5, 1e3, true ; ex:in [ ex:name "inner" ] ; ex:list ( 1 2 ) .
<b> ex:long \"\"\"two
lines\"\"\" .
"""
TRIG = "@prefix ex: <http://example.org/> . ex:g { ex:a ex:p ex:b . } GRAPH ex:h { ex:c ex:p \"x\"^^ex:t . } ex:d ex:p ex:e ."
JSONLD = '{"@context": {"@vocab": "http://example.org/", "ex": "http://example.org/", "at": {"@id": "ex:at", "@type": "@id"}}, "@id": "ex:a", "@type": "Work", "name": {"@value": "Een", "@language": "nl"}, "n": [1, true, 1.5], "at": "ex:b", "in": {"name": "inner"}}'
XML = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://example.org/"><ex:Work rdf:about="http://example.org/a">
<ex:name xml:lang="nl">Een</ex:name><ex:at rdf:resource="http://example.org/b"/><ex:n rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">1</ex:n><ex:in><rdf:Description><ex:name>inner</ex:name></rdf:Description></ex:in></ex:Work></rdf:RDF>"""


def short(rows):
    return {(r[2].split("/")[-1].split("#")[-1], r[3].replace(EX, ""), r[4], r[6]) for r in rows}


def test_turtle_and_trig():
    rows = list(rdf.turtle_quads(TURTLE))
    assert {("type", "Work", "iri", None), ("name", 'Een "verhaal"', "literal", "nl"), ("name", "x", "literal", None), ("n", "2.5", "literal", None), ("n", "true", "literal", None), ("long", "two\nlines", "literal", None), ("name", "inner", "literal", None)} <= short(rows)
    assert len(rows) == 15 and {r[5].split("#")[-1] for r in rows if r[2] == EX + "n"} == {"integer", "decimal", "double", "boolean"}
    assert {(r[0][-1], r[7] and r[7][-1]) for r in rdf.turtle_quads(TRIG)} == {("a", "g"), ("c", "h"), ("d", None)}


def test_jsonld_and_xml():
    for rows in (list(rdf.jsonld_quads(JSONLD)), list(rdf.rdfxml_quads(XML))):
        assert {("type", "Work", "iri", None), ("name", "Een", "literal", "nl"), ("at", "b", "iri", None), ("n", "1", "literal", None), ("name", "inner", "literal", None)} <= short(rows)
        inner = next(r for r in rows if r[3] == "inner")
        assert inner[1] == "bnode" and any(r[3] == inner[0] and r[4] == "bnode" for r in rows)


def test_lines_go_round(spark, tmp_path):
    t = frame(spark, quad(EX + "s", EX + "p", 'a "q" \\ \n\t é 😀', "nl", g=EX + "g"), quad("_:b1", EX + "p", "_:b2"), quad(EX + "s", EX + "p", "5", dt="urn:int"), quad(EX + "s", EX + "p", ""), quad(EX + "s", EX + "p", "x" * 200_000 + '"' * 5000))
    serialize(t, graph=True).write.text(str(tmp_path / "q.nq"))
    back = rdf.read_quads(spark, str(tmp_path / "q.nq"), "nq", EX + "dataset")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, t.collect()), key=str)
    odd = spark.createDataFrame([("# note",), ("",), (r'<urn:a> <urn:b> "Aé\U0001F600\r" .',), ("_:x <urn:b> <urn:c> . # end",)], "value string")
    assert {r.o for r in rdf.parse_lines(odd).collect()} == {"Aé😀\r", "urn:c"}
    try:
        rdf.parse_lines(spark.createDataFrame([("nonsense",)], "value string")).collect()
    except Exception as e:
        assert "not a triple" in str(e)
    else:
        raise AssertionError


def test_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TURTLE)
    (tmp_path / "b.jsonld.gz").write_bytes(gzip.compress(JSONLD.encode()))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("in/x.rdf", XML)
        z.writestr("readme.md", "no")
    assert rdf.read_quads(spark, str(tmp_path / "a.ttl")).count() == 15
    assert rdf.read_quads(spark, str(tmp_path / "b.jsonld.gz")).count() == 8
    assert rdf.read_files(spark, str(tmp_path / "c.zip"), "rdf", "urn:d").select("dataset").distinct().first().dataset == "urn:d"


def test_formats(spark):
    assert rdf.format_for("text/turtle", "x.nt", None) == ("ttl", False) and rdf.format_for(None, "dump.nt.gz", "text/html") == ("nt", False)
    assert rdf.format_for("text/turtle", None, "application/n-triples+gzip; q=1") == ("nt", True)
    rows = spark.createDataFrame([("text/turtle", True), ("application/n-quads", False), ("application/n-quads", True), ("text/html", True)], "media_type string, compressed boolean")
    assert [tuple(r) for r in rdf.preferred(rows).collect()] == [("application/n-quads", True), ("application/n-quads", False), ("text/turtle", True)]


RDFNS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def test_jsonld_lists_maps_and_reversed_properties():
    text = """{"@context": {"@vocab": "http://v/", "@language": "en", "steps": {"@container": "@list"}, "label": {"@container": "@language"}, "partOf": {"@reverse": "http://v/has"}, "see": {"@type": "@id"}, "none": null},
      "@id": "http://a", "steps": ["x", 2], "label": {"nl": "een", "de": ["eins", "ein"], "@none": "1"}, "partOf": {"@id": "http://w", "name": "Whole"}, "see": "http://b",
      "@reverse": {"http://v/knows": [{"@id": "http://c"}]}, "tags": {"@set": ["p", "q"]}, "gone": null, "plain": "t", "empty": {"@list": []}}"""
    got = {(s, p, o, kind, lang) for s, _, p, o, kind, _, lang, _ in rdf.jsonld_quads(text)}
    one = lambda p, s=None: [x for x in got if x[1] == p and (s is None or x[0] == s)]
    (_, _, head, kind, _), = one("http://v/steps")
    assert kind == "bnode" and one(RDFNS + "first", head)[0][2:] == ("x", "literal", "en")
    rest = one(RDFNS + "rest", head)[0][2]
    assert one(RDFNS + "first", rest)[0][2] == "2" and one(RDFNS + "rest", rest)[0][2] == RDFNS + "nil"
    assert {x[2:] for x in one("http://v/label")} == {("een", "literal", "nl"), ("eins", "literal", "de"), ("ein", "literal", "de"), ("1", "literal", None)}
    assert one("http://v/has") == [("http://w", "http://v/has", "http://a", "iri", None)] and one("http://v/name", "http://w")[0][2] == "Whole"
    assert one("http://v/knows") == [("http://c", "http://v/knows", "http://a", "iri", None)] and {x[2] for x in one("http://v/tags")} == {"p", "q"}
    assert one("http://v/see")[0][3] == "iri" and not one("http://v/gone") and one("http://v/plain")[0][4] == "en" and one("http://v/empty")[0][2] == RDFNS + "nil"
    with pytest.raises(ValueError):
        list(rdf.jsonld_quads('{"@context": "https://example.org/context.jsonld", "name": "x"}'))


def test_rdfxml_attributes_collections_and_bases():
    text = f"""<rdf:RDF xmlns:rdf="{RDFNS}" xmlns:v="http://v/" xml:base="http://base/doc" xml:lang="en">
      <v:Thing rdf:ID="a" v:name="Ann"><v:list rdf:parseType="Collection"><rdf:Description rdf:about="#b"/><v:Thing rdf:about="http://c"/></v:list>
        <v:box rdf:parseType="Resource"><v:size rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">3</v:size></v:box><v:text rdf:parseType="Literal">x<b>y</b></v:text>
        <v:near v:name="Near" rdf:resource="d"/><rdf:li>first</rdf:li><rdf:li>second</rdf:li></v:Thing></rdf:RDF>"""
    got = {(s, p, o, kind) for s, _, p, o, kind, *_ in rdf.rdfxml_quads(text)}
    a = "http://base/doc#a"
    assert (a, "http://v/name", "Ann", "literal") in got and (a, RDFNS + "type", "http://v/Thing", "iri") in got
    head = next(o for s, p, o, _ in got if p == "http://v/list")
    assert (head, RDFNS + "first", "http://base/doc#b", "iri") in got and ("http://c", RDFNS + "type", "http://v/Thing", "iri") in got
    rest = next(o for s, p, o, _ in got if s == head and p == RDFNS + "rest")
    assert (rest, RDFNS + "rest", RDFNS + "nil", "iri") in got
    box = next(o for s, p, o, _ in got if p == "http://v/box")
    assert (box, "http://v/size", "3", "literal") in got and (a, "http://v/near", "http://base/d", "iri") in got and ("http://base/d", "http://v/name", "Near", "literal") in got
    assert (a, RDFNS + "_1", "first", "literal") in got and (a, RDFNS + "_2", "second", "literal") in got and any(p == "http://v/text" and "<b>y</b>" in o for _, p, o, _ in got)


def test_archives_with_other_files_are_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.ttl.zip", "w") as z:
        z.writestr("a.ttl", "<urn:a> <urn:b> <urn:c> .")
        z.writestr("README.md", "notes")
        z.writestr("b.csv", "a,b")
    with pytest.raises(Exception, match="b.csv"):
        rdf.read_files(spark, str(tmp_path / "a.ttl.zip"), "ttl").collect()


def test_downloads_are_fresh_whole_and_inside(tmp_path):
    source = tmp_path / "source.nt"
    source.write_text("<urn:a> <urn:b> <urn:c> .\n")
    folder = str(tmp_path / "store")
    path = rdf.download(source.as_uri(), folder)
    assert open(path).read() == source.read_text() and path.startswith(folder) and rdf.download(source.as_uri(), folder, 0.0, source.stat().st_size) == path
    source.write_text("<urn:a> <urn:b> <urn:d> .\n<urn:x> <urn:y> <urn:z> .\n")
    assert "urn:d" not in open(rdf.download(source.as_uri(), folder, 0.0)).read() and "urn:d" in open(rdf.download(source.as_uri(), folder, None, source.stat().st_size)).read()
    source.write_text("")
    with pytest.raises(ValueError):
        rdf.download(source.as_uri(), str(tmp_path / "other"))
