import pytest
from pyspark.sql import functions as F

from quadloom.plans import sparql

from .graphs import EX, frame, mixed_namespaces, quad

P = f"PREFIX ex: <{EX}> PREFIX s: <https://schema.org/> "


@pytest.fixture(scope="module")
def people(spark):
    return frame(
        spark, quad(EX + "a", EX + "knows", EX + "b"), quad(EX + "b", EX + "knows", EX + "c"), quad(EX + "c", EX + "knows", EX + "a"), quad(EX + "c", EX + "knows", EX + "d"),
        quad(EX + "a", EX + "age", "30", dt="http://www.w3.org/2001/XMLSchema#integer"), quad(EX + "b", EX + "age", "9", dt="http://www.w3.org/2001/XMLSchema#integer"),
        quad(EX + "a", EX + "name", "Ann", "en"), quad(EX + "b", EX + "name", "Bob"), quad(EX + "d", EX + "nick", "Dee"),
    )


def got(quads, text, *columns):
    rows = sparql.run(quads, P + text)
    return sorted(tuple((r[c] or "").replace(EX, "") for c in columns or rows.columns) for r in rows.collect())


def test_optional_then_shared_variable(people):
    assert got(people, "SELECT ?x ?n { ?x ex:age ?a OPTIONAL { ?x ex:name ?n FILTER(LANG(?n) = 'en') } }") == [("a", "Ann"), ("b", "")]
    text = "SELECT ?x ?n { ?x ex:knows ?y OPTIONAL { ?x ex:name ?n } OPTIONAL { ?y ex:name ?n } }"
    assert got(people, text) == [("a", "Ann"), ("b", "Bob"), ("c", ""), ("c", "Ann")]


def test_minus_without_shared_variables_is_nothing(people):
    assert len(got(people, "SELECT ?x { ?x ex:age ?a MINUS { ?y ex:nick ?z } }")) == 2
    assert got(people, "SELECT ?x { ?x ex:knows ?y MINUS { ?x ex:age ?a } }") == [("c",), ("c",)]


def test_paths(people):
    assert got(people, "SELECT ?y { ex:a ex:knows+ ?y }") == [("a",), ("b",), ("c",), ("d",)]
    assert got(people, "SELECT ?y { ex:d ex:knows* ?y }") == [("d",)]
    assert got(people, "SELECT ?y { ex:c ^ex:knows/ex:age ?y }") == [("9",)]
    assert got(people, "SELECT ?x ?n { ?x (ex:name|ex:nick) ?n }") == [("a", "Ann"), ("b", "Bob"), ("d", "Dee")]


def test_filters_and_functions(people):
    assert got(people, "SELECT ?x { ?x ex:age ?a FILTER(?a > 10) }") == [("a",)]
    assert got(people, "SELECT ?x { ?x ex:name ?n FILTER(REGEX(?n, '^a', 'i') || ?n IN ('Bob')) }") == [("a",), ("b",)]
    assert got(people, "SELECT ?x { ?x ex:knows ?y FILTER NOT EXISTS { ?y ex:age ?a } }") == [("b",), ("c",)]
    assert got(people, "SELECT ?k { ex:a ex:name ?n BIND(CONCAT(UCASE(STR(?n)), '-', MD5('a')) AS ?k) }") == [("ANN-0cc175b9c0f1b6a831c399e269772661",)]
    assert got(people, "SELECT ?d { ex:a ex:age ?n BIND(DATATYPE(?n) AS ?d) FILTER(ISLITERAL(?n)) }") == [("http://www.w3.org/2001/XMLSchema#integer",)]


def test_groups_values_and_subqueries(people):
    assert got(people, "SELECT ?x (COUNT(DISTINCT ?y) AS ?n) { ?x ex:knows ?y } GROUP BY ?x") == [("a", "1"), ("b", "1"), ("c", "2")]
    assert got(people, "SELECT (SUM(?a) AS ?t) { ?x ex:age ?a }") == [("39",)]
    assert got(people, "SELECT ?x ?z { VALUES (?x ?z) { (ex:a 'one') (ex:c UNDEF) } ?x ex:knows ?y }") == [("a", "one"), ("c", ""), ("c", "")]
    assert got(people, "SELECT ?x { { SELECT ?x { ?x ex:age ?a } ORDER BY DESC(?a) LIMIT 1 } ?x ex:name ?n }") == [("a",)]


def test_values_enter_the_innermost_query(people):
    q = sparql.parse(P + "SELECT ?x ?n { { SELECT ?x (COUNT(?y) AS ?n) { ?x ex:knows ?y } GROUP BY ?x } }")
    sparql.inject_values(q, ["x"], [[EX + "c"]])
    assert [(r.x, r.n) for r in sparql.run(people, q).collect()] == [(EX + "c", "2")]
    (kind, (inner,)), = q.where.steps
    assert kind == "union" and inner.steps[0][1].where.steps[-1][0] == "values" and len(inner.steps) == 1


def test_construct_skips_unbound_and_ask(people):
    made = sparql.run(people, P + "CONSTRUCT { ?x ex:label ?n ; a ex:Person } WHERE { ?x ex:age ?a OPTIONAL { ?x ex:name ?n FILTER(LANG(?n) != '') } }").collect()
    assert sorted((r.s[-1], r.o.replace(EX, ""), r.o_lang) for r in made) == [("a", "Ann", "en"), ("a", "Person", None), ("b", "Person", None)]
    assert sparql.run(people, P + "ASK { ex:a ex:age 30 }").first().answer and not sparql.run(people, P + "ASK { ex:a ex:age 31 }").first().answer


def test_anonymous_nodes_and_mixed_namespaces(spark):
    t = mixed_namespaces(spark)
    assert sparql.run(t, P + "SELECT (COUNT(*) AS ?n) { [] a ?c ; s:name ?o }").first().n == "2"


@pytest.mark.parametrize("text", ["SELECT ?x { ?x ", "SELECT { } }", "SELECT ?x { ?x foo:bar ?y }", "INSERT DATA { }", "SELECT (NOPE(?x) AS ?y) { ?x ?p ?o }"])
def test_what_is_not_understood_is_refused(people, text):
    with pytest.raises(sparql.ParseError):
        sparql.run(people, text)


XSD = "http://www.w3.org/2001/XMLSchema#"


@pytest.fixture(scope="module")
def clash(spark):
    """Terms of one text and other kinds, datatypes, languages and graphs."""
    rows = [
        quad(EX + "a", EX + "v", "5", dt=XSD + "integer"), quad(EX + "b", EX + "v", "10", dt=XSD + "integer"), quad(EX + "c", EX + "v", "9.5", dt=XSD + "decimal"), quad(EX + "d", EX + "v", "5"),
        quad(EX + "a", EX + "w", "5.0", dt=XSD + "decimal"), quad(EX + "b", EX + "w", "9", dt=XSD + "integer"), quad(EX + "c", EX + "w", "1e1", dt=XSD + "double"),
        quad(EX + "x", EX + "says", "x", "en"), quad(EX + "y", EX + "says", "x", "nl"), quad(EX + "z", EX + "says", "x"),
        quad(EX + "a", EX + "link", EX + "b"), quad(EX + "a", EX + "text", EX + "b"), quad(EX + "t", EX + "when", "2024-02-29T23:15:07.5+02:00", dt=XSD + "dateTime"),
    ]
    t = frame(spark, *rows)
    return t.withColumns({"o_kind": F.when(F.col("p") == EX + "text", F.lit("literal")).otherwise(F.col("o_kind")), "o_dt": F.when(F.col("p") == EX + "text", F.lit(XSD + "string")).otherwise(F.col("o_dt"))})


def test_terms_join_by_kind_datatype_and_language(clash):
    assert got(clash, "SELECT ?n { ?s ex:text ?x . ?x ex:v ?n }") == [] and got(clash, "SELECT ?n { ?s ex:link ?x . ?x ex:v ?n }") == [("10",)]
    assert got(clash, "SELECT ?s ?t { ?s ex:says ?x . ?t ex:says ?x }") == [("x", "x"), ("y", "y"), ("z", "z")]
    assert got(clash, "SELECT ?s { ?s ex:says 'x'@en }") == [("x",)] and got(clash, "SELECT ?s { ?s ex:says 'x' }") == [("z",)]
    assert got(clash, "SELECT ?s { ?s ex:v ?x . ex:d ex:v ?x }") == [("d",)]


def test_equality_and_order_of_values(clash):
    assert got(clash, "SELECT ?s { ?s ex:v ?v ; ex:w ?w FILTER(?v = ?w) }") == [("a",)]
    assert got(clash, "SELECT ?s { ?s ex:v ?v ; ex:w ?w FILTER(?v < ?w) }") == [("c",)] and got(clash, "SELECT ?s { ?s ex:v ?v ; ex:w ?w FILTER(?v > ?w) }") == [("b",)]
    assert got(clash, "SELECT ?s { ?s ex:link ?x ; ex:text ?y FILTER(?x = ?y) }") == [] and got(clash, "SELECT ?s { ?s ex:link ?x ; ex:text ?y FILTER(STR(?x) = ?y) }") == [("a",)]
    assert got(clash, "SELECT ?s { ?s ex:says ?x FILTER(?x IN ('x'@nl, 'y')) }") == [("y",)]
    assert got(clash, "SELECT (MIN(?v) AS ?a) (MAX(?v) AS ?b) { ?s ex:v ?v FILTER(ISNUMERIC(?v)) }") == [("5", "10")]
    assert [r.v for r in sparql.run(clash, P + "SELECT ?v { ?s ex:v|ex:link ?v } ORDER BY ?v").collect()] == [EX + "b", "5", "9.5", "10", "5"]
    assert [r.s[-1] for r in sparql.run(clash, P + "SELECT ?s { ?s ex:w ?w } ORDER BY DESC(?w + 0)").collect()] == ["c", "b", "a"]


@pytest.mark.parametrize(("expression", "value"), [
    ("1 + 2 * 5", "11"), ("(1 + 2) * 5", "15"), ("7 - 2 - 1", "4"), ("1 / 4", "0.25"), ("-2 * -3", "6"), ("0.1 + 0.2", "0.3"), ("1e0 / 4", "0.25"), ("1 / 0", ""), ("'a' + 1", ""),
    ("STRBEFORE('x.y', '.')", "x"), ("STRAFTER('x.y', '.')", "y"), ("STRAFTER('xy', '.')", ""), ("REPLACE('aBc', 'b', '-', 'i')", "a-c"), ("REPLACE('abc', '(b)', '[$1]')", "a[b]c"), ("SUBSTR('hello', 2)", "ello"), ("SUBSTR('hello', 2, 3)", "ell"),
    ("ROUND(2.5)", "3"), ("ROUND(-2.5)", "-2"), ("CEIL(2.1)", "3"), ("FLOOR(-2.1)", "-3"), ("ABS(-4)", "4"), ("YEAR('2024-02-29'^^<http://www.w3.org/2001/XMLSchema#date>)", "2024"),
    ("LANGMATCHES('en-GB', 'EN')", "true"), ("LANGMATCHES('eng', 'en')", "false"), ("LANGMATCHES('', '*')", "false"), ("SAMETERM(1, 1.0)", "false"), ("1 = 1.0", "true"), ("'1' = 1", "false"), ("ISNUMERIC('1')", "false"), ("COALESCE(1 / 0, 'x')", "x"),
    ("IF(1 > 2, 'a', 'b')", "b"), ("LANG(STRLANG('a', 'EN'))", "en"), ("DATATYPE(1.5)", XSD + "decimal"), ("DATATYPE(STRDT('1', ex:t))", EX + "t"), ("<http://www.w3.org/2001/XMLSchema#integer>('12')", "12"), ("<http://www.w3.org/2001/XMLSchema#integer>(12.7)", "12"),
    ("<http://www.w3.org/2001/XMLSchema#boolean>('1')", "true"), ("ENCODE_FOR_URI('a b/é~')", "a%20b%2F%C3%A9~"), ("SHA256('a')", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("CONCAT('a', 'b'@en)", "ab"), ("!(1 = 1) || 2 IN (1, 2)", "true"), ("3 NOT IN (1, 2)", "true"), ("'b' < 'c'", "true"), ("BOUND(?nothing)", "false"),
    ("CONTAINS('abc'@en, 'b')", "true"), ("true && false", "false"), ("STRLEN('''a\\nb''')", "3"),
])
def test_expressions(clash, expression, value):
    row = sparql.run(clash, P + f"SELECT ({expression} AS ?v) {{ }}").collect()
    assert len(row) == 1 and (row[0].v or "") == value


def test_times(clash):
    parts = "SELECT (HOURS(?t) AS ?h) (MINUTES(?t) AS ?m) (SECONDS(?t) AS ?s) (TZ(?t) AS ?z) (TIMEZONE(?t) AS ?d) (DAY(?t) AS ?y) { ex:t ex:when ?t }"
    assert got(clash, parts, "h", "m", "s", "z", "d", "y") == [("23", "15", "7.5", "+02:00", "PT2H", "29")]
    assert got(clash, "SELECT ?s { ?s ex:when ?t FILTER(?t > '2024-02-29T22:00:00Z'^^<http://www.w3.org/2001/XMLSchema#dateTime>) }") == []


def test_filters_of_optional_see_outer_variables(clash):
    assert got(clash, "SELECT ?s ?w { ?s ex:v ?v OPTIONAL { ?s ex:w ?w FILTER(?v = 5) } }") == [("a", "5.0"), ("b", ""), ("c", ""), ("d", "")]
    assert got(clash, "SELECT ?s ?t { ?s ex:v ?v FILTER(ISNUMERIC(?v)) OPTIONAL { ?t ex:w ?w FILTER(?w > ?v) } }") == [("a", "b"), ("a", "c"), ("b", ""), ("c", "c")]


def test_unbound_variables_join_with_everything(clash):
    text = "SELECT ?s ?x ?t { ?s ex:v ?v OPTIONAL { ?s ex:link ?x } { ?t ex:link ?x } UNION { ?t ex:says 'x'@en } }"
    assert got(clash, text) == [("a", "b", "a"), ("a", "b", "x"), ("b", "", "x"), ("b", "b", "a"), ("c", "", "x"), ("c", "b", "a"), ("d", "", "x"), ("d", "b", "a")]


def test_aggregates(clash):
    assert got(clash, "SELECT (SUM(?v) AS ?t) (AVG(?v) AS ?m) (COUNT(DISTINCT ?v) AS ?n) { ?s ex:v ?v FILTER(ISNUMERIC(?v)) }", "t", "m", "n") == [("24.5", "8.166666666667", "3")]
    assert got(clash, "SELECT (SUM(?v) AS ?t) (COUNT(*) AS ?n) { ?s ex:v ?v }", "t", "n") == [("", "4")]
    assert got(clash, "SELECT (SUM(?v) AS ?t) (AVG(?v) AS ?m) (MIN(?v) AS ?l) (COUNT(?v) AS ?n) { ?s ex:nothing ?v }", "t", "m", "l", "n") == [("0", "0", "", "0")]
    assert got(clash, "SELECT ?x (GROUP_CONCAT(STR(?s); SEPARATOR=',') AS ?g) { ?s ex:says ?x } GROUP BY ?x HAVING(LANG(?x) != '')", "g") == [("x",), ("y",)]
    assert got(clash, "SELECT (COUNT(DISTINCT *) AS ?n) { { ?s ex:v ?v } UNION { ?s ex:v ?v } }") == [("4",)]
    assert got(clash, "SELECT ?k (COUNT(*) AS ?n) { ?s ?p ?v } GROUP BY (ISIRI(?v) AS ?k) ORDER BY DESC(COUNT(*))", "k", "n") == [("false", "12"), ("true", "1")]


def test_graphs(spark, people):
    t = people.withColumn("g", F.when(F.col("p") == EX + "knows", F.lit("urn:k")).otherwise(F.lit("urn:o")))
    t = t.unionByName(t.where("g = 'urn:k'").withColumn("g", F.lit("urn:copy")))
    count = "SELECT (COUNT(*) AS ?n) {} {{ ?x ex:knows ?y }}"
    assert got(t, count.format("FROM <urn:k> FROM <urn:copy>")) == [("4",)] and got(t, count.format("FROM <urn:o>")) == [("0",)]
    assert got(t, "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?x ex:knows ?y . ?y ex:knows ?z } } GROUP BY ?g") == [("urn:copy", "4"), ("urn:k", "4")]
    assert got(t, "SELECT ?g { GRAPH ?g { ex:a ex:age ?y } }") == [("urn:o",)] and got(t, "SELECT ?x { GRAPH <urn:o> { ?x ex:nick ?y } }") == [("d",)]
    assert got(t, "SELECT ?g FROM NAMED <urn:k> { GRAPH ?g { ex:a ex:knows ?y } }") == [("urn:k",)] and got(t, "SELECT ?x FROM NAMED <urn:k> { ?x ex:knows ?y }") == []


def test_more_paths(people):
    assert got(people, "SELECT ?y { ex:a ex:knows? ?y }") == [("a",), ("b",)] and got(people, "SELECT ?y { ex:d ex:knows? ?y }") == [("d",)]
    assert got(people, "SELECT ?x { ?x ex:knows+ ex:d }") == [("a",), ("b",), ("c",)] and got(people, "SELECT ?x { ?x ex:knows* ex:d }") == [("a",), ("b",), ("c",), ("d",)]
    assert got(people, "SELECT ?y { ex:a !(ex:knows|ex:name) ?y }") == [("30",)] and got(people, "SELECT ?y { ex:b !(^ex:age) ?y }") == [("a",)]
    assert got(people, "SELECT ?x ?y { ?x ex:nick ?n . ?y ex:knows+ ?x }") == [("d", "a"), ("d", "b"), ("d", "c")]
    assert got(people, "SELECT ?x ?y { ?x (ex:knows/ex:knows)+ ?y . ?x ex:age 30 }") == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d")]


def test_bases_blank_nodes_and_lists(spark, people):
    assert got(people, f"BASE <{EX}> SELECT ?x {{ <a> <knows> ?x }}".replace("BASE", "\nBASE")) == [("b",)]
    assert got(people, "SELECT ?x { _:n ex:knows ?x . _:n ex:nick ?y }") == [] and got(people, "SELECT ?x { _:n ex:age 30 ; ex:knows ?x }") == [("b",)]
    made = sparql.run(people, P + "CONSTRUCT { ?x ex:has [ ex:of ?a ] . 'no' ex:p ?x } WHERE { ?x ex:age ?a }").collect()
    nodes = {r.o for r in made if r.p == EX + "has"}
    assert len(made) == 4 and len(nodes) == 2 and {r.s for r in made if r.p == EX + "of"} == nodes
    assert {(r.p, r.o) for r in sparql.run(people, P + "CONSTRUCT WHERE { ?x ex:nick ?n }").collect()} == {(EX + "nick", "Dee")}
    assert sparql.parse(P + "SELECT ?x { ?x ex:p (1 ?y) }").where.steps[0][1][0][1].iri.endswith("first")


def test_updates(people):
    t = people.withColumn("g", F.lit("urn:g"))
    after = sparql.updated(t, P + "CLEAR GRAPH <urn:other>; INSERT DATA { GRAPH <urn:g> { ex:a ex:knows ex:b . ex:new ex:age 1 } } ; DELETE DATA { GRAPH <urn:g> { ex:b ex:name 'Bob' } }")
    assert after.count() == t.count() and got(after, "SELECT ?x { ?x ex:age 1 }") == [("new",)] and got(after, "SELECT ?x { ?x ex:name 'Bob' }") == []
    assert sparql.updated(after, "CLEAR GRAPH <urn:g>").count() == 0 and sparql.updated(after, "DROP SILENT DEFAULT").count() == after.count() and sparql.updated(after, "CLEAR ALL").isEmpty()
    for text in ("INSERT DATA { ?x ex:p 1 }", "INSERT { ?x ?y ?z } WHERE { }", "CLEAR <urn:g>"):
        with pytest.raises(sparql.ParseError):
            sparql.updated(t, P + text)


@pytest.mark.parametrize("iri", ["urn:a> } DROP ALL #", "a b", "", "x\ny", 'x"', "{", "a\\u0020"])
def test_unsafe_iris_are_refused(people, iri):
    with pytest.raises(sparql.ParseError):
        sparql.run(people, P + "ASK { ?dataset ex:p ?x }", dataset=iri)
