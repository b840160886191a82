from quadloom.operators import quads as Q
from quadloom.operators import void as V
from quadloom.sources.tables import RDF_TYPE

from .graphs import EX, HTTP, HTTPS, frame, mixed_namespaces, quad


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_properties_by_subjects_and_objects(spark):
    got = {r.p: (r.entities, r.distinct_objects) for r in V.entity_properties(mixed_namespaces(spark)).collect()}
    assert got[RDF_TYPE] == (5, 3) and got[HTTP + "name"] == (2, 2)
    assert V.entity_properties(Q.in_graph(mixed_namespaces(spark), "urn:other")).count() == 0


def test_variants_merge_by_summing(spark):
    merged = V.merge_variants(V.class_partitions(mixed_namespaces(spark)), ["class"], ["entities"])
    assert rows(merged, "class", "entities") == [(HTTPS + "CreativeWork", 4), (HTTPS + "Person", 1)]
    both = frame(spark, quad(EX + "w", "a", HTTP + "Thing"), quad(EX + "w", "a", HTTPS + "Thing"))
    assert rows(V.merge_variants(V.class_partitions(both), ["class"], ["entities"]), "entities") == [(2,)]
    odd = spark.createDataFrame([(HTTP + "a", "7"), (HTTPS + "a", "x")], "class string, entities string")
    assert rows(V.merge_variants(odd, ["class"], ["entities"]), "class", "entities") == [(HTTPS + "a", 7)]


def test_literals_are_told_apart_by_type_and_language(spark):
    t = frame(spark, quad(EX + "a", EX + "p", "1"), quad(EX + "a", EX + "p", "1", dt="urn:int"), quad(EX + "a", EX + "p", "1", "nl"), quad(EX + "b", EX + "p", "1"), quad("_:x", EX + "p", "_:y"))
    assert rows(V.object_literals(t), "distinct_literals") == [(3,)]
    assert rows(V.subjects(t), "distinct_subjects") == [(2,)] and rows(V.triples(t), "triples") == [(5,)]
    assert V.datatypes(t.where("o_kind = 'iri'")).count() == 0


def test_languages_count_literals_and_datatypes_triples(spark):
    t = frame(spark, *(quad(EX + s, "a", EX + "C") for s in "ab"), *(quad(EX + s, EX + "p", "x", "en") for s in "ab"))
    assert rows(V.class_property_languages(t), "language", "triples") == [("en", 1)]
    assert rows(V.class_property_datatypes(t), "triples") == [(2,)]


def test_single_entity_spaces_go_after_the_cut(spark):
    t = frame(spark, *(quad(f"urn:x{i}/a", EX + "p", "v") for i in range(12)), quad("urn:x0/b", EX + "p", "v"))
    assert rows(V.subject_uri_spaces(t), "uri_space", "entities") == [("urn:x0/", 2)]


def test_first_configured_prefix_holds(spark):
    spaces = spark.createDataFrame([("urn:a/b/", 3), ("urn:a/c/", 4), ("urn:z/", 9)], "uri_space string, triples long")
    assert rows(V.map_uri_spaces(spaces, [("urn:a/b", "inner"), ("urn:a/", "outer")]), "space", "triples") == [("inner", 3), ("outer", 4)]


def test_set_operators(spark):
    t = mixed_namespaces(spark)
    assert Q.dedupe(t.unionByName(t)).count() == t.count()
    same = Q.normalize_namespaces(t, V.SCHEMA_ORG)
    assert same.where(f"p like '{HTTP}%' or o like '{HTTP}%'").count() == 0
    assert set(Q.alias_variants(HTTPS + "x", V.SCHEMA_ORG)) == {HTTPS + "x", HTTP + "x"} == set(Q.alias_variants(HTTP + "x", V.SCHEMA_ORG))
    assert rows(Q.of_subjects(t, spark.createDataFrame([(EX + "work1",)], "s string")), "p") == [(HTTP + "name",), (RDF_TYPE,)]


def test_blank_nodes(spark):
    t = frame(spark, quad("_:a", EX + "p", "_:b"), quad(EX + "s", EX + "p", "_:a"), quad(EX + "s", EX + "p", "x"))
    named = Q.skolemize(t)
    assert Q.blank_nodes(named).count() == 0 and Q.blank_nodes(t).count() == 2
    subject = named.where("o_kind = 'iri' and s <> 'http://example.org/s'").first().s
    assert named.where(named.o == subject).count() == 1
    assert rows(Q.skolemize(t.repartition(3)), "s", "o") == rows(named, "s", "o")
    try:
        Q.assert_no_blank_nodes(t).collect()
    except Exception as e:
        assert "blank node" in str(e)
    else:
        raise AssertionError
