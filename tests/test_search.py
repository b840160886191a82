import pytest
from pyspark.sql import functions as F

from quadloom.functions.text import fold_text
from quadloom.search.engine import QueryError, SearchEngine
from quadloom.search.project import project
from quadloom.search.query import Criterion, Filter, SearchQuery, Sort, page, unsatisfiable, validate_query, where
from quadloom.search.schema import Field, JoinGraph, Key, Range, SearchSchema, SearchType, document_schema, inline_depth, physical_name, validate

from .graphs import EX, frame, quad

RANGES = (Range("a", 1, 10), Range("b", 10, 100), Range("c", 100))
WORK = SearchType("Work", (
    Field("title", "text", output=True, searchable=5, sortable=True, locales=("nl", "en")), Field("keyword", "keyword", array=True, facetable=True, filterable=True, searchable=1),
    Field("status", "keyword", facetable=True, filterable=True), Field("size", "integer", filterable=True, sortable=True, facetable=True, facet_ranges=RANGES),
    Field("iiif", "boolean", filterable=True, facetable=True, output=True), Field("posted", "date", filterable=True, sortable=True),
    Field("dataset", "reference", array=True, ref="Dataset", label_source=True, joinable=True),
), class_iri=EX + "Work")
DATASET = SearchType("Dataset", (Field("name", "keyword", filterable=True, output=True), Field("publisher", "reference", ref="Publisher", label_source=True, joinable=True)), class_iri=EX + "Dataset")
PUBLISHER = SearchType("Publisher", (Field("name", "keyword", filterable=True),), class_iri=EX + "Publisher")
SCHEMA = SearchSchema((WORK, DATASET, PUBLISHER))


@pytest.fixture(scope="module")
def engine(spark):
    works = spark.createDataFrame([
        ("w1", {"nl": "Møhlmann"}, "mohlmann", None, ["x", "y", "x"], "open", 5, True, 100, ["d1", "d2"]), ("w2", {"en": "Other"}, None, "other", ["y"], "closed", 10, False, -34712668800, ["d2"]),
        ("w3", {}, None, None, None, "open", 150, None, None, None), ("w4", {"nl": "Zee"}, "zee", None, [], None, None, True, 300, ["gone"]),
    ], "id string, title map<string,string>, title_search_nl string, title_search_en string, keyword array<string>, status string, size long, iiif boolean, posted long, dataset array<string>")
    works = works.withColumns({"title_sort_nl": F.col("title_search_nl"), "title_sort_en": F.col("title_search_en")})
    return SearchEngine(SCHEMA, {
        "Work": works, "Dataset": spark.createDataFrame([("d1", "one", "p1"), ("d2", "two", "p2")], "id string, name string, publisher string"),
        "Publisher": spark.createDataFrame([("p1", "P"), ("p2", "Q")], "id string, name string"),
    })


def ids(engine, *clauses, **more):
    return [r.id for r in engine.hits("Work", SearchQuery(where=where(*clauses), **more)).collect()]


def test_clauses(engine):
    c = Criterion
    assert ids(engine, c("status", in_=("open",))) == ["w1", "w3"]
    assert ids(engine, c("keyword", in_=("y", "z"))) == ["w1", "w2"]
    assert ids(engine, Filter((c("status", in_=()), c("iiif", is_=False)))) == ["w1", "w2", "w3", "w4"]  # a void alternative voids the clause
    assert ids(engine, Filter((c("id", in_=()), c("status", in_=("closed",))))) == ["w2"]  # one that cannot hold drops out
    assert ids(engine, Filter((c("id", in_=()), c("id", in_=())))) == []
    assert unsatisfiable(SearchQuery(where=where(c("id", in_=())))) and ids(engine, c("id", in_=())) == []
    assert ids(engine, c("size", range_=(None, 10))) == ["w1", "w2"] and ids(engine, c("size", range_=(None, None))) == ["w1", "w2", "w3", "w4"]
    assert ids(engine, c("posted", range_=(None, "-0800-01-01"))) == [] and ids(engine, c("posted", range_=("-1100", "0900"))) == ["w2"]
    assert ids(engine, c("iiif", is_=False)) == ["w2"]  # absent is not false for a filter
    assert ids(engine, Filter(())) == ["w1", "w2", "w3", "w4"]


def test_joins(engine):
    c = Criterion
    assert ids(engine, c("name", in_=("P",), on=("dataset", "publisher"))) == ["w1"]
    assert ids(engine, c("name", in_=("Q",), on=("dataset", "publisher"))) == ["w1", "w2"]
    assert ids(engine, c("name", in_=("one",), on=("dataset",)), c("name", in_=("Q",), on=("dataset", "publisher"))) == ["w1"]  # met by different referents
    assert ids(engine, Filter((c("name", in_=("one",), on=("dataset",)), c("status", in_=("closed",))))) == ["w1", "w2"]
    assert ids(engine, c("id", in_=("p2",), on=("dataset", "publisher"))) == ["w1", "w2"]


def test_text_order_and_pages(engine):
    assert ids(engine, text="Mohlmann") == ids(engine, text="MØHLMANN") == ["w1"] and ids(engine, text="mohlmann other") == []
    assert ids(engine, order_by=(Sort("size", True),)) == ["w3", "w2", "w1", "w4"]
    assert ids(engine, order_by=(Sort("title"),), locale="nl") == ["w1", "w4", "w2", "w3"]
    assert ids(engine, limit=2, offset=3) == ["w3", "w4"] and ids(engine, limit=0) == []
    assert page(3, 10) == (10, 20)
    row = engine.hits("Work", SearchQuery(where=where(Criterion("id", in_=("w3",))))).first()
    assert row.iiif is False
    with pytest.raises(ValueError):
        page(0)


def test_facets_leave_out_their_own_clauses(engine):
    q = SearchQuery(where=where(Criterion("status", in_=("open",)), Criterion("iiif", is_=True)), facets=("status", "keyword", "size"))
    got = sorted((r.field, r.value, r["count"]) for r in engine.facets("Work", q).collect())
    assert got == [("keyword", "x", 1), ("keyword", "y", 1), ("size", "a", 1), ("status", "open", 1)]
    for name in q.facets:  # one pass gives what one query a facet would
        alone = SearchQuery(where=tuple(f for f in q.where if f.owned != name), facets=(name,))
        assert sorted((r.value, r["count"]) for r in engine.facets("Work", alone).collect()) == sorted((v, n) for f, v, n in got if f == name)
    outcomes = engine.search_facets("Work", [SearchQuery(facets=("nope",)), SearchQuery(facets=("iiif",))])
    assert isinstance(outcomes[0], QueryError) and sorted((r.value, r["count"]) for r in outcomes[1].collect()) == [("false", 1), ("true", 2)]


def test_referents(engine):
    q = SearchQuery(resolve=(("dataset", ("name",)),), where=where(Criterion("id", in_=("w1", "w4"))))
    rows = engine.resolve(engine.tables["Work"].where("id in ('w1', 'w4')").select("id", "dataset"), WORK.field("dataset"), ["name"]).orderBy("id").collect()
    assert [[tuple(x) for x in r.dataset] for r in rows] == [[("d1", "one"), ("d2", "two")], [("gone", None)]]
    assert not validate_query(q, WORK, SCHEMA)


def test_query_issues():
    c = Criterion
    q = SearchQuery(where=where(c("nope", in_=("x",)), c("title", in_=("x",)), c("size", in_=("x",)), c("posted", range_=("soon", None)), c("name", in_=("x",), on=("keyword",)), c("name", in_=("x",), on=("dataset",) * 4)), facets=("title", "zip"), order_by=(Sort("zap"),), resolve=(("status", ()),))
    assert {i.reason for i in validate_query(q, WORK, SCHEMA)} == {"unknown-field", "not-filterable", "operator-mismatch", "unparseable-bound", "unknown-join", "join-too-deep", "not-facetable", "not-resolvable"}


def issues(*fields, **more):
    return {i.reason for i in validate(SearchSchema((SearchType("T", fields, class_iri="urn:t", **more),)))}


@pytest.mark.parametrize(("f", "reason"), [
    (Field("1x", "keyword"), "invalid-field-name"), (Field("x", "blob"), "unknown-kind"), (Field("x", "text", locales=("n_l",)), "invalid-locale"), (Field("x", "reference", inline=True), "missing-ref"),
    (Field("x", "reference", ref="No"), "missing-ref-type-name"), (Field("x", "keyword", ref="T"), "ref-not-allowed"), (Field("x", "text", searchable=1), "text-requires-locales"), (Field("x", "keyword", locales=("nl",)), "locales-not-allowed"),
    (Field("x", "keyword", facet_ranges=RANGES), "facet-ranges-not-allowed"), (Field("x", "integer", searchable=1), "searchable-not-allowed"), (Field("x", "date", transform=str), "transform-not-allowed"), (Field("x", "keyword", derive=str, path=("p",)), "derive-with-path"),
    (Field("x", "date", from_value="dataset"), "from-not-allowed"), (Field("x", "keyword", from_value="dataset", path=("p",)), "from-with-path"), (Field("x", "keyword", from_value="dataset", derive=str), "from-with-derive"), (Field("x", "keyword", from_value="other"), "unknown-projection-value"),
    (Field("x", "text", filterable=True), "text-not-filterable"), (Field("x", "text", facetable=True), "text-not-facetable"), (Field("x", "keyword", joinable=True), "joinable-not-allowed"), (Field("x", "reference", ref="T", joinable=True), "joinable-without-label-source"),
    (Field("x", "reference", ref="T", label_source=True, joinable=True, inline=True), "joinable-with-inline-ref"), (Field("or", "keyword"), "reserved-field-name"), (Field("x", "reference", ref="T", inline=True), "inline-cycle"),
])
def test_declaration_issues(f, reason):
    assert reason in issues(f)


def test_key_issues_and_names():
    ref = Field("k", "reference", array=True, path=("p",))
    assert not issues(ref, key=Key("k"))
    for f, reason in ((Field("k", "keyword", array=True, path=("p",)), "key-field-not-reference"), (Field("k", "reference", path=("p",)), "key-field-not-array"), (Field("k", "reference", array=True), "key-field-without-path")):
        assert reason in issues(f, key=Key("k"))
    assert "key-field-unknown" in issues(ref, key=Key("z")) and "duplicate-field-name" in issues(ref, ref)
    assert [physical_name(SearchType(n, ())) for n in ("CreativeWork", "DCATDataset", "Person", "TVSeries", "Analysis", "creative work")] == ["creative_works", "dcat_datasets", "people", "tv_series", "analyses", "creative_works"]
    with pytest.raises(ValueError):
        physical_name(SearchType("Café", ()))
    assert JoinGraph(SCHEMA).components() == [["Publisher", "Dataset", "Work"]] and inline_depth(SCHEMA, "Work") == 0
    assert document_schema(SCHEMA, WORK)["title_search_nl"].dataType.simpleString() == "string"


def test_projection(spark):
    place = SearchType("Place", (Field("same", "reference", path=(EX + "same",), array=True, output=True, transform=lambda c: F.regexp_replace(F.regexp_replace(c, "/$", ""), "^http:", "https:")), Field("name", "keyword", path=(EX + "name",), output=True)), class_iri=EX + "Place", key=Key("same"))
    work = SearchType("Work", (
        Field("title", "text", path=(EX + "title",), output=True, searchable=1, sortable=True, locales=("nl",)), Field("year", "integer", path=(EX + "year",), output=True), Field("on", "boolean", path=(EX + "on",), output=True),
        Field("made", "date", path=(EX + "made",), output=True), Field("at", "reference", path=(EX + "at",), ref="Place", output=True), Field("hidden", "keyword", path=(EX + "year",)),
    ), class_iri=EX + "Work")
    schema = SearchSchema((place, work))
    t = frame(
        spark, quad(EX + "1", "a", EX + "Work"), quad(EX + "1", EX + "title", "Één", "nl"), quad(EX + "1", EX + "title", "Twee", "nl"), quad(EX + "1", EX + "title", "One", "en_GB"), quad(EX + "1", EX + "year", " 12.9 "),
        quad(EX + "1", EX + "on", "0"), quad(EX + "1", EX + "made", "-1100"), quad(EX + "1", EX + "at", EX + "p1"), quad("_:b", "a", EX + "Work"), quad(EX + "2", "a", EX + "Work"), quad(EX + "2", EX + "year", "0x10"),
        quad(EX + "p1", "a", EX + "Place"), quad(EX + "p1", EX + "same", "http://x.org/1/"), quad(EX + "p2", "a", EX + "Place"), quad(EX + "p2", EX + "same", "https://x.org/1"), quad(EX + "p3", "a", EX + "Place"), quad(EX + "p3", EX + "same", "nothing"),
    )
    one, two = project(t, schema, work).orderBy("id").collect()
    assert one.title == {"nl": "Twee", "en-gb": "One"} or one.title["nl"] in ("Één", "Twee")
    assert set(one.title_search_nl.split()) == {"een", "twee"} and (one.year, one.on) == (12, False) and one.made < 0
    assert (two.year, two.on, two.title, two["at"]) == (16, None, None, None) and "hidden" not in one
    assert one["at"] == EX + "p1" or one["at"].startswith("http")
    assert sorted(r.id for r in project(t, schema, place).collect()) == [EX + "p3", "https://x.org/1"]


def test_fold():
    assert [fold_text(x) for x in ("Møhlmann", "ÆØÅ Œ ß", "ﬁŁ", "")] == ["mohlmann", "aeoa oe ss", "fil", ""]
    assert fold_text(fold_text("Ĳſ")) == fold_text("Ĳſ")


def test_names_languages_and_defaults():
    from quadloom.search.query import SearchQuery, language_order, with_defaults
    from quadloom.search.schema import Field, SearchSchema, SearchType, SharedName, display_fields, physical_name, sweepable, table_names

    assert language_order(("nl", "en"), ["und", "de", "en", "fr", "nl"]) == ["nl", "en", "de", "fr", "und"]
    q = with_defaults(SearchQuery(text="x", limit=5), limit=50, locale="nl")
    assert (q.text, q.limit, q.locale) == ("x", 5, "nl")
    source = Field("source", "keyword", facetable=True)
    a, b = SearchType("Person", (source,), class_iri="urn:p"), SearchType("person", (Field("source", "keyword", array=True),), class_iri="urn:q")
    assert sweepable(a, "source") == [] and sweepable(b, "source") == ["array", "not-facetable"] and sweepable(a, "other") == ["missing"]
    both = SearchSchema((a, b))
    if physical_name(a) == physical_name(b):
        with pytest.raises(SharedName):
            table_names(both)
    assert table_names(both, {"Person": "x", "person": "x"}) == {"Person": "x", "person": "x"}
    assert display_fields(Field("title", "text", locales=("en", "nl")), ["nl", "de"]) == {"nl": "title_search_nl"}


def test_folding_is_one_for_index_and_query(spark):
    from pyspark.sql import functions as F

    from quadloom.functions.text import fold, fold_text

    texts = ["Plain", "Ő ű Ę", "Größe", "Ærø", "", None, "Ωmega", "ﬁne", "ŁÓDŹ", "naïve"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", fold(F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [None if t is None else fold_text(t) for t in texts]


def test_referents_of_several_levels(spark):
    from quadloom.search.engine import SearchEngine
    from quadloom.search.schema import Field, SearchSchema, SearchType

    schema = SearchSchema((
        SearchType("Region", (Field("label", "keyword", output=True),), class_iri="urn:r"), SearchType("Nation", (Field("label", "keyword", output=True), Field("region", "reference", ref="Region", output=True)), class_iri="urn:n"),
        SearchType("Person", (Field("nations", "reference", ref="Nation", array=True, output=True),), class_iri="urn:p"),
    ))
    tables = {
        "Region": spark.createDataFrame([("r1", "One")], "id string, label string"), "Nation": spark.createDataFrame([("n1", "A", "r1"), ("n2", "B", "r9")], "id string, label string, region string"),
        "Person": spark.createDataFrame([("p", ["n2", "n1", "n9"])], "id string, nations array<string>"),
    }
    row = SearchEngine(schema, tables).referents("Person", [], {"nations": (["label"], {"region": (["label"], {})})}).first()
    assert [(x.id, x.label, x.region and (x.region.id, x.region.label)) for x in row.nations] == [("n2", "B", ("r9", None)), ("n1", "A", ("r1", "One")), ("n9", None, None)]
