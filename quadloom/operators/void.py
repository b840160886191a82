"""Dataset statistics: counts and partitions by class, property, datatype, language and namespace.

All take ``t``, a set of triples (the term columns). Partitions by class share
the join of triples with their subjects' classes on the subject: one shuffle,
after which each statistic aggregates partially before its own. Those that count
subjects, objects or classes also take a ``Graph``; one of tables needs no such join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.operators.graph import Graph, graph_of, types
from quadloom.operators.graph import object_key as _object_key
from quadloom.operators.quads import canonical_iri
from quadloom.sources.tables import TERM_COLUMNS

VOID, VOID_EXT = "http://rdfs.org/ns/void#", "http://ldf.fi/void-ext#"
WELL_KNOWN = "/.well-known/void#"
SCHEMA_ORG = {"http://schema.org/": "https://schema.org/"}
#: Fixed predicates that state a license.
LICENSE_PREDICATES = ["http://schema.org/license", "https://schema.org/license", "http://purl.org/dc/elements/1.1/license", "https://www.ica.org/standards/RiC/ontology#conditionsOfUse"]
#: Groups that the subject namespaces keep, before single entities go.
TOP_SPACES = 10


def triples(t: DataFrame) -> DataFrame:
    return t.agg(F.count("*").alias("triples"))


def subjects(t: DataFrame | Graph) -> DataFrame:
    return graph_of(t).subjects().where("s_kind <> 'bnode'").agg(F.count("*").alias("distinct_subjects"))


def properties(t: DataFrame) -> DataFrame:
    return t.agg(F.count_distinct("p").alias("properties"))


def object_literals(t: DataFrame) -> DataFrame:
    return t.where("o_kind = 'literal'").agg(F.count_distinct(_object_key()).alias("distinct_literals"))


def object_uris(t: DataFrame) -> DataFrame:
    return t.where("o_kind = 'iri'").agg(F.count_distinct("o").alias("distinct_iri_objects"))


def datatypes(t: DataFrame) -> DataFrame:
    """A row a datatype with their number; no literals, no rows."""
    found = t.where("o_kind = 'literal' and o_dt is not null").agg(F.collect_set("o_dt").alias("all"))  # a few names
    return found.select(F.explode("all").alias("datatype"), F.size("all").cast("long").alias("datatypes"))


def class_partitions(t: DataFrame) -> DataFrame:
    return types(t).groupBy("class").agg(F.count("*").alias("entities"))


def class_property_subjects(t: DataFrame | Graph) -> DataFrame:
    """Distinct subjects."""
    return graph_of(t).class_property_subjects()


def class_property_objects(t: DataFrame | Graph) -> DataFrame:
    return graph_of(t).class_property_objects()


def class_property_datatypes(t: DataFrame | Graph) -> DataFrame:
    """Literal triples by datatype."""
    return graph_of(t).class_property_literals()


def class_property_languages(t: DataFrame) -> DataFrame:
    """Distinct literals by language: unlike datatypes, not triples."""
    tagged = t.where("o_kind = 'literal' and o_lang <> ''").select("s", "p", "o", "o_lang")
    return tagged.join(types(t), "s").select("class", "p", "o", "o_lang").distinct().groupBy("class", "p", F.col("o_lang").alias("language")).agg(F.count("*").alias("triples"))


def class_property_object_classes(t: DataFrame | Graph) -> DataFrame:
    """Links are counted for each object first: an object of most triples, as a class is, is one row of the join."""
    g = graph_of(t)
    objects = g.object_types().select(F.col("s").alias("o"), F.col("class").alias("object_class"))
    return g.links().join(objects, "o").groupBy("class", "p", "object_class").agg(F.sum("triples").alias("triples"))


def entity_properties(t: DataFrame | Graph) -> DataFrame:
    """Distinct subjects and objects of each property: two aggregates and a join of their few rows, not one expanded input."""
    g = graph_of(t)
    return g.property_subjects().join(g.property_objects(), "p")


def licenses(t: DataFrame) -> DataFrame:
    """Triples by license term; a literal and an IRI of one text are two groups."""
    return t.where(F.col("p").isin(LICENSE_PREDICATES)).groupBy(F.col("o").alias("license"), "o_kind").agg(F.count("*").alias("triples")).select("license", "triples")


def subject_uri_spaces(t: DataFrame | Graph, top: int = TOP_SPACES) -> DataFrame:
    """The largest namespaces of subjects; those of a single entity go after the cut, not before."""
    return graph_of(t).subject_spaces().orderBy(F.desc("entities"), "uri_space").limit(top).where("entities > 1")


def object_uri_spaces(t: DataFrame, top: int | None = None) -> DataFrame:
    spaces = t.where("o_kind = 'iri'").groupBy(F.regexp_replace("o", "([^/]+$)", "").alias("uri_space")).agg(F.count("*").alias("triples"))
    return spaces if top is None else spaces.orderBy(F.desc("triples"), "uri_space").limit(top)


def first_prefix(text: Column, configured: list[tuple[str, str]]) -> Column:
    """The value of the first configured (prefix, value) that a text starts with; null if there is none.

    One expression over the list: no join, whatever the number of rows.
    """
    return F.coalesce(*(F.when(text.startswith(prefix), F.lit(value)) for prefix, value in configured), F.lit(None).cast("string"))


def map_uri_spaces(spaces: DataFrame, configured: list[tuple[str, str]]) -> DataFrame:
    """Counts of object namespaces summed by configured space; others go."""
    named = spaces.withColumn("space", first_prefix(F.col("uri_space"), configured)).where("space is not null")
    return named.groupBy("space").agg(F.sum("triples").alias("triples"))


def vocabularies(t: DataFrame, known: list[tuple[str, str]]) -> DataFrame:
    """The vocabularies of the properties in use."""
    return t.select("p").distinct().select(first_prefix(F.col("p"), known).alias("vocabulary")).where("vocabulary is not null").distinct()


def mint(dataset: Column | str, kind: str, *parts: Column) -> Column:
    """A partition's IRI: the md5 of its joined parts under the dataset's well-known path."""
    base = dataset if isinstance(dataset, Column) else F.lit(dataset)
    return F.concat(base, F.lit(f"{WELL_KNOWN}{kind}-"), F.md5(F.concat(*parts)))


def merge_variants(partitions: DataFrame, keys: list[str], measures: list[str], aliases: dict[str, str] = SCHEMA_ORG) -> DataFrame:
    """Partitions whose keys are spellings of one IRI, merged: keys canonical, measures summed.

    A sum of distinct counts may count an object of two spellings twice; so the merge is defined.
    """
    canonical = partitions.withColumns({k: canonical_iri(F.col(k), aliases) for k in keys})
    return canonical.groupBy(*keys).agg(*(F.sum(F.coalesce(F.col(m).try_cast("bigint"), F.lit(0))).alias(m) for m in measures))


def statistics(t: DataFrame, top: int | None = None) -> dict[str, DataFrame]:
    """All statistics of a table of triples, by name, from one stored set of them.

    The triples are written once as a set, dealt by subject, and once with each of their subject's
    classes; every statistic reads one of the two.
    """
    from quadloom.plans.tables import checkpointed

    t = checkpointed(t.select(*TERM_COLUMNS).repartition("s").distinct())
    by_class = checkpointed(t.join(types(t), "s"))
    pairs = by_class.groupBy("class", "p")
    literals = by_class.where("o_kind = 'literal'")
    tagged = literals.where("o_lang <> ''").select("class", "p", "o", F.col("o_lang").alias("language")).distinct()
    objects = types(t).select(F.col("s").alias("o"), F.col("class").alias("object_class"))
    return {
        "triples": triples(t), "subjects": subjects(t), "properties": properties(t), "object_literals": object_literals(t), "object_uris": object_uris(t), "datatypes": datatypes(t),
        "class_partitions": class_partitions(t), "entity_properties": entity_properties(t), "licenses": licenses(t),
        "subject_uri_spaces": subject_uri_spaces(t), "object_uri_spaces": object_uri_spaces(t, top),
        "class_property_subjects": by_class.select("class", "p", "s").distinct().groupBy("class", "p").agg(F.count("*").alias("entities")),
        "class_property_objects": pairs.agg(F.count_distinct(_object_key()).alias("distinct_objects")),
        "class_property_datatypes": literals.groupBy("class", "p", F.col("o_dt").alias("datatype")).agg(F.count("*").alias("triples")),
        "class_property_languages": tagged.groupBy("class", "p", "language").agg(F.count("*").alias("triples")),
        "class_property_object_classes": by_class.where("o_kind = 'iri'").select("class", "p", "o").join(objects, "o").groupBy("class", "p", "object_class").agg(F.count("*").alias("triples")),
    }


def partition_chain(found: DataFrame, dataset: str, measure: str, leaf: str | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Quads of partitions (class, p, leaf column if given, measure) under a dataset: each class partition, in it each
    property partition, in that each of the leaf's. With aliases, partitions of spellings of one IRI are merged first and
    every IRI of the chain is minted from the merged keys.
    """
    from quadloom.operators.quads import construct

    keys = ["class", "p", *([leaf] if leaf else [])]
    merged = merge_variants(found, keys, [measure], aliases or {}) if aliases else found
    c, p = F.col("class"), F.col("p")
    of_class, of_property = mint(dataset, "class", c), mint(dataset, "class-property", c, p)
    rows = merged.withColumns({"__d": F.lit(dataset), "__c": of_class, "__p": of_property})
    template = [
        (F.col("__d"), f"{VOID}classPartition", ("iri", F.col("__c"))), (F.col("__c"), f"{VOID}class", ("iri", c)),
        (F.col("__c"), f"{VOID}propertyPartition", ("iri", F.col("__p"))), (F.col("__p"), f"{VOID}property", ("iri", p)),
    ]
    at = F.col("__p")
    if leaf:
        rows = rows.withColumn("__l", mint(dataset, leaf, c, p, F.col(leaf)))
        at = F.col("__l")
        template += [(F.col("__p"), f"{VOID_EXT}{leaf}Partition", ("iri", at)), (at, f"{VOID_EXT}{leaf}", F.col(leaf) if leaf == "language" else ("iri", F.col(leaf)))]
    return construct(rows, [*template, (at, VOID + {"entities": "entities", "distinct_objects": "distinctObjects"}.get(measure, "triples"), F.col(measure))])
