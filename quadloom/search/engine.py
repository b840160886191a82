"""The engine: queries compiled to DataFrame plans over one table for each type.

A criterion compiles to True (it states no constraint), False (it cannot hold)
or a condition; a clause is true if any of its criteria is, and False only if
all are. A criterion on another type is an existence test: the ids that hold
it are followed back hop by hop with semi joins, so nothing multiplies, and
each criterion is a test of its own.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quadloom.functions.text import fold_text, tokens
from quadloom.functions.values import iso_to_seconds
from quadloom.search.query import RELEVANCE, Criterion, Filter, SearchQuery, Sort, unsatisfiable, validate_query
from quadloom.search.schema import KINDS, Field, JoinGraph, Range, SearchSchema, SearchType

FACET_VALUES = 10


class QueryError(ValueError):
    """A query that its type does not allow; has the issues."""

    def __init__(self, issues: list):
        super().__init__("; ".join(f"{i.part}.{i.field}: {i.reason}" for i in issues))
        self.issues = issues


def _leaf(c: Criterion, search_type: SearchType) -> bool | Column:
    if c.field == "id":
        return F.col("id").isin(list(c.in_)) if c.in_ else False
    f = search_type.field(c.field)
    if f is None or KINDS[f.kind][0] != c.operator:
        return False
    column = F.col(f.name)
    if c.operator == "in":
        if not c.in_:
            return True
        return F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, c.in_))), F.lit(False)) if f.array else column.isin(list(c.in_))
    if c.operator == "is":
        return column == F.lit(c.is_)
    low, high = (iso_to_seconds(b) if f.kind == "date" and isinstance(b, str) else b for b in c.range_)
    held = lambda x: ([x >= F.lit(low)] if low is not None else []) + ([x <= F.lit(high)] if high is not None else [])
    if low is None and high is None:
        return True
    if f.array:
        return F.exists(column, lambda x: reduce(Column.__and__, held(x)))
    return reduce(Column.__and__, held(column))


class SearchEngine:
    """A schema and its tables: by type name, one row a document with ``id``."""

    def __init__(self, schema: SearchSchema, tables: dict[str, DataFrame], synonyms: list[set[str]] | None = None):
        """synonyms: sets of words that mean the same; a search for one finds the others."""
        self.schema, self.tables, self.graph = schema, tables, JoinGraph(schema)
        self.synonyms: dict[str, set[str]] = {}
        for same in synonyms or ():
            folded = {fold_text(x) for x in same}
            for word in folded:
                self.synonyms[word] = self.synonyms.get(word, set()) | folded

    # -- filters

    def _holders(self, c: Criterion, search_type: SearchType) -> bool | DataFrame:
        """Of a joined criterion: the ids (__id) of search_type's documents for which it holds."""
        hops = self.graph.resolve(search_type.name, c.on)
        if hops is None:
            return False
        leaf = _leaf(c, hops[-1][1])
        if leaf is True or leaf is False:
            return leaf
        ids = self.tables[hops[-1][1].name].where(leaf).select(F.col("id").alias("__ref"))
        owners = [search_type, *(t for _, t in hops[:-1])]
        for owner, (f, _) in reversed(list(zip(owners, hops, strict=True))):
            rows = self.tables[owner.name].select("id", (F.explode(f.name) if f.array else F.col(f.name)).alias("__ref"))
            ids = rows.join(ids, "__ref", "left_semi").select(F.col("id").alias("__ref"))
            if f.array:
                ids = ids.distinct()
        return ids.withColumnRenamed("__ref", "__id")

    def _clauses(self, rows: DataFrame, search_type: SearchType, filters: tuple[Filter, ...]) -> tuple[DataFrame, list[bool | Column]]:
        """rows, with a flag for each joined criterion that a clause has beside others, and each clause's condition."""
        out: list[bool | Column] = []
        for i, clause in enumerate(filters):
            terms: list[bool | Column] = []
            for j, c in enumerate(clause.any_of):
                held = self._holders(c, search_type) if c.on else _leaf(c, search_type)
                if isinstance(held, DataFrame):
                    flag = f"__holds_{i}_{j}"
                    rows = rows.join(held.select("__id", F.lit(True).alias(flag)), F.col("id") == F.col("__id"), "left").drop("__id")
                    held = F.coalesce(F.col(flag), F.lit(False))
                terms.append(held)
            if not terms or any(t is True for t in terms):
                out.append(True)
            else:
                conditions = [F.coalesce(t, F.lit(False)) for t in terms if t is not False]
                out.append(reduce(Column.__or__, conditions) if conditions else False)
        return rows, out

    def matching(self, type_name: str, query: SearchQuery) -> DataFrame:
        """The documents that the clauses and the text admit, with ``__score``."""
        search_type, rows = self.schema.type(type_name), self.tables[type_name]
        if unsatisfiable(query):
            return rows.limit(0).withColumn("__score", F.lit(0))
        rest = []
        for clause in query.where:  # a lone joined criterion is a plain semi join
            if len(clause.any_of) == 1 and clause.any_of[0].on and isinstance(held := self._holders(clause.any_of[0], search_type), DataFrame):
                rows = rows.join(held, F.col("id") == F.col("__id"), "left_semi")
            else:
                rest.append(clause)
        rows, conditions = self._clauses(rows, search_type, tuple(rest))
        for x in conditions:
            if x is not True:
                rows = rows.where(F.lit(False) if x is False else x)
        return self._scored(rows, search_type, query)

    # -- text

    def _scored(self, rows: DataFrame, search_type: SearchType, query: SearchQuery) -> DataFrame:
        """All folded words of the text must be in some searchable field; each field adds its weight a word it holds."""
        words = list(dict.fromkeys(w for w in _split(fold_text(query.text))))
        if not words:
            return rows.withColumn("__score", F.lit(0))

        def hit(column: Column, word: str) -> Column:
            """Whether a column holds a word, a word that means the same, or one that the last word begins."""
            found = tokens(F.coalesce(column, F.lit("")))
            if query.prefix and word == words[-1]:
                return F.exists(found, lambda x: x.startswith(word))
            same = self.synonyms.get(word)
            return F.arrays_overlap(found, F.array(*map(F.lit, sorted(same)))) if same else F.array_contains(found, word)

        held = [(hit(column, w), weight, w) for column, weight in self._searched(search_type, query.locale) for w in words]
        if not held:
            return rows.where(F.lit(False)).withColumn("__score", F.lit(0))
        score = reduce(Column.__add__, [F.when(hit, F.lit(weight)).otherwise(0) for hit, weight, _ in held])
        every = reduce(Column.__and__, [reduce(Column.__or__, [hit for hit, _, of in held if of == w]) for w in words])
        return rows.where(every).withColumn("__score", score)

    def _searched(self, search_type: SearchType, locale: str) -> list[tuple[Column, int]]:
        """Searched columns and weights: the active locale's and those of no language weigh in full, others one less."""
        out = []
        for f in sorted((f for f in search_type.fields if f.searchable), key=lambda f: -f.searchable):
            if f.kind == "text":
                out += [(F.col(f"{f.name}_search_{x}"), f.searchable if x in (locale, "und") else max(1, f.searchable - 1)) for x in f.locales]
            else:
                out.append((F.array_join(f.name, " ") if f.array else F.col(f.name), f.searchable))
        return out

    # -- results

    def _order(self, search_type: SearchType, query: SearchQuery) -> list[Column]:
        out = []
        for s in query.order_by or ((Sort(RELEVANCE, True),) if query.text else ()):
            f = search_type.field(s.field)
            column = "__score" if s.field == RELEVANCE else s.field
            if f is not None and f.kind == "text":
                column = f"{f.name}_sort_{query.locale if query.locale in f.locales else f.locales[0]}"
            out.append(F.col(column).desc_nulls_last() if s.descending else F.col(column).asc_nulls_last())
        return [*out, F.col("id").asc()]

    def check(self, type_name: str, query: SearchQuery) -> SearchType:
        search_type = self.schema.type(type_name)
        if search_type is None:
            raise KeyError(type_name)
        if issues := validate_query(query, search_type, self.schema):
            raise QueryError(issues)
        return search_type

    def hits(self, type_name: str, query: SearchQuery) -> DataFrame:
        """The page of documents, in order."""
        search_type = self.check(type_name, query)
        rows = self.matching(type_name, query).orderBy(*self._order(search_type, query))
        rows = rows.offset(query.page_start()).limit(query.limit) if query.page_start() else rows.limit(query.limit)
        outputs = ["id", *(f.name for f in search_type.fields if f.output)]
        booleans = {f.name for f in search_type.fields if f.kind == "boolean" and f.output}
        rows = rows.select(*(F.coalesce(c, F.lit(False)).alias(c) if c in booleans else F.col(c) for c in outputs))
        for name, fields in query.resolve:
            rows = self.resolve(rows, search_type.field(name), list(fields))
        return rows

    def referents(self, type_name: str, fields: list[str], nested: dict[str, tuple[list[str], dict]]) -> DataFrame:
        """A type's table with ``fields`` and, for each reference in nested (field: (fields, nested)), the referents'
        documents in place of their ids, level by level."""
        search_type = self.schema.type(type_name)
        rows = self.tables[type_name].select("id", *dict.fromkeys([*fields, *nested]))
        for name, (inner, deeper) in nested.items():
            f = search_type.field(name)
            table = self.referents(f.ref, inner, deeper)
            rows = SearchEngine(self.schema, {**self.tables, f.ref: table}).resolve(rows, f, [c for c in table.columns if c != "id"])
        return rows

    def total(self, type_name: str, query: SearchQuery) -> DataFrame:
        self.check(type_name, query)
        return self.matching(type_name, query).agg(F.count("*").alias("total"))

    def resolve(self, rows: DataFrame, f: Field, fields: list[str]) -> DataFrame:
        """rows with a reference's ids as structs of the target's fields; a target that is absent leaves its id alone."""
        target = self.tables[f.ref].select(F.col("id").alias("__t"), F.struct(F.col("id"), *fields).alias("__doc"))
        bare = F.struct(F.col("__ref").alias("id"), *(F.lit(None).cast(self.tables[f.ref].schema[c].dataType).alias(c) for c in fields))
        if not f.array:
            joined = rows.withColumn("__ref", F.col(f.name)).join(target, F.col("__ref") == F.col("__t"), "left")
            return joined.withColumn(f.name, F.when(F.col("__ref").isNotNull(), F.coalesce("__doc", bare))).drop("__ref", "__t", "__doc")
        single = rows.select(F.col("id").alias("__id"), F.posexplode(f.name).alias("__pos", "__ref")).join(target, F.col("__ref") == F.col("__t"), "left")
        lists = single.groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", F.coalesce("__doc", bare).alias("__doc")))), lambda x: x["__doc"]).alias("__docs"))
        return rows.join(lists, F.col("id") == F.col("__id"), "left").withColumn(f.name, F.col("__docs")).drop("__id", "__docs")

    def labels(self, rows: DataFrame, f: Field, label: str) -> DataFrame:
        """rows with ``<field>_label``: the label map of a referent."""
        target = self.tables[f.ref].select(F.col("id").alias("__t"), F.col(label).alias(f"{f.name}_label"))
        return rows.join(target, F.col(f.name) == F.col("__t"), "left").drop("__t")

    # -- facets

    def facets(self, type_name: str, query: SearchQuery, top: int = FACET_VALUES) -> DataFrame:
        """(field, value, count, min, max), each facet without its own clauses: one pass over the documents.

        Every clause is one flag; a facet counts the documents whose other clauses all hold.
        """
        search_type = self.check(type_name, query)
        rows = self.tables[type_name]
        if unsatisfiable(query):
            rows = rows.limit(0)
        rows, conditions = self._clauses(rows, search_type, query.where)
        rows = self._scored(rows, search_type, query)
        flags = [F.lit(x) if isinstance(x, bool) else x for x in conditions]
        per_facet = []
        for name in query.facets:
            others = [x for x, clause in zip(flags, query.where, strict=True) if clause.owned != name]
            admitted = reduce(Column.__and__, others) if others else F.lit(True)
            per_facet.append(F.when(admitted, self._named_buckets(search_type.field(name))))
        empty = F.expr("cast(array() as array<struct<field: string, value: string, min: double, max: double>>)")
        single = rows.select(F.explode(F.flatten(F.array(*(F.coalesce(x, empty) for x in per_facet)))).alias("b")).select("b.*")
        counts = single.groupBy("field", "value", "min", "max").agg(F.count("*").alias("count"))
        return self._top(counts, top)

    @staticmethod
    def _top(counts: DataFrame, top: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "value"))
        return counts.withColumn("__rank", rank).where(F.col("__rank") <= top).drop("__rank").select("field", "value", "count", "min", "max")

    def _named_buckets(self, f: Field) -> Column:
        return F.transform(self._buckets(f), lambda b: F.struct(F.lit(f.name).alias("field"), b["value"].alias("value"), b["min"].alias("min"), b["max"].alias("max")))

    @staticmethod
    def _buckets(f: Field) -> Column:
        """The buckets of a document: its distinct values, or the bins that hold its value. Bins may overlap."""
        null = F.lit(None).cast("double")
        values = F.array_distinct(F.col(f.name)) if f.array else F.array(F.col(f.name))
        if not f.facet_ranges:
            return F.transform(F.array_compact(values), lambda v: F.struct(v.cast("string").alias("value"), null.alias("min"), null.alias("max")))

        def bin_of(r: Range) -> Column:
            above = lambda v: v >= F.lit(r.min) if r.min is not None else v.isNotNull()
            below = lambda v: v < F.lit(r.max) if r.max is not None else F.lit(True)
            inside = F.exists(values, lambda v: F.coalesce(above(v) & below(v), F.lit(False)))
            return F.when(inside, F.struct(F.lit(r.key).alias("value"), F.lit(r.min).cast("double").alias("min"), F.lit(r.max).cast("double").alias("max")))

        return F.array_compact(F.array(*map(bin_of, f.facet_ranges)))

    def search_facets(self, type_name: str, queries: list[SearchQuery]) -> list[DataFrame | Exception]:
        """One outcome a query, in order; a query that is wrong does not stop the others."""
        out: list[DataFrame | Exception] = []
        for q in queries:
            try:
                out.append(self.facets(type_name, q))
            except (QueryError, KeyError) as e:
                out.append(e)
        return out


def _split(folded: str) -> list[str]:
    return re.findall(r"[^\W_]+", folded)
