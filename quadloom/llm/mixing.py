"""Mixing sources to target weights by temperature, in DataFrame functions alone.

1. Tokens are summed by source: share p_s.
2. Weights are p_s ** a, normalised. The exponent a is bisected between 0
   (all sources alike) and 1 (as found): the largest a whose entropy reaches
   ``entropy_share`` of the most that so many sources can have; then, if
   ``max_passes`` is given, raised until no source is repeated more often.
3. Each source gets a budget of tokens: its weight times the total budget.
   The default total is the least that passes over every source once or more,
   so nothing is lost and small sources repeat.
4. A budget is whole passes over the source and a part of one more. The part
   is taken in the order of a hash of doc_id, a pseudo-random permutation. The
   hash's leading bits cut it into blocks; sums of tokens by block, then by
   groups of blocks, find the block in which the budget ends, and only that
   block's documents are looked at one by one. No source is ever in one task.

``mix_blocks`` deals what is chosen into blocks of the output, each a sample of
the whole mix, one block for each copy: a source's k-th pass (from 0) at hash h
stands at (k + h) / passes. There are as many blocks as the copies of all
documents fill with ``OUTPUT_BLOCK_DOCS`` each.

A token is a word: a run of anything but ASCII white space.

Defined results: null and empty texts have no tokens; they stand where their
hash puts them; very long ones are counted in the JVM like others. A null source is a source. Rows that repeat a doc_id share its
place and are chosen together, each counted. A source without tokens gets one
pass. Empty tables give an empty result. Other columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadloom.llm.workspace import materialize

ENTROPY_SHARE = 0.9
SEED = 17
#: Steps of the bisection, those that one pass over the sources settles, and the decimals that are kept.
STEPS, STEPS_A_PASS, DECIMALS = 20, 5, 5
HASH_BITS = 60
#: Documents that a block is planned for, and blocks in a group.
BLOCK_DOCS, GROUP_BITS = 1024, 10
OUTPUT_BLOCK_DOCS = 65536
#: Sources up to which a table of one row a source is broadcast; beyond it the join is left to Spark.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, seed: int) -> Column:
    """A document's place in its source's permutation: 60 bits of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def token_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, h), written out."""
    rows = docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("n_tokens"), place(F.col("doc_id"), seed).alias("h"))
    return materialize(rows, "tokens")


def source_totals(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n_docs")), "sources")


def _entropy(sums: tuple[float, float], a: float) -> float:
    return math.log(sums[0]) - a * sums[1] / sums[0]


def exponent(sources: DataFrame, entropy_share: float = ENTROPY_SHARE, max_passes: float | None = None, budget: int | None = None) -> float:
    """The temperature exponent; only sums over the sources come to the driver."""
    held = sources.where("total > 0")
    n, all_tokens, least, most = held.agg(F.count("*"), F.sum("total"), F.min("total"), F.max("total")).first()
    if not n or n == 1:
        return 1.0
    p = F.col("total") / F.lit(float(all_tokens))

    def sums(points: list[float]) -> dict[float, tuple[float, float]]:
        aggs = [x for a in points for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]
        row = held.agg(*aggs).first()
        return {a: (row[2 * i], row[2 * i + 1]) for i, a in enumerate(points)}

    def passes(a: float, s0: float) -> float:
        """The most passes over a source: over the smallest, as weights fall slower than shares."""
        total = all_tokens * s0 * (most / all_tokens) ** (1 - a) if budget is None else budget
        return total * (least / all_tokens) ** a / s0 / least

    def bisect(good) -> float:
        """The largest a in [0, 1] for which good(a) holds, if it holds at 0 and then fails at some point."""
        lo, hi, at = 0, 1 << STEPS, {}
        scale = float(1 << STEPS)
        for done in range(STEPS):
            if done % STEPS_A_PASS == 0:
                step = (hi - lo) >> STEPS_A_PASS
                at = sums([(lo + i * step) / scale for i in range(1, 1 << STEPS_A_PASS)])
            mid = (lo + hi) // 2
            if good(mid / scale, at[mid / scale]):
                lo = mid
            else:
                hi = mid
        return lo / scale

    target = entropy_share * math.log(n)
    if _entropy(sums([1.0])[1.0], 1.0) >= target:
        a = 1.0
    else:
        a = bisect(lambda x, s: _entropy(s, x) >= target)
    if max_passes is not None and passes(a, sums([a])[a][0]) > max_passes:
        a = 1.0 if passes(1.0, 1.0) > max_passes else bisect(lambda x, s: passes(x, s[0]) > max_passes) + 1 / (1 << STEPS)
    return round(a, DECIMALS)


def source_budgets(sources: DataFrame, a: float, budget: int | None = None) -> DataFrame:
    """(source, total, n_docs, weight, passes, rest): whole passes, and tokens of one more."""
    held = F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), F.lit(a))).otherwise(0.0)
    norm, full = sources.agg(F.sum(held), F.max(F.when(F.col("total") > 0, F.try_divide("total", held)))).first()  # two numbers
    # the budget over the norm: with none given, the least for which each source's passes reach 1
    scale = F.lit((full or 0.0) if budget is None else float(budget) / norm if norm else 0.0)
    out = sources.select("source", "total", "n_docs", F.coalesce(F.try_divide(held, F.lit(norm or 0.0)), F.lit(0.0)).alias("weight"), F.round(scale * held).cast("long").alias("quota"))
    total = F.col("total")
    return out.select(
        "source", "total", "n_docs", "weight",
        F.when(total > 0, F.floor(F.try_divide("quota", "total"))).otherwise(1).cast("long").alias("passes"),
        F.when(total > 0, F.try_mod("quota", "total")).otherwise(0).cast("long").alias("rest"),
    )


def _with_source(rows: DataFrame, table: DataFrame, n_sources: int) -> DataFrame:
    small = table.withColumnRenamed("source", "__source")
    small = F.broadcast(small) if n_sources <= BROADCAST_SOURCES else small
    return rows.join(small, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def cuts(rows: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """(source, cut): the last hash of each source's partial pass; -1 if there is none.

    A document is in if the tokens before its hash fall short of the rest.
    """
    block_bits = max(0, math.ceil(math.log2(max(1, rows.count()) / BLOCK_DOCS)))
    block = F.shiftrightunsigned(F.col("h"), HASH_BITS - block_bits)
    places = rows.groupBy("source", block.alias("block")).agg(F.sum("n_tokens").alias("tokens"))
    blocks = materialize(_with_source(places, budgets.where("rest > 0").select("source", "rest"), n_sources), "blocks")

    def crossing(level: DataFrame, at: str) -> DataFrame:
        """The first ``at`` of each source at whose end its tokens reach the rest, and the rest within it."""
        before = F.sum("tokens").over(W.partitionBy("source").orderBy(at).rowsBetween(W.unboundedPreceding, -1))
        before = F.coalesce(before, F.lit(0))
        return level.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest"))).select("source", at, (F.col("rest") - F.col("before")).alias("rest"))

    groups = blocks.groupBy("source", "rest", F.shiftright("block", GROUP_BITS).alias("group")).agg(F.sum("tokens").alias("tokens"))
    group = crossing(groups, "group").withColumnsRenamed({"group": "g", "rest": "r"})
    inside = _with_source(blocks.drop("rest").withColumn("group", F.shiftright("block", GROUP_BITS)), group, n_sources).where("group = g")
    last = crossing(inside.select("source", "block", "tokens", F.col("r").alias("rest")), "block").withColumnsRenamed({"block": "b", "rest": "r"})
    docs = _with_source(rows.withColumn("block", block), last, n_sources).where("block = b")
    tied = docs.groupBy("source", "h", F.col("r").alias("rest")).agg(F.sum("n_tokens").alias("tokens"))
    return materialize(crossing(tied, "h").select("source", F.col("h").alias("cut")), "cuts")


ADDED = ["n_tokens", "weight", "copies", "mix_blocks"]


def _plan(rows: DataFrame, entropy_share: float, max_passes: float | None, budget: int | None) -> tuple[DataFrame, int, int]:
    """(source, __weight, __passes, __cut, __all), the number of sources, and that of the output's blocks."""
    sources = source_totals(rows)
    n_sources = sources.count()
    budgets = materialize(source_budgets(sources, exponent(sources, entropy_share, max_passes, budget), budget), "budgets")
    found = cuts(rows, budgets, n_sources)
    plan = budgets.join(found.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    every = F.when(F.col("total") > 0, F.col("passes") + F.col("rest") / F.col("total")).otherwise(1.0)
    n_copies = budgets.agg(F.sum(F.col("n_docs") * every)).first()[0] or 0.0
    plan = plan.select("source", F.col("weight").alias("__weight"), F.col("passes").alias("__passes"), F.coalesce("cut", F.lit(-1)).alias("__cut"), every.alias("__all"))
    return plan, n_sources, max(1, int(n_copies) // OUTPUT_BLOCK_DOCS)


def _placed(rows: DataFrame, plan: DataFrame, n_sources: int, n_blocks: int, names: list[str], n_tokens: Column) -> DataFrame:
    """rows (…, source, __h) with what a plan gives them."""
    held = _with_source(rows, plan, n_sources)
    copies = F.col("__passes") + (F.col("__h") <= F.col("__cut")).cast("long")
    at = F.col("__h") / F.lit(float(1 << HASH_BITS))
    block = lambda k: F.least(F.floor((k + at) / F.greatest(F.col("__all"), F.lit(1e-9)) * n_blocks), F.lit(n_blocks - 1)).cast("long")
    empty = F.expr("cast(array() as array<bigint>)")
    blocks = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), block)).otherwise(empty)
    return held.select(*names, n_tokens.alias("n_tokens"), F.col("__weight").alias("weight"), copies.alias("copies"), blocks.alias("mix_blocks"))


def mix(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_passes: float | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """docs with n_tokens, weight (of the source), copies and mix_blocks (of each copy); copies may be 0."""
    plan = _plan(token_rows(docs, seed), entropy_share, max_passes, budget)
    names = [c for c in docs.columns if c not in ADDED]
    return _placed(docs.select(*names).withColumn("__h", place(F.col("doc_id"), seed)), *plan, names, word_count(F.col("text").cast("string")))


def mixed_rows(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_passes: float | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """As mix, without texts and other columns: (doc_id, source, n_tokens, weight, copies, mix_blocks). Texts are read once."""
    rows = token_rows(docs, seed)
    return _placed(rows.withColumnRenamed("h", "__h"), *_plan(rows, entropy_share, max_passes, budget), ["doc_id", "source"], F.col("n_tokens"))


def realise(mixed: DataFrame) -> DataFrame:
    """One row for each copy with its ``mix_block``, without what else mix added."""
    kept = [c for c in mixed.columns if c not in (*ADDED, "mix_block")]
    return mixed.select(*kept, F.explode("mix_blocks").alias("mix_block"))
