from pyspark.sql import functions as F

from quadloom.functions.text import _ACCENTED, TRANSLITERATED, fold, fold_text

LETTERS = sorted({x for k in (*_ACCENTED, *TRANSLITERATED) for x in (k, k.upper())})
TEXTS = [None, "", "Plain A\nB", "ÉCOLE Straße æther þing", "".join(LETTERS), *LETTERS, "KK Å ẞ İ", "Ἀθῆναι ΟΔΟΣ", "é ﬁ", "é\n漢字", "x]^-\\é", "é\x00Z"]


def test_every_text_is_folded_as_fold_text_does(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").select("k", fold(F.col("t")).alias("f")).collect()
    assert {r.k: r.f for r in rows} == {k: t if t is None else fold_text(t) for k, t in enumerate(TEXTS)}


def test_a_text_is_searched_once_for_all_letters(spark):
    plan = spark.range(1).select(fold(F.col("id").cast("string")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
