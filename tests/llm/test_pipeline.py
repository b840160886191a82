import public_tokenizers
import sentencepiece

import corpus_pipeline

from . import brute

SF = "/root/testdata/sf0.001"


def brute_pipeline(rows, model):
    """rows: (doc_id, text, source) -> sorted [(doc_id, ids)]"""
    rows = [r for r in rows if brute.quality_kept(r[1] or "")]
    texts = {d: t for d, _, _, t in brute.line_dedup([(d, t) for d, t, _ in rows])}
    classes = brute.near_classes(list(texts.items()))
    rows = [(d, texts[d], s) for d, _, s in rows if classes[d] == d]
    copies = brute.mix(rows)
    return sorted((d, tuple(model.encode(t) + [2])) for d, t, _ in rows for _ in range(copies[d]))


def test_run_equals_brute_force(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == brute_pipeline([(r.doc_id, r.text, r.source) for r in docs], model)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, very long texts and columns of clashing names."""
    words = " ".join(f"w{i}" for i in range(40))
    data = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, words + " more", "en", None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (None, words[::-1], None, "s", 5),
            (5, " ".join(f"v{i}" for i in range(30_000)), "en", "t", None), (5, " ".join(f"z{i}" for i in range(60)), "en", "t", None)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as kept", "'x' as copies", "2 as node")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # copies 1 and 2 are one; a repeated doc_id is one document; what has no words is rejected; a null id stays
    assert {r.doc_id for r in got} == {1, 5, None} and all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in got)
    assert sum(r.doc_id == 5 for r in got) == sum(r.doc_id == 1 for r in got) or {r.source for r in got} == {"s", "t"}
