import base64

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from quadloom.llm import token_counts as T
from quadloom.llm.queries import PIECE_MODEL, RANKS, op9_token_counts, tokenizer_file
from quadloom.llm.workspace import new_path

SCHEMA = "doc_id long, text string, source string, lang string, op string, seq long"


def words():
    return lambda texts: np.array([len(x.split()) for x in texts], np.int64)


def letters():
    return lambda texts: np.array([len(x) for x in texts], np.int64)


def totals(ledger):
    return sorted(((r.source, r.lang, r.tokenizer, r.n_docs, r.n_tokens, r.n_chars) for r in ledger.totals().collect()), key=str)


def test_signed_batches(spark):
    ledger = T.TokenLedger(spark, new_path(spark, "ledger"), {"words": words, "letters": letters})
    assert totals(ledger) == []
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    first = rows((1, "a b", "s", "en", "insert", 0), (2, None, "s", "en", "insert", 0), (3, "x y z", None, None, "insert", 0), (None, "lost", "s", "en", "insert", 0))
    assert ledger.commit("one", first) and not ledger.commit("one", first)
    start = totals(ledger)
    assert start == sorted([("s", "en", "words", 2, 2, 3), ("s", "en", "letters", 2, 3, 3), (None, None, "words", 1, 3, 5), (None, None, "letters", 1, 5, 5)], key=str)
    change = rows((1, "a b c", "t", "de", "revise", 1), (1, "old", "t", "de", "revise", 0), (3, None, None, None, "delete", 0), (77, None, None, None, "delete", 0))
    assert ledger.commit("two", change)
    assert totals(ledger) == sorted([("s", "en", "words", 1, 0, 0), ("s", "en", "letters", 1, 0, 0), ("t", "de", "words", 1, 3, 5), ("t", "de", "letters", 1, 5, 5)], key=str)
    assert ledger.commit("three", rows((1, "a b", "s", "en", "revise", 0), (3, "x y z", None, None, "insert", 0)))
    assert totals(ledger) == start
    assert ledger.commit("none", first.limit(0)) and totals(ledger) == start


def test_a_batch_that_broke_off_does_not_count(spark):
    ledger = T.TokenLedger(spark, new_path(spark, "ledger"), {"words": words})
    rows = spark.createDataFrame([(1, "a b", "s", "en", "insert", 0)], SCHEMA)
    ledger.commit("one", rows)
    fs, where = ledger._fs(f"{ledger.path}/log/{0:012d}")
    fs.delete(where, True)  # as if the run had died before its entry
    assert totals(ledger) == [] and ledger.committed() == []
    ledger.commit("one", rows)
    assert totals(ledger) == [("s", "en", "words", 1, 2, 3)]


def test_a_commit_that_comes_second_is_made_anew(spark, monkeypatch):
    path = new_path(spark, "ledger")
    one, two = (T.TokenLedger(spark, path, {"words": words}, buckets=2) for _ in range(2))
    rows = lambda text: spark.createDataFrame([(1, text, "s", "en", "insert", 0)], SCHEMA)
    write = one._write

    def late(signed, attempt):  # another writer's commit falls between reading and logging
        write(signed, attempt)
        two.commit("two", rows("a b c"))

    monkeypatch.setattr(one, "_write", late)
    assert one.commit("one", rows("a"))
    assert one.committed() == ["two", "one"] and totals(one) == [("s", "en", "words", 1, 1, 1)]


def test_ties_and_odd_ops(spark):
    ledger = T.TokenLedger(spark, new_path(spark, "ledger"), {"words": words}, buckets=2)
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    ledger.commit("one", rows((1, "x", "z", "en", "insert", 0), (1, "a b c d", "a", "en", "insert", 0), (2, "p q", "s", "en", None, None), (2, "p", "s", "en", "insert", 0), (3, "p", "s", "en", "upsert", 9)))
    assert totals(ledger) == [("a", "en", "words", 1, 4, 7), ("s", "en", "words", 1, 1, 1)]
    ledger.commit("two", rows((1, "gone", "s", "en", "unknown", 9), (2, "p q r", "s", "en", None, 1), (2, "p q r", "s", "en", None, 1)))
    assert totals(ledger) == [("a", "en", "words", 1, 4, 7), ("s", "en", "words", 1, 3, 5)]


def test_merged_batches(spark, monkeypatch):
    monkeypatch.setattr(T, "MERGE_AFTER", 2)
    ledger = T.TokenLedger(spark, new_path(spark, "ledger"), {"words": words}, buckets=2)
    for i in range(5):
        batch = spark.createDataFrame([(i, "a b", "s", "en", "insert", 0), (0, "a " * (i + 1), "s", "en", "revise", 1), (i - 2, None, None, None, "delete", 0)], SCHEMA)
        assert ledger.commit(f"b{i}", batch) and not ledger.commit("b0", batch)
    assert ledger.committed() == [f"b{i}" for i in range(5)] and len(ledger._log()) < 4
    assert totals(ledger) == [("s", "en", "words", 3, 9, 16)]
    assert sorted((r.doc_id, r.n_tokens) for r in ledger.documents().collect()) == [(0, 5), (3, 2), (4, 2)]


def test_query_equals_brute_force(spark, tmp_path):
    import sentencepiece

    data = [(i, f"line {i % 7}\nline {i % 7}\nlast é", f"s{i % 2}", "en") for i in range(40)] + [(90, None, None, None), (91, "", "s0", "de"), (92, "", "s0", "de"), (None, "x", "s0", "en"), (3, "line 3\nline 3\nlast é", "s1", "en")]
    spark.createDataFrame(data, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    held, firsts = {}, {}
    for d, t, s, lang in sorted((x for x in data if x[0] is not None), key=lambda x: x[0]):
        if t is None or firsts.setdefault(t, d) == d:
            held[d] = ("\n".join(dict.fromkeys((t or "").split("\n"))), s, lang)
    want = {}
    for t, s, lang in held.values():
        for name, n in (("piece_bpe_32k", len(piece.encode(t))), ("byte_bpe_50k", len(bpe.encode_ordinary(t)))):
            old = want.get((s, lang, name), (0, 0, 0))
            want[s, lang, name] = (old[0] + 1, old[1] + n, old[2] + len(t))
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in op9_token_counts(spark, str(tmp_path)).collect()}
    assert got == want


def test_counters_equal_the_libraries(spark):
    import sentencepiece

    texts = ["", "hello  world", "é 😀\n" * 50, "x" * 3000]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))
    assert T.piece_counter(tokenizer_file(PIECE_MODEL))()(texts).tolist() == [len(x) for x in model.encode(texts)]
    counted = T.rank_counter(tokenizer_file(RANKS), public_tokenizers.PATTERN)()(texts)
    assert counted[0] == 0 and counted[1] == 3 and (counted > 0).sum() == 3
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_chars", F.lit(-1))
    got = T.count_tokens(frame, {"w": words}, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_tokens_0, r.n_chars) for r in got] == [(len(t.split()), len(t)) for t in texts]
