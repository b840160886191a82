import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.llm import quality as Q

from . import brute

TEXTS = ["", " ", "a b c", "w " * 30, "one two three four five six seven eight nine ten eleven", "é ü x y # * $ | <b> &", "line\nline\n\n \nline x\nLINE", "a b c d e f a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, "x" * 200_000]


def check(text):
    assert Q.measure(text.encode())[:6] == brute.quality(text)


def test_base_measures():
    for text in TEXTS:
        check(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "dé", "\n", " ", "#x"]), max_size=60))
def test_base_measures_of_any_text(words):
    check(" ".join(words))


def test_collisions_do_not_count(monkeypatch):
    monkeypatch.setattr(Q, "_ROLL", np.uint64(0))  # windows that end alike now share a hash
    for text in TEXTS[:8]:
        check(text)


def test_rows(spark):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (91, TEXTS[4]), (91, TEXTS[4])]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumns({"kept": F.lit("old"), "x": F.lit(1)})
    out = Q.quality_rules(frame).collect()
    assert len(out) == len(data) and {r.x for r in out} == {1}
    by = {r.doc_id: r for r in out}
    assert by[90].n_words == 0 and not by[90].kept and by[4].kept and not by[3].kept
    assert Q.quality_rules(frame.limit(0)).collect() == []


def test_repetition_below_the_base_limit_is_judged_too():
    words = [f"w{i}" for i in range(100)]
    repeated = " ".join(words[:50] + ["averyveryverylongrepeatedword again"] * 9 + words[50:])
    assert not Q.measure(repeated.encode())[-1]
    assert Q.measure(" ".join(words).encode())[-1]


def some(n, name="w"):
    return [f"{name}{i:03}" for i in range(n)]


PASSAGE = some(20, "p")
REPETITIVE = {
    "a passage twice": some(150) + PASSAGE + some(100, "v") + PASSAGE,
    "short passages": [x for i in range(6) for x in [*some(6, f"p{i % 3}"), *some(35, f"v{i}")]],
    "a pair of words": [x for i in range(40) for x in ["again", "always", *some(5, f"v{i}")]],
    "lines": [x for i in range(40) for x in ["\nhome\n", *some(8, f"v{i}")]],
}
CLEAN = {
    "no repetition": some(300),
    "a line at head and foot": [*PASSAGE[:9], "\n", *some(110), "\n", *PASSAGE[:9]],
    "a pair twice in a short text": "to be or not to be that is here the question".split(),
    "one of three lines twice": ["so\n", *some(30), "\nso"],
    "a passage twice in a long text": some(400) + PASSAGE + some(300, "v") + PASSAGE,
}


def test_cases_that_the_base_rule_leaves_open():
    for name, words in REPETITIVE.items():
        found = Q.measure(" ".join(words).replace(" \n", "\n").replace("\n ", "\n").encode())
        assert not found[5] and not found[-1], name
    for name, words in CLEAN.items():
        found = Q.measure(" ".join(words).replace(" \n", "\n").replace("\n ", "\n").encode())
        assert not found[5] and found[-1], name


def test_limits_lie_between_those_of_long_and_short_texts():
    assert [Q.limit((0.1, 0.2), 20, n) for n in (1, 100, 160, 200, 9000)] == [0.2, 0.2, 0.125, 0.1, 0.1]


def test_kept_equals_brute_force():
    texts = [*TEXTS, *(" ".join(w).replace(" \n", "\n").replace("\n ", "\n") for w in (*REPETITIVE.values(), *CLEAN.values()))]
    for text in texts[:8] + texts[9:]:
        assert Q.measure(text.encode())[-1] == brute.quality_kept(text), text[:80]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "cé", "d e f g h", "i j k l m n o p q r s t", "\n", "\nu v w x y z 1 2 3 4\n", *[f"w{i} x{i} y{i}" for i in range(12)]]), max_size=60))
def test_kept_of_any_text(words):
    text = " ".join(words)
    assert Q.measure(text.encode())[-1] == brute.quality_kept(text)


def test_kept_of_the_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        if len(r.text or "") < 30_000:
            assert Q.measure((r.text or "").encode())[-1] == brute.quality_kept(r.text or ""), r.doc_id
