import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quadloom.llm import toxicity as T
from quadloom.llm.queries import op3_toxicity

PLAIN = ["you are an idiot", "stupid answer again", "what a moron", "this is trash"] * 30
CLEAN = ["the weather is fine today", "we answer every letter", "a train leaves at noon", "this is a table"] * 90


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(x,) for x in PLAIN + CLEAN], "text string")
    return T.LanguageModel(T.letter_counts(docs))


def test_letter_counts_are_of_all_texts(spark):
    docs = spark.createDataFrame([("ab",), (None,), ("",), ("AB é",)], "text string")
    counts = T.letter_counts(docs)
    edge, other = T._EDGE, T._OTHER
    at = lambda a, b, c: counts[(a * T._N + b) * T._N + c]
    assert at(edge, edge, 0) == 2 and at(edge, 0, 1) == 2 and at(0, 1, edge) == 2 and at(edge, other, edge) == 1  # one letter, though two bytes
    assert counts.sum() == len("  ab      AB é  ") - 2


@pytest.mark.parametrize(("token", "word"), [("1d10t", "idiot"), ("st*upid", "stupid"), ("stuuupid", "stupid"), ("m0r0n", "moron"), ("s-t-u-p-i-d", "stupid"), ("tr@sh", "trash"), ("trash", "trash")])
def test_restores(model, token, word):
    assert word in T.Restorer(model).token(token)


def test_letters_spelt_apart(model):
    assert "idiot" in T.Restorer(model).words("oh you i d i 0 t go")
    assert "stupid" in T.Restorer(model).words("S T U P I D")


RUN = "y o u a r e a s t u p i d i d i o t y o u a r e a m o r o n"


@pytest.mark.parametrize("text", [RUN, RUN.replace(" ", "."), RUN.replace(" ", "-"), RUN.replace("u p", "u  u u u u u  p").replace("  ", " ")])
def test_long_spelt_runs_are_cut_into_words(model, text):
    assert {"stupid", "idiot", "moron"} <= T.Restorer(model).words(text)


@pytest.mark.parametrize("text", ["y o u  i d i o t", "y o u\ni d i o t", "y-o-u--i-d-i-o-t", "y  o  u   i  d  i  o  t"])
def test_wider_gaps_are_word_limits(model, text):
    assert {"you", "idiot"} <= T.Restorer(model).words(text)
    assert T._lattice("a\nb")[1] == [(" ", 0.0)] and T._lattice("a--b-c", True)[1] == [(" ", T.SKIP_COST)]


def test_no_length_is_too_long(model):
    assert "stupid" in T.Restorer(model).words("st" + "u" * 5000 + "pid")
    assert "stupid" in T.Restorer(model).words("s" + "-" * 5000 + "tupid")
    assert len(T.restore("1d10t" * 20_000, model)) == 100_000


def test_doubled_letters(spark, model):
    texts = [*PLAIN, *["what an asshole"] * 30]
    labelled = [(x, 1) for x in texts] + [(x, 0) for x in CLEAN]
    learnt = T.fit(spark.createDataFrame(labelled, "text string, toxic int"), model)
    read = T.Restorer(model).words
    for text in ("iidiot", "stuupid", "mooron", "idioott", "aasshoole", "ashole", "stuupidest"):
        assert learnt.score(read(text)) >= T.THRESHOLD, text
    for text in ("letter", "noon", "a fine weather table"):
        assert learnt.score(read(text)) < T.THRESHOLD, text


def brute_restore(token, model):
    """The likeliest path by trying all."""
    paths = [((), 0.0)]
    for arcs in T._lattice(token):
        paths = [((*p, letters), c + extra) for p, c in paths for letters, extra in arcs]

    def cost(word):
        codes = [T._EDGE, T._EDGE, *T._codes(word), T._EDGE]
        return sum(model.cost[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    return min(c + cost("".join(p)) for p, c in paths), cost


@pytest.mark.parametrize("token", ["1d10t", "st*upid", "aa$$1|l", "w3++er", "7h15", "l00k!!"])
def test_viterbi_equals_all_paths(model, token):
    best, cost = brute_restore(token, model)
    word = T.restore(token, model)
    extras = [c + cost(word) for p, c in _paths(token) if "".join(p) == word]
    assert math.isclose(min(extras), best)


def _paths(token):
    out = [((), 0.0)]
    for arcs in T._lattice(token):
        out = [((*p, letters), c + extra) for p, c in out for letters, extra in arcs]
    return out


def test_scores(spark, model):
    labelled = [(x, 1) for x in PLAIN] + [(x, 0) for x in CLEAN] + [("x", None), (None, 0)]
    learnt = T.fit(spark.createDataFrame(labelled, "text string, toxic int"), model)
    data = [(1, "you absolute 1d10t"), (2, "a fine table"), (3, None), (4, ""), (5, "fine " * 60_000 + "m0r0n"), (1, "MORON")]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumns({"score": F.lit("old"), "x": F.lit(1)})
    out = T.score(frame, model, learnt).collect()
    flagged = {(r.doc_id, (r.text or "")[:5]) for r in out if r.score >= T.THRESHOLD}
    assert flagged == {(1, "you a"), (5, "fine "), (1, "MORON")} and all(0 <= r.score <= 1 and r.x == 1 for r in out)
    assert T.score(frame.limit(0), model, learnt).collect() == []


HIDDEN = ["ｉｄｉｏｔ", "іdіоt", "ѕtuріd", "id\u200biot", "𝐢𝐝𝐢𝐨𝐭", "i\u0301diot"]


@pytest.mark.parametrize("token", HIDDEN)
def test_letters_that_look_alike(model, token):
    assert {"idiot", "stupid"} & set(T.Restorer(model).token(token))
    assert T.Restorer(model).token("погода") == ("погода",) and T.Restorer(model).token("größe") == ("größe",)


def test_scorer_equals_the_model(model):
    """Gathering only words with a weight changes no score."""
    learnt = T.ToxicityModel({"idiot": 2.0, "=stupid": 1.5, "moron*": 1.0, T.named("x" * 90): 3.0, "ass": 0.5}, -1.0, 0.7)
    scorer, restorer = T.Scorer(T.Restorer(model), learnt), T.Restorer(model)
    texts = [*HIDDEN, *PLAIN[:4], *CLEAN[:4], RUN, "", "stuupid!! (idiot) 1d10t, morons'", "x" * 90, "x" * 91, "aass ass a ss", "y o u\ni d i o t", "é ö å 12 3"]
    for text in texts * 2:
        assert scorer.score(text) == learnt.score(restorer.words(text)), text
    assert scorer.score("x" * 90) > scorer.score("x" * 91)


def plain_weights(rows, toxic, clean, tried):
    """rows: (features, toxic): the weight of each feature that points to toxic texts."""
    out = {}
    for f in {f for fs, y in rows if y for f in fs}:
        n, no = (sum(f in fs for fs, y in rows if y == side) for side in (1, 0))
        share, p = toxic / (toxic + clean), n / (n + no) if n + no else 0
        if n >= T.MIN_TEXTS and n / toxic >= T.MIN_RATIO * (no + 0.5) / clean:
            tail = n * math.log(p / share) + (no * math.log((1 - p) / (1 - share)) if no else 0)
            if tail > math.log(tried / T.CHANCE):
                out[f] = math.log(((n + 0.5) / (toxic + 1)) / ((no + 0.5) / (clean + 1)))
    return out


def test_fit_and_score_equal_brute_force(spark, model):
    """Features counted one by one; the regression held to its optimum; evidence summed word by word."""
    rng = random.Random(1)
    bad, good = ["idiot", "stuupid", "moron", "tr@sh", "1diot"], "weather train letter table noon answer fine leaves coffee garden".split()
    data = [(" ".join([*rng.choices(good, k=12), f"n{i}", *(rng.sample(bad, 2) if i % 4 == 0 and rng.random() < 0.9 else [])]), int(i % 4 == 0)) for i in range(240)]
    data += [data[0]] * 5 + [(None, 0), ("idiot", 0), ("stupid", 0)]
    frame = spark.createDataFrame(data, "text string, toxic int")
    learnt = T.fit(frame, model)
    half = {r.text: r.h for r in frame.selectExpr("text", "cast(pmod(xxhash64(coalesce(text, ''), 1), 2) as int) h").collect()}
    words = lambda t: T.Restorer(model).words(t or "")
    rows = [(T.features(words(t)), y, half[t]) for t, y in data]
    tried = len({f for fs, y, _ in rows if y for f in fs})
    of = lambda h: [(fs, y) for fs, y, side in rows if h is None or side == h]
    likely = lambda f: (n := sum(f in fs for fs, y, _ in rows if y)) >= T.MIN_TEXTS and n / sum(y for _, y, _ in rows) >= 0.5 * T.MIN_RATIO * (sum(f in fs for fs, y, _ in rows if not y) + 0.5) / sum(1 - y for _, y, _ in rows)
    weights = lambda h: {f: w for f, w in every(h).items() if likely(f)}
    every = lambda h: plain_weights(of(h), sum(y for _, y in of(h)), sum(1 - y for _, y in of(h)), tried)
    want = weights(None)
    assert want and learnt.held.keys() == want.keys() and all(math.isclose(learnt.held[f], want[f]) for f in want)
    evidence = lambda t, w: sum(max([0.0, *(w[f] for f in map(T.named, T.looked_up(x)) if f in w)]) for x in words(t))
    halves = [weights(0), weights(1)]
    x = [(evidence(t, halves[1 - half[t]]), y) for t, y in data]
    base = (sum(y for _, y in x) + 0.5) / (len(x) + 1)
    slope = [-1e-2 * (learnt.bias - math.log(base / (1 - base))), -1e-2 * (learnt.slope - 1)]
    for e, y in x:
        p = 1 / (1 + math.exp(-learnt.bias - learnt.slope * e))
        slope[0], slope[1] = slope[0] + y - p, slope[1] + (y - p) * e
    assert abs(slope[0]) < 1e-6 and abs(slope[1]) < 1e-6
    for r in T.score(frame, model, learnt).collect():
        assert math.isclose(r.score, 1 / (1 + math.exp(-learnt.bias - learnt.slope * evidence(r.text, want))))


def test_the_sample_is_a_bound(spark, model):
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = T.sample_labels(labels, 20).collect()
    assert len(got) == 20 == len({r.doc_id for r in got}) and all(r.toxic == r.doc_id % 2 for r in got)
    assert T.sample_labels(labels).count() == 50


def test_nothing_to_learn_from(spark, model):
    empty = spark.createDataFrame([], "text string, toxic int")
    for rows in (empty, spark.createDataFrame([("a", 0)], "text string, toxic int"), spark.createDataFrame([("a", 1)], "text string, toxic int")):
        assert 0 < T.fit(rows, model).score({"a"}) < 1


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.75 and hit / sum(r.predicted for r in rows) > 0.8
