"""Toxicity with noisy-channel deobfuscation.

1. ``letter_counts`` counts letter trigrams over all documents, in lower case:
   a character language model, one row of sums a task and one sum at the end.
2. A word that holds digits, symbols, letters thrice or more in a row or letters spelt apart
   is restored: a lattice gives every character the letters it may stand for
   (leetspeak), lets a run of one letter shrink to two or one, and lets symbols between
   letters stand for nothing. Viterbi finds the likeliest path under the
   language model and the channel's costs. Plain words are their own path.
   Tokens of any length are decoded, as the cost is linear in it. In letters
   spelt apart, by spaces or by separators, a gap may also stand for a space,
   and one that is wider than the run's least gap always does.
3. ``fit`` learns from labelled rows which words and word beginnings point to
   toxic texts: those held by so many more toxic than other texts that chance
   would give as many in one of 1 / ``CHANCE`` fits, all features tried. A
   feature's weight is its log-likelihood ratio, a text's evidence the sum of
   its words' weights, each word by its best feature, those that its letters
   without doubling have included ('stuupid', 'iidiot'). Logistic regression turns
   evidence into a score; for it, each half of the rows has the evidence of
   the other half's features, so luck in their choice does not count.
   ``sample_labels`` draws at most ``SAMPLE`` labelled rows, so what fitting
   holds is bounded by that parameter; ``fit`` merges rows of one text and label.
4. A text's score is the regression's for the evidence of its restored words.

Letters of other scripts that look like Latin ones are read as either; wide and
other compatible forms of letters count as the letters; marks of no width as separators.

Lang, source and doc_id are no inputs. Defined results: null text is empty; an
empty text has no evidence and so the score of none; texts are
scored one by one and whole; with no toxic or no other labelled row every
score is the share of toxic rows. Of labels that repeat a doc_id the toxic one
holds; documents that repeat a labelled doc_id are learnt from, each.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.pieces import slices
from quadloom.llm.workspace import mapped, materialize

SAMPLE = 40_000
#: Tokens that a worker keeps: those without weight, and those with one or that were decoded.
DULL_TOKENS, KEPT_TOKENS = 200_000, 100_000
#: Longer features go by a digest, so a feature is never longer than this.
FEATURE_CHARS = 64
#: Word beginnings that are features, by length.
PREFIXES = (5, 6, 7)
MIN_TEXTS, MIN_RATIO, CHANCE = 4, 12.0, 0.1
THRESHOLD = 0.3

#: What a character may stand for, besides itself. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
#: Letters of other scripts and the Latin ones that they look like. Fixed values.
ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "н": "h", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ſ": "s",
}
#: Symbols that may stand for nothing between letters; the last ones have no width.
SEPARATORS = ".-_*~^'`,:;/\\=+|#" + "\u00ad\u200b\u200c\u200d\u2060\ufeff"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Costs in nats: reading a sign as a letter, skipping a separator or another sign, shortening a run.
SIGN_COST, SKIP_COST, LOSS_COST, RUN_COST = 0.5, 0.3, 6.0, 0.5

#: By how much spaces in a run of letters spelt apart are favoured, one reading each.
SPACE_GAINS = (0.0, 1.0, 2.0, 3.0)

_N = len(ALPHABET) + 2  # letters, another letter, a word's edge
_OTHER, _EDGE = _N - 2, _N - 1
_CODE = {c: i for i, c in enumerate(ALPHABET)}
_RUNS = re.compile(r"(.)\1+")
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = "".join(re.escape(c) for c in LEET)
_ODD = re.compile(rf"[{_SIGNS}]|([^\W\d_])\1\1|[^\W\d_][{re.escape(SEPARATORS)}]+[^\W\d_]")
#: Marks in a run of letters spelt apart: what may be a space, and what is one.
GAP, LIMIT = " ", "\n"
_GAPS = re.compile("|".join(f"{re.escape(c)}+" for c in SEPARATORS if c not in LEET))
_SPELT = re.compile(rf"(?<![^\W_])(?:[^\W_][{re.escape(SEPARATORS)}]+){{3}}")
_ALIKE = re.compile(f"[{''.join(ALIKE)}]")
#: Forms of letters that compatibility folding turns into plain ones, and marks that combine.
_FORMS = re.compile("[\u2100-\u214f\u2460-\u24ff\uff00-\uffef\U0001d400-\U0001d7ff\U0001f130-\U0001f189]")
_MARKS = re.compile("[\u0300-\u036f]+")
#: What no plain word holds, and signs around one that stand for no letter.
_SPECIAL = re.compile(f"{_FORMS.pattern}|{_ALIKE.pattern}")
_TRIPLE = re.compile(r"(.)\1\1")
_AROUND = "".join(c for c in "\"'.,:;?)[]{}-" if c not in LEET)
_SPACES = np.array([chr(i).isspace() for i in range(0x3002)])
_APART = re.compile(rf"(?<![^\s])[^\W\d_{_SIGNS}]?[{_SIGNS}]?(?:[\s]+[^\W\d_]|[\s]+[{_SIGNS}]){{2,}}(?![^\s])")


def _codes(word: str) -> list[int]:
    return [_CODE.get(c, _OTHER) for c in word]


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Trigrams of the words of all texts, with edges: an array of _N ** 3 counts. A letter beyond a-z is one _OTHER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array([_OTHER if chr(i).isalpha() else _EDGE for i in range(0x10000)], np.int64)
        for c, i in _CODE.items():
            table[ord(c)] = table[ord(c.upper())] = i
        total = np.zeros(_N**3, np.int64)
        for part in (part for batch in batches for part in slices(batch, 0)):
            joined = "  ".join(["", *(x or "" for x in part.column(0).to_pylist()), ""])
            at = table[np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
            total += np.bincount((at[:-2] * _N + at[1:-1]) * _N + at[2:], minlength=_N**3)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    out = np.zeros(_N**3)
    for row in mapped(rows, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # _N ** 3 rows at most
        out[row.gram] = row.n
    return out


class LanguageModel:
    """Letter trigrams, interpolated with bigrams and single letters; costs are negative logarithms."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(_N, _N, _N)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        uni = (uni + 1) / (uni.sum() + _N)
        bi = (bi + 5 * uni) / (bi.sum(1, keepdims=True) + 5)
        tri = (tri + 5 * bi[None]) / (tri.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(tri)).tolist()

    def of(self, word: str) -> float:
        """The cost of a word, edges included, a letter."""
        codes = [_EDGE, _EDGE, *_codes(word), _EDGE]
        return sum(self.cost[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)) / (len(word) + 1)


def _lattice(token: str, spaced: bool = False, gain: float = 0.0) -> list[list[tuple[str, float]]]:
    """For each run of a character: the strings that it may stand for and their costs.

    With ``spaced`` a gap may be a space: a separator, GAP or LIMIT. One that is wider than the least is nothing else.
    """
    out = []
    least = min((len(x) for x in _GAPS.findall(token)), default=0) if spaced else 0
    for run in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = run[1], len(run[0])
        arcs: list[tuple[str, float]] = []
        if c == GAP or c == LIMIT:
            out.append([(" ", 0.0)] if c == LIMIT else [("", 0.0), (" ", -gain)] if spaced else [("", 0.0)])
            continue
        if spaced and c in SEPARATORS and c not in LEET:
            out.append([(" ", SKIP_COST)] if n > least else [("", SKIP_COST), (" ", SKIP_COST - gain)])
            continue
        if c.isalpha():
            arcs += [(c, 0.0)] if n == 1 else [(c * 2, RUN_COST * (n > 2)), (c, RUN_COST)]
        for letter in LEET.get(c) or ALIKE.get(c, ""):
            arcs += [(letter, SIGN_COST)] if n == 1 else [(letter * 2, SIGN_COST + RUN_COST * (n > 2)), (letter, SIGN_COST + RUN_COST)]
        if c in SEPARATORS or not arcs:
            arcs.append(("", SKIP_COST if c in SEPARATORS else LOSS_COST))
        elif c in LEET:
            arcs.append(("", LOSS_COST))
        out.append(arcs)
    return out


def restore(token: str, model: LanguageModel, spaced: bool = False, gain: float = 0.0) -> str:
    """The likeliest word behind a token, by Viterbi over its lattice; words, if gaps may be spaces."""
    cost = model.cost
    best: dict[tuple[int, int], tuple[float, tuple]] = {(_EDGE, _EDGE): (0.0, ())}
    for arcs in _lattice(token, spaced, gain):
        now: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (so_far, path) in best.items():
            for letters, extra in arcs:
                x, y, total = a, b, so_far + extra
                if letters == " " and b == _EDGE:
                    letters = ""  # a space already
                for c in letters:
                    z = _EDGE if c == " " else _CODE.get(c, _OTHER)
                    total += cost[x][y][z]
                    x, y = y, z
                if (x, y) not in now or total < now[x, y][0]:
                    now[x, y] = (total, (path, letters) if letters else path)
        best = now
    path = min(((total + (cost[a][b][_EDGE] if b != _EDGE or not path else 0.0), path) for (a, b), (total, path) in best.items()), key=lambda x: x[0])[1]
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def cut(token: str, model: LanguageModel) -> list[str]:
    """The words of a run of letters, for each of SPACE_GAINS: letter trigrams alone do not tell every limit."""
    return [w for gain in SPACE_GAINS for w in restore(token, model, True, gain).split()]


#: Longer tokens are not kept, as they would fill the memory; they are decoded like others.
KEPT_CHARS = 64


def is_odd(token: str) -> bool:
    """Whether a token may hide a word."""
    if _ODD.search(token):
        return True
    # a letter that looks like a Latin one, among Latin letters or such letters alone
    return not token.isascii() and bool(_ALIKE.search(token)) and all(c in ALIKE or c.isascii() for c in token if c.isalpha())


class Restorer:
    """Words of a text, restored; tokens met before are kept, up to a bound."""

    def __init__(self, model: LanguageModel, most: int = KEPT_TOKENS):
        self.model, self.most, self.kept = model, most, {}

    def token(self, token: str) -> tuple[str, ...]:
        found = self.kept.get(token)
        if found is None:
            found = self.read(token)
            self._keep(token, found)
        return found

    def read(self, token: str) -> tuple[str, ...]:
        """The words that a token may stand for, as it stands and restored."""
        plain = tuple(_WORD.findall(token))
        if not token.isascii() and (_FORMS.search(token) or _MARKS.search(token)):
            folded = unicodedata.normalize("NFKC", _MARKS.sub("", token)).lower()
            if folded != token:
                parts = [w for x in folded.split() for w in self.read(x)]
                return tuple(dict.fromkeys([*plain, *parts]))
        if not is_odd(token):
            return plain
        bare = token.strip("\"'.,:;?()[]{}")
        word = restore(bare, self.model)
        apart = cut(bare, self.model) if _SPELT.search(bare) else ()
        return tuple(x for x in dict.fromkeys([*plain, word, single(word), *apart, *map(single, apart)]) if x)

    def spelt(self, run: str) -> tuple[str, ...]:
        """Words of letters that stand apart: each part between wider gaps as one word, and as cut into words."""
        found = self.kept.get(run)
        if found is None:
            gaps = re.findall(r"\s+", run)
            least = min(map(_width, gaps))
            marked = re.sub(r"\s+", lambda m: LIMIT if _width(m[0]) > least else GAP, run)
            whole = [restore(x, self.model) for x in marked.split(LIMIT)]
            apart = cut(marked, self.model)
            found = tuple(x for x in dict.fromkeys([*whole, *map(single, whole), *apart, *map(single, apart)]) if x)
            self._keep(run, found)
        return found

    def _keep(self, token: str, found: tuple[str, ...]) -> None:
        if len(token) <= KEPT_CHARS:
            if len(self.kept) >= self.most:
                self.kept.clear()
            self.kept[token] = found

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out: set[str] = set()
        for token in set(low.split()):
            out.update(self.token(token))
        for run in spelt_runs(low):
            out.update(self.spelt(run))
        return out


def spelt_runs(low: str) -> list[str]:
    """Runs of letters spelt apart. They have two neighbouring tokens of one character, which few texts have."""
    if len(low) > 2:
        space = _SPACES[np.minimum(np.frombuffer(f" {low} ".encode("utf-32-le", "surrogatepass"), np.uint32), 0x3001)]
        alone = np.flatnonzero(space[:-2] & ~space[1:-1] & space[2:])
        if len(alone) > 1:
            number = np.cumsum(space[:-2] & ~space[1:-1])[alone]
            if (np.diff(number) == 1).any():
                return [x[0].strip() for x in _APART.finditer(low)]
    return []


def _width(gap: str) -> tuple[bool, int]:
    return "\n" in gap, len(gap)


def single(word: str) -> str:
    """A word without doubled letters."""
    return _RUNS.sub(r"\1", word)


def named(feature: str) -> str:
    """A feature's name: itself, or a digest of a long one."""
    return feature if len(feature) <= FEATURE_CHARS else f"#{xxhash.xxh3_128_hexdigest(feature.encode('utf-8', 'surrogatepass'))}"


def features(words: set[str]) -> set[str]:
    """Words and beginnings (*); of those with doubled letters, also what is left without (=)."""
    out = {w for w in words if len(w) > 2}
    singles = {s for w in out if _RUNS.search(w) and len(s := single(w)) > 2}
    out.update([f"{w[:n]}*" for w in words for n in PREFIXES if len(w) >= n])
    out.update(f"={s}" for s in singles)
    out.update(f"={s[:n]}*" for s in singles for n in PREFIXES if len(s) >= n)
    return set(map(named, out))


def looked_up(word: str) -> list[str]:
    """The features that point to a word; with doubled letters, also those of its letters without (=* counts such words alone)."""
    beginnings = lambda w, mark="": [f"{mark}{w[:n]}*" for n in PREFIXES if len(w) >= n]
    out = [word, f"={word}", *beginnings(word)]
    s = single(word)
    return out if s == word else [*out, s, f"={s}", *beginnings(s), *beginnings(s, "=")]


class ToxicityModel:
    """Features with their weights, and the regression from evidence to score."""

    def __init__(self, held: dict[str, float], bias: float = 0.0, slope: float = 1.0):
        self.held, self.bias, self.slope = held, bias, slope
        # every feature that may point to a word begins, without doubled letters, as the word does
        self.heads = {single(f.strip("=*"))[:3] for f in held if not f.startswith("#")}
        self.has_long = any(f.startswith("#") for f in held)

    def word(self, word: str) -> float:
        """What a word's best feature weighs; 0 if nothing points to it."""
        head = word[:3]
        if len(head) == 3 and head not in self.heads and head[0] != head[1] != head[2] and not (self.has_long and len(word) >= FEATURE_CHARS):
            return 0.0
        held = self.held
        return max(0.0, *(held.get(named(name), 0.0) for name in looked_up(word)))

    def evidence(self, words: set[str]) -> float:
        return sum(sorted(x for x in map(self.word, words) if x))

    def of_evidence(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.bias + self.slope * evidence))))

    def score(self, words: set[str]) -> float:
        return self.of_evidence(self.evidence(words))


class Scorer:
    """Scores of texts: as the model's for a text's words, but only words with a weight are gathered."""

    def __init__(self, restorer: Restorer, model: ToxicityModel):
        self.restorer, self.model = restorer, model
        self.dull: set[str] = set()
        self.weighty: dict[str, dict[str, float]] = {}

    def _weights(self, token: str) -> dict[str, float]:
        bare = token.strip(_AROUND)
        if bare.isalpha() and not _TRIPLE.search(bare) and (bare.isascii() or not _SPECIAL.search(bare)):  # as most are: a plain word
            return {bare: x} if (x := self.model.word(bare)) else {}
        return {w: x for w in self.restorer.read(token) if (x := self.model.word(w))}

    def score(self, text: str) -> float:
        low = text.lower()
        found: dict[str, float] = {}
        for token in set(low.split()).difference(self.dull):
            weights = self.weighty.get(token)
            if weights is None:
                weights = self._weights(token)
                if len(token) <= KEPT_CHARS:
                    if not weights:
                        if len(self.dull) >= DULL_TOKENS:
                            self.dull.clear()
                        self.dull.add(token)
                    else:
                        if len(self.weighty) >= KEPT_TOKENS:
                            self.weighty.clear()
                        self.weighty[token] = weights
            found.update(weights)
        for run in spelt_runs(low):
            found.update({w: x for w in self.restorer.spelt(run) if (x := self.model.word(w))})
        return self.model.of_evidence(sum(sorted(found.values())))


def _weight(n: Column, no: Column, toxic: int, clean: int, tried: int) -> Column:
    """A feature's weight by its toxic and other holders, or null if it does not point to toxic texts."""
    if not clean or not toxic:
        return F.lit(None).cast("double")
    share = toxic / (toxic + clean)
    p = n / (n + no)
    # the tail of the binomial, bounded by its exponent
    tail = n * F.log(p / F.lit(share)) + F.when(no > 0, no * F.log((1 - p) / F.lit(1 - share))).otherwise(0.0)
    often = (n >= MIN_TEXTS) & (n / F.lit(toxic) >= MIN_RATIO * (no + 0.5) / F.lit(clean))
    weight = F.log((n + 0.5) / F.lit(toxic + 1) * F.lit(clean + 1) / (no + 0.5))
    return F.when(often & (tail > F.lit(math.log(max(1, tried) / CHANCE))), weight)


def _restored(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(words, toxic, half, times) of labelled texts, written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            words = [sorted(restorer.words(x or "")) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), *batch.columns[1:]], ["words", "toxic", "half", "times"])

    return materialize(mapped(rows, run, "words array<string>, toxic int, half int, times long"), "restored")


def _feature_counts(held: DataFrame) -> DataFrame:
    """(feature, y0, y1, n0, n1): how many toxic and other texts of each half hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for words, toxic, half, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for f in features(set(words)):
                    counts.setdefault(f, [0, 0, 0, 0])[2 * (1 - toxic) + half] += times
            columns = [pa.array([x[i] for x in counts.values()], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *columns], ["feature", "y0", "y1", "n0", "n1"])

    names = ["y0", "y1", "n0", "n1"]
    return mapped(held, run, "feature string, y0 long, y1 long, n0 long, n1 long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in names))


def _evidence(held: DataFrame, models: list[ToxicityModel]) -> list[tuple[float, int, int]]:
    """(evidence, toxic, how often) by the model of the half that a row is not in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [models[1 - half].evidence(set(words)) for words, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1), batch.column(3)], ["evidence", "toxic", "times"])

    rows = mapped(held, run, "evidence double, toxic int, times long").groupBy("evidence", "toxic").agg(F.sum("times").alias("times"))
    return [(r.evidence, r.toxic, r.times) for r in rows.collect()]  # two numbers a row of the sample, at most


def sample_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` of labels (doc_id, toxic), one a doc_id, chosen by a hash: small enough to be sent everywhere."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(rows: DataFrame, model: LanguageModel, sample: int = SAMPLE) -> ToxicityModel:
    """rows: (text, toxic), labelled. About ``sample`` different texts of them at most are used, chosen by a hash of the text.

    Features are counted and chosen on the executors; those chosen come to the driver.
    """
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    mark = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 20))
    share = min(1.0, sample / max(1, rows.count()))
    half = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)), F.lit(2)).cast("int").alias("half")
    different = rows.where(mark < F.lit(int(share * (1 << 20)))).groupBy("text", "toxic").agg(F.count("*").alias("times"))
    held = _restored(different.select("text", "toxic", half, "times"), model)
    of = {(r.toxic, r.half): r.times for r in held.groupBy("toxic", "half").agg(F.sum("times").alias("times")).collect()}
    size = lambda toxic, *halves: sum(of.get((toxic, h), 0) for h in halves)
    toxic, clean = size(1, 0, 1), size(0, 0, 1)
    base = (toxic + 0.5) / (toxic + clean + 1)
    start = math.log(base / (1 - base))
    if not toxic or not clean:
        return ToxicityModel({}, start)
    counts = materialize(_feature_counts(held), "features")
    tried = counts.where("y0 + y1 > 0").count()
    # what the halves hold must be likely by the whole sample too
    y, n = F.col("y0") + F.col("y1"), F.col("n0") + F.col("n1")
    likely = counts.where((y >= MIN_TEXTS) & (y / F.lit(toxic) >= 0.5 * MIN_RATIO * (n + 0.5) / F.lit(clean)))
    weights = {
        "whole": _weight(y, n, toxic, clean, tried),
        "half0": _weight(F.col("y0"), F.col("n0"), size(1, 0), size(0, 0), tried),
        "half1": _weight(F.col("y1"), F.col("n1"), size(1, 1), size(0, 1), tried),
    }
    chosen = likely.select("feature", *(w.alias(c) for c, w in weights.items())).where("coalesce(whole, half0, half1) is not null").collect()
    of_model = lambda c: {r.feature: r[c] for r in chosen if r[c] is not None}
    if not of_model("whole"):
        return ToxicityModel({}, start)
    return ToxicityModel(of_model("whole"), *_regression(_evidence(held, [ToxicityModel(of_model(c)) for c in ("half0", "half1")]), start))


def _regression(rows: list[tuple[float, int, int]], start: float) -> tuple[float, float]:
    """Bias and slope of a logistic regression of toxic on evidence; rows: (evidence, toxic, how often)."""
    x, y, n = (np.array(c, float) for c in zip(*sorted(rows), strict=True))
    rows, w = np.stack([np.ones(len(x)), x], 1), np.array([start, 0.0])
    for _ in range(50):  # Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        curve = (rows * (n * p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, rows.T @ (n * (y - p)) - 1e-2 * (w - [start, 1.0]))
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(max(0.0, w[1]))


def score(docs: DataFrame, model: LanguageModel, toxicity: ToxicityModel) -> DataFrame:
    """docs with a score added (or replaced)."""
    names = [c for c in docs.columns if c != "score"]
    rows = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Restorer(model), toxicity)
        for part in (part for batch in batches for part in slices(batch, at)):
            scores = [scorer.score(x or "") for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*names, "score"])

    schema = rows.withColumn("score", F.lit(0.0)).schema
    return mapped(rows, run, schema)
