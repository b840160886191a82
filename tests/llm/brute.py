"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = " \t\n\r\x0b\x0c"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def line_dedup(rows, min_docs=5, min_chars=40):
    """rows: (doc_id, text) -> [(doc_id, n_lines, n_dropped, text)]"""
    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= min_chars and d is not None:
                holders[key].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (d is not None and len(holders.get(k := lower(x.strip(SPACE)), ())) >= min_docs and max(holders[k]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def shingles(text):
    words = [lower(w) for w in WORD.findall(text or "")]
    if len(words) < 5:
        return Counter([tuple(words)]) if words else Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_classes(rows):
    """rows: (doc_id, text) -> {doc_id: class_id} by all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            a, b = sets[x], sets[y]
            same = sum((a & b).values())
            total = sum(a.values()) + sum(b.values()) - same
            if total == 0 or same >= 0.8 * total - 1e-9:
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return {d: root(d) for d in ids}


def place(doc_id, seed):
    return int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:15], 16)


def mix(rows, entropy_share=0.9, seed=17, steps=20, decimals=5):
    """rows: (doc_id, text, source) -> {doc_id: copies}"""
    tokens = [(d, s, len(WORD.findall(t or ""))) for d, t, s in rows]
    total = Counter()
    for _, s, n in tokens:
        total[s] += n
    held = {s: n for s, n in total.items() if n}
    p = {s: n / sum(held.values()) for s, n in held.items()}

    def entropy(a):
        z = sum(x**a for x in p.values())
        return -sum(x**a / z * math.log(x**a / z) for x in p.values())

    a, target = 1.0, entropy_share * math.log(len(p)) if p else 0
    if len(p) > 1 and entropy(1.0) < target:
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if entropy(mid) >= target else (lo, mid)
        a = lo
    a = round(a, decimals)
    scale = max((n / n**a for n in held.values()), default=0)
    out = {}
    for s in total:
        if not total[s]:
            out |= {d: 1 for d, x, _ in tokens if x == s}
            continue
        passes, rest = divmod(round(scale * total[s] ** a), total[s])
        before = 0
        for d, _, n in sorted((x for x in tokens if x[1] == s), key=lambda x: place(x[0], seed)):
            out[d] = passes + (before < rest)
            before += n
    return out


def quality_kept(text):
    """Whether the quality rules keep a text, from every window of words one by one."""
    from quadloom.llm import quality as Q

    base = quality(text)
    words = [w for w in WORD.findall(text or "")]
    n, letters = len(words), sum(len(w.encode()) for w in words)

    def share(places, size):
        inside = {i + j for i in places for j in range(size)}
        return sum(len(words[i].encode()) for i in inside) / max(1, letters)

    if base[5]:
        return False
    for size in {*Q.TOP_NGRAM_SHARE, *Q.DUP_NGRAM_SHARE}:
        at = defaultdict(list)
        for i in range(n - size + 1):
            at[tuple(words[i : i + size])].append(i)
        repeated = {g: places for g, places in at.items() if len(places) > 1}
        if not repeated:
            continue
        if size in Q.TOP_NGRAM_SHARE:
            shares = Q.TOP_NGRAM_SHARE[size]
            most = max(len(x) for x in repeated.values())
            # of several most frequent ones the first in the text
            top = min((x for x in repeated.values() if len(x) == most), key=lambda x: x[0])
            if share(top, size) > min(shares[1], max(shares[0], 2 * size / n)):
                return False
        if size in Q.DUP_NGRAM_SHARE:
            shares = Q.DUP_NGRAM_SHARE[size]
            if share([i for x in repeated.values() for i in x], size) > min(shares[1], max(shares[0], Q.LINE_WORDS / n)):
                return False
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    seen, again = set(), []
    for line in lines:
        if line in seen:
            again.append(line)
        seen.add(line)
    limit = lambda pair: pair[0] if len(again) >= 2 else pair[1]
    size = lambda xs: sum(len(x.encode()) for x in xs)
    return len(again) / max(1, len(lines)) <= limit(Q.DUP_LINE_SHARE) and size(again) / max(1, size(lines)) <= limit(Q.DUP_LINE_CHAR_SHARE)
