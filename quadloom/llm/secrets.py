"""Secret scans with dictionary-primed zstandard novelty.

Base spans are matches of three patterns. The method adds spans: a candidate
is a string of ``MIN_CHARS`` or more letters, digits and ``+/_=-`` in a
sensitive context: a word such as key, credential or bearer begins within
``REACH`` characters before it, or the candidate is in a key block that such a word begins.
Its novelty is the number of bytes that it adds to a zstandard frame of the
text around it, primed with dictionaries: code, the language's own identifiers
and words. What ordinary names or near text explain adds little, a random string adds nearly
its entropy. Candidates whose added bits a character reach ``MIN_BITS`` are reported
as ``novel``, unless a base span overlaps them. Letters of one case, as words are, need
``ONE_CASE_BITS`` and ``ONE_CASE_CHARS`` characters. In shorter strings a frame tells
a random one from a new name by little; they need ``SHORT_BITS``, and digits, small
and capital letters that change places at half of their characters or more.

Places are code points, ends exclusive. Defined results: null text is empty;
rows are judged one by one and other columns are kept.
"""

from __future__ import annotations

import bisect
import builtins
import keyword
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quadloom.llm.pieces import slices
from quadloom.llm.workspace import mapped

KINDS = ["assign", "access", "hex", "novel"]
#: Fixed patterns of the base spans and the least length of what they find.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

#: Words that make what follows sensitive, and how far they reach.
_CONTEXT_WORDS = ("key", "credential", "passphrase", "passcode", "bearer", "auth", "signature", "private", "secret", "token", "password", "pwd")
_CONTEXT = re.compile("|".join(_CONTEXT_WORDS), re.IGNORECASE | re.ASCII)
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*(?:PRIVATE|SECRET|KEY)[A-Z0-9 ]*-----.*?(?:-----END|\Z)", re.DOTALL)
_MIXED = re.compile("[0-9]|[a-z][A-Z]|[A-Z][A-Z][a-z]")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")  # MIN_CHARS
MIN_CHARS, ONE_CASE_CHARS, REACH, AROUND = 12, 16, 40, 256
MIN_BITS, ONE_CASE_BITS, SHORT_BITS = 3.2, 7.5, 7.2

#: Identifiers and code that prime the compressor. Fixed values.
IDENTIFIERS = """
import os import sys from typing import Any Optional def __init__(self): return None class public static void main(String[] args)
private final int getValue setValue getName setName toString hashCode equals isEmpty length size append insert remove update delete
const let var function async await export default require module exports console.log document.getElementById addEventListener
http://www.example.com/ https://github.com/ localhost 127.0.0.1 Authorization: Bearer Content-Type: application/json charset=utf-8
API_KEY SECRET_KEY ACCESS_KEY PRIVATE_KEY PUBLIC_KEY CLIENT_ID CLIENT_SECRET DATABASE_URL PASSWORD USERNAME TOKEN AUTH_TOKEN
your_api_key_here your-secret-key changeme placeholder example_password xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef
application configuration environment production development testing staging connection database server client request response
message exception error warning debug info logger handler controller service repository factory builder manager provider interface
implementation abstract override virtual template namespace include define struct union typedef unsigned double float boolean integer
string number object array list dictionary mapping iterator generator primary_key foreign_key keyboard key_value keyword author authority
authentication authorization signature_algorithm private_method password_reset_token token_count tokenizer tokenization secretary
internationalization characteristically telecommunications counterrevolutionary electroencephalogram disproportionately
institutionalization responsibilities enthusiastically incomprehensibility straightforwardness multidimensional establishment
misunderstandings acknowledgements representatives commercialization environmentally unconditionally psychological physiologically
philosophical mathematically circumstances transformation consideration recommendations approximately extraordinarily simultaneously
manufacturing administrative interdisciplinary notwithstanding experimentation superintendent microorganisms photosynthesis
"""


def identifiers() -> str:
    """Names that the language defines: key words, built-in functions and their methods, modules."""
    names = {*keyword.kwlist, *dir(builtins), *(m for kind in (str, bytes, dict, list, set, int, float) for m in dir(kind)), *sys.stdlib_module_names}
    return " ".join(sorted(names))


class Novelty:
    """Marginal compressed bytes under a primed compressor."""

    def __init__(self):
        import zstandard

        primer = zstandard.ZstdCompressionDict(f"{identifiers()}\n{IDENTIFIERS}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primer.precompute_compress(level=9)
        self.pack = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False).compress

    def bits(self, before: str, candidate: str, after: str) -> float:
        """Bits a character that the candidate adds to what stands around it, copies of itself left out."""
        around = (before + "\n" + after).replace(candidate, "").encode()
        return 8 * (len(self.pack(around + b"\n" + candidate.encode())) - len(self.pack(around + b"\n"))) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans (by start) cover: apart and ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in spans:
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(covered: tuple[list[int], list[int]], a: int, b: int) -> bool:
    starts, ends = covered
    i = bisect.bisect_right(ends, a)  # the first that ends behind a
    return i < len(starts) and starts[i] < b


def needed_bits(candidate: str) -> float:
    """The novelty that makes a candidate a secret; no novelty makes short letters of one case one."""
    if not _MIXED.search(candidate):
        return ONE_CASE_BITS if len(candidate) >= ONE_CASE_CHARS else float("inf")
    if len(candidate) >= ONE_CASE_CHARS:
        return MIN_BITS
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else c if not c.isalpha() else "l" for c in candidate]
    changes = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
    return SHORT_BITS if 2 * changes >= len(candidate) else float("inf")


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    low = text.lower()
    if not any(w in low for w in _CONTEXT_WORDS):
        return []
    known = _merged([(a, b) for a, b, _ in base])
    blocks = _merged([m.span() for m in _BLOCK.finditer(text)] if "-----BEGIN" in text else [])
    out = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if _meets(known, a, b) or not (_CONTEXT.search(text, max(0, a - REACH), a) or _meets(blocks, a, a + 1)):
            continue
        if (needed := needed_bits(m[0])) < float("inf") and novelty.bits(text[max(0, a - AROUND) : a], m[0], text[b : b + AROUND]) >= needed:
            out.append((a, b, "novel"))
    return out


_SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs with ``secrets``: spans by start, then kind as listed in KINDS."""
    names = [c for c in docs.columns if c != "secrets"]
    rows = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    at = names.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for part in (part for batch in batches for part in slices(batch, at)):
            out = []
            for text in part.column(at).to_pylist():
                text = text or ""
                found = base_spans(text)
                found = sorted([*found, *novel_spans(text, found, novelty)], key=lambda x: (x[0], KINDS.index(x[2])))
                out.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], [*names, "secrets"])

    return mapped(rows, run, StructType([*rows.schema.fields, StructField("secrets", _SPANS)]))
