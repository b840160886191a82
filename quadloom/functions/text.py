"""Folding: one form for index and query, without case and accents."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters that do not decompose. Fixed values.
TRANSLITERATED = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ð": "d", "þ": "th", "ł": "l", "đ": "d", "ħ": "h", "ŋ": "ng", "ı": "i", "ĸ": "k"}
_TABLE = str.maketrans(TRANSLITERATED)


def fold_text(text: str) -> str:
    """Lower case, transliterated, decomposed, without combining marks."""
    decomposed = unicodedata.normalize("NFKD", text.lower().translate(_TABLE))
    return "".join(c for c in decomposed if unicodedata.category(c) != "Mn")


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(fold_text, na_action="ignore")


#: Accented letters of western European languages and what folding makes of them; the rest is left to fold.
_ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūýÿñçšž"
_PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuyyncsz"
_ONE = {k: v for k, v in TRANSLITERATED.items() if len(v) == 1}
_TWO = {k: v for k, v in TRANSLITERATED.items() if len(v) > 1}
#: Texts of these letters alone need no Python; capitals whose small letter is more than one character are left out.
_WESTERN = "".join(sorted({x for k in (*_ACCENTED, *TRANSLITERATED) for x in (k, k.upper()) if len(x) == 1}))


def fold(text: Column) -> Column:
    """fold_text of a column. Western letters are folded in the JVM; only texts that still hold others go to Python."""
    other = ~_ascii(text) & ~text.rlike(rf"\A[\p{{ASCII}}{_WESTERN}]*+\z")
    # a null is passed by: the Python side sees no text of those that need it not; each text is folded on one side only
    return F.coalesce(_fold(F.when(other, text)), fold_western(text))


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def fold_western(text: Column) -> Column:
    """fold for texts in Latin-1 letters, in the JVM alone; other letters keep their accents. Texts without any are not searched for them."""
    out = F.lower(text)
    for letters, plain in _TWO.items():
        out = F.replace(out, F.lit(letters), F.lit(plain))
    # one pass for all letters: a pass costs as much for one
    return F.when(_ascii(text), F.lower(text)).otherwise(F.translate(out, _ACCENTED + "".join(_ONE), _PLAIN + "".join(_ONE.values())))


def tokens(folded: Column) -> Column:
    """The distinct words of a folded text."""
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
