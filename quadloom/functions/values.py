"""Values at the edges: dates in Unix seconds, numbers and booleans as written, IRIs, media types."""

from __future__ import annotations

import re
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_ISO = re.compile(r"([+-]?)(\d{4,6}|\d{1,6}(?=\Z|-))(?:-(\d\d)(?:-(\d\d))?)?(?:T(\d\d):(\d\d)(?::(\d\d)(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?\Z")
#: The widest time that the codec holds, as milliseconds either side of 1970.
MAX_MILLIS = 8_640_000_000_000_000


def _days(year: int, month: int, day: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, for any year."""
    year -= month <= 2
    era, of_era = divmod(year, 400)
    of_year = (153 * (month + (-3 if month > 2 else 9)) + 2) // 5 + day - 1
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719468


def iso_to_seconds(text: str | None) -> int | None:
    """Unix seconds, towards zero; years beyond four digits and before the common era included. UTC where no offset is given."""
    m = _ISO.match(text.strip()) if text is not None else None
    if m is None:
        return None
    sign, digits, month, day, hour, minute, second, part, zone = m.groups()
    year = int(digits) * (-1 if sign == "-" else 1)
    month, day, hour, minute, second = (int(x) if x else d for x, d in ((month, 1), (day, 1), (hour, 0), (minute, 0), (second, 0)))
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    last = [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    if not 1 <= month <= 12 or not 1 <= day <= last[month - 1] or hour > 24 or minute > 59 or second > 59 or hour == 24 and (minute or second):
        return None
    millis = (_days(year, month, day) * 86400 + hour * 3600 + minute * 60 + second) * 1000 + int(float(part or 0) * 1000)
    if zone and zone != "Z":
        millis -= (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[-2:])) * 60_000
    if abs(millis) > MAX_MILLIS:
        return None
    return int(millis / 1000) if abs(millis) < 1 << 50 else (abs(millis) // 1000) * (1 if millis > 0 else -1)


def seconds_to_iso(seconds: int) -> str:
    """ISO 8601 with milliseconds; years beyond four digits are signed and have six."""
    days, rest = divmod(seconds, 86400)
    era, day = divmod(days + 719468, 146097)
    of_era = (day - day // 1460 + day // 36524 - day // 146096) // 365
    of_year = day - (365 * of_era + of_era // 4 - of_era // 100)
    month = (5 * of_year + 2) // 153
    date = of_year - (153 * month + 2) // 5 + 1
    month = month + 3 if month < 10 else month - 9
    year = of_era + era * 400 + (month <= 2)
    shown = f"{year:04d}" if 0 <= year <= 9999 else f"{'-' if year < 0 else '+'}{abs(year):06d}"
    return f"{shown}-{month:02d}-{date:02d}T{rest // 3600:02d}:{rest % 3600 // 60:02d}:{rest % 60:02d}.000Z"


@F.pandas_udf(LongType())
def _deep_seconds(text: pd.Series) -> pd.Series:
    return text.map(iso_to_seconds, na_action="ignore").astype("Int64")


def unix_seconds(text: Column) -> Column:
    """iso_to_seconds of a column: ordinary dates in the JVM, others in a Pandas UDF that sees only those."""
    trimmed = F.trim(text)
    plain = trimmed.rlike(r"^\d{4}-\d\d-\d\d$") & F.to_date(F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd"))).isNotNull()
    return F.when(plain, F.unix_date(F.to_date(F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd")))).cast("long") * 86400).otherwise(_deep_seconds(F.when(~plain, text)))


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(text: Column) -> Column:
    """A number as scripts read one: blank is 0, hexadecimal and Infinity count, other text is nothing."""
    t = F.trim(text)
    hexadecimal = F.conv(F.substring(t, 3, 64), 16, 10).cast("double")
    infinite = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(t == "", 0.0).when(t.rlike(_NUMBER), t.try_cast("double")).when(t.rlike("^0[xX][0-9a-fA-F]+$"), hexadecimal).when(t.rlike("^[+-]?Infinity$"), infinite)


def to_integer(text: Column) -> Column:
    """to_number without its fraction, towards zero."""
    n = to_number(text)
    return F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long")


def to_boolean(text: Column) -> Column:
    """true and 1 are true, any other text false, nothing is nothing."""
    return F.when(text.isNotNull(), text.isin("true", "1"))


def is_absolute_iri(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S*$")


def local_name(iri: Column) -> Column:
    return F.regexp_extract(iri, r"([^/#]*)$", 1)


def language_tag(tag: Column) -> Column:
    return F.replace(tag, F.lit("_"), F.lit("-"))


def skolem_iri(base: Column, *suffixes: Column) -> Column:
    return F.concat_ws("-", base, *suffixes)


def source_fingerprint(last_modified: Column, byte_size: Column, is_sparql: Column) -> Column:
    """What tells one state of a dump from another; an endpoint has none."""
    parts = F.concat_ws("|", F.coalesce(last_modified, F.lit("")), F.coalesce(byte_size.cast("string"), F.lit("")))
    return F.when(~is_sparql & (last_modified.isNotNull() | byte_size.isNotNull()), parts)


def should_reprocess(fingerprint: Column, version: Column, stored_fingerprint: Column, stored_version: Column, stored_status: Column) -> Column:
    """Unless the same state was processed well by the same version; without a fingerprint always."""
    return ~F.coalesce((fingerprint == stored_fingerprint) & (version == stored_version) & (stored_status == "success"), F.lit(False))


#: Media types: compressed forms end in these.
_COMPRESSED = r"\+(gzip|zip)$"


def mime_type(declared: Column) -> Column:
    """A media type in lower case, without parameters and compression."""
    return F.regexp_replace(F.lower(F.trim(F.element_at(F.split(declared, ";"), 1))), _COMPRESSED, "")


def is_sparql(media_type: Column, conforms_to: Column) -> Column:
    return F.coalesce(mime_type(media_type).isin("application/sparql-query", "application/sparql-results+json", "application/sparql-results+xml"), F.lit(False)) | F.coalesce(conforms_to.startswith("https://www.w3.org/TR/sparql11-") | conforms_to.startswith("http://www.w3.org/TR/sparql11-"), F.lit(False))


def now_iso() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def most_recent(*dates: Column) -> Column:
    """The latest of several ISO dates; those that are no dates do not count."""
    at = [F.struct(d.try_cast("timestamp").alias("t"), d.alias("d")) for d in dates]
    held = F.filter(F.array(*at), lambda x: x["t"].isNotNull())
    return F.array_max(held)["d"]


def first_by_path(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Properties (path, …) merged by path: of each column the first value in order that is not null."""
    rest = [c for c in rows.columns if c not in ("path", order)]
    return rows.groupBy("path").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest))
