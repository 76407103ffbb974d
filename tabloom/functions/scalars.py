"""Scalar expressions (F1-F10, P6). All of them stay inside whole-stage codegen and are safe under ANSI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the shape of hash-like or base64-like text.
HASH_LIKE_PATTERN = r"^[A-Za-z0-9+/=_\-]+$"


def tidy_text(c: Column) -> Column:
    """lower-cased, trimmed text."""
    return F.lower(F.trim(c))


def mentions(c: Column, needle: str) -> Column:
    """case-insensitive substring test."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def is_hash_like(c: Column) -> Column:
    """the whole text is made of hash or base64 characters."""
    return c.cast("string").rlike(HASH_LIKE_PATTERN)


def lenient_timestamp(c: Column) -> Column:
    """parse text to a timestamp; what does not parse becomes NULL."""
    return F.try_to_timestamp(c.cast("string"))


def date_parts(c: Column, prefix: str) -> list[Column]:
    """Year, month, day, day of week (Monday = 0) and weekend flag of a date or timestamp."""
    weekday = F.weekday(c)
    return [
        F.year(c).alias(f"{prefix}_year"),
        F.month(c).alias(f"{prefix}_month"),
        F.dayofmonth(c).alias(f"{prefix}_day"),
        weekday.alias(f"{prefix}_dow"),
        F.coalesce((weekday >= 5).cast("int"), F.lit(0)).alias(f"{prefix}_is_weekend"),
    ]


def _is_instant(c: Column) -> Column:
    """Whether a column is a timestamp with a zone; known when the query is planned."""
    return F.typeof(c) == "timestamp"


def epoch_micros(c: Column) -> Column:
    """microseconds since the epoch of a date or timestamp.

    A date or a timestamp without a zone is counted from the epoch as written, whatever the session's zone.
    """
    since = c.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    hours = F.extract(F.lit("DAY"), since).cast("long") * 24 + F.extract(F.lit("HOUR"), since)
    seconds = (hours * 60 + F.extract(F.lit("MINUTE"), since)) * 60
    written = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")
    return F.when(_is_instant(c), F.unix_micros(c.cast("timestamp"))).otherwise(written)


def from_epoch_micros(c: Column, has_zone: bool) -> Column:
    """the timestamp so many microseconds after the epoch, with or without a zone."""
    if has_zone:
        return F.timestamp_micros(c)
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + since


def elapsed_seconds(start: Column, end: Column) -> Column:
    """seconds between two timestamps."""
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1e6)


def iso_text(c: Column) -> Column:
    """ISO-8601 text to the microsecond, as written or, for an instant, in the session's zone."""
    text = c.cast("timestamp_ntz").cast("string")
    fraction = F.rpad(F.substring(text, 21, 6), 6, "0")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), fraction)


def clamp(c: Column, low: float, high: float) -> Column:
    """limit to an interval."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """rounded ratio whose denominator is at least one."""
    return F.round(part / F.greatest(whole, F.lit(1)), digits)


def zero_to_null(c: Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(c, F.lit(0))


def safe_ratio(a: Column, b: Column) -> Column:
    """F8: a / b, missing where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def json_value(*columns: Column) -> Column:
    """the columns of a row as one JSON document."""
    return F.to_json(F.struct(*columns))


def text_map(keys: Column, values: Column) -> Column:
    """a map from two collected arrays."""
    return F.map_from_arrays(keys, values)
