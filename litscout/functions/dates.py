"""Dates: parsing as the scouting pipeline reads them, formats, ages. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?([+-]\d{2}(:?\d{2})?)?)?$"


def parse_date(c: Column) -> Column:
    """Epoch seconds, ISO date or date-time (``Z`` as UTC, no zone as UTC), ``%Y-%m-%d`` with short parts, ``YYYYMMDD``; else null.

    A year alone, or year and month, is no date. The session's time zone must be UTC.
    """
    text = F.regexp_replace(c, "[Zz]$", "+00:00")
    iso = F.when(text.rlike(_ISO), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")))
    compact = F.when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd")))
    short = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(c, F.lit("yyyy-M-d")))
    return F.coalesce(iso, compact, short)


def iso_instant(c: Column) -> Column:
    """An ISO date-time; null stays null, anything else stops the query."""
    bad = F.raise_error(F.concat(F.lit("no ISO date-time: "), c)).cast("timestamp")
    return F.when(c.isNull(), F.lit(None).cast("timestamp")).otherwise(F.coalesce(parse_date(c), bad))


def epoch_date(c: Column) -> Column:
    """S11 for numbers: seconds since 1970; zero counts as missing."""
    return F.when(c != 0, F.timestamp_seconds(c))


def iso_utc(c: Column) -> Column:
    """ISO format with the offset of UTC."""
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def rfc822(c: Column) -> Column:
    """S14."""
    return F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss xx")


def elapsed_days(published: Column, asof: Column) -> Column:
    """Whole days passed, not calendar days; future dates count as 0."""
    return F.greatest(F.timestamp_diff("DAY", published, asof), F.lit(0).cast("bigint"))


def is_recent(published: Column, asof: Column, days: int) -> Column:
    """FLT7: ``days <= 0`` lets all pass; null dates go, future dates stay."""
    if days <= 0:
        return F.lit(True)
    return F.coalesce(published >= asof - F.make_dt_interval(F.lit(days)), F.lit(False))
