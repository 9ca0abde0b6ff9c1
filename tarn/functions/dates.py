"""Dates that come as text. `as_of` is always given, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}([T ].*)?$|^\d{8}$"


def iso_date(c: str | Column) -> Column:
    """The date, or null for what isn't strictly ISO (week dates aren't taken)."""
    c = F.col(c) if isinstance(c, str) else c
    dashed = F.regexp_replace(F.substring(c, 1, 10), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(c.rlike(ISO), F.try_to_date(dashed, "yyyy-MM-dd"))


def is_valid(c: str | Column) -> Column:
    return iso_date(c).isNotNull()


def too_old(c: str | Column, as_of: Column, days: int = 14) -> Column:
    return F.coalesce(F.datediff(as_of, iso_date(c)) > days, F.lit(False))


def in_future(c: str | Column, as_of: Column) -> Column:
    return F.coalesce(iso_date(c) > as_of, F.lit(False))


def within(a: Column, b: Column, days: int) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(False))


def freshness(c: Column, as_of: Column) -> Column:
    """Compares text, as the sources hold it: new_today, recent, backfill."""
    iso = lambda days: F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd")
    return F.when(c >= iso(1), "new_today").when(c >= iso(7), "recent").otherwise("backfill")


def kept_in_feed(c: str | Column, now: Column, days: int = 180) -> Column:
    """Midnight of the date against the moment `days` before now; without a date a row stays."""
    return F.coalesce(iso_date(c).cast("timestamp") >= now - F.make_dt_interval(F.lit(days)), F.lit(True))


def relative_label(d: Column, as_of: Column) -> Column:
    return F.when(d == as_of, "TODAY").when(d == F.date_sub(as_of, 1), "YESTERDAY").otherwise(F.date_format(d, "MMM dd, yyyy"))


def shown(c: str | Column) -> Column:
    """"Jan 5, 2026"; what is no date stays as it is, and nothing is the empty text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.date_format(iso_date(c), "MMM d, yyyy"), c, F.lit(""))
