"""Dates and epochs.  All in UTC, epochs in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

DAY_MS = 86_400_000


def ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def parse_date(c) -> Column:
    """Struct of epoch ms (null if not a date) and whether only a day was given.  Without a zone: UTC."""
    t = F.trim(col(c))
    day = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    at = F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd")), F.try_to_timestamp(t))
    return F.struct(F.unix_millis(at).alias("ms"), day.alias("day_only"))


def date_range(start, end) -> Column:
    """Half-open [from, to) in ms; a day as the end means all of it.  ``ok`` is false for an empty range."""
    a, b = parse_date(start), parse_date(end)
    to = b["ms"] + F.when(b["day_only"], F.lit(DAY_MS)).otherwise(F.lit(0))
    return F.struct(a["ms"].alias("from_ms"), to.alias("to_ms"), F.coalesce(a["ms"] < to, F.lit(True)).alias("ok"))


def iso(ms_col) -> Column:
    return F.date_format(F.timestamp_millis(col(ms_col)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def freshness(ms_col, now_ms) -> Column:
    """Seconds and hours since, never negative."""
    seconds = F.greatest(F.lit(0), F.floor((col(now_ms) - col(ms_col)) / 1000)).cast("long")
    return F.struct(seconds.alias("seconds"), F.round(seconds / 3600, 2).alias("hours"))


def before_term(oldest_ms) -> Column:
    """The day after the oldest message, as mailbox queries write it."""
    return F.concat(F.lit("before:"), F.date_format(F.date_add(F.to_date(F.timestamp_millis(col(oldest_ms))), 1), "yyyy/MM/dd"))


def mail_date(header, epoch_ms) -> Column:
    """Date of an RFC 2822 header, else of the epoch."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(col(header)), r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", "")
    at = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")))
    return F.coalesce(F.to_date(at), F.to_date(F.timestamp_millis(col(epoch_ms))))


def thread_bounds(first_ms, last_ms) -> Column:
    """The span of a conversation, widened on both sides by itself, a day at least."""
    span = F.greatest(F.lit(DAY_MS), col(last_ms) - col(first_ms))
    return F.struct((col(first_ms) - span).alias("from_ms"), (col(last_ms) + span).alias("to_ms"))
