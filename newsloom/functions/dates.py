"""Dates: parsing with defined failures (null), and scores that take ``as_of`` in place of a clock."""

from __future__ import annotations

from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MICROS = 86_400_000_000
#: Forms that are read natively.
ISO_FORMS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[XXX]", "yyyy-MM-dd'T'HH:mm[XXX]", "yyyy-MM-dd")


def parse_iso(text: Column) -> Column:
    """ISO 8601; without a zone in the session's, which is UTC. Anything else is null."""
    text = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ISO_FORMS])


@F.pandas_udf(T.TimestampType())
def _free_form(text: pd.Series) -> pd.Series:
    from dateutil import parser

    fixed = datetime(2000, 1, 1)  # what a text leaves open is taken from here, not from today

    def one(x):
        try:
            found = parser.parse(x, default=fixed)
        except (ValueError, OverflowError, TypeError):
            return None
        return found.replace(tzinfo=found.tzinfo or timezone.utc).astimezone(timezone.utc)

    return pd.to_datetime(pd.Series([one(x) if x else None for x in text]), utc=True)


def parse_article_date(text: Column, free_form: bool = False) -> Column:
    """Epoch seconds (10 digits) or milliseconds (13), ISO, or with ``free_form`` what dateutil makes of it."""
    text = F.trim(text)
    seconds = F.when(text.rlike(r"^\d{10}$"), F.timestamp_seconds(F.try_to_number(text, F.lit("9999999999")).cast("long")))
    millis = F.when(text.rlike(r"^\d{13}$"), F.timestamp_millis(F.try_to_number(text, F.lit("9999999999999")).cast("long")))
    known = F.coalesce(seconds, millis, parse_iso(text))
    return F.coalesce(known, _free_form(text)) if free_form else known


def parse_feed_date(text: Column) -> Column:
    """RFC 2822, then ISO 8601; the weekday is not read."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+", "")
    zone = F.regexp_replace(bare, r"\s+(?:UT|GMT|UTC|Z)$", " +0000")
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(zone, F.lit(f)) for f in forms], parse_iso(text))


def read_feed_date(text: str | None) -> datetime | None:
    """``parse_feed_date`` in Python, with the obsolete forms of RFC 2822."""
    if not text or not text.strip():
        return None
    found = None
    try:
        found = parsedate_to_datetime(text.strip())
    except (TypeError, ValueError, IndexError):
        try:
            found = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
        except ValueError:
            return None
    return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)


def recency(published: Column, as_of: Column, window_days: int, undated: bool = True) -> Column:
    """1 now, falling to 0 at the window's end; the future counts as now; 0.5 or 0 without a date."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(published)) / DAY_MICROS)
    inside = F.lit(1.0) if window_days <= 0 else 1.0 - age / window_days
    return F.when(published.isNull(), F.lit(0.5 if undated else 0.0)).when(age > window_days, F.lit(0.0)).otherwise(inside)


def proximity(left: Column, right: Column, window_hours: float) -> Column:
    """1 at the same time, falling to 0 at the window's end; 0 without a date."""
    apart, window = F.abs(F.unix_micros(left) - F.unix_micros(right)), window_hours * 3_600_000_000
    if window <= 0:
        return F.lit(0.0)
    return F.when(apart.isNull() | (apart > window), F.lit(0.0)).otherwise(1.0 - apart / window)


def lookback(published: Column, days: float) -> Column:
    return published - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(days) * 86_400))


def backoff_seconds(attempt: Column, base: float, multiplier: float) -> Column:
    return F.lit(float(base)) * F.pow(F.lit(float(multiplier)), attempt - 1)


def next_run(cron: str, after: datetime) -> datetime | None:
    """Next minute after ``after`` that a five-field cron expression names (lists, ranges, steps; day fields are or-ed if both are set); None within four years."""
    from datetime import timedelta

    def allowed(field: str, low: int, high: int) -> set[int]:
        out: set[int] = set()
        for piece in field.split(","):
            span, _, step = piece.partition("/")
            lo, _, hi = span.partition("-")
            first, last = (low, high) if span == "*" else (int(lo), int(hi or (high if step else lo)))
            if not low <= first <= last <= high:
                raise ValueError(f"cron field out of range: {field}")
            out |= set(range(first, last + 1, int(step or 1)))
        return out

    fields = cron.split()
    if len(fields) != 5:
        raise ValueError("a cron expression has five fields")
    minutes, hours, days, months = (allowed(f, *b) for f, b in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12))))
    weekdays = {d % 7 for d in allowed(fields[4], 0, 7)}
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = after + timedelta(days=4 * 366)
    while at <= end:
        by_date, by_week = at.day in days, (at.weekday() + 1) % 7 in weekdays
        fits = by_date or by_week if fields[2] != "*" and fields[4] != "*" else by_date and by_week
        if at.month not in months or not fits:
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif at.hour not in hours:
            at = at.replace(minute=0) + timedelta(hours=1)
        elif at.minute not in minutes:
            at += timedelta(minutes=1)
        else:
            return at
    return None
