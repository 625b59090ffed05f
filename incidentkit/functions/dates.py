"""Month keys, spines and period starts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Months standing in for a missing opening or closing date.
OPENED_DEFAULT = 200001
CLOSED_DEFAULT = 203001


def month_key(ts: Column) -> Column:
    """``yyyymm`` as bigint."""
    return (F.year(ts) * 100 + F.month(ts)).cast("bigint")


def month_index(key: Column) -> Column:
    """Months since year zero of a ``yyyymm`` key, so that months can be added."""
    return (F.floor(key / 100) * 12 + key % 100 - 1).cast("bigint")


def key_of_index(index: Column) -> Column:
    """Inverse of :func:`month_index`."""
    return (F.floor(index / 12) * 100 + index % 12 + 1).cast("bigint")


def parse_day_first(text: Column) -> Column:
    """Timestamp out of ``d-M-yyyy[ H:mm[:ss]]`` text, null where it is none."""
    clean = F.regexp_replace(F.trim(text), "/", "-")
    return F.coalesce(
        F.try_to_timestamp(clean, F.lit("d-M-yyyy H:mm:ss")),
        F.try_to_timestamp(clean, F.lit("d-M-yyyy H:mm")),
        F.try_to_timestamp(clean, F.lit("d-M-yyyy")),
    )


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def hour_start(ts: Column) -> Column:
    """Start of the hour, free of any session time zone."""
    zero = F.lit(0)
    return F.make_timestamp_ntz(
        F.year(ts), F.month(ts), F.day(ts), F.hour(ts), zero, zero.cast("decimal(16,6)")
    )


def period_start(ts: Column, period: str) -> Column:
    """Start of the hour, day, week, month or year that holds ``ts``."""
    if period == "hour":
        return hour_start(ts)
    if period == "day":
        return ts.cast("date")
    return F.trunc(ts.cast("date"), period)
