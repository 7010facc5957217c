"""Timestamps that arrive as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_published(raw: Column) -> Column:
    """SC10: ISO 8601, then the mail format; null otherwise. A time without a zone is UTC (the session's zone)."""
    text = F.trim(raw)
    mail = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    return F.coalesce(iso, F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")))


def to_ymd(raw: Column) -> Column:
    """SC11: YYYY-MM-DD of a date in one of the usual forms, else its first ten characters."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    mail = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    day = lambda form, source=text: F.date_format(F.try_to_timestamp(source, F.lit(form)), "yyyy-MM-dd")
    named = F.date_format(F.try_to_timestamp(F.regexp_extract(mail, r"^(\d{1,2} [A-Za-z]{3} \d{4})", 1), F.lit("d MMM yyyy")), "yyyy-MM-dd")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)).otherwise(
        F.coalesce(named, day("d MMMM yyyy"), day("yyyy/MM/dd"), day("MM/dd/yyyy"), day("dd-MM-yyyy"), F.substring(text, 1, 10))
    )


def within_age(published: Column, now: Column, days: int) -> Column:
    """PR07: not older than so many days; undated and future ones pass, and so does one of exactly that age."""
    return published.isNull() | (published > now) | (published >= now - F.make_dt_interval(F.lit(days)))


def freshness(latest: Column, now: Column, max_age_days: int | None) -> Column:
    """PR26: struct of status (unknown, fresh, stale) and age in days to two places."""
    if not max_age_days:
        return F.struct(F.lit("unknown").alias("status"), F.lit(None).cast("double").alias("age_days"))
    age = (F.unix_micros(now) - F.unix_micros(latest)) / F.lit(86400e6)
    status = F.when(latest.isNull(), "unknown").when((latest > now) | (age <= max_age_days), "fresh").otherwise("stale")
    return F.struct(status.alias("status"), F.when(latest.isNotNull(), F.when(latest > now, F.lit(0.0)).otherwise(F.bround(age, 2))).alias("age_days"))
