"""URL functions as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.dims import TRACKING_KEYS, TRACKING_PREFIXES

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, which: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; '' where there is none."""
    return F.regexp_extract(url, _PARTS, which)


def domain(url: Column) -> Column:
    """SC09: the authority in lower case, with its port, '' if there is none."""
    return F.lower(part(F.trim(F.coalesce(url, F.lit(""))), 2))


def strip_tracking(url: Column) -> Column:
    """SC06: tracking and blank parameters and the fragment gone; parameters of one name stand together, where the first stood."""
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p.rlike("^[^=]+=.+$"))
    name = lambda p: F.lower(F.regexp_extract(p, "^([^=]+)=", 1))
    kept = F.filter(pairs, lambda p: ~name(p).isin(TRACKING_KEYS) & ~name(p).rlike("^(" + "|".join(TRACKING_PREFIXES) + ")"))
    exact = lambda p: F.regexp_extract(p, "^([^=]+)=", 1)
    names = F.array_distinct(F.transform(kept, exact))
    query = F.array_join(F.transform(names, lambda n: F.array_join(F.filter(kept, lambda p: exact(p) == n), "&")), "&")
    head = F.concat(
        F.when(part(url, 1) != "", F.concat(F.lower(part(url, 1)), F.lit(":"))).otherwise(""),
        F.when(part(url, 2) != "", F.concat(F.lit("//"), part(url, 2))).otherwise(""),
        part(url, 3),
    )
    return F.concat(head, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def aggregator_target(url: Column) -> Column:
    """SC07: the address that a news aggregator's link carries in url, u or q; null if none."""
    query = F.concat(F.lit("&"), part(url, 4))
    found = [F.trim(F.try_url_decode(F.nullif(F.regexp_extract(query, f"&{key}=([^&]+)", 1), F.lit("")))) for key in ("url", "u", "q")]
    targets = [F.when(f.rlike("^https?://"), f) for f in found]
    return F.when(domain(url).contains("news.google."), F.coalesce(*targets))


def canonical(url: Column) -> Column:
    """SC08: trimmed, the aggregator's target if there is one, tracking gone; redirects are not followed."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    return strip_tracking(F.coalesce(aggregator_target(raw), raw))
