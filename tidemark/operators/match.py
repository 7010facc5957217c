"""Matching items by country, hazard and age, with reasons (PR01 to PR07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dims import CONFLICT_IMPACT, CONFLICT_STRONG, HAZARD_ALIASES, HAZARDS, inverted, lookup
from tidemark.functions.dates import within_age
from tidemark.functions.text import contains_word, count_terms, normalize


def matches_country(text: Column, countries: list[str]) -> Column:
    """PR01: any of the countries stands in the text as a word."""
    wanted = [" ".join(c.lower().split()) for c in countries if c.strip()]
    return contains_word(normalize(text), wanted) if wanted else F.lit(False)


def first_country(text: Column, countries: list[str]) -> Column:
    """PR02: the first of the countries, as configured, that the text names; where it names none, the first one."""
    return F.coalesce(*[F.when(matches_country(text, [c]), F.lit(c)) for c in countries], F.lit(countries[0]))


def is_conflict(text: Column) -> Column:
    """PR04: a strong and an impact word, or two different strong words (normalised text)."""
    strong = count_terms(text, CONFLICT_STRONG, words=True)
    return ((strong >= 1) & contains_word(text, CONFLICT_IMPACT)) | (strong >= 2)


def infer_hazard(text: Column, allowed: list[str]) -> Column:
    """PR03: the first of the allowed hazards that the text shows, or null."""
    t = normalize(text)
    hits = [F.when(is_conflict(t) if h == "conflict emergency" else contains_word(t, HAZARDS.get(h, [h])), F.lit(h)) for h in allowed]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def match_reason(text: Column, countries: list[str], hazards: list[str], published: Column | None = None, now: Column | None = None, max_age_days: int | None = None) -> Column:
    """PR05: country_miss, hazard_miss, age_filtered or matched, in this order of precedence."""
    out = F.when(~matches_country(text, countries), "country_miss").when(infer_hazard(text, hazards).isNull(), "hazard_miss")
    if max_age_days:
        out = out.when(~within_age(published, now, max_age_days), "age_filtered")
    return out.otherwise("matched")


def canonical_hazard(value: Column) -> Column:
    """SC13: the canonical name of a hazard, by name or alias, or null."""
    cleaned = F.lower(F.trim(value))
    key = F.trim(F.regexp_replace(F.regexp_replace(cleaned, r"[_/\-]+", " "), r"\s+", " "))
    return F.when(cleaned.isin(list(HAZARDS)), cleaned).otherwise(lookup(inverted(HAZARD_ALIASES), key))


def canonical_hazards(values: Column, strict: bool = False) -> Column:
    """SC14: canonical names in order without repeats; strict raises on a value that is none."""
    named = F.transform(values, canonical_hazard)
    out = F.array_distinct(F.array_compact(named))
    if not strict:
        return out
    bad = F.exists(values, lambda v: canonical_hazard(v).isNull() & (F.trim(v) != ""))
    return F.when(bad, F.raise_error("invalid disaster type")).otherwise(out)


def reason_counts(items: DataFrame, by: str, reason: str = "reason") -> DataFrame:
    """AG25: a column of counts for each reason, one row a source."""
    reasons = ["matched", "country_miss", "hazard_miss", "age_filtered"]
    return items.groupBy(by).agg(*[F.count_if(F.col(reason) == r).alias(r) for r in reasons])
