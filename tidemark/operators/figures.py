"""Numeric figures in text (PR19): four families of patterns, the largest value of each kind. No Python: regular expressions and arrays."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let

# The patterns and what their labels count.
NUMBER_LABEL = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(people|persons|individuals|deaths|dead|killed|displaced|injured|missing|houses|homes|affected|families|households|children|schools|health\s*facilit)"
TOLL = r"(?i)(?:death\s+toll|toll)\s+(?:rises?\s+to|hits?|reaches?|climbs?\s+to|stands?\s+at|now)\s+(\d[\d,]*)|(?:kills?|killed)\s+(\d[\d,]*)"
AT_LEAST = r"(?i)(?:at\s+least|over|more\s+than|nearly|approximately|about|up\s+to|around|some)\s+(\d[\d,]*(?:\.\d+)?)\s*(people|persons|dead|killed|deaths|displaced|injured|missing|affected|houses|homes|children|families|schools|health)"
SENTENCE = r"(?i)\b(\d[\d,]*)\b[^.]{0,30}\b(killed|dead|deaths|drowned|perished|fatalities)"
#: Of these words a text must have one for the pattern to find anything: looked for first, which costs far less than the pattern.
NEEDED = {
    NUMBER_LABEL: "people person individual death dead kill displaced injured missing house home affected famil child school health".split(),
    TOLL: ["toll", "kill"],
    AT_LEAST: "least over more nearly approximately about up around some".split(),
    SENTENCE: "killed dead drowned perished fatalities deaths".split(),
}
FIGURES = {
    "deaths": ["deaths", "dead", "killed"], "displaced": ["displaced"], "injured": ["injured"], "missing": ["missing"], "houses_affected": ["houses", "homes"],
    "people_affected": ["people", "persons", "individuals", "affected", "families", "households"], "children_affected": ["children"], "schools_affected": ["schools"],
}


def _key(label: Column) -> Column:
    out = F.when(label.startswith("health"), "health_facilities_affected")
    for key, labels in FIGURES.items():
        out = out.when(label.isin(labels), key)
    return out


def _value(number: Column) -> Column:
    return F.try_to_number(F.regexp_replace(F.regexp_replace(number, ",", ""), r"\..*$", ""), F.lit("9" * 18)).cast("long")


def _found(text: Column, low: Column, pattern: str, labelled: bool) -> Column:
    """Array of struct<key, value> of all matches, found in one scan; without labels they count deaths.

    A match holds one number; its label, if the pattern has one, is the last word (of health facilities, the last two).
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    number = lambda m: _value(F.regexp_extract(m, r"\d[\d,]*(?:\.\d+)?", 0))
    needed = reduce(or_, [low.contains(w) for w in NEEDED[pattern]])
    label = lambda m: _key(F.lower(F.regexp_extract(m, r"(?i)(?:health\s*facilit|[a-z]+)$", 0))) if labelled else F.lit("deaths")
    found = F.transform(matches, lambda m: F.struct(label(m).alias("key"), number(m).alias("value")))
    return F.when(needed, found).otherwise(F.array().cast("array<struct<key:string,value:bigint>>"))


def figure_mentions(text: Column) -> Column:
    """All figures that the four families find, as an array of struct<key, value>; a text without a digit, or without a word that a pattern needs, is not scanned for it."""

    def mentions(low: Column) -> Column:
        toll = F.filter(_found(text, low, TOLL, False), lambda x: x["value"] > 0)
        near = F.filter(_found(text, low, SENTENCE, False), lambda x: (x["value"] > 0) & (x["value"] < 1_000_000))
        every = F.concat(_found(text, low, NUMBER_LABEL, True), toll, _found(text, low, AT_LEAST, True), near)
        return F.filter(every, lambda x: x["key"].isNotNull() & x["value"].isNotNull())

    return F.when(text.rlike("[0-9]"), let(F.lower(text), mentions)).otherwise(F.array().cast("array<struct<key:string,value:bigint>>"))


def figures(items: DataFrame, text: str, *ids: str) -> DataFrame:
    """(ids..., figure_key, value): the largest value of each kind in each text."""
    each = items.select(*ids, F.explode(figure_mentions(F.col(text))).alias("f"))
    return each.groupBy(*ids, F.col("f.key").alias("figure_key")).agg(F.max("f.value").alias("value"))


def figure_map(text: Column) -> Column:
    """map<key, value> of one text, without a shuffle."""

    def largest(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda x: x["key"]))
        of = lambda k: F.array_max(F.transform(F.filter(found, lambda x: x["key"] == k), lambda x: x["value"]))
        return let(keys, lambda ks: F.map_from_arrays(ks, F.transform(ks, of)))

    return let(figure_mentions(text), largest)
