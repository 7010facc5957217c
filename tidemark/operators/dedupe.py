"""Event deduplication and change detection (DD01 to DD10, JN04 to JN06).

Items are blocked by country and hazard, clustered greedily by title in arrival order, and each cluster becomes one event with
a severity and a confidence calibrated by corroboration. Blocks never interact. Within a block only distinct normalised titles
reach the greedy step (``leaders.py``): an item with the title of an earlier one joins the same cluster, for it meets the same pivots
with the same scores in the same order. So hot titles cost nothing, and the step's cost is that of distinct titles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dims import COUNTRIES, SEVERITY_LEVELS, SOURCE_RANKS, literal_map, lookup
from tidemark.functions.similarity import lcs_length, lcs_ratio, length_bound, ratio
from tidemark.functions.text import event_hash, normalize, summary
from tidemark.operators.classify import event_severity, source_confidence
from tidemark.operators.leaders import leading_titles, rare_grams, shuffled
from tidemark.operators.match import first_country, infer_hazard
from tidemark.sources.shared import written

CLUSTER_AT, UPDATED_AT = 0.90, 0.92


def candidates(items: DataFrame, countries: list[str], hazards: list[str]) -> DataFrame:
    """DD01: items with their country, its ISO3 code and hazard; those that show no hazard go."""
    text = F.concat_ws(" ", "title", "text", F.array_join("country_candidates", " "))
    return items.withColumns({"country": first_country(text, countries), "disaster_type": infer_hazard(text, hazards)}).filter("disaster_type is not null").withColumn(
        "country_iso3", F.coalesce(lookup(COUNTRIES, F.lower(F.trim("country"))), F.lit(""))
    )


def cluster(items: DataFrame, threshold: float = CLUSTER_AT, blocks: tuple[str, ...] = ("country", "disaster_type"), order: str = "ord", exact_ratio: bool = True) -> DataFrame:
    """DD02: add ``cluster``, the order of its cluster's first item. ``exact_ratio`` takes SC04's ratio, else SC05's.

    A null title is empty; null blocks are blocks of their own. With threshold 1 only equal titles meet, and no Python is needed.
    """
    # As JSON a null leaves its name out, so a block with a null is no other one's.
    titled = items.withColumns({"_block": F.to_json(F.struct(*blocks)) if blocks else F.lit(""), "_title": F.coalesce(normalize(F.col("title")), F.lit(""))})
    distinct = titled.groupBy(F.col("_block").alias("block"), F.col("_title").alias("t")).agg(F.min(order).alias("first"))
    if threshold >= 1.0:
        leaders_of = distinct.withColumnRenamed("first", "cluster")
    else:
        leaders_of = leading_titles(distinct, threshold, ratio if exact_ratio else lcs_ratio)
    leaders_of = leaders_of.withColumnsRenamed({"block": "_block", "t": "_title"})
    if not blocks:  # nothing bounds the titles of all items, so they don't go through the driver
        leaders_of = shuffled(leaders_of)
    return titled.join(leaders_of, ["_block", "_title"]).drop("_block", "_title")


def cluster_titles(titles: DataFrame, threshold: float = CLUSTER_AT) -> DataFrame:
    """DD03: (ord, title) clustered without blocks."""
    return cluster(titles, threshold, blocks=(), exact_ratio=False)


def primaries(clustered: DataFrame, order: str = "ord", blocks: tuple[str, ...] = ("country", "disaster_type")) -> DataFrame:
    """DD04, DD05: one row a cluster: its primary item (best source, longest text, first), the counts that corroborate it, severity and confidence inputs."""
    rank = F.coalesce(lookup(SOURCE_RANKS, F.col("source_type")), F.lit(0))
    keys = [*blocks, "cluster"]
    item = F.struct(*[c for c in clustered.columns if c not in keys])
    level = F.element_at(literal_map(SEVERITY_LEVELS), event_severity(F.concat_ws(" ", "title", "text")))
    best = F.struct(rank, F.coalesce(F.char_length("text"), F.lit(0)), -F.col(order))
    return clustered.groupBy(*keys).agg(
        F.max_by(item, best).alias("primary"), F.count(F.lit(1)).alias("corroboration_sources"), F.countDistinct("connector").alias("corroboration_connectors"),
        F.countDistinct("source_type").alias("corroboration_source_types"), F.max(rank).alias("strongest_rank"), F.max(level).alias("base_level"),
        F.max_by("source_type", F.struct(rank, -F.col(order))).alias("strongest_type"),
    )


def calibrated_confidence() -> Column:
    """DD06."""
    over = lambda c: F.greatest(F.lit(0), F.col(c) - 1)
    score = over("corroboration_connectors") + over("corroboration_source_types") + over("strongest_rank")
    official = (F.col("strongest_type") == "official") & (F.col("corroboration_connectors") >= 2)
    return F.when(official | (score >= 4), "high").when(score >= 2, "medium").otherwise(source_confidence(F.col("strongest_type")))


def calibrated_severity(confidence: Column) -> Column:
    """DD07: weak severe claims one level down, well corroborated medium ones up to high."""
    level = F.col("base_level")
    down = (confidence == "low") & (level >= 3) & (F.col("corroboration_connectors") < 2)
    up = (confidence == "high") & (level == 2) & (F.col("corroboration_connectors") >= 3)
    names = F.array(*[F.lit(k) for k in SEVERITY_LEVELS])
    return F.element_at(names, F.when(down, level - 1).when(up, F.lit(3)).otherwise(level))


def events_of(clusters: DataFrame, order: str = "ord", *keep: str) -> DataFrame:
    """DD04 to DD08: events of clusters, one an event_id, the first cluster's; with ``keep`` these columns of them only.

    The pick of the first cluster takes a row as a whole, so columns that a reader leaves out are made all the same unless ``keep`` leaves them out here.
    """
    p = lambda c: F.col(f"primary.{c}")
    event_id = event_hash(F.col("country"), F.col("disaster_type"), p("title"), p("published_at"))
    confidence = calibrated_confidence()
    full = clusters.select(
        event_id.alias("event_id"), F.col("cluster").alias("ord"), p("connector").alias("connector"), p("source_type").alias("source_type"), p("url").alias("url"), p("title").alias("title"), "country",
        p("country_iso3").alias("country_iso3"), "disaster_type", p("published_at").alias("published_at"), calibrated_severity(confidence).alias("severity"), confidence.alias("confidence"),
        summary(p("text"), p("title"), F.col("corroboration_sources")).alias("summary"), "corroboration_sources", "corroboration_connectors", "corroboration_source_types",
    )
    names = list(keep) or [c for c in full.columns if c != "event_id"]
    return full.groupBy("event_id").agg(F.min_by(F.struct(*names), "ord").alias("e")).select("event_id", "e.*")


def updated_events(events: DataFrame, threshold: float = UPDATED_AT) -> DataFrame:
    """JN06: event_id of the events whose title is similar to that of any earlier one of the batch.

    A title's later events follow an equal one, so only its first one is compared with others: with those that share one of
    its rarest q-grams (see ``rare_grams``: none that is similar enough is lost) and whose lengths allow it.
    """
    titled = events.select("event_id", "ord", normalize(F.col("title")).alias("t"))
    distinct = titled.groupBy("t").agg(F.min("ord").alias("first"))
    grams = written(rare_grams(distinct, threshold), "rare-grams")
    a, b = grams.select(F.col("t").alias("ta"), F.col("first").alias("fa"), "gram"), grams.select(F.col("t").alias("tb"), F.col("first").alias("fb"), "gram")
    pairs = a.join(shuffled(b), "gram").filter((F.col("fb") < F.col("fa")) & (length_bound(F.col("ta"), F.col("tb")) >= threshold)).select("ta", "tb", "fb").distinct()

    def any_near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A title's pairs follow one another; after the first similar one the others are passed over."""
        found = None
        for frame in frames:
            hits = []
            for a, b in zip(frame["ta"], frame["tb"]):
                if a != found and 2 * lcs_length(a, b) >= threshold * (len(a) + len(b)) - 1e-9 and ratio(a, b) >= threshold:
                    found = a
                    hits.append(a)
            yield pd.DataFrame({"t": hits}, dtype="str")

    near = pairs.select("ta", "tb", "fb").repartition("ta").sortWithinPartitions("ta", "fb").select("ta", "tb").mapInPandas(any_near, "t string").withColumn("near", F.lit(True))
    known = titled.join(distinct, "t").join(near, "t", "left")
    return known.filter((F.col("first") < F.col("ord")) | F.col("near")).select("event_id")


def with_status(events: DataFrame, previous: DataFrame, threshold: float = UPDATED_AT) -> DataFrame:
    """DD09, JN04: unchanged if the id was there before, updated if an earlier event of the batch has a similar title, else new."""
    was = previous.select("event_id").distinct().withColumn("_was", F.lit(True))
    near = updated_events(events, threshold).distinct().withColumn("_near", F.lit(True))
    joined = events.join(was, "event_id", "left").join(near, "event_id", "left")
    return joined.withColumn("status", F.when(F.col("_was"), "unchanged").when(F.col("_near"), "updated").otherwise("new")).drop("_was", "_near")


def detect_changes(items: DataFrame, previous: DataFrame, countries: list[str], hazards: list[str], include_unchanged: bool = True) -> DataFrame:
    """DD01 to DD10: items (ord, connector, source_type, url, title, text, country_candidates, published_at) to events with their status."""
    # Written, for the clusters and the states each read them more than once.
    found = written(candidates(items, countries, hazards), "candidates")
    events = written(events_of(primaries(cluster(found))), "events")
    out = with_status(events, previous)
    return out if include_unchanged else out.filter("status <> 'unchanged'")


def hash_set(events: DataFrame) -> DataFrame:
    """DD10, SO03: the distinct ids that the next cycle compares with."""
    return events.select("event_id").distinct()


def first_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """WN07: the first row of each key, as an aggregate, which a hot key does not hold up."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*").select(*rows.columns)
