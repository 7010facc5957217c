"""Staleness of sources as a stream (ST03): the streak of WN02 kept as state by source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "source_url string, check_id long, freshness string, stale_streak long"


def streak_stream(checks: DataFrame) -> DataFrame:
    """A stream of (source_url, check_id, freshness) with the streak after each check.

    State is one number a source. Checks of a source in one micro-batch are taken in order of their id; across batches they
    must arrive in order, as a poller's do.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames), ignore_index=True).sort_values("check_id", ignore_index=True)
        streaks = []
        for freshness in rows["freshness"]:
            streak = streak + 1 if freshness == "stale" else 0 if freshness == "fresh" else streak
            streaks.append(streak)
        state.update((streak,))
        yield pd.DataFrame({"source_url": [key[0]] * len(rows), "check_id": rows["check_id"], "freshness": rows["freshness"], "stale_streak": streaks})

    return checks.groupBy("source_url").applyInPandasWithState(run, SCHEMA, "streak long", "append", GroupStateTimeout.NoTimeout)
