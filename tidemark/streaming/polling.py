"""Polling cycles (ST01, ST02, ST05, ST07): each micro-batch of raw items is one cycle, compared with the cycle before."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.dedupe import detect_changes, hash_set
from tidemark.sources.tables import Warehouse

T = TypeVar("T")
Progress = Callable[[str, str, dict], None]
STAGE_EVENT = "cycle_id long, n int, stage string, status string, rows long, elapsed_ms double, error string"


class StageLog:
    """ST07: what the stages of one cycle did, in order: started, then completed with the number of rows, or error with what went wrong.

    A callback hears of each as it happens; its own failures stop nothing. ``write`` makes them a part of the events table.
    """

    def __init__(self, cycle_id: int, progress: Progress | None = None):
        self.cycle_id, self.progress, self.events = cycle_id, progress, []

    def _note(self, stage: str, status: str, rows: int | None = None, elapsed_ms: float | None = None, error: str | None = None) -> None:
        self.events.append((self.cycle_id, len(self.events), stage, status, rows, elapsed_ms, error))
        if self.progress is not None:
            try:
                self.progress(stage, status, {"rows": rows, "elapsed_ms": elapsed_ms, "error": error})
            except Exception:  # noqa: S110  whoever listens does not decide about the run
                pass

    def run(self, stage: str, work: Callable[[], T], rows: Callable[[T], int] | None = None) -> T:
        self._note(stage, "started")
        began = time.monotonic()
        taken = lambda: round(1000 * (time.monotonic() - began), 1)
        try:
            result = work()
            count = None if rows is None else rows(result)
        except Exception as error:
            self._note(stage, "error", elapsed_ms=taken(), error=f"{type(error).__name__}: {str(error).splitlines()[0]}")
            raise
        self._note(stage, "completed", count, taken())
        return result

    def write(self, spark: SparkSession, warehouse: Warehouse) -> None:
        """Replaces the events of an earlier try of the cycle."""
        frame = spark.createDataFrame(self.events, STAGE_EVENT).coalesce(1)
        frame.drop("cycle_id").write.mode("overwrite").parquet(warehouse.at(f"stage_events/cycle_id={self.cycle_id}"))


def run_cycles(
    items: DataFrame, warehouse: Warehouse, countries: list[str], hazards: list[str], checkpoint: str, every: str | None = None, progress: Progress | None = None
) -> StreamingQuery:
    """Start the stream. ``every`` is the polling interval; without it, what is there is processed and the query ends.

    The state between cycles is the previous cycle's set of event ids alone, which each cycle replaces (ST02). It is a table of
    the warehouse named by batch, so a batch that is run again after a failure reads the same previous set; older ones go.
    """
    spark = items.sparkSession

    def cycle(batch: DataFrame, batch_id: int) -> None:
        log = StageLog(batch_id, progress)
        batch = batch.persist()
        try:
            log.run("collect", lambda: batch, DataFrame.count)
            before = warehouse.state(f"hashes_{batch_id - 1}") if batch_id else spark.createDataFrame([], "event_id string")
            events = log.run("detect", lambda: detect_changes(batch, before, countries, hazards).persist(), DataFrame.count)
            log.run("persist", lambda: events.withColumn("cycle_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(warehouse.at(f"events/cycle_id={batch_id}")))
            log.run("state", lambda: warehouse.save_state(f"hashes_{batch_id}", hash_set(events)))
            events.unpersist()
            if batch_id > 1:
                warehouse.drop_state(f"hashes_{batch_id - 2}")
        finally:
            batch.unpersist()
            log.write(spark, warehouse)

    writer = items.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def poll(run: Callable[[], object], seconds: float, max_runs: int | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """ST01: ``run`` at once, then at each interval from the first start on, ``max_runs`` times or for ever. Returns how often it ran.

    A run is, say, ``run_cycles(...).awaitTermination()``: it also counts where nothing new had come. While one takes longer than the
    interval, the starts that it covers are left out.
    """
    if max_runs is not None and max_runs < 1:
        return 0
    began, runs = clock(), 0
    while True:
        run()
        runs += 1
        if runs == max_runs:
            return runs
        ahead = clock() - began
        sleep((ahead // seconds + 1) * seconds - ahead)
