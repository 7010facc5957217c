"""The table model: Parquet tables of a warehouse folder, additive schemas, sinks (SNK01 to SNK06, SO06)."""

from __future__ import annotations

import time
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "cycles": "cycle_id long, run_at timestamp, connector_count int, raw_item_count int, event_count int, summary string",
    "events": "cycle_id long, event_id string, status string, connector string, source_type string, url string, title string, country string, country_iso3 string, disaster_type string, published_at string, severity string, confidence string, summary string, corroboration_sources long, corroboration_connectors long, corroboration_source_types long",
    "raw_items": "cycle_id long, connector string, source_type string, url string, title string, published_at string, language string, content_mode string, payload_json string",
    "extractions": "cycle_id long, connector string, source_url string, attachment_url string, downloaded boolean, status string, method string, char_count int, duration_ms int, error string",
    "connector_health": "cycle_id long, connector string, attempted_sources int, healthy_sources int, failed_sources int, fetched_count int, matched_count int",
    "feed_health": "cycle_id long, connector string, source_name string, source_url string, status string, error string, fetched_count int, matched_count int",
    "snapshots": "snapshot_id long, created_at timestamp, impacts long, needs long, risks long, responses long",
}


class Warehouse:
    """Tables in one folder that all executors share.

    What belongs together, all rows of a cycle in six tables or the node tables of a snapshot, is written under the name of an
    attempt first, and a row in a log of commits then says that this attempt is the one that counts for the cycle. Readers join with the
    last commit of each. So a cycle that broke off between two tables is not there, and one that is written again replaces the first.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _complete(self, name: str, rows: DataFrame) -> DataFrame:
        """Columns that the table's schema has and the rows lack are null; others are kept (additive evolution)."""
        for field in T._parse_datatype_string(SCHEMAS[name]).fields if name in SCHEMAS else []:
            if field.name not in rows.columns:
                rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
        return rows

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows of a table that no cycle owns."""
        rows = self._complete(name, rows)
        writer = rows.write.mode("append")
        (writer.partitionBy("cycle_id") if "cycle_id" in rows.columns else writer).parquet(self.at(name))

    def exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _attempt(self) -> str:
        """A name that is greater than those of earlier attempts."""
        return f"w{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def _put(self, attempt: str, key: str, name: str, rows: DataFrame) -> None:
        """In order of the key, so that a reader of few cycles skips the rest of an attempt; an attempt of one cycle is left out as a whole."""
        rows.withColumn(key, F.col(key).cast("long")).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{self.at(name)}/attempt={attempt}")

    def _commits(self, key: str) -> DataFrame:
        """One row a committed cycle or snapshot: the attempt that counts."""
        log = self.spark.read.schema(f"{key} long, attempt string").parquet(self.at(f"commits_{key}"))
        return log.groupBy(key).agg(F.max("attempt").alias("attempt"))

    def _commit(self, attempt: str, key: str, keys: DataFrame) -> None:
        keys.select(F.col(key).cast("long").alias(key), F.lit(attempt).alias("attempt")).distinct().coalesce(1).write.mode("append").parquet(self.at(f"commits_{key}"))

    def read(self, name: str, **defaults) -> DataFrame:
        """SNK06: all versions of the table merged, of committed cycles or snapshots only, with defaults for columns that old rows lack."""
        out = self.spark.read.option("mergeSchema", "true").parquet(self.at(name))
        if "attempt" in out.columns:
            key = "snapshot_id" if "snapshot_id" in out.columns else "cycle_id"
            out = out.join(self._commits(key), [key, "attempt"], "left_semi").drop("attempt")
        for column, value in defaults.items():
            out = out.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in out.columns else F.lit(value))
        return out

    def vacuum(self, *names: str, key: str = "cycle_id") -> None:
        """Delete the attempts that no cycle or snapshot counts; nothing may be being written meanwhile."""
        counting = {r.attempt for r in self._commits(key).select("attempt").distinct().collect()}  # a name for each cycle at most
        for name in names:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name))
            files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for entry in files.listStatus(where):
                if (folder := entry.getPath()).getName().startswith("attempt=") and folder.getName().removeprefix("attempt=") not in counting:
                    files.delete(folder, True)

    def persist_cycles(self, tables: dict[str, DataFrame]) -> None:
        """SNK01: the rows of some cycles, each with its cycle_id, in all tables as one write; ``cycles`` says which cycles those are."""
        attempt = self._attempt()
        for name, rows in tables.items():
            self._put(attempt, "cycle_id", name, self._complete(name, rows))
        self._commit(attempt, "cycle_id", tables["cycles"])

    def persist_cycle(self, cycle_id: int, cycle: DataFrame, events: DataFrame, items: DataFrame, metrics: DataFrame) -> None:
        """SNK01: one cycle's rows: events, items, their extraction events, connector metrics and their feed results."""
        plain = [c for c in items.columns if c != "extraction_events"]
        tables = {"cycles": cycle, "events": events, "raw_items": items.select(*plain).withColumn("payload_json", F.to_json(F.struct(*plain))), "connector_health": metrics.drop("source_results")}
        if "extraction_events" in items.columns:
            tables["extractions"] = items.select(F.col("url").alias("source_url"), F.inline("extraction_events"))
        if "source_results" in metrics.columns:
            tables["feed_health"] = metrics.select("connector", F.inline("source_results"))
        self.persist_cycles({name: rows.withColumn("cycle_id", F.lit(cycle_id).cast("long")) for name, rows in tables.items()})

    def persist_ontology(self, snapshot_id: int, nodes: dict[str, DataFrame]) -> None:
        """SNK02: the node tables of a snapshot, descriptions of 500 characters at most, and its header, as one write."""
        attempt, counts = self._attempt(), {}
        stamp = lambda df: df.withColumn("snapshot_id", F.lit(snapshot_id).cast("long"))
        for name, rows in nodes.items():
            out = stamp(rows)
            if "description" in out.columns:
                out = out.withColumn("description", F.substring("description", 1, 500))
            self._put(attempt, "snapshot_id", f"onto_{name}", out)
            counts[name] = self.spark.read.schema(out.schema).parquet(f"{self.at(f'onto_{name}')}/attempt={attempt}").count()
        header = stamp(self.spark.range(1).select(F.current_timestamp().alias("created_at"), *[F.lit(n).cast("long").alias(k) for k, n in counts.items()]))
        self._put(attempt, "snapshot_id", "snapshots", header)
        self._commit(attempt, "snapshot_id", header)

    def snapshots(self, limit: int) -> DataFrame:
        """SNK03."""
        return self.read("snapshots").orderBy(F.desc("snapshot_id")).limit(limit)

    def save_state(self, name: str, rows: DataFrame) -> None:
        """SNK05: a small table that each cycle replaces."""
        rows.write.mode("overwrite").parquet(self.at(f"state_{name}"))

    def drop_state(self, name: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(f"state_{name}"))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def state(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.at(f"state_{name}"))


class GraphStore:
    """ON08, ON03, ON04: nodes that are added to over snapshots.

    A snapshot adds a part: nodes that no earlier one has, found by an anti-join, and for known ones only what fills a blank
    of theirs. So a part is as large as its news. Of a node the first sighting stands, by snapshot and then by order; columns to be filled
    have the greatest value that any sighting gave. A snapshot that is added again replaces its part.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.store = Warehouse(spark, path)

    def nodes(self, kind: str, key: str, filled: tuple[str, ...] = (), before: int | None = None) -> DataFrame:
        """One row a node, of all snapshots or those before one."""
        parts = self.store.read(f"nodes_{kind}")
        parts = parts if before is None else parts.filter(F.col("snapshot_id") < before)
        first = [c for c in parts.columns if c not in (key, "snapshot_id", "_order", "_new", *filled)]
        sighted = F.min_by(F.struct(*first), F.when(F.col("_new"), F.struct("snapshot_id", "_order"))).alias("_first")
        return parts.groupBy(key).agg(sighted, *[F.max(c).alias(c) for c in filled]).select(key, "_first.*", *filled)

    def add(self, snapshot_id: int, sightings: dict[str, tuple[DataFrame, str, str, tuple[str, ...]]]) -> None:
        """For each kind of node its sightings, key, order and the columns to be filled."""
        attempt = self.store._attempt()
        stamp = F.lit(snapshot_id).cast("long").alias("snapshot_id")
        for kind, (rows, key, order, filled) in sightings.items():
            others = [c for c in rows.columns if c not in (key, order, *filled)]
            seen = rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_first"), F.min(order).alias("_order"), *[F.max(F.nullif(c, F.lit(""))).alias(c) for c in filled])
            seen = seen.select(key, "_first.*", "_order", *filled)
            if self.store.exists(f"nodes_{kind}"):
                known = self.nodes(kind, key, filled, before=snapshot_id).select(key, *[F.col(c).alias(f"_{c}") for c in filled])
                new = seen.join(known, key, "left_anti").withColumn("_new", F.lit(True))
                news = [F.col(c).isNotNull() & (F.col(f"_{c}").isNull() | (F.col(c) > F.col(f"_{c}"))) for c in filled]
                fills = seen.join(known, key).filter(reduce(or_, news, F.lit(False))).select(*seen.columns).withColumn("_new", F.lit(False))
                seen = new.unionByName(fills)
            else:
                seen = seen.withColumn("_new", F.lit(True))
            self.store._put(attempt, "snapshot_id", f"nodes_{kind}", seen.withColumn("snapshot_id", stamp))
        self.store._commit(attempt, "snapshot_id", self.store.spark.range(1).select(stamp))


def schema_drift(declared: str, live: T.StructType) -> list[str]:
    """SO06: declared columns that the live table lacks, and live ones that are not declared."""
    wanted = {f.name for f in T._parse_datatype_string(declared).fields}
    there = {f.name for f in live.fields}
    return [f"missing column {c}" for c in sorted(wanted - there)] + [f"undeclared column {c}" for c in sorted(there - wanted)]
