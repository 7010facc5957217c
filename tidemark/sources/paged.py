"""Sources that are fetched page by page, as Python data sources (SRC04, SRC05, SRC06, ST04).

A client answers for a page and for the number of rows there are; what it is asked besides, equal values, a least date and search
terms, comes from the filters of the DataFrame that reads it. A task fetches a page. Nothing here opens a network connection.

As a stream, the pages between two offsets are read by as many tasks. A page that can't be fetched gives one row that tells its place
and the error; ``pull`` keeps the matching rows before the first such place, up to a limit of matches over the stream's life, and
leaves the offset where it was, so that the next run fetches those pages again and replaces what it had kept of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import chain
from operator import and_, or_
from typing import Protocol

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition
from pyspark.sql.types import StructType, _parse_datatype_string

from tidemark.dims import HAZARDS

PAGE, MOST_PAGES, MOST_TERMS, TERMS_A_HAZARD = 100, 10, 12, 5
#: What every source adds to its rows: the place of a row from 0 on, and what went wrong there.
PLACE, ERROR = "place", "error"


@dataclass(frozen=True)
class Asked:
    """What a client is asked for: columns that must have one of some values, columns with a least value, and terms that all must occur."""

    among: dict[str, tuple] = field(default_factory=dict)
    least: dict[str, object] = field(default_factory=dict)
    terms: tuple[str, ...] = ()

    @property
    def query(self) -> str:
        return " AND ".join(self.terms)


class Client(Protocol):
    """Both are called in tasks or on the driver, so a client can be pickled. Rows are in an order that doesn't change."""

    def fetch(self, offset: int, size: int, asked: Asked) -> list[tuple]: ...

    def count(self, asked: Asked) -> int: ...


def query_terms(countries: Sequence[str], hazards: Sequence[str], most: int = MOST_TERMS) -> list[str]:
    """SRC06: the terms asked of a server: countries and the first five keywords of each hazard, trimmed, each once whatever its case."""
    terms = [t.strip() for t in [*countries, *(k for h in hazards for k in HAZARDS.get(h, [h])[:TERMS_A_HAZARD])]]
    return list({t.lower(): t for t in reversed(terms) if t}.values())[::-1][:most]


@dataclass(frozen=True)
class Page(InputPartition):
    offset: int
    size: int
    part: Client | None = None  #: the part of the source that is read as a whole, whose rows have their places from the offset on


def pages_between(start: int, end: int, size: int) -> list[Page]:
    return [Page(at, min(size, end - at)) for at in range(start, end, size)]


class PageReader(DataSourceReader):
    """The first pages, or all that the server has, one task each; a failing one fails its task.

    All rows of a client that has ``parts`` are read a part a task, page after page, so that no task passes over the rows before its own.
    """

    def __init__(self, client: Client, rows: int | None, size: int, asked: Asked, pushed: tuple[str, ...]):
        self.client, self.rows, self.size, self.asked, self.pushed = client, rows, size, asked, pushed

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equal and listed values, and least values, of the columns that the server can filter by are asked of it; the rest is left to Spark."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if isinstance(f, (EqualTo, In)) and name in self.pushed and name not in self.asked.among:
                values = (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
                self.asked = replace(self.asked, among={**self.asked.among, name: values})
            elif isinstance(f, GreaterThanOrEqual) and name in self.pushed and name not in self.asked.least:
                self.asked = replace(self.asked, least={**self.asked.least, name: f.value})
            else:
                yield f

    def partitions(self) -> list[Page]:
        if self.rows is not None:
            return pages_between(0, self.rows, self.size)
        if not hasattr(self.client, "parts"):
            return pages_between(0, self.client.count(self.asked), self.size)
        pages, at = [], 0
        for part in self.client.parts():
            rows = part.count(self.asked)
            pages += [Page(at, rows, part)] if rows else []
            at += rows
        return pages

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # Spark asks for one read where there are no pages
            return
        if partition.part is not None:
            for i, row in enumerate(chain.from_iterable(partition.part.pages(self.size, self.asked))):
                yield (*row, partition.offset + i, None)
            return
        for i, row in enumerate(self.client.fetch(partition.offset, partition.size, self.asked)[: partition.size]):
            yield (*row, partition.offset + i, None)


class PageStream(DataSourceStreamReader):
    """The pages from the last offset to as many rows as the source has now; the offset is the number of rows fetched."""

    def __init__(self, client: Client, size: int, asked: Asked, columns: int):
        self.client, self.size, self.asked, self.columns = client, size, asked, columns

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": self.client.count(self.asked)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return pages_between(start["rows"], end["rows"], self.size)

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:
            return
        try:
            rows = self.client.fetch(partition.offset, partition.size, self.asked)[: partition.size]
        except Exception as error:  # whatever a server does wrong
            yield (*[None] * self.columns, partition.offset, f"{type(error).__name__}: {error}")
            return
        for i, row in enumerate(rows):
            yield (*row, partition.offset + i, None)


def paged_source(name: str, schema: str, client: Client, limit: int | None = PAGE * MOST_PAGES, page: int = PAGE, most_pages: int = MOST_PAGES, asked: Asked | None = None, pushed: tuple[str, ...] = ()) -> type[DataSource]:
    """SRC04, SRC05: a data source over a client. A batch reads ``limit`` rows in ``most_pages`` pages at most; a limit of 0 reads nothing, and with none a batch reads all that the server has."""
    size = max(1, page if limit is None else min(page, limit))
    asked = asked or Asked()

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"{schema}, {PLACE} long, {ERROR} string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return PageReader(client, None if limit is None else max(0, min(limit, most_pages * size)), size, asked, pushed)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return PageStream(client, size, asked, len(schema) - 2)

    return Paged


def load(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    """The source as a DataFrame, with the session's switch for filters to Python sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


STOPPED = "the pull ends at place"


def pull(spark: SparkSession, source: type[DataSource], match: Column, limit: int, path: str, checkpoint: str) -> str | None:
    """SRC05, ST04: fetch what is new and keep the rows that match, ``limit`` of them over all runs. Returns the error that ended the run early, if one did.

    Kept rows are in a folder a batch, which a batch that is run again replaces; ``pulled`` reads them.
    """
    spark.dataSource.register(source)
    stream = spark.readStream.format(source.name()).load()

    def keep(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch_id:
            earlier = pulled(session, path, batch.schema).filter(F.col("batch") < batch_id).count()
        else:
            earlier = 0
        batch = batch.persist()
        try:
            failed = batch.filter(F.col(ERROR).isNotNull()).agg(F.min(F.struct(PLACE, ERROR)).alias("f")).first().f
            good = batch.filter(F.col(ERROR).isNull() & match)
            good = good if failed is None else good.filter(F.col(PLACE) < failed[PLACE])
            good.orderBy(PLACE).limit(max(0, limit - earlier)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()
        if failed is not None:
            raise RuntimeError(f"{STOPPED} {failed[PLACE]}: {failed[ERROR]}")

    running = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    except PySparkException as error:
        if STOPPED not in str(error):
            raise
        return str(error).split(STOPPED, 1)[1].split("\n", 1)[0].strip()
    return None


def pulled(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What ``pull`` has kept, with the number of its batch."""
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(path)


@dataclass(frozen=True)
class FolderClient:
    """A client over Parquet files in any file system that Arrow knows, whose rows are in order of the files' names; terms are looked for in ``texts``."""

    path: str
    columns: tuple[str, ...]
    texts: tuple[str, ...] = ()

    def _rows(self, asked: Asked):
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path)
        tests = [pc.field(c).isin(list(v)) for c, v in asked.among.items()] + [pc.field(c) >= v for c, v in asked.least.items()]
        tests += [reduce(or_, [pc.match_substring(pc.field(c), term, ignore_case=True) for c in self.texts]) for term in asked.terms]
        return ds.dataset(at, filesystem=files, format="parquet"), reduce(and_, tests) if tests else None

    def parts(self) -> list[FolderClient]:
        """A client for each file."""
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path)
        scheme = self.path[: self.path.index(at)]
        found = files.get_file_info(fs.FileSelector(at, recursive=True))
        return [replace(self, path=scheme + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.size and not f.base_name.startswith(("_", "."))]

    def pages(self, size: int, asked: Asked) -> Iterator[list[tuple]]:
        """All pages, one after another; they may be shorter than ``size``."""
        found, test = self._rows(asked)
        for batch in found.to_batches(columns=list(self.columns), filter=test, batch_size=size):
            yield list(zip(*(column.to_pylist() for column in batch.columns)))

    def fetch(self, offset: int, size: int, asked: Asked) -> list[tuple]:
        found, test = self._rows(asked)
        rows: list[tuple] = []
        for batch in found.to_batches(columns=list(self.columns), filter=test, batch_size=4096):
            if offset < batch.num_rows:
                part = batch.slice(offset, size - len(rows))
                rows += zip(*(column.to_pylist() for column in part.columns))
            offset = max(0, offset - batch.num_rows)
            if len(rows) == size:
                break
        return rows

    def count(self, asked: Asked) -> int:
        found, test = self._rows(asked)
        return found.count_rows(filter=test)
