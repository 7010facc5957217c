"""Paged sources, pulls that match, filters sent to a source, and writes that count once."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.sources import paged, tables
from tidemark.sources.paged import Asked, FolderClient, pull, pulled

SCHEMA = "n long, name string"


class Numbers:
    """So many rows, of which those of the pages in ``bad`` can't be fetched; a folder may hold other counts and bad pages by name of its file."""

    def __init__(self, rows: int = 250, bad: tuple[int, ...] = (), state=None):
        self.rows, self.bad, self.state = rows, bad, state

    def now(self):
        if self.state is None:
            return self.rows, self.bad
        rows, *bad = map(int, self.state.read_text().split())
        return rows, tuple(bad)

    def fetch(self, offset: int, size: int, asked: Asked) -> list[tuple]:
        rows, bad = self.now()
        if offset in bad:
            raise ConnectionError(f"no answer at {offset}")
        return [(i, "even" if i % 2 == 0 else "odd") for i in range(offset, min(offset + size, rows))]

    def count(self, asked: Asked) -> int:
        return self.now()[0]


@pytest.mark.parametrize("limit, pages, wanted, parts", [(230, 10, 230, 3), (1000, 10, 250, 10), (1000, 2, 200, 2), (30, 10, 30, 1), (0, 10, 0, 0)])
def test_pages_up_to_the_limit(spark, limit, pages, wanted, parts):
    frame = paged.load(spark, paged.paged_source("numbers_batch", SCHEMA, Numbers(), limit=limit, most_pages=pages))
    rows = sorted((r.n, r.place, r.error) for r in frame.collect())
    assert rows == [(i, i, None) for i in range(wanted)] and frame.rdd.getNumPartitions() == max(parts, 1)


def test_a_failing_page_fails_a_batch(spark):
    with pytest.raises(PySparkException, match="no answer at 100"):
        paged.load(spark, paged.paged_source("numbers_bad", SCHEMA, Numbers(bad=(100,)))).collect()


def run(spark, source, tmp_path, limit=1000, match=None):
    return pull(spark, source, F.lit(True) if match is None else match, limit, f"file://{tmp_path}/kept", f"file://{tmp_path}/cp")


def kept(spark, tmp_path):
    rows = pulled(spark, f"file://{tmp_path}/kept", f"{SCHEMA}, place long, error string").orderBy("place").collect()
    return [(r.batch, r.n) for r in rows]


def test_all_rows_come_in_one_run(spark, tmp_path):
    assert run(spark, paged.paged_source("numbers_all", SCHEMA, Numbers()), tmp_path) is None
    assert kept(spark, tmp_path) == [(0, i) for i in range(250)]


def test_the_plain_stream_gives_all_rows(spark, tmp_path):
    spark.dataSource.register(paged.paged_source("numbers_plain", SCHEMA, Numbers()))
    query = spark.readStream.format("numbers_plain").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(250))


def test_a_restart_goes_on_from_its_checkpoint(spark, tmp_path):
    """Two runs with more rows in the second; a third one with nothing new."""
    state = tmp_path / "state"
    source = paged.paged_source("numbers_more", SCHEMA, Numbers(state=state))
    for rows in (130, 310, 310):
        state.write_text(str(rows))
        run(spark, source, tmp_path)
    assert kept(spark, tmp_path) == [(0, i) for i in range(130)] + [(1, i) for i in range(130, 310)]


@pytest.mark.parametrize("limit, first, second", [(200, 100, 55), (80, 80, 0), (0, 0, 0)])
def test_the_limit_counts_matches_over_all_runs(spark, tmp_path, limit, first, second):
    state = tmp_path / "state"
    source = paged.paged_source("numbers_matched", SCHEMA, Numbers(state=state))
    for rows in (200, 310):
        state.write_text(str(rows))
        run(spark, source, tmp_path, limit, F.col("name") == "even")
    assert kept(spark, tmp_path) == [(0, 2 * i) for i in range(first)] + [(1, 200 + 2 * i) for i in range(second)]


def test_a_failing_page_ends_the_run_and_costs_no_row(spark, tmp_path):
    """What comes before it is kept; when it answers again, the next run has everything once."""
    state = tmp_path / "state"
    source = paged.paged_source("numbers_failing", SCHEMA, Numbers(state=state))
    state.write_text("350 200 300")
    error = run(spark, source, tmp_path)
    assert error.startswith("200: ConnectionError: no answer at 200") and kept(spark, tmp_path) == [(0, i) for i in range(200)]
    state.write_text("350")
    assert run(spark, source, tmp_path) is None and kept(spark, tmp_path) == [(0, i) for i in range(350)]


class Recorder(Numbers):
    """Writes down what it is asked."""

    def __init__(self, path):
        super().__init__()
        self.path = path

    def fetch(self, offset, size, asked):
        if offset == 0:
            self.path.write_text(repr((sorted(asked.among.items()), sorted(asked.least.items()))))
        return [(i, c, h, d) for i, (c, h, d) in enumerate([("Peru", "flood", "2026-01-05"), ("Peru", "storm", "2026-01-06"), ("Chad", "flood", "2026-01-01")])][offset:]


@pytest.mark.parametrize(
    "where, asked",
    [
        ("country = 'Peru' AND hazard IN ('flood', 'storm') AND day >= '2026-01-02' AND n < 1", ([("country", ("Peru",)), ("hazard", ("flood", "storm"))], [("day", "2026-01-02")])),
        ("country = 'Peru' AND country = 'Peru' AND n = 0", ([("country", ("Peru",))], [])),
        ("n = 1 OR country = 'Chad'", ([], [])),
        ("lower(country) = 'peru' AND day > '2026-01-05'", ([], [])),
    ],
)
def test_filters_arrive_at_the_source(spark, tmp_path, where, asked):
    path = tmp_path / "asked"
    source = paged.paged_source("reports_asked", "n long, country string, hazard string, day string", Recorder(path), pushed=("country", "hazard", "day"))
    frame = paged.load(spark, source)
    rows = [(0, "Peru", "flood", "2026-01-05"), (1, "Peru", "storm", "2026-01-06"), (2, "Chad", "flood", "2026-01-01")]
    plain = spark.createDataFrame(rows, "n long, country string, hazard string, day string").filter(where)
    answered = sorted(r.n for r in frame.filter(where).collect())
    assert path.read_text() == repr(asked)
    # The recorder filters nothing itself, so what was asked of it is not filtered again; the rest is.
    rest = {"n < 1": [0], "n = 0": [0]}.get(where.rsplit(" AND ", 1)[-1])
    assert answered == (rest if rest is not None else sorted(r.n for r in plain.collect()))


def test_query_terms():
    assert paged.query_terms(["Nepal", "NEPAL ", " "], ["flood", "tsunami"], 4) == ["Nepal", "flood", "flash flood", "inundation"]
    assert Asked(terms=("a", "b c")).query == "a AND b c"


def test_a_folder_as_a_source(spark, tmp_path):
    rows = [(i, f"Report {i} on {'Floods' if i % 3 else 'storms'}", "A" if i % 2 else "B") for i in range(700)]
    spark.createDataFrame(rows, "n long, title string, country string").repartitionByRange(3, "n").sortWithinPartitions("n").write.parquet(str(tmp_path / "t"))
    client = FolderClient(f"file://{tmp_path}/t", ("n", "title"), ("title",))
    assert client.fetch(95, 10, Asked()) == [r[:2] for r in rows[95:105]] and client.fetch(695, 10, Asked()) == [r[:2] for r in rows[695:]] and client.fetch(900, 5, Asked()) == []
    wanted = [r[:2] for r in rows if r[2] == "A" and r[0] >= 300 and "Floods" in r[1]]
    asked = Asked({"country": ("A",)}, {"n": 300}, ("report", "floods"))
    assert client.fetch(50, 60, asked) == wanted[50:110] and client.count(asked) == len(wanted)


# --- writes that count once


def cycle_tables(spark, cycles, n):
    keys = [(c, i) for c in cycles for i in range(n)]
    return {
        "cycles": spark.createDataFrame([(c, n) for c in cycles], "cycle_id long, event_count int"),
        "events": spark.createDataFrame([(c, f"e{i}") for c, i in keys], "cycle_id long, event_id string"),
        "raw_items": spark.createDataFrame([(c, f"u{i}") for c, i in keys], "cycle_id long, url string"),
    }


def counts(store, name):
    return {r.cycle_id: r["count"] for r in store.read(name).groupBy("cycle_id").count().collect()}


def test_a_cycle_counts_once(spark, tmp_path, monkeypatch):
    store = tables.Warehouse(spark, str(tmp_path))
    store.persist_cycles(cycle_tables(spark, [1, 2], 3))
    store.persist_cycles(cycle_tables(spark, [2], 3))
    assert counts(store, "events") == counts(store, "raw_items") == {1: 3, 2: 3}
    # Written again with other rows, the last ones hold; one that broke off between two tables is not there.
    store.persist_cycles(cycle_tables(spark, [1], 5))
    put = tables.Warehouse._put
    monkeypatch.setattr(tables.Warehouse, "_put", lambda self, attempt, key, name, rows: put(self, attempt, key, name, rows) if name != "raw_items" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.persist_cycles(cycle_tables(spark, [2, 3], 7))
    assert counts(store, "events") == counts(store, "raw_items") == {1: 5, 2: 3} and counts(store, "cycles") == {1: 1, 2: 1}


def test_a_snapshot_counts_once(spark, tmp_path):
    store = tables.Warehouse(spark, str(tmp_path))
    nodes = lambda n: {"impacts": spark.createDataFrame([(f"i{k}",) for k in range(n)], "description string"), "needs": spark.createDataFrame([], "description string")}
    for snapshot, n in ((1, 3), (1, 3), (2, 4)):
        store.persist_ontology(snapshot, nodes(n))
    assert [(r.snapshot_id, r.impacts, r.needs) for r in store.snapshots(5).collect()] == [(2, 4, 0), (1, 3, 0)]
    assert store.read("onto_impacts").count() == 7 and store.read("onto_needs").count() == 0


def test_old_attempts_go(spark, tmp_path):
    store = tables.Warehouse(spark, str(tmp_path))
    for _ in range(3):
        store.persist_cycles(cycle_tables(spark, [1], 2))
    store.persist_cycles(cycle_tables(spark, [2], 2))
    store.vacuum("events", "raw_items", "cycles")
    assert len(list((tmp_path / "events").glob("attempt=*"))) == 2 and counts(store, "events") == counts(store, "raw_items") == {1: 2, 2: 2}


@pytest.mark.parametrize("name", ["src06_pushdown", "src06_query_terms"])
def test_asked_sources_are_read_whole(spark, tmp_path, name):
    """More matching reports than the first ten pages hold."""
    from tidemark.plans import flow_queries

    spark.range(70_000).selectExpr("id AS page_id", "concat('http://h/', id) AS url").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(25).selectExpr("cast(id AS int) AS n_nationkey", "concat('NATION_', id) AS n_name").write.parquet(str(tmp_path / "nation.parquet"))
    found = {r.id for r in flow_queries.QUERIES[name](spark, str(tmp_path)).select("id").collect()}
    if name == "src06_pushdown":
        # Hazards go round by five and floods come first, dates by ninety days from 1 January on.
        wanted = {i for i in range(70_000) if i % 25 in (5, 10, 15, 20) and i % 5 == 0 and i % 90 >= 4 and i % 2 == 0}
    else:
        wanted = {i for i in range(70_000) if i % 25 == 6}
    assert len(wanted) > 2_000 and found == wanted


def test_whole_source_without_parts(spark):
    """A client without parts is counted and read a page a task; every row has its place."""

    class Counted:
        def fetch(self, offset, size, asked):
            return [(i,) for i in range(offset, min(offset + size, 1_234))]

        def count(self, asked):
            return 1_234

    frame = paged.load(spark, paged.paged_source("counted_whole", "n long", Counted(), limit=None))
    rows = frame.select("n", "place").collect()
    assert sorted((r.n, r.place) for r in rows) == [(i, i) for i in range(1_234)]
