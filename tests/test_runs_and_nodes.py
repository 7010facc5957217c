"""Polling at intervals, stage events, nodes over snapshots, templates of a table, and plans that find figures once."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify, ontology
from tidemark.sources import configuration
from tidemark.sources.tables import GraphStore, Warehouse
from tidemark.streaming.polling import StageLog, poll


class Clock:
    """Time that passes in sleeps and in runs only."""

    def __init__(self):
        self.now, self.starts = 100.0, []

    def sleep(self, seconds):
        self.now += seconds

    def run(self, takes):
        self.starts.append(self.now - 100)
        self.now += takes


@pytest.mark.parametrize("takes, runs, starts", [(1, 3, [0, 10, 20]), (0, 1, [0]), (25, 3, [0, 30, 60]), (10, 3, [0, 20, 40]), (1, 0, [])])
def test_runs_at_an_interval(takes, runs, starts):
    """The first one at once; intervals that a run covers are left out."""
    clock = Clock()
    assert poll(lambda: clock.run(takes), 10, runs, clock.sleep, lambda: clock.now) == runs and clock.starts == starts


def test_without_a_number_runs_go_on(monkeypatch):
    clock = Clock()

    def run():
        clock.run(0)
        if len(clock.starts) == 5:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        poll(run, 10, None, clock.sleep, lambda: clock.now)
    assert clock.starts == [0, 10, 20, 30, 40]


def test_stage_events(spark, tmp_path):
    heard = []

    def listen(stage, status, details):
        heard.append((stage, status))
        raise ValueError("a listener that fails stops nothing")

    store = Warehouse(spark, str(tmp_path))
    for _ in range(2):  # the second try of a cycle replaces the events of the first
        log = StageLog(4, listen)
        assert log.run("collect", lambda: [1, 2, 3], len) == [1, 2, 3]
        with pytest.raises(ZeroDivisionError):
            log.run("detect", lambda: 1 / 0)
        log.write(spark, store)
    rows = spark.read.parquet(store.at("stage_events")).orderBy("n").collect()
    assert [(r.cycle_id, r.n, r.stage, r.status, r.rows, r.error) for r in rows] == [
        (4, 0, "collect", "started", None, None), (4, 1, "collect", "completed", 3, None), (4, 2, "detect", "started", None, None), (4, 3, "detect", "error", None, "ZeroDivisionError: division by zero"),
    ]
    assert heard[:4] == [(r.stage, r.status) for r in rows] and all(r.elapsed_ms is not None for r in rows if r.status != "started")


@pytest.mark.parametrize("cuts", [(40, 40), (1, 3), (20, 33)])
def test_nodes_of_any_split_are_those_of_one_build(spark, tmp_path, cuts):
    rng = random.Random(3)
    rows = [(i, f"key{rng.randrange(12)}", f"Name {i}", rng.randrange(3), rng.choice([None, "", f"I{rng.randrange(4)}"])) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, geo_key string, name string, admin_level int, iso3 string")
    store = GraphStore(spark, str(tmp_path))
    parts = [frame.filter(F.col("id").between(a, b - 1)) for a, b in itertools.pairwise((0, *cuts, 40))]
    for snapshot in (0, 1, 1, 2, 0):  # some again, as after a failure
        store.add(snapshot, {"geo": (parts[snapshot], "geo_key", "id", ("iso3",))})
    wanted = {}
    for _, key, name, level, iso3 in rows:
        first = wanted.setdefault(key, [name, level, None])
        first[2] = max(filter(None, (first[2], iso3)), default=None)
    assert {r.geo_key: [r.name, r.admin_level, r.iso3] for r in store.nodes("geo", "geo_key", ("iso3",)).collect()} == wanted


def test_templates_of_a_table(spark):
    given = [("a", '{"sections": {"method": "How", "other": "x"}, "limits": {"method_max_words": 5}}'), ("b", "no JSON"), ("c", None), ("d", '{"sections": 7}')]
    rows = configuration.templates(spark.createDataFrame(given, "report string, template string")).collect()
    for report, text in given:
        wanted = configuration.template(text)
        got = {(r.part, r.key): r.value for r in rows if r.report == report}
        assert got == {(part, key): str(configuration.template(text)[part][key] if key in wanted[part] else value) for part in ("sections", "limits") for key, value in configuration.TEMPLATE[part].items()}


def test_a_word_that_all_names_share_pairs_nothing(spark):
    areas = spark.createDataFrame([(f"North {i}", 1, i) for i in range(200)] + [("North", 1, 500), ("Old-Town", 2, 501)], "name string, admin_level int, ord int")
    items = spark.createDataFrame([(1, "in the north"), (2, "in North 7 and north 9"), (3, "old town, old-town"), (4, "north 700"), (5, None)], "id long, text string")
    got = {r.id: r.area for r in classify.detect_area(items, areas, "text", "id").collect()}
    assert got == {1: "North", 2: "North 7", 3: "Old-Town", 4: "North", 5: None}


def test_figures_are_found_once(spark):
    """The optimizer adds no second evaluation of the four patterns to see whether there are any."""
    evidence = spark.createDataFrame([("t", "s", "5 people killed", "high", "2026-01-01")], "title string, summary string, text string, severity string, published_at string")
    plan = ontology.explode_figures(ontology.annotate(evidence), "title")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4
