"""Semantics on small hand-made frames: nulls, empty strings, ties, Unicode, and the loops that SQL can't express."""

from __future__ import annotations

import itertools
import json
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, policy, similarity, spans, text, urls
from tidemark.operators import classify, dedupe, evidence, figures, health, match, ontology, ordering, render, reports
from tidemark.sources import configuration, documents, feeds, tables
from tidemark.streaming.freshness import streak_stream
from tidemark.streaming.polling import run_cycles


def one(spark, column, **values):
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("https://a.org/x?utm_source=f&b=1&UTM_Medium=q&c=&b=2#top", "https://a.org/x?b=1&b=2"), ("https://a.org/?fbclid=1", "https://a.org/"), ("", ""), ("no scheme", "no scheme"),
        ("https://a.org/p?a=1&x=2&a=3", "https://a.org/p?a=1&a=3&x=2"), ("https://news.google.com/rss?oc=5&url=https%3A%2F%2Fb.org%2Fy%3Fgclid%3D1%26k%3D2", "https://b.org/y?k=2"),
    ],
)
def test_canonical_url(spark, raw, clean):
    assert one(spark, urls.canonical(F.col("u")), u=raw) == clean


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("2026-03-03T10:00:00Z", "2026-03-03 10:00:00"), ("2026-03-03T10:00:00+02:00", "2026-03-03 08:00:00"), ("2026-03-03", "2026-03-03 00:00:00"), ("Tue, 03 Mar 2026 10:00:00 +0100", "2026-03-03 09:00:00"),
        ("Tue, 3 Mar 2026 10:00:00 GMT", "2026-03-03 10:00:00"), ("soon", None), ("", None), (None, None),
    ],
)
def test_parse_published(spark, raw, wanted):
    assert one(spark, dates.parse_published(F.col("d")).cast("string"), d=raw) == wanted


@pytest.mark.parametrize(("raw", "day"), [("Tue, 03 Mar 2026 00:00:00 +0000", "2026-03-03"), ("3 March 2026", "2026-03-03"), ("2026/03/04", "2026-03-04"), ("03/04/2026", "2026-03-04"), ("04-03-2026", "2026-03-04"), ("unclear date", "unclear da"), (None, "")])
def test_to_ymd(spark, raw, day):
    assert one(spark, dates.to_ymd(F.col("d")), d=raw) == day


def test_word_boundaries_are_unicode(spark):
    assert one(spark, match.matches_country(F.col("t"), ["Niger"]), t="In  NIGER today") and not one(spark, match.matches_country(F.col("t"), ["Niger"]), t="Nigeria élu")
    assert not one(spark, text.contains_word(F.col("t"), ["lu"]), t="élu")


@pytest.mark.parametrize(
    ("sentence", "wanted"),
    [
        ("48,000 displaced and 59 killed", {"displaced": 48000, "deaths": 48000}), ("death toll rises to 59", {"deaths": 59}), ("at least 12 injured, 3 schools", {"injured": 12, "schools_affected": 3}),
        ("16,000 people displaced", {"people_affected": 16000}), ("kills 4. 2 health facilities hit", {"deaths": 4, "health_facilities_affected": 2}), ("nothing here", {}), ("", {}),
    ],
)
def test_figures(spark, sentence, wanted):
    got = one(spark, figures.figure_map(F.col("t")), t=sentence)
    assert got == wanted


def test_impacts_and_needs(spark):
    assert one(spark, classify.all_impacts(F.col("t")), t="Bridge and road out; hospital hit") == ["infrastructure_impact", "services_impact"]
    assert one(spark, classify.all_impacts(F.col("t")), t="") == ["people_impact"]
    assert one(spark, classify.needs(F.col("t")), t="Shelter and water") == ["wash", "shelter"]
    assert one(spark, classify.actor(F.col("t")), t="the Red Cross").actor == "RED CROSS"


def test_redaction_of_maps(spark):
    got = spark.sql("SELECT map('Token', 'abc', 'note', 'api_key: xyz', 'other', 'fine') AS m").select(policy.redact_map(F.col("m")).alias("m")).first().m
    assert got == {"Token": "[REDACTED]", "note": "api_key: [REDACTED]", "other": "fine"}


def test_quote_spans():
    source = "He said “it’s   gone” and left."
    assert spans.span_of(source, "said", 3, 7) == (3, 7)
    assert spans.span_of(source, "left") == (26, 30)
    start, end = spans.span_of(source, "\"it's gone\"")
    assert source[start:end] == "“it’s   gone”"
    assert spans.span_of(source, "absent") is None and spans.span_of(None, "") is None


def test_lcs_ratio():
    assert similarity.lcs_ratio("abcd", "abd") == pytest.approx(6 / 7) and similarity.lcs_ratio("", "") == 1 and similarity.lcs_ratio("a", "abcd") == 0.25


def test_updated_equals_all_pairs(spark):
    rng = random.Random(2)
    titles = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 30))) for _ in range(80)] + ["same title", "same title", "same titlex"]
    events = spark.createDataFrame([(f"e{i}", i, t) for i, t in enumerate(titles)], "event_id string, ord long, title string")
    normal = [" ".join(t.lower().split()) for t in titles]
    wanted = {f"e{j}" for i, j in itertools.combinations(range(len(titles)), 2) if SequenceMatcher(None, normal[j], normal[i]).ratio() >= 0.8}
    assert {r.event_id for r in dedupe.updated_events(events, 0.8).collect()} == wanted


ITEMS = "ord long, connector string, source_type string, url string, title string, text string, country_candidates array<string>, published_at string"


def changes(spark, rows, previous=(), **options):
    items = spark.createDataFrame(rows, ITEMS)
    before = spark.createDataFrame([(p,) for p in previous], "event_id string")
    return dedupe.detect_changes(items, before, ["Pakistan", "Nepal"], ["flood", "earthquake"], **options)


def test_detect_changes_corroboration_and_repeat(spark):
    rows = [
        (0, "gov", "official", "u0", "Severe flood in Pakistan", "Flood displaces many", [], "2026-01-01"), (1, "bbc", "news", "u1", "Severe flood in Pakistan", "Longer text about the flood", ["Pakistan"], "2026-01-01"),
        (2, "usgs", "official", "u2", "Earthquake advisory Nepal", "tremor", [], None), (3, "x", "social", "u3", "Festival in Nepal", "nothing", [], None),
    ]
    found = {r.title: r for r in changes(spark, rows).collect()}
    flood, quake = found["Severe flood in Pakistan"], found["Earthquake advisory Nepal"]
    assert len(found) == 2 and flood.corroboration_connectors == 2 and (flood.confidence, flood.severity, flood.country_iso3) == ("high", "high", "PAK")
    assert (quake.confidence, quake.severity, quake.status) == ("medium", "medium", "new")
    again = {r.title: r.status for r in changes(spark, rows, [flood.event_id]).collect()}
    assert again == {flood.title: "unchanged", quake.title: "new"}
    assert {r.title for r in changes(spark, rows, [flood.event_id], include_unchanged=False).collect()} == {quake.title}


def test_weak_severe_claim_is_lowered(spark):
    row = changes(spark, [(0, "x", "social", "u", "Catastrophic flood in Nepal", "", [], None)]).first()
    assert (row.severity, row.confidence) == ("high", "low")


def balanced_loop(rows, limit, countries, per_country, per_connector, per_source):
    taken, connectors, sources = [], {}, {}

    def take(r):
        if r in taken or connectors.get(r[2], 0) >= (per_connector or 99) or sources.get(r[3], 0) >= (per_source or 99):
            return False
        taken.append(r)
        connectors[r[2]] = connectors.get(r[2], 0) + 1
        sources[r[3]] = sources.get(r[3], 0) + 1
        return True

    for c in countries if per_country else []:
        left = per_country
        for r in rows:
            if len(taken) < limit and left and r[1] == c and take(r):
                left -= 1
    for r in rows:
        if len(taken) < limit:
            take(r)
    return {r[0] for r in taken}


@pytest.mark.parametrize(("per_country", "per_connector", "per_source"), [(1, 3, 2), (0, 4, 0), (2, 0, 1), (0, 0, 0), (3, 2, 2)])
def test_balanced_selection(spark, per_country, per_connector, per_source):
    rng = random.Random(per_country + per_connector)
    rows = [(i, rng.choice(["mg", "mz", "ke"]), rng.choice(["a", "b", "c"]), rng.choice(["s1", "s2", "s3", "s4"]), float(rng.randint(0, 9))) for i in range(60)]
    frame = spark.createDataFrame([(i, f"e{i}", c.upper(), k, s, score, "low", "2026", "http://x/") for i, c, k, s, score in rows], "id long, event_id string, country string, connector string, source_label string, graph_score double, severity string, published_at string, url string")
    ordered = sorted(rows, key=lambda r: (-r[4], -r[0]))
    got = {r.id for r in evidence.balanced(frame, 12, ["mg", "mz"], per_country, per_connector, per_source).collect()}
    assert got == balanced_loop(ordered, 12, ["mg", "mz"], per_country, per_connector, per_source)


def test_quality_report_of_nothing(spark):
    cycles = spark.createDataFrame([], "cycle_id long, llm_attempted int, llm_fallback int, llm_insufficient_text int, llm_provider_error int, llm_validation_fail int")
    events = spark.createDataFrame([], "cycle_id long, status string, url string, published_at string, severity string, confidence string, llm_enriched boolean, citations array<string>")
    assert health.quality_report(events, cycles).first().traceable_rate == 0.0
    some = spark.createDataFrame([(1, 1, 0, 0, 0, 0)], cycles.schema)
    row = health.quality_report(events, some).first()
    assert (row.traceable_rate, row.events_analyzed, row.duplicate_rate_estimate) == (1.0, 0, 0.0)
    assert health.hardening_gate(health.quality_report(events, cycles), spark.createDataFrame([], "failure_rate double")).first().status == "insufficient_data"


def test_analysis_report_passes_its_own_gate(spark):
    text_ = "## Executive Summary\nOne. [1]\nTwo. [1]\n## National Impact Overview\n| **deaths** | 12 | 2026-01-02 | [1] |\n| displaced | 1,200 | 3 Jan 2026 | [2,1] |\n## Province-Level Impact\n| # | A |\n| 1 | Sofala | x |\n## Sources and References\n1. https://a\n2. https://b\n"
    row = reports.analysis_score(spark.createDataFrame([(1, text_)], "doc_id long, markdown string")).first()
    assert row.citation_accuracy == 1.0 and row.key_figure_coverage == pytest.approx(2 / 7) and row.date_attribution == 1.0 and row.admin_coverage == pytest.approx(0.2)


def test_access_snippets_overlap():
    found = reports.snippets_of("x" * 50 + " road blocked and bridge collapsed here " + "y" * 100)
    assert len(found) == 2 and "bridge collapse" in found[0] and "road block" in found[1]


def test_links(spark):
    html = '<a href="a.pdf">1</a><a class=x href=\'/B.PDF\'>2</a><a href="a.pdf">3</a><a href="https://o.org/c.html">4</a>'
    assert one(spark, documents.links_ending(F.col("h"), F.lit("https://h.org/d/page"), ".pdf"), h=html) == ["https://h.org/d/a.pdf", "https://h.org/B.PDF"]
    assert one(spark, documents.first_outside_link(F.col("h")), h=html) == "https://o.org/c.html"


def test_replay(spark, tmp_path):
    item = lambda **x: {"connector": "c", "source_type": "news", "url": "u", "text": "", "country_candidates": [], "published_at": None} | x
    fixture = {
        "description": "d", "countries": ["Pakistan"], "disaster_types": ["flood", "earthquake"], "check_interval_minutes": 30, "previous_hashes": [],
        "items": [item(title="Severe flood in Pakistan", source_type="official", connector="g"), item(title="Severe flood in Pakistan", connector="n"), item(title="Earthquake advisory Pakistan", source_type="official")],
    }
    path = tmp_path / "replay.json"
    path.write_text(json.dumps(fixture))
    rows = feeds.replay(spark, str(path)).collect()
    assert sorted((r.disaster_type, r.severity, r.confidence, r.corroboration_sources) for r in rows) == [("earthquake", "medium", "medium", 1), ("flood", "high", "high", 2)]


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>T1</title><link>http://a/1</link><published>2026</published></item><item><title> </title><link>http://a/2</link></item></channel></rss>")
    entries = feeds.read_feeds(spark, str(tmp_path)).withColumn("name", F.lit("A"))
    assert [(r.title, r.url) for r in feeds.entry_items(entries, "name", "feed", "news").collect()] == [("[A] T1", "http://a/1")]


def test_warehouse(spark, tmp_path):
    store = tables.Warehouse(spark, str(tmp_path))
    item = spark.createDataFrame([("c", "news", "u", "t", [("a", True, "ok")])], "connector string, source_type string, url string, title string, extraction_events array<struct<attachment_url:string,downloaded:boolean,status:string>>")
    metrics = spark.createDataFrame([("c", 1, [("n", "s", "ok", 3)])], "connector string, attempted_sources int, source_results array<struct<source_name:string,source_url:string,status:string,fetched_count:int>>")
    events = spark.createDataFrame([("e1", "new")], "event_id string, status string")
    for cycle in (1, 2):
        store.persist_cycle(cycle, spark.createDataFrame([("s",)], "summary string"), events, item, metrics)
    assert store.read("extractions").count() == 2 and store.read("feed_health").first().source_url == "s"
    assert json.loads(store.read("raw_items").first().payload_json).get("extraction_events") is None
    assert {r.cycle_id for r in store.read("events", extra="x").filter("extra = 'x'").collect()} == {1, 2}
    store.persist_ontology(7, {"impacts": spark.createDataFrame([("d" * 600,)], "description string")})
    assert len(store.read("onto_impacts").first().description) == 500 and store.snapshots(3).first().impacts == 1
    assert tables.schema_drift("a int, b int", spark.createDataFrame([(1, 2)], "b int, c int").schema) == ["missing column a", "undeclared column c"]


def test_streak_stream_equals_window(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{i % 4}", i, rng.choice(["stale", "stale", "fresh", "unknown"])) for i in range(80)]
    checks = spark.createDataFrame(rows, "source_url string, check_id long, freshness string")
    for k in range(4):  # one file a micro-batch, in order
        checks.filter(f"check_id div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(checks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streak_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, health.stale_streaks(checks).collect()))


def test_cycles_compare_with_the_one_before(spark, tmp_path):
    store = tables.Warehouse(spark, str(tmp_path / "w"))
    row = (0, "gov", "official", "u", "Severe flood in Nepal", "text", [], "2026-01-01")
    for k in range(3):
        rows = [row] if k != 1 else [(0, "gov", "official", "u", "Earthquake in Nepal", "text", [], None)]
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_cycles(spark.readStream.schema(ITEMS).parquet(str(tmp_path / "in")), store, ["Nepal"], ["flood", "earthquake"], str(tmp_path / "cp")).awaitTermination(180)
    got = {r.cycle_id: r.status for r in spark.read.parquet(store.at("events")).collect()}
    assert got == {0: "new", 1: "new", 2: "new"}  # only the cycle just before is compared with


def test_plans_stay_native(spark, sf_dir):
    from tidemark.plans import registry

    for name in ("pr19_figures", "ag18_admin1_figures", "dd08_event_dedupe", "sl03_graph_score"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct")), name


def test_balanced_repeated_event(spark):
    """Rows that repeat one event do not use up the places of its group."""
    rows = [(i, "same" if i > 10 else f"e{i}", "Nepal", "rss", f"http://a.org/{i}", "unknown", 1.0 * i, "high", "2024-01-01") for i in range(1, 21)]
    scored = spark.createDataFrame(rows, "id long, event_id string, country string, connector string, url string, source_label string, graph_score double, severity string, published_at string")
    got = evidence.balanced(scored, 5, ["Nepal"], 3, 0, 4).collect()
    assert [r.id for r in got] == [20, 10, 9, 8]


@pytest.mark.parametrize("by", [None, ["g"]])
def test_numbering_by_ranges_equals_one_window(spark, by):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, i long").repartition(6)
    got = {r.i: r.n for r in ordering.numbered(df, ["x", "i"], by).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    wanted, seen = {}, Counter()
    for g, _, i in order:
        key = g if by else None
        wanted[i] = seen[key]
        seen[key] += 1
    assert got == wanted


def test_rare_grams_lose_no_similar_title(spark):
    """At several thresholds: titles made from one another by few changes, and short ones."""
    rng = random.Random(21)
    base = ["flood in the northern valley", "earthquake near the coast today", "ab", "abc", "abcdefg", "drought: crops fail again and again", "aaaaaaaaaaaa"]
    titles = list(base)
    for t in base * 12:
        chars = list(t)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(chars))
            chars[k : k + 1] = rng.choice([[], [rng.choice("abcxyz")], [chars[k], rng.choice("abc")]])
            chars = chars or ["q"]
        titles.append("".join(chars))
    events = spark.createDataFrame([(f"e{i}", i, t) for i, t in enumerate(titles)], "event_id string, ord long, title string")
    normal = [" ".join(t.lower().split()) for t in titles]
    for threshold in (0.92, 0.86, 0.7):
        wanted = {f"e{j}" for i, j in itertools.combinations(range(len(titles)), 2) if SequenceMatcher(None, normal[j], normal[i]).ratio() >= threshold}
        assert {r.event_id for r in dedupe.updated_events(events, threshold).collect()} == wanted


def test_situation_analysis_has_every_section_from_its_operator(spark, tmp_path):
    evidence = spark.createDataFrame(
        [
            ("e1", "Flood in Sofala", "s", "At least 12 people killed and 300 displaced; shelter and food needed. Road cut near Beira. Further flooding expected this week.", "Beira", "flood", "high", "2026-01-02", "c", "http://a", 1),
            ("e2", "Flood in Sofala", "s", "5 killed. Clean water needed.", "Sofala", "flood", "medium", "2026-01-03", "c", "http://b", 2),
        ],
        "event_id string, title string, summary string, text string, geo_area string, disaster_type string, severity string, published_at string, connector string, url string, id long",
    ).withColumns({"source_label": F.lit("Wire"), "admin_level": F.lit(1)})
    areas = spark.createDataFrame([("Sofala", 1, "", 1, ""), ("Beira", 2, "Sofala", 2, "")], "name string, admin_level int, parent string, ord int, iso3 string")
    geo, facts = ontology.geo_nodes(areas, "ord"), ontology.annotate(evidence)
    found = ontology.impacts(facts, "id", "admin_level")
    figures = ontology.explode_figures(found.filter("pos = 0"), "id", "geo_area", "reported_date", "source_label", "connector", "url").withColumnRenamed("id", "ord")
    needs = ontology.need_statements(facts)
    annex = spark.createDataFrame([("Sofala", "Beira")], "admin1 string, districts string")
    sources = spark.createDataFrame([(1, "http://a"), (2, "http://b")], "n long, url string")
    lines = render.analysis_lines(
        "Cyclone", ontology.national_figures_dated(figures), ontology.admin1_rollup(found.drop("admin_level"), geo).withColumnRenamed("admin1_key", "name"), ontology.admin2_rollup(found.drop("admin_level"), geo), ontology.sector_summary(needs),
        ontology.sector_by_area(needs), reports.access_constraints(facts, "text", "id"), ontology.risk_statements(facts), annex, sources,
    )
    text_ = render.document(lines).first().markdown
    for folder in ("a", "b"):  # the same text from files as from one row, whatever the number of ranges
        render.write_document(lines.repartition(3), str(tmp_path / folder))
        assert "\n".join(r.text for r in render.read_document(spark, str(tmp_path / folder)).orderBy("n").collect()) == text_
    parts = {p.split("\n", 1)[0]: p for p in text_.split("## ")[1:]}
    assert list(parts) == ["Executive Summary", "National Impact Overview", "Province-Level Impact", "District-Level Impact", "Shelter", "WASH", "Health", "Food Security", "Protection", "Education", "Access Constraints", "Outstanding Needs", "Forecast", "Annex", "Sources and References"]
    assert "| deaths | 17 | 2026-01-03 | Wire |" in parts["National Impact Overview"] and "| displaced | 300 |" in parts["National Impact Overview"]
    assert "| sofala | beira |" in parts["District-Level Impact"] and "| sofala |" in parts["Province-Level Impact"]
    assert "- shelter: 1" in parts["Outstanding Needs"] and "Beira (1)" in parts["Shelter"] and "No data." in parts["Education"]
    assert "Road cut near Beira" in parts["Access Constraints"] and "- flood, next 7d: 1 statements" in parts["Forecast"]
    assert "- Sofala: Beira" in parts["Annex"] and parts["Sources and References"].rstrip().endswith("1. http://a\n2. http://b")
    row = reports.analysis_score(spark.createDataFrame([(1, text_)], "doc_id long, markdown string")).first()
    assert row.section_completeness == 1.0 and row.citation_accuracy == 1.0


def test_quality_table(spark):
    scores = spark.createDataFrame([(1, 0.9, 0.1, 1.0, 1.0, 1.0, 0.2, 0.7, True)], "doc_id long, section_completeness double, key_figure_coverage double, citation_accuracy double, citation_density double, admin_coverage double, date_attribution double, overall_score double, passed boolean")
    lines = reports.quality_table(scores).first().markdown.split("\n")
    assert "### Quality Gate: **PASS** (score 0.70)" in lines and "| Key Figure Coverage | 0.10 | 0.30 | **Fail** |" in lines and "| Section Completeness | 0.90 | 0.70 | Pass |" in lines


def test_broken_feed_bytes(spark, tmp_path):
    (tmp_path / "feed.xml").write_bytes(b"<rss><channel><item><title>Caf\xe9 \xff</title><link>http://a</link></item><item><title>x</link></item><item><title>Good</title><link>http://b</link></item>")
    rows = feeds.read_feeds(spark, str(tmp_path)).collect()
    assert [r.link for r in rows if r._corrupt_record is None] == ["http://a", "http://b"] and sum(r._corrupt_record is not None for r in rows) == 1


def test_configuration_falls_back():
    broken, some = configuration.keywords("[impact"), configuration.keywords('[impact]\npeople_impact = ["lost"]')
    assert broken == configuration.keywords() and some.impacts["people_impact"] == ["lost"] and some.needs == broken.needs and some.risks == broken.risks
    assert configuration.template("no json") == configuration.template() and configuration.template("[1]")["name"] == "default-v1"
    assert configuration.template('{"name": " x ", "limits": {"method_max_words": 3}}')["limits"]["method_max_words"] == 3


def test_long_report_of_two_rows_and_of_none(spark):
    rows = [(1, "Flood A", "Nepal", "flood", "high", "high", 1, "sum a", "http://a", "c1"), (2, "Flood B", "Kenya", "flood", "low", "low", 4, "sum b", "http://b", "c2")]
    ranked = spark.createDataFrame(rows, "rank int, title string, country string, disaster_type string, severity string, confidence string, credibility_tier int, summary string, url string, connector string")
    report = render.long_report(ranked, "T", template=configuration.template('{"sections": {"method": "How it was made"}}'))
    assert "1. **Flood A**\n   - Nepal, flood, severity high, confidence high, UN/OCHA (Tier 1)\n   - sum a\n   - Citation: [1]" in report and "   - Citation: [2]" in report
    assert "| Nepal | 1 |" in report and "## How it was made" in report and report.rstrip().endswith("1. http://a\n2. http://b")
    assert render.long_report(ranked.limit(0), "T") == "# T\n\nNo evidence found for selected filters and cycles.\n"


def test_streaks_over_ranges_equal_the_state_machine(spark):
    rng = random.Random(13)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), i, rng.choices(["stale", "fresh", "unknown", None], [8, 1, 3, 1])[0]) for i in range(2000)]
    got = {r.check_id: r.stale_streak for r in health.stale_streaks(spark.createDataFrame(rows, "source_url string, check_id long, freshness string").repartition(5)).collect()}
    streak, wanted = Counter(), {}
    for source, i, freshness in rows:
        streak[source] = streak[source] + 1 if freshness == "stale" else 0 if freshness == "fresh" else streak[source]
        wanted[i] = streak[source]
    assert got == wanted


def test_analysis_patterns_run_once_and_over_several_tasks(spark, sf_dir):
    """A pattern stands once in the plan of the score, however many measures read what it finds; the few keys are spread before the reports are made."""
    from tidemark.operators import reports
    from tidemark.plans import more_queries

    made = more_queries._analyses(spark, sf_dir)
    assert made.rdd.getNumPartitions() > 1
    plan = reports.analysis_score(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?m)^##\s+(.+)") == 1


@pytest.mark.parametrize("name", ["jn04_unchanged", "jn06_updated", "dd09_status", "dd09_status_exact"])
def test_states_cluster_the_items_once(spark, sf_dir, name):
    """Events are written and read, not clustered anew by each reader."""
    from tidemark.plans import registry

    files = registry.queries()[name](spark, sf_dir).inputFiles()
    assert files and not [f for f in files if "orders.parquet" in f]


def test_admin1_figures_find_no_impacts(spark, sf_dir):
    """Figures are read from the rows, so no row is taken apart into its impacts."""
    from tidemark.plans import registry

    plan = registry.queries()["ag18_admin1_figures"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
