"""Further queries of sources, deduplication, health and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.dims import ANALYSIS_SECTIONS
from tidemark.operators import classify, dedupe, evidence, health, render, reports
from tidemark.plans.adapters import EV, events, read
from tidemark.plans.core_queries import _CLUSTERS, _ITEMS, _clusters
from tidemark.plans.graph_queries import _GEO, _MD, _analysis, _geo, _reports
from tidemark.plans.text_queries import _COUNTRIES3, _HAZARD, _NORM, _NT, _word
from tidemark.sources import configuration, documents, feeds
from tidemark.sources.shared import shared_folder
from tidemark.sources.tables import Warehouse

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


_DD01_TEXT = _NORM.format("concat_ws(' ', title, text, country)")
_HAZARDS5 = ["flood", "earthquake", "cyclone/storm", "drought", "conflict emergency"]


@query(
    "dd01_candidates",
    f"WITH {EV}, c AS (SELECT id AS ord, CASE " + " ".join(f"WHEN {_word([c.lower()], _DD01_TEXT)} THEN '{c}'" for c in _COUNTRIES3) + f" ELSE 'NATION_3' END AS country, {_HAZARD.replace(_NT, _DD01_TEXT)} AS disaster_type FROM ev) SELECT ord, country, disaster_type FROM c WHERE disaster_type IS NOT NULL",
)
def dd01(spark, sf_dir):
    items = events(spark, sf_dir).select(F.col("id").alias("ord"), "title", "text", F.array("country").alias("country_candidates"))
    return dedupe.candidates(items, _COUNTRIES3, _HAZARDS5).select("ord", "country", "disaster_type")


@query("dd03_title_clusters")
def dd03(spark, sf_dir):
    """DD03: the titles of all pages."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    return dedupe.cluster_titles(pages).select("ord", "title", "cluster")


@query("dd07_severity", f"WITH {EV}, {_ITEMS}, {_CLUSTERS} SELECT cluster, country, disaster_type, base AS base_level, CASE level WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity FROM sv")
def dd07(spark, sf_dir):
    return _clusters(spark, sf_dir).select("cluster", "country", "disaster_type", "base_level", dedupe.calibrated_severity(dedupe.calibrated_confidence()).alias("severity"))


@query("src02_broken_entries", "SELECT n_name AS title, 'http://f/' || n_nationkey::STRING AS url FROM nation WHERE n_nationkey % 5 <> 2")
def src02(spark, sf_dir):
    """SRC02: entries that are no XML, and bytes that are no UTF-8, don't cost the file's other entries."""
    folder = shared_folder(spark, "broken-feeds")
    key = F.col("n_nationkey").cast("string")
    good = F.concat(F.lit("<item><title>"), F.col("n_name"), F.lit("</title><link>http://f/"), key, F.lit("</link></item>"))
    bad = F.concat(F.lit("<item><title>"), F.col("n_name"), F.lit("</link><link>http://f/"), key, F.lit("</item>"))
    read(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 5 != 2, good).otherwise(bad).alias("value")).write.text(folder)
    return feeds.read_feeds(spark, folder).filter("_corrupt_record IS NULL AND link IS NOT NULL").select("title", F.col("link").alias("url"))


@query("so02_ordered_union", "WITH l AS (SELECT 'c' AS category, n_name AS name, 'u' || (n_nationkey % 7)::STRING AS url, n_nationkey AS ord, 0 AS layer FROM nation UNION ALL SELECT 'c', lower(n_name), 'U' || (n_nationkey % 7)::STRING, n_nationkey, 1 FROM nation UNION ALL SELECT 'c', r_name, 'u', r_regionkey, 1 FROM region), r AS (SELECT *, row_number() OVER (PARTITION BY category, lower(name), lower(url) ORDER BY layer, ord) AS n FROM l) SELECT name, url, row_number() OVER (ORDER BY layer, ord) - 1 AS place FROM r WHERE n = 1")
def so02(spark, sf_dir):
    """SO02: the union of two registries, in order, without what the first has already."""
    from tidemark.operators.ordering import numbered

    url = F.concat(F.lit("u"), (F.col("n_nationkey") % 7).cast("string"))
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    first = nation.select(F.lit("c").alias("category"), F.col("n_name").alias("name"), url.alias("url"), F.col("n_nationkey").cast("long").alias("ord"))
    second = first.select("category", F.lower("name").alias("name"), F.upper("url").alias("url"), "ord").union(region.select(F.lit("c"), "r_name", F.lit("u"), F.col("r_regionkey").cast("long")))
    return numbered(feeds.merge_registry(first, second), ["layer", "ord"], out="place").select("name", "url", "place")


@query("on05_hierarchy", f"WITH {_GEO} SELECT g.name AS district, p.name AS admin1 FROM geo g JOIN geo p ON g.parent = p.geo_key WHERE g.admin_level = 2")
def on05(spark, sf_dir):
    """ON05: districts under their admin1 areas, seeded from the gazetteer."""
    geo = _geo(spark, sf_dir)
    districts = geo.filter("admin_level = 2").select(F.col("name").alias("district"), "parent")
    return districts.join(geo.select(F.col("geo_key").alias("parent"), F.col("name").alias("admin1")), "parent").select("district", "admin1")


@query("wn04_facet_features", f"WITH {EV} SELECT id, count(*) OVER (PARTITION BY lower(severity)) AS facet_severity, count(*) OVER (PARTITION BY lower(url)) AS facet_url FROM ev")
def wn04(spark, sf_dir):
    return evidence.facets(events(spark, sf_dir), ("severity", "url")).select("id", "facet_severity", "facet_url")


@query("wn05_running_totals", f"WITH {EV}, c AS (SELECT cycle_id, count(*) AS events FROM ev GROUP BY cycle_id) SELECT cycle_id, events, sum(events) OVER (ORDER BY cycle_id)::BIGINT AS events_so_far FROM c")
def wn05(spark, sf_dir):
    return health.running_totals(events(spark, sf_dir))


@query("snk06_migration", f"WITH {EV} SELECT status, CASE WHEN connector = 'BBC' THEN 'old' ELSE 'new' END AS origin, count(*) AS events FROM ev GROUP BY ALL")
def snk06(spark, sf_dir):
    """SNK06: rows of an older version without a column, read together with newer ones and with its default."""
    store = Warehouse(spark, shared_folder(spark, "versions"))
    facts = events(spark, sf_dir).select("cycle_id", "status", "connector")
    store.append("notes", facts.filter("connector = 'BBC'"))
    store.append("notes", facts.filter("connector <> 'BBC'").withColumn("origin", F.lit("new")))
    return store.read("notes", origin="old").groupBy("status", "origin").agg(F.count(F.lit(1)).alias("events"))


@query("sl10_reports", f"WITH {_MD} SELECT doc_id, doc_id % 17 AS modified FROM md ORDER BY modified DESC, doc_id LIMIT 25")
def sl10(spark, sf_dir):
    return reports.listing(_reports(spark, sf_dir).withColumn("modified", F.col("doc_id") % 17), 25).select("doc_id", "modified")


# Analyses that have a section or not by the customer's key, and cite one source that they list and one that they may not.
_HAS = [f"(doc_id + {i}) % {2 + i % 3} <> 0" for i in range(len(ANALYSIS_SECTIONS) - 1)]


def _analyses(spark, sf_dir):
    # A file of keys is a few splits at most, and each key becomes a report, so they are spread before that; a number given is kept however small the partitions are.
    made = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    headings = [F.when(F.expr(has), F.concat(F.lit(f"## {name}\nas "), "doc_id")) for has, name in zip(_HAS, ANALYSIS_SECTIONS)]
    cited = F.concat(F.lit("Stated in [1] and ["), (F.col("doc_id") % 4).cast("string"), F.lit("]."))
    return made.withColumn("markdown", F.concat_ws("\n", F.lit("# Analysis"), cited, *headings, F.lit("## Sources and References\n1. https://a.org/x\n2. https://b.org/y")))


@query(
    "gt08_quality_table",
    "WITH c AS (SELECT c_custkey AS doc_id FROM customer), m AS (SELECT doc_id, (1 + " + " + ".join(f"({has})::INT" for has in _HAS) + f") / {len(ANALYSIS_SECTIONS)}.0::DOUBLE AS complete, CASE WHEN doc_id % 4 IN (1, 2) THEN 1.0 ELSE 0.5 END AS accurate FROM c) "
    "SELECT doc_id, format('| Section Completeness | {:.2f} | 0.70 | ', complete) || CASE WHEN complete >= 0.7 THEN 'Pass |' ELSE '**Fail** |' END AS completeness, format('| Citation Accuracy | {:.2f} | 0.80 | ', accurate::DOUBLE) || CASE WHEN accurate >= 0.8 THEN 'Pass |' ELSE '**Fail** |' END AS accuracy FROM m",
)
def gt08(spark, sf_dir):
    table = reports.quality_table(reports.analysis_score(_analyses(spark, sf_dir)))
    line = lambda name: F.regexp_extract("markdown", rf"(?m)^\| {name} .*$", 0)
    return table.select("doc_id", line("Section Completeness").alias("completeness"), line("Citation Accuracy").alias("accuracy"))


@query("ext03_routing", "SELECT page_id, CASE page_id % 4 WHEN 3 THEN 'skipped' ELSE CASE WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN 'none' ELSE 'read' END END AS method, CASE WHEN page_id % 4 = 3 OR page_id % 5 = 0 OR page_id % 7 = 0 THEN NULL ELSE ['layout,tables,plain text', 'main text,tags stripped', 'office'][page_id % 4 + 1] END AS readers FROM pages")
def ext03(spark, sf_dir):
    """EXT03: attachments by media type and size; a quarter is of a kind that is not read."""
    k = F.col("page_id")
    mime = F.when(k % 4 == 0, "application/pdf").when(k % 4 == 1, "text/html; charset=utf-8").when(k % 4 == 2, "application/msword").otherwise("image/png")
    size = F.when(k % 5 == 0, 0).when(k % 7 == 0, documents.MOST_BYTES + 1).otherwise(documents.MOST_BYTES)
    routed = documents.route(mime, size)
    return read(spark, sf_dir, "pages").select("page_id", routed["method"].alias("method"), F.array_join(routed["readers"], ",").alias("readers"))


@query("ext03_fallback", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'layout' WHEN 1 THEN 'plain text' ELSE 'none' END AS method, CASE page_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'c' ELSE '' END AS text FROM pages")
def ext03f(spark, sf_dir):
    """EXT03: the first reader that gave text."""
    k = F.col("page_id")
    tries = F.array(*[F.struct(F.lit(i).alias("try"), F.lit(m).alias("method"), t.alias("text")) for i, m, t in ((0, "layout", F.when(k % 3 == 0, "a")), (1, "tables", F.lit("  ")), (2, "plain text", F.when(k % 3 < 2, "c")))])
    return documents.first_success(read(spark, sf_dir, "pages").select("page_id", F.inline(tries)), "page_id")


@query("st05_age_filter_stream", f"WITH {EV} SELECT id FROM ev WHERE published_at = '' OR published_at >= '1996-01-01'")
def st05(spark, sf_dir):
    """ST05: a stream that leaves out what is older than a day given; undated items pass, and no watermark is kept."""
    folder = shared_folder(spark, "dated")
    rows = events(spark, sf_dir).select("id", "published_at")
    rows.write.parquet(f"{folder}/in")
    fresh = spark.readStream.schema(rows.schema).parquet(f"{folder}/in").filter("published_at = '' OR published_at >= '1996-01-01'").select("id")
    fresh.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(fresh.schema).parquet(f"{folder}/out")


@query("rn05_forecast_lines")
def rn05f(spark, sf_dir):
    """RN05: the lines of the analysis after the sectors."""
    return _analysis(spark, sf_dir, first=20)


@query(
    "snk04_report_file",
    "WITH l AS (SELECT 0 AS part, '' AS place, '# Suppliers' AS text UNION ALL SELECT 1, lpad(s_suppkey::STRING, 12, '0'), '| ' || s_name || ' | ' || n_name || ' |' FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 2, lpad(n_nationkey::STRING, 12, '0'), '- ' || n_name FROM nation) "
    "SELECT row_number() OVER (ORDER BY part, place, text) - 1 AS n, text FROM l",
)
def snk04(spark, sf_dir):
    """SNK04: a Markdown document with a line for each supplier and nation, written by ranges and read back."""
    folder = shared_folder(spark, "report")
    nation, supplier = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    place = lambda c: F.lpad(F.col(c).cast("string"), 12, "0").alias("place")
    rows = render.table_rows(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "n_name").select(F.lit(1).alias("part"), place("s_suppkey"), F.col("line").alias("text"))
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit("").alias("place"), F.lit("# Suppliers").alias("text"))
    render.write_document(head.union(rows).union(nation.select(F.lit(2), place("n_nationkey"), F.concat(F.lit("- "), "n_name"))), folder)
    return render.read_document(spark, folder)


_KEYWORDS = """[need]
shelter = ["houses", "roof"]
[risk]
keywords = ["emergency"]
"""


@query("on09_configured_words", f"WITH {EV} SELECT id, contains(lower(text), 'houses') OR contains(lower(text), 'roof') AS shelter, contains(lower(text), 'emergency') AS risk FROM ev")
def on09(spark, sf_dir):
    """ON09: word tables of a configuration in place of the built-in ones."""
    words = configuration.keywords(_KEYWORDS)
    return events(spark, sf_dir).select("id", F.array_contains(classify.needs(F.col("text"), words.needs), "shelter").alias("shelter"), classify.is_risk(F.col("text"), words.risks).alias("risk"))


@query(
    "rn06_template",
    "WITH d AS (SELECT unnest(['sections', 'sections', 'limits']) AS part, unnest(['method', 'citations', 'max_incident_highlights']) AS key, unnest(['Method', 'Citations', '12']) AS value) "
    "SELECT n_name AS report, part, key, CASE WHEN n_nationkey % 3 = 0 AND key = 'method' THEN 'How ' || n_name WHEN n_nationkey % 3 < 2 AND key = 'max_incident_highlights' THEN (n_nationkey + 1)::STRING ELSE value END AS value FROM nation, d",
)
def rn06(spark, sf_dir):
    """RN06: a template for each nation, laid over the default one; a third give a heading and a limit, a third a limit, and a third are broken."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    limits = F.concat(F.lit('"limits": {"max_incident_highlights": '), (k + 1).cast("string"), F.lit("}"))
    text = F.when(k % 3 == 0, F.concat(F.lit('{"sections": {"method": "How '), name, F.lit('"}, '), limits, F.lit("}"))).when(k % 3 == 1, F.concat(F.lit("{"), limits, F.lit("}"))).otherwise('{"limits": ')
    merged = configuration.templates(read(spark, sf_dir, "nation").select(name.alias("report"), text.alias("template")))
    return merged.filter("key IN ('method', 'citations', 'max_incident_highlights')").select("report", "part", "key", "value")


_REGISTRY = "rg AS (SELECT ['government', 'un', 'ngo', 'local_news'][page_id % 4 + 1] AS category, lower(url) AS url FROM pages), fd AS (SELECT DISTINCT category, url FROM rg)"


def _registry(spark, sf_dir):
    """A registry with a feed for each page, given twice with names in other cases."""
    category = F.element_at(F.array(*[F.lit(c) for c in configuration.CONNECTORS]), (F.col("page_id") % 4 + 1).cast("int"))
    layer = read(spark, sf_dir, "pages").select(category.alias("category"), F.concat(F.lit("Feed of "), "url").alias("name"), "url", F.col("page_id").alias("ord"))
    return feeds.merge_registry(layer, layer.withColumns({"name": F.upper("name"), "url": F.upper("url")}))


@query("ag30_feed_counts", f"WITH {_REGISTRY} SELECT category, count(*) AS feeds FROM fd GROUP BY category")
def ag30(spark, sf_dir):
    return feeds.feed_counts(_registry(spark, sf_dir))


@query("src08_connectors", f"WITH {_REGISTRY}, k AS (SELECT unnest(['government', 'un', 'ngo', 'local_news']) AS category, unnest(['government_feeds', 'un_humanitarian_feeds', 'ngo_feeds', 'local_news_feeds']) AS connector, unnest(['official', 'humanitarian', 'humanitarian', 'news']) AS source_type) SELECT connector, source_type, count(*) AS feeds FROM fd JOIN k USING (category) GROUP BY ALL")
def src08(spark, sf_dir):
    """SRC08: the connector and kind of source of each feed of a registry."""
    return configuration.connectors(spark, _registry(spark, sf_dir)).groupBy("connector", "source_type").agg(F.count(F.lit(1)).alias("feeds"))
