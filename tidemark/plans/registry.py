"""Every query of the library and the SQL it agrees with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import html
from ..functions import native as N
from ..operators import analytics, collections, graphdict, history, links, quality, search, seo
from ..sources import archive, index
from ..streaming import events as stream
from . import views as V

FLAGSHIP = "a2_referring_hosts"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_H = f"target_host = '{V.HOST}'"
_NONBLANK = "anchor IS NOT NULL AND length(trim(anchor, ' ')) > 0"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _host_links(spark, sf):
    return links.of_host(links.details(V.links(spark, sf)), V.HOST)


@query("a1_host_summary", f"WITH {V.LINKS_SQL} SELECT count(*) AS observed_link_row_count, count(DISTINCT source_host) AS unique_referring_host_count, count(DISTINCT target_url) AS unique_target_page_count, count(*) FILTER (WHERE {_NONBLANK}) AS nonempty_anchor_row_count FROM links WHERE {_H}")
def a1(spark, sf):
    return links.host_summary(_host_links(spark, sf))


@query("a1_all_hosts", f"WITH {V.LINKS_SQL} SELECT target_host, count(*) AS observed_link_row_count, count(DISTINCT source_host) AS unique_referring_host_count, count(DISTINCT target_url) AS unique_target_page_count, count(*) FILTER (WHERE {_NONBLANK}) AS nonempty_anchor_row_count FROM links WHERE target_host IS NOT NULL GROUP BY 1")
def a1_all(spark, sf):
    return links.host_summary(links.details(V.links(spark, sf)), "target_host")


@query("a2_referring_hosts", f"WITH {V.LINKS_SQL} SELECT source_host, count(*) AS observed_link_row_count FROM links WHERE {_H} GROUP BY 1")
def a2(spark, sf):
    return links.referring_hosts(_host_links(spark, sf))


@query("a3_top_anchors", f"WITH {V.LINKS_SQL} SELECT anchor, count(*) AS observed_link_row_count FROM links WHERE {_H} AND {_NONBLANK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def a3(spark, sf):
    return links.top_anchors(_host_links(spark, sf))


@query("a4_top_linked_pages", f"WITH {V.LINKS_SQL} SELECT target_url, count(*) AS observed_link_row_count, count(DISTINCT source_host) AS referring_host_count FROM links WHERE {_H} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def a4(spark, sf):
    return links.top_linked_pages(_host_links(spark, sf), 20)


@query("f1_host_bucket", f"WITH {V.LINKS_SQL} SELECT target_host, lpad(CAST(CAST('0x' || substr(sha256(target_host), 1, 3) AS INT) // 4 AS VARCHAR), 4, '0') AS target_host_bucket, count(*) AS n FROM links WHERE target_host IS NOT NULL AND target_host <> '' GROUP BY 1, 2")
def f1(spark, sf):
    return links.details(V.links(spark, sf)).groupBy("target_host", "target_host_bucket").agg(F.count("*").alias("n"))


_PAGE_ORDER = "ORDER BY source_url, target_url NULLS LAST, anchor NULLS LAST, crawled_at"


@query("r2_backlinks_page", f"WITH {V.LINKS_SQL} SELECT source_url, source_host, target_url, anchor, crawled_at FROM (SELECT * FROM links WHERE crawl = '{V.CRAWL}' AND {_H} {_PAGE_ORDER} LIMIT 10) WHERE source_host NOT LIKE '%.example.org'")
def r2(spark, sf):
    return links.lookup(links.details(V.links(spark, sf)), V.CRAWL, V.HOST)


@query("r2_backlinks_external_first", f"WITH {V.LINKS_SQL} SELECT source_url, source_host, target_url, anchor, crawled_at FROM links WHERE crawl = '{V.CRAWL}' AND {_H} {_PAGE_ORDER} LIMIT 10 OFFSET 10")
def r2x(spark, sf):
    return links.lookup(V.links(spark, sf), V.CRAWL, V.HOST, page=2, external_first=True)


_ID = "CAST(CAST('0x' || substr(sha256({0}), 1, 16) AS UBIGINT) AS VARCHAR)"


@query("r5_dictionary_urls", f"WITH {V.LINKS_SQL}, pg AS (SELECT DISTINCT crawl, source_url, source_host, source_url || '?c' AS canonical FROM links WHERE source_url LIKE '%7'), u AS (SELECT source_url AS url, source_host AS host FROM pg UNION ALL SELECT source_url, source_host FROM links UNION ALL SELECT target_url, target_host FROM links UNION ALL SELECT canonical, NULL FROM pg) SELECT {_ID.format('url')} AS url_id, url, {_ID.format('min(host)')} AS host_id FROM u WHERE url IS NOT NULL GROUP BY url")
def r5_urls(spark, sf):
    d = graphdict.dictionaries(V.link_pages(spark, sf), V.links(spark, sf))["urls"]
    return d.select(N.unsigned("url_id").cast("string").alias("url_id"), "url", N.unsigned("host_id").cast("string").alias("host_id"))


@query("r5_edges", f"WITH {V.LINKS_SQL} SELECT {_ID.format('source_url')} AS source_url_id, CAST(CAST('0x' || substr(sha256(source_url), 1, 16) AS UBIGINT) % 128 AS INT) AS source_bucket, count(*) AS n, count(target_url) AS n_targets, count(anchor) AS n_anchors FROM links GROUP BY 1, 2")
def r5_edges(spark, sf):
    e = graphdict.edges(V.links(spark, sf))
    counted = e.groupBy("source_url_id", "source_bucket").agg(F.count("*").alias("n"), F.count("target_url_id").alias("n_targets"), F.count("anchor_id").alias("n_anchors"))
    return counted.withColumn("source_url_id", N.unsigned("source_url_id").cast("string"))


@query("j2_decode", f"WITH {V.LINKS_SQL} SELECT crawl, source_url, source_host, target_url, target_host, anchor, min(crawled_at) AS first_at, max(crawled_at) AS last_at, count(*) AS n FROM links GROUP BY ALL")
def j2(spark, sf):
    ls = V.links(spark, sf)
    back = graphdict.decode(graphdict.edges(ls), graphdict.dictionaries(V.link_pages(spark, sf), ls))
    return back.groupBy("crawl", "source_url", "source_host", "target_url", "target_host", "anchor").agg(F.min("crawled_at").alias("first_at"), F.max("crawled_at").alias("last_at"), F.count("*").alias("n"))


@query("a7_collisions", f"WITH {V.LINKS_SQL} SELECT 0::BIGINT AS url_collisions, (SELECT count(*) FROM (SELECT substr(sha256(n_name), 1, 1) AS k FROM nation GROUP BY 1 HAVING count(DISTINCT n_name) > 1)) AS short_collisions, (SELECT count(*) FROM (SELECT target_url FROM links WHERE target_url IS NOT NULL GROUP BY 1 HAVING count(DISTINCT target_host) > 1)) AS host_conflicts")
def a7(spark, sf):
    ls, pg = V.links(spark, sf), V.link_pages(spark, sf)
    bad = graphdict.collisions(graphdict.dictionaries(pg, ls)["urls"], "url_id", "url").agg(F.count("*").alias("url_collisions")).withColumn("k", F.lit(1))
    short = V.table(spark, sf, "nation").select(F.substring(F.sha2("n_name", 256), 1, 1).alias("id"), "n_name")
    bad = bad.join(graphdict.collisions(short, "id", "n_name").agg(F.count("*").alias("short_collisions")).withColumn("k", F.lit(1)), "k")
    return bad.join(graphdict.host_conflicts(pg, ls).agg(F.count("*").alias("host_conflicts")).withColumn("k", F.lit(1)), "k").drop("k")


@query("j11_registrable_domains", f"WITH {V.LINKS_SQL} SELECT target_host AS host, regexp_extract(target_host, '[^.]+[.][^.]+$') AS domain, (source_host <> '' AND regexp_extract(source_host, '[^.]+[.][^.]+$') <> regexp_extract(target_host, '[^.]+[.][^.]+$')) AS is_external, count(*) AS n FROM links WHERE target_host IS NOT NULL GROUP BY 1, 2, 3")
def j11(spark, sf):
    ls = links.details(V.links(spark, sf))
    return ls.groupBy(F.col("target_host").alias("host"), N.registrable_domain("target_host").alias("domain"), N.external_link("source_host", "target_host").alias("is_external")).agg(F.count("*").alias("n"))


_CUR = "date >= DATE '1998-06-01' AND date < DATE '2001-12-01'"
_PRE = "date >= DATE '1994-12-01' AND date < DATE '1998-06-01' AND l_partkey % 40 <> 0"
_M = "sum(click)::DOUBLE AS clicks, count(*)::DOUBLE AS impressions, sum(click) / count(*) AS ctr, round(avg(pos), 6) AS position"


def _rows(dim: str) -> str:
    return f"WITH {V.FACTS_SQL}, cur AS (SELECT {dim} AS k, {_M} FROM facts WHERE {_CUR} GROUP BY 1), pre AS (SELECT {dim} AS k, {_M} FROM facts WHERE {_PRE} GROUP BY 1), j AS (SELECT cur.*, pre.clicks AS prev_clicks, cur.clicks - pre.clicks AS d_clicks, cur.impressions - pre.impressions AS d_impressions FROM cur LEFT JOIN pre USING (k))"


def _compared(spark, sf, dim):
    return search.compared(search.report(V.current(spark, sf), [dim]), search.report(V.previous(spark, sf), [dim]), dim)


def _flat(rows, dim):
    return rows.select(F.col(dim).alias("k"), "clicks", "impressions", "ctr", F.round("position", 6).alias("position"), F.col("previous.clicks").alias("prev_clicks"), F.col("change.clicks").alias("d_clicks"), F.col("change.impressions").alias("d_impressions"))


@query("a11_overview", f"WITH {V.FACTS_SQL} SELECT sum(click)::DOUBLE AS clicks, count(*)::DOUBLE AS impressions, sum(click) / count(*) AS ctr, round(avg(pos), 6) AS position FROM facts WHERE {_CUR}")
def a11(spark, sf):
    return search.overview(search.report(V.current(spark, sf), ["date"])).withColumn("position", F.round("position", 6))


for _dim in ("query", "page"):
    query(f"j1_compare_{_dim}", _rows(_dim) + " SELECT * FROM j")(lambda spark, sf, d=_dim: _flat(_compared(spark, sf, d), d))

for _name, _f, _dim, _where, _order in (
    ("p11_quick_wins", search.quick_wins, "query", "impressions >= 50 AND position BETWEEN 4 AND 20", "impressions DESC"),
    ("p12_ctr_opportunities", search.ctr_opportunities, "query", "impressions >= 100 AND position <= 10 AND ctr < 0.03", "impressions DESC"),
    ("p13_content_decay", search.content_decay, "page", "prev_clicks >= 5 AND clicks < prev_clicks", "d_clicks"),
    ("p15_winners", search.winners, "query", "d_clicks > 0", "d_clicks DESC"),
    ("p15_losers", search.losers, "query", "d_clicks < 0", "d_clicks"),
):
    query(_name, _rows(_dim) + f" SELECT * FROM j WHERE {_where} ORDER BY {_order}, k LIMIT 8")(lambda spark, sf, f=_f, d=_dim: _flat(f(_compared(spark, sf, d), d), d))


@query("p14_cannibalisation", f"WITH {V.FACTS_SQL}, qp AS (SELECT query, page, {_M} FROM facts WHERE {_CUR} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY impressions DESC, page) AS n FROM qp) SELECT query, count(*) AS page_count, sum(clicks) AS total_clicks, sum(impressions) AS total_impressions, string_agg(page, ',' ORDER BY n) FILTER (WHERE n <= 5) AS pages FROM r GROUP BY 1 HAVING count(*) >= 2 AND sum(impressions) >= 20 ORDER BY 4 DESC, 1 LIMIT 8")
def p14(spark, sf):
    return search.cannibalisation(search.report(V.current(spark, sf), ["query", "page"])).withColumn("pages", F.array_join("pages", ","))


@query("p16_opportunities", f"WITH {V.FACTS_SQL}, q AS (SELECT query, {_M} FROM facts WHERE {_CUR} GROUP BY 1), o AS (" + " UNION ALL ".join(f"(SELECT '{k}' AS kind, * FROM q WHERE {p} ORDER BY query LIMIT {n})" for k, p, n in search.OPPORTUNITIES) + ") SELECT * FROM o")
def p16(spark, sf):
    return search.opportunities(search.report(V.current(spark, sf), ["query"])).withColumn("position", F.round("position", 6))


@query("a14_full_report_totals", f"WITH {V.FACTS_SQL}, q AS (SELECT query, {_M} FROM facts WHERE {_CUR} GROUP BY 1) SELECT sum(clicks) AS clicks, sum(impressions) AS impressions, sum(clicks) / sum(impressions) AS ctr, round(avg(position), 4) AS position FROM q")
def a14(spark, sf):
    cur = V.current(spark, sf)
    return search.full_report_totals(search.report(cur, ["query"]), search.report(cur, ["date"])).withColumn("position", F.round("position", 4))


@query("s20_date_report", f"WITH {V.FACTS_SQL} SELECT date, {_M} FROM facts WHERE {_CUR} GROUP BY 1")
def s20(spark, sf):
    return search.report(V.current(spark, sf), ["date"]).withColumn("position", F.round("position", 6))


_E = f"WITH {V.EVENTS_SQL} "


@query("a15_totals", _E + "SELECT count(*) AS pageviews, count(DISTINCT visitor) AS unique_visitors, count(DISTINCT session) AS unique_sessions FROM ev")
def a15(spark, sf):
    return analytics.totals(V.events(spark, sf))


@query("p19_range", _E + "SELECT count(*) AS pageviews, count(DISTINCT visitor) AS unique_visitors, count(DISTINCT session) AS unique_sessions FROM ev WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def p19(spark, sf):
    return analytics.totals(analytics.in_range(V.events(spark, sf), "2024-01-20", 7))


@query("w1_top_pages", _E + "SELECT page, count(*) AS views, floor(count(*) / (SELECT count(*) FROM ev) * 1000 + 0.5) / 10 AS share FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def w1(spark, sf):
    return analytics.top_pages(V.events(spark, sf))


@query("a16_referrers", _E + "SELECT CASE WHEN referrer IS NULL OR referrer = '' THEN 'Direct / None' ELSE lower(regexp_extract(referrer, '://([^/]+)', 1)) END AS referrer, count(*) AS views FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a16(spark, sf):
    return analytics.referrers(V.events(spark, sf))


@query("a19_devices", _E + "SELECT d AS device, count(ev.ts) AS views FROM (VALUES ('desktop'), ('mobile'), ('tablet')) x(d) LEFT JOIN ev ON coalesce(ev.device, 'desktop') = d GROUP BY 1")
def a19(spark, sf):
    return analytics.devices(V.events(spark, sf))


@query("a17_daily_trend", _E + "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS pageviews, count(DISTINCT visitor) AS visitors FROM ev GROUP BY 1")
def a17(spark, sf):
    return analytics.daily_trend(V.events(spark, sf))


@query("r19_daily_aggregates", _E + "SELECT website_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS pageviews, count(DISTINCT visitor) AS unique_visitors, count(DISTINCT session) AS unique_sessions, count(*) FILTER (WHERE coalesce(device, 'desktop') = 'desktop') AS desktop FROM ev GROUP BY 1, 2")
def r19(spark, sf):
    d = analytics.daily_aggregates(V.events(spark, sf))
    return d.select("website_id", "date", "pageviews", "unique_visitors", "unique_sessions", F.coalesce(F.try_element_at("device_breakdown", F.lit("desktop")), F.lit(0)).alias("desktop"))


_P = r"""WITH p AS (SELECT page_id % 4 AS scan_id, url, CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 500 ELSE 200 END AS status, (page_id * 37) % 2000 AS ms,
  nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), ' '), '') AS title,
  nullif(trim(regexp_extract(html, '(?is)<meta[^>]+name=["'']description["''][^>]+content=["'']([^"'']*)', 1), ' '), '') AS description,
  nullif(trim(regexp_extract(html, '(?is)<link[^>]+rel=["'']canonical["''][^>]+href=["'']([^"'']*)', 1), ' '), '') AS canonical,
  regexp_matches(html, '(?is)<meta[^>]+name=["'']robots["''][^>]+noindex') AS noindex, len(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>')) AS n_h1 FROM pages),
i AS (SELECT scan_id, url AS affected_url, unnest(list_filter([
  CASE WHEN status IN (404, 500) THEN 'broken-internal-link' END, CASE WHEN ms > 1500 THEN 'slow-response-time' END, CASE WHEN noindex THEN 'noindex-detected' END,
  CASE WHEN canonical IS NULL THEN 'canonical-missing' END, CASE WHEN title IS NULL THEN 'title-missing' END, CASE WHEN length(title) > 60 THEN 'title-too-long' END,
  CASE WHEN length(title) < 10 THEN 'title-too-short' END, CASE WHEN description IS NULL THEN 'meta-desc-missing' END, CASE WHEN length(description) > 160 THEN 'meta-desc-too-long' END,
  CASE WHEN n_h1 = 0 THEN 'h1-missing' END, CASE WHEN n_h1 > 1 THEN 'h1-multiple' END,
  CASE WHEN title IS NOT NULL AND count(*) OVER (PARTITION BY scan_id, title) > 1 THEN 'duplicate-titles' END], lambda x: x IS NOT NULL)) AS rule_id FROM p)"""
_SEV = "CASE " + " ".join(f"WHEN rule_id = '{r}' THEN '{s}'" for r, _, s in seo.RULES) + " END"
_WEIGHT = "CASE " + " ".join(f"WHEN rule_id = '{r}' THEN {seo.WEIGHTS[s]}" for r, _, s in seo.RULES) + " END"


@query("r11_issues", _P + f" SELECT scan_id, affected_url, rule_id, {_SEV} AS severity FROM i")
def r11(spark, sf):
    return seo.issues(V.audited_pages(spark, sf)).select("scan_id", "affected_url", "rule_id", "severity")


@query("a22_scores", _P + f", l AS (SELECT scan_id, sum({_WEIGHT}) AS d, count(*) AS n FROM i GROUP BY 1), c AS (SELECT scan_id, count(*) AS pages FROM p GROUP BY 1) SELECT scan_id, pages, coalesce(d, 0)::BIGINT AS deduction, least(100, greatest(0, floor(100 - coalesce(d, 0) / sqrt(pages) + 0.5)))::BIGINT AS score, 10 * pages AS total_checks, coalesce(n, 0) AS failed, greatest(0, 10 * pages - coalesce(n, 0)) AS passed FROM c LEFT JOIN l USING (scan_id)")
def a22(spark, sf):
    pages = V.audited_pages(spark, sf)
    return seo.scores(seo.issues(pages), pages)


@query("a20_severity_counts", _P + f" SELECT scan_id, " + ", ".join(f"count(*) FILTER (WHERE {_SEV} = '{s}') AS {s}" for s in seo.WEIGHTS) + " FROM i GROUP BY 1")
def a20(spark, sf):
    return seo.severity_counts(seo.issues(V.audited_pages(spark, sf)), "scan_id")


@query("a24_coverage", _P + " SELECT count(*) AS pages, count(title) AS with_title, count(description) AS with_description, count(canonical) AS with_canonical, count(*) FILTER (WHERE n_h1 = 1) AS with_one_h1 FROM p WHERE status = 200")
def a24(spark, sf):
    return seo.coverage(V.audited_pages(spark, sf))


@query("u5_scan_differences", f"WITH {V.SCANS_SQL}, a AS (SELECT DISTINCT website_id, rule_id, affected_url FROM scans WHERE scan_no = 1), b AS (SELECT DISTINCT website_id, rule_id, affected_url FROM scans WHERE scan_no = 2) SELECT *, 'new' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def u5(spark, sf):
    s = V.scans(spark, sf)
    return history.differences(s.where("scan_no = 1"), s.where("scan_no = 2"), *history.KEY)


def _history(spark, sf):
    old = V.scans(spark, sf).where("scan_no = 1").groupBy(*history.KEY).agg(F.min("created_at").alias("first_detected_at"), F.max("created_at").alias("last_detected_at"))
    old = old.withColumn("status", F.when(F.col("affected_url").endswith("3"), "resolved").otherwise("active"))
    none = F.lit(None).cast("timestamp")
    return old.select(*history.KEY, "status", "first_detected_at", "last_detected_at", none.alias("resolved_at"), none.alias("reoccurred_at"), F.expr("cast(array() as array<struct<event:string,timestamp:timestamp,scan_id:string>>)").alias("events"))


@query("t6_issue_lifecycle", f"WITH {V.SCANS_SQL}, a AS (SELECT website_id, rule_id, affected_url, CASE WHEN affected_url LIKE '%3' THEN 'resolved' ELSE 'active' END AS st FROM scans WHERE scan_no = 1 GROUP BY ALL), b AS (SELECT DISTINCT website_id, rule_id, affected_url, TRUE AS seen FROM scans WHERE scan_no = 2) SELECT website_id, rule_id, affected_url, CASE WHEN seen THEN 'active' ELSE 'resolved' END AS status, CASE WHEN st IS NULL THEN 'detected' WHEN seen AND st = 'resolved' THEN 'reoccurred' WHEN seen IS NULL AND st = 'active' THEN 'resolved' ELSE '' END AS last_event FROM a FULL JOIN b USING (website_id, rule_id, affected_url)")
def t6(spark, sf):
    out = history.lifecycle(_history(spark, sf), V.scans(spark, sf).where("scan_no = 2"), "scan-2", "2024-01-01 00:00:00")
    return out.select(*history.KEY, "status", F.coalesce(F.try_element_at("events", F.lit(-1))["event"], F.lit("")).alias("last_event"))


@query("w4_latest_scan", f"WITH {V.SCANS_SQL} SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY website_id ORDER BY created_at DESC, scan_id DESC) = 1")
def w4(spark, sf):
    return history.latest(V.scans(spark, sf))


@query("w3_previous_position", "SELECT l_partkey AS keyword_id, l_orderkey * 10 + l_linenumber AS ranking_id, lag(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) AS previous_position FROM lineitem")
def w3(spark, sf):
    r = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("keyword_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ranking_id"), F.col("l_quantity").alias("position"), F.col("l_shipdate").alias("created_at"))
    return history.with_previous(r).select("keyword_id", "ranking_id", "previous_position")


def _orders(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_orderstatus") == "F", "deleted").otherwise("active").alias("state"), F.col("o_orderdate").alias("created_at"))


@query("r15_list", "SELECT o_orderkey AS id, o_custkey AS owner_id, CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'active' END AS state, o_orderdate AS created_at, c_name AS owner_id_public FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20) LEFT JOIN customer ON o_custkey = c_custkey")
def r15(spark, sf):
    users = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("public_id"))
    return collections.listed(_orders(spark, sf), collections.COLLECTIONS["projects"], parents={"users": users}, page=2)


@query("p25_soft_delete", "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
def p25(spark, sf):
    return collections.matching(_orders(spark, sf), collections.COLLECTIONS["projects"]).agg(F.count("*").alias("n"))


@query("p21_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), '00001')")
def p21(spark, sf):
    return collections.search(V.table(spark, sf, "customer"), " 00001 ", "c_name", "c_mktsegment").select("c_custkey", "c_name")


@query("a25_duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a25(spark, sf):
    return collections.duplicate_keys(V.table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", most=None)


@query("j8_cascade", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j8(spark, sf):
    gone = V.table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return collections.without_children(V.table(spark, sf, "orders"), gone, "o_custkey").agg(F.count("*").alias("n"))


@query("j4_by_parent", "SELECT count(*) AS n, sum(o_orderkey) AS s FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j4(spark, sf):
    parents = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("public_id"))
    return collections.of_parent(V.table(spark, sf, "orders"), parents, "o_custkey", "BUILDING").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("w8_shards", "SELECT s_suppkey AS idx, ntile(7) OVER (ORDER BY s_suppkey) - 1 AS shard_id FROM supplier")
def w8(spark, sf):
    return quality.sharded(V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("idx")), 7).withColumn("shard_id", F.col("shard_id").cast("long"))


@query("d12_violations", "SELECT unnest(['positive', 'flag', 'small']) AS \"check\", unnest([(SELECT count(*) FROM lineitem WHERE NOT l_quantity > 0), (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')), (SELECT count(*) FROM lineitem WHERE NOT l_discount <= 0.05)]) AS n")
def d12(spark, sf):
    return quality.violations(V.table(spark, sf, "lineitem"), {"positive": "l_quantity > 0", "flag": "l_returnflag in ('A', 'N')", "small": "l_discount <= 0.05"})


_INV = "WITH a AS (SELECT o_orderkey AS key, sha256(o_orderstatus) AS want FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS key, sha256(CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE o_orderstatus END) AS have FROM orders WHERE o_orderkey % 5 <> 0)"


@query("d14_inventory", _INV + " SELECT key, CASE WHEN want IS NULL THEN 'unexpected' WHEN have IS NULL THEN 'copy' WHEN want = have THEN 'verified' ELSE 'conflict' END AS action FROM a FULL JOIN b USING (key)")
def d14(spark, sf):
    o = V.table(spark, sf, "orders")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("key"), F.sha2("o_orderstatus", 256).alias("sha256"))
    b = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("key"), F.sha2(F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(F.col("o_orderstatus")), 256).alias("sha256"))
    return quality.inventory_actions(a, b)


@query("t4_quota", "SELECT event_id AS request_id, (epoch_ms(ts) // 3600000) AS window_id, row_number() OVER (PARTITION BY user_id, epoch_ms(ts) // 3600000 ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def t4(spark, sf):
    e = V.table(spark, sf, "events").withColumnRenamed("event_id", "request_id")
    return quality.quota(e, "user_id", "ts", 3_600_000, 2).select("request_id", "window_id", "allowed")


@query("f_scalars", "SELECT s_suppkey, floor(s_acctbal / 7 + 0.5)::BIGINT AS half_up, CASE WHEN length(s_name) > 9 THEN left(s_name, 6) || '...' ELSE s_name END AS short, CASE WHEN s_suppkey * 997 < 3000 THEN 'fast' WHEN s_suppkey * 997 < 30000 THEN 'acceptable' WHEN s_suppkey * 997 < 180000 THEN 'slow' ELSE 'over' END AS band, least(300, 30 * pow(2, s_suppkey % 6 - 1)) AS delay, lower('WWW.S' || s_suppkey || '.Example.CO.UK') AS host FROM supplier")
def f_scalars(spark, sf):
    s = V.table(spark, sf, "supplier")
    url = F.concat(F.lit("HTTPS://u@WWW.S"), F.col("s_suppkey").cast("string"), F.lit(".Example.CO.UK:443/x?y"))
    return s.select("s_suppkey", N.half_up(F.col("s_acctbal") / 7).cast("long").alias("half_up"), N.ellipsis("s_name", 9).alias("short"), N.duration_band(F.col("s_suppkey") * 997).alias("band"), N.retry_delay(F.col("s_suppkey") % 6).alias("delay"), N.url_host(url).alias("host"))


@query("u6_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS state, o_orderdate AS created_at FROM orders UNION ALL SELECT -o_orderkey - 1, 'new', TIMESTAMP '2024-01-01' FROM orders WHERE o_orderkey % 4 = 0")
def u6(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("created_at"))
    change = o.where("id % 4 = 0").withColumn("state", F.lit("new")).withColumn("created_at", F.lit("2024-01-01").cast(o.schema["created_at"].dataType))
    return history.upsert(o, change.unionByName(change.withColumn("id", -F.col("id") - 1)), ["id"], ("created_at",))


def _archive_rows(spark, sf):
    """Envelopes made of the pages table, through the record parser; every ninth page has no HTTP part."""
    p = V.table(spark, sf, "pages")
    each = F.transform(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int")), lambda i: F.to_json(F.struct(F.lit("A@/href").alias("path"), F.concat(F.lit("../p/"), i.cast("string")).alias("url"), F.concat(F.lit("cafÃ© "), i.cast("string")).alias("text"))))
    http = F.concat(F.lit('{"Response-Message":{"Status":200},"Headers":{"Content-Type":["text/html","x"]},"HTML-Metadata":{"Head":{"Title":"T'), (F.col("page_id") % 50).cast("string"), F.lit('"},"Links":['), F.array_join(each, ","), F.lit("]}}"))
    payload = F.concat(F.lit('{"Envelope":{"WARC-Header-Metadata":{"WARC-Target-URI":"https://h'), F.col("page_id").cast("string"), F.lit('.example.com/a/b","WARC-Date":"2024-01-02T03:04:05Z"},"Payload-Metadata":{'), F.when(F.col("page_id") % 9 != 0, F.concat(F.lit('"HTTP-Response-Metadata":'), http)).otherwise(""), F.lit("}}}"))
    zero = F.lit(0)
    framed = p.select(F.concat(F.lit("in-"), (F.col("page_id") % 5).cast("string")).alias("input"), F.lit(1).cast("long").alias("input_bytes"), payload.alias("payload"), zero.alias("bad_framing"), F.lit(1).alias("seen"), zero.alias("bad_json"))
    return archive.from_framed(framed, V.CRAWL)


_AT = "'https://h' || page_id || '.example.com/a/b' AS source_url, 'h' || page_id || '.example.com' AS source_host, TIMESTAMP '2024-01-02 03:04:05' AS crawled_at"


@query("p1_archive_pages", f"SELECT '{V.CRAWL}' AS crawl, {_AT}, '200' AS status, 'text/html; x' AS content_type, 'T' || page_id % 50 AS title, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS canonical FROM pages WHERE page_id % 9 <> 0")
def p1(spark, sf):
    return archive.pages(_archive_rows(spark, sf))


@query("p2_archive_links", f"SELECT '{V.CRAWL}' AS crawl, {_AT}, 'https://h' || page_id || '.example.com/p/' || i AS target_url, 'h' || page_id || '.example.com' AS target_host, 'café ' || i AS anchor FROM (SELECT page_id, unnest(range(0, page_id % 3 + 1)) AS i FROM pages WHERE page_id % 9 <> 0)")
def p2(spark, sf):
    return archive.links(_archive_rows(spark, sf))


@query("r1_archive_metrics", "SELECT 'in-' || page_id % 5 AS input, count(*) FILTER (WHERE page_id % 9 <> 0) AS pages_emitted, (sum(page_id % 3 + 1) FILTER (WHERE page_id % 9 <> 0))::BIGINT AS links_emitted, count(*) AS records_seen, (sum(page_id % 3 + 1) FILTER (WHERE page_id % 9 <> 0))::BIGINT AS encoding_repairs FROM pages GROUP BY 1")
def r1_archive(spark, sf):
    return archive.metrics(_archive_rows(spark, sf)).select("input", "pages_emitted", "links_emitted", "records_seen", "encoding_repairs")


_IDX = "SELECT o_orderkey AS line_no, o_orderkey % 7 AS bad, 'https://a.com/' || o_custkey AS url, strftime(o_orderdate, '%Y%m%d') || '010203' AS stamp FROM orders"


def _index(spark, sf):
    o = V.table(spark, sf, "orders")
    bad = F.col("o_orderkey") % 7
    name = F.when(bad == 2, "elsewhere.gz").otherwise("crawl-data/C-1/segments/s/warc/a.warc.gz")
    stamp = F.when(bad == 3, "20240230000000").otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("010203")))
    line = F.to_json(F.struct(F.concat(F.lit("https://A.com/"), F.col("o_custkey").cast("string"), F.lit("#f")).alias("url"), stamp.alias("timestamp"), F.when(bad == 1, "404").otherwise("200").alias("status"), F.lit("text/html").alias("mime"), name.alias("filename"), F.col("o_orderkey").cast("string").alias("offset"), F.when(bad == 4, "0").otherwise("10").alias("length")))
    return index.index_lines(o.select(F.col("o_orderkey").alias("line_no"), line.alias("value")), "C-1")


@query("s23_index_faults", f"SELECT CASE bad WHEN 1 THEN 'malformed record' WHEN 2 THEN 'file name' WHEN 3 THEN 'timestamp' ELSE 'length' END AS fault, count(*) AS n FROM ({_IDX}) WHERE bad BETWEEN 1 AND 4 GROUP BY 1")
def s23_faults(spark, sf):
    return index.faults(_index(spark, sf))


@query("s23_index_records", f"SELECT line_no, url AS normalized_url, stamp AS timestamp, line_no AS \"offset\" FROM ({_IDX}) WHERE bad IN (0, 5, 6) QUALIFY row_number() OVER (PARTITION BY url ORDER BY line_no) = 1")
def s23_records(spark, sf):
    return index.index_records(_index(spark, sf), "a.com").select("line_no", "normalized_url", "timestamp", "offset")


_TEXT = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("f27_html_pages", _P + f" SELECT url, {_TEXT.format('title')} AS title, {_TEXT.format('description')} AS description, noindex, n_h1 FROM p")
def f27(spark, sf):
    p = html.parsed_pages(V.table(spark, sf, "pages"), written=True)
    return p.select("url", "title", "description", "noindex", F.size("h1").cast("long").alias("n_h1"))


def _streamed(spark, sf, name, make, *key):
    """The result of a stream over the event table, run to its end; table and checkpoint lie in the shared folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    at = f"{top}/{name}-{uuid.uuid4().hex}"
    schema = V.table(spark, sf, "events").schema
    raw = stream.event_files(spark, sf, schema, only="events.parquet")
    run = stream.write_latest(make(V.event_columns(raw.withColumn("ts", F.col("ts").cast("timestamp")))), f"{at}/table", f"{at}/checkpoint", *key)
    run.awaitTermination()
    return stream.read_latest(spark, f"{at}/table")


@query("t2_stream_page_views", _E + "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", page, count(*) AS views FROM ev GROUP BY 1, 2, 3")
def t2_views(spark, sf):
    views = _streamed(spark, sf, "page_views", stream.page_views, "start", "page")
    return views.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "page", "views")


@query("t2_stream_daily_views", _E + "SELECT website_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS pageviews, count(DISTINCT visitor) AS visitors FROM ev GROUP BY 1, 2")
def t2_daily(spark, sf):
    return stream.summed(_streamed(spark, sf, "daily", stream.daily_trend, "website_id", "date", "part"))


from . import extra  # noqa: E402, F401  registers its queries with the decorator above
