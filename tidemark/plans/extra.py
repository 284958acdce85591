"""More queries beside their SQL: predicates, reports, operations, manifests, samples and the document lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import native as N
from ..operators import admin, analytics, collections, ga4, graphdict, history, links, manifests, quality, samples, search, seo
from . import views as V
from .registry import _CUR, _E, _H, _M, _P, _SEV, _WEIGHT, query


def _q(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def _cases(spark, sf, values):
    """The table of suppliers with the value whose number is the key modulo their count."""
    s = V.table(spark, sf, "supplier").select("s_suppkey")
    return s.withColumn("x", F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("s_suppkey") % len(values) + 1).cast("int")))


def _expected(pairs, *names: str, kind: str = "") -> str:
    """SQL over the same table whose columns are the expected values of each case."""
    def one(i, name):
        return f"CASE s_suppkey % {len(pairs)} " + " ".join(f"WHEN {k} THEN {_q(p[i]) if not isinstance(p[i], bool) else str(p[i]).upper()}" for k, p in enumerate(pairs)) + f" END{kind} AS {name}"

    return "SELECT s_suppkey, " + ", ".join(one(i + 1, n) for i, n in enumerate(names)) + " FROM supplier"


#: (agent, device, browser)
AGENTS = (
    ("Mozilla/5.0 (iPad; CPU OS 17_0) Version/17.0 Safari/604.1", "tablet", "Safari"),
    ("Mozilla/5.0 (Linux; Android 14; SM-X200) Chrome/120.0 Safari/537.36", "tablet", "Chrome"),
    ("Mozilla/5.0 (Linux; Android 14; Pixel) Chrome/120.0 Mobile Safari/537.36", "mobile", "Chrome"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Safari/604.1", "mobile", "Safari"),
    ("Mozilla/5.0 (iPod touch; CPU iPhone OS 12) Safari/604.1", "mobile", "Safari"),
    ("BlackBerry9700/5.0.0.862", "mobile", "Other"),
    ("Opera/9.80 (J2ME/MIDP; Opera Mini/7.1) Presto/2.12", "mobile", "Other"),
    ("Mozilla/5.0 (Windows Phone 10.0) Edge/15.1", "mobile", "Other"),
    ("SomeBot mobi reader", "desktop", "Other"),
    ("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0", "desktop", "Edge"),
    ("Mozilla/5.0 (X11; Linux) Gecko/20100101 Firefox/121.0", "desktop", "Firefox"),
    (None, "desktop", "Unknown"),
    ("", "desktop", "Unknown"),
)


@query("f19_agents", _expected(AGENTS, "device", "browser"))
def f19(spark, sf):
    return _cases(spark, sf, [a[0] for a in AGENTS]).select("s_suppkey", N.device_category("x").alias("device"), N.browser_category("x").alias("browser"))


#: (host, whether a crawler must keep away)
HOSTS = (
    ("example.com", False), ("8.8.8.8", False), ("localhost", True), ("LOCALHOST.", True), ("printer.local", True), ("db.internal", True), ("nas.home", True), ("metadata.google.internal", True), ("loopback", True), ("local.example.org", False),
    ("0.1.2.3", True), ("10.0.0.1", True), ("100.64.0.1", True), ("100.128.0.1", False), ("127.9.9.9", True), ("169.254.169.254", True), ("172.15.0.1", False), ("172.31.0.1", True), ("172.32.0.1", False), ("192.0.77.1", True),
    ("192.31.196.7", True), ("192.31.197.7", False), ("192.52.193.1", True), ("192.88.99.1", True), ("192.168.4.4", True), ("192.175.48.9", True), ("198.17.0.1", False), ("198.18.0.1", True), ("198.19.255.1", True), ("198.51.100.3", True),
    ("203.0.113.8", True), ("223.255.255.255", False), ("224.0.0.1", True), ("255.255.255.255", True), ("[::1]", True), ("::", True), ("2606:4700::6810:1", False), ("fd00::1", True), ("fe80::1", True), ("ff02::1", True), ("2001:db8::5", True),
    ("2001:0:1::", True), ("2001:4860:4860::8888", False), ("2002:808:808::1", True), ("100::1", True), ("::ffff:127.0.0.1", True), ("::ffff:8.8.8.8", False), ("::ffff:c0a8:101", True), ("::10.0.0.1", True), ("64:ff9b::a00:1", True),
    ("64:ff9b::808:808", False), ("1:2:3:4:5:6:7", True), ("1::2::3", True), ("1:2:3:4:5:6:7:8", False), ("::1:2:3:4:5:6:7:8", True), ("[2606:4700::1]", False),
)


@query("p30_unsafe_hosts", _expected(HOSTS, "unsafe"))
def p30(spark, sf):
    return _cases(spark, sf, [h[0] for h in HOSTS]).select("s_suppkey", N.unsafe_host("x").alias("unsafe"))


#: (country code, name)
CODES = (("us", "United States"), ("DE", "Germany"), ("zz", "ZZ"), ("", "Unknown"), (None, "Unknown"), ("fr", "France"))


@query("f33_countries", _expected(CODES, "country"))
def f33(spark, sf):
    return _cases(spark, sf, [x[0] for x in CODES]).select("s_suppkey", N.country_name("x").alias("country"))


#: (text, escaped, address path, the last two labels, host that may be looked up)
TEXTS = (
    ("a<b & \"c\" 'd'", "a&lt;b &amp; &quot;c&quot; &#39;d&#39;", "/", "a<b & \"c\" 'd'", None),
    ("https://a.b.example.org/x/y?q#f", "https://a.b.example.org/x/y?q#f", "/x/y", "example.org/x/y?q#f", "a.b.example.org"),
    ("http://Example.com", "http://Example.com", "/", "http://Example.com", "example.com"),
    ("shop.example.co.uk.", "shop.example.co.uk.", "/", "uk.", "shop.example.co.uk"),
    ("ftp://example.com/z", "ftp://example.com/z", "/z", "ftp://example.com/z", None),
    ("https://u@example.com/", "https://u@example.com/", "/", "https://u@example.com/", None),
    ("single", "single", "/", "single", None),
)


@query("f_texts", _expected(TEXTS, "escaped", "path", "apex", "lookup"))
def f_texts(spark, sf):
    return _cases(spark, sf, [t[0] for t in TEXTS]).select("s_suppkey", N.html_escape("x").alias("escaped"), N.url_path("x").alias("path"), N.apex_domain("x").alias("apex"), N.lookup_domain("x").alias("lookup"))


@query("f_digests", "SELECT s_suppkey, substr(sha256(s_name), 1, 16) AS input_key, sha256(s_name) AS trimmed, printf('%.2f', s_acctbal / 7) AS money, 'scan_' || lpad(lower(hex((1700000000000 + s_suppkey)::BIGINT)), 12, '0') || substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 20) AS id, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal / (s_suppkey % 3) ELSE 0 END AS ratio FROM supplier")
def f_digests(spark, sf):
    s = V.table(spark, sf, "supplier")
    ts = F.timestamp_millis(F.lit(1700000000000) + F.col("s_suppkey"))
    return s.select("s_suppkey", N.input_key("s_name").alias("input_key"), N.unblank_sha256(F.concat(F.lit(" \t"), "s_name", F.lit("\n "))).alias("trimmed"), N.fixed(F.col("s_acctbal") / 7, 2).alias("money"), N.public_id("scan_", ts, "s_suppkey").alias("id"), N.ratio("s_acctbal", F.col("s_suppkey") % 3).alias("ratio"))


@query("f4_inputs_sha256", "SELECT n_regionkey AS shard_id, sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey)) AS inputs_sha256 FROM nation GROUP BY 1")
def f4(spark, sf):
    return V.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("shard_id")).agg(N.inputs_sha256("n_name", "n_nationkey").alias("inputs_sha256"))


@query("f16_scope", "SELECT s_suppkey, s_suppkey % 4 IN (0, 1) AS inside, s_suppkey % 4 <> 3 AS same_site FROM supplier")
def f16(spark, sf):
    # the host itself, its www form, a sibling, another site
    host = F.element_at(F.array(F.lit("Example.com."), F.lit("www.example.com"), F.lit("shop.example.com"), F.lit("example.org")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return V.table(spark, sf, "supplier").select("s_suppkey", N.in_scope(host, F.lit("example.com")).alias("inside"), N.same_site(host, F.lit("example.com")).alias("same_site"))


@query("f5_wall_clock", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::TIMESTAMP + INTERVAL 90 MINUTE END AS at FROM orders")
def f5(spark, sf):
    o = V.table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T01:30:00"), F.when(F.col("o_orderkey") % 3 == 1, "Z").otherwise("+05:00")))
    return o.select("o_orderkey", N.wall_clock(text).alias("at"))


@query("p22_predicates", "SELECT o_orderkey, o_orderkey % 5 = 1 AS sound, o_orderkey % 4 IN (1, 2) AS listed, (o_orderkey % 6 = 0 OR o_orderkey % 6 = 3) AS claimable FROM orders")
def p22(spark, sf):
    o = V.table(spark, sf, "orders")
    five, four, six = F.col("o_orderkey") % 5, F.col("o_orderkey") % 4, F.col("o_orderkey") % 6
    o = o.select("o_orderkey", F.when(five == 0, 404).otherwise(200).alias("status_code"), F.when(five == 2, "timeout").when(five == 3, "").alias("failure"), F.when(five == 3, "x").when(five == 4, "y").otherwise("").alias("error"),
                 F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("warning"), F.lit("low")), (four + 1).cast("int")).alias("severity"),
                 F.when(six.isin(0, 1, 2), "queued").when(six == 5, "completed").otherwise("crawling").alias("status"), F.when(six == 2, 3).otherwise(1).alias("attempts"),
                 F.when(six == 3, F.lit("2024-01-01 00:00:00")).when(six == 4, F.lit("2024-01-03 00:00:00")).cast("timestamp").alias("lease_expires_at"),
                 F.when(six == 1, F.lit("2024-01-03 00:00:00")).cast("timestamp").alias("next_attempt_at"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    return o.select("o_orderkey", N.sound_page("status_code", "failure", "error").alias("sound"), N.severity_matches("severity", "medium").alias("listed"), N.claimable("2024-01-02 00:00:00").alias("claimable"))


@query("s25_sitemaps", "SELECT s_suppkey, unnest(['https://a.example/' || s_suppkey, 'http://b.example/x']) AS url FROM supplier")
def s25(spark, sf):
    xml = F.concat(F.lit("<urlset><url><loc> https://a.example/"), F.col("s_suppkey").cast("string"), F.lit(" </loc></url><url><LOC>http://b.example/x</LOC></url><url><loc>ftp://c.example/</loc></url></urlset>"))
    return V.table(spark, sf, "supplier").select("s_suppkey", F.explode(N.sitemap_locations(xml)).alias("url"))


@query("p28_robots", "SELECT s_suppkey, s_suppkey % 4 IN (1, 2) AS allowed FROM supplier")
def p28(spark, sf):
    lines = ["User-agent: other", "Disallow: /", "user-agent: *", "Disallow: /private # not here", "Allow: /private/open", "Disallow:"]
    s = V.table(spark, sf, "supplier").select("s_suppkey")
    rows = s.select(F.col("s_suppkey").alias("site"), F.posexplode(F.array(*map(F.lit, lines))).alias("line_no", "line"))
    rules = seo.robots_rules(rows).groupBy("site").agg(F.collect_list(F.when(F.col("kind") == "allow", F.col("prefix"))).alias("allow"), F.collect_list(F.when(F.col("kind") == "disallow", F.col("prefix"))).alias("disallow"))
    path = F.element_at(F.array(F.lit("/private/x"), F.lit("/public"), F.lit("/private/open/y"), F.lit("/private")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return s.join(rules.withColumnRenamed("site", "s_suppkey"), "s_suppkey").select("s_suppkey", seo.robots_allowed(path, F.col("allow"), F.col("disallow")).alias("allowed"))


# the link graph


@query("r5_edge_ids", f"WITH {V.LINKS_SQL}, e AS (SELECT source_url, target_url, anchor, count(*) AS n FROM links GROUP BY ALL) SELECT CAST(CAST('0x' || substr(sha256(source_url), 1, 16) AS UBIGINT) AS VARCHAR) AS source_id, CAST(CAST('0x' || substr(sha256(target_url), 1, 16) AS UBIGINT) AS VARCHAR) AS target_id, CAST(CAST('0x' || substr(sha256(anchor), 1, 16) AS UBIGINT) AS VARCHAR) AS anchor_id, n FROM e")
def r5_edge_ids(spark, sf):
    e = graphdict.edges(V.links(spark, sf)).groupBy("source_url_id", "target_url_id", "anchor_id").agg(F.count("*").alias("n"))
    return e.select(*[N.unsigned(f"{x}_id").cast("string").alias(f"{x.split('_')[0]}_id") for x in ("source_url", "target_url", "anchor")], "n")


@query("r5_pages_optimized", f"WITH {V.LINKS_SQL}, pg AS (SELECT DISTINCT crawl, source_url FROM links WHERE source_url LIKE '%7') SELECT CAST(CAST('0x' || substr(sha256(source_url), 1, 16) AS UBIGINT) AS VARCHAR) AS url_id, CAST(CAST('0x' || substr(sha256(source_url || '?c'), 1, 16) AS UBIGINT) AS VARCHAR) AS canonical_id, 'T' AS title, CAST(CAST('0x' || substr(sha256(source_url), 1, 16) AS UBIGINT) % 100 AS INT) AS source_bucket FROM pg")
def r5_pages(spark, sf):
    p = V.link_pages(spark, sf).withColumns({"crawled_at": F.lit(None).cast("timestamp"), "status": F.lit("200"), "content_type": F.lit("x"), "title": F.lit("T"), "description": F.lit(None).cast("string")})
    o = graphdict.pages_optimized(p, 100)
    return o.select(N.unsigned("url_id").cast("string").alias("url_id"), N.unsigned("canonical_url_id").cast("string").alias("canonical_id"), "title", "source_bucket")


@query("u3_foreign_crawls", f"WITH {V.LINKS_SQL} SELECT count(*) FILTER (WHERE l_orderkey % 11 = 0) AS n FROM lineitem")
def u3(spark, sf):
    ls = V.table(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 11 == 0, "CC-OTHER").otherwise(V.CRAWL).alias("crawl"))
    return spark.range(1).select(F.lit(links.foreign_crawls(V.CRAWL, ls)).cast("long").alias("n"))


@query("o6_sample_rows", f"WITH {V.LINKS_SQL} SELECT least(20, count(*)) AS n, count(*) FILTER (WHERE FALSE) AS foreign_rows FROM links WHERE {_H}")
def o6(spark, sf):
    return links.sample_rows(V.links(spark, sf), V.HOST).agg(F.count("*").alias("n"), F.count_if(F.col("target_host") != V.HOST).alias("foreign_rows"))


@query("p31_missing_buckets", "SELECT lpad(CAST(range AS VARCHAR), 4, '0') AS target_host_bucket FROM range(1024) WHERE lpad(CAST(range AS VARCHAR), 4, '0') NOT IN (SELECT lpad(CAST(CAST('0x' || substr(sha256(n_name), 1, 3) AS INT) // 4 AS VARCHAR), 4, '0') FROM nation)")
def p31(spark, sf):
    return quality.missing_buckets(V.table(spark, sf, "nation").select(N.host_bucket("n_name").alias("target_host_bucket")))


# web-property reports

_V = "SELECT website_id, device, page, count(*) AS sessions, count(DISTINCT visitor) AS users FROM ev GROUP BY ALL"


@query("s22_report", _E + "SELECT page, coalesce(device, 'none') AS device, count(*) AS views, count(DISTINCT visitor) AS users FROM ev GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 7")
def s22(spark, sf):
    e = V.events(spark, sf).withColumn("device", F.coalesce("device", F.lit("none")))
    return ga4.report(e, ["page", "device"], {"views": F.count("*"), "users": F.countDistinct("visitor")}, [F.desc("views")], 7)


@query("s22_realtime", _E + "SELECT page, count(DISTINCT visitor) AS active_users FROM ev WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 600 MINUTE GROUP BY 1")
def s22_realtime(spark, sf):
    e = V.events(spark, sf)
    now = e.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("x")).first()["x"]
    return ga4.active_now(e, now, 600, "page")


@query("a27_device_share", _E + "SELECT coalesce(device, 'none') AS device, count(DISTINCT visitor) AS users, floor(100 * count(DISTINCT visitor) / (SELECT sum(u) FROM (SELECT count(DISTINCT visitor) AS u FROM ev GROUP BY device)) + 0.5)::BIGINT AS share FROM ev GROUP BY 1")
def a27(spark, sf):
    e = V.events(spark, sf).withColumn("device", F.coalesce("device", F.lit("none")))
    return ga4.device_share(ga4.report(e, ["device"], {"users": F.countDistinct("visitor")}))


@query("a27_key_figures", _E + ", c AS (SELECT count(*) AS sessions, count(DISTINCT visitor) AS users, 0 AS none FROM ev WHERE website_id = 1), p AS (SELECT count(*) AS sessions, count(DISTINCT visitor) AS users, 0 AS none FROM ev WHERE website_id = 2) SELECT m AS metric, a::DOUBLE AS current, b::DOUBLE AS previous, CASE WHEN b = 0 THEN 0 ELSE floor((a - b) / b * 100 + 0.5) END::BIGINT AS pct_change FROM (SELECT unnest(['sessions', 'users', 'none']) AS m, unnest([c.sessions, c.users, c.none]) AS a, unnest([p.sessions, p.users, p.none]) AS b FROM c, p)".replace("FROM events) ,", "FROM events),"))
def a27_kpi(spark, sf):
    one = lambda w: V.events(spark, sf).where(F.col("website_id") == w).agg(F.count("*").alias("sessions"), F.countDistinct("visitor").alias("users"), F.lit(0).alias("none"))
    return ga4.key_figures(one(1), one(2), ("sessions", "users", "none"))


@query("a28_new_and_returning", "SELECT (SELECT count(*) FROM events WHERE event_id % 3 = 0) AS new_users, (SELECT count(*) FROM events WHERE event_id % 3 <> 0) AS returning_users, 2.5::DOUBLE AS avg_session_seconds, (SELECT round(count(*) / count(DISTINCT user_id), 2) FROM events) AS sessions_per_user")
def a28(spark, sf):
    e = V.table(spark, sf, "events")
    kind = F.element_at(F.array(F.lit("New"), F.lit("returning"), F.lit("(not set)")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = e.groupBy(kind.alias("type")).agg(F.count("*").alias("users")).select("type", "users", F.when(F.col("type") == "returning", 2.5).otherwise(9.0).alias("avg_session_seconds"), F.when(F.col("type") == "returning", 3).otherwise(1).alias("_ord"))
    ratio = e.agg(F.count("*").alias("s"), F.countDistinct("user_id").alias("u")).select(ga4.sessions_per_user("s", "u").alias("sessions_per_user"), F.lit(1).alias("k"))
    return ga4.new_and_returning(rows).withColumn("k", F.lit(1)).join(F.broadcast(ratio), "k").drop("k")


@query("p17_insights", "WITH p AS (SELECT s_suppkey AS n, 's' || s_suppkey AS page, s_suppkey % 9 AS sessions, (s_suppkey % 7) / 10 AS e, (s_suppkey % 11) / 10 AS b FROM supplier) (SELECT 'poor_engagement' AS kind, page AS subject, printf('%.1f', e * 100) || '% Engagement Rate' AS label FROM p WHERE sessions >= 5 AND e < 0.4 ORDER BY n LIMIT 3) UNION ALL (SELECT 'high_bounce', page, printf('%.1f', b * 100) || '% Bounce Rate' FROM p WHERE sessions >= 5 AND b > 0.6 ORDER BY n LIMIT 3) UNION ALL (SELECT 'growing_source', 'c0', '12 Sessions')")
def p17(spark, sf):
    p = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("_ord"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("page"), (F.col("s_suppkey") % 9).alias("sessions"), ((F.col("s_suppkey") % 7) / 10).alias("engagement_rate"), ((F.col("s_suppkey") % 11) / 10).alias("bounce_rate"))
    sources = spark.range(3).select(F.col("id").alias("_ord"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("channel"), (F.col("id") + 12).alias("sessions"))
    return ga4.insights(p, sources)


@query("p18_conversions", "SELECT CASE event_type WHEN 'click' THEN 'Purchase' WHEN 'view' THEN 'sign_up' ELSE event_type END AS event_name, count(*) AS count, round(count(*) / 700, 3) AS rate FROM events GROUP BY 1 HAVING event_name IN ('Purchase', 'purchase', 'generate_lead', 'sign_up', 'conversion', 'submit_form')")
def p18(spark, sf):
    e = V.table(spark, sf, "events")
    name = F.when(F.col("event_type") == "click", "Purchase").when(F.col("event_type") == "view", "sign_up").otherwise(F.col("event_type"))
    return ga4.conversions(e.groupBy(name.alias("event_name")).agg(F.count("*").alias("count")), 700)


@query("p20_retained", _E + "SELECT page, count(*) AS views FROM ev WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 12 DAY GROUP BY 1")
def p20(spark, sf):
    return analytics.dimension(analytics.retained(V.events(spark, sf), "2024-01-25", 12), "page")


# search performance


@query("p35_keywords", f"WITH {V.FACTS_SQL} SELECT query, {_M} FROM facts WHERE date BETWEEN DATE '2000-06-15' - INTERVAL 28 DAY AND DATE '2000-06-15' GROUP BY 1 ORDER BY clicks DESC, impressions DESC, query LIMIT 100")
def p35(spark, sf):
    return search.keyword_list(V.facts(spark, sf), "2000-06-15").withColumn("position", F.round("position", 6))


@query("u4_sections", f"WITH {V.FACTS_SQL} SELECT section, key, clicks, impressions, row_number() OVER (ORDER BY section DESC, key) AS n FROM (SELECT 'query' AS section, query AS key, {_M} FROM facts WHERE {_CUR} AND query < 'LARGE' GROUP BY 2 UNION ALL SELECT 'page', page, {_M} FROM facts WHERE {_CUR} GROUP BY 2)")
def u4(spark, sf):
    from pyspark.sql.window import Window

    cur = V.current(spark, sf)
    both = search.both_sections(search.report(cur.where("query < 'LARGE'"), ["query"]), search.report(cur, ["page"]))
    return both.select("section", "key", "clicks", "impressions", F.row_number().over(Window.orderBy("_ord")).cast("long").alias("n"))


@query("a31_scale", f"WITH {V.FACTS_SQL} SELECT page, greatest(max(clicks), 1)::DOUBLE AS scale FROM (SELECT page, date, sum(click)::DOUBLE AS clicks FROM facts WHERE {_CUR} GROUP BY ALL) GROUP BY 1")
def a31(spark, sf):
    return search.scale(search.report(V.current(spark, sf), ["page", "date"]), "clicks", "page").withColumn("scale", F.col("scale").cast("double"))


@query("a33_indexing", "SELECT website_id, greatest(0, p - c) AS indexed_pages, c AS not_indexed, c AS errors, h AS excluded FROM (SELECT 'w' || (o_custkey % 5) AS website_id, o_orderkey % 50 AS p, o_orderkey % 40 AS c, o_orderkey % 7 AS h FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)")
def a33(spark, sf):
    k = F.col("o_orderkey")
    s = V.table(spark, sf, "orders").select(F.concat(F.lit("w"), (F.col("o_custkey") % 5).cast("string")).alias("website_id"), F.col("o_orderdate").alias("created_at"), k.alias("scan_id"), (k % 50).alias("pages"), (k % 40).alias("critical"), (k % 7).alias("high"))
    return search.indexing_overview(history.latest(s))


@query("p34_property", "SELECT 'sc-domain:s3.example.com' AS site, 2 AS priority")
def p34(spark, sf):
    s = V.table(spark, sf, "supplier").select((F.col("s_suppkey") % 40).cast("string").alias("n"))
    sites = s.select(F.concat(F.lit("sc-domain:s"), "n", F.lit(".example.com")).alias("site")).unionByName(s.select(F.concat(F.lit("https://www.s"), "n", F.lit(".example.com/")).alias("site")))
    return search.property_match(sites, "www.s3.example.com").select("site", "priority")


# operations


@query("a23_statuses", "SELECT o_custkey % 10 AS crawl, o_orderkey % 3 = 0 AS has_404, count(*) AS n, sum(o_orderkey)::BIGINT AS bytes FROM orders GROUP BY 1, 2")
def a23(spark, sf):
    o = V.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("crawl"), F.when(F.col("o_orderkey") % 3 == 0, 404).otherwise(200).alias("status"), F.col("o_orderkey").alias("bytes"), (F.col("o_orderkey") % 3 == 0).alias("has_404"))
    h = admin.status_histogram(o, "crawl", "has_404")
    return h.select("crawl", "has_404", F.element_at("statuses", F.when(F.col("has_404"), "404").otherwise("200")).alias("n"), "bytes")


@query("a18_totals", "SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM supplier) AS websites, count(*) AS scans, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed_scans, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed_scans FROM orders")
def a18(spark, sf):
    scans = V.table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued").alias("status"))
    return admin.totals(V.table(spark, sf, "customer"), V.table(spark, sf, "supplier"), scans)


_JOBS = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'crawling' WHEN 2 THEN 'analysing' ELSE 'completed' END AS status, o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS lease FROM orders WHERE o_orderkey % 97 < 5"


def _jobs(spark, sf):
    o = V.table(spark, sf, "orders").where("o_orderkey % 97 < 5")
    status = F.element_at(F.array(*map(F.lit, ("queued", "crawling", "analysing", "completed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 day")).alias("lease_expires_at"))


@query("a30_queue", f"WITH j AS ({_JOBS}) SELECT least(26, count(*) FILTER (WHERE status = 'queued')) AS pending, greatest(0, epoch_ms(TIMESTAMP '1998-01-01') - epoch_ms(min(created_at) FILTER (WHERE status = 'queued'))) AS oldest_pending_ms, least(26, count(*) FILTER (WHERE status IN ('crawling', 'analysing') AND lease <= TIMESTAMP '1998-01-01')) AS stale_leases FROM j")
def a30(spark, sf):
    return admin.queue_health(_jobs(spark, sf), "1998-01-01 00:00:00")


@query("o9_oldest", f"WITH j AS ({_JOBS}) SELECT id, status FROM j WHERE status = 'queued' ORDER BY created_at, id LIMIT 1")
def o9(spark, sf):
    return admin.oldest(_jobs(spark, sf), F.col("status") == "queued").select("id", "status")


@query("o10_newest", f"WITH j AS ({_JOBS}) SELECT id, status FROM j ORDER BY created_at DESC, id DESC LIMIT 30")
def o10(spark, sf):
    return admin.newest_first(_jobs(spark, sf), "created_at", most=30).select("id", "status")


@query("o13_latest_collection", "SELECT n_name AS id FROM nation ORDER BY n_regionkey DESC, n_name DESC LIMIT 1")
def o13(spark, sf):
    return admin.newest_first(V.table(spark, sf, "nation").select(F.col("n_name").alias("id"), "n_regionkey"), "n_regionkey", "id", 1).select("id")


@query("t7_job_state", "SELECT o_custkey AS job_id, CASE WHEN last = 'queued' AND starts >= 3 THEN 'failed' ELSE last END AS status, starts AS attempts FROM (SELECT o_custkey, arg_max(s, o_orderdate::TIMESTAMP + to_microseconds(o_orderkey)) AS last, count(*) FILTER (WHERE s = 'crawling') AS starts FROM (SELECT o_custkey, o_orderdate, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'crawling' WHEN 'O' THEN 'queued' ELSE 'failed' END AS s FROM orders) GROUP BY 1)")
def t7(spark, sf):
    s = F.col("o_orderstatus")
    e = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.when(s == "F", "crawling").when(s == "O", "queued").otherwise("failed").alias("status"))
    return admin.job_state(e).select("job_id", "status", "attempts")


@query("a10_progress", "SELECT 900::BIGINT AS total_inputs, 5 + count(*) AS files_attempted, 5 + count(*) FILTER (WHERE s_suppkey % 10 <> 0) AS files_completed, count(*) FILTER (WHERE s_suppkey % 10 = 0) AS files_failed, 895 - count(*) AS files_remaining, (count(*) * 1048576)::BIGINT AS input_bytes, sum(s_suppkey)::BIGINT AS links_emitted, round(count(*) / 8.0 * 3600, 3) AS files_per_hour, round(count(*) / 8.0, 3) AS input_mib_per_second, round((895 - count(*)) / (count(*) / 8.0), 3) AS remaining_seconds FROM supplier")
def a10(spark, sf):
    m = V.table(spark, sf, "supplier").select(F.lit(1 << 20).cast("long").alias("input_bytes"), F.col("s_suppkey").alias("links_emitted"), F.when(F.col("s_suppkey") % 10 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("failures"))
    return admin.progress(m, 900, 5, 8.0)


@query("a9_metrics_total", "SELECT sum(s_suppkey * 1000)::BIGINT AS input_bytes, sum(s_suppkey * 7)::BIGINT AS output_bytes, count(*) FILTER (WHERE s_suppkey % 10 = 0) AS failed_inputs, 0.993::DOUBLE AS reduction_ratio FROM supplier")
def a9(spark, sf):
    n = F.col("s_suppkey")
    zero = [F.lit(0).alias(x) for x in ("pages_emitted", "links_emitted", "records_seen", "malformed_records", "malformed_json", "malformed_warc")]
    m = V.table(spark, sf, "supplier").select((n * 1000).alias("input_bytes"), (n * 7).alias("output_bytes"), *zero, F.when(n % 10 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("failures"))
    return quality.metrics_total(m).select("input_bytes", "output_bytes", "failed_inputs", F.col("reduction_ratio").cast("double").alias("reduction_ratio"))


@query("a26_tallies", _P + f", s AS (SELECT CASE WHEN {_SEV} = 'low' AND length(affected_url) % 2 = 0 THEN 'warning' ELSE {_SEV} END AS severity, scan_id FROM i) SELECT scan_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity IN ('medium', 'warning')) AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM s GROUP BY 1")
def a26(spark, sf):
    i = seo.issues(V.audited_pages(spark, sf))
    return admin.tallies(i.withColumn("severity", F.when((F.col("severity") == "low") & (F.length("affected_url") % 2 == 0), "warning").otherwise(F.col("severity"))), "scan_id")


@query("a34_snapshot", _P + f", l AS (SELECT scan_id, sum({_WEIGHT}) AS d, count(*) AS issues, count(*) FILTER (WHERE {_SEV} = 'critical') AS critical, count(*) FILTER (WHERE {_SEV} = 'high') AS high, count(*) FILTER (WHERE {_SEV} = 'medium') AS medium, count(*) FILTER (WHERE {_SEV} = 'low') AS low FROM i GROUP BY 1), c AS (SELECT scan_id, count(*) AS pages FROM p GROUP BY 1) SELECT scan_id, least(100, greatest(0, floor(100 - coalesce(d, 0) / sqrt(pages) + 0.5)))::BIGINT AS score, '1' AS rule_version, coalesce(issues, 0) AS issues, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, pages FROM c LEFT JOIN l USING (scan_id)")
def a34(spark, sf):
    pages = V.audited_pages(spark, sf)
    return admin.scan_snapshot(seo.issues(pages), pages)


@query("a24_checklist", _P + ", m AS (SELECT (SELECT count(*) FROM p) AS attempted, count(*) AS pages, count(title) AS t, count(description) AS d, count(canonical) AS c, count(*) FILTER (WHERE n_h1 = 1) AS h FROM p WHERE status = 200) SELECT 'crawlability' AS \"check\", CASE WHEN pages = attempted THEN 'pass' WHEN pages > 0 THEN 'warn' ELSE 'fail' END AS status, pages AS have, attempted - pages AS missing FROM m" + "".join(f" UNION ALL SELECT '{n}', CASE WHEN pages = {c} THEN 'pass' ELSE 'warn' END, {c}, pages - {c} FROM m" for n, c in (("canonical", "c"), ("titles", "t"), ("meta_desc", "d"), ("headings", "h"))))
def a24(spark, sf):
    return admin.checklist(V.audited_pages(spark, sf))


@query("r17_fixes", _P + " SELECT scan_id, affected_url, 'Fix ' || rule_id || ': look at ' || affected_url AS suggested_fix FROM i")
def r17(spark, sf):
    i = seo.issues(V.audited_pages(spark, sf)).withColumns({"title": F.col("rule_id"), "recommendation": F.concat(F.lit("look at "), "affected_url")})
    return admin.suggested_fixes(i).select("scan_id", "affected_url", "suggested_fix")


@query("a32_page_count", "SELECT count(*) AS total, greatest(1, ceil(count(*) / 20))::BIGINT AS pages FROM orders WHERE o_orderstatus = 'O'")
def a32(spark, sf):
    return admin.page_of(V.table(spark, sf, "orders").where("o_orderstatus = 'O'"), 20)


@query("p32_unexpired", "SELECT count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'")
def p32(spark, sf):
    return admin.unexpired(V.table(spark, sf, "orders").withColumnRenamed("o_orderdate", "expires_at"), "1997-01-01").agg(F.count("*").alias("n"))


#: Pages whose canonical is broken, on another host, absent or sound; and site findings.
@query("r7_canonicals", "SELECT s_suppkey AS scan_id, rule_id FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'canonical-invalid' WHEN 1 THEN 'canonical-external' WHEN 2 THEN 'canonical-missing' WHEN 3 THEN 'jsonld-syntax-error' END AS rule_id FROM supplier) WHERE rule_id IS NOT NULL")
def r7(spark, sf):
    n = F.col("s_suppkey") % 5
    null = F.lit(None).cast("string")
    canonical = F.when(n == 0, "not an address").when(n == 1, "https://elsewhere.example/").when(n == 2, null).otherwise("https://a.example/")
    p = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scan_id"), F.lit("https://a.example/").alias("url"), F.lit("a.example").alias("hostname"), F.lit(200).alias("status"), F.lit(5).alias("response_ms"), F.lit(True).alias("parsed"), F.lit("A sound title").alias("title"), F.lit("d").alias("description"), canonical.alias("canonical"), null.alias("canonical_error"), F.lit(False).alias("noindex"), F.array(F.lit("h")).alias("h1"), (n != 3).alias("jsonld_valid"))
    return seo.issues(p).select("scan_id", "rule_id")


@query("r1_site_issues", "SELECT s_suppkey AS scan_id, rule_id FROM (SELECT s_suppkey, unnest(list_filter([CASE WHEN s_suppkey % 5 = 0 THEN 'robots-txt-missing' END, CASE WHEN s_suppkey % 3 = 0 THEN 'sitemap-missing' END, CASE WHEN s_suppkey % 2 = 0 THEN 'sitemap-url-error' END], lambda x: x IS NOT NULL)) AS rule_id FROM supplier WHERE s_suppkey % 7 <> 0)")
def r1_site(spark, sf):
    n = F.col("s_suppkey")
    s = V.table(spark, sf, "supplier").select(n.alias("scan_id"), F.lit("https://a.example/").alias("start_url"), (n % 7 != 0).alias("discovery"), F.when(n % 5 == 0, 404).otherwise(200).alias("robots_status"), (n % 3 == 0).alias("sitemap_missing"), F.when(n % 2 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("sitemap_errors"))
    return seo.site_issues(s).select("scan_id", "rule_id")


_DIFF = f"WITH {V.SCANS_SQL}, a AS (SELECT DISTINCT rule_id || ':' || affected_url AS k FROM scans WHERE website_id = 'w1' AND scan_no = 1), b AS (SELECT DISTINCT rule_id || ':' || affected_url AS k FROM scans WHERE website_id = 'w1' AND scan_no = 2), c AS (SELECT DISTINCT affected_url AS k FROM scans WHERE website_id = 'w1' AND scan_no = 1), d AS (SELECT DISTINCT affected_url AS k FROM scans WHERE website_id = 'w1' AND scan_no = 2), n AS (SELECT * FROM b EXCEPT SELECT * FROM a), r AS (SELECT * FROM a EXCEPT SELECT * FROM b), np AS (SELECT * FROM d EXCEPT SELECT * FROM c), rp AS (SELECT * FROM c EXCEPT SELECT * FROM d)"


@query("r12_snapshot", _DIFF + " SELECT (SELECT count(*) FROM n) AS new_issues_count, (SELECT count(*) FROM r) AS resolved_issues_count, (SELECT count(*) FROM np) AS new_pages_count, (SELECT count(*) FROM rp) AS removed_pages_count, " + ", ".join(f"(SELECT coalesce(string_agg(k, ' ' ORDER BY k), '') FROM (SELECT k FROM {t} ORDER BY k LIMIT 50)) AS {c}" for t, c in (("n", "new_issues"), ("r", "resolved_issues"), ("np", "new_pages"), ("rp", "removed_pages"))))
def r12(spark, sf):
    s = V.scans(spark, sf).where("website_id = 'w1'")
    old, new = s.where("scan_no = 1"), s.where("scan_no = 2")
    pages = lambda df: df.select(F.col("affected_url").alias("url"))
    d = history.scan_difference("w1", "2", old, new, pages(old), pages(new), "2024-01-01")
    names = ("new_issues", "resolved_issues", "new_pages", "removed_pages")
    return d.select(*[f"{n}_count" for n in names], *[F.array_join(n, " ").alias(n) for n in names])


@query("s19_written", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 THEN 'replaced' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT -o_orderkey - 1, 'inserted' FROM orders WHERE o_orderkey % 5 = 2")
def s19(spark, sf):
    k = F.col("id")
    t = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    ops = t.where(k % 5 <= 1).select("id", F.lit("replaced").alias("state"), F.when(k % 5 == 0, "delete").otherwise("replace").alias("op"))
    new = t.where(k % 5 == 2).select((-k - 1).alias("id"), F.lit("inserted").alias("state"), F.lit("insert").alias("op"))
    lost = t.where(k % 5 == 3).select((-k - 1).alias("id"), F.lit("x").alias("state"), F.lit("replace").alias("op"))  # nothing to replace
    twice = t.where(k % 5 == 4).select("id", F.lit("x").alias("state"), F.lit("insert").alias("op"))  # there already
    return history.written(t, ops.unionByName(new).unionByName(lost).unionByName(twice), ["id"])


@query("r13_resolved", f"WITH {V.SCANS_SQL} SELECT website_id, rule_id, affected_url, CASE WHEN website_id = 'w2' AND rule_id = '1-URGENT' AND affected_url LIKE '%/7' THEN 'resolved' WHEN affected_url LIKE '%3' THEN 'resolved' ELSE 'active' END AS status FROM scans WHERE scan_no = 1 GROUP BY ALL")
def r13(spark, sf):
    from .registry import _history

    return admin.lifecycle_resolved(_history(spark, sf), {"website_id": "w2", "rule_id": "1-URGENT", "affected_url": "https://c.example/7"}, "2024-01-01").select(*history.KEY, "status")


# lists of inputs and their shards

_INPUTS = "SELECT s_suppkey AS idx, 'crawl-data/' || s_name || '.gz' AS path FROM supplier"


def _inputs(spark, sf):
    return V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("idx"), F.concat(F.lit("crawl-data/"), "s_name", F.lit(".gz")).alias("path"))


@query("d8_promotion", f"WITH a AS ({_INPUTS}) SELECT FALSE AS can_promote, count(*) FILTER (WHERE idx % 9 = 0) AS broken FROM a WHERE idx < 60")
def d8(spark, sf):
    a = _inputs(spark, sf)
    return manifests.can_promote(a.where("idx < 60"), a.withColumn("path", F.when(F.col("idx") % 9 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path"))))


@query("d6_list_faults", f"WITH a AS ({_INPUTS}) SELECT (count(*) + count(*) FILTER (WHERE idx % 10 = 0))::BIGINT AS inputs, count(*) FILTER (WHERE idx % 7 = 0) AS wrong_form, count(*) FILTER (WHERE idx % 10 = 0) AS repeated, 0::BIGINT AS shared_keys FROM a")
def d6(spark, sf):
    a = _inputs(spark, sf).withColumn("path", F.when(F.col("idx") % 7 == 0, F.concat("path", F.lit(".bad"))).otherwise(F.col("path")))
    out = manifests.list_faults(a.unionByName(a.where("idx % 10 = 0")), "crawl-data/", ".gz")
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("j9_binding", f"WITH s AS (SELECT ntile(6) OVER (ORDER BY idx) - 1 AS shard_id, idx, path FROM ({_INPUTS})) SELECT shard_id, unnest(['last_input', 'inputs_sha256']) AS field FROM (SELECT DISTINCT shard_id FROM s WHERE shard_id = 2) UNION ALL SELECT 5, unnest(['input_count', 'first_input', 'last_input', 'inputs_sha256'])")
def j9(spark, sf):
    shards = quality.sharded(_inputs(spark, sf), 6).withColumn("shard_id", F.col("shard_id").cast("long"))
    plan = manifests.shard_entries(shards).where("shard_id <> 5")
    last = shards.where("shard_id = 2").agg(F.max("idx").alias("m")).first()["m"]
    return manifests.binding_errors(plan, shards.withColumn("path", F.when(F.col("idx") == last, "other").otherwise(F.col("path"))))


@query("d15_slice", f"WITH a AS ({_INPUTS}) SELECT count(*) FILTER (WHERE idx % 30 = 0) AS overlap, 2::BIGINT AS uncovered, 2::BIGINT AS unbound FROM a")
def d15(spark, sf):
    a = _inputs(spark, sf)
    shards = quality.sharded(a, 4)
    plan = manifests.shard_entries(shards)
    changed = shards.withColumn("path", F.when(F.col("idx") == 1, "other").otherwise(F.col("path")))
    out = manifests.slice_faults(a, a.where("idx % 30 = 0"), changed, plan.withColumn("input_count", F.when(F.col("shard_id") == 3, 0).otherwise(F.col("input_count"))))
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("o14_chunks", f"WITH a AS ({_INPUTS}) SELECT idx // 16 AS chunk, count(*) AS n, min(path) AS first FROM a GROUP BY 1")
def o14(spark, sf):
    return manifests.chunked(_inputs(spark, sf), 16).groupBy("chunk").agg(F.count("*").alias("n"), F.min("path").alias("first"))


@query("d7_cover", f"WITH a AS ({_INPUTS}) SELECT path, 1::BIGINT AS n_base, CASE WHEN idx % 13 = 0 THEN 0 ELSE 2 END::BIGINT AS n_shards FROM a WHERE idx % 13 = 0 OR idx % 13 = 1")
def d7(spark, sf):
    a = _inputs(spark, sf)
    return quality.cover_errors(a, a.where("idx % 13 <> 0").unionByName(a.where("idx % 13 = 1"))).fillna(0)


@query("d13_triplets", "SELECT s_suppkey AS input_key, CASE s_suppkey % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS n FROM supplier WHERE s_suppkey % 4 <> 0")
def d13(spark, sf):
    kinds = F.element_at(F.array(F.array(*map(F.lit, ("pages", "links", "metrics"))), F.array(F.lit("pages"), F.lit("links"), F.lit("pages")), F.array(F.lit("pages"), F.lit("other"), F.lit("other")), F.array(F.lit("other"), F.lit("other"), F.lit("other"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return quality.incomplete_triplets(V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("input_key"), F.explode(kinds).alias("dataset")))


@query("j7_pending", f"WITH a AS ({_INPUTS}) SELECT path AS input FROM a WHERE idx % 3 <> 0")
def j7(spark, sf):
    a = _inputs(spark, sf).select("idx", F.col("path").alias("input"))
    return quality.pending(a, a.where("idx % 3 = 0")).select("input")


@query("u8_key_collisions", f"WITH a AS ({_INPUTS}) SELECT substr(sha256(path), 1, 16) AS input_key, count(DISTINCT path) AS n FROM a GROUP BY 1 HAVING count(DISTINCT path) > 1")
def u8(spark, sf):
    return quality.key_collisions(_inputs(spark, sf))


@query("s15_footers", "SELECT count(*) AS rows FROM lineitem")
def s15(spark, sf):
    return manifests.footers(spark, f"{sf}/lineitem.parquet").agg(F.sum("rows").alias("rows"))


# samples in JSON lines


def _compact(spark, sf):
    p = V.table(spark, sf, "pages")
    each = F.transform(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int")), lambda i: F.struct(F.when(i == 3, "IMG@/src").otherwise("A@/href").alias("path"), F.element_at(F.array(F.lit("../up?x"), F.lit("/root"), F.lit("https://o.example/z"), F.lit("i.png")), i + 1).alias("url"), F.concat(F.lit("a"), i.cast("string")).alias("text")))
    http = F.struct(F.struct(F.lit("200").alias("Status")).alias("Response-Message"), F.struct(F.lit("text/html").alias("Content-Type")).alias("Headers"), F.struct(F.struct(F.concat(F.lit("T"), F.col("page_id").cast("string")).alias("Title"), F.array(F.struct(F.lit("Description").alias("name"), F.lit("D").alias("content"))).alias("Metas")).alias("Head"), each.alias("Links")).alias("HTML-Metadata"))
    meta = F.struct(F.when(F.col("page_id") % 5 != 0, http).alias("HTTP-Response-Metadata"))
    head = F.struct(F.concat(F.lit("https://h"), F.col("page_id").cast("string"), F.lit(".example.com/a/b/c")).alias("WARC-Target-URI"), F.lit("2024-01-02T03:04:05Z").alias("WARC-Date"))
    line = F.when(F.col("page_id") % 7 == 0, "no json").otherwise(F.to_json(F.struct(F.struct(head.alias("WARC-Header-Metadata"), meta.alias("Payload-Metadata")).alias("Envelope"))))
    return samples.compacted(p.select(line.alias("value")), V.CRAWL)


_KEPT = "page_id % 5 <> 0 AND page_id % 7 <> 0"


@query("p3_compact", f"SELECT 'https://h' || page_id || '.example.com/a/b/c' AS source_url, 'h' || page_id || '.example.com' AS source_host, '200' AS status, 'text/html' AS content_type, 'T' || page_id AS title, 'D' AS description, CAST(NULL AS VARCHAR) AS canonical FROM pages WHERE {_KEPT}")
def p3(spark, sf):
    return samples.pages(_compact(spark, sf)).select("source_url", "source_host", "status", "content_type", "title", "description", "canonical")


@query("s17_links", f"SELECT 'https://h' || page_id || '.example.com/a/b/c' AS source_url, CASE i WHEN 0 THEN 'https://h' || page_id || '.example.com/a/up?x' WHEN 1 THEN 'https://h' || page_id || '.example.com/root' ELSE 'https://o.example/z' END AS target_url, CASE i WHEN 2 THEN 'o.example' ELSE 'h' || page_id || '.example.com' END AS target_host, 'a' || i AS anchor FROM (SELECT page_id, unnest(range(0, least(3, page_id % 4 + 1))) AS i FROM pages WHERE {_KEPT})")
def s17(spark, sf):
    return samples.links(_compact(spark, sf)).select("source_url", "target_url", "target_host", "anchor")


@query("a29_link_volume", f"SELECT count(*) AS pages, sum(least(3, page_id % 4 + 1))::BIGINT AS links, round(sum(least(3, page_id % 4 + 1)) / count(*), 1) AS links_per_page FROM pages WHERE {_KEPT}")
def a29(spark, sf):
    return samples.link_volume(_compact(spark, sf)).select("pages", "links", "links_per_page")


@query("s17_cleaned", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'text/html; x' WHEN 1 THEN 'text/plain' ELSE NULL END AS content_type FROM supplier")
def s17_cleaned(spark, sf):
    n = F.col("s_suppkey") % 3
    return samples.cleaned(V.table(spark, sf, "supplier").select("s_suppkey", F.when(n == 0, '["text/html","x"]').when(n == 1, "text/plain").alias("content_type")))


# document lists: every collection, with a filter and its references


@query("j5_owned", "SELECT count(*) AS n FROM orders WHERE o_custkey % 50 IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def j5(spark, sf):
    rows = V.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("website_id"))
    sites = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("user_id"))
    return collections.owned(rows, sites, "3").agg(F.count("*").alias("n"))


def _listed(spec: collections.Collection):
    """A list query over the orders as that collection's documents, and its SQL.

    The first filter that is not a state is set to 1; filters and references hold
    the customer modulo 7, and parents are the nations.
    """
    columns = sorted({*spec.filters, *spec.references} - {"state", spec.sort})
    chosen = next((f for f in spec.filters if f != "state"), None)
    state = "state" in spec.filters or spec.soft_delete
    own = ", ".join(f"o_custkey % 7 AS {c}" for c in columns)
    key = "'k' || (o_orderkey % 1000) AS key, " if spec.sort == "key" else ""
    where = " AND ".join(filter(None, [f"o_custkey % 7 = {1 if chosen != 'key' else 0}" if chosen in columns else "", "o_orderstatus <> 'F'" if spec.soft_delete else ""]))
    states = "CASE o_orderstatus WHEN 'F' THEN 'deleted' WHEN 'O' THEN 'active' END AS state, " if state else ""
    order = "key, id" if spec.sort == "key" else "created_at DESC, id"
    base = f"SELECT o_orderkey AS id, {states}{key}{own + ', ' if own else ''}o_orderdate AS created_at FROM orders" + (f" WHERE {where}" if where else "")
    joins = "".join(f" LEFT JOIN nation n{i} ON n{i}.n_nationkey = d.{c}" for i, c in enumerate(spec.references))
    shown = "".join(f", n{i}.n_name AS {c}_public" for i, c in enumerate(spec.references))
    sql = f"SELECT d.*{shown} FROM (SELECT * FROM ({base}) ORDER BY {order} LIMIT 20 OFFSET 20) d{joins}"

    def run(spark, sf):
        o = V.table(spark, sf, "orders")
        status = F.col("o_orderstatus")
        docs = o.select(
            F.col("o_orderkey").alias("id"), *([F.when(status == "F", "deleted").when(status == "O", "active").alias("state")] if state else []), *([F.concat(F.lit("k"), (F.col("o_orderkey") % 1000).cast("string")).alias("key")] if spec.sort == "key" else []),
            *[(F.col("o_custkey") % 7).alias(c) for c in columns], F.col("o_orderdate").alias("created_at"),
        )
        nations = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("public_id"))
        return collections.listed(docs, spec, {chosen: 1} if chosen in columns else None, {p: nations for p in spec.references.values()}, page=2)

    return sql, run


for _spec in collections.COLLECTIONS.values():
    _sql, _run = _listed(_spec)
    query(f"r15_{_spec.name}", _sql)(_run)
