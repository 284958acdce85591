"""Literal expectations of the library's own operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import native as N
from tidemark.operators import collections, graphdict, history, links, manifests, quality, samples, search, seo

LINKS = "crawl string, source_url string, source_host string, target_url string, target_host string, anchor string, crawled_at timestamp_ntz"


@pytest.fixture(scope="module")
def sample(spark):
    rows = [
        ("CC-TEST", "https://a.example/one", "a.example", "https://target.example/a", "target.example", "Alpha", None),
        ("CC-TEST", "https://a.example/two", "a.example", "https://target.example/a", "target.example", "Alpha", None),
        ("CC-TEST", "https://b.example/", "b.example", "https://target.example/b", "target.example", "Beta", None),
        ("CC-TEST", "https://source.example/", "source.example", "https://other.example/", "other.example", None, None),
    ]
    return spark.createDataFrame(rows, LINKS)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bucket_and_rollup(spark, sample, tmp_path):
    assert value(spark, N.host_bucket(F.lit("github.com"))) == "0235"
    path = str(tmp_path / "details")
    links.write_details(sample, path, partitions=4)
    back = links.read_details(spark, path)
    assert back.count() == 4 and dict(back.dtypes)["target_host_bucket"] == "string"
    assert links.host_summary(links.of_host(back, "target.example")).first()[:3] == (3, 2, 2)
    with pytest.raises(Exception, match="(?i)exists"):
        links.write_details(sample, path)
    assert quality.missing_buckets(back).count() == 1024 - back.select("target_host_bucket").distinct().count()


def test_lookup_pages(sample):
    assert links.lookup(sample, "CC-TEST", "target.example", page=-4, size=0).count() <= 1
    with pytest.raises(ValueError):
        links.top_anchors(sample, 0)
    assert links.foreign_crawls("CC-TEST", sample) == 0


def test_dictionary_round_trip(spark):
    ls = spark.createDataFrame([("c", "https://a.example/", "a.example", "https://b.example/", "b.example", "first", None), ("c", "https://b.example/", "b.example", "https://a.example/", "a.example", None, None)], LINKS)
    pages = spark.createDataFrame([("c", "https://b.example/", "b.example", "https://a.example/")] * 50, "crawl string, source_url string, source_host string, canonical string")
    d = graphdict.dictionaries(pages, ls)
    assert d["urls"].count() == 2 and graphdict.host_conflicts(pages, ls).isEmpty()
    back = graphdict.decode(graphdict.edges(ls), d).select(*ls.columns)
    assert back.exceptAll(ls).isEmpty() and ls.exceptAll(back).isEmpty()


def test_sites(spark):
    cases = {"example.com": "example.com", "www.shop.example.co.uk": "example.co.uk", "co.uk": None, "127.0.0.1": None, "x.unknownsuffix": None}
    for host, domain in cases.items():
        assert value(spark, N.registrable_domain(F.lit(host))) == domain
    assert not value(spark, N.external_link(F.lit(None).cast("string"), F.lit("example.com")))
    assert not value(spark, N.external_link(F.lit("www.example.com"), F.lit("blog.example.com")))
    assert value(spark, N.external_link(F.lit("referrer.net"), F.lit("example.com")))


def test_public_suffix_file(spark):
    text = "// a comment\n// ===BEGIN ICANN DOMAINS===\ncom\n*.ck\n!www.ck\nkawasaki.jp\njp\n*.kawasaki.jp\n!city.kawasaki.jp\n// ===END ICANN DOMAINS===\nblogs.com\n"
    rules = N.suffix_rules(text.split("\n"))
    cases = {"a.blogs.com": "blogs.com", "shop.co.ck": "shop.co.ck", "co.ck": None, "www.ck": "www.ck", "x.www.ck": "www.ck", "y.city.kawasaki.jp": "city.kawasaki.jp", "z.b.kawasaki.jp": "z.b.kawasaki.jp", "b.kawasaki.jp": None, "m.n.jp": "n.jp", "x.nowhere": None}
    for host, want in cases.items():
        assert value(spark, N.registrable_domain(F.lit(host), **rules)) == want, host


def test_scalars(spark):
    assert value(spark, N.repair_mojibake(F.lit("FranÃ§ais"))) == "Français"
    assert value(spark, N.repair_mojibake(F.lit("日本"))) == "日本"
    assert value(spark, N.half_up(F.lit(-2.5))) == -2
    assert value(spark, N.url_host(F.lit("HTTPS://u@WWW.A_b.com:8/x"))) == "www.a_b.com"
    assert value(spark, N.wall_clock(F.lit("2026-07-10T01:02:03+05:00"))) == dt.datetime(2026, 7, 10, 1, 2, 3)
    assert value(spark, N.private_ipv4(F.lit("172.20.0.1"))) and not value(spark, N.private_ipv4(F.lit("8.8.8.8")))
    assert value(spark, N.device_category(F.lit("Android 9 tablet"))) == "tablet"


def test_unsafe_hosts_stay_small_expressions(spark):
    # every use of the host once stood for a copy of all that it was made of, which no driver could hold
    assert len(str(N.unsafe_host("x"))) < 10_000
    unsafe = {"::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False, "[FD00::1]": True, "1::2::3": True, "2606:4700::1": False, "10.1.2.3.": True, "example.com": False, "a.local": True, None: True}
    rows = spark.createDataFrame([(h,) for h in unsafe], "x string").select("x", N.unsafe_host("x").alias("unsafe")).collect()
    assert {r.x: r.unsafe for r in rows} == unsafe


def test_quota_windows_agree_with_sql_at_their_edges(spark, tmp_path):
    import duckdb

    from tidemark.plans import registry

    hours = ("2024-01-01 01:00:00", "1969-12-31 23:00:00", "1970-01-01 00:00:00", "1969-06-01 12:00:00")
    ms = "(values (-1001), (-1000), (-501), (-500), (-499), (-1), (0), (499), (500), (1500), (3599999500)) t(us)"
    db = duckdb.connect()
    db.sql("CREATE TABLE events AS SELECT row_number() OVER (ORDER BY h, us, u) AS event_id, h::TIMESTAMP + to_microseconds(us) AS ts, u AS user_id FROM (SELECT unnest(['" + "','".join(hours) + f"']) AS h), {ms}, range(2) r(u)")
    db.sql("INSERT INTO events VALUES (NULL, '2024-01-01 01:00:00', 0), (NULL, NULL, 1), (901, NULL, 1), (902, NULL, 1), (903, '2024-01-01 01:00:00', NULL)")
    db.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in registry.QUERIES["t4_quota"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(db.sql(registry.ORACLES["t4_quota"]).fetchall(), key=str)


def test_search_periods(spark):
    s = "query string, clicks double, impressions double, ctr double, position double"
    row = lambda q, c, i, p: (q, float(c), float(i), c / i, float(p))
    cur = spark.createDataFrame([row("oak table", 3, 310, 9), row("pine chair", 31, 260, 3), row("first seen", 1, 12, 15)], s)
    pre = spark.createDataFrame([row("oak table", 14, 280, 8), row("pine chair", 9, 240, 5)], s)
    j = search.compared(cur, pre, "query")
    assert search.quick_wins(j).first()["query"] == "oak table"
    assert search.ctr_opportunities(j).first()["query"] == "oak table"
    assert search.losers(j).first()["query"] == "oak table" and search.winners(j).first()["query"] == "pine chair"
    new = j.where("query = 'first seen'").first()
    assert new["previous"] is None and new["change"] is None
    twice = pre.unionByName(pre.withColumn("clicks", F.col("clicks") + 1)).withColumn("_ord", F.when(F.col("clicks") == 15, 0).otherwise(1))
    assert search.compared(cur, twice, "query").where("query = 'oak table'").first()["previous"]["clicks"] == 14
    daily = spark.createDataFrame([("a", 30.0, 250.0, 0.12, 2.0), ("b", 15.0, 750.0, 0.02, 6.0)], s)
    assert tuple(round(x, 6) for x in search.overview(daily).first()) == (45.0, 1000.0, 0.045, 5.0)
    assert tuple(search.overview(daily.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)
    assert search.periods("2026-08-10", 3) == ("2026-08-02", "2026-08-08", "2026-07-26", "2026-08-01")


def test_audit_score(spark):
    s = "scan_id int, url string, hostname string, status int, response_ms int, parsed boolean, title string, description string, canonical string, canonical_error string, noindex boolean, h1 array<string>, jsonld_valid boolean"
    pages = spark.createDataFrame([(1, "https://x.com/", "x.com", 200, 100, True, "A fine long title", "words", "https://x.com/", None, False, ["h"], True), (1, "https://x.com/b", "x.com", 200, 100, True, None, None, None, None, True, [], True)], s)
    found = seo.issues(pages)
    assert {r.rule_id for r in found.collect()} == {"noindex-detected", "canonical-missing", "title-missing", "meta-desc-missing", "h1-missing"}
    assert seo.scores(found, pages).first()["score"] == 61


def test_robots(spark):
    lines = ["Disallow: /early", "User-agent: *", "Disallow: /cart", "Allow: /cart/help", "User-agent: fetcher", "Disallow: /"]
    rules = seo.robots_rules(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "site string, line_no int, line string"))
    sets = rules.groupBy("site").agg(F.collect_list(F.when(F.col("kind") == "allow", F.col("prefix"))).alias("a"), F.collect_list(F.when(F.col("kind") == "disallow", F.col("prefix"))).alias("d"))
    got = {p: sets.select(seo.robots_allowed(F.lit(p), F.col("a"), F.col("d"))).first()[0] for p in ("/cart/7", "/cart/help/x", "/news", "/early")}
    assert got == {"/cart/7": False, "/cart/help/x": True, "/news": True, "/early": False}


def test_lifecycle_rounds(spark):
    key = "website_id string, rule_id string, affected_url string"
    empty = spark.createDataFrame([], key + ", status string, first_detected_at timestamp, last_detected_at timestamp, resolved_at timestamp, reoccurred_at timestamp, events array<struct<event:string,timestamp:timestamp,scan_id:string>>")
    one = spark.createDataFrame([("w", "r", "u")], key)
    h = history.lifecycle(empty, one, "1", "2026-01-01")
    h = history.lifecycle(h, one, "2", "2026-01-02")
    assert [e["event"] for e in h.first()["events"]] == ["detected"]
    h = history.lifecycle(h, one.limit(0), "3", "2026-01-03")
    h = history.lifecycle(h, one, "4", "2026-01-04")
    assert [e["event"] for e in h.first()["events"]] == ["detected", "resolved", "reoccurred"] and h.first()["resolved_at"] is None


def test_reachable_and_collections(spark):
    g = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source_url string, target_url string")
    assert {(r.url, r.depth) for r in history.reachable(g, ["a"]).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert len(collections.COLLECTIONS) == 22
    with pytest.raises(ValueError):
        collections.matching(g, collections.COLLECTIONS["users"], {"nope": 1})


def test_manifests(spark):
    inputs = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "idx int, path string")
    shards = quality.sharded(inputs, 3)
    assert sorted(r["count"] for r in shards.groupBy("shard_id").count().collect()) == [3, 3, 4]
    assert quality.cover_errors(inputs, shards).isEmpty() and quality.key_collisions(inputs).isEmpty()
    m = {"a": 1, "manifest_sha256": "x"}
    assert quality.self_hash(m) == quality.self_hash({"a": 1})


def test_lists_and_datasets(spark, tmp_path):
    import gzip
    import hashlib

    (tmp_path / "list.gz").write_bytes(gzip.compress("b/2\n\n a/1 \nc/3\n".encode()))
    got = manifests.input_list(spark, str(tmp_path / "list.gz"), ("given",), most=3).orderBy("idx").collect()
    assert [(r.idx, r.path) for r in got] == [(0, "given"), (1, "b/2"), (2, "a/1")]
    root = str(tmp_path / "set")
    spark.range(0, 1000, 1, 3).withColumn("t", F.lit("x")).write.parquet(root)
    one = manifests.dataset_summary(spark, root).first()
    names = sorted(p.name for p in (tmp_path / "set").glob("*.parquet"))
    tree = b"".join(n.encode() + b"\0" + hashlib.sha256((tmp_path / "set" / n).read_bytes()).hexdigest().encode() + b"\n" for n in names)
    assert (one.files, one["rows"], one.row_groups, one.codecs) == (3, 1000, 3, ["SNAPPY"]) and one.sha256 == hashlib.sha256(tree).hexdigest()
    assert {e.column for e in one.encodings} == {"id", "t"} and one.bytes == sum((tmp_path / "set" / n).stat().st_size for n in names)
    assert manifests.file_count(spark, root, 3) == 3
    listed = manifests.file_manifest(spark, root).collect()
    assert [r.path.rsplit("/", 1)[1] for r in listed] == names and sum(r["rows"] for r in listed) == 1000
    assert [r.sha256 for r in listed] == [hashlib.sha256((tmp_path / "set" / n).read_bytes()).hexdigest() for n in names]
    spark.range(5).write.parquet(str(tmp_path / "tree" / "k=1"))
    assert manifests.read_flat(spark, str(tmp_path / "tree")).columns == ["id"]
    with pytest.raises(ValueError):
        manifests.file_count(spark, root, 4)


def test_host_rollup_is_published_once(spark, sample, tmp_path):
    detail = links.details(sample)
    where = str(tmp_path / "out" / "target")
    m = links.host_rollup(detail, " Target.example ", str(tmp_path / "stage1"), where, "run-1", k=5)
    assert m["summary"] == {"observed_link_row_count": 3, "unique_referring_host_count": 2, "unique_target_page_count": 2, "nonempty_anchor_row_count": 3}
    assert quality.self_hash(m) == m["manifest_sha256"]
    sizes = {d: spark.read.parquet(f"{where}/dataset={d}").count() for d in ("domain-summary", "referring-hosts", "top-anchors", "top-linked-pages", "manifest")}
    assert sizes == {"domain-summary": 1, "referring-hosts": 2, "top-anchors": 2, "top-linked-pages": 2, "manifest": 1}
    with pytest.raises(FileExistsError):
        links.host_rollup(detail, "target.example", str(tmp_path / "stage2"), where, "run-2")
    with pytest.raises(LookupError):
        links.host_rollup(detail, "absent.example", str(tmp_path / "stage3"), str(tmp_path / "none"), "run-3")


def test_optimized_graph_checks_its_counts(spark, sample, tmp_path):
    pages = spark.createDataFrame([("CC-TEST", "https://b.example/", "b.example", None, None, "200", "x", "T", None)], "crawl string, source_url string, source_host string, canonical string, crawled_at timestamp_ntz, status string, content_type string, title string, description string")
    rows = graphdict.optimized(pages, sample, "CC-TEST", str(tmp_path / "g"), 8)
    assert rows == {"urls": 7, "hosts": 5, "anchors": 2, "crawls": 1, "edges": 4, "pages_optimized": 1}
    with pytest.raises(ValueError, match="crawl"):
        graphdict.optimized(pages, sample, "CC-OTHER", str(tmp_path / "h"))


def test_samples_round_trip(spark, tmp_path):
    row = ("c", "https://a.test/x/y", "a.test", "2020-01-01", "200", "t", "T", None, None, [("../z", "up"), ("#f", None), ("?q", ""), ("//b.test/w", "w"), ("mailto:x@y", "m")])
    compact = spark.createDataFrame([row], samples.COMPACT)
    samples.write_lines(compact, str(tmp_path / "lines"))
    with open(tmp_path / "lines" / "bad.json", "w") as f:
        f.write("{no json\n")
    back = samples.read_lines(spark, str(tmp_path / "lines"))
    assert back.count() == 1
    assert [r.target_url for r in samples.links(back).collect()] == ["https://a.test/z", "https://a.test/x/y#f", "https://a.test/x/y?q", "https://b.test/w", "mailto:x@y"]


def test_texts_and_predicates(spark):
    domains = {" Example.com ": "example.com", "https://www.Shop.example.co.uk/a?b": "www.shop.example.co.uk", "https://u@a.com": None, "a.com:443": None, "localhost": None, "ftp://a.com": None, "a b.com": None, "-a.com": None, "x" * 64 + ".com": None}
    for text, want in domains.items():
        assert value(spark, N.lookup_domain(F.lit(text))) == want, text
    xml = "<urlset><url><loc> https://a.com/1 </loc></url><loc>ftp://x</loc><LOC>http://a.com/2</LOC></urlset>"
    assert value(spark, N.sitemap_locations(F.lit(xml))) == ["https://a.com/1", "http://a.com/2"]
    assert value(spark, N.unblank_sha256(F.lit("\u00a0a "))) == value(spark, F.sha2(F.lit("a"), 256))
    assert value(spark, N.severity_matches(F.lit("warning"), "medium")) and not value(spark, N.severity_matches(F.lit(None).cast("string"), "high"))


def test_claimable_and_sound(spark):
    jobs = spark.createDataFrame([(1, "queued", None, None, None), (2, "queued", 0, None, "2026-01-02"), (3, "crawling", 1, "2025-12-31", None), (4, "crawling", 1, "2026-01-02", None), (5, "queued", 3, None, None), (6, "completed", 0, None, None), (7, None, None, None, None), (8, "analysing", 1, None, None), (9, "analysing", 1, None, None)], "id int, status string, attempts int, lease string, retry string")
    jobs = jobs.withColumn("lease_expires_at", F.col("lease").cast("timestamp")).withColumn("next_attempt_at", F.col("retry").cast("timestamp")).withColumn("created_at", F.when(F.col("id") == 9, F.lit("2025-12-31 23:50:00")).otherwise("2025-12-31").cast("timestamp"))
    assert [r.id for r in jobs.where(N.claimable("2026-01-01")).orderBy("id").collect()] == [1, 3, 8]
    pages = spark.createDataFrame([(200, None, ""), (200, "dns", None), (404, None, None), (None, None, None)], "status int, fetch_failure string, error string")
    assert pages.where(N.sound_page()).count() == 1


def test_duplicate_keys_query_has_no_row_limit(spark):
    from tidemark.plans import registry

    found = registry.QUERIES["a25_duplicate_keys"](spark, "/root/testdata/sf0.001")
    assert "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()
