"""Page audit: parsed pages, rules that give issues, scores and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import native as N

#: Fixed values: (rule, category, severity).
RULES = (
    ("robots-txt-missing", "crawlability", "medium"),
    ("sitemap-missing", "crawlability", "high"),
    ("sitemap-url-error", "crawlability", "high"),
    ("broken-internal-link", "links", "critical"),
    ("slow-response-time", "performance", "medium"),
    ("noindex-detected", "indexability", "critical"),
    ("canonical-invalid", "indexability", "medium"),
    ("canonical-missing", "indexability", "medium"),
    ("canonical-external", "indexability", "high"),
    ("title-missing", "metadata", "critical"),
    ("title-too-long", "metadata", "low"),
    ("title-too-short", "metadata", "low"),
    ("meta-desc-missing", "metadata", "high"),
    ("meta-desc-too-long", "metadata", "low"),
    ("h1-missing", "content", "high"),
    ("h1-multiple", "content", "medium"),
    ("jsonld-syntax-error", "structured-data", "high"),
    ("duplicate-titles", "metadata", "high"),
    ("thin-content", "content", "medium"),
)
#: What an issue takes off the score.
WEIGHTS = {"critical": 15, "high": 10, "medium": 5, "low": 2, "info": 0}


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, description, canonical, robots, headings and links by regular expressions, in the JVM."""
    h = F.col(html)
    text = lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))
    one = lambda p: F.nullif(text(F.regexp_extract(h, p, 1)), F.lit(""))
    return pages.select(
        "*",
        one(r"(?is)<title[^>]*>(.*?)</title>").alias("title"),
        one(r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)""").alias("description"),
        one(r"""(?is)<link[^>]+rel=["']canonical["'][^>]+href=["']([^"']*)""").alias("canonical"),
        h.rlike(r"""(?is)<meta[^>]+name=["']robots["'][^>]+noindex""").alias("noindex"),
        F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)), text).alias("h1"),
        F.size(F.regexp_extract_all(h, F.lit(r"(?i)<h2[\s>]"), F.lit(0))).alias("h2_count"),
        F.array_distinct(F.regexp_extract_all(h, F.lit(r"""(?i)<a[^>]+href=["']([^"'#]+)"""), F.lit(1))).alias("hrefs"),
    )


def _rule(name: str, when: Column, evidence: Column) -> Column:
    category, severity = next(r[1:] for r in RULES if r[0] == name)
    return F.when(when, F.struct(F.lit(name).alias("rule_id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), evidence.cast("string").alias("evidence")))


def issues(pages: DataFrame, host: str = "hostname") -> DataFrame:
    """One row per page and broken rule.

    `pages` has scan_id, url, hostname, status, response_ms, parsed (false where
    there is no HTML), title, description, canonical, canonical_error, noindex, h1
    and jsonld_valid.  All rules of a page are one array of a single projection;
    duplicate titles need one window by scan and title.
    """
    missing = lambda x: F.col(x).isNull() | (F.col(x) == "")
    html = F.col("parsed")
    canonical_host = N.url_host("canonical")
    bad = F.col("canonical").isNotNull() & (~F.col("canonical").rlike("^(?i)https?://") | canonical_host.isNull())
    n_h1 = F.size("h1")
    w = Window.partitionBy("scan_id", "title")
    p = pages.withColumn("_same", F.when(~missing("title") & html, F.count("*").over(w)).otherwise(0))
    found = F.array(
        _rule("broken-internal-link", ~F.col("status").isin(200, 0) & ((F.col("status") == 404) | (F.col("status") >= 500)), F.col("status")),
        _rule("slow-response-time", F.col("response_ms") > 1500, F.col("response_ms")),
        _rule("noindex-detected", html & F.col("noindex"), F.lit("noindex")),
        _rule("canonical-invalid", html & (F.col("canonical_error").isNotNull() | bad), F.coalesce("canonical_error", "canonical")),
        _rule("canonical-missing", html & F.col("canonical_error").isNull() & missing("canonical"), F.lit("")),
        _rule("canonical-external", html & F.col("canonical_error").isNull() & ~bad & (canonical_host != F.col(host)), F.col("canonical")),
        _rule("title-missing", html & missing("title"), F.lit("")),
        _rule("title-too-long", html & (F.length("title") > 60), F.col("title")),
        _rule("title-too-short", html & ~missing("title") & (F.length("title") < 10), F.col("title")),
        _rule("meta-desc-missing", html & missing("description"), F.lit("")),
        _rule("meta-desc-too-long", html & (F.length("description") > 160), F.col("description")),
        _rule("h1-missing", html & (n_h1 == 0), F.lit("")),
        _rule("h1-multiple", html & (n_h1 > 1), F.array_join("h1", "; ")),
        _rule("jsonld-syntax-error", html & ~F.col("jsonld_valid"), F.lit("")),
        _rule("duplicate-titles", F.col("_same") > 1, F.col("_same") - 1),
    )
    return p.select("scan_id", F.col("url").alias("affected_url"), F.explode(F.array_compact(found)).alias("i")).select("scan_id", "affected_url", "i.*")


def site_issues(sites: DataFrame) -> DataFrame:
    """Rules on a whole site: scan_id, start_url, discovery, robots_status, sitemap_missing, sitemap_errors; what is not confirmed is no finding."""
    on = F.col("discovery")
    found = F.array(
        _rule("robots-txt-missing", on & (F.col("robots_status") == 404), F.col("robots_status")),
        _rule("sitemap-missing", on & F.col("sitemap_missing"), F.lit("")),
        _rule("sitemap-url-error", on & (F.size("sitemap_errors") > 0), F.array_join("sitemap_errors", "; ")),
    )
    return sites.select("scan_id", F.col("start_url").alias("affected_url"), F.explode(F.array_compact(found)).alias("i")).select("scan_id", "affected_url", "i.*")


def weight(severity: str = "severity") -> Column:
    return F.coalesce(*[F.when(F.col(severity) == s, F.lit(w)) for s, w in WEIGHTS.items()], F.lit(0))


def severity_counts(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS])


def scores(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Score of each scan: 100 less the weights over the square root of its pages, within 0 and 100; and its checks."""
    n = pages.groupBy("scan_id").agg(F.count("*").alias("pages"))
    loss = found.groupBy("scan_id").agg(F.sum(weight()).alias("deduction"), F.count("*").alias("failed"))
    out = n.join(loss, "scan_id", "left").fillna(0, ["deduction", "failed"])
    raw = N.half_up(100 - F.col("deduction") / F.sqrt(F.greatest(F.col("pages"), F.lit(1))))
    return out.select("scan_id", "pages", "deduction", F.least(F.greatest(raw, F.lit(0)), F.lit(100)).cast("long").alias("score"), (10 * F.col("pages")).alias("total_checks"), "failed", F.greatest(10 * F.col("pages") - F.col("failed"), F.lit(0)).alias("passed"))


def coverage(pages: DataFrame) -> DataFrame:
    """One row of how many sound pages have a title, a description, exactly one heading and a canonical."""
    ok = pages.where((F.col("status") == 200) & F.col("parsed"))
    has = lambda x: F.count_if(F.col(x).isNotNull() & (F.col(x) != ""))
    return ok.agg(F.count("*").alias("pages"), has("title").alias("with_title"), has("description").alias("with_description"), has("canonical").alias("with_canonical"), F.count_if(F.size("h1") == 1).alias("with_one_h1"))


def robots_rules(lines: DataFrame) -> DataFrame:
    """Allow and disallow prefixes for all agents out of (site, line_no, line); lines before any agent count."""
    field = F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1)))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r":\s*([^#]*)", 1), r"\s+$", ""))
    w = Window.partitionBy("site").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("site", "line_no", field.alias("field"), value.alias("value"))
    rows = rows.withColumn("mine", F.coalesce(F.last(F.when(F.col("field") == "user-agent", F.col("value") == "*"), ignorenulls=True).over(w), F.lit(True)))
    return rows.where(F.col("mine") & F.col("field").isin("allow", "disallow") & (F.col("value") != "")).select("site", F.col("field").alias("kind"), F.col("value").alias("prefix"))


def robots_allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """Any allow prefix wins; else a disallow of everything or of a prefix blocks."""
    return F.exists(allow, lambda p: F.startswith(path, p)) | ~F.exists(disallow, lambda p: (p == "/") | F.startswith(path, p))
