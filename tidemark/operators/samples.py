"""The sample tables in JSON lines: archive envelopes, compact pages, pages, links and their volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native as N

_LINK = "array<struct<url:string,anchor:string>>"
COMPACT = f"crawl string, source_url string, source_host string, crawled_at string, status string, content_type string, title string, description string, canonical string, links {_LINK}"


def read_lines(spark: SparkSession, path: str, schema: str = COMPACT) -> DataFrame:
    """JSON lines by a given schema, so nothing is read twice; lines that are no JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_lines(table: DataFrame, path: str) -> None:
    table.write.mode("errorifexists").json(path)


def compacted(envelopes: DataFrame, crawl: str, payload: str = "value") -> DataFrame:
    """Compact pages of envelope lines: those with a response and an address; links that are anchors with an address."""
    v = F.try_parse_json(payload)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)

    def q(*names: str) -> str:
        return "$" + "".join(f"[\"{n}\"]" for n in names)

    base = ("Envelope", "Payload-Metadata", "HTTP-Response-Metadata")
    html = (*base, "HTML-Metadata")
    named = lambda path, key, value, wanted: F.filter(get(q(*path), f"array<struct<{key}:string,{value}:string>>"), lambda x: F.lower(x[key]) == wanted)[0][value]
    url = get(q("Envelope", "WARC-Header-Metadata", "WARC-Target-URI"))
    found = F.filter(get(q(*html, "Links"), "array<struct<path:string,url:string,text:string>>"), lambda x: (x["path"] == "A@/href") & (x["url"] != ""))
    links = F.coalesce(F.transform(found, lambda x: F.struct(x["url"].alias("url"), x["text"].alias("anchor"))), F.array().cast(_LINK))
    return envelopes.where(F.try_variant_get(v, q(*base), "variant").isNotNull() & (url != "")).select(
        F.lit(crawl).alias("crawl"), url.alias("source_url"), N.url_host(url).alias("source_host"), get(q("Envelope", "WARC-Header-Metadata", "WARC-Date")).alias("crawled_at"),
        get(q(*base, "Response-Message", "Status")).alias("status"), get(q(*base, "Headers", "Content-Type")).alias("content_type"), get(q(*html, "Head", "Title")).alias("title"),
        named((*html, "Head", "Metas"), "name", "content", "description").alias("description"), named((*html, "Head", "Link"), "rel", "url", "canonical").alias("canonical"), links.alias("links"),
    )


def pages(compact: DataFrame) -> DataFrame:
    return compact.drop("links")


def cleaned(pages: DataFrame, raw: str = "content_type") -> DataFrame:
    """Content types as text: a JSON list is joined by "; "."""
    items = F.from_json(F.col(raw), "array<string>")
    return pages.withColumn(raw, F.when(F.col(raw).startswith("["), F.coalesce(F.array_join(items, "; "), F.col(raw))).otherwise(F.col(raw)))


def _absolute(base: Column, ref: Column) -> Column:
    """A target against its page: absolute ones, those of the same scheme or host, fragments, queries, and paths with dots resolved."""
    top = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//([^/?#]*)", 0)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_extract(N.url_path(base), r"^(.*/)", 1)
    path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    rest = F.substring(ref, F.length(path) + 1, F.length(ref))
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))

    def step(done, part):
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(joined, "/", -1)
    clean = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    clean = F.when(F.element_at(parts, -1).isin(".", "..") & ~clean.endswith("/"), F.concat(clean, F.lit("/"))).otherwise(clean)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(scheme, ref)).when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .when(ref.startswith("?"), F.concat(plain, ref)).otherwise(F.concat(top, clean, rest))
    )


def links(compact: DataFrame) -> DataFrame:
    """One row per link with an address, resolved against its page in the JVM."""
    each = compact.where("source_url <> ''").select("crawl", "source_url", "source_host", F.explode("links").alias("l"), "crawled_at").where("l.url <> ''")
    target = _absolute(F.col("source_url"), F.col("l.url"))
    out = each.withColumn("target_url", target)
    return out.select("crawl", "source_url", "source_host", "target_url", N.url_host("target_url").alias("target_host"), F.col("l.anchor").alias("anchor"), "crawled_at")


def link_volume(compact: DataFrame) -> DataFrame:
    """One row: pages, links, links a page, megabytes, and how much of them links are."""
    size = lambda x: F.sum(F.octet_length(F.to_json(x)))
    m = compact.agg(F.count("*").alias("pages"), F.sum(F.size("links")).alias("links"), size(F.struct(*compact.columns)).alias("bytes"), size(F.col("links")).alias("link_bytes"))
    return m.select("pages", "links", F.round(F.col("links") / F.col("pages"), 1).alias("links_per_page"), F.round(F.col("bytes") / 1e6, 1).alias("megabytes"), F.round(F.col("link_bytes") / 1e6, 1).alias("link_megabytes"), F.round(100 * F.col("link_bytes") / F.col("bytes"), 1).alias("link_percent"))
