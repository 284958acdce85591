"""One generic list query for the document collections: filter, hide deleted, resolve references, sort, page, count."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native as N


@dataclass(frozen=True)
class Collection:
    """How a collection is listed; references map a column to the collection it points to."""

    name: str
    filters: tuple[str, ...] = ()
    references: dict[str, str] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    soft_delete: bool = False
    sort: str = "created_at"
    descending: bool = True
    ttl_days: int | None = None


_D, _P, _U = {"domain_id": "domains"}, {"project_id": "projects"}, {"user_id": "users"}
COLLECTIONS = {
    c.name: c
    for c in (
        Collection("activity_logs", ("action", "project_id", "user_id"), _P | _U, ttl_days=365),
        Collection("api_keys", ("state", "user_id"), _U),
        Collection("audit_issues", ("assigned_to_user_id", "audit_id", "category", "domain_id", "page_id", "project_id", "severity", "state"), {"audit_id": "page_audits", "page_id": "pages", "assigned_to_user_id": "users"} | _D | _P),
        Collection("backlinks", ("is_lost", "is_no_follow", "link_location", "snapshot", "source_domain", "state", "target_domain_id"), {"target_domain_id": "domains", "crawl_source_id": "crawl_sources"}, ("target_domain_id", "source_url_hash", "target_url_hash", "snapshot"), True),
        Collection("cache_stats", (), _D | _P, ("domain_id", "key")),
        Collection("crawl_jobs", ("domain_id", "engine", "project_id", "status"), {"crawl_source_id": "crawl_sources"} | _D | _P | _U, ttl_days=90),
        Collection("crawl_snapshots", ("domain_id", "project_id", "snapshot"), {"crawl_job_id": "crawl_jobs"} | _D | _P, ("domain_id", "snapshot")),
        Collection("crawl_sources", ("is_active", "provider", "type")),
        Collection("domains", ("apex_domain", "project_id", "state"), _P, ("hostname", "project_id"), True),
        Collection("ga4_properties", ("domain_id", "project_id", "state"), _D | _P, ("domain_id", "property_id")),
        Collection("gsc_properties", ("domain_id", "project_id", "state"), _D | _P, ("domain_id", "site_url")),
        Collection("keyword_rankings", ("domain_id", "keyword_id", "project_id", "search_engine", "snapshot"), {"keyword_id": "keywords", "crawl_job_id": "crawl_jobs"} | _D | _P, ("keyword_id", "snapshot")),
        Collection("keywords", ("country", "device", "domain_id", "project_id", "search_engine", "state"), _D | _P, ("domain_id", "term", "search_engine", "country", "device"), True),
        Collection("page_ai_outputs", ("domain_id", "llm_model", "page_id", "project_id"), {"page_id": "pages"} | _D | _P, ("page_id", "prompt_hash")),
        Collection("page_audits", ("algorithm_version", "audit_date", "crawl_job_id", "domain_id", "page_id", "project_id"), {"page_id": "pages", "crawl_job_id": "crawl_jobs"} | _D | _P, ("page_id", "crawl_job_id", "algorithm_version")),
        Collection("page_metadata", ("domain_id", "page_id"), {"page_id": "pages"} | _D | _P, ("page_id",)),
        Collection("pages", ("discovery_source", "domain_id", "is_indexable", "project_id", "state", "status_code"), {"crawl_source_id": "crawl_sources", "crawl_job_id": "crawl_jobs"} | _D | _P, ("domain_id", "url_hash"), True),
        Collection("project_members", ("project_id", "state", "user_id"), {"invited_by": "users"} | _P | _U, ("project_id", "user_id"), True),
        Collection("projects", ("owner_id", "state"), {"owner_id": "users"}, (), True),
        Collection("raw_documents", ("crawl", "crawl_source_id", "domain_id", "page_id", "storage"), {"page_id": "pages", "crawl_source_id": "crawl_sources"} | _D),
        Collection("system_settings", ("key",), {"updated_by": "users"}, ("key",), sort="key", descending=False),
        Collection("users", ("state",), {}, ("email",), True),
    )
}


def matching(table: DataFrame, spec: Collection, filters: dict | None = None) -> DataFrame:
    """Rows that meet the equality filters that are set; deleted ones are hidden where the collection hides them."""
    for name, value in (filters or {}).items():
        if name not in spec.filters:
            raise ValueError(f"{spec.name} has no filter {name}")
        if value is not None and not (spec.soft_delete and name == "state"):
            table = table.where(F.col(name) == value)
    return table.where(N.not_deleted("state")) if spec.soft_delete else table


def listed(table: DataFrame, spec: Collection, filters: dict | None = None, parents: dict[str, DataFrame] | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """One page, newest first, with the public id of each parent (null where it is missing).

    The page is cut first, so the joins see at most `limit` rows.
    """
    if page < 1 or not 1 <= limit <= 100:
        raise ValueError("page starts at 1 and limit lies between 1 and 100")
    key = F.col(spec.sort).desc_nulls_last() if spec.descending else F.col(spec.sort).asc_nulls_first()
    out = matching(table, spec, filters).orderBy(key, "id").offset((page - 1) * limit).limit(limit)
    for column, parent in spec.references.items():
        if parents and parent in parents and column in out.columns:
            ids = parents[parent].select(F.col("id").alias(column), F.col("public_id").alias(f"{column}_public"))
            out = ids.join(F.broadcast(out), column, "right")
    return out


def count(table: DataFrame, spec: Collection, filters: dict | None = None) -> int:
    return matching(table, spec, filters).count()


def duplicate_keys(table: DataFrame, *key: str, most: int | None = 1000) -> DataFrame:
    found = table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return found if most is None else found.limit(most)


def without_children(children: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    """Children left after a cascade."""
    return children.join(deleted.select(F.col("id").alias(column)), column, "left_anti")


def of_parent(rows: DataFrame, parents: DataFrame, column: str, public_id: str) -> DataFrame:
    """Rows that point to the parent with a public id."""
    return rows.join(parents.where(F.col("public_id") == public_id).select(F.col("id").alias(column)), column, "left_semi")


def owned(rows: DataFrame, resources: DataFrame, user: str) -> DataFrame:
    return rows.join(resources.where(F.col("user_id") == user).select(F.col("id").alias("website_id")), "website_id", "left_semi")


def search(table: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows where any column holds the text, whatever the case; an empty text finds all."""
    needle = text.strip().lower()
    if not needle:
        return table
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    return table.where(test)
