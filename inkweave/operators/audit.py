"""Ten drift checks; each returns rule, key and detail, and all of them together the audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.operators.graph import edges_of

# Documents that never go stale, by kind and by path (LIKE patterns).
EVERGREEN_TYPES = ("hub", "journal")
EVERGREEN_PATHS = (
    "CLAUDE.md",
    "%/CLAUDE.md",
    "README.md",
    "%/README.md",
    "%/_templates/%",
    "memory/people/%",
    "personal/00-reference/principles/%",
)


def ghost_projects(project: DataFrame) -> DataFrame:
    return project.filter("is_ghost").select("slug")


def ghost_people(person: DataFrame, edge: DataFrame, min_mentions: int = 2) -> DataFrame:
    m = edges_of(edge, "MENTIONS").groupBy(F.col("target_id").alias("slug")).agg(F.count_distinct("source_id").alias("mentions"))
    return person.filter("is_ghost").select("slug", "display_name").join(m.filter(F.col("mentions") >= min_mentions), "slug")


def one_way_edges(edge: DataFrame) -> DataFrame:
    """Sibling edges without any related edge back."""
    r = edges_of(edge, "RELATED_TO", None)
    back = r.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"))
    return r.filter("edge_subtype = 'sibling'").select("source_id", "target_id").join(back, ["source_id", "target_id"], "left_anti")


def stale_active_docs(docs: DataFrame, project: DataFrame, edge: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Active documents not touched for ``days``; a project's hub is as fresh as its newest member.

    docs: with effective status and governed.  as_of: an ISO date.
    """
    hub_of = project.filter("hub_doc is not null").select("slug", F.col("hub_doc").alias("path"))
    touched = edges_of(edge, "MEMBER_OF_PROJECT").select("source_id", F.col("target_id").alias("slug")).join(docs.select(F.col("path").alias("source_id"), F.col("last_modified").alias("m")), "source_id")
    newest = hub_of.join(touched, "slug").groupBy("path").agg(F.max("m").alias("newest_member"))
    d = docs.join(newest, "path", "left").join(hub_of.select("path", F.lit(True).alias("is_hub")).distinct(), "path", "left")
    last = F.when(F.col("doc_type") == "hub", F.greatest("last_modified", "newest_member")).otherwise(F.col("last_modified"))
    evergreen = reduce(lambda a, b: a | b, (F.col("path").ilike(p) for p in EVERGREEN_PATHS), F.coalesce("doc_type", F.lit("")).isin(*EVERGREEN_TYPES))
    old = F.substring(last, 1, 10) < F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")
    return d.filter((F.col("status") == "active") & ~F.col("governed") & old & (F.col("is_hub").isNotNull() | ~evergreen)).select("path", last.alias("last_activity"))


def inconsistent_hub_state(doc: DataFrame, edge: DataFrame) -> DataFrame:
    """Active hubs that block documents which are done or blocked by their own status."""
    e = edges_of(edge, "BLOCKS").filter("edge_subtype = 'downstream'").select("source_id", "target_id")
    hub = doc.filter("doc_type = 'hub' and status = 'active'").select(F.col("path").alias("source_id"))
    done = doc.filter("status in ('done', 'blocked')").select(F.col("path").alias("target_id"), F.col("status").alias("target_status"))
    return e.join(hub, "source_id").join(done, "target_id").select("source_id", "target_id", "target_status")


def orphan_docs(docs: DataFrame, edge: DataFrame) -> DataFrame:
    inbound = edge.filter("target_type = 'doc' and edge_type in ('LINKS_TO', 'RELATED_TO', 'BLOCKS')").select(F.col("target_id").alias("path")).distinct()
    return docs.filter((F.col("status") == "active") & ~F.col("doc_type").eqNullSafe("hub")).select("path").join(inbound, "path", "left_anti")


def decision_drift(decision: DataFrame, edge: DataFrame) -> DataFrame:
    about = edges_of(edge, "ABOUT_DECISION", "decision").select(F.col("source_id").alias("id"))
    return decision.filter("status = 'active'").select("id", "date").join(about, "id", "left_anti")


def tag_drift(edge: DataFrame, max_count: int = 2) -> DataFrame:
    return edges_of(edge, "TAGGED", None).groupBy(F.col("target_id").alias("tag")).agg(F.count("*").alias("uses")).filter(F.col("uses") <= max_count)


def format_drift(drift: DataFrame) -> DataFrame:
    return drift.filter("artifact_kind = 'decision'").select(F.col("artifact_id").alias("id"), "notes")


def findings(doc: DataFrame, docs: DataFrame, project: DataFrame, person: DataFrame, edge: DataFrame, broken: DataFrame, decision: DataFrame, drift: DataFrame, as_of: str) -> DataFrame:
    """rule, key of every check; keys are what a suppression names."""
    pair = lambda a, b: F.concat_ws("::", a, b)
    parts = {
        "ghost_projects": ghost_projects(project).select(F.col("slug").alias("key")),
        "ghost_people": ghost_people(person, edge).select(F.col("slug").alias("key")),
        "broken_links": broken.select(pair("source_doc", "link_target").alias("key")),
        "one_way_edges": one_way_edges(edge).select(pair("source_id", "target_id").alias("key")),
        "stale_active_docs": stale_active_docs(docs, project, edge, as_of).select(F.col("path").alias("key")),
        "inconsistent_hub_state": inconsistent_hub_state(doc, edge).select(pair("source_id", "target_id").alias("key")),
        "orphan_docs": orphan_docs(docs, edge).select(F.col("path").alias("key")),
        "decision_drift": decision_drift(decision, edge).select(F.col("id").alias("key")),
        "tag_drift": tag_drift(edge).select(F.col("tag").alias("key")),
        "decisions_format_drift": format_drift(drift).select(F.col("id").alias("key")),
    }
    return reduce(DataFrame.unionByName, (d.select(F.lit(rule).alias("rule"), "key") for rule, d in parts.items()))


def suppress(found: DataFrame, suppressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, rule and n of what was suppressed).  suppressions: rule, key."""
    s = suppressions.select("rule", "key").distinct()
    return found.join(s, ["rule", "key"], "left_anti"), found.join(s, ["rule", "key"], "left_semi").groupBy("rule").agg(F.count("*").alias("n"))
