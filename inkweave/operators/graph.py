"""Queries of the document graph: effective status, lists, blockers, projects, people, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like_prefix(path: Column, scope: str) -> Column:
    """A path prefix as LIKE reads it: ASCII case is ignored, ``_`` and ``%`` in the scope are wild."""
    return path.ilike(f"{scope.rstrip('/')}/%")


def edges_of(edge: DataFrame, kind: str, source_type: str | None = "doc") -> DataFrame:
    e = edge.filter(F.col("edge_type") == kind)
    return e.filter(F.col("source_type") == source_type) if source_type else e


def governing_hubs(doc: DataFrame, project: DataFrame, edge: DataFrame) -> DataFrame:
    """path, hub_path, hub_status: every hub of a project that a document is a member of, other than itself."""
    members = edges_of(edge, "MEMBER_OF_PROJECT").select(F.col("source_id").alias("path"), F.col("target_id").alias("slug"))
    hubs = project.select("slug", F.col("hub_doc").alias("hub_path")).filter("hub_path is not null")
    status = doc.select(F.col("path").alias("hub_path"), F.col("status").alias("hub_status"))
    # Hubs get their states first, so that members, of which there are most, move once.
    return members.join(hubs.join(status, "hub_path"), "slug").filter("hub_path <> path").select("path", "hub_path", "hub_status")


def effective_status(doc: DataFrame, project: DataFrame, edge: DataFrame) -> DataFrame:
    """doc with own_status, status (effective) and governed (a document that is no hub and has a governing hub).

    The best hub is an active one, then the smallest path; a grouped minimum of a struct, so the shuffle carries partial
    results only.
    """
    order = F.when(F.col("hub_status") == "active", 0).when(F.col("hub_status").isNotNull(), 1).otherwise(2)
    best = governing_hubs(doc, project, edge).groupBy("path").agg(F.min(F.struct(order.alias("o"), "hub_path", "hub_status")).alias("best"))
    own = F.col("status")
    inherited = F.coalesce(F.nullif(own, F.lit("active")), F.col("best.hub_status"), own)
    hub = F.col("doc_type").eqNullSafe("hub")
    out = doc.join(best, "path", "left")
    return out.select(*doc.columns[: doc.columns.index("status")], own.alias("own_status"), F.when(hub, own).otherwise(inherited).alias("status"), *doc.columns[doc.columns.index("status") + 1 :], (~hub & F.col("best").isNotNull()).alias("governed"))


def in_project(docs: DataFrame, edge: DataFrame, slug: str) -> DataFrame:
    e = edges_of(edge, "MEMBER_OF_PROJECT").filter(F.col("target_id") == slug).select(F.col("source_id").alias("path")).distinct()
    return docs.join(e, "path", "left_semi")


def with_tags(docs: DataFrame, edge: DataFrame, tags: list[str]) -> DataFrame:
    """Documents that have all of the tags: one pass over the tag edges."""
    e = edges_of(edge, "TAGGED").filter(F.col("target_id").isin(tags)).groupBy(F.col("source_id").alias("path")).agg(F.count_distinct("target_id").alias("n"))
    return docs.join(e.filter(F.col("n") == len(set(tags))), "path", "left_semi")


def list_active(docs: DataFrame, edge: DataFrame, scope: str | None = None, project: str | None = None) -> DataFrame:
    """docs: with effective status."""
    d = docs.filter("status = 'active'")
    if scope:
        d = d.filter(like_prefix(F.col("path"), scope))
    return in_project(d, edge, project) if project else d


def newest(docs: DataFrame, limit: int) -> DataFrame:
    """A negative limit gives nothing; the path breaks ties."""
    return docs.orderBy(F.col("last_modified").desc_nulls_last(), "path").limit(max(0, limit))


def blockers(edge: DataFrame) -> DataFrame:
    """path, blocker: inbound downstream edges and outbound upstream edges, each pair once."""
    e = edges_of(edge, "BLOCKS", None)
    inbound = e.filter("target_type = 'doc' and edge_subtype = 'downstream'").select(F.col("target_id").alias("path"), F.col("source_id").alias("blocker"))
    outbound = e.filter("source_type = 'doc' and edge_subtype = 'upstream'").select(F.col("source_id").alias("path"), F.col("target_id").alias("blocker"))
    return inbound.unionByName(outbound).distinct()


def blocked_with_blockers(docs: DataFrame, edge: DataFrame) -> DataFrame:
    lists = blockers(edge).groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("blocker")), ",").alias("blockers"))
    return docs.filter("status = 'blocked'").select("path", "title", "last_modified").join(lists, "path", "left").fillna("", ["blockers"])


def members(docs: DataFrame, edge: DataFrame) -> DataFrame:
    """slug with every member document; target_type is not looked at."""
    e = edges_of(edge, "MEMBER_OF_PROJECT").select(F.col("source_id").alias("path"), F.col("target_id").alias("slug"))
    return e.join(docs, "path")


def status_mix(docs: DataFrame, edge: DataFrame) -> DataFrame:
    return members(docs, edge).groupBy("slug", F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def project_decisions(edge: DataFrame, decision: DataFrame) -> DataFrame:
    """slug, id, date, title: decisions about a project's members, each once."""
    member = edges_of(edge, "MEMBER_OF_PROJECT").select(F.col("source_id").alias("path"), F.col("target_id").alias("slug"))
    about = edges_of(edge, "ABOUT_DECISION", "decision").select(F.col("source_id").alias("id"), F.col("target_id").alias("path"))
    return about.join(member, "path").select("slug", "id").distinct().join(decision.select("id", "date", "title"), "id")


def who(person: DataFrame, alias: DataFrame, names: DataFrame) -> DataFrame:
    """name -> slug for every name of ``names``: by display name, then slug, then alias, ASCII case ignored."""
    keys = person.select(F.lower("display_name").alias("key"), "slug", F.lit(0).alias("rank"))
    keys = keys.unionByName(person.select(F.lower("slug").alias("key"), "slug", F.lit(1).alias("rank"))).unionByName(alias.select(F.lower("alias").alias("key"), "slug", F.lit(2).alias("rank")))
    found = names.select("name", F.lower("name").alias("key")).distinct().join(keys, "key").groupBy("name").agg(F.min(F.struct("rank", "slug")).alias("m"))
    return found.select("name", F.col("m.slug").alias("slug"), F.col("m.rank").alias("matched_by"))


def mentions(docs: DataFrame, edge: DataFrame) -> DataFrame:
    e = edges_of(edge, "MENTIONS").select(F.col("source_id").alias("path"), F.col("target_id").alias("slug"))
    return e.join(docs, "path")


def decision_links(decision: DataFrame, edge: DataFrame) -> DataFrame:
    """id with sorted lists about_docs, supersedes, superseded_by (comma-joined): three grouped lists, no lookups per row."""

    def grouped(e: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return e.groupBy(F.col(key).alias("id")).agg(F.array_join(F.sort_array(F.collect_list(value)), ",").alias(name))

    about, sup = edges_of(edge, "ABOUT_DECISION", "decision"), edges_of(edge, "SUPERSEDES", "decision")
    out = decision.select("id", "date", "title", "status")
    for g in (grouped(about, "source_id", "target_id", "about_docs"), grouped(sup, "source_id", "target_id", "supersedes"), grouped(sup, "target_id", "source_id", "superseded_by")):
        out = out.join(g, "id", "left")
    return out.fillna("", ["about_docs", "supersedes", "superseded_by"])


def decisions(decision: DataFrame, topic: str | None = None, since: str | None = None) -> DataFrame:
    d = decision
    if since:
        d = d.filter(F.col("date") >= since)
    if topic:
        d = d.filter(F.col("title").ilike(f"%{topic}%") | F.col("decision_text").ilike(f"%{topic}%"))
    return d


def neighbours(edge: DataFrame, path: str, outbound: bool = True) -> DataFrame:
    if outbound:
        return edge.filter((F.col("source_type") == "doc") & (F.col("source_id") == path)).select("edge_type", "edge_subtype", "target_type", "target_id")
    return edge.filter((F.col("target_type") == "doc") & (F.col("target_id") == path)).select("edge_type", "edge_subtype", "source_type", "source_id")


def entity_majority(edge: DataFrame) -> DataFrame:
    """slug, entity, votes: the entity of most member documents; ties go to the first name."""
    p = edges_of(edge, "MEMBER_OF_PROJECT").select("source_id", F.col("target_id").alias("slug"))
    e = edges_of(edge, "MEMBER_OF_ENTITY").select("source_id", F.col("target_id").alias("entity"))
    votes = p.join(e, "source_id").groupBy("slug", "entity").agg(F.count("*").alias("votes"))
    best = votes.groupBy("slug").agg(F.min(F.struct((-F.col("votes")).alias("v"), "entity")).alias("m"))
    return best.select("slug", F.col("m.entity").alias("entity"), (-F.col("m.v")).alias("votes"))


def resolve_hubs(docs: DataFrame, edge: DataFrame) -> DataFrame:
    """slug, hub_doc: the smallest path of a hub document that is a member of the project."""
    return members(docs.filter("doc_type = 'hub'"), edge).groupBy("slug").agg(F.min("path").alias("hub_doc"))
