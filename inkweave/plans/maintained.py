"""Registered queries of the maintained graph: a change log over one file for each user, applied in three parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.operators import maintain
from inkweave.plans.catalogue import query
from inkweave.sources.store import folder, written

#: Every change as a name-status entry; renames move a file into another folder.
LOG = """SELECT n, op, CASE WHEN op = 'R' THEN concat('new/', path) ELSE path END AS path, CASE WHEN op = 'R' THEN path END AS old_path FROM change_log"""
PARTS = (0.3, 0.6, 1.0)


def _kept(g) -> maintain.Graph:
    root = folder(g.spark, g.sf_dir, "maintained")
    graph = maintain.Graph.latest(g.spark, root)
    last = g.change_log.agg(F.max("n")).first()[0] or 0
    if graph.version.facts.get("applied") == last:
        return graph
    log = g.change_log.select("n", "op", F.when(F.col("op") == "R", F.concat(F.lit("new/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("op") == "R", F.col("path")).alias("old_path"))
    path = maintain.entries(log).select("path").distinct()
    u = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("int")
    link = lambda by, to: F.concat(F.lit(f"[{to}]("), ((u + by) % 97).cast("string"), F.lit(".md) "))
    text = F.concat(F.lit("---\ntags: [project/p"), (u % 7).cast("string"), F.when(u % 5 == 0, ", type/hub").otherwise(""), F.when(u % 3 == 0, ", status/active").otherwise(", status/done"), F.lit("]\n---\n# User "), u.cast("string"), F.lit("\n"), link(1, "next"), link(5, "far"))
    corpus = written(g.spark, path.withColumn("text", text))
    for share in PARTS:
        graph = maintain.apply_log(g.spark, root, log.filter(F.col("n") <= F.lit(int(last * share))), corpus, {"new/": "moved", "u/": "users"}, buckets=8)
    return graph


STATE = f"""l AS ({LOG}), e AS (SELECT n, 0 AS k, 'D' AS op, old_path AS path FROM l WHERE op = 'R' UNION ALL SELECT n, 1, CASE WHEN op = 'D' THEN 'D' ELSE 'M' END, path FROM l WHERE op IN ('A', 'M', 'D', 'R')),
    f AS (SELECT path, CAST(regexp_extract(path, '([0-9]+)\\.md$', 1) AS INT) AS u, regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir FROM (SELECT path, op, row_number() OVER (PARTITION BY path ORDER BY n DESC, k DESC) AS r FROM e) WHERE r = 1 AND op = 'M'),
    k AS (SELECT path, concat(dir, (u + b) % 97, '.md') AS target, concat((u + b) % 97, '.md') AS raw, CASE b WHEN 1 THEN 'next' ELSE 'far' END AS t FROM f, (SELECT unnest([1, 5]) AS b))"""


@query(f"""WITH {STATE}, own AS (SELECT path AS source_id, 'MEMBER_OF_PROJECT' AS edge_type, concat('p', u % 7) AS target_id FROM f UNION ALL SELECT path, 'TAGGED', concat('project/p', u % 7) FROM f UNION ALL SELECT path, 'TAGGED', CASE WHEN u % 3 = 0 THEN 'status/active' ELSE 'status/done' END FROM f
    UNION ALL SELECT path, 'TAGGED', 'type/hub' FROM f WHERE u % 5 = 0 UNION ALL SELECT path, 'MEMBER_OF_ENTITY', CASE WHEN starts_with(dir, 'new/') THEN 'moved' ELSE 'users' END FROM f UNION ALL SELECT DISTINCT path, 'LINKS_TO', target FROM k WHERE target IN (SELECT path FROM f)),
    v AS (SELECT concat('p', u % 7) AS slug, CASE WHEN starts_with(dir, 'new/') THEN 'moved' ELSE 'users' END AS entity, count(*) AS c FROM f GROUP BY 1, 2)
    SELECT * FROM own UNION ALL SELECT slug, 'MEMBER_OF_ENTITY', entity FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY c DESC, entity) AS r FROM v) WHERE r = 1""")
def graph_apply_edges(g):
    """All edges after a change log that comes in three parts: those of the files that are left."""
    return _kept(g).edge.select("source_id", "edge_type", "target_id")


@query(f"WITH {STATE} SELECT DISTINCT path AS source_doc, t AS link_text, raw AS link_target FROM k WHERE target NOT IN (SELECT path FROM f)")
def graph_apply_broken(g):
    return _kept(g).broken_link


@query(f"""WITH {STATE} SELECT slug, hub_doc, hub_doc IS NULL AS is_ghost FROM (SELECT concat('p', u % 7) AS slug, min(path) FILTER (WHERE u % 5 = 0) AS hub_doc FROM f GROUP BY 1)""")
def graph_apply_projects(g):
    return _kept(g).project.select("slug", "hub_doc", "is_ghost")
