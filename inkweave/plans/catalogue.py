"""The registered queries, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import scalars as S
from inkweave.operators import audit as A
from inkweave.operators import changes as C
from inkweave.operators import graph as G
from inkweave.operators import inverted as I
from inkweave.operators import retrieval as R
from inkweave.operators import text as T
from inkweave.sources.store import folder
from inkweave.sources.views import edges, oracle, view

AS_OF = "1998-12-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Graph:
    """The views of one folder, read as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def edges(self, *kinds: str) -> DataFrame:
        """The edges of some kinds; what a query does not name is not made for it."""
        return edges(self.spark, self.sf_dir, *kinds)

    @property
    def docs(self) -> DataFrame:
        """Documents with effective status."""
        return G.effective_status(self.doc, self.project, self.edges("MEMBER_OF_PROJECT"))

    @property
    def index(self) -> I.Index:
        """The index of all files with language and source as title, built by the first query of a session that asks for it."""
        index = I.Index(self.spark, folder(self.spark, self.sf_dir, "index"), ["title", "text"])
        return index if index.version() else index.upsert(self.file.withColumn("title", F.concat_ws(" ", "lang", "source")))

    def hits(self, *words: str, every: bool = False) -> DataFrame:
        """path, score of the files whose text has some, or every, word."""
        units = [I.word(w) for w in words]
        return (self.index.search(every=units, fields=["text"]) if every else self.index.search(some=units, fields=["text"])).select("path", F.round("score", 6).alias("score"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of a Graph under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = oracle(sql)
        return f

    return add


EFF = """gov AS (SELECT e.source_id AS path, h.path AS hp, h.status AS hs FROM edge e JOIN project p ON p.slug = e.target_id JOIN doc h ON h.path = p.hub_doc
    WHERE e.source_type = 'doc' AND e.edge_type = 'MEMBER_OF_PROJECT' AND h.path <> e.source_id),
  best AS (SELECT path, hs FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN hs = 'active' THEN 0 WHEN hs IS NOT NULL THEN 1 ELSE 2 END, hp) AS r FROM gov) WHERE r = 1),
  eff AS (SELECT d.path, d.title, d.status AS own, CASE WHEN d.doc_type = 'hub' THEN d.status ELSE coalesce(nullif(d.status, 'active'), b.hs, d.status) END AS status,
    d.doc_type, d.last_modified, (d.doc_type IS DISTINCT FROM 'hub' AND b.path IS NOT NULL) AS governed FROM doc d LEFT JOIN best b ON b.path = d.path)"""


# Status and lists


@query(f"WITH {EFF} SELECT path, own AS own_status, status FROM eff")
def effective_status(g):
    return g.docs.select("path", "own_status", "status")


@query(f"WITH {EFF} SELECT path FROM eff WHERE governed")
def has_governing_hub(g):
    return g.docs.filter("governed").select("path")


@query("SELECT coalesce(status, 'none') AS status, count(*) AS n FROM doc GROUP BY 1")
def status_counts(g):
    return g.doc.groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {EFF} SELECT path, title, status, doc_type, last_modified FROM eff WHERE status = 'active' ORDER BY last_modified DESC, path LIMIT 50")
def list_active(g):
    return G.newest(G.list_active(g.docs, g.edges("MEMBER_OF_PROJECT")), 50).select("path", "title", "status", "doc_type", "last_modified")


@query(f"WITH {EFF} SELECT path, last_modified FROM eff WHERE status = 'active' AND path ILIKE 'NATION_1%/%' ORDER BY last_modified DESC, path LIMIT 50")
def list_active_scope(g):
    return G.newest(G.list_active(g.docs, g.edges("MEMBER_OF_PROJECT"), scope="NATION_1%/"), 50).select("path", "last_modified")


@query(f"WITH {EFF} SELECT path, last_modified FROM eff WHERE status = 'active' AND path IN (SELECT source_id FROM edge WHERE edge_type = 'MEMBER_OF_PROJECT' AND target_id = 'c4') ORDER BY last_modified DESC, path LIMIT 50")
def list_active_project(g):
    return G.newest(G.list_active(g.docs, g.edges("MEMBER_OF_PROJECT"), project="c4"), 50).select("path", "last_modified")


@query(f"WITH {EFF} SELECT count(*) AS n FROM eff WHERE status = 'active'")
def count_active(g):
    return G.list_active(g.docs, g.edges("MEMBER_OF_PROJECT")).agg(F.count("*").alias("n"))


BLOCKERS = """blk AS (SELECT DISTINCT * FROM (SELECT target_id AS path, source_id AS blocker FROM edge WHERE edge_type = 'BLOCKS' AND target_type = 'doc' AND edge_subtype = 'downstream'
    UNION ALL SELECT source_id, target_id FROM edge WHERE edge_type = 'BLOCKS' AND source_type = 'doc' AND edge_subtype = 'upstream'))"""


@query(f"WITH {EFF}, {BLOCKERS} SELECT e.path, title, last_modified, coalesce(string_agg(blocker, ',' ORDER BY blocker), '') AS blockers FROM (SELECT * FROM eff WHERE status = 'blocked' ORDER BY last_modified DESC, path LIMIT 50) e LEFT JOIN blk USING (path) GROUP BY ALL")
def list_blocked(g):
    page = G.newest(g.docs.filter("status = 'blocked'"), 50)
    return G.blocked_with_blockers(page, g.edges("BLOCKS"))


@query(f"WITH {EFF} SELECT count(*) AS n FROM eff WHERE status = 'blocked'")
def count_blocked(g):
    return g.docs.filter("status = 'blocked'").agg(F.count("*").alias("n"))


@query(f"WITH {BLOCKERS} SELECT path, blocker FROM blk")
def blockers(g):
    return G.blockers(g.edges("BLOCKS"))


@query("SELECT source_id AS path, edge_type, edge_subtype, target_type, target_id FROM edge WHERE source_type = 'doc'")
def get_doc_outbound(g):
    return g.edge.filter("source_type = 'doc'").select(F.col("source_id").alias("path"), "edge_type", "edge_subtype", "target_type", "target_id")


@query("SELECT target_id AS path, edge_type, edge_subtype, source_type, source_id FROM edge WHERE target_type = 'doc' AND target_id IN (SELECT path FROM doc)")
def get_doc_inbound(g):
    return g.edge.filter("target_type = 'doc'").join(g.doc.select("path"), F.col("target_id") == F.col("path"), "left_semi").select(F.col("target_id").alias("path"), "edge_type", "edge_subtype", "source_type", "source_id")


# Projects, people, decisions


@query(f"WITH {EFF} SELECT e.target_id AS slug, x.path, x.status FROM edge e JOIN eff x ON x.path = e.source_id WHERE e.edge_type = 'MEMBER_OF_PROJECT' AND e.source_type = 'doc'")
def project_members(g):
    return G.members(g.docs, g.edges("MEMBER_OF_PROJECT")).select("slug", "path", "status")


@query(f"WITH {EFF} SELECT e.target_id AS slug, coalesce(x.status, 'unknown') AS status, count(*) AS n FROM edge e JOIN eff x ON x.path = e.source_id WHERE e.edge_type = 'MEMBER_OF_PROJECT' AND e.source_type = 'doc' GROUP BY ALL")
def project_status_mix(g):
    return G.status_mix(g.docs, g.edges("MEMBER_OF_PROJECT"))


@query(f"WITH {EFF}, {BLOCKERS} SELECT DISTINCT e.target_id AS slug, x.path, blocker FROM edge e JOIN eff x ON x.path = e.source_id JOIN blk ON blk.path = x.path WHERE e.edge_type = 'MEMBER_OF_PROJECT' AND e.source_type = 'doc' AND x.status = 'blocked'")
def project_blockers(g):
    return G.members(g.docs.filter("status = 'blocked'"), g.edges("MEMBER_OF_PROJECT")).select("slug", "path").distinct().join(G.blockers(g.edges("BLOCKS")), "path").select("slug", "path", "blocker")


@query("SELECT DISTINCT m.target_id AS slug, d.id, d.date, d.title FROM decision d JOIN edge a ON a.edge_type = 'ABOUT_DECISION' AND a.source_id = d.id JOIN edge m ON m.edge_type = 'MEMBER_OF_PROJECT' AND m.source_type = 'doc' AND m.source_id = a.target_id")
def project_decisions(g):
    return G.project_decisions(g.edges("MEMBER_OF_PROJECT", "ABOUT_DECISION"), g.decision).select("slug", "id", "date", "title")


@query("""SELECT name, slug, matched_by FROM (SELECT name, slug, matched_by, row_number() OVER (PARTITION BY name ORDER BY matched_by, slug) AS r FROM
    (SELECT upper(alias) AS name FROM person_alias) n JOIN (SELECT lower(display_name) AS k, slug, 0 AS matched_by FROM person UNION ALL SELECT lower(slug), slug, 1 FROM person UNION ALL SELECT lower(alias), slug, 2 FROM person_alias) p ON lower(name) = k) WHERE r = 1""")
def who_lookup(g):
    return G.who(g.person, g.person_alias, g.person_alias.select(F.upper("alias").alias("name")))


@query(f"WITH {EFF} SELECT e.target_id AS slug, x.path, x.status, x.last_modified FROM edge e JOIN eff x ON x.path = e.source_id WHERE e.edge_type = 'MENTIONS' AND e.target_id = 's3' ORDER BY last_modified DESC, path LIMIT 50")
def who_mentions(g):
    return G.newest(G.mentions(g.docs, g.edges("MENTIONS")).filter("slug = 's3'"), 50).select("slug", "path", "status", "last_modified")


@query("SELECT target_id AS slug, count(*) AS n FROM edge WHERE edge_type = 'MENTIONS' GROUP BY 1")
def who_mentions_total(g):
    return G.mentions(g.doc.select("path"), g.edges("MENTIONS")).groupBy("slug").agg(F.count("*").alias("n"))


@query("SELECT id, date, title FROM decision WHERE date >= (SELECT substr(max(date), 1, 7) FROM decision) ORDER BY date DESC, id LIMIT 50")
def decisions_since(g):
    month = g.decision.agg(F.substring(F.max("date"), 1, 7).alias("m")).first()["m"] or ""
    return G.decisions(g.decision, since=month).orderBy(F.col("date").desc(), "id").limit(50).select("id", "date", "title")


@query("SELECT id, date, title FROM decision WHERE title ILIKE '%BY 1_%' OR decision_text ILIKE '%BY 1_%'")
def decisions_topic(g):
    return G.decisions(g.decision, topic="BY 1_").select("id", "date", "title")


@query("SELECT status, count(*) AS n FROM decision GROUP BY 1")
def count_decisions(g):
    return g.decision.groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT source_id AS id, string_agg(target_id, ',' ORDER BY target_id) AS v FROM edge WHERE edge_type = 'ABOUT_DECISION' GROUP BY 1),
    s AS (SELECT source_id AS id, string_agg(target_id, ',' ORDER BY target_id) AS v FROM edge WHERE edge_type = 'SUPERSEDES' GROUP BY 1),
    b AS (SELECT target_id AS id, string_agg(source_id, ',' ORDER BY source_id) AS v FROM edge WHERE edge_type = 'SUPERSEDES' GROUP BY 1)
    SELECT d.id, date, title, status, coalesce(a.v, '') AS about_docs, coalesce(s.v, '') AS supersedes, coalesce(b.v, '') AS superseded_by FROM decision d LEFT JOIN a USING (id) LEFT JOIN s USING (id) LEFT JOIN b USING (id)""")
def decision_links(g):
    return G.decision_links(g.decision, g.edges("ABOUT_DECISION", "SUPERSEDES"))


# Audit

STALE = f"""last AS (SELECT p.hub_doc AS path, max(m.last_modified) AS t FROM project p JOIN edge e ON e.edge_type = 'MEMBER_OF_PROJECT' AND e.target_id = p.slug AND e.source_type = 'doc' JOIN doc m ON m.path = e.source_id WHERE p.hub_doc IS NOT NULL GROUP BY 1),
    stale AS (SELECT x.path, CASE WHEN x.doc_type = 'hub' THEN greatest(x.last_modified, l.t) ELSE x.last_modified END AS last_activity FROM eff x LEFT JOIN last l USING (path)
    WHERE x.status = 'active' AND NOT governed AND NOT (x.path NOT IN (SELECT hub_doc FROM project WHERE hub_doc IS NOT NULL) AND coalesce(x.doc_type, '') IN ('hub', 'journal'))
    AND substr(CASE WHEN x.doc_type = 'hub' THEN greatest(x.last_modified, l.t) ELSE x.last_modified END, 1, 10) < CAST(DATE '{AS_OF}' - 90 AS VARCHAR))"""
CHECKS = {
    "ghost_projects": "SELECT slug FROM project WHERE is_ghost",
    "ghost_people": "SELECT slug, display_name, count(DISTINCT source_id) AS mentions FROM person JOIN edge ON edge_type = 'MENTIONS' AND target_id = slug WHERE is_ghost GROUP BY ALL HAVING count(DISTINCT source_id) >= 2",
    "broken_links": "SELECT source_doc, link_text, link_target FROM broken_link",
    "one_way_edges": "SELECT source_id, target_id FROM edge e WHERE edge_type = 'RELATED_TO' AND edge_subtype = 'sibling' AND NOT EXISTS (SELECT 1 FROM edge r WHERE r.edge_type = 'RELATED_TO' AND r.source_id = e.target_id AND r.target_id = e.source_id)",
    "stale_active_docs": "SELECT path, last_activity FROM stale",
    "inconsistent_hub_state": "SELECT e.source_id, e.target_id, t.status AS target_status FROM edge e JOIN doc h ON h.path = e.source_id AND h.doc_type = 'hub' AND h.status = 'active' JOIN doc t ON t.path = e.target_id AND t.status IN ('done', 'blocked') WHERE edge_type = 'BLOCKS' AND edge_subtype = 'downstream'",
    "orphan_docs": "SELECT path FROM eff WHERE status = 'active' AND doc_type IS DISTINCT FROM 'hub' AND path NOT IN (SELECT target_id FROM edge WHERE target_type = 'doc' AND edge_type IN ('LINKS_TO', 'RELATED_TO', 'BLOCKS'))",
    "decision_drift": "SELECT id, date FROM decision WHERE status = 'active' AND id NOT IN (SELECT source_id FROM edge WHERE edge_type = 'ABOUT_DECISION')",
    "tag_drift": "SELECT target_id AS tag, count(*) AS uses FROM edge WHERE edge_type = 'TAGGED' GROUP BY 1 HAVING count(*) <= 2",
    "decisions_format_drift": "SELECT artifact_id AS id, notes FROM format_drift WHERE artifact_kind = 'decision'",
}
KEYS = {"ghost_projects": "slug", "ghost_people": "slug", "broken_links": "concat(source_doc, '::', link_target)", "one_way_edges": "concat(source_id, '::', target_id)", "stale_active_docs": "path", "inconsistent_hub_state": "concat(source_id, '::', target_id)", "orphan_docs": "path", "decision_drift": "id", "tag_drift": "tag", "decisions_format_drift": "id"}
RUN_CHECK = {
    "ghost_projects": lambda g: A.ghost_projects(g.project),
    "ghost_people": lambda g: A.ghost_people(g.person, g.edges("MENTIONS")),
    "broken_links": lambda g: g.broken_link,
    "one_way_edges": lambda g: A.one_way_edges(g.edges("RELATED_TO")),
    "stale_active_docs": lambda g: A.stale_active_docs(g.docs, g.project, g.edges("MEMBER_OF_PROJECT"), AS_OF),
    "inconsistent_hub_state": lambda g: A.inconsistent_hub_state(g.doc, g.edges("BLOCKS")),
    "orphan_docs": lambda g: A.orphan_docs(g.docs, g.edges("LINKS_TO", "RELATED_TO", "BLOCKS")),
    "decision_drift": lambda g: A.decision_drift(g.decision, g.edges("ABOUT_DECISION")),
    "tag_drift": lambda g: A.tag_drift(g.edges("TAGGED")),
    "decisions_format_drift": lambda g: A.format_drift(g.format_drift),
}
for _name, _sql in CHECKS.items():

    def _check(g, name=_name):
        return RUN_CHECK[name](g)

    _check.__name__ = f"audit_{_name}"
    query(f"WITH {EFF}, {STALE} {_sql}")(_check)

FOUND = "found AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, {KEYS[n]} AS key FROM ({s})" for n, s in CHECKS.items()) + ")"


def _findings(g) -> DataFrame:
    return A.findings(g.doc, g.docs, g.project, g.person, g.edge, g.broken_link, g.decision, g.format_drift, AS_OF)


@query(f"WITH {EFF}, {STALE}, {FOUND} SELECT rule, count(*) AS n FROM found GROUP BY 1")
def audit_summary(g):
    return _findings(g).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH {EFF}, {STALE}, {FOUND} SELECT rule, count(*) AS n FROM found WHERE key LIKE 'c%' AND rule = 'ghost_projects' OR rule = 'tag_drift' GROUP BY 1")
def audit_suppressed(g):
    found = _findings(g)
    named = found.filter("(rule = 'ghost_projects' and key like 'c%') or rule = 'tag_drift'")
    return A.suppress(found, named)[1]


@query("""SELECT slug, entity, votes FROM (SELECT p.target_id AS slug, e.target_id AS entity, count(*) AS votes, row_number() OVER (PARTITION BY p.target_id ORDER BY count(*) DESC, e.target_id) AS r FROM edge p JOIN edge e ON e.edge_type = 'MEMBER_OF_ENTITY' AND e.source_id = p.source_id AND e.source_type = 'doc'
    WHERE p.edge_type = 'MEMBER_OF_PROJECT' AND p.source_type = 'doc' GROUP BY 1, 2) WHERE r = 1""")
def project_entity_majority(g):
    return G.entity_majority(g.edges("MEMBER_OF_PROJECT", "MEMBER_OF_ENTITY"))


@query("SELECT e.target_id AS slug, min(d.path) AS hub_doc FROM edge e JOIN doc d ON d.path = e.source_id AND d.doc_type = 'hub' WHERE e.edge_type = 'MEMBER_OF_PROJECT' AND e.source_type = 'doc' GROUP BY 1")
def hub_resolution(g):
    return G.resolve_hubs(g.doc, g.edges("MEMBER_OF_PROJECT"))


@query("SELECT target_id AS tag, count(*) AS uses FROM edge WHERE edge_type = 'TAGGED' GROUP BY 1")
def tag_usage(g):
    return G.edges_of(g.edges("TAGGED"), "TAGGED", None).groupBy(F.col("target_id").alias("tag")).agg(F.count("*").alias("uses"))


@query("SELECT edge_type, edge_subtype, count(*) AS n FROM edge GROUP BY ALL")
def edge_type_counts(g):
    return g.edge.groupBy("edge_type", "edge_subtype").agg(F.count("*").alias("n"))


# Upserts and change feeds


@query("SELECT path, n, op FROM (SELECT path, n, op, row_number() OVER (PARTITION BY path ORDER BY n DESC) AS r FROM change_log) WHERE r = 1")
def upsert_keep_last(g):
    return C.keep_last(g.change_log.select("path", "n", "op"), ["path"], ["n"])


@query("SELECT path, n, op FROM (SELECT path, n, op, row_number() OVER (PARTITION BY path ORDER BY n) AS r FROM change_log) WHERE r = 1")
def upsert_keep_first(g):
    return C.keep_first(g.change_log.select("path", "n", "op"), ["path"], ["n"])


RENAMED = "ren AS (SELECT path, concat('archive/', path) AS new_path FROM doc WHERE k % 4 = 1)"


def _renames(g) -> DataFrame:
    return g.doc.filter("k % 4 = 1").select("path", F.concat(F.lit("archive/"), "path").alias("new_path"))


@query(f"WITH {RENAMED} SELECT coalesce(a.new_path, e.source_id) AS source_id, edge_type, coalesce(b.new_path, e.target_id) AS target_id FROM edge e LEFT JOIN ren a ON a.path = e.source_id AND e.source_type = 'doc' LEFT JOIN ren b ON b.path = e.target_id AND e.target_type = 'doc'")
def rename_apply(g):
    return C.rename_docs(g.doc, g.edge, g.broken_link, _renames(g))[1].select("source_id", "edge_type", "target_id")


@query("SELECT source_id, edge_type, target_id FROM edge WHERE NOT (source_type = 'doc' AND source_id IN (SELECT path FROM doc WHERE k % 4 = 1))")
def delete_apply(g):
    return C.delete_docs(g.doc, g.edge, g.broken_link, _renames(g))[1].select("source_id", "edge_type", "target_id")


@query("SELECT source_doc, link_target FROM broken_link WHERE source_doc NOT IN (SELECT path FROM doc WHERE k % 4 = 1)")
def delete_apply_broken(g):
    return C.delete_docs(g.doc, g.edge, g.broken_link, _renames(g))[2].select("source_doc", "link_target")


@query("SELECT path, op, n FROM (SELECT path, op, n, row_number() OVER (PARTITION BY path ORDER BY ts DESC, n DESC) AS r FROM change_log WHERE op <> 'T') WHERE r = 1")
def changelog_fold(g):
    return C.fold_log(g.change_log)


@query("SELECT substr(op, 1, 1) AS op, CASE WHEN op = 'R' THEN concat('new/', path) ELSE path END AS path, CASE WHEN op = 'R' THEN path END AS old_path FROM change_log WHERE op <> 'T'")
def name_status_lines(g):
    line = F.when(F.col("op") == "R", F.concat(F.lit("R086\t"), "path", F.lit("\tnew/"), "path")).otherwise(F.concat("op", F.lit("\t"), "path"))
    return C.parse_name_status(g.change_log.select(line.alias("line")))


@query("SELECT path, max(ts) AS latest FROM change_log GROUP BY 1")
def git_dates_latest(g):
    return C.latest_dates(g.change_log)


SYNC = """f AS (SELECT path, size, doc_id * 1000 AS mtime, md5(text) AS md5 FROM file WHERE doc_id % 10 <> 0), i AS (SELECT path, CASE WHEN age = 0 THEN size + 1 ELSE size END AS size, CASE WHEN age IN (1, 2) THEN doc_id * 1000 - 5 ELSE doc_id * 1000 END AS mtime, CASE WHEN age < 2 AND doc_id % 2 = 0 THEN '' ELSE md5(text) END AS md5, status, doc_id % 4 <> 0 AS scanned FROM file WHERE doc_id % 9 <> 0)
    SELECT coalesce(f.path, i.path) AS path, CASE WHEN f.path IS NULL THEN 'delete' WHEN i.path IS NULL THEN 'add' WHEN f.size <> i.size OR f.mtime <> i.mtime THEN CASE WHEN f.md5 = i.md5 AND i.status = 'ok' AND {scanned} THEN 'touch' ELSE 'update' END WHEN i.status IN ('error', 'skipped') THEN {failed} WHEN {scanned} THEN 'skip' ELSE 'update' END AS action FROM f FULL JOIN i ON f.path = i.path"""


def _synced(g, **options) -> DataFrame:
    """Files with a new size (age 0), with a new time only (1 and 2), of which those with an even id and an age below 2 have other contents."""
    found = g.file.filter("doc_id % 10 <> 0").select("path", "size", (F.col("doc_id") * 1000).alias("mtime"))
    size = F.when(F.col("age") == 0, F.col("size") + 1).otherwise(F.col("size"))
    mtime = F.when(F.col("age").isin(1, 2), F.col("doc_id") * 1000 - 5).otherwise(F.col("doc_id") * 1000)
    md5 = F.when((F.col("age") < 2) & (F.col("doc_id") % 2 == 0), "").otherwise(F.md5(F.col("text").cast("binary")))
    index = g.file.filter("doc_id % 9 <> 0").select("path", size.alias("size"), mtime.alias("mtime"), md5.alias("md5"), "status", (F.col("doc_id") % 4 != 0).alias("scanned"))
    return C.plan_sync(found, index, g.file.select("path", "text"), **options)


@query("WITH " + SYNC.format(scanned="true", failed="'retry'"))
def sync_plan(g):
    return _synced(g, retry_errors=True)


@query("WITH " + SYNC.format(scanned="(i.scanned OR i.status <> 'ok')", failed="'skip'"))
def sync_plan_pii(g):
    """The same with personal data to scan for, and without a second try of failed files."""
    return _synced(g, pii=True)


@query("SELECT path FROM file WHERE doc_id % 9 = 0 AND doc_id % 10 <> 0")
def index_set_diff(g):
    return g.file.filter("doc_id % 10 <> 0").select("path").join(g.file.filter("doc_id % 9 <> 0").select("path"), "path", "left_anti")


@query("SELECT status, count(*) AS files, sum(size) AS chars, count(*) FILTER (WHERE age = 0) AS fresh FROM file GROUP BY 1")
def semantic_status(g):
    return g.file.groupBy("status").agg(F.count("*").alias("files"), F.sum("size").alias("chars"), F.count_if(F.col("age") == 0).alias("fresh"))


# Text

TOK = "tok AS (SELECT path, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM file)"
POST = TOK + ", post AS (SELECT path, len, term, count(*) AS tf FROM (SELECT path, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL)"


@query(f"WITH {TOK} SELECT path, len(t) AS n FROM tok")
def doc_lengths(g):
    return g.file.select("path", F.size(T.tokens(F.col("text"))).alias("n"))


@query(f"WITH {POST} SELECT path, term, tf, len FROM post")
def postings(g):
    return T.postings(g.file).select("path", "term", "tf", "len")


@query(f"WITH {POST}, n AS (SELECT count(*) AS n FROM file) SELECT term, count(*) AS df, round(greatest(ln((max(n.n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6), 6) AS idf FROM post, n GROUP BY 1")
def idf(g):
    n = g.file.agg(F.count("*").alias("n"))
    df = T.postings(g.file).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)), 6).alias("idf"))  # n is one row


def _bm25_sql(terms: list[str], every: bool) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms)))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    return f"{TOK}, tf AS (SELECT path, len(t) AS len, {tf} FROM tok), fig AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM tf), hit AS (SELECT path, round(-({score}), 6) AS score FROM tf, fig WHERE " + (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(terms))) + ")"


@query(f"WITH {_bm25_sql(['license', 'reserved', 'under'], False)} SELECT path, score FROM hit ORDER BY score, path LIMIT 50")
def bm25_or(g):
    return g.hits("license", "reserved", "under").orderBy("score", "path").limit(50)


@query(f"WITH {_bm25_sql(['the', 'of', 'and'], True)} SELECT path, score FROM hit ORDER BY score, path LIMIT 50")
def bm25_and(g):
    return g.hits("the", "of", "and", every=True).orderBy("score", "path").limit(50)


@query(f"WITH {_bm25_sql(['license', 'the'], False)} SELECT h.path, h.score FROM hit h JOIN file f USING (path) WHERE h.path ILIKE 'EN/%' AND f.status = 'ok' ORDER BY score, path LIMIT 20")
def search_docs_filtered(g):
    hits = g.hits(*T.query_terms("the license a")[::-1])
    ok = g.file.filter("status = 'ok'").select("path")
    return hits.filter(G.like_prefix(F.col("path"), "EN/")).join(ok, "path", "left_semi").orderBy("score", "path").limit(20)


@query(f"WITH {TOK} SELECT path FROM tok WHERE contains(concat(' ', array_to_string(t, ' '), ' '), ' all rights reserved ')")
def search_docs_phrase(g):
    return g.index.search(every=[I.phrase("all", "rights", "reserved")], fields=["text"]).select("path")


# Vectors and fusion

DIST = "SELECT {q} AS query_id, v.vec_id, round(1 - list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS distance FROM embeddings v, embeddings q WHERE {w}"


@query("SELECT query_id, vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM (" + DIST.format(q="q.vec_id", w="q.vec_id = 0") + ") ORDER BY distance, vec_id LIMIT 200")
def knn_cosine(g):
    v = g.table("embeddings")
    return T.knn(v.select("vec_id", "embedding"), v.filter("vec_id = 0"), 200)


@query("SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (" + DIST.format(q="q.vec_id", w="q.vec_id % 100 = 0") + ")) WHERE rank <= 5")
def knn_batch(g):
    v = g.table("embeddings")
    return T.knn(v.select("vec_id", "embedding"), v.filter("vec_id % 100 = 0"), 5)


@query("SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (" + DIST.format(q="q.vec_id", w="q.vec_id % 100 = 0") + ")) WHERE rank <= 20")
def knn_hundredth(g):
    v = g.table("embeddings")
    return T.knn(v, v.filter("vec_id % 100 = 0"), 20)


TERMS = ["license", "under", "the"]
NEAR = "SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (" + DIST.format(q="q.vec_id", w="{w}") + ")"
RRF = f"""{_bm25_sql(TERMS, False)}, k1 AS (SELECT path, row_number() OVER (ORDER BY score, path) AS rank FROM (SELECT * FROM hit ORDER BY score, path LIMIT 200)),
  k2 AS (SELECT path, rank FROM ({NEAR.format(w="q.vec_id = 0")}) JOIN file ON doc_id = vec_id WHERE rank <= 200),
  l1 AS (SELECT path, row_number() OVER (ORDER BY rank) AS rank FROM k1 JOIN file USING (path) WHERE {{allowed}}), l2 AS (SELECT path, row_number() OVER (ORDER BY rank) AS rank FROM k2 JOIN file USING (path) WHERE {{allowed}}),
  fused AS (SELECT path, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1)"""


def _fused(g, allowed=None) -> DataFrame:
    v = g.table("embeddings")
    return R.fused(g.file, v, v.filter("vec_id = 0"), g.hits(*TERMS), allowed=allowed)


@query("WITH " + RRF.format(allowed="true") + " SELECT path, score FROM fused")
def rrf_fuse(g):
    return _fused(g)


def _hybrid_sql(allowed: str, cap_by: str) -> str:
    return f"""WITH {RRF.format(allowed=allowed)}, pool AS (SELECT path, source, least(1, len(list_intersect(list_distinct(t), ['license', 'under', 'the'])) / 3.0::DOUBLE + least(0.05, 0.1 * pow(0.5, age / 60.0))) AS s FROM (SELECT * FROM fused ORDER BY score DESC, path LIMIT 24) JOIN file USING (path) JOIN tok USING (path)),
      top AS (SELECT *, row_number() OVER (PARTITION BY {cap_by} ORDER BY s DESC, path) AS r FROM pool) SELECT path, source, round(s, 6) AS score, (SELECT count(*) FROM fused) AS candidates FROM top WHERE r <= 3 ORDER BY s DESC, path LIMIT 8"""


@query(_hybrid_sql("true", "path"))
def hybrid_search(g):
    return R.search(_fused(g), g.file, TERMS)


@query(_hybrid_sql("status = 'ok' AND lang <> 'de'", "source"))
def hybrid_search_filtered(g):
    """Ranks count allowed files only."""
    return R.search(_fused(g, (F.col("status") == "ok") & (F.col("lang") != "de")), g.file, TERMS, cap_by="source")


@query(f"""WITH near AS (SELECT * FROM ({NEAR.format(w="q.vec_id % 100 = 0")}) WHERE rank <= 6 AND vec_id <> query_id), r AS (SELECT n.query_id, row_number() OVER (PARTITION BY n.query_id ORDER BY n.rank) AS rank, n.distance, a.label = b.label AS ok FROM near n JOIN embeddings a ON a.vec_id = n.query_id JOIN embeddings b ON b.vec_id = n.vec_id),
  e AS (SELECT query_id, min(rank) FILTER (WHERE ok) AS first, min(distance) AS d FROM r WHERE rank <= 5 GROUP BY 1)
  SELECT count(*) AS queries, round(avg(CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN first IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr,
  round(avg(CASE WHEN d <= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accepted, round(median(d), 6) AS median, list_sort(list(d))[95 * (count(*) - 1) // 100 + 1] AS p95 FROM e""")
def eval_retrieval(g):
    from pyspark.sql import Window

    v = g.table("embeddings")
    near = T.knn(v, v.filter("vec_id % 100 = 0"), 6).filter("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    label = lambda c: v.select(F.col("vec_id").alias(c), F.col("label").alias(f"label_{c}"))
    # Right answers among the few that were found: a join of all equal labels would be one of all pairs.
    right = near.select("query_id", "vec_id").join(label("query_id"), "query_id").join(label("vec_id"), "vec_id").filter("label_query_id = label_vec_id").select("query_id", "vec_id")
    return R.evaluate(near, right, 0.5)


@query("SELECT path, source, size FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, path) AS r FROM file) WHERE r <= 3")
def per_source_cap(g):
    from pyspark.sql import Window

    return g.file.select("path", "source", "size").withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.col("size").desc(), "path"))).filter("r <= 3").drop("r")


@query("SELECT path, round(least(0.05, 0.1 * pow(0.5, age / 60.0)), 9) AS bonus FROM file")
def recency_bonus(g):
    return g.file.select("path", F.round(S.recency(F.col("age")), 9).alias("bonus"))


@query(f"WITH {TOK} SELECT path, round(len(list_intersect(list_distinct(t), ['license', 'under', 'the', 'version'])) / 4.0, 6) AS score FROM tok")
def overlap_rerank(g):
    q = F.array(*(F.lit(w) for w in ("license", "under", "the", "version")))
    return g.file.select("path", F.round(F.size(F.array_intersect(T.tokens(F.col("text")), q)) / 4.0, 6).alias("score"))


@query("SELECT path, greatest(1, CAST(ceil(length(text) / 2000.0) AS BIGINT)) AS pages, substr(text, 2001, 2000) AS page2 FROM file")
def read_document_page(g):
    return g.file.select("path", S.page_count(F.col("text"), 2000).alias("pages"), S.page_of(F.col("text"), 2, 2000).alias("page2"))


@query("SELECT role, count(*) AS n, quantile_cont(length(text), 0.5) AS median, list_sort(list(length(text)))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95 FROM conversations GROUP BY 1")
def eval_metrics(g):
    return T.length_metrics(g.table("conversations"))


# Identifiers and scalars


@query(r"SELECT path, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS email FROM file")
def pii_emails(g):
    return g.file.select("path", F.explode(S.emails(F.col("text"))).alias("email"))


@query("""WITH r AS (SELECT path, unnest(regexp_extract_all(text, '[0-9]+')) AS digits FROM file)
    SELECT path, digits, list_sum([CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INT) ELSE CASE WHEN 2 * CAST(reverse(digits)[i] AS INT) > 9 THEN 2 * CAST(reverse(digits)[i] AS INT) - 9 ELSE 2 * CAST(reverse(digits)[i] AS INT) END END FOR i IN range(1, length(digits) + 1)]) % 10 = 0 AS valid FROM r WHERE length(digits) BETWEEN 13 AND 19""")
def pii_luhn(g):
    return g.file.select("path", F.explode(S.digit_runs(F.col("text"))).alias("digits")).select("path", "digits", S.luhn_valid(F.col("digits")).alias("valid"))


@query("SELECT s_name AS value, length(regexp_replace(s_name, '[^0-9A-Za-z]', '', 'g')) >= 6 AS good FROM supplier")
def pii_substance_gate(g):
    return g.table("supplier").select(F.col("s_name").alias("value"), S.substantial(F.col("s_name")).alias("good"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(g):
    return g.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages")
def page_headings(g):
    return g.table("pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"))


@query(r"SELECT path, len(regexp_extract_all(text, '[A-Za-z]{3,}')) >= 5 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 0.6 * length(regexp_replace(text, '\s', '', 'g')) AS good FROM file")
def looks_like_text(g):
    return g.file.select("path", S.looks_like_text(F.col("text")).alias("good"))


@query(r"SELECT path, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM file")
def word_count(g):
    return g.file.select("path", S.word_count(F.col("text")).alias("n"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(concat(p_name, ' _ ', p_type)), '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify(g):
    return g.table("part").select("p_partkey", S.slugify(F.concat("p_name", F.lit(" _ "), "p_type")).alias("slug"))


@query("SELECT path, CASE WHEN x = '' THEN 'memory' ELSE x END AS slug FROM (SELECT path, regexp_replace(substr(array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 8), '-'), 1, 60), '^-+|-+$', '', 'g') AS x FROM file)")
def memory_slug(g):
    return g.file.select("path", S.memory_slug(F.col("text")).alias("slug"))


@query("""SELECT path, CASE ext WHEN 'md' THEN 'md' WHEN 'txt' THEN 'text' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'office' WHEN 'png' THEN 'image' END AS kind FROM (SELECT concat('a/', doc_id, '.', e) AS path, lower(e) AS ext FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'MD' WHEN 1 THEN 'txt' WHEN 2 THEN 'Pdf' WHEN 3 THEN 'docx' WHEN 4 THEN 'png' ELSE 'exe' END AS e FROM file))""")
def file_kind(g):
    e = F.get(F.array(*(F.lit(x) for x in ("MD", "txt", "Pdf", "docx", "png", "exe"))), (F.col("doc_id") % 6).cast("int"))
    d = g.file.select(F.concat(F.lit("a/"), "doc_id", F.lit("."), e).alias("path"))
    return d.select("path", S.file_kind(F.col("path")).alias("kind"))


@query("SELECT path, concat(nat, '/', k, '.md') AS target FROM doc")
def link_normalise(g):
    return g.doc.select("path", S.normal_path(F.concat("nat", F.lit("/./"), "c", F.lit("/../"), "k", F.lit(".md"))).alias("target"))


@query("SELECT path, i AS ordinal, substr(text, i * 600 + 1, 680) AS chunk FROM (SELECT path, text, unnest(range(0, CAST(ceil(length(text) / 600.0) AS BIGINT))) AS i FROM file)")
def chunk_fixed(g):
    from inkweave.functions.chunks import fixed_chunks

    return fixed_chunks(g.file)


@query()
def chunk_greedy(g):
    from inkweave.functions.chunks import greedy_chunks

    return g.file.select("path", F.posexplode(greedy_chunks(F.col("text"))).alias("ordinal", "chunk"))


@query(f"WITH {TOK} SELECT path, i - 1 AS pos, t[i] AS term FROM (SELECT path, t, unnest(range(1, len(t) + 1)) AS i FROM tok)")
def doc_tokens(g):
    return g.file.select("path", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term"))


@query(f"WITH {_bm25_sql(['the', 'of'], False)} SELECT path, source, score FROM (SELECT h.path, f.source, h.score, row_number() OVER (PARTITION BY f.source ORDER BY h.score, h.path) AS r FROM hit h JOIN file f USING (path) WHERE starts_with(h.path, 'en/')) WHERE r = 1 ORDER BY score, path LIMIT 3")
def recall(g):
    from pyspark.sql import Window

    hits = g.hits("the", "of").filter(F.col("path").startswith("en/")).join(g.file.select("path", "source"), "path")
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("score", "path"))).filter("r = 1").select("path", "source", "score").orderBy("score", "path").limit(3)


# Event windows: an extension, the batch form of streaming/feed.py


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(g):
    return g.table("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def events_session(g):
    return g.table("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1")
def events_sliding(g):
    return g.table("events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


from inkweave.plans import maintained, more, pii, search  # noqa: E402, F401  register further queries
