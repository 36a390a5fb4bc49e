"""Further registered queries: whole-result functions, sections, memory notes, stubs, personal data by label, counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkweave.functions import scalars as S
from inkweave.operators import graph as G
from inkweave.operators import retrieval as R
from inkweave.operators.sections import lines_of, sections
from inkweave.plans.catalogue import BLOCKERS, EFF, query
from inkweave.sources.store import written

# Whole results


@query(f"""WITH {EFF}, ob AS (SELECT source_id AS path, string_agg(concat(edge_type, ':', target_id), ',' ORDER BY edge_type, target_id) AS outbound FROM edge WHERE source_type = 'doc' GROUP BY 1),
    ib AS (SELECT target_id AS path, string_agg(concat(edge_type, ':', source_id), ',' ORDER BY edge_type, source_id) AS inbound FROM edge WHERE target_type = 'doc' GROUP BY 1)
    SELECT path, title, status, doc_type, coalesce(outbound, '') AS outbound, coalesce(inbound, '') AS inbound FROM eff LEFT JOIN ob USING (path) LEFT JOIN ib USING (path)""")
def get_doc(g):
    """Each document with effective status and both lists of edges."""
    side = lambda own, other, name: g.edge.filter(f"{own}_type = 'doc'").groupBy(F.col(f"{own}_id").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("edge_type", F.col(f"{other}_id").alias("id")))), lambda e: F.concat(e["edge_type"], F.lit(":"), e["id"])), ",").alias(name))
    d = g.docs.select("path", "title", "status", "doc_type")
    return d.join(side("source", "target", "outbound"), "path", "left").join(side("target", "source", "inbound"), "path", "left").fillna("", ["outbound", "inbound"])


@query(f"""WITH {EFF}, {BLOCKERS}, m AS (SELECT e.target_id AS slug, d.path, d.status FROM edge e JOIN eff d ON d.path = e.source_id WHERE e.edge_type = 'MEMBER_OF_PROJECT' AND e.source_type = 'doc'),
    s AS (SELECT slug, count(*) AS members, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'blocked') AS blocked FROM m GROUP BY 1),
    b AS (SELECT slug, count(DISTINCT blocker) AS blockers FROM m JOIN blk USING (path) WHERE status = 'blocked' GROUP BY 1),
    c AS (SELECT slug, count(DISTINCT e.source_id) AS decisions FROM edge e JOIN m ON m.path = e.target_id WHERE e.edge_type = 'ABOUT_DECISION' AND e.source_type = 'decision' GROUP BY 1)
    SELECT p.slug, hub_doc, coalesce(members, 0) AS members, coalesce(active, 0) AS active, coalesce(blocked, 0) AS blocked, coalesce(blockers, 0) AS blockers, coalesce(decisions, 0) AS decisions FROM project p LEFT JOIN s USING (slug) LEFT JOIN b USING (slug) LEFT JOIN c USING (slug)""")
def project_state(g):
    """Each project's hub and the numbers of its members, of their states, of what blocks them and of decisions about them."""
    m = written(g.spark, G.members(g.docs, g.edges("MEMBER_OF_PROJECT")).select("slug", "path", "status"))  # made once, read three times
    counts = m.groupBy("slug").agg(F.count("*").alias("members"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    blocked = m.filter("status = 'blocked'").join(G.blockers(g.edges("BLOCKS")), "path").groupBy("slug").agg(F.count_distinct("blocker").alias("blockers"))
    about = G.edges_of(g.edges("ABOUT_DECISION"), "ABOUT_DECISION", "decision").select(F.col("source_id").alias("id"), F.col("target_id").alias("path"))
    decided = about.join(m, "path").groupBy("slug").agg(F.count_distinct("id").alias("decisions"))
    out = g.project.select("slug", "hub_doc")
    for part in (counts, blocked, decided):
        out = out.join(part, "slug", "left")
    return out.fillna(0, ["members", "active", "blocked", "blockers", "decisions"])


@query(f"""WITH {EFF}, a AS (SELECT path, last_modified FROM eff WHERE status = 'active'), t AS (SELECT count(*) AS total FROM a), i AS (SELECT path FROM a ORDER BY last_modified DESC, path LIMIT 20)
    SELECT string_agg(path, ',' ORDER BY path) AS items, any_value(total) AS total, CASE WHEN any_value(total) > count(*) THEN concat('showing ', count(*), ' of ', any_value(total)) END AS note FROM i, t""")
def list_envelope(g):
    """One row: the newest items, how many there are, and a note if not all are shown."""
    active = G.list_active(g.docs, g.edges("MEMBER_OF_PROJECT"))
    items = G.newest(active, 20).agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("items"), F.count("*").alias("n"))
    total = active.agg(F.count("*").alias("total"))
    note = F.when(F.col("total") > F.col("n"), F.concat(F.lit("showing "), "n", F.lit(" of "), "total"))
    return items.crossJoin(F.broadcast(total)).select("items", "total", note.alias("note"))  # both have one row


@query(f"""WITH {EFF}, p AS (SELECT source_id AS path, string_agg(target_id, ',' ORDER BY target_id) AS projects FROM edge WHERE edge_type = 'MEMBER_OF_PROJECT' AND source_type = 'doc' GROUP BY 1)
    SELECT path, status, coalesce(projects, '') AS projects FROM eff LEFT JOIN p USING (path)""")
def graph_enrichment(g):
    """What the graph knows of each path: effective status and projects."""
    p = G.edges_of(g.edges("MEMBER_OF_PROJECT"), "MEMBER_OF_PROJECT").groupBy(F.col("source_id").alias("path")).agg(F.array_join(F.sort_array(F.collect_list("target_id")), ",").alias("projects"))
    return g.docs.select("path", "status").join(p, "path", "left").fillna("", ["projects"])


@query("SELECT DISTINCT e.target_id AS slug FROM edge e LEFT JOIN project p ON p.slug = e.target_id WHERE e.edge_type = 'MEMBER_OF_PROJECT' AND p.slug IS NULL")
def project_stubs(g):
    """Projects that documents name and that have no row of their own."""
    named = G.edges_of(g.edges("MEMBER_OF_PROJECT"), "MEMBER_OF_PROJECT", None).select(F.col("target_id").alias("slug")).distinct()
    return named.join(g.project, "slug", "left_anti")


@query("""SELECT slug, entity FROM (SELECT slug, entity, row_number() OVER (PARTITION BY slug ORDER BY count(*) DESC, min(k), entity) AS r FROM
    (SELECT p.target_id AS slug, e.target_id AS entity, d.k FROM edge p JOIN edge e ON e.edge_type = 'MEMBER_OF_ENTITY' AND e.source_id = p.source_id AND e.source_type = 'doc' JOIN doc d ON d.path = p.source_id WHERE p.edge_type = 'MEMBER_OF_PROJECT' AND p.source_type = 'doc') GROUP BY slug, entity) WHERE r = 1""")
def entity_majority_first_seen(g):
    """The entity of most votes; of ties the one that was seen first."""
    p = G.edges_of(g.edges("MEMBER_OF_PROJECT"), "MEMBER_OF_PROJECT").select(F.col("source_id").alias("path"), F.col("target_id").alias("slug"))
    e = G.edges_of(g.edges("MEMBER_OF_ENTITY"), "MEMBER_OF_ENTITY").select(F.col("source_id").alias("path"), F.col("target_id").alias("entity"))
    votes = p.join(e, "path").join(g.doc.select("path", "k"), "path").groupBy("slug", "entity").agg(F.count("*").alias("n"), F.min("k").alias("seen"))
    return votes.groupBy("slug").agg(F.min(F.struct((-F.col("n")).alias("n"), "seen", "entity")).alias("m")).select("slug", F.col("m.entity").alias("entity"))


# Sections


MD = "md AS (SELECT path, concat('before', chr(10), '# ', lang, chr(10), 'intro', chr(10), '```', chr(10), '# no heading', chr(10), '```', chr(10), '## ', source, ' ##', chr(10), text, chr(10), '### deep', chr(10), 'x', chr(10), '# last') AS text FROM file)"
MD_LINES = MD + r""", l0 AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM md), l1 AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence FROM l0), l2 AS (SELECT *, sum(fence::INT) OVER (PARTITION BY path ORDER BY i) % 2 = 1 AS inside FROM l1),
    l3 AS (SELECT path, i, line, CASE WHEN NOT fence AND NOT inside AND regexp_matches(line, '^#{1,6}\s+(.+?)\s*#*\s*$') THEN length(regexp_extract(line, '^(#{1,6})\s+(.+?)\s*#*\s*$', 1)) END AS level, CASE WHEN NOT fence AND NOT inside AND regexp_matches(line, '^#{1,6}\s+(.+?)\s*#*\s*$') THEN regexp_extract(line, '^(#{1,6})\s+(.+?)\s*#*\s*$', 2) END AS title FROM l2)"""


def _markdown(g):
    # The front matter and the closing marks are not in the SQL: sections are without them.
    parts = (F.lit("---\ntags: [a/b]\n---\nbefore\n# "), "lang", F.lit("  #\nintro\n```\n# no heading\n```\n## "), "source", F.lit(" ##\n"), "text", F.lit("\n### deep\nx\n# last"))
    return g.file.select("path", F.concat(*parts).alias("text"))


@query(f"WITH {MD_LINES} SELECT path, i, level, title FROM l3 WHERE level IS NOT NULL")
def headings(g):
    return lines_of(_markdown(g)).filter("level is not null").select("path", "i", "level", "title")


@query(f"""WITH {MD_LINES}, w AS (SELECT *, count(level) OVER a AS section, max(CASE WHEN level = 1 THEN i END) OVER a AS p1, max(CASE WHEN level = 2 THEN i END) OVER a AS p2, max(CASE WHEN level = 3 THEN i END) OVER a AS p3,
    last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER a AS t1, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER a AS t2, last_value(CASE WHEN level = 3 THEN title END IGNORE NULLS) OVER a AS t3 FROM l3 WINDOW a AS (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT path, section, i, level, line, concat_ws(' > ', t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END) AS heading FROM w),
    s AS (SELECT path, section, max(heading) AS heading, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level IS NULL), ''), '^\\s+|\\s+$', '', 'g') AS text FROM c GROUP BY 1, 2)
    SELECT path, section, heading, sha256(text) AS text_sha256 FROM s WHERE text <> ''""")
def markdown_sections(g):
    return sections(_markdown(g)).select("path", "section", "heading", F.sha2("text", 256).alias("text_sha256"))


# Memory notes and names


@query("""WITH t AS (SELECT path, regexp_extract(regexp_replace(trim(text), '\\s+', ' ', 'g'), '^(.*?[.!?])( |$)', 1) AS s, regexp_replace(trim(text), '\\s+', ' ', 'g') AS a FROM file), f AS (SELECT path, CASE WHEN s = '' THEN a ELSE s END AS s FROM t)
    SELECT path, CASE WHEN length(s) <= 80 THEN s ELSE concat(regexp_replace(substr(s, 1, 80), ' [^ ]*$', ''), '…') END AS title FROM f""")
def memory_title(g):
    """The first sentence; longer than 80 characters, it is cut at a word."""
    return g.file.select("path", S.memory_title(F.col("text")).alias("title"))


@query("WITH s AS (SELECT doc_id, concat(lang, '-', source) AS slug FROM file) SELECT doc_id, CASE WHEN r = 1 THEN slug ELSE concat(slug, '-', r) END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS r FROM s)")
def slug_collisions(g):
    """Notes of one name get -2, -3 ... in the order of their ids."""
    r = F.row_number().over(Window.partitionBy("slug").orderBy("doc_id"))
    return g.file.select("doc_id", F.concat("lang", F.lit("-"), "source").alias("slug")).withColumn("r", r).select("doc_id", F.when(F.col("r") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), "r")).alias("slug"))


@query("SELECT slug, coalesce(nullif(CASE WHEN is_ghost THEN '' ELSE display_name END, ''), concat(upper(slug[1]), lower(slug[2:]))) AS name FROM person")
def display_name(g):
    return g.person.select("slug", S.display_name(F.when(~F.col("is_ghost"), F.col("display_name")), F.lit(None).cast("string"), F.col("slug")).alias("name"))


@query("SELECT tag, regexp_full_match(tag, '[a-z0-9-]+/[a-z0-9._-]+') AND NOT starts_with(tag, 'status/') AND NOT starts_with(tag, 'type/') AS good FROM (SELECT DISTINCT target_id AS tag FROM edge WHERE edge_type = 'TAGGED')")
def tag_validity(g):
    tags = G.edges_of(g.edges("TAGGED"), "TAGGED", None).select(F.col("target_id").alias("tag")).distinct()
    return tags.select("tag", S.good_tag(F.col("tag")).alias("good"))


@query("SELECT n, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%d') AS day FROM change_log")
def epoch_round_trip(g):
    """An ISO string as seconds, and seconds as an ISO day."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return g.change_log.select("n", S.epoch(text).alias("seconds")).select("n", "seconds", S.iso_day(F.col("seconds")).alias("day"))


@query("SELECT path, concat(lang, ' > ', source, chr(10), text) AS text FROM file")
def rerank_text(g):
    """What a reranker reads: title > heading, then the text."""
    return g.file.select("path", S.rerank_text(F.col("lang"), F.col("source"), F.col("text")).alias("text"))


@query("""WITH t AS (SELECT path, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM file), c AS (SELECT path, CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % 64 AS k, count(*) AS n FROM t GROUP BY 1, 2), z AS (SELECT path, sqrt(sum(n * n)) AS z FROM c GROUP BY 1)
    SELECT path, string_agg(concat(k, ':', CAST(round(n / z * 1000) AS BIGINT)), ' ' ORDER BY k) AS vector FROM c JOIN z USING (path) GROUP BY 1""")
def hashed_embedding(g):
    """The offline embedding, its places that are not zero in thousandths."""
    v = R.hashed_vectors(g.file)
    shown = F.filter(F.transform("vector", lambda x, k: F.when(x > 0, F.concat(k.cast("string"), F.lit(":"), F.round(x * 1000).cast("long").cast("string")))), lambda s: s.isNotNull())
    return v.select("path", F.array_join(shown, " ").alias("vector")).filter("vector <> ''")


# Index


@query(r"SELECT path, label, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT path, 'email' AS label, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS value FROM file UNION ALL SELECT path, 'number', unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 13 AND 19)) FROM file)) GROUP BY 1, 2")
def pii_by_label(g):
    """Distinct values of each label and file, merged inside the row."""
    one = lambda name, values: F.struct(F.lit(name).alias("label"), F.size(F.array_distinct(values)).cast("long").alias("n"))
    found = F.array(one("email", S.emails(F.col("text"))), one("number", S.digit_runs(F.col("text"))))
    return g.file.select("path", F.explode(found).alias("e")).select("path", "e.label", "e.n").filter("n > 0")


@query("SELECT path, status FROM file WHERE status <> 'ok' ORDER BY status, path LIMIT 50")
def problems_listing(g):
    """The first 50 files that are not in order, for a report."""
    return g.file.filter("status <> 'ok'").select("path", "status").orderBy("status", "path").limit(50)


@query("SELECT count(*) AS files, count(*) FILTER (WHERE status = 'error') AS errors, 100.0::DOUBLE * count(*) FILTER (WHERE status = 'error') / count(*) > 5 AS failed FROM file")
def run_counters(g):
    """Counts of a run, and whether more than five in a hundred failed."""
    errors = F.count_if(F.col("status") == "error")
    return g.file.agg(F.count("*").alias("files"), errors.alias("errors"), (100.0 * errors / F.count("*") > 5).alias("failed"))


@query("WITH c AS (SELECT status, count(*) AS n FROM file GROUP BY 1) SELECT status, n, greatest(6, CAST(floor(n / max(n) OVER () * 345) AS BIGINT)) AS width FROM c")
def chart_widths(g):
    """Bars of a chart: in proportion to the largest, six wide at least."""
    c = g.file.groupBy("status").agg(F.count("*").alias("n"))
    most = c.agg(F.max("n").alias("most"))
    return c.crossJoin(F.broadcast(most)).select("status", "n", F.greatest(F.lit(6).cast("long"), F.floor(F.col("n") / F.col("most") * 345)).alias("width"))  # one row


@query("""WITH gone AS (SELECT path FROM file WHERE age = 0), c AS (SELECT path, i AS ordinal, substr(text, i * 600 + 1, 680) AS chunk FROM (SELECT path, text, unnest(range(0, CAST(ceil(length(text) / 600.0) AS BIGINT))) AS i FROM file))
    SELECT path, ordinal, sha256(CASE WHEN path IN (SELECT path FROM gone) THEN concat('new ', chunk) ELSE chunk END) AS chunk_sha256 FROM c""")
def replace_file(g):
    """The chunk table after files were replaced: their old chunks go, the new ones come, the others stay."""
    from inkweave.functions.chunks import fixed_chunks

    old = fixed_chunks(g.file)
    changed = g.file.filter("age = 0")
    new = fixed_chunks(changed).withColumn("chunk", F.concat(F.lit("new "), "chunk"))
    out = old.join(changed.select("path"), "path", "left_anti").unionByName(new)
    return out.select("path", "ordinal", F.sha2("chunk", 256).alias("chunk_sha256"))


@query("SELECT f.path, strftime(coalesce(m.last, DATE '2020-01-01' + CAST(f.age AS INT)), '%Y-%m-%d') AS modified FROM file f LEFT JOIN (SELECT n, max(ts) AS last FROM change_log GROUP BY 1) m ON m.n = f.doc_id")
def commit_date_fallback(g):
    """A file's last commit, else its own date."""
    last = g.change_log.groupBy(F.col("n").alias("doc_id")).agg(F.max("ts").alias("last"))
    own = F.date_add(F.lit("2020-01-01").cast("date"), F.col("age").cast("int")).cast("timestamp")
    return g.file.join(last, "doc_id", "left").select("path", F.date_format(F.coalesce("last", own), "yyyy-MM-dd").alias("modified"))


@query("SELECT path FROM change_log WHERE path LIKE '%.md' AND NOT regexp_matches(path, '(^|/)(_archive|\\.obsidian)(/|$)') GROUP BY 1")
def incremental_paths(g):
    """Changed paths that an update looks at."""
    return g.change_log.select("path").distinct().filter(S.updated(F.col("path")))
