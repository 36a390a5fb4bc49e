"""The document graph as views over the star-schema tables, in SQL that Spark and DuckDB both read.

Orders are documents, customers are projects, suppliers are people, purchases are decisions: enough of each kind, with
ghosts, ties and dangling ends, for every query to find something.
"""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.sources.store import stored

TABLES = ("nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "pages")

UNION = "\n        UNION ALL "
#: Edges by kind.
EDGES = {
    "MEMBER_OF_PROJECT": [
        "SELECT 'doc' AS source_type, path AS source_id, 'MEMBER_OF_PROJECT' AS edge_type, 'project' AS target_type, concat('c', c) AS target_id, '' AS edge_subtype FROM doc",
        "SELECT 'doc', path, 'MEMBER_OF_PROJECT', 'project', concat('c', c + 1), '' FROM doc WHERE k % 7 = 0",
    ],
    "MEMBER_OF_ENTITY": [
        "SELECT 'doc', path, 'MEMBER_OF_ENTITY', 'entity', nat, '' FROM doc",
    ],
    "TAGGED": [
        "SELECT 'doc', path, 'TAGGED', 'tag', concat('status/', status), '' FROM doc WHERE status IS NOT NULL",
        "SELECT 'doc', path, 'TAGGED', 'tag', concat('topic/', k % 6000), '' FROM doc WHERE k % 2 = 0",
    ],
    "LINKS_TO": [
        "SELECT 'doc', a.path, 'LINKS_TO', 'doc', b.path, '' FROM doc a JOIN first_line ON a.k = l_orderkey AND l_partkey % 2 = 0 JOIN doc b ON b.k = l_orderkey + l_partkey % 50 + 1",
    ],
    "RELATED_TO": [
        "SELECT 'doc', a.path, 'RELATED_TO', 'doc', b.path, 'sibling' FROM doc a JOIN doc b ON b.k = a.k + 1 WHERE a.k % 5 = 0",
        "SELECT 'doc', b.path, 'RELATED_TO', 'doc', a.path, 'sibling' FROM doc a JOIN doc b ON b.k = a.k + 1 WHERE a.k % 10 = 0",
    ],
    "BLOCKS": [
        "SELECT 'doc', a.path, 'BLOCKS', 'doc', b.path, 'downstream' FROM doc a JOIN doc b ON b.k = a.k + 2 WHERE a.k % 4 = 0",
        "SELECT 'doc', a.path, 'BLOCKS', 'doc', b.path, 'upstream' FROM doc a JOIN doc b ON b.k = a.k + 3 WHERE a.k % 6 = 0",
    ],
    "MENTIONS": [
        "SELECT DISTINCT 'doc', path, 'MENTIONS', 'person', concat('s', l_suppkey), '' FROM doc JOIN {lineitem} ON k = l_orderkey",
    ],
    "ABOUT_DECISION": [
        "SELECT 'decision', concat('d', event_id), 'ABOUT_DECISION', 'doc', path, '' FROM {events} JOIN doc ON k = event_id WHERE event_type = 'purchase' AND event_id % 3 <> 0",
    ],
    "SUPERSEDES": [
        """SELECT 'decision', concat('d', event_id), 'SUPERSEDES', 'decision', concat('d', before), '' FROM
            (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events} WHERE event_type = 'purchase') p WHERE before IS NOT NULL""",
    ],
}

VIEWS = {
    "o": """SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderdate AS d, lower(n_name) AS nat
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "hubs": "SELECT c AS hub_c, min(k) AS hub FROM o GROUP BY c",
    "doc": """SELECT concat(nat, '/', c, '/', k, '.md') AS path, concat('Order ', k) AS title,
        CASE WHEN s = 'O' THEN 'active' WHEN s = 'F' THEN 'done' WHEN k % 3 = 1 THEN 'blocked' WHEN k % 3 = 2 THEN 'paused' END AS status,
        CASE WHEN k = hub THEN 'hub' WHEN k % 11 = 5 THEN 'journal' END AS doc_type,
        concat(CAST(d AS DATE), 'T00:00:00+00:00') AS last_modified, k, c, nat FROM o JOIN hubs ON c = hub_c""",
    "project": """SELECT concat('c', c_custkey) AS slug, CASE WHEN c_custkey % 10 <> 0 THEN path END AS hub_doc, (path IS NULL OR c_custkey % 10 = 0) AS is_ghost
        FROM {customer} LEFT JOIN doc ON c_custkey = c AND doc_type = 'hub'""",
    "first_line": "SELECT l_orderkey, l_partkey FROM {lineitem} WHERE l_linenumber = 1",
    "edge": UNION.join(x for kind in EDGES.values() for x in kind),
    "person": "SELECT concat('s', s_suppkey) AS slug, s_name AS display_name, concat('nation ', s_nationkey) AS role, (s_suppkey % 4 = 0) AS is_ghost FROM {supplier}",
    "person_alias": "SELECT concat('s', s_suppkey) AS slug, lower(s_name) AS alias FROM {supplier}",
    "broken_link": "SELECT path AS source_doc, concat('part ', l_partkey) AS link_text, concat('missing/', l_partkey, '.md') AS link_target FROM doc JOIN first_line ON k = l_orderkey WHERE l_partkey % 2 = 1",
    "decision": """SELECT concat('d', event_id) AS id, concat(CAST(ts AS DATE), '') AS date, concat('Purchase by ', user_id) AS title, concat('value ', CAST(round(value) AS BIGINT)) AS decision_text,
        CASE WHEN event_id % 4 = 3 THEN 'superseded' ELSE 'active' END AS status, event_id FROM {events} WHERE event_type = 'purchase'""",
    "format_drift": "SELECT 'decision' AS artifact_kind, id AS artifact_id, 'missing: Why' AS notes FROM decision WHERE event_id % 5 = 0",
    "change_log": """SELECT event_id AS n, ts, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'M' WHEN 'error' THEN 'D' WHEN 'signup' THEN 'R' ELSE 'T' END AS op,
        concat('u/', user_id, '.md') AS path FROM {events}""",
    "file": """SELECT concat(lang, '/', source, '/', doc_id, '.md') AS path, doc_id, lang, source, text, length(text) AS size, doc_id % 7 AS age, CASE doc_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'skipped' ELSE 'ok' END AS status FROM {documents}""",
}


#: Spark's own text where another one moves less: people are told apart where their orders lie, siblings are joined once.
OWN = {
    "MENTIONS": ["SELECT 'doc', path, 'MENTIONS', 'person', concat('s', l_suppkey), '' FROM (SELECT DISTINCT k, path, l_suppkey FROM doc JOIN {lineitem} ON k = l_orderkey)"],
    "RELATED_TO": ["""SELECT 'doc', s, 'RELATED_TO', 'doc', t, 'sibling' FROM (SELECT inline(CASE WHEN a.k % 10 = 0 THEN array(named_struct('s', a.path, 't', b.path), named_struct('s', b.path, 't', a.path))
        ELSE array(named_struct('s', a.path, 't', b.path)) END) FROM doc a JOIN doc b ON b.k = a.k + 1 WHERE a.k % 5 = 0)"""],
}
COLUMNS = "source_type, source_id, edge_type, target_type, target_id, edge_subtype"
TEXTS = {k: v for k, v in VIEWS.items() if k != "edge"} | {f"edge_{k}": f"SELECT * FROM ({UNION.join(OWN.get(k, v))}) AS e({COLUMNS})" for k, v in EDGES.items()}

#: Views that are written once.  Edges are views by kind, so that a query makes the kinds that it asks for and no others;
#: those without a join are read off the documents.
STORED = {"doc", "project", *(f"edge_{k}" for k, v in EDGES.items() if any(" JOIN " in x or "lag(" in x for x in v))}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of sf_dir.  The views of STORED are built once for the folder, the others as asked for."""
    if name == "edge":
        return edges(spark, sf_dir, *EDGES)
    if name in STORED:
        return stored(spark, sf_dir, name, lambda: _made(spark, sf_dir, name))
    return _made(spark, sf_dir, name)


def edges(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The edges of some kinds; the kind is a constant of each part, so a filter on it leaves the other parts out."""
    return reduce(DataFrame.unionByName, (view(spark, sf_dir, f"edge_{k}").withColumn("edge_type", F.lit(k)) for k in kinds))


def _made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    inputs = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _needed(name)}
    keep, built = _closure(name), {k for k in STORED if k != name}
    inputs |= {f"stored_{k}": view(spark, sf_dir, k) for k in built & keep}
    text = "WITH " + ",\n".join(f"{k} AS ({f'SELECT * FROM {{stored_{k}}}' if k in built else v})" for k, v in TEXTS.items() if k in keep) + f"\nSELECT * FROM {name}"
    return spark.sql(text, **inputs)


@cache
def _closure(name: str) -> frozenset[str]:
    """The views that a view reads, itself included; what stored ones read is left out."""
    out, todo = set(), [name]
    while todo:
        x = todo.pop()
        if x in TEXTS and x not in out:
            out.add(x)
            if x == name or x not in STORED:
                todo += re.findall(r"(?:FROM|JOIN)\s+(\w+)", TEXTS[x])
    return frozenset(out)


@cache
def _needed(name: str) -> tuple[str, ...]:
    text = " ".join(TEXTS[k] for k in _closure(name) if k == name or k not in STORED)
    return tuple(t for t in TABLES if f"{{{t}}}" in text)


def oracle(body: str) -> str:
    """DuckDB SQL: the views, then ``body``, which may start with more WITH entries."""
    text = ",\n".join(f"{k} AS ({v})" for k, v in VIEWS.items())
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    body = body.strip()
    return f"WITH {text}" + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
