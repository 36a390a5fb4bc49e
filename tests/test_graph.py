"""Effective status over every mix of its rule, LIKE scopes, masks and change logs on small frames."""

from collections import Counter
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from inkweave.functions import scalars
from inkweave.operators import audit, changes, graph

EDGES = "source_type string, source_id string, edge_type string, target_type string, target_id string, edge_subtype string"
STATES = ("active", "paused", None)


def cases():
    """(path, status, doc_type, projects) of every mix of own status, kind and states of up to two hubs, and of no hub."""
    hubs = {f"hub-{s}": s for s in STATES}
    out = [(f"z/{slug}.md", s, "hub", [slug]) for slug, s in hubs.items()]
    memberships = [[], ["hubless"], *([a] for a in hubs), *(list(pair) for pair in combinations(hubs, 2))]
    for n, (own, kind, slugs) in enumerate(product(("active", "done", None), (None, "journal", "hub"), memberships)):
        out.append((f"d/{n:03}.md", own, kind, slugs))
    return out, hubs


def expected(own, kind, slugs, hubs, path):
    """The rule: a hub keeps its own status; so does a status other than active; else the best hub's, an active one first, then by path."""
    governing = sorted((hubs[s] != "active", hubs[s] is None, f"z/{s}.md") for s in slugs if s in hubs and f"z/{s}.md" != path)
    if kind == "hub" or own not in ("active", None) or not governing:
        return own
    inherited = hubs[governing[0][2][2:-3]]
    return inherited if inherited is not None else own


@pytest.fixture(scope="module")
def tables(spark):
    docs, hubs = cases()
    doc = spark.createDataFrame([(p, p, s, t, f"20{10 + len(p) % 3}-01-01T00:00:00+00:00") for p, s, t, _ in docs], "path string, title string, status string, doc_type string, last_modified string")
    project = spark.createDataFrame([(s, f"z/{s}.md", False) for s in hubs] + [("hubless", None, True)], "slug string, hub_doc string, is_ghost boolean")
    edge = spark.createDataFrame([("doc", p, "MEMBER_OF_PROJECT", "project", s, "") for p, _, _, slugs in docs for s in slugs], EDGES)
    return doc, project, edge


def test_effective_status(tables):
    docs, hubs = cases()
    got = {r.path: (r.own_status, r.status) for r in graph.effective_status(*tables).collect()}
    assert got == {p: (s, expected(s, t, slugs, hubs, p)) for p, s, t, slugs in docs}


def test_status_mix_counts_members(tables):
    docs, hubs = cases()
    want = Counter((slug, expected(s, t, slugs, hubs, p) or "unknown") for p, s, t, slugs in docs for slug in slugs)
    assert {(r.slug, r.status): r.n for r in graph.status_mix(graph.effective_status(*tables), tables[2]).collect()} == want


def test_stale(spark):
    """A hub is as fresh as its newest member; what a hub governs and journals do not go stale."""
    old, fresh = "2001-05-05T00:00:00+00:00", "2030-05-05T00:00:00+00:00"
    rows = [("p/kept.md", "hub", old), ("p/member.md", None, fresh), ("q/left.md", "hub", old), ("q/member.md", None, old), ("alone.md", None, old), ("young.md", None, fresh), ("diary.md", "journal", old), ("README.md", None, old)]
    doc = spark.createDataFrame([(p, p, "active", t, m) for p, t, m in rows], "path string, title string, status string, doc_type string, last_modified string")
    project = spark.createDataFrame([("p", "p/kept.md", False), ("q", "q/left.md", False)], "slug string, hub_doc string, is_ghost boolean")
    edge = spark.createDataFrame([("doc", p, "MEMBER_OF_PROJECT", "project", p[0], "") for p, _, _ in rows if "/" in p], EDGES)
    got = {r.path for r in audit.stale_active_docs(graph.effective_status(doc, project, edge), project, edge, "2026-01-01").collect()}
    assert got == {"q/left.md", "alone.md"}


def test_negative_limit(tables):
    assert graph.newest(tables[0], -1).count() == 0


def test_scope_is_like(spark):
    d = spark.createDataFrame([("A_b/x.md",), ("aXb/x.md",), ("other/x.md",)], "path string")
    assert d.filter(graph.like_prefix(F.col("path"), "a_b/")).count() == 2


def test_blockers_both_ways(spark):
    rows = [("doc", "a", "BLOCKS", "doc", "b", "downstream"), ("doc", "b", "BLOCKS", "doc", "a", "upstream"), ("doc", "b", "BLOCKS", "doc", "c", "upstream")]
    e = spark.createDataFrame(rows, "source_type string, source_id string, edge_type string, target_type string, target_id string, edge_subtype string")
    assert {tuple(r) for r in graph.blockers(e).collect()} == {("b", "a"), ("b", "c")}


def test_delete_keeps_inbound(spark):
    e = spark.createDataFrame([("doc", "a", "LINKS_TO", "doc", "b", ""), ("doc", "b", "LINKS_TO", "doc", "a", ""), ("decision", "a", "ABOUT_DECISION", "doc", "b", "")], "source_type string, source_id string, edge_type string, target_type string, target_id string, edge_subtype string")
    doc = spark.createDataFrame([("a",), ("b",)], "path string")
    broken = spark.createDataFrame([("a", "x")], "source_doc string, link_target string")
    d, out, b = changes.delete_docs(doc, e, broken, spark.createDataFrame([("a",)], "path string"))
    assert {r.path for r in d.collect()} == {"b"} and b.count() == 0
    assert {(r.source_type, r.source_id) for r in out.collect()} == {("doc", "b"), ("decision", "a")}


def test_name_status(spark):
    lines = spark.createDataFrame([("A\tx.md",), ("R086\told.md\tnew.md",), ("C100\tq\tr",), ("D\ty.md",)], "line string")
    assert {tuple(r) for r in changes.parse_name_status(lines).collect()} == {("A", "x.md", None), ("R", "new.md", "old.md"), ("D", "y.md", None)}


def test_mask_whole_tokens(spark):
    d = spark.createDataFrame([("id 123456789 and 9123456789 x", ["123456789"])], "t string, v array<string>")
    assert d.select(scalars.mask(F.col("t"), F.col("v"))).first()[0] == "id [pii …6789] and 9123456789 x"


def test_luhn_and_paths(spark):
    d = spark.createDataFrame([("4111111111111111", "a/b/../c.md"), ("4111111111111112", "../x/./y.md")], "n string, p string")
    assert [tuple(r) for r in d.select(scalars.luhn_valid(F.col("n")), scalars.normal_path(F.col("p"))).collect()] == [(True, "a/c.md"), (False, "../x/y.md")]


def test_a_query_makes_the_kinds_of_edges_that_it_names(spark, tmp_path):
    from inkweave.plans import catalogue
    from inkweave.sources import store

    (tmp_path / "x").symlink_to("/root/testdata/sf0.001")
    made = lambda: {name for _, source, name in store._paths if source == f"{tmp_path}/x"}
    for query, kinds in (("count_active", set()), ("project_stubs", set()), ("project_decisions", {"ABOUT_DECISION"}), ("project_state", {"ABOUT_DECISION", "BLOCKS"}), ("audit_orphan_docs", {"LINKS_TO", "RELATED_TO", "BLOCKS"})):
        catalogue.QUERIES[query](spark, f"{tmp_path}/x")
        assert made() - {"project"} == {"doc"} | {f"edge_{k}" for k in kinds}
        store.forget(f"{tmp_path}/x")


def test_renames_move_edges_for_their_ends_that_are_documents(spark):
    """Every mix of kinds of ends, nulls among them; the kind of an end is no key of a join."""
    kinds = ("doc", "tag", None)
    rows = [(s, a, "X", t, b, "") for s in kinds for t in kinds for a in ("a", "q", None) for b in ("a", "b", "q")]
    doc, broken = spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("b", "x")], "source_doc string, link_target string")
    new = {"a": "n/a", "b": "n/b"}
    out = changes.rename_docs(doc, spark.createDataFrame(rows, EDGES), broken, spark.createDataFrame(list(new.items()), "path string, new_path string"))[1]
    end = lambda kind, x: new.get(x, x) if kind == "doc" else x
    assert Counter(tuple(r) for r in out.collect()) == Counter((s, end(s, a), x, t, end(t, b), y) for s, a, x, t, b, y in rows)
    assert "Join [source_type" not in out._jdf.queryExecution().executedPlan().toString()
