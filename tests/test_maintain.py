"""The maintained graph: any split of a log, broken runs, links that mend, people that change, subset runs."""

import pytest
from pyspark.sql import functions as F

from inkweave.operators import maintain
from inkweave.sources.snapshot import Snapshot

ENTITIES = {"acme/": "acme", "acme/lab/": "lab", "home/": "home"}


def page(*tags, body="text"):
    return f"---\ntags: [{', '.join(tags)}]\n---\n{body}\n"


#: (n, op, path, old_path, text at the end of the entry)
STEPS = [
    (1, "A", "acme/hub.md", None, page("type/hub", "project/alpha", "status/active", body="# Alpha\n[leaf](leaf.md) [pic](../pic.png)\nJane Doe wrote it.")),
    (1, "A", "acme/leaf.md", None, page("project/alpha", body="see [hub](hub.md) and [gone](gone.md)")),
    (2, "A", "memory/people/jane.md", None, "---\ndisplay_name: Jane Doe\naliases: [jd]\nrole: lead\n---\nabout her"),
    (3, "A", "home/a.md", None, page("project/alpha", "project/beta", body="> **Downstream:** [h](../acme/hub.md)\njane  doe is not the name; JANE DOE is.")),
    (4, "A", "pic.png", None, None),
    (5, "A", "memory/decisions-log.md", None, "### 2026-01-02 — Go\n**Decision:** yes [hub](../acme/hub.md)\n\n### 2026-01-03 — Stop\n**Decision:** no [x](../acme/gone.md)\n"),
    (6, "A", "acme/gone.md", None, page(body="here now")),
    (7, "M", "acme/leaf.md", None, page("status/done", "project/beta", "type/hub", body="no links, Jane Doe")),
    (8, "R", "acme/lab/hub.md", "acme/hub.md", page("type/hub", "project/alpha", "status/active", body="# Alpha\n[leaf](../leaf.md)")),
    (9, "D", "acme/gone.md", None, None),
    (10, "M", "memory/people/jane.md", None, "---\nname: Jane Roe\n---\n"),
    (11, "A", "home/b.md", None, "---\nbad: [\n---\nJane Roe! and jane-roe"),
    (12, "T", "home/b.md", None, "not counted"),
    (13, "R", "home/c.md", "home/a.md", page("project/alpha", body="moved")),
    (14, "A", "home/a.md", None, page("project/beta", body="again at the old place, Jane Roe")),
    (15, "A", "_archive/x.md", None, page("project/zeta")),
    (16, "D", "pic.png", None, None),
    (17, "A", "home/null.md", None, None),
]
TABLES = ("doc", "edge", "broken_link", "project", "person", "decision", "mention", "quarantine", "other")


def frames(spark, upto):
    now = {}
    for n, op, path, before, text in STEPS:
        if n <= upto and op != "T":
            now.pop(before, None)
            now[path] = text
            if op == "D":
                del now[path]
    log = spark.createDataFrame([s[:4] for s in STEPS if s[0] <= upto], "n long, op string, path string, old_path string")
    return log, spark.createDataFrame(list(now.items()), "path string, text string").repartition(2)


def state(graph):
    return {t: sorted(map(repr, (r.asDict() for r in getattr(graph, t).collect()))) for t in TABLES}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    return maintain.apply_log(spark, str(tmp_path_factory.mktemp("m")), *frames(spark, 17), ENTITIES, buckets=4)


def test_what_it_holds(whole):
    e = {(r.source_id, r.edge_type, r.target_id) for r in whole.edge.collect()}
    assert {("acme/lab/hub.md", "LINKS_TO", "acme/leaf.md"), ("2026-01-03-stop", "ABOUT_DECISION", "acme/gone.md"), ("home/b.md", "MENTIONS", "jane")} - e == {("2026-01-03-stop", "ABOUT_DECISION", "acme/gone.md")}
    assert ("home/a.md", "MENTIONS", "jane") in e and ("acme/leaf.md", "MENTIONS", "jane") not in e
    assert ("acme/lab/hub.md", "MEMBER_OF_ENTITY", "lab") in e and ("alpha", "MEMBER_OF_ENTITY", "home") in e
    assert {(r.slug, r.hub_doc, r.is_ghost) for r in whole.project.collect()} == {("alpha", "acme/lab/hub.md", False), ("beta", "acme/leaf.md", False)}
    assert {r.path for r in whole.quarantine.collect()} == {"home/null.md"} and {r.path for r in whole.doc.filter("parse_status = 'partial'").collect()} == {"home/b.md"}
    assert whole.mention.filter("path = 'home/b.md'").first().context == "Jane Roe! and jane-roe"


@pytest.mark.parametrize("cuts", [[6, 9, 17], [1, 7, 10, 13, 14, 17]])
def test_any_split_equals_one_run(spark, tmp_path, whole, cuts):
    for upto in cuts:
        graph = maintain.apply_log(spark, f"{tmp_path}/g", *frames(spark, upto), ENTITIES, buckets=4)
    assert state(graph) == state(whole)
    assert maintain.apply_log(spark, f"{tmp_path}/g", *frames(spark, 17), ENTITIES, buckets=4).version.version == graph.version.version


def test_links_break_and_mend_without_their_files(spark, tmp_path):
    broken = {}
    for upto in (3, 6, 9):
        graph = maintain.apply_log(spark, f"{tmp_path}/g", *frames(spark, upto), ENTITIES, buckets=4)
        broken[upto] = {(r.source_doc, r.link_target) for r in graph.broken_link.collect()}
    assert broken == {3: {("acme/hub.md", "../pic.png"), ("acme/leaf.md", "gone.md")}, 6: set(), 9: {("memory/decisions-log.md", "../acme/hub.md"), ("memory/decisions-log.md", "../acme/gone.md")}}


def test_a_broken_run_changes_nothing(spark, tmp_path, whole, monkeypatch):
    root = f"{tmp_path}/g"
    before = state(maintain.apply_log(spark, root, *frames(spark, 6), ENTITIES, buckets=4))
    for name in ("commit", "replace"):
        calls = []
        with monkeypatch.context() as m:
            real = getattr(Snapshot, name)

            def fail(self, *a, real=real, calls=calls, **b):
                calls.append(1)
                if len(calls) > (3 if name == "replace" else 0):
                    raise RuntimeError("lost")
                return real(self, *a, **b)

            m.setattr(Snapshot, name, fail)
            with pytest.raises(RuntimeError):
                maintain.apply_log(spark, root, *frames(spark, 17), ENTITIES, buckets=4)
        assert state(maintain.Graph.latest(spark, root)) == before
    assert state(maintain.apply_log(spark, root, *frames(spark, 17), ENTITIES, buckets=4)) == state(whole)


def test_a_subset_run_deletes_nothing(spark, tmp_path):
    root = f"{tmp_path}/g"
    maintain.apply_log(spark, root, *frames(spark, 8), ENTITIES, buckets=4)
    graph = maintain.apply_log(spark, root, *frames(spark, 14), ENTITIES, only=F.col("path").startswith("home/") | (F.col("path") == "acme/gone.md"))
    assert {r.path for r in graph.doc.collect()} >= {"home/a.md", "home/b.md", "home/c.md", "acme/gone.md"} and graph.version.facts["applied"] == 8


def test_a_small_change_writes_few_buckets(spark, tmp_path):
    root = f"{tmp_path}/g"
    rows = [(f"d/{i}.md", page(f"topic/{i % 9}", body=f"[n]({i + 1}.md)")) for i in range(400)]
    log = spark.createDataFrame([(1, "A", p, None) for p, _ in rows], "n long, op string, path string, old_path string")
    corpus = spark.createDataFrame(rows, "path string, text string")
    maintain.apply_log(spark, root, log, corpus)
    graph = maintain.apply_log(spark, root, log.unionByName(log.filter("path in ('d/7.md', 'd/8.md')").withColumn("n", F.lit(2)).withColumn("op", F.lit("D"))), corpus)
    written = graph.version.tables["body"]["written"]
    assert sum(v == 2 for v in written.values()) <= 2 and len(written) > 50
    assert {(r.source_doc, r.link_target) for r in graph.broken_link.collect()} == {("d/6.md", "7.md"), ("d/399.md", "400.md")}


def test_a_fold_keeps_the_greatest_entry_without_sorting_the_log(spark):
    import random

    random.seed(3)
    rows = [(random.choice([None, *range(40)]), random.choice("AMDRT"), f"p{random.randrange(60)}", random.choice([None, f"p{random.randrange(60)}"])) for _ in range(400)]
    want = {}
    for n, op, path, before in rows:
        if op == "T":
            continue
        for k, kind, at in ((0, "D", before if op == "R" else None), (1, "D" if op == "D" else "M", path)):
            if at is not None:
                want[at] = max(want.get(at, (-2, 0, "")), (-1 if n is None else n, k, kind))
    got = maintain.fold(spark.createDataFrame(rows, "n long, op string, path string, old_path string"))
    assert {r.path: r.op for r in got.collect()} == {path: kind for path, (_, _, kind) in want.items()}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_tables_without_a_touched_file_are_not_written(spark, tmp_path):
    root = tmp_path / "g"
    log = spark.createDataFrame([(i, "A", f"d/{i}.md", None) for i in range(9)], "n long, op string, path string, old_path string")
    corpus = log.select("path", F.lit(page("project/alpha")).alias("text"))
    graph = maintain.apply_log(spark, str(root), log, corpus, buckets=4)
    written = {p.parent.name for p in root.glob("*/v=1")}
    assert {"doc", "own_edge", "project"} <= written and not written & {"person", "decision", "about", "other"}
    assert graph.person.count() == 0 and graph.other.count() == 0 and graph.doc.count() == 9
