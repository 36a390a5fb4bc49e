"""A small corpus from files to edges."""

from pyspark.sql import functions as F

from inkweave.sources import markdown

FILES = {
    "a/hub.md": "---\ntags: [status/active, type/hub, project/alpha/x]\n---\n# Alpha Hub\n> **Downstream:** [leaf](leaf.md) · [gone](../b/gone.md)\n\nSee [the leaf](leaf.md#part \"t\") and [web](https://x.example). Jane Doe was here.\n",
    "a/leaf.md": "---\ntags: status/done\n---\nno heading, [broken](nowhere.md) [anchor](#x)\n",
    "_templates/bad.md": "---\nbad: [\n---\nbody words here\n",
    "_archive/old.md": "# Old\n",
    "log.md": "### 2026-01-02 — Pick a name\n**Decision:** yes\n**Why:** because\n**Alternatives considered:** none\n**Source / context:** [hub](a/hub.md)\n\n### 2026-01-03 — Another One\n**Decision:** no\n",
}


def build(spark, tmp_path):
    for p, t in FILES.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t, encoding="utf-8")
    corpus = markdown.read_corpus(spark, str(tmp_path))
    return corpus, markdown.parse(corpus).cache()


def test_corpus(spark, tmp_path):
    corpus, parsed = build(spark, tmp_path)
    got = {r.path: r for r in parsed.collect()}
    assert set(got) == set(FILES) - {"_archive/old.md"}
    hub = got["a/hub.md"]
    assert (hub.title, hub.status, hub.doc_type, list(hub.projects)) == ("Alpha Hub", "active", "hub", ["alpha"])
    assert (got["a/leaf.md"].title, got["a/leaf.md"].status) == ("leaf", "done")
    assert got["_templates/bad.md"].parse_status == "partial" and got["_templates/bad.md"].word_count == 3
    links = {(r.path, r.resolved, r.broken) for r in markdown.links(parsed, corpus).collect()}
    assert links == {("a/hub.md", "a/leaf.md", False), ("a/leaf.md", "a/nowhere.md", True), ("log.md", "a/hub.md", False)}
    edges = {(r.source_id, r.edge_type, r.target_id, r.edge_subtype) for r in markdown.edges(parsed, corpus).collect()}
    assert ("a/hub.md", "BLOCKS", "a/leaf.md", "downstream") in edges and ("a/hub.md", "BLOCKS", "b/gone.md", "downstream") in edges
    assert ("a/hub.md", "MEMBER_OF_PROJECT", "alpha", "") in edges
    decisions = {r.id: (r.parse_status, list(r.missing)) for r in markdown.decisions(parsed).collect()}
    assert decisions == {"2026-01-02-pick-a-name": ("ok", []), "2026-01-03-another-one": ("format_drift", ["Alternatives considered", "Source / context", "Why"])}
    people = spark.createDataFrame([("jane-doe", "Jane Doe"), ("jane", "Jane Roe")], "slug string, display_name string")
    assert [(r.path, r.slug, r.context.strip()) for r in markdown.mentions(parsed, people).collect()] == [("a/hub.md", "jane-doe", 'part "t") and [web](https://x.example). Jane Doe was here.')]


def test_mentions_equal_every_pattern_over_every_body(spark):
    """Names with signs, names inside names, words that touch, other letters; the context is that of the last place."""
    import re

    names = {"ob": "Pat O'Brien", "b": "O'Brien", "u": "Ümit Öz", "j": "J. R. Smith", "s": "Smith", "x": "Mary-Ann Lee", "none": "!!", "dup": "Smith", "null": None}
    bodies = {
        "a": "PAT O'BRIEN met o'brien's friend. Pat  O'Brien no.", "b": "ümit öz and j. r. smith; blacksmith Smithy _Smith_ smith.", "c": "Mary-Ann Lee, Mary Ann Lee\nMary-Ann\nLee", "d": "", "e": None,
        "f": "word " * 20_000 + "Smith " + "tail " * 30,
    }
    want = {}
    for p, body in bodies.items():
        for slug, name in names.items():
            if body and name and re.search(r"\w", name):
                for m in re.finditer(r"\b" + re.escape(name) + r"\b", body, re.IGNORECASE):
                    want[p, slug] = body[max(0, m.start() - 40) : m.end() + 40].replace("\n", " ")[:120]
    parsed = spark.createDataFrame(list(bodies.items()), "path string, body string").repartition(3)
    people = spark.createDataFrame(list(names.items()), "slug string, display_name string")
    assert {(r.path, r.slug): r.context for r in markdown.mentions(parsed, people).collect()} == want
    assert markdown.mentions(parsed, people.limit(0)).count() == 0


def test_equal_front_matter_is_read_once_and_edges_read_a_file_twice(spark, monkeypatch):
    import pandas as pd
    import yaml

    calls, real = [], yaml.safe_load
    monkeypatch.setattr(yaml, "safe_load", lambda text: calls.append(text) or real(text))
    blocks = ["tags: [a/b]", "", None, "bad: [", "tags: c"]
    got = markdown._front_matter(pd.Series(blocks * 50))
    assert sorted(calls) == ["bad: [", "tags: [a/b]", "tags: c"]
    assert [list(t) for t in got["tags"]] == [["a/b"], [], [], [], ["c"]] * 50 and got["note"].notna().tolist() == [False, False, False, True, False] * 50
    corpus = spark.createDataFrame([("d/a.md", "---\ntags: [project/p, type/hub, type/hub]\n---\n> **Siblings:** [b](b.md) [c](c.md)\n> **Upstream:** [b](b.md)\n")], "path string, text string")
    edges = markdown.own_edges(markdown.parse(corpus), F.lit("e"))
    assert {(r.edge_type, r.target_type, r.target_id, r.edge_subtype) for r in edges.collect()} == {("TAGGED", "tag", "project/p", ""), ("TAGGED", "tag", "type/hub", ""), ("MEMBER_OF_PROJECT", "project", "p", ""), ("MEMBER_OF_ENTITY", "entity", "e", ""), ("RELATED_TO", "doc", "d/b.md", "sibling"), ("RELATED_TO", "doc", "d/c.md", "sibling"), ("BLOCKS", "doc", "d/b.md", "upstream")}
    assert edges.count() == 7 and edges._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
