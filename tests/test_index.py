"""The kept index against lists of tokens, upserts against rebuilds, and what a search reads."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkweave.operators import inverted as I
from inkweave.sources.snapshot import Snapshot

ROWS = [
    ("a", "Blue Moon", "the quick brown fox jumps over the lazy dog. The quick fox"), ("b", "moon", "brown quick the fox"), ("c", None, None), ("d", "", "quick " * 5 + "fox-trot under moonlight"),
    ("e", "quick", "brown fox"), ("f", "fox", "lazy lazy dog"), ("g", "x", "lorem ipsum"),
]
FIELDS = ["title", "text"]


def toks(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, title string, text string").repartition(3)


def want(rows):
    out = Counter()
    for p, *texts in rows:
        places = {}
        for k, t in enumerate(texts):
            for i, w in enumerate(toks(t)):
                places.setdefault(w, []).append(k * I.FIELD + i)
        for w, at in places.items():
            out[p, w, len(at), tuple(at), tuple(len(toks(t)) for t in texts)] += 1
    return out


def got(index):
    return Counter((r.path, r.term, r.tf, tuple(r.places), tuple(r.lengths)) for r in index.postings().collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return I.Index(spark, str(tmp_path_factory.mktemp("i") / "x"), FIELDS).upsert(frame(spark, ROWS))


def found(df):
    return sorted(r.path for r in df.collect())


def test_postings_and_counts(index):
    assert got(index) == want(ROWS)
    assert index.counts() == (7, [sum(len(toks(r[k])) for r in ROWS) for k in (1, 2)])


def test_units(index):
    assert found(index.search(every=[I.phrase("quick", "brown", "fox")])) == ["a"]
    assert found(index.search(every=[I.phrase("quick", "brown")])) == ["a"]  # title and text do not touch in e
    assert found(index.search(every=[I.prefix("moon")])) == ["a", "b", "d"]
    assert found(index.search(every=[I.near("fox", "brown", 1)])) == ["a", "e"]
    assert found(index.search(every=[I.near("brown", "fox", 2)])) == ["a", "b", "e"]
    assert found(index.search(every=[I.word("fox")], none=[I.word("lazy"), I.word("under")])) == ["b", "e"]
    assert found(index.search(some=[I.word("ipsum"), I.phrase("lazy", "lazy")])) == ["f", "g"]
    assert found(index.search(every=[I.word("quick"), I.word("moon")])) == ["a", "b"]
    assert found(index.search(every=[I.word("quick")], fields=["title"])) == ["e"]
    assert found(index.search(every=[I.word("absent")])) == [] and found(index.search(some=[I.prefix("zz")])) == []


def test_score_equals_the_formula(index):
    import math

    docs = {p: toks(t) + toks(x) for p, t, x in ROWS}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    expected = {}
    for p, w in docs.items():
        s = 0
        for t in ("quick", "lazy"):
            df = sum(t in x for x in docs.values())
            s -= max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if s:
            expected[p] = round(s, 9)
    assert {r.path: round(r.score, 9) for r in index.search(some=[I.word("quick"), I.word("lazy")]).collect()} == expected
    q = index.spark.createDataFrame([(1, "quick"), (1, "lazy"), (2, "dog"), (3, "none")], "query_id long, term string")
    best = index.best(q, 3).collect()
    assert [r.path for r in sorted(best, key=lambda r: r["rank"]) if r.query_id == 1] == [p for _, p in sorted((round(s, 6), p) for p, s in expected.items())][:3]
    only = index.best(q, 3, index.spark.createDataFrame([("f",), ("e",)], "path string"))
    assert {(r.query_id, r.path, r["rank"]) for r in only.collect()} == {(1, "f", 1), (1, "e", 2), (2, "f", 1)}


def test_best_moves_no_pairs_of_questions_and_documents(spark, tmp_path):
    """Copies tie and go by path, rows of one path are taken together, allowed ones alone get ranks; pairs are not grouped."""
    import math
    import random

    rng = random.Random(3)
    rows = [(f"p{i:03}", None, " ".join(rng.choices(["common"] * 30 + [f"w{k}" for k in range(40)], k=rng.randint(0, 12)))) for i in range(150)]
    rows += [(f"copy{i:02}", None, "common w1 w2") for i in range(40)] + [("p000", None, "w1 extra")]
    index = I.Index(spark, f"{tmp_path}/i", FIELDS).upsert(frame(spark, rows))
    asked = {q: rng.sample(["common", "absent", *(f"w{k}" for k in range(40))], 4) for q in range(25)} | {99: ["common"], 98: ["w1", "common"]}
    n, mean = len(rows), sum(len(toks(r[2])) for r in rows) / len(rows)
    docs = {}
    for p, _, x in rows:
        docs.setdefault(p, []).append(toks(x))
    df = {w: sum(any(w in x for x in xs) for xs in docs.values()) for ws in asked.values() for w in ws}
    even = {p for p in docs if p[-1] in "02468"}
    for only in (None, even):
        expected = set()
        for q, ws in asked.items():
            scores = []
            for p, xs in docs.items():
                tf = {w: sum(x.count(w) for x in xs) for w in ws}
                size = {w: max(len(x) for x in xs if w in x) for w in ws if tf[w]}  # the longest of a path's rows with the term
                s = sum(-max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[w] / mean)) for w, f in tf.items() if f)
                if any(tf.values()) and (only is None or p in only):
                    scores.append((round(s, 6) + 0.0, p))
            expected |= {(q, p, s, i + 1) for i, (s, p) in enumerate(sorted(scores)[:7])}
        questions = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "query_id long, term string")
        best = index.best(questions, 7, None if only is None else spark.createDataFrame([(p,) for p in only], "path string"))
        assert {(r.query_id, r.path, r.score, r["rank"]) for r in best.collect()} == expected
        assert not re.search(r"hashpartitioning\(query_id#\w+, path#", best._jdf.queryExecution().executedPlan().toString())


def test_a_search_reads_postings_of_its_terms_only(index):
    plan = index.search(every=[I.phrase("quick", "brown")])._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert scans and all("/postings/" in x and re.search(r"PartitionFilters: \[part#\w+ IN", x) and "In(term, [brown,quick])" in x for x in scans)


def test_upserts_equal_a_rebuild(spark, tmp_path):
    index = I.Index(spark, f"{tmp_path}/i", FIELDS).upsert(frame(spark, ROWS))
    now = {r[0]: r for r in ROWS}
    for changed, gone in (([("a", "new title", "other words"), ("h", "added", "fox")], ["b", "absent"]), ([("b", "back", "again fox"), ("a", None, "fox")], []), ([], ["c", "h"])):
        index.upsert(frame(spark, changed), spark.createDataFrame([(p,) for p in gone], "path string"))
        now = {p: r for p, r in now.items() if p not in gone} | {r[0]: r for r in changed}
        assert got(index) == want(now.values())
        assert index.counts() == (len(now), [sum(len(toks(r[k])) for r in now.values()) for k in (1, 2)])
    assert found(index.search(every=[I.word("fox")])) == ["a", "b", "d", "e", "f"]
    index.compact()
    assert got(index) == want(now.values()) and index.counts()[0] == len(now)
    assert len(Snapshot.latest(spark, index.root).facts["segments"]) == 1


def test_a_broken_upsert_is_not_seen(spark, tmp_path, monkeypatch):
    index = I.Index(spark, f"{tmp_path}/i", FIELDS).upsert(frame(spark, ROWS))
    with monkeypatch.context() as m:
        m.setattr(Snapshot, "commit", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.upsert(frame(spark, [("a", "half", "done")]))
    assert got(index) == want(ROWS) and index.version() == 1
    index.upsert(frame(spark, [("g", "whole", "done")]))
    assert got(index) == want([*ROWS[:-1], ("g", "whole", "done")])


def test_empty_and_null(spark, tmp_path):
    index = I.Index(spark, f"{tmp_path}/i", FIELDS).upsert(frame(spark, [(None, "a", "b")]))
    assert index.counts() == (0, [0, 0]) and index.postings().count() == 0 and index.search(every=[I.word("a")]).count() == 0
    twice = I.Index(spark, f"{tmp_path}/j", FIELDS).upsert(frame(spark, [("p", "a", "b"), ("p", "a", "c"), ("q", None, "long " * 100_000)]))
    assert twice.counts()[0] == 3 and found(twice.search(every=[I.word("b"), I.word("c")])) == ["p"]
    assert twice.postings(["long"]).select(F.size("places").alias("n")).first().n == 100_000


def test_snapshot_replaces_touched_buckets_only(spark, tmp_path):
    rows = lambda xs: spark.createDataFrame(xs, "path string, n int")
    first = Snapshot.latest(spark, f"{tmp_path}/s").next()
    first.replace("t", "path", rows([(f"p{i}", 0) for i in range(200)]), rows([(f"p{i}", i) for i in range(200)]), 16)
    first.commit()
    second = Snapshot.latest(spark, f"{tmp_path}/s").next()
    hit = second.replace("t", "path", rows([("p3", 0), ("p4", 0)]), rows([("p4", -4)]))
    assert len(hit) <= 2 and Snapshot.latest(spark, f"{tmp_path}/s").version == 1
    second.commit()
    now = Snapshot.latest(spark, f"{tmp_path}/s")
    assert now.version == 2 and sorted(set(now.tables["t"]["written"].values())) == [1, 2] and list(now.tables["t"]["written"].values()).count(2) == len(hit)
    assert {(r.path, r.n) for r in now.read("t").collect()} == {(f"p{i}", i if i != 4 else -4) for i in range(200) if i != 3}
    assert first.read("t").count() == 200  # a reader of the older version still has it


def test_postings_are_packed_by_term_and_block(spark, tmp_path):
    """What is shuffled and sorted has a row for each term and block of documents instead of one for each posting."""
    rows = [(f"p{i:02}é", "t", f"common words é {i} common") for i in range(60)]
    index = I.Index(spark, f"{tmp_path}/i", FIELDS).upsert(frame(spark, rows))
    kept = spark.read.parquet(f"{index.root}/postings").filter("term = 'common'")
    assert kept.count() <= 3 and index.postings(["common"]).count() == 60  # three batches
    assert got(index) == want(rows)
    assert index.compact().postings().count() == 60 * 4 and got(index) == want(rows)


def test_documents_are_dealt_by_no_join(spark, tmp_path, monkeypatch):
    """A merge join can become a broadcast join while a query runs, so what deals and orders documents is an exchange (F1)."""
    rows = [(f"p{i:02}", f"t{i % 3}", f"w{i % 5} w{i % 7} w{i % 2} w1") for i in range(40)]
    index = I.Index(spark, f"{tmp_path}/i", FIELDS).upsert(frame(spark, rows))
    questions = spark.createDataFrame([(q, f"w{(q + k) % 7}") for q in range(7) for k in range(3)], "query_id long, term string")
    allowed = spark.createDataFrame([(p,) for p, *_ in rows if p[-1] != "7"] + [("absent",), (None,)], "path string")
    plans, write = [], I.written
    monkeypatch.setattr(I, "written", lambda s, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(s, df))[1])
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        best = index.best(questions, 40, allowed).collect()
    finally:
        spark.conf.unset(key)
    docs = {p: set(toks(f"{t} {x}")) for p, t, x in rows if p[-1] != "7"}
    assert {(r.query_id, r.path) for r in best} == {(q, p) for q in range(7) for p, w in docs.items() if w & {f"w{(q + k) % 7}" for k in range(3)}}
    (plan,) = [p for p in plans if "_packed" in p or "MapInArrow run" in p.split("\n")[1]]
    assert re.search(r"MapInArrow.*\n\W*Sort \[path.*\n\W*Exchange hashpartitioning\(xxhash64\(path", plan)


def test_an_index_by_documents_gives_what_one_by_terms_gives(spark, tmp_path, monkeypatch):
    """Rows of one path, upserts, fields, allowed documents; questions are answered without moving a posting (F2 to F4)."""
    import random

    rng = random.Random(9)
    monkeypatch.setattr(I, "TOKENS", 40)
    text = lambda: " ".join(rng.choices(["common"] * 9 + [f"w{k}" for k in range(15)], k=rng.randint(0, 9)))
    rows = [(f"p{i:02}", rng.choice([None, "w1 w2", "common"]), text()) for i in range(60)] + [("p00", "w1", "w1 w3"), ("p00", None, ""), (None, "w1", "w1")]
    new = [(f"p{i:02}", None, text()) for i in range(50, 66)]
    two = [I.Index(spark, f"{tmp_path}/{b}", FIELDS, parts=4, by_term=b).upsert(frame(spark, rows)).upsert(frame(spark, new), spark.createDataFrame([("p07",)], "path string")) for b in (True, False)]
    assert got(two[0]) == got(two[1]) and two[0].counts() == two[1].counts()
    assert found(two[1].search(every=[I.word("common"), I.prefix("w1")])) == found(two[0].search(every=[I.word("common"), I.prefix("w1")]))
    questions = spark.createDataFrame([(q, w) for q in range(20) for w in rng.sample(["common", "absent", *(f"w{k}" for k in range(15))], 4)], "query_id long, term string")
    for only, fields in ((None, None), ([p for p, *_ in rows if p and p[-1] != "3"], ["text"])):
        allowed = None if only is None else spark.createDataFrame([(p,) for p in only], "path string")
        best = [index.best(questions, 5, allowed, fields) for index in two]
        assert sorted(map(tuple, best[0].collect())) == sorted(map(tuple, best[1].collect()))
        assert "_packed" not in best[1]._jdf.queryExecution().executedPlan().toString()
