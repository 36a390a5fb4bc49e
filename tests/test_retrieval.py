"""Sections, hybrid search and its evaluation on small frames."""

from pyspark.sql import functions as F

from inkweave.operators import retrieval as R
from inkweave.operators import text as T
from inkweave.operators.sections import sections


def test_sections_follow_headings_and_fences(spark):
    text = "pre\n# One\na\n### Deep\nb\n## Two\n```\n# code\n```\n# Next\nc"
    got = [(r.heading, r.text) for r in sections(spark.createDataFrame([("x", text)], "path string, text string")).orderBy("section").collect()]
    assert got == [("", "pre"), ("One", "a"), ("One > Deep", "b"), ("One > Two", "```\n# code\n```"), ("Next", "c")]
    only = sections(spark.createDataFrame([("x", "# Just a title"), ("y", "")], "path string, text string")).collect()
    assert [(r.path, r.heading, r.text) for r in only] == [("x", "Just a title", "")]


def test_postings_count_inside_the_row(spark):
    d = spark.createDataFrame([("a", "to be or not to be"), ("b", ""), ("c", None)], "path string, text string")
    got = T.postings(d)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.term, r.tf, r.len) for r in got.collect()} == {("a", "to", 2, 6), ("a", "be", 2, 6), ("a", "or", 1, 6), ("a", "not", 1, 6)}


def test_fusion_has_both_legs(spark):
    files = spark.createDataFrame([("a", 1, "apple pie", "s", 0), ("b", 2, "plum tart", "s", 0), ("c", 3, "apple apple", "s", 400)], "path string, doc_id long, text string, source string, age long")
    v = spark.createDataFrame([(0, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    hits = T.bm25(files, ["apple"]).select("path", F.round("score", 6).alias("score"))
    got = {r.path: r.score for r in R.fused(files, v, v.filter("vec_id = 0"), hits, 3).collect()}
    # A term that most files have weighs next to nothing, so a and c tie by BM25 and the path decides.
    # Vector 0 has no file, so b and c are the first two of the vector leg.
    assert got == {"a": round(1 / 61, 10), "b": round(1 / 61, 10), "c": round(1 / 62 + 1 / 62, 10)}
    # Among the allowed, c is the first by its vector and the second by its words.
    only = R.fused(files, v, v.filter("vec_id = 0"), hits, 3, allowed=F.col("path") != "b")
    assert {r.path: r.score for r in only.collect()} == {"a": round(1 / 61, 10), "c": round(1 / 61 + 1 / 62, 10)}
    found = R.search(only, files, ["apple"], cap_by="source", per_source=2).collect()
    assert [(r.path, r.candidates) for r in found] == [("a", 2), ("c", 2)]


def test_evaluation(spark):
    near = spark.createDataFrame([(1, 10, 0.1, 1), (1, 11, 0.2, 2), (2, 10, 0.7, 1), (2, 12, 0.8, 2), (3, 13, 0.4, 1)], "query_id long, vec_id long, distance double, rank int")
    right = spark.createDataFrame([(1, 10), (2, 12)], "query_id long, vec_id long")
    r = R.evaluate(near, right, 0.5).first()
    assert (r.queries, r.hit_1, r.hit_k, r.mrr, r.accepted, r.median, r.p95) == (3, round(1 / 3, 6), round(2 / 3, 6), 0.5, round(2 / 3, 6), 0.4, 0.4)


def test_hashed_vectors_are_of_unit_length(spark):
    d = R.hashed_vectors(spark.createDataFrame([("x", "a b a"), ("y", "")], "path string, text string"), 16)
    got = {r.path: sum(x * x for x in r.vector) for r in d.collect()}
    assert abs(got["x"] - 1) < 1e-9 and got["y"] == 0


def test_knn_over_many_chunks_with_ties(spark):
    """Against all pairs: copies tie and go by id, zero vectors are no neighbours; packed queries are read, not made anew."""
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.integers(0, 3, (9000, 4)).astype(float)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(2)
    near = T.knn(d, d.filter("vec_id % 1000 = 1"), 25)
    assert "inkweave-store" in near._jdf.queryExecution().executedPlan().toString()
    length, want = np.sqrt((v * v).sum(1)), set()
    for q in range(1, 9000, 1000):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.round(1 - v @ v[q] / (length * length[q]), 6) + 0.0
        want |= {(q, int(i), k + 1) for k, i in enumerate([i for i in np.lexsort((np.arange(9000), x)) if not np.isnan(x[i])][:25])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in near.collect()} == want


def test_hashed_vectors_equal_counts_by_md5(spark):
    from hashlib import md5

    texts = ["to be or not to be", "", None, "a " * 500 + "b"]
    got = R.hashed_vectors(spark.createDataFrame(list(enumerate(texts)), "path long, text string"))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        n = [0] * 64
        for w in (texts[r.path] or "").split():
            n[int(md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        size = max(sum(x * x for x in n) ** 0.5, 1e-12)
        assert list(r.vector) == [x / size for x in n]
