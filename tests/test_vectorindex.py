"""The vector index against the exact search: recall, exactness with all probes, awkward vectors."""

import numpy as np

from inkweave.operators import text as T
from inkweave.operators.vectorindex import VectorIndex, recall


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def test_recall_and_exactness(spark, tmp_path):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 24))
    x = (middle[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[2000:2900] = x[0]  # a group of copies with nearly a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [1.0] * 3), (9004, [None] * 24), (9100, [0.0] * 24)]
    vectors = frame(spark, rows + bad)
    index = VectorIndex.build(vectors, f"{tmp_path}/v", 16)
    assert sorted(r.vec_id for r in index.rows.select("vec_id").collect()) == list(range(3000))
    asked = vectors.filter("vec_id % 100 = 0 and vec_id <> 9000")
    exact = T.knn(frame(spark, rows), frame(spark, rows).filter("vec_id % 100 = 0"), 10)
    got = recall(index.search(asked, 10, 4), exact).first()
    assert got.queries == 30 and got.recall >= 0.9
    whole = {(r.query_id, r["rank"]): (r.vec_id, round(r.distance, 5)) for r in index.search(asked, 10, 16).collect()}
    want = {(r.query_id, r["rank"]): (r.vec_id, round(r.distance, 5)) for r in exact.collect()}
    assert len(whole) == len(want) == 300 and sum(whole[k] == want[k] for k in want) >= 295  # unit vectors round at other places


def test_empty(spark, tmp_path):
    index = VectorIndex.build(frame(spark, [(1, None)]), f"{tmp_path}/v", 4)
    assert index.search(frame(spark, [(1, [1.0])]), 3, 2).count() == 0
