"""Search operators on awkward rows."""

import duckdb
import numpy as np

from inkweave.operators import text as T
from inkweave.plans import catalogue


def test_length_metrics_counts_before_it_ranks(spark, tmp_path):
    rows = [("a", "x" * (i % 7)) for i in range(201)] + [("a", None)] * 9 + [("b", "y"), ("c", None), (None, "zz"), (None, "zzzz")]
    frame = spark.createDataFrame(rows, "role string, text string")
    got = T.length_metrics(frame)
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    frame.write.parquet(f"{tmp_path}/c.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet/*.parquet'")
    want = duck.execute(f"SELECT role, n, median, p95 FROM ({catalogue.SQL['eval_metrics']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select("role", "n", "median", "p95").collect())
    assert catalogue.QUERIES["eval_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().find("collect_list") < 0


def test_knn_takes_any_number_of_queries(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2300, 8)).astype(np.float32)
    x[5] = x[4]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2300, None)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in T.knn(frame, frame, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.vec_id)
    y = x.astype(float)
    length = np.sqrt((y * y).sum(1))
    near = np.round(1 - y @ y.T / np.outer(length, length), 6) + 0.0
    assert len(got) == 2300
    for q in range(2300):
        best = sorted(zip(near[q].tolist(), range(2300), strict=True))[:4]
        assert [got[q][i + 1] for i in range(4)] == best


def test_a_task_gives_the_k_best_of_a_query_and_no_more(spark):
    """Ties with the last one go by id, so what tasks give grows with the queries and not with chunks or ties (F2, F3)."""
    import random

    import pyarrow as pa

    rng = random.Random(1)
    for kind, k in ((str, 1), (str, 7), (int, 3)):
        ids = T.Ids()
        best, want, names = T.Best(2, k, ids), [[], []], rng.sample(range(10000), 300)
        for c in range(6):
            mine = [kind(x) for x in names[c * 50 : c * 50 + 50]]
            for q in range(2):
                values = np.array([rng.randint(0, 3) / 2 for _ in mine])
                want[q] += zip(values.tolist(), mine, strict=True)
                best.add(q, ids.add(c, pa.array(mine)), np.arange(50), values)
        got = [tuple(x) for b in best.listed(pa.array([0, 1]), ["q", "id", "v"], 4) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted(got) == sorted((q, i, v) for q in range(2) for v, i in sorted(want[q])[:k])
    same = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(500)], "vec_id long, embedding array<double>").repartition(20)
    near = T.knn(same, same.filter("vec_id < 3"), 4)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" in plan and {(r.query_id, r.vec_id) for r in near.collect()} == {(0, i) for i in (0, 2, 4, 6)} | {(1, i) for i in (1, 3, 5, 7)} | {(2, i) for i in (0, 2, 4, 6)}
