"""A change log applied in micro-batches equals the folded log."""

from inkweave.operators.changes import fold_log
from inkweave.sources.views import view
from inkweave.streaming import feed

DIR = "/root/testdata/sf0.001"


def test_apply_in_batches(spark, tmp_path):
    log = view(spark, DIR, "change_log")
    log.repartition(3).write.parquet(f"{tmp_path}/log")
    stream = feed.read_log(spark, f"{tmp_path}/log", "n long, ts timestamp, op string, path string", 1)
    q = feed.apply_changes(stream, f"{tmp_path}/state", f"{tmp_path}/ck")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/state/batch=2").select("path", "op", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold_log(log).select("path", "op", "n").collect()))
