"""Change feeds and event windows as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from inkweave.operators.changes import fold_log


def read_log(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; each file is read once, also across restarts (by the checkpoint)."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def apply_changes(log: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last operation of each path under ``state``/batch=N: a version for each micro-batch, whole on its own.

    log: stream of ts, n, op, path.  A batch that is run again after a failure overwrites its own version from the one
    before, so every change counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.filter("op in ('A', 'M', 'D', 'R')").select("path", "ts", "n", "op")
        if number:
            new = new.unionByName(spark.read.parquet(f"{state}/batch={number - 1}").select("path", "ts", "n", "op"))
        best = new.groupBy("path").agg(F.max(F.struct("ts", "n", "op")).alias("m"))
        best.select("path", "m.ts", "m.n", "m.op").write.mode("overwrite").parquet(f"{state}/batch={number}")

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def final_state(log: DataFrame) -> DataFrame:
    """The batch form of ``apply_changes``."""
    return fold_log(log)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by window and type; what comes later than ``late`` does not count."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
