"""An approximate vector index: vectors by coarse cluster, several clusters of a query searched exactly.

The clusters' centres are learned on the driver from a bounded sample (``SAMPLE`` vectors, those with the least hashes of
their ids); every vector is then assigned to its nearest centre inside Arrow batches and written by cluster.  A query looks
into its ``probes`` nearest clusters; within these, distances are exact.  Queries meet vectors in an equal join of packed
chunks by cluster, so a large cluster is many chunks, which Spark may split over tasks, and each chunk hands on k rows a query.

Defined results: vectors that are null, hold nulls or values that are not finite, or are of zero length, have no distance
and are in no cluster; a query like that finds nothing; ties go by id.  With as many probes as clusters the search is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that centres are learned from, at most; rounds of learning; rows of a packed chunk.
SAMPLE, ROUNDS, CHUNK = 20_000, 12, 2048


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a direction, their unit vectors)."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    with np.errstate(invalid="ignore"):
        length = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return rows[good], x[good] / length[good, None]


@dataclass
class VectorIndex:
    """centres: clusters x dimension.  rows: vec_id, cluster, embedding of every vector, written by cluster under ``path``."""

    centres: np.ndarray
    rows: DataFrame

    @staticmethod
    def build(vectors: DataFrame, path: str, clusters: int, seed: int = 5) -> VectorIndex:
        """vectors: vec_id, embedding (one length; that of the first sampled vector)."""
        sample = vectors.filter("embedding is not null and size(embedding) > 0").select("embedding", F.xxhash64("vec_id", F.lit(seed)).alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
        sample = sample.combine_chunks() if isinstance(sample, pa.ChunkedArray) else sample
        dim = len(sample[0]) if len(sample) else 1
        _, x = _unit(sample, dim)
        rng = np.random.default_rng(seed)
        centres = x[rng.permutation(len(x))[:clusters]] if len(x) else np.zeros((1, dim))
        for _ in range(ROUNDS if len(x) else 0):
            own = (x @ centres.T).argmax(axis=1)
            total = np.zeros_like(centres)
            np.add.at(total, own, x)
            length = np.sqrt((total * total).sum(axis=1))
            centres = np.where(length[:, None] > 0, total / np.maximum(length, 1e-300)[:, None], centres)

        def run(batches):
            for b in batches:
                at, y = _unit(b.column(1), dim)
                own = (y @ centres.T).argmax(axis=1) if len(y) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(own.astype(np.int32)), b.column(1).take(pa.array(at)).cast(pa.list_(pa.float64()))], ["vec_id", "cluster", "embedding"])

        kind = vectors.schema["vec_id"].dataType.simpleString()
        placed = vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, cluster int, embedding array<double>")
        placed.hint("rebalance", "cluster").write.mode("overwrite").partitionBy("cluster").parquet(path)
        return VectorIndex(centres, vectors.sparkSession.read.schema(f"vec_id {kind}, embedding array<double>, cluster int").parquet(path))

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, vec_id, distance, rank of about the k nearest vectors of each query (vec_id, embedding)."""
        centres, dim = self.centres, self.centres.shape[1]

        def packed(ids, flat, cluster) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([cluster], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.ascontiguousarray(flat).tobytes()], pa.binary())], ["cluster", "ids", "flat"])

        def pack_vectors(batches):
            for b in batches:
                at, y = _unit(b.column(1), dim)
                own = b.column(2).to_numpy(zero_copy_only=False)[at]
                for c in np.unique(own):
                    some = np.flatnonzero(own == c)
                    for i in range(0, len(some), CHUNK):
                        part = some[i : i + CHUNK]
                        yield packed(b.column(0).take(pa.array(at[part])), y[part], c)

        def pack_queries(batches):
            for b in batches:
                at, y = _unit(b.column(1), dim)
                if not len(at):
                    continue
                near = np.argsort(-(y @ centres.T), axis=1, kind="stable")[:, :probes]
                for c in np.unique(near):
                    some = np.flatnonzero((near == c).any(axis=1))
                    for i in range(0, len(some), CHUNK):
                        part = some[i : i + CHUNK]
                        yield packed(b.column(0).take(pa.array(at[part])), y[part], c)

        def meet(batches):
            for b in batches:
                for at in range(len(b)):
                    q_ids, v_ids = (b.column(c)[at].values for c in ("q_ids", "v_ids"))
                    q, v = (np.frombuffer(b.column(c)[at].as_py(), np.float64).reshape(-1, dim) for c in ("q", "v"))
                    distance, ids = np.round(1 - q @ v.T, 6) + 0.0, v_ids.to_numpy(zero_copy_only=False)
                    for i, d in enumerate(distance):
                        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if k < len(d) else np.arange(len(d))
                        some = some[np.lexsort((ids[some], d[some]))[:k]]
                        yield pa.RecordBatch.from_arrays([pa.array([q_ids[i].as_py()] * len(some), q_ids.type), v_ids.take(pa.array(some)), pa.array(d[some])], ["query_id", "vec_id", "distance"])

        kind = lambda df: df.schema["vec_id"].dataType.simpleString()
        schema = lambda df: f"cluster int, ids array<{kind(df)}>, flat binary"
        v = self.rows.select("vec_id", "embedding", "cluster").mapInArrow(pack_vectors, schema(self.rows)).select("cluster", F.col("ids").alias("v_ids"), F.col("flat").alias("v"))
        q = queries.select("vec_id", "embedding").mapInArrow(pack_queries, schema(queries)).select("cluster", F.col("ids").alias("q_ids"), F.col("flat").alias("q"))
        found = v.join(q, "cluster").select("q_ids", "q", "v_ids", "v").mapInArrow(meet, f"query_id {kind(queries)}, vec_id {kind(self.rows)}, distance double")
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, recall: the share of the exact neighbours (query_id, vec_id) that were found, over all queries."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
