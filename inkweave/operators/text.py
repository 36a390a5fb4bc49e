"""Full-text search: tokens, postings, BM25."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.sources.store import written

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def postings(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, term, tf, len: one row for each document and term, counted inside the row: nothing is shuffled."""
    t = docs.select(key, F.sort_array(tokens(F.col(text))).alias("t"))
    # In sorted tokens a term stands from where it differs from the one before to where the next one begins.
    begin = F.filter(F.transform("t", lambda x, i: F.when(F.coalesce(x == F.get(F.col("t"), i - 1), F.lit(False)), None).otherwise(i)), lambda i: i.isNotNull())
    t = t.select(key, "t", F.size("t").alias("len"), begin.alias("b"))
    each = F.transform("b", lambda at, k: F.struct(F.get(F.col("t"), at).alias("term"), (F.coalesce(F.get(F.col("b"), k + 1), F.col("len")) - at).cast("long").alias("tf")))
    return t.select(key, "len", F.explode(each).alias("e")).select(key, "len", "e.term", "e.tf")


def query_terms(query: str) -> list[str]:
    """Ordered, distinct terms of more than one character."""
    import re

    return list(dict.fromkeys(w for w in re.findall(r"\w+", query.lower()) if len(w) > 1))


def bm25(docs: DataFrame, terms: list[str], every: bool = False, key: str = "path", text: str = "text") -> DataFrame:
    """key, score of documents with some (or every) term; the score is negative, lower is better.

    One scan counts tokens and looks up the few terms inside each row, so no token is ever shuffled; the corpus figures
    are one small aggregate.
    """
    t = docs.select(key, tokens(F.col(text)).alias("t"))
    t = t.select(key, F.size("t").alias("len"), *(F.size(F.filter("t", _is(w))).alias(f"tf{i}") for i, w in enumerate(terms)))
    figures = t.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hits = t.filter(" and ".join(f"tf{i} > 0" for i in range(len(terms))) if every else " or ".join(f"tf{i} > 0" for i in range(len(terms))))
    j = hits.crossJoin(F.broadcast(figures))  # one row of figures
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}")
        score = score - idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return j.select(key, score.alias("score"))


def _is(word: str):
    return lambda x: x == word


def phrase(docs: DataFrame, words: list[str], key: str = "path", text: str = "text") -> DataFrame:
    """Documents with the words one after the other."""
    return docs.filter(F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" ")).contains(" " + " ".join(words) + " ")).select(key)


def ranked(df: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    """Ranks of a bounded candidate list (the rows that a limit has left)."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by)))


def rrf(first: DataFrame, second: DataFrame, key: str = "path", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (key, rank)."""
    both = first.select(key, "rank").unionByName(second.select(key, "rank"))
    return both.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 10).alias("score"))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Queries of a block, vectors of a chunk.
BLOCK, CHUNK = 1000, 16384


def _packed(vectors: DataFrame, name: str, rows: int) -> DataFrame:
    """ids, name: vectors packed by so many rows; a null vector has no distance and is left out."""

    def pack(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        flat = part.column(1).combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0).combine_chunks()), pa.array([flat.tobytes()], pa.binary())], [f"{name}_ids", name])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + len(b)
            if n >= rows:
                x = pa.Table.from_batches(held)
                yield from (pack(x.slice(i, rows)) for i in range(0, n - n % rows, rows))
                held, n = x.slice(n - n % rows).to_batches(), n % rows
        if n:
            yield pack(pa.Table.from_batches(held))

    v = vectors.filter("embedding is not null").select("vec_id", "embedding")
    return v.mapInArrow(run, f"{name}_ids array<{v.schema['vec_id'].dataType.simpleString()}>, {name} binary")


def few(df: DataFrame) -> DataFrame:
    """df in twice as many partitions as tasks can run at once, at most; nothing is moved.

    A task that meets all queries gives each its k best, so what tasks give grows with the queries and not with the rows.
    """
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, distance, rank of the k nearest vectors of each query; any number of queries.

    Blocks of queries meet chunks of vectors inside Arrow batches.  A task keeps the k best that it has seen for each
    query and gives them when it ends.
    """
    from pyspark.sql import Window

    def run(batches):
        seen, ids = {}, Ids()
        for b in batches:
            for at in range(len(b)):
                q_ids, v_ids = (b.column(c)[at].values for c in ("q_ids", "v_ids"))
                q, v = (np.frombuffer(b.column(c)[at].as_py(), np.float64).reshape(n, -1) for c, n in (("q", len(q_ids)), ("v", len(v_ids))))
                no = b.column("q_no")[at].as_py()
                if no not in seen:
                    seen[no] = q_ids, Best(len(q_ids), k, ids)
                best = seen[no][1]
                chunk = ids.add(b.column("v_no")[at].as_py(), v_ids)
                qq, vv = (q * q).sum(1), (v * v).sum(1)
                # Cosines in single precision say what may be near enough: rounding and their error are less than ``slack``.
                slack = 2e-6 + 2.4e-7 * (q.shape[1] + 4)
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    unit, asking = (np.float32(x / np.sqrt(xx)[:, None]) for x, xx in ((v, vv), (q, qq)))
                    for i, x in ((i + j, x) for i in range(0, len(q), 64) for j, x in enumerate(asking[i : i + 64] @ unit.T)):
                        some = np.flatnonzero(x >= np.float32(1 - best.limit(i) - slack))
                        if len(some) > 4 * k:
                            some = some[x[some] >= -np.partition(-x[some], k - 1)[k - 1] - np.float32(slack)]
                        if len(some):
                            best.add(i, chunk, some, np.round(1 - v[some] @ q[i] / np.sqrt(qq[i] * vv[some]), 6) + 0.0)
        for q_ids, best in seen.values():
            yield from best.listed(q_ids, ["query_id", "vec_id", "distance"])

    # Packed queries are written, so that they are not made anew for each part of the vectors.
    asked = written(queries.sparkSession, _packed(queries, "q", BLOCK)).withColumn("q_no", F.monotonically_increasing_id())
    pairs = few(_packed(vectors, "v", CHUNK).withColumn("v_no", F.monotonically_increasing_id())).crossJoin(asked)
    kind = lambda df: df.schema["vec_id"].dataType.simpleString()
    d = pairs.mapInArrow(run, f"query_id {kind(queries)}, vec_id {kind(vectors)}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Ids:
    """The ids of the chunks that a task has seen, each chunk's once, and their order."""

    def __init__(self) -> None:
        self.known, self.arrays, self.ranks = {}, [], []

    def add(self, key, ids: pa.Array) -> int:
        """The number of a chunk."""
        if key not in self.known:
            self.known[key] = len(self.arrays)
            self.arrays.append(ids)
            self.ranks.append(None)
        return self.known[key]

    def rank(self, chunk: int) -> np.ndarray:
        if self.ranks[chunk] is None:
            order = pc.sort_indices(self.arrays[chunk], null_placement="at_start").to_numpy()
            self.ranks[chunk] = np.empty(len(order), np.int64)
            self.ranks[chunk][order] = np.arange(len(order))
        return self.ranks[chunk]

    def take(self, places: np.ndarray) -> list:
        return [self.arrays[p >> 32][p & 0xFFFFFFFF].as_py() for p in places.tolist()]


class Best:
    """The k best rows, least value first, then least id, that a task has seen for each query of a block."""

    def __init__(self, queries: int, k: int, ids: Ids) -> None:
        self.k, self.ids = k, ids
        self.values, self.places, self.n = np.full((queries, k), np.inf), np.zeros((queries, k), np.int64), np.zeros(queries, np.int64)

    def limit(self, i: int) -> float:
        """The value that a row of query i must not be above."""
        return self.values[i, -1]

    def add(self, i: int, chunk: int, rows: np.ndarray, values: np.ndarray) -> None:
        """Rows of a chunk with their values."""
        k, n = self.k, self.n[i]
        good = values <= self.limit(i)
        rows, values = rows[good], values[good]
        if len(values) > k:
            good = values <= np.partition(values, k - 1)[k - 1]
            rows, values = rows[good], values[good]
            if len(values) > k:
                order = np.lexsort((self.ids.rank(chunk)[rows], values))[:k]
                rows, values = rows[order], values[order]
        if not len(values):
            return
        values = np.concatenate([self.values[i, :n], values])
        places = np.concatenate([self.places[i, :n], rows.astype(np.int64) | chunk << 32])
        order = np.argsort(values, kind="stable")
        if len(values) > k and values[order[k - 1]] == values[order[k]]:
            # Of those that tie with the last one, the least ids stay.
            tied = np.flatnonzero(values == values[order[k - 1]])
            least = sorted(zip(((x is not None, x) for x in self.ids.take(places[tied])), tied.tolist(), strict=True))
            before = order[: np.count_nonzero(values < values[order[k - 1]])]
            order = np.concatenate([before, [t for _, t in least]]).astype(np.int64)
        order = order[:k]
        self.n[i] = len(order)
        self.values[i, : len(order)], self.places[i, : len(order)] = values[order], places[order]

    def listed(self, queries: pa.Array, names: list[str], rows: int = 1 << 16):
        """query, row, value of what was kept, in batches."""
        own = np.repeat(np.arange(len(self.n)), self.n)
        there = np.arange(self.k) < self.n[:, None]
        values, places = self.values[there], self.places[there]
        if not len(values):
            return
        starts = np.cumsum([0, *(len(a) for a in self.ids.arrays)])
        ids = pa.chunked_array(self.ids.arrays)
        for i in range(0, len(values), rows):
            at = places[i : i + rows]
            found = ids.take(pa.array(starts[at >> 32] + (at & 0xFFFFFFFF)))
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(own[i : i + rows])), pa.concat_arrays(found.chunks), pa.array(values[i : i + rows])], names)


def length_metrics(turns: DataFrame) -> DataFrame:
    """role, n, median and p95 of the text lengths of each role.

    Rows are counted by length first, so running sums over a role's distinct lengths find the places; a null text has a
    place after all lengths for p95 and none for the median.
    """
    from pyspark.sql import Window

    role = Window.partitionBy("role")
    up = role.orderBy(F.col("len").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = turns.select("role", F.length("text").cast("long").alias("len")).groupBy("role", "len").agg(F.count("*").alias("m"))
    c = c.select("role", "len", "m", F.sum("m").over(up).alias("upto"), F.sum("m").over(role).alias("n"), F.coalesce(F.sum(F.when(F.col("len").isNotNull(), F.col("m"))).over(role), F.lit(0)).alias("known"))
    at = lambda place: F.min(F.when(F.col("upto") > F.expr(place), F.col("len")))
    return c.groupBy("role").agg(F.first("n").alias("n"), ((at("(known - 1) div 2") + at("known div 2")) / 2).alias("median"), at("95 * (n - 1) div 100").alias("p95"))
