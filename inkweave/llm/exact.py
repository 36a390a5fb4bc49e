"""Exact duplicates by composable polynomial fingerprints.

A text without its white space is cut into chunks; each chunk has a polynomial hash modulo two primes, and the hash of
two neighbours is ``left * base**len(right) + right``, so chunks of a huge text can be hashed apart and joined in any
bracketing: texts of more than ``HUGE`` bytes are, over all tasks.  Texts with equal fingerprints are then compared chunk
by chunk with the first row of their group; texts that differ form a group of their own and go round again, so a
collision never merges different texts.

Only rows of groups move with their text, and a group is never gathered: each member's chunk meets the one chunk of its
group's first row in an equi-join that adaptive execution can split.

Defined results: null and empty texts are equal; of equal texts the longest original (in code points) stays, then the
smallest doc_id, then one of the repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import _SPACES, NO_ID, keyed, octets, settle

PRIMES = (2147483647, 2147483629)
BASE = 1000003
#: Bytes of a chunk; sums of byte * power stay below 2**64.
CHUNK = 1 << 16
#: Bytes from which on the chunks of one text are hashed in parallel.
HUGE = 1 << 22


def powers(prime: int, n: int = CHUNK) -> np.ndarray:
    """base**0 .. base**(n-1) modulo prime."""
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * BASE % prime
    return out


def chunk_hash(chunk: np.ndarray, table: np.ndarray, prime: int) -> int:
    return int((chunk.astype(np.uint64) * table[: len(chunk)][::-1]).sum() % np.uint64(prime))


def combine(left: int, right: int, right_length: int, prime: int) -> int:
    """The hash of two neighbouring stretches."""
    return (left * pow(BASE, right_length, prime) + right) % prime


def fingerprint(data: np.ndarray, tables: list[np.ndarray], primes: tuple[int, ...] = PRIMES) -> int:
    """Both hashes in one number."""
    out = 0
    for prime, t in zip(primes, tables, strict=True):
        h = 0
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK]
            h = combine(h, chunk_hash(part, t, prime), len(part), prime)
        out = out << 31 | h
    return out


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


_FIGURES = "_row long, _id long, n_points long, n_bytes long, fingerprint long, text_sha256 string"


def _small(docs: DataFrame, primes: tuple[int, ...]) -> DataFrame:
    """The figures of each row, its chunks hashed one after the other."""

    def run(batches):
        tables = [powers(p) for p in primes]
        for b in batches:
            raw, at = octets(b.column("text"))
            points, size, prints, shas = [], [], [], []
            for i in range(len(b)):
                own = raw[at[i] : at[i + 1]]
                points.append(_points(own))
                data = own[~_SPACES[own]]
                size.append(len(data))
                prints.append(fingerprint(data, tables, primes))
                shas.append(hashlib.sha256(data).hexdigest())
            yield _batch({"_row": b.column("_row"), "_id": b.column("_id"), "n_points": pa.array(points, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "fingerprint": pa.array(prints, pa.int64()), "text_sha256": pa.array(shas, pa.string())})

    return docs.select("_row", "_id", "text").mapInArrow(run, _FIGURES)


def _huge(docs: DataFrame, primes: tuple[int, ...], chunk: int) -> DataFrame:
    """The same figures of texts whose chunks are hashed apart, wherever the shuffle deals them, and then combined."""

    def cut(batches):
        for b in batches:
            raw, at = octets(b.column("text"))
            for i in range(len(b)):
                own = raw[at[i] : at[i + 1]]
                sha = hashlib.sha256(own[~_SPACES[own]]).hexdigest()
                for k, first in enumerate(range(0, len(own), chunk)):
                    yield _batch({"_row": b.column("_row").slice(i, 1), "_id": b.column("_id").slice(i, 1), "k": pa.array([k], pa.int64()), "part": pa.array([own[first : first + chunk].tobytes()], pa.binary()), "sha": pa.array([sha if not k else None], pa.string())})

    def hashed(batches):
        tables = [powers(p) for p in primes]
        for b in batches:
            rows = []
            for part in b.column("part"):
                own = np.frombuffer(part.as_buffer(), np.uint8)
                data = own[~_SPACES[own]]
                rows.append((_points(own), len(data), *(v for p, t in zip(primes, tables, strict=True) for v in (chunk_hash(data, t, p), pow(BASE, len(data), p)))))
            names = ("points", "n", "h1", "s1", "h2", "s2")
            yield _batch({c: b.column(c) for c in ("_row", "_id", "k", "sha")} | {c: pa.array([r[j] for r in rows], pa.int64()) for j, c in enumerate(names)})

    parts = docs.select("_row", "_id", "text").mapInArrow(cut, "_row long, _id long, k long, part binary, sha string")
    hashes = parts.repartition("_row", "k").mapInArrow(hashed, "_row long, _id long, k long, sha string, points long, n long, h1 long, s1 long, h2 long, s2 long")
    # One entry for each chunk of one text; hashes stay below 2**31, so the products stay below 2**62.
    lists = hashes.groupBy("_row").agg(F.min("_id").alias("_id"), F.sum("points").alias("n_points"), F.sum("n").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("k", "h1", "s1", "h2", "s2"))).alias("l"), F.max("sha").alias("text_sha256"))
    whole = lambda h, s, p: F.aggregate("l", F.lit(0).cast("long"), lambda a, e: (a * e[s] + e[h]) % F.lit(p))
    return lists.select("_row", "_id", "n_points", "n_bytes", (F.shiftleft(whole("h1", "s1", primes[0]), 31).bitwiseOR(whole("h2", "s2", primes[1]))).alias("fingerprint"), "text_sha256")


def fingerprints(docs: DataFrame, primes: tuple[int, ...] = PRIMES, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """_row, _id, n_points, n_bytes, fingerprint and text_sha256 of each keyed row; the last three of the text without spaces.

    How a text is cut does not change its fingerprint; texts of more than ``huge`` bytes have their chunks hashed in parallel.
    """
    long = F.octet_length("text") > huge
    return _small(docs.filter(~long), primes).unionByName(_huge(docs.filter(long), primes, chunk))


def _chunks(rows: DataFrame) -> DataFrame:
    """n_bytes, fingerprint, _row, _id, chunk number and bytes of texts without spaces, streamed chunk by chunk."""

    def run(batches):
        for b in batches:
            raw, at = octets(b.column("text"))
            for i in range(len(b)):
                data = raw[at[i] : at[i + 1]]
                data = data[~_SPACES[data]].tobytes()
                parts = [data[k : k + CHUNK] for k in range(0, len(data), CHUNK)] or [b""]
                same = {c: pa.array([b.column(c)[i].as_py()] * len(parts), pa.int64()) for c in ("n_bytes", "fingerprint", "_row", "_id")}
                yield _batch(same | {"chunk": pa.array(range(len(parts)), pa.int64()), "part": pa.array(parts, pa.binary())})

    return rows.select("n_bytes", "fingerprint", "_row", "_id", "text").mapInArrow(run, "n_bytes long, fingerprint long, _row long, _id long, chunk long, part binary")


def exact_groups(docs: DataFrame, primes: tuple[int, ...] = PRIMES, huge: int = HUGE) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.  primes: smaller ones force collisions."""
    docs = keyed(docs)
    prints = settle(fingerprints(docs, primes, huge))
    key = ["n_bytes", "fingerprint"]
    # Grouped figures are written before they are joined, so that a join may split the rows of a large group.
    groups = settle(prints.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key))
    members = prints.join(groups, key, "left_semi").select("_row", *key)
    left = settle(_chunks(docs.join(members, "_row")))
    classes, number, open_rows = None, 0, None
    while True:
        first = left.groupBy(*key).agg(F.min(F.struct("_id", "_row")).alias("f")).select(*key, F.col("f._row").alias("_row"))
        first_parts = settle(left.join(first, [*key, "_row"], "left_semi").select(*key, "chunk", F.col("part").alias("first_part")))
        same = left.join(first_parts, [*key, "chunk"]).select("_row", (F.col("part") == F.col("first_part")).alias("same"))
        differ = settle(same.groupBy("_row").agg(F.min("same").alias("same")).filter("not same").select("_row"))
        n = differ.count()
        if not n:
            break
        if open_rows is not None and n >= open_rows:
            raise RuntimeError("rows that differ from the first of their group must become fewer")  # each group loses its first row
        number, open_rows = number + 1, n
        later = differ.select("_row", F.lit(number).alias("class"))
        classes = later if classes is None else classes.unionByName(later)
        left = left.join(differ, "_row", "left_semi")
    if classes is None:
        prints = prints.withColumn("class", F.lit(0))
    else:
        prints = prints.join(classes.groupBy("_row").agg(F.max("class").alias("class")), "_row", "left").fillna(0, ["class"])
    stays = settle(prints.groupBy(*key, "class").agg(F.min(F.struct((-F.col("n_points")).alias("n"), "_id", "_row")).alias("keep"), F.count("*").alias("group_size")))
    known = lambda c: F.when(c != NO_ID, c)
    return prints.join(stays, [*key, "class"]).select(known(F.col("_id")).alias("doc_id"), known(F.col("keep._id")).alias("keep_id"), "group_size", (F.col("_row") == F.col("keep._row")).alias("kept"), "text_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
     g AS (SELECT s, count(*) AS group_size, arg_min((doc_id, r), (-length(t), coalesce(doc_id, 9223372036854775807), r)) AS keep FROM d GROUP BY s)
SELECT doc_id, keep[1] AS keep_id, group_size, r = keep[2] AS kept, sha256(s) AS text_sha256 FROM d JOIN g USING (s)
"""
