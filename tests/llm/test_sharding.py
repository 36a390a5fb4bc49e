"""Shards against a brute-force version."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from inkweave.llm import sharding

SCHEMA = "doc_id long, text string, source string, shard int, slot string, size int, law int, _h int, _at int"
LONG = "a very long text " * 40_000


def rows_of(n):
    """A third of all rows from one source, copies, nulls, repeated ids and an own source for some rows."""
    out = [(i, f"text {i % 7}" if i % 3 else f"hot {i}", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(n)]
    return [*out, (None, None, None), (None, "", None), (5, "text 5", "s5"), (5, "text 5", "s5"), (6, "ünï 🙂", "alone"), (7, LONG, "hot"), *[(9, "same", "hot")] * 60]


def brute(rows, shards=sharding.SHARDS, seed=sharding.SEED):
    """(doc_id, size, crc, shard, slot) of each row, by lists."""
    own = defaultdict(list)
    for i, t, s in rows:
        raw = (t or "").encode()
        size, crc = len(raw) + 8, zlib.crc32(raw)
        h = int(hashlib.md5("|".join(str(x) for x in (seed, i, crc, size) if x is not None).encode()).hexdigest()[:15], 16)
        own[s].append((h, i is None, i or 0, size, crc, i))
    order = []
    for place, s in enumerate(sorted(own, key=lambda s: (s is not None, (s or "").encode()))):
        for rank, r in enumerate(sorted(own[s], key=lambda r: r[:5])):
            order.append(((2 * rank + 1) / (2 * len(own[s])), place, rank, r))
    order.sort(key=lambda x: x[:3])
    out = []
    for p, (*_, (_, _, _, size, crc, i)) in enumerate(order):
        k = p * shards // len(order)
        out.append((i, size, crc, k, p - -(-k * len(order) // shards)))
    return Counter(out)


@pytest.mark.parametrize("n", [0, 5, 500])
def test_report_equals_brute_force(spark, n):
    rows = rows_of(n)
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], SCHEMA).repartition(5)
    got = sharding.report(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == brute(rows)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    held = Counter(r.shard for r in got)
    assert max(held.values()) - min(held[k] for k in range(24)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(held[k])) for k in range(24))


def test_every_shard_matches_the_mixture(spark):
    rows = [r for r in rows_of(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = sharding.shard(docs).collect()
    whole, each = Counter(r.source for r in out), Counter((r.source, r.shard) for r in out)
    assert all(abs(each[s, k] - n / 24) <= 1 + n * len(whole) / sum(whole.values()) for s, n in whole.items() for k in range(24))


def test_shard_keeps_rows_and_report_agrees(spark):
    rows = [(*r, 1, "x", 2, 3, 4, 5) for r in rows_of(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = sharding.shard(docs)
    assert set(out.columns) == set(docs.columns)
    assert Counter((r.doc_id, r.text, r.source, r.law) for r in out.collect()) == Counter((i, t, s, w) for i, t, s, _, _, _, w, _, _ in rows)
    assert Counter((r.doc_id, r.shard, r.slot) for r in out.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in sharding.report(docs).collect())


def test_written_shards_are_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 3}") for i in range(100)], "doc_id long, text string, source string").repartition(4)
    sharding.write_shards(docs, f"{tmp_path}/out", shards=4, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 100 and back.groupBy("shard").count().filter("count = 25").count() == 4
    assert {r.shard: r["max(slot)"] for r in back.groupBy("shard").max("slot").collect()} == dict.fromkeys(range(4), 24)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sharding.report(none).count() == 0 and sharding.shard(none).count() == 0


def test_sql_agrees(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame(rows_of(60), "doc_id long, text string, source string")
    docs.repartition(3).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = Counter(con.execute(f"SELECT doc_id, size, text_crc32, shard, slot FROM ({sharding.ORACLE_SQL})").fetchall())
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.report(docs).collect()) == want
