"""Shards that all match the mixture: proportional stratified interleaving.

Within each source, rows are put into a seeded pseudorandom order and ranked; a row's fractional rank is the middle of its
place, (rank + 1/2) / rows of the source.  Sorted by fractional rank the sources interleave in proportion, so any stretch
of that order has nearly the mixture of the whole, and cutting it into runs whose lengths differ by one at most gives the
shards (the law ``rows``).  Of each shard a source has its share, give or take one row and its share of one row a source.

Ranks and places are counts before a row in a global order.  ``numbered`` gets them from Spark's range-partitioned sort and
one row for each task of it, so a source that holds most rows is dealt over tasks like any other, and no window meets a
whole source.  Only short rows (id, source, size, checksum) are sorted, never texts.

Defined results: a null text has no bytes and checksum 0; a null source is a source of its own; a null doc_id counts as
the largest; rows that repeat doc_id, text and source are separate rows, which may change places with one another, so
equal input gives equal results however it is split; other columns are ignored by ``report`` and kept by ``shard``, but
for those named shard or slot; an empty table gives an empty result; more shards than rows leaves some shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import keyed, settle

SHARDS, SEED = 24, 41
#: Bytes that a row counts besides its text.
OVERHEAD = 8


def numbered(rows: DataFrame, place: str, *order) -> tuple[DataFrame, int]:
    """rows with ``place``, the number of rows before each in the order given, which must be total; and their number."""
    ordered = settle(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    # One row for each task of the sort.
    counts = sorted(tuple(r) for r in ordered.groupBy(part.alias("p")).count().collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = ordered.sparkSession.createDataFrame(before, "_part long, _before long")
    out = ordered.join(F.broadcast(offsets), part == F.col("_part"))
    return out.withColumn(place, F.col("_before") + F.col("_m") - F.shiftleft(part, 33)).drop("_m", "_part", "_before"), total


def measured(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, source, size, text_crc32 and the columns ``keys`` of each row of docs."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + F.lit(OVERHEAD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.crc32(text).alias("text_crc32"), *keys)


def interleaved(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Measured rows with shard and slot.  A ``_row`` among their columns tells equal rows apart, else their place does."""
    if "_row" not in rows.columns:
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
    digest = F.md5(F.concat_ws("|", F.lit(seed), "doc_id", "text_crc32", "size"))
    rows = settle(rows.withColumn("_h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")))
    rank, total = numbered(rows, "_rank", F.col("source").asc_nulls_first(), "_h", F.col("doc_id").asc_nulls_last(), "size", "text_crc32", "_row")
    sources = rank.groupBy(F.col("source").alias("_source")).agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    # A source with most rows is no hot key here: each source has one row on the other side, so Spark may split its rows.
    known = rank.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    fraction = (2 * (F.col("_rank") - F.col("_first")) + 1).cast("double") / (2 * F.col("_n")).cast("double")
    placed, _ = numbered(known.withColumn("_f", fraction), "_at", "_f", "_first", "_rank")
    shard = F.expr(f"_at * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_at") - first.cast("long")).drop("_h", "_rank", "_source", "_first", "_n", "_f", "_at")


def report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs."""
    out = interleaved(measured(docs), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of docs with the columns shard and slot."""
    d = keyed(docs, keep=True)
    given = interleaved(measured(d.select("doc_id", "text", F.col("_all.source").alias("source"), "_row"), "_row"), shards, seed)
    rest = [F.col("_all").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return d.select("_row", "_all").join(given.select("_row", "shard", "slot"), "_row").select(*rest, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, files: int = 1) -> None:
    """Writes each shard as a folder ``shard=n`` of Parquet files, whose rows are in the order of their slots.

    files: files of a shard, at least about; a shard of a large corpus needs more than one.
    """
    sharded = shard(docs, shards, seed)
    sharded.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


#: A checksum in SQL goes byte by byte; the table and the polynomial are those of CRC-32.
ORACLE_SQL = f"""WITH tab AS (SELECT list(v ORDER BY c) AS tab FROM (SELECT c, list_reduce(list_concat([c::UBIGINT], range(8)::UBIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) t(c))),
  byte AS (SELECT row_number() OVER () AS r, doc_id, source, strlen(coalesce(text, '')) + {OVERHEAD} AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS b FROM documents),
  m AS (SELECT r, doc_id, source, size, xor(list_reduce(list_concat([4294967295::UBIGINT], b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM byte, tab),
  h AS (SELECT *, ('0x' || substr(md5(concat_ws('|', {SEED}, doc_id, text_crc32, size)), 1, 15))::BIGINT AS h FROM m),
  k AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, h, doc_id NULLS LAST, size, text_crc32, r) - 1 AS pos FROM h),
  s AS (SELECT *, min(pos) OVER (PARTITION BY source) AS lo, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM k),
  p AS (SELECT *, row_number() OVER (ORDER BY (2 * (pos - lo) + 1)::DOUBLE / (2 * n)::DOUBLE, lo, pos) - 1 AS place FROM s)
  SELECT doc_id, size, text_crc32, 'rows' AS law, (place * {SHARDS} // total)::INT AS shard, place - (place * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard FROM p"""
