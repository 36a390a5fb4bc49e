"""Mixing sources to target weights over fixed-length blocks of words.

The documents of a source, in a pseudorandom order, form one stream of words that is cut into blocks of ``block`` words.
Every source gets slots for its target.  The output has a power of two of shards; how many of its slots a source has in
each shard is a multinomial draw, made by halving: a node of the tree over the shards deals its slots to its halves by a
binomial draw from a seed of its own.  So any task draws any range of shards from the source's row alone, and the totals
are exact.  The j-th slot of a source takes the block at a pseudorandom permutation of its index (a Feistel network
walked until it stays in range), another permutation for each pass over the source; slots and blocks are joined by
index.  A source whose target is at most three times its size is passed over three times at most, so no block is taken
more often.

Sources are a table: targets are found by raising one number, the words for a unit of weight, until no source is above
its limit, each time by one sum over that table.  The driver sees single numbers and one row for each partition of the
sources.  Offsets in a stream are two levels of sums, over stretches of about the square root of the source's rows, so no
task meets a whole source.

Defined results: a null text has size 0 and is never taken; a null source is a source and comes last; rows that repeat
a doc_id are separate rows; an empty table gives an empty result.  Equal input and seed give equal results, however the
input is split: row numbers only tell rows of one doc_id and equal text apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.common import _SPACES, keyed, mix, octets, pieces, settle, tidy

#: Words of a block; weights of the sources in the order of their names, repeating; passes over a source.
BLOCK, WEIGHTS, PASSES = 64, (5.0, 2.0, 1.0), 3
#: Slots of an output shard, about, and shards at least; slots of a source that one task draws, about.
SHARD_SLOTS, SHARDS, DRAWN = 100_000, 64, 100_000


def word_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where words begin."""
    inside = ~_SPACES[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    rows = at[:-1][at[:-1] < len(raw)]
    start[rows] = inside[rows]
    return start


def sizes(d: DataFrame) -> DataFrame:
    """doc_id, _id, _row, _tie (hash of the text), source, size (words) of keyed rows with their source."""

    def run(batches):
        for b in batches:
            raw, at = octets(b.column("text"))
            n = []
            for i, j in pieces(at):
                up = np.concatenate([[0], np.cumsum(word_starts(raw[at[i] : at[j]], at[i : j + 1] - at[i]))])
                n.append(up[at[i + 1 : j + 1] - at[i]] - up[at[i:j] - at[i]])
            names = ("doc_id", "_id", "_row", "_tie", "source")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.concatenate(n) if n else [], pa.int64())], [*names, "size"])

    own = d.select(F.col("doc_id").cast("long"), "_id", "_row", F.xxhash64("text").alias("_tie"), F.col("_all.source").cast("string").alias("source"), "text")
    return own.mapInArrow(tidy(run), "doc_id long, _id long, _row long, _tie long, source string, size long")


def with_targets(sources: DataFrame, passes: float = PASSES) -> DataFrame:
    """sources (source_size, weight) with their target: shares of the whole by weight; none above ``passes`` times its
    size, what is above is shared again by weight until none is above."""
    limit = passes * F.col("source_size")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    unit = -1.0
    while True:
        full = F.col("weight") * unit > limit
        got = sources.agg(F.sum(F.when(~full, F.col("weight"))).alias("free"), F.sum(F.when(full, limit)).alias("used")).first()
        more = (total - (got["used"] or 0.0)) / got["free"] if got["free"] else unit
        if more <= unit:
            return sources.withColumn("target", F.when(full, limit).otherwise(F.col("weight") * unit).cast("double"))
        unit = more


def _seeded(*parts: int) -> np.random.Generator:
    return np.random.default_rng([p & 0xFFFFFFFFFFFFFFFF for p in parts])


def draw(slots: int, bits: int, depth: int, prefix: int, *seed: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, slots) of the shards whose number of ``bits`` bits begins with the ``depth`` bits of prefix."""

    def halves(n: int, level: int, node: int) -> int:
        return int(_seeded(*seed, level, node).binomial(n, 0.5))

    first, n = 0, slots
    for level in range(depth):
        node = prefix >> (depth - level)
        left = halves(n, level, node)
        if prefix >> (depth - level - 1) & 1:
            first, n = first + left, n - left
        else:
            n = left
    out, todo = [], [(depth, prefix, first, n)]
    while todo:
        level, node, first, n = todo.pop()
        if not n:
            continue
        if level == bits:
            out.append((node, first, n))
            continue
        left = halves(n, level, node)
        todo += [(level + 1, 2 * node + 1, first + left, n - left), (level + 1, 2 * node, first, left)]
    return out


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each index i < n under the pseudorandom permutation of range(n) that key names."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64))
    low = (np.uint64(1) << bits) - np.uint64(1)
    out = i.astype(np.uint64)
    todo = np.arange(len(out))
    limit, salt = n.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        left, right = out[todo] >> bits[todo], out[todo] & low[todo]
        for r in range(4):
            left, right = right, left ^ (mix(right + salt[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & low[todo])
        out[todo] = left << bits[todo] | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def planned(sized: DataFrame, weights: tuple[float, ...], block: int) -> DataFrame:
    """_s (place by code point, null last), source, source_size, target, stretches, blocks, slots of each source."""
    ordered = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # One row for each partition of the sources, so few enough to collect and to send.
    counts = sorted(tuple(r) for r in ordered.groupBy(part.alias("p")).count().collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    offsets = ordered.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part long, _before long")
    place = F.col("_before") + F.col("_at") - F.shiftleft(part, 33)
    ranked = ordered.join(F.broadcast(offsets), part == F.col("_part")).select(place.alias("_s"), "source", "source_size", "rows")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_s") % len(weights) + 1).cast("int"))
    aimed = with_targets(settle(ranked.withColumn("weight", weight)))
    blocks = F.ceil(F.col("source_size") / block)
    slots = F.when(F.col("source_size") > 0, F.least(PASSES * blocks, F.round(F.col("target") * blocks / F.col("source_size")).cast("long"))).otherwise(F.lit(0).cast("long"))
    return settle(aimed.select("_s", "source", "source_size", "target", F.greatest(F.lit(1), F.round(F.sqrt("rows"))).cast("int").alias("stretches"), blocks.alias("blocks"), slots.alias("slots")))


def drawn(plan: DataFrame, seed: int) -> DataFrame:
    """_s, shard, block, pass of every slot of the mix."""
    slots = int(plan.agg(F.sum("slots")).first()[0] or 0)
    bits = (max(SHARDS, -(-slots // SHARD_SLOTS)) - 1).bit_length()
    depth = F.least(F.lit(bits), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("slots") / DRAWN)))).cast("int")
    ranges = plan.filter("slots > 0").select("_s", "slots", "blocks", depth.alias("depth"))
    ranges = ranges.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.col("depth")).cast("long") - 1)).alias("prefix"))
    ranges = ranges.repartition(min(4096, max(8, -(-slots // DRAWN))))

    def deal(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                rows += [(r["_s"], r["blocks"], *d) for d in draw(r["slots"], bits, r["depth"], r["prefix"], seed, r["_s"])]
            names = ("_s", "blocks", "shard", "first", "n")
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(5)], names)

    def take(batches):
        for b in batches:
            s, j, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_s", "j", "blocks"))
            key = s * 1_000_003 + (j // n) * 7_919 + seed
            yield pa.RecordBatch.from_arrays([b.column("_s"), b.column("shard"), pa.array(permuted(j % n, n, key)), pa.array((j // n).astype(np.int32))], ["_s", "shard", "block", "pass"])

    counts = ranges.mapInArrow(tidy(deal), "_s long, blocks long, shard long, first long, n long")
    each = counts.select("_s", "blocks", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"))
    return each.mapInArrow(tidy(take), "_s long, shard long, block long, pass int")


def _of_source(rows: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
    """rows joined with columns of their source's plan; a null source is a source."""
    key = lambda d: (d["source"].isNull(), F.coalesce(d["source"], F.lit("")))
    (a, b), (x, y) = key(rows), key(plan)
    return rows.join(plan, (a == x) & (b == y)).drop(plan["source"]).select(*rows.columns, *columns)


def mixed(keyed_docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized, plan, spans): rows with their sizes; the sources; _row, shard, pass, first word, words taken there."""
    sized = settle(sizes(keyed_docs))
    plan = planned(sized, weights, block)
    known = _of_source(sized.select("source", "_row", "_id", "_tie", "size").filter("size > 0"), plan, "_s", "stretches").withColumn("stretch", F.pmod(F.xxhash64("_id", "_tie", F.lit(seed)), F.col("stretches")))
    sums = known.groupBy("_s", "stretch").agg(F.sum("size").alias("n"))
    before = sums.select("_s", "stretch", (F.sum("n").over(Window.partitionBy("_s").orderBy("stretch")) - F.col("n")).alias("base"))
    inner = F.sum("size").over(Window.partitionBy("_s", "stretch").orderBy("_id", "_tie", "_row")) - F.col("size")
    placed = known.select("*", inner.alias("inner")).join(before, ["_s", "stretch"]).select("_s", "_row", "size", (F.col("base") + F.col("inner")).alias("at"))
    cut = placed.select("*", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    begin, end = F.greatest("at", F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    parts = cut.select("_s", "block", "_row", (begin - F.col("at")).alias("first"), (end - begin).alias("n"))
    # The optimiser takes the slots for as small as the rows they are made from; a merge join keeps them from being broadcast.
    spans = parts.join(drawn(plan, seed).hint("merge"), ["_s", "block"]).select("_row", "shard", "pass", "first", "n")
    return sized, plan, spans


def mix_report(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs."""
    sized, plan, spans = mixed(keyed(docs.select("doc_id", "text", "source"), keep=True), weights, block, seed)
    taken = spans.groupBy("_row").agg(F.sum("n").alias("taken"))
    out = _of_source(sized.select("doc_id", "_row", "size", "source"), plan, "source_size", "target")
    return out.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_texts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of docs: one row for each row of docs and pass, its text cut to the blocks taken.

    Stretches of words that are not neighbours are joined by a line break; n_chars, where docs has it, follows the text.
    """
    d = keyed(docs, keep=True)
    _, _, spans = mixed(d, weights, block, seed)
    wanted = spans.groupBy("_row", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("spans"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    joined = d.select("_row", "doc_id", "text", F.struct(*(F.col("_all").getField(c).alias(c) for c in others)).alias("_rest")).join(wanted, "_row").select("doc_id", "text", "_rest", "spans")

    def run(batches):
        for b in batches:
            raw, at = octets(b.column("text"))
            texts = []
            for i, spans_of in enumerate(b.column("spans").to_pylist()):
                own = raw[at[i] : at[i + 1]]
                begin = np.flatnonzero(word_starts(own, np.array([0, len(own)])))
                data, out, last = own.tobytes(), [], None
                for s in spans_of:
                    a, z = s["first"], s["first"] + s["n"]
                    if last is not None and last[1] == a:
                        last[1] = z
                    else:
                        out.append(last := [a, z])
                texts.append("\n".join(data[begin[a] : begin[z] if z < len(begin) else len(data)].decode().strip(" \t\n\x0b\f\r") if (a, z) != (0, len(begin)) else data.decode() for a, z in out))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("_rest")], ["doc_id", "text", "_rest"])

    out = joined.select("doc_id", "text", "_rest").schema
    cut = joined.mapInArrow(tidy(run), out)
    return cut.select(*((F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c)) for c in docs.columns))
