"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact confirmation, components.

1. Each text becomes the set of its word shingles (64-bit hashes).  Texts with equal sets are one class, found by two
   sums of hashes with partial aggregation, and only one row of the class goes on: copies are never expanded.
2. The set's minima under ``hashes`` multiply-shift functions form its signature; bands of ``rows`` minima are keys.
3. Every class of a key is compared with two centres of the key, its least row and a pseudorandom one.  A pair whose
   signatures agree far too little for the threshold is dropped (the chance to drop a true pair is about 1e-8); the
   others are confirmed on full sets.
4. Components of the confirmed links.  Components that share a key which still holds several of them form a family.
   In each family the classes outside its largest component are compared with all others on full sets, in tiles of
   ``TILE`` by ``TILE``: a tile multiplies membership matrices and returns only a spanning star of each group that it
   finds linked, so no list of pairs is ever made.  Every two texts that share a key thus end up compared or connected.
5. Components of the components that the tiles linked.

Defined results: rows are linked one by one, also those that repeat a doc_id or have none; component_id is the smallest
doc_id of the component (null if no row of it has one); texts without words have an empty set and are linked with
nothing; kept compares the two ids, so of repeated rows several can be kept, while ``stays`` is true of one row of each
component only: that with the smallest doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import NO_ID, keyed, mix, octets, pieces, settle, tidy, words
from inkweave.llm.components import components

#: Texts on each side of a tile.
TILE = 256


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and their offsets."""
    h, w = words(raw, at, lower=True)
    n = np.diff(w)
    row = np.repeat(np.arange(len(n)), n)
    left = w[row + 1] - np.arange(len(h))  # words from here to the text's end
    full = np.flatnonzero(left >= k)
    s = np.full(len(full), 0x243F6A8885A308D3, np.uint64)
    for i in range(k):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[full + i])
    owner = row[full]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        t = np.full(len(short), 0x13198A2E03707344, np.uint64)
        for i in range(k - 1):
            more = n[short] > i
            t[more] = mix(t[more] * np.uint64(0x9E3779B97F4A7C15) + h[w[short[more]] + i])
        s, owner = np.concatenate([s, t]), np.concatenate([owner, short])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(len(n) + 1))


def functions_of(hashes: int) -> np.ndarray:
    """Odd multipliers and addends of the universal functions (x * a + b) >> 32."""
    r = np.random.default_rng(20240229).integers(0, 2**63, (2, hashes), dtype=np.uint64)
    r[0] = r[0] * np.uint64(2) + np.uint64(1)
    return r


def signatures(s: np.ndarray, at: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """The minima of each set with members, one row each (uint32)."""
    starts = at[:-1][at[:-1] < at[1:]]
    out = np.empty((len(starts), functions.shape[1]), np.uint32)
    for j in range(functions.shape[1]):
        out[:, j] = np.minimum.reduceat(((s * functions[0, j] + functions[1, j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _sketch(docs: DataFrame, k: int, rows: int, bands: int, hashes: int) -> DataFrame:
    functions = functions_of(hashes)

    def run(batches):
        for b in batches:
            raw, at = octets(b.column("text"))
            for i, j in pieces(at):
                s, o = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], k)
                n = np.diff(o)
                some = n > 0
                sig = signatures(s, o, functions)
                total = np.concatenate([[np.uint64(0)], np.cumsum(s)])
                other = np.concatenate([[np.uint64(0)], np.cumsum(mix(s + np.uint64(1)))])
                key = np.full((len(sig), bands), 0x452821E638D01377, np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r : rows * bands : rows].astype(np.uint64))
                at_some = np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(at_some * bands), pa.array(key.reshape(-1).view(np.int64)))
                blobs, flat = [None] * len(n), (sig >> np.uint32(8)).astype(np.uint8).tobytes()
                for x, y in zip(np.flatnonzero(some), range(len(sig)), strict=True):
                    blobs[x] = flat[y * hashes : (y + 1) * hashes]
                yield _batch({"_row": b.column("_row").slice(i, j - i), "_id": b.column("_id").slice(i, j - i), "n": pa.array(n, pa.int64()), "fa": pa.array((total[o[1:]] - total[o[:-1]]).view(np.int64)), "fb": pa.array((other[o[1:]] - other[o[:-1]]).view(np.int64)), "keys": keys, "sig": pa.array(blobs, pa.binary())})

    return docs.select("_row", "_id", "text").mapInArrow(tidy(run), "_row long, _id long, n long, fa long, fb long, keys array<long>, sig binary")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, members: signature and shingle hashes of the wanted rows (node, sig)."""

    def run(batches):
        for b in batches:
            raw, at = octets(b.column("text"))
            for i, j in pieces(at):
                s, o = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], k)
                yield _batch({"node": b.column("node").slice(i, j - i), "members": pa.array([b.column("sig")[i + x].as_py() + s[o[x] : o[x + 1]].tobytes() for x in range(j - i)], pa.binary())})

    return docs.join(wanted, docs["_row"] == wanted["node"]).select("node", "sig", "text").mapInArrow(tidy(run), "node long, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hashes: int, least: int) -> DataFrame:
    """The pairs whose signatures agree in ``least`` places and that have 100 * intersection >= percent * union.

    a is the centre of many pairs: its set is joined last, and does not move again.
    """
    one = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}"))

    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                if np.count_nonzero(np.frombuffer(x, np.uint8, hashes) == np.frombuffer(y, np.uint8, hashes)) < least:
                    good.append(False)
                    continue
                together = np.sort(np.concatenate([np.frombuffer(x, np.uint64, -1, hashes), np.frombuffer(y, np.uint64, -1, hashes)]), kind="stable")
                common = int(np.count_nonzero(together[1:] == together[:-1]))
                good.append(100 * common >= percent * (len(together) - common))
            good = pa.array(good, pa.bool_())
            yield _batch({c: b.column(c).filter(good) for c in ("a", "b")})

    return pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), "a long, b long")


def linked_stars(x: list[np.ndarray], y: list[np.ndarray], apart: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning stars of the links between sets x and sets y; places of y count on from len(x).  apart: pairs to look at."""
    n = np.array([len(s) for s in (*x, *y)])
    owner = np.repeat(np.arange(len(n)), n)
    _, column, often = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    several = often > 1
    number = np.cumsum(several) - 1
    use = several[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(x), len(y)), np.float32)
    for first in range(0, int(several.sum()), 4096):
        low, high = np.searchsorted(column, [first, first + 4096])
        m = np.zeros((len(n), 4096), np.float32)
        m[owner[low:high], column[low:high] - first] = 1
        common += m[: len(x)] @ m[len(x) :].T
    union = n[: len(x), None] + n[None, len(x) :] - common
    link = apart & (100 * common >= percent * union)
    out: list[tuple[int, int]] = []
    left, right = np.ones(len(x), bool), np.ones(len(y), bool)
    for i in np.flatnonzero(link.any(axis=1)):
        if not left[i]:
            continue
        left[i] = False
        front = np.array([i])
        while len(front):
            found = np.flatnonzero(link[front].any(axis=0) & right)
            right[found] = False
            front = np.flatnonzero(link[:, found].any(axis=1) & left)
            left[front] = False
            out += [(i, len(x) + j) for j in found] + [(i, j) for j in front]
    return out


def _in_tiles(keys: DataFrame, sets: DataFrame, percent: int, hashes: int) -> DataFrame:
    """a, b: enough of the linked components inside each family of components that open keys (key, node, component, lo) chain."""
    families = components(keys.select("lo", "component"), "lo", "component").select(F.col("node").alias("component"), F.col("component").alias("family"))
    placed = settle(keys.select("node", "component").distinct().join(settle(families), "component"))
    sizes = placed.groupBy("family", "component").agg(F.count("*").alias("size")).groupBy("family").agg(F.max(F.struct("size", "component")).alias("m"), F.sum("size").alias("all"))
    sizes = settle(sizes.select("family", F.col("m.component").alias("main"), F.ceil(F.col("all") / TILE).alias("tiles"), F.ceil((F.col("all") - F.col("m.size")) / TILE).alias("outer_tiles")))
    full = placed.join(sizes, "family").join(sets, "node")
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    fields = ("node", "component", "main", "members")
    member = full.select("family", spot("tiles").alias("t"), every("outer_tiles").alias("o"), *fields)
    outer = full.filter("component <> main").select("family", every("tiles").alias("t"), spot("outer_tiles").alias("o"), *fields).toDF("family", "t", "o", *fields)  # fresh columns: both sides come from one frame

    def run(outers: pa.Table, members: pa.Table) -> pa.Table:
        x, y = ([np.frombuffer(v.as_buffer(), np.uint64, -1, hashes) for v in t.column("members")] for t in (outers, members))
        pairs: set[tuple[int, int]] = set()
        if x and y:
            (xn, xc, _), (yn, yc, main) = (tuple(t.column(c).to_numpy() for c in ("node", "component", "main")) for t in (outers, members))
            apart = (xc[:, None] != yc[None, :]) & ((yc == main)[None, :] | (xn[:, None] > yn[None, :]))
            of = np.concatenate([xc, yc])
            pairs = {(int(of[i]), int(of[j])) for i, j in linked_stars(x, y, apart, percent) if of[i] != of[j]}
        return pa.table({c: pa.array([p[k] for p in pairs], pa.int64()) for k, c in enumerate(("a", "b"))})

    tile = ("family", "t", "o")
    return outer.groupBy(*tile).cogroup(member.groupBy(*tile)).applyInArrow(run, "a long, b long")


def labelled(docs: DataFrame, k: int, percent: int, rows: int, bands: int, hashes: int) -> DataFrame:
    """_row, _id, n (set size), least (_id and _row of the component's first row; null for empty sets) of each keyed row."""
    p = percent / 100
    least = math.floor(p * hashes - 5.5 * math.sqrt(p * (1 - p) * hashes))
    sketches = settle(_sketch(docs, k, rows, bands, hashes))
    # Grouped figures are written before they are joined, so that a join may split the rows of a large group.
    of_set = ("n", "fa", "fb")
    nodes = settle(sketches.filter("n > 0").groupBy(*of_set).agg(F.min("_row").alias("node"), F.min(F.struct("_id", "_row")).alias("least"), F.min_by(F.struct("keys", "sig"), "_row").alias("s")).select(*of_set, "node", "least", "s.keys", "s.sig"))
    by_key = nodes.select("node", F.explode("keys").alias("key"))
    far = F.min_by("node", F.xxhash64("node"))
    centers = settle(by_key.groupBy("key").agg(F.min("node").alias("a"), far.alias("c"), F.count("*").alias("size")).filter("size > 1").select("key", "a", F.when(F.col("size") > 2, F.col("c")).otherwise(F.col("a")).alias("c")))
    shared = settle(by_key.join(centers, "key"))
    wanted = nodes.select("node", "sig").join(shared.select("node").distinct(), "node", "left_semi")
    sets = settle(_full_sets(docs, wanted, k))
    pairs = shared.select(F.explode(F.array("a", "c")).alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    found = settle(components(settle(_confirmed(pairs, sets, percent, hashes, least))))
    placed = settle(shared.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    several = settle(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key", "lo"))
    roots = nodes.select(*of_set, "node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if several.count():
        tiled = settle(_in_tiles(settle(placed.join(several, "key")), sets, percent, hashes))
        joined = settle(components(tiled).select(F.col("node").alias("component"), F.col("component").alias("root")))
        roots = roots.join(joined, "component", "left").withColumn("component", F.coalesce("root", "component"))
    roots = settle(roots.select(*of_set, "component", "least"))
    first = settle(roots.groupBy("component").agg(F.min("least").alias("least")))
    of_class = settle(roots.select(*of_set, "component").join(first, "component").select(*of_set, "least"))
    return sketches.select("_row", "_id", *of_set).join(of_class, [*of_set], "left").select("_row", "_id", "n", "least")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 4, bands: int = 28, hashes: int = 256) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, stays.

    At 4 rows, 28 bands find a pair at similarity 0.8 but for a chance of 4e-7, and 20 bands one at 0.85.
    """
    known = lambda c: F.when(c != NO_ID, c)
    out = labelled(keyed(docs), k, percent, rows, bands, hashes)
    out = out.select("_row", "least", known(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.coalesce("least._id", "_id")).alias("component_id"))
    stays = F.coalesce(F.col("least._row") == F.col("_row"), F.lit(True))
    same = F.when(F.col("component_id").isNull(), stays).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.select("doc_id", "n_shingles", "component_id", same.alias("kept"), stays.alias("stays"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 4, bands: int = 28, hashes: int = 256) -> DataFrame:
    """The rows of docs, with every column, without those whose component has a row that comes first."""
    d = keyed(docs, keep=True)
    gone = labelled(d, k, percent, rows, bands, hashes).filter("least._row <> _row").select("_row")
    return d.join(gone, "_row", "left_anti").select(*(F.col("_all").getField(c).alias(c) for c in docs.columns))


#: The rows of op4_minhash (3-word shingles, similarity 0.85) by DuckDB: all pairs that share a shingle, and what they reach.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT r, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda j: w[j:j + 2]) WHEN len(w) > 0 THEN [w] ELSE [] END)) AS g FROM d),
n AS (SELECT r, len(g)::BIGINT AS n FROM s),
m AS (SELECT g, min(r) AS c FROM s WHERE len(g) > 0 GROUP BY g),
e AS (SELECT c AS r, unnest(g) AS x FROM m),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT c, c FROM m UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
root AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a),
placed AS (SELECT s.r, root FROM s JOIN m USING (g) JOIN root USING (c)),
least AS (SELECT root, min(doc_id) AS first, arg_min(r, (coalesce(doc_id, 9223372036854775807), r)) AS stay FROM placed JOIN d USING (r) GROUP BY root),
o AS (SELECT doc_id, n, CASE WHEN root IS NULL THEN doc_id ELSE first END AS component_id, root IS NULL OR r = stay AS stays FROM d JOIN n USING (r) LEFT JOIN placed USING (r) LEFT JOIN least USING (root))
SELECT doc_id, n AS n_shingles, component_id, CASE WHEN component_id IS NULL THEN stays ELSE coalesce(doc_id = component_id, false) END AS kept, stays FROM o
"""
