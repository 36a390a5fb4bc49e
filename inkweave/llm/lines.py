"""Line deduplication by winnowing over line hashes.  DataFrame functions only.

Among the lines of a text that are not blank, a gram is one line of ``GRAM_WORDS`` words or two neighbours, and a window
is the shortest run of lines from each line on that has ``WORDS`` words or ``LINES`` lines.  Of the grams inside a window
the one with the least MD5 is its fingerprint (of equals the last).  Windows depend on their lines alone, so two equal
runs of ``WORDS`` words or ``LINES`` lines always select the same fingerprints at the same places; only those move.

A fingerprint's first place is that with the least (doc_id, line).  Its first place in each later document is joined with
it, and each further place in a document with the one before it.  A joined pair of places aligns two texts, and the match
is extended both ways along them for as long as lines are equal.  A run of equal lines with ``WORDS`` words or ``LINES``
lines is deleted from the later place.  A fingerprint whose first place has other surroundings finds a match too short to
delete; other fingerprints of the run then have to find it.

With ``whole`` (the query and the pipeline) nothing is left out.  A fingerprint that occurs twice leads to the runs it was
picked in: of each line the shortest run of ``WORDS`` words or ``LINES`` lines that begins with it, and the shortest that
ends with it.  Runs with one fingerprint and the same lines (64-bit hashes of hashes) are equal; each but those of the
first document goes, and those that repeat in a document.  Every line of a longer equal run is in one of these.

Extension compares 64-bit hashes of lines at aligned places only, so a wrong line needs one given hash, not any two equal
ones among all lines.  A first place is found by a grouped minimum, never by pairs; texts move once, to lose their lines.

Defined results: null and empty texts have no lines to delete; a null doc_id comes last; rows that repeat a doc_id, or
have none, do not count against each other; blank lines stay; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.common import keyed, settle

LINES, WORDS, GRAM_WORDS = 3, 50, 25
#: A character that is not white space.
FULL = r"[^\x20\x09-\x0D]"


def _apart(d: DataFrame, keep: tuple[str, ...], **columns: Column) -> DataFrame:
    """d with columns that are computed once a row.

    Exploded from an array of one, they are not copied into the lambdas that use them, where each element would compute
    them anew.
    """
    row = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return d.select(*keep, row.alias("_one")).select(*keep, "_one.*")


def _grams(d: DataFrame, whole: bool = False) -> DataFrame:
    """_row, _id, h and c (hash and words of each line that is not blank), picks: the places and MD5 of the fingerprints;
    runs where the whole is asked for."""
    key = ("_row", "_id")
    d = _apart(d, key, l=F.filter(F.split("text", "\n"), lambda x: x.rlike(FULL))).filter(F.size("l") > 0)
    d = _apart(d, (*key, "l"), h=F.transform("l", lambda x: F.xxhash64(x)), c=F.transform("l", lambda x: F.regexp_count(x, F.lit(FULL + "+"))))
    at = lambda a, i: F.get(F.col(a), i)
    two = lambda x, i: F.md5(F.concat(x, F.lit("\n"), at("l", i + 1)).cast("binary"))
    gram = lambda x, i: F.struct(F.when(at("c", i) >= GRAM_WORDS, F.md5(x.cast("binary"))).otherwise(two(x, i)).alias("g"), F.when(at("c", i) >= GRAM_WORDS, 1).otherwise(2).alias("m"))
    window = lambda x, i: F.when(x >= WORDS, 1).when(x + at("c", i + 1) >= WORDS, 2).when(at("c", i + 2).isNotNull(), LINES)
    d = _apart(d, (*key, "h", "c"), g=F.transform("l", gram), w=F.transform("c", window))

    def inside(w: Column, i: Column, j: int) -> Column:
        """The gram at i + j, where it ends inside the window of w lines at i."""
        return F.when(at("g", i + j)["m"] + j <= w, F.struct(at("g", i + j)["g"].alias("g"), (-(i + j)).alias("p")))

    # Distinct places, which are numbers, and not distinct structs, which would be compared with each other one by one.
    d = _apart(d, (*key, "h", "c", "g", "w"), at=F.transform("w", lambda w, i: -F.array_min(F.array(*(inside(w, i, j) for j in range(LINES))))["p"]))
    d = _apart(d, (*key, "h", "c", "g", "w", "at"), places=F.array_distinct(F.filter("at", lambda p: p.isNotNull())))
    picks = F.transform("places", lambda p: F.struct(at("g", p)["g"].alias("g"), p.alias("p")))
    return d.select(*key, "h", "c", picks.alias("picks"), *([_runs().alias("runs")] if whole else []))


def _runs() -> Column:
    """g, x, p, n: the fingerprint, hash, place and number of lines of each run that is shortest from its first or to its last line."""
    at = lambda a, i: F.get(F.col(a), i)
    # The shortest run to line j has so many lines.
    back = lambda j: F.when(at("c", j) >= WORDS, 1).when(at("c", j) + at("c", j - 1) >= WORDS, 2).otherwise(LINES)
    here = lambda w, i, n: F.when((i + n <= F.size("h")) & ((w == n) | (back(i + n - 1) == n)), n)
    run = lambda i, n: F.struct(at("g", at("at", i))["g"].alias("g"), F.xxhash64(F.slice("h", i + 1, n)).alias("x"), i.alias("p"), n.alias("n"))
    sizes = F.flatten(F.transform("w", lambda w, i: F.transform(F.filter(F.array(*(here(w, i, n) for n in range(1, LINES + 1))), lambda n: n.isNotNull()), lambda n: run(i, n))))
    return F.filter(sizes, lambda r: r["g"].isNotNull())


def _matched(aligned: DataFrame) -> DataFrame:
    """_row, places: the places of h that lie in long enough runs of lines equal to those of h0, ``delta`` places before, of deltas."""

    def along(delta: Column) -> Column:
        differ = F.filter(F.transform("h", lambda x, i: F.when(F.coalesce(x == F.get(F.col("h0"), i - delta), F.lit(False)), None).otherwise(i)), lambda i: i.isNotNull())
        return F.concat(F.array(F.lit(-1)), differ, F.array(F.size("h")))

    # Equal lines are what stands between two neighbouring ends.
    d = aligned.select("_row", "h", "h0", "c", F.explode("deltas").alias("delta"))
    d = _apart(d, ("_row", "c"), ends=along(F.col("delta")))
    d = _apart(d, ("_row", "c"), runs=F.transform("ends", lambda b, k: F.struct((b + 1).alias("s"), F.coalesce(F.get(F.col("ends"), k + 1) - b - 1, F.lit(0)).alias("n"))))
    enough = F.filter("runs", lambda r: (r["n"] >= LINES) | ((r["n"] > 0) & (F.aggregate(F.slice("c", r["s"] + 1, r["n"]), F.lit(0), lambda a, x: a + x) >= WORDS)))
    return d.select("_row", F.flatten(F.transform(enough, lambda r: F.sequence(r["s"], r["s"] + r["n"] - 1))).alias("places")).filter(F.size("places") > 0)


def repeated_lines(d: DataFrame, whole: bool = False) -> DataFrame:
    """_row, gone: the places (from 0, among the lines that are not blank) of the lines to delete, for keyed rows that have some."""
    grams = settle(_grams(d, whole))
    picked = grams.select("_row", "_id", F.explode("picks").alias("e")).select("_row", "_id", F.unhex("e.g").alias("g"), "e.p")
    # Grouped figures are written before they are joined, so that a join may split the places of a common fingerprint.
    firsts = settle(picked.groupBy("g").agg(F.min(F.struct("_id", "_row", "p")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("g", "first"))
    if whole:
        return _equal(grams, firsts).groupBy("_row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("gone"))
    # Places of one fingerprint in one document; none holds more than the document's lines.
    own = Window.partitionBy("_row", "g").orderBy("p")
    placed = picked.join(firsts, "g").withColumn("last", F.lag("p").over(own)).filter("last is not null or first._id < _id")
    inner = F.col("last").isNotNull()
    pairs = placed.select("_row", F.when(inner, F.col("_row")).otherwise(F.col("first._row")).alias("other"), (F.col("p") - F.coalesce("last", "first.p")).alias("delta"))
    pairs = pairs.groupBy("_row", "other").agg(F.collect_set("delta").alias("deltas"))
    texts = grams.select("_row", "h", "c")
    aligned = pairs.join(texts, "_row").join(grams.select(F.col("_row").alias("other"), F.col("h").alias("h0")), "other")
    return _matched(aligned).groupBy("_row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("gone"))


def _equal(grams: DataFrame, firsts: DataFrame) -> DataFrame:
    """_row, places of the lines of every run that also stands in an earlier document, or before in its own."""
    runs = grams.select("_row", "_id", F.explode("runs").alias("r")).select("_row", "_id", F.unhex("r.g").alias("g"), "r.x", "r.p", "r.n")
    runs = settle(runs.join(firsts.select("g"), "g", "left_semi"))
    first = settle(runs.groupBy("g", "x").agg(F.min("_id").alias("first"), F.count("*").alias("m")).filter("m > 1").select("g", "x", "first"))
    before = F.row_number().over(Window.partitionBy("_row", "g", "x").orderBy("p")) > 1
    gone = runs.join(first, ["g", "x"]).withColumn("before", before).filter("before or first < _id")
    return gone.select("_row", F.expr("sequence(p, p + n - 1)").alias("places"))


def dedup_lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Every row and column of docs, its text without the repeated lines; added: n_lines, n_removed.

    whole: all runs that stand earlier, not only those that a fingerprint's first place shows.
    """
    d = keyed(docs, keep=True)
    out = d.join(repeated_lines(d, whole), "_row", "left")
    kept = ("_all", "text", "gone")
    out = _apart(out, kept, ls=F.split("text", "\n"))
    out = _apart(out, (*kept, "ls"), f=F.when(F.col("gone").isNotNull(), F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(FULL), i)), lambda i: i.isNotNull())))
    # What is kept stands between two neighbouring deleted lines.
    out = _apart(out, (*kept, "ls"), ends=F.concat(F.array(F.lit(-1)), F.transform("gone", lambda p: F.get(F.col("f"), p)), F.array(F.size("ls"))))
    left = F.flatten(F.transform("ends", lambda b, k: F.slice("ls", b + 2, F.coalesce(F.get(F.col("ends"), k + 1) - b - 1, F.lit(0)))))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    same = (text.alias(c) if c == "text" else F.col("_all").getField(c).alias(c) for c in docs.columns)
    return out.select(*same, F.size("ls").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of each row."""
    return dedup_lines(docs.select("doc_id", "text"), whole=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT r, id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM d),
     f AS (SELECT r, id, x, i, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS p, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS c FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
     a AS (SELECT r, id, p, x, c, lead(x) OVER o AS x1, lead(c) OVER o AS c1, lead(c, 2) OVER o AS c2 FROM f WINDOW o AS (PARTITION BY r ORDER BY p)),
     m AS (SELECT r, id, p, CASE WHEN c >= 25 THEN 1 ELSE 2 END AS m, CASE WHEN c >= 25 THEN md5(x) ELSE md5(x || chr(10) || x1) END AS g,
                  CASE WHEN c >= 50 THEN 1 WHEN c + c1 >= 50 THEN 2 WHEN c2 IS NOT NULL THEN 3 END AS w FROM a),
     s AS (SELECT *, lead(g) OVER o AS g1, lead(m) OVER o AS m1, lead(g, 2) OVER o AS g2, lead(m, 2) OVER o AS m2 FROM m WINDOW o AS (PARTITION BY r ORDER BY p)),
     u AS (SELECT r, id, p, p AS q, g FROM s WHERE m <= w UNION ALL SELECT r, id, p, p + 1, g1 FROM s WHERE 1 + m1 <= w UNION ALL SELECT r, id, p, p + 2, g2 FROM s WHERE 2 + m2 <= w),
     k AS (SELECT DISTINCT r, id, arg_min(g, (g, -q)) AS g, arg_min(q, (g, -q)) AS q FROM u GROUP BY r, id, p),
     v AS (SELECT g, min(id) AS id0, arg_min(r, (id, r, q)) AS r0, arg_min(q, (id, r, q)) AS q0 FROM k GROUP BY g HAVING count(*) > 1),
     b AS (SELECT r, id, g, q, lag(q) OVER (PARTITION BY r, g ORDER BY q) AS q1 FROM k),
     c AS (SELECT DISTINCT r, CASE WHEN q1 IS NULL THEN r0 ELSE r END AS r0, q - coalesce(q1, q0) AS delta FROM b JOIN v USING (g) WHERE q1 IS NOT NULL OR id0 < id),
     e AS (SELECT c.r, c.r0, c.delta, x.p, x.i, x.c, x.p - row_number() OVER (PARTITION BY c.r, c.r0, c.delta ORDER BY x.p) AS island
           FROM c JOIN f x ON x.r = c.r JOIN f y ON y.r = c.r0 AND y.p = x.p - c.delta AND y.x = x.x),
     t AS (SELECT r, r0, delta, island FROM e GROUP BY ALL HAVING count(*) >= 3 OR sum(c) >= 50),
     g AS (SELECT DISTINCT r, i FROM e JOIN t USING (r, r0, delta, island)),
     kept AS (SELECT l.r, string_agg(x, chr(10) ORDER BY l.i) AS kept FROM l ANTI JOIN g ON l.r = g.r AND l.i = g.i GROUP BY l.r),
     n AS (SELECT r, count(*) AS n FROM g GROUP BY r)
SELECT doc_id, len(ls) AS n_lines, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""
