"""Registered queries of the kept index: words, phrases, prefixes, nearness, fields, upserts, batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.functions.words import words
from inkweave.operators import inverted as I
from inkweave.operators.chunkstore import Chunks
from inkweave.operators import text as T
from inkweave.operators.snippets import snippets
from inkweave.operators.text import tokens
from inkweave.operators.vectorindex import VectorIndex, recall
from inkweave.plans.catalogue import query
from inkweave.sources.store import folder

TT = "tt AS (SELECT path, regexp_extract_all(lower(concat_ws(' ', lang, source)), '[a-z0-9]+') AS a, regexp_extract_all(lower(text), '[a-z0-9]+') AS b FROM file)"
#: u0, u1 ...: occurrences of each unit in path's text; len: tokens that count.
SCORE = "SELECT path, round(-({score}), 6) AS score FROM f, fig WHERE {where}"



def bm25_sql(units: list[str], where: str, length: str = "coalesce(len(a), 0) + coalesce(len(b), 0)") -> str:
    """units: SQL for the number of occurrences of each."""
    cols = ", ".join(f"coalesce({u}, 0) AS u{i}" for i, u in enumerate(units))
    df = ", ".join(f"count(*) FILTER (WHERE u{i} > 0) AS df{i}" for i in range(len(units)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * u{i} * 2.2 / (u{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(units)))
    return f"{TT}, f AS (SELECT path, {length} AS len, {cols} FROM tt), fig AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM f), hit AS ({SCORE.format(score=score, where=where)})"


def _times(w: str, t: str = "b") -> str:
    return f"len(list_filter({t}, lambda x: x = '{w}'))"


def _phrase(*words: str, t: str = "b") -> str:
    here = " AND ".join(f"{t}[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"len(list_filter(range(1, len({t}) + 1), lambda i: {here}))"


@query("""WITH tt AS (SELECT path, regexp_extract_all(lower(concat_ws(' ', lang, source)), '[a-z0-9]+') AS a, regexp_extract_all(lower(text), '[a-z0-9]+') AS b FROM file),
    e AS (SELECT path, a[i] AS term, 't' AS field, i - 1 AS p FROM (SELECT path, a, unnest(range(1, len(a) + 1)) AS i FROM tt) UNION ALL SELECT path, b[i], 'x', i - 1 FROM (SELECT path, b, unnest(range(1, len(b) + 1)) AS i FROM tt))
    SELECT path, term, count(*) AS tf, coalesce(sum(p) FILTER (WHERE field = 't'), 0)::BIGINT AS title_places, coalesce(sum(p) FILTER (WHERE field = 'x'), 0)::BIGINT AS text_places, coalesce(min(p) FILTER (WHERE field = 'x'), -1) AS first_place FROM e GROUP BY 1, 2""")
def index_postings(g):
    """All postings of the kept index, with sums of their places in each field."""
    p = g.index.postings()
    own = F.filter("places", lambda x: x >= I.FIELD)
    add = lambda a, x: a + x
    return p.select("path", "term", "tf", F.aggregate(F.filter("places", lambda x: x < I.FIELD), F.lit(0).cast("long"), add).alias("title_places"), F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x - I.FIELD).alias("text_places"), F.coalesce(F.get(own, 0) - I.FIELD, F.lit(-1).cast("long")).alias("first_place"))


@query(f"WITH {bm25_sql([_times('license') + ' + ' + _times('license', 'a'), _times('src7') + ' + ' + _times('src7', 'a'), _times('the') + ' + ' + _times('the', 'a')], 'u0 > 0 OR u1 > 0')} SELECT path, score FROM (SELECT path, round(-(greatest(ln((n - df0 + 0.5) / (df0 + 0.5)), 1e-6) * u0 * 2.2 / (u0 + 1.2 * (0.25 + 0.75 * len / mean)) + greatest(ln((n - df1 + 0.5) / (df1 + 0.5)), 1e-6) * u1 * 2.2 / (u1 + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM f, fig WHERE (u0 > 0 OR u1 > 0) AND u2 = 0)")
def index_any_without(g):
    """Title and text together: one word or another, and not a third; all hits."""
    return g.index.search(some=[I.word("license"), I.word("src7")], none=[I.word("the")]).select("path", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_sql([_phrase('all', 'rights', 'reserved'), _times('license')], 'u0 > 0 OR u1 > 0')} SELECT * FROM hit")
def index_phrase_or_word(g):
    return g.index.search(some=[I.phrase("all", "rights", "reserved"), I.word("license")]).select("path", F.round("score", 6).alias("score"))


@query(f"""WITH {bm25_sql(["len(list_filter(b, lambda x: starts_with(x, 'lic'))) + len(list_filter(a, lambda x: starts_with(x, 'lic')))"], 'u0 > 0')} SELECT * FROM hit""")
def index_prefix(g):
    return g.index.search(every=[I.prefix("lic")]).select("path", F.round("score", 6).alias("score"))


@query(f"""WITH {bm25_sql(["len(list_filter(range(1, len(b) + 1), lambda i: b[i] = 'under' AND (list_contains(b[greatest(1, i - 4):i - 1], 'license') OR list_contains(b[i + 1:i + 4], 'license'))))"], 'u0 > 0')} SELECT * FROM hit""")
def index_near(g):
    """Two words with three others between them at most."""
    return g.index.search(every=[I.near("under", "license", 3)]).select("path", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_sql([_times('en', 'a'), _times('src3', 'a')], 'u0 > 0 AND u1 > 0', 'len(a)')} SELECT * FROM hit")
def index_field(g):
    """Words of the title alone."""
    return g.index.search(every=[I.word("en"), I.word("src3")], fields=["title"]).select("path", F.round("score", 6).alias("score"))


QUESTIONS = "q AS (SELECT doc_id AS query_id, unnest(list_distinct(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 8))) AS term FROM file WHERE doc_id % 100 = 0)"
ANSWERS = f"""{TT}, {QUESTIONS}, len AS (SELECT path, coalesce(len(a), 0) + coalesce(len(b), 0) AS len FROM tt), fig AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
    w AS (SELECT path, unnest(list_concat(coalesce(a, []), coalesce(b, []))) AS term FROM tt), p AS (SELECT path, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT query_id, path, round(sum(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN p USING (term) JOIN d USING (term) JOIN len USING (path), fig {{allowed}} GROUP BY ALL)
    SELECT query_id, path, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, path) AS rank FROM s) WHERE rank <= 10"""


def questions(g) -> DataFrame:
    """The first words of every document whose id is divisible by 100, as questions."""
    first = F.array_distinct(F.slice(tokens(F.col("text")), 1, 8))
    return g.file.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(first).alias("term"))


@query("WITH " + ANSWERS.format(allowed=""))
def search_questions(g):
    """The ten best documents for each question: all questions against all documents, in one job."""
    return g.index.best(questions(g), 10)


@query("WITH " + ANSWERS.format(allowed="WHERE path IN (SELECT path FROM file WHERE status = 'ok')"))
def search_questions_allowed(g):
    """The same with ranks among the allowed documents only."""
    return g.index.best(questions(g), 10, g.file.filter("status = 'ok'"))


def word_index(g) -> I.Index:
    """The index of all texts by words of any alphabet without accents, with stems, built by the first query that asks for it."""
    index = I.Index(g.spark, folder(g.spark, g.sf_dir, "words"), cut=words, stemmed=True, by_term=False)
    return index if index.version() else index.upsert(g.file)


FOLDED = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*')"


@query(f"SELECT path, term, count(*) AS tf, min(p) AS first_place FROM (SELECT path, t[i] AS term, i - 1 AS p FROM (SELECT path, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT path, {FOLDED} AS t FROM file))) GROUP BY 1, 2")
def word_postings(g):
    """Postings of words of any alphabet, without case and accents."""
    return word_index(g).postings().select("path", "term", "tf", F.get("places", 0).alias("first_place"))


@query()
def word_stems(g):
    """Every distinct word of all texts with its stem (SQL has no stemmer here; tested against the full-text module's)."""
    return word_index(g).stems()


@query()
def search_questions_stemmed(g):
    """The ten best documents by stems for each question, all questions against all documents, in one job."""
    first = F.array_distinct(F.slice(words(F.col("text")), 1, 8))
    asked = g.file.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(first).alias("term"))
    return word_index(g).best(asked, 10, stemmed=True)


LOOKED_FOR = ("license", "version", "under", "permission")
SNIPPET = r"""wd AS (SELECT path, text, regexp_extract_all(text, '[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*') AS w, string_split_regex(text, '[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*') AS g FROM file),
    tk AS (SELECT path, i, len(w) AS n, strip_accents(lower(w[i])) AS t, i = 1 OR regexp_matches(g[i], '[.:][ \t\n\r]+$') AS s FROM (SELECT path, w, g, unnest(range(1, len(w) + 1)) AS i FROM wd)),
    sn0 AS (SELECT *, max(CASE WHEN s THEN i END) OVER (PARTITION BY path ORDER BY i) AS st FROM tk), h AS (SELECT * FROM sn0 WHERE t IN ({words})),
    c AS (SELECT path, n, i AS io, 0 AS kind, i AS p FROM h UNION ALL SELECT path, n, min(i), 1, st FROM h WHERE st < i AND n > 10 GROUP BY path, n, st),
    sc AS (SELECT c.path, c.n, io, kind, p, 999 * count(DISTINCT t) + count(*) + CASE WHEN kind = 0 THEN 0 WHEN p = 1 THEN 120 ELSE 100 END AS score, max(h.i) AS last FROM c JOIN h ON h.path = c.path AND h.i BETWEEN p AND p + 9 GROUP BY c.path, c.n, io, kind, p),
    bs AS (SELECT path, CASE WHEN kind = 1 THEN p ELSE greatest(1, least(p - (10 - (last + 1 - p)) // 2, n - 9)) END AS b FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, io, kind) AS r FROM sc) WHERE r = 1),
    sh AS (SELECT path, w, g, coalesce(b, 1) AS b, least(coalesce(b, 1) + 9, len(w)) AS e FROM wd LEFT JOIN bs USING (path)),
    sn AS (SELECT path, CASE WHEN len(w) = 0 THEN g[1] ELSE concat(CASE WHEN b > 1 THEN '...' ELSE g[1] END,
      array_to_string([CASE WHEN j > b THEN g[j] ELSE '' END || CASE WHEN strip_accents(lower(w[j])) IN ({words}) THEN '[' || w[j] || ']' ELSE w[j] END FOR j IN range(b, e + 1)], ''), CASE WHEN e < len(w) THEN '...' ELSE g[len(w) + 1] END) END AS snippet FROM sh)""".replace("{words}", ", ".join(f"'{w}'" for w in LOOKED_FOR))


@query(f"WITH {SNIPPET} SELECT path, snippet FROM sn")
def snippet(g):
    """The best stretch of every text for several words."""
    return snippets(g.file, [I.word(w) for w in LOOKED_FOR])


CHANGED = "c AS (SELECT path, CASE WHEN doc_id % 100 = 3 THEN concat('replaced words here ', text) ELSE text END AS text FROM file WHERE doc_id % 100 <> 5)"


@query(f"WITH {CHANGED}, w AS (SELECT path, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM c), l AS (SELECT path, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS len FROM c) SELECT path, term, count(*) AS tf, any_value(len) AS len, (SELECT count(*) FROM c) AS n, (SELECT sum(len) FROM l)::BIGINT AS total FROM w JOIN l USING (path) GROUP BY 1, 2")
def index_upsert(g):
    """The postings after an upsert that replaces a hundredth of the documents and drops another: those of a new build."""
    index = I.Index(g.spark, folder(g.spark, g.sf_dir, "index_upsert"))
    if not index.version():
        index.upsert(g.file)
    if index.version() == 1:
        index.upsert(g.file.filter("doc_id % 100 = 3").withColumn("text", F.concat(F.lit("replaced words here "), "text")), g.file.filter("doc_id % 100 = 5"))
    n, (total,) = index.counts()
    return index.postings().select("path", "term", "tf", F.get("lengths", 0).alias("len"), F.lit(n).cast("long").alias("n"), F.lit(total).cast("long").alias("total"))


# Chunks and hybrid search

CHUNK = "ch AS (SELECT concat(path, '#', i) AS id, path, i AS ordinal, substr(text, i * 600 + 1, 680) AS text FROM (SELECT path, text, unnest(range(0, CAST(ceil(length(text) / 600.0) AS BIGINT))) AS i FROM file))"
HYBRID = f"""{CHUNK}, ct AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM ch), q AS (SELECT doc_id AS query_id, list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 12) AS t FROM file WHERE doc_id % 100 = 0),
    cw AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(t) AS w FROM ct) GROUP BY 1, 2), qw AS (SELECT query_id, w, count(*) AS tf FROM (SELECT query_id, unnest(t) AS w FROM q) GROUP BY 1, 2),
    ck AS (SELECT id, CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % 64 AS k, sum(tf)::DOUBLE AS n FROM cw GROUP BY 1, 2), qk AS (SELECT query_id, CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % 64 AS k, sum(tf)::DOUBLE AS n FROM qw GROUP BY 1, 2),
    cz AS (SELECT id, sqrt(sum(n * n)) AS z FROM ck GROUP BY 1), qz AS (SELECT query_id, sqrt(sum(n * n)) AS z FROM qk GROUP BY 1),
    dist AS (SELECT query_id, id, round(1 - sum(ck.n * qk.n) / (any_value(cz.z) * any_value(qz.z)), 6) AS d FROM ck JOIN qk USING (k) JOIN cz USING (id) JOIN qz USING (query_id) GROUP BY 1, 2),
    l0 AS (SELECT query_id, id, 0 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM dist),
    len AS (SELECT id, len(t) AS len FROM ct), fig AS (SELECT count(*) AS n, avg(len) AS mean FROM len), df AS (SELECT w, count(*) AS df FROM cw GROUP BY 1),
    sc AS (SELECT query_id, id, round(sum(-greatest(ln((fig.n - df + 0.5) / (df + 0.5)), 1e-6) * cw.tf * 2.2 / (cw.tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS s FROM qw JOIN cw USING (w) JOIN df USING (w) JOIN len USING (id), fig GROUP BY 1, 2),
    l1 AS (SELECT query_id, id, 1 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY s, id) AS rank FROM sc),
    l AS (SELECT query_id, id, path, source AS title, age, leg, row_number() OVER (PARTITION BY query_id, leg ORDER BY rank) AS rank FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1) JOIN ch USING (id) JOIN file f USING (path) WHERE rank <= 200 AND {{allowed}}),
    fu AS (SELECT query_id, id, any_value(path) AS path, any_value(title) AS title, any_value(age) AS age, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS fused, coalesce(min(rank) FILTER (WHERE leg = 0), 1 << 30) AS v, coalesce(min(rank) FILTER (WHERE leg = 1), 1 << 30) AS w FROM l GROUP BY 1, 2),
    pl AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS candidates, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, v, w, id) AS first FROM fu),
    sr AS (SELECT p.query_id, p.path, ordinal, candidates, first, least(1.0::DOUBLE, len(list_intersect(list_distinct(regexp_extract_all(lower(concat(title, chr(10), ch.text)), '[a-z0-9]+')), list_distinct(q.t)))::DOUBLE / greatest(len(list_distinct(q.t)), 1) + least(0.05, 0.1 * pow(0.5, age / 60.0))) AS s FROM pl p JOIN ch USING (id) JOIN q USING (query_id) WHERE first <= 24),
    cp AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY s DESC, first) AS of_file FROM sr), tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first) AS place FROM cp WHERE of_file <= 3)
    SELECT query_id, path, ordinal, round(s, 4) AS score, place, candidates FROM tp WHERE place <= 8"""


def _stretches(text):
    """The chunks of functions.chunks.fixed_chunks as an array."""
    n = F.ceil(F.length(text) / 600).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(text, i * 600 + 1, F.lit(680)))).otherwise(F.array().cast("array<string>"))


def chunk_store(g) -> Chunks:
    """The chunks of all files, built by the first query of a session that asks for them."""
    store = Chunks(g.spark, folder(g.spark, g.sf_dir, "chunks"), _stretches)
    return store if store.latest().version else store.update(g.file)


def _answers(g, allowed=None):
    q = g.file.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(tokens(F.col("text")), 1, 12), " ").alias("text"))
    files = g.file.withColumn("title", F.col("source")).drop("text")
    return chunk_store(g).search(q, files, allowed).drop("text")


@query("WITH " + HYBRID.format(allowed="true"))
def hybrid_questions(g):
    """Hybrid search over chunks: the first words of every document whose id is divisible by 100, against all chunks, in one job."""
    return _answers(g)


@query("WITH " + HYBRID.format(allowed="f.status = 'ok' AND f.lang <> 'de'"))
def hybrid_questions_allowed(g):
    """The same where ranks count allowed files only."""
    return _answers(g, (F.col("status") == "ok") & (F.col("lang") != "de"))


@query(f"WITH {CHUNK.replace('FROM file)', 'FROM (SELECT path, CASE WHEN doc_id % 100 = 7 THEN substr(text, 1, 1000) ELSE text END AS text FROM file WHERE doc_id % 100 <> 9))')} SELECT path, ordinal, text FROM ch")
def chunk_replace(g):
    """The chunk table after a hundredth of the files is cut short and another goes: that of a new build."""
    store = Chunks(g.spark, folder(g.spark, g.sf_dir, "chunk_replace"), _stretches, buckets=16)
    if not store.latest().version:
        store.update(g.file)
    if store.latest().version == 1:
        store.update(g.file.filter("doc_id % 100 = 7").withColumn("text", F.substring("text", 1, 1000)), g.file.filter("doc_id % 100 = 9"))
    return store.chunks().select("path", "ordinal", "text")


# An approximate vector index

#: Clusters, and clusters that a query looks into: most of them, since the given vectors have hardly any clusters.
CLUSTERS, PROBES = 24, 19


def _vector_index(g):
    return VectorIndex.build(g.table("embeddings"), f"{folder(g.spark, g.sf_dir, 'vectors')}/by_cluster", CLUSTERS)


@query()
def knn_index(g):
    """The ten nearest vectors, about, of every vector whose id is divisible by 100, from the index over all vectors."""
    return _vector_index(g).search(g.table("embeddings").filter("vec_id % 100 = 0"), 10, PROBES)


@query("SELECT count(*) AS queries, true AS good FROM embeddings WHERE vec_id % 100 = 0")
def knn_index_recall(g):
    """Whether the index finds nine tenths or more of what the exact search over all vectors finds."""
    v = g.table("embeddings")
    asked = v.filter("vec_id % 100 = 0")
    return recall(_vector_index(g).search(asked, 10, PROBES), T.knn(v, asked, 10)).select("queries", (F.col("recall") >= 0.9).alias("good"))
