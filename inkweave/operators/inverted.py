"""A kept positional inverted index: postings by term, read by term, with phrases, prefixes, nearness and BM25.

A posting says of a term and a document how often, and at which places.  A place is the token's number plus ``FIELD``
times the number of its field, so places of different fields never stand next to one another.  Tasks cut texts once and
pack the postings of a block of documents by term, so what is shuffled and sorted are rows of terms and blocks instead of
postings.  They are partitioned by a hash of the term and sorted by it, so a search reads the partitions of its terms and
in them the row groups that have them, and opens these rows only; texts are not read.

An index that is asked by tables of questions only is kept by documents (``by_term=False``): each block of documents stays
one row with its terms and their postings.  Building it shuffles nothing, ``best`` reads it without moving a posting, and a
search for a few words reads all blocks.

The index grows by segments.  An upsert writes one segment with the postings of the touched paths, and the list of these
paths hides what older segments say of them; ``compact`` writes all live postings as one segment.  A manifest, written
last, names the segments and the counts of the whole index.

Defined results: a null text has no tokens and its document counts; a null path, or a path that comes twice, raises no
error: null paths are left out, rows of one path are taken together (their postings are separate rows, and searches see
the places of all); terms that no document has match nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.functions.porter import with_stems
from inkweave.operators.text import K1, Best, B, Ids, few, tokens
from inkweave.sources.snapshot import Snapshot
from inkweave.sources.store import written

FIELD = 1 << 40
#: Partitions of a segment.
PARTS = 32
#: Postings of a chunk of documents, about, and questions of a block, when many are answered.
POSTINGS, QUESTIONS = 1 << 20, 4096
#: Tokens of a block of documents, about, and postings that are opened at once.
TOKENS, OPENED = 1 << 21, 1 << 17
#: Terms of a part of the vocabulary that is asked for, about.
VOCABULARY = 1 << 17


@dataclass(frozen=True)
class Unit:
    """What is looked for: a word, words one after the other, the beginning of a word, or two words near each other."""

    kind: str
    words: tuple[str, ...]
    gap: int = 0


def word(w: str) -> Unit:
    return Unit("word", (w,))


def phrase(*words: str) -> Unit:
    return Unit("phrase", words)


def prefix(start: str) -> Unit:
    return Unit("prefix", (start,))


def near(a: str, b: str, gap: int = 10) -> Unit:
    """Two words with at most ``gap`` others between them, in any order."""
    return Unit("near", (a, b), gap)


#: A block's postings of one term as Arrow and numpy have them in memory: the bytes of the paths and their lengths (int32),
#: for each posting and field how often (int32) and the field's tokens (int32), and the tokens' numbers (int32).
PACKED = "term string, paths binary, sizes binary, tf binary, len binary, at binary"


SCHEMA = f"{PACKED}, seg long, part long"

#: A block kept by documents: paths (neighbours that are equal once), of each row its path's number and its tokens by field,
#: terms, where each one's postings and places begin, of each posting its row and how often by field, the tokens' numbers.
BLOCKS = "block long, paths array<string>, own binary, len binary, terms array<string>, first binary, begin binary, doc binary, tf binary, at binary"


def blocks(docs: DataFrame, fields: list[str], cut: Callable[[Column], Column] = tokens) -> DataFrame:
    """Postings packed by term for each block of documents, and one row without a term for all of a block; nothing is shuffled."""
    each = (cut(F.coalesce(F.col(f), F.lit(""))).alias(f"t{k}") for k, f in enumerate(fields))
    return docs.filter("path is not null").select(F.col("path").cast("string").alias("path"), *each).mapInArrow(_blocked, PACKED)


def _blocked(batches):
    for b in batches:
        size = np.sum([pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in b.columns[1:]], 0)
        at = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // TOKENS)) + 1).tolist(), len(b)]
        for i, j in zip(at, at[1:], strict=False):
            if j > i:
                yield from _block(b.slice(i, j - i))


def _block(b: pa.RecordBatch):
    path, lengths, terms, first, doc, tf, at, places = _cut(b)
    none = np.zeros(0, np.int32)
    yield _rows(pa.array([None], pa.string()), np.zeros(1, np.int64), path, np.zeros((len(b), 0), np.int32), lengths, none, np.array([0, 0]))
    if len(terms):
        yield _rows(terms, first, path.take(pa.array(doc)), tf, lengths[doc], at, places)


def _cut(b: pa.RecordBatch) -> tuple:
    """path, lengths of each row; terms; where each one's postings begin; row, tf of each posting; places; where each term's begin."""
    path, cols = b.column(0).cast(pa.string()), b.columns[1:]
    lengths = np.stack([pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols], 1)
    if not lengths.sum():
        none = np.zeros(0, np.int64)
        return path, lengths, pa.array([], pa.string()), none, none, np.zeros((0, len(cols)), np.int32), none.astype(np.int32), np.array([0])
    row = np.concatenate([np.repeat(np.arange(len(b)), n) for n in lengths.T])
    at = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in lengths.T]).astype(np.int32)
    field = np.repeat(np.arange(len(cols)), lengths.sum(0))
    term = pa.concat_arrays([c.flatten().cast(pa.string()) for c in cols]).dictionary_encode()
    key = term.indices.to_numpy().astype(np.int64) * len(b) + row
    bits = len(key).bit_length()
    if len(term.dictionary) * len(b) < 1 << (63 - bits):  # of one term and row, places stay in order
        key = np.sort(key << bits | np.arange(len(key)))
        key, order = key >> bits, key & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.stack([np.add.reduceat((field[order] == k).astype(np.int32), begin) for k in range(len(cols))], 1)
    posting = key[begin]
    first = np.flatnonzero(np.diff(posting // len(b), prepend=-1))
    doc = posting % len(b)
    terms = term.dictionary.take(pa.array(posting[first] // len(b)))
    return path, lengths, terms, first, doc, tf, at[order], np.append(begin[first], len(at))


def kept_blocks(docs: DataFrame, fields: list[str], cut: Callable[[Column], Column] = tokens) -> DataFrame:
    """Rows of BLOCKS; nothing is shuffled.  Neighbours with one path stay in one block."""
    each = (cut(F.coalesce(F.col(f), F.lit(""))).alias(f"t{k}") for k, f in enumerate(fields))
    return docs.filter("path is not null").select(F.col("path").cast("string").alias("path"), *each).mapInArrow(_kept, BLOCKS)


def _kept(batches):
    own = TaskContext.get().partitionId() << 32
    held, tokens_held, n = [], 0, 0
    for b in batches:
        size = np.sum([pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in b.columns[1:]], 0, dtype=np.int64)
        at = [0, *(np.flatnonzero(np.diff((tokens_held + np.cumsum(size)) // TOKENS)) + 1).tolist(), len(b)]
        for i, j in zip(at, at[1:], strict=False):
            if j <= i:
                continue
            held.append(b.slice(i, j - i))
            tokens_held += int(size[i:j].sum())
            if tokens_held >= TOKENS:
                x = pa.Table.from_batches(held).combine_chunks()
                if len(changes := _changes(x.column(0).combine_chunks())):  # the last path may go on
                    yield _document_block(x.slice(0, changes[-1]), own + n)
                    x, n = x.slice(changes[-1]), n + 1
                    held, tokens_held = x.to_batches(), sum(len(c.flatten()) for t in x.to_batches() for c in t.columns[1:])
    if held:
        yield _document_block(pa.Table.from_batches(held), own + n)


def _document_block(x: pa.Table, number: int) -> pa.RecordBatch:
    x = x.combine_chunks()
    path, lengths, terms, first, doc, tf, at, places = _cut(pa.RecordBatch.from_arrays([c.combine_chunks() for c in x.columns], x.schema.names))
    begin = np.append(0, _changes(path))
    own = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(path)))
    of = lambda a: pa.array([np.ascontiguousarray(a, np.int32).tobytes()], pa.binary())
    listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    columns = [pa.array([number]), listed(path.take(pa.array(begin))), of(own), of(lengths), listed(terms), of(np.append(first, len(doc))), of(places), of(doc), of(tf), of(at)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKS.split(", ")])


def _numbers(b: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(b.column(n)[row].as_py() or b"", np.int32) for n in names]


def _paths_of(fields: int):
    """path, lengths of each row of blocks."""

    def run(batches):
        for b in batches:
            for row in range(len(b)):
                own, length = _numbers(b, row, "own", "len")
                lengths = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * fields, pa.int32()), pa.array(length.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("paths")[row].values.take(pa.array(own)), lengths], ["path", "lengths"])

    return run


def _postings_of(fields: int, words: list[str] | None, starts: list[str]):
    """Postings of blocks, as ``_unpacked`` gives them: all, or those of words and of terms that begin so."""

    def run(batches):
        for b in batches:
            for row in range(len(b)):
                own, length, first, begin, doc, tf, at = _numbers(b, row, "own", "len", "first", "begin", "doc", "tf", "at")
                terms = b.column("terms")[row].values
                packed = _rows(terms, first[:-1].astype(np.int64), b.column("paths")[row].values.take(pa.array(own[doc])), tf.reshape(-1, fields), length.reshape(-1, fields)[doc], at, begin.astype(np.int64))
                packed = packed.append_column("seg", pa.array(np.full(len(terms), b.column("seg")[row].as_py()), pa.int64()))
                if words is not None or starts:
                    wanted = pc.is_in(terms, value_set=pa.array(words or [], pa.string()))
                    for s in starts:
                        wanted = pc.or_(wanted, pc.starts_with(terms, s))
                    packed = packed.filter(wanted)
                if len(packed):
                    yield from _unpacked(fields)([pa.concat_batches([packed])])

    return run


def _rows(terms: pa.Array, first: np.ndarray, path: pa.Array, tf: np.ndarray, lengths: np.ndarray, at: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """A row for each term: its postings begin at ``first`` of path, tf and lengths, its places at ``places`` of at."""
    ends = np.append(first, len(path))
    offset = np.frombuffer(path.buffers()[1], np.int32)[path.offset : path.offset + len(path) + 1] if len(path) else np.zeros(1, np.int32)

    def cut(values, begins: np.ndarray) -> pa.Array:
        return pa.BinaryArray.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(begins.astype(np.int32)), values])

    of = lambda x: cut(pa.py_buffer(np.ascontiguousarray(x, np.int32)), ends * 4 * (x.shape[1] if x.ndim > 1 else 1))
    columns = [terms, cut(path.buffers()[2] or pa.py_buffer(b""), offset[ends]), of(np.diff(offset)), of(tf), of(lengths), cut(pa.py_buffer(np.ascontiguousarray(at, np.int32)), places * 4)]
    return pa.RecordBatch.from_arrays(columns, ["term", "paths", "sizes", "tf", "len", "at"])


def _unpacked(fields: int):
    """path, tf, places, lengths of each posting of packed rows, with their other columns."""

    def run(batches):
        for b in batches:
            n = pc.binary_length(b.column("sizes")).to_numpy(zero_copy_only=False) // 4
            at = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // OPENED)) + 1).tolist(), len(b)]
            for i, j in zip(at, at[1:], strict=False):
                if n[i:j].sum():
                    yield _opened(b.slice(i, j - i), n[i:j], fields)

    return run


def _opened(b: pa.RecordBatch, n: np.ndarray, fields: int) -> pa.RecordBatch:
    def data(name: str) -> pa.Buffer:
        c = b.column(name).cast(pa.binary())
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        return c.buffers()[2].slice(ends[0], ends[-1] - ends[0]) if ends[-1] > ends[0] else pa.py_buffer(b"")

    total = int(n.sum())
    many = lambda ends: pa.py_buffer(np.append(0, ends).astype(np.int32))
    path = pa.StringArray.from_buffers(total, many(np.cumsum(np.frombuffer(data("sizes"), np.int32))), data("paths"))
    columns = {"path": path}
    if len(b.column("tf")) and len(tf := np.frombuffer(data("tf"), np.int32)):
        tf = tf.reshape(total, fields)
        at = np.frombuffer(data("at"), np.int32) + np.repeat(np.tile(np.arange(fields) * FIELD, total), tf.ravel())
        columns["tf"] = pa.array(tf.sum(1, dtype=np.int64))
        columns["places"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf.sum(1))), pa.int32()), pa.array(at))
    lengths = np.frombuffer(data("len"), np.int32).astype(np.int64)
    columns["lengths"] = pa.ListArray.from_arrays(pa.array(np.arange(total + 1) * fields, pa.int32()), pa.array(lengths))
    own = pa.array(np.repeat(np.arange(len(b)), n))
    columns |= {c: b.column(c).take(own) for c in b.schema.names if c not in ("paths", "sizes", "tf", "len", "at")}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _repacked(fields: int):
    """Packed rows of batches of postings."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            term = b.column("term").cast(pa.string()).dictionary_encode()
            order = np.argsort(term.indices.to_numpy(), kind="stable")
            b, key = b.take(pa.array(order)), term.indices.to_numpy()[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            size = pc.list_value_length(b.column("places")).to_numpy(zero_copy_only=False)
            place = b.column("places").flatten().to_numpy()
            row = np.repeat(np.arange(len(b)), size)
            tf = np.bincount(row * fields + place // FIELD, minlength=len(b) * fields).reshape(-1, fields)
            lengths = b.column("lengths").flatten().to_numpy().reshape(-1, fields)
            begin = np.append(0, np.cumsum(size))
            yield _rows(term.dictionary.take(pa.array(key[first])), first, b.column("path").cast(pa.string()), tf, lengths, place % FIELD, np.append(begin[first], len(place)))

    return run


def _moved(by: int):
    return lambda y: y + F.lit(by)


class Index:
    """The index under ``root``; every method sees the newest version.

    cut: a text column to its tokens.  stemmed: whether ``best`` can also search by stems.  Then a table of stems is kept,
    one row for each distinct term, by a hash of the stem; postings stay those of the terms, and a stem's are its terms'.
    by_term: whether postings are partitioned by term, for searches of few words; else blocks are kept by documents.
    """

    def __init__(self, spark: SparkSession, root: str, fields: list[str] = ("text",), parts: int = PARTS, cut: Callable[[Column], Column] = tokens, stemmed: bool = False, by_term: bool = True) -> None:
        self.spark, self.root, self.fields, self.parts, self.cut, self.stemmed, self.by_term = spark, root, list(fields), parts, cut, stemmed, by_term

    # Writing

    def upsert(self, docs: DataFrame, removed: DataFrame | None = None) -> Index:
        """Replaces the documents of docs (path and the fields) and drops those of removed (path): one new segment."""
        old = Snapshot.latest(self.spark, self.root)
        new = old.next()
        paths = self._upsert_blocks(docs, new.version) if not self.by_term else self._upsert_terms(docs, new.version)
        stems = self._write_stems(old, new.version)
        if removed is not None:
            paths = paths.unionByName(removed.filter("path is not null").select(F.col("path").cast("string").alias("path")).join(paths.select("path"), "path", "left_anti").distinct().withColumn("lengths", F.lit(None).cast("array<long>")))
        at = f"{self.root}/paths/seg={new.version}"
        paths.write.mode("overwrite").parquet(at)
        change = self._count(self.spark.read.schema("path string, lengths array<long>").parquet(at))
        if old.version:
            touched = self.spark.read.schema("path string").parquet(at).distinct()
            was = self._count(self._live(self._paths(old), old).join(touched, "path", "left_semi"))
            change = [c - w for c, w in zip(change, was, strict=True)]
        before = old.facts.get("counts", [0] * len(change))
        new.facts = {"segments": [*old.facts.get("segments", []), new.version], "counts": [b + c for b, c in zip(before, change, strict=True)], "stems": stems}
        new.commit()
        return self

    def _upsert_terms(self, docs: DataFrame, segment: int) -> DataFrame:
        """Texts are cut once; from what is staged, terms go to their partitions and documents to the list of paths."""
        staged = f"{self.root}/staged/seg={segment}"
        blocks(docs, self.fields, self.cut).write.mode("overwrite").option("compression", "zstd").parquet(staged)
        packed = self.spark.read.schema(PACKED).parquet(staged)
        self._write(packed.filter("term is not null"), segment)
        return packed.filter("term is null").select("paths", "sizes", "tf", "len", "at").mapInArrow(_unpacked(len(self.fields)), "path string, lengths array<long>")

    def _upsert_blocks(self, docs: DataFrame, segment: int) -> DataFrame:
        """Blocks as they are cut.  Rows that repeat a path, if there are any, are brought together first."""
        at = f"{self.root}/blocks/seg={segment}"

        def write(rows: DataFrame) -> DataFrame:
            kept_blocks(rows, self.fields, self.cut).write.mode("overwrite").option("compression", "zstd").parquet(at)
            return self.spark.read.schema(BLOCKS).parquet(at).select("paths", "own", "len").mapInArrow(_paths_of(len(self.fields)), "path string, lengths array<long>")

        paths = write(docs)
        rows, distinct = paths.agg(F.count("*"), F.countDistinct("path")).first()
        return paths if rows == distinct else write(docs.filter("path is not null").repartition(F.xxhash64("path")).sortWithinPartitions("path"))

    def compact(self) -> Index:
        """All live postings as one segment."""
        if not self.by_term:
            raise ValueError("an index kept by documents is not compacted: upsert the documents anew")
        old = Snapshot.latest(self.spark, self.root)
        new = old.next()
        self._write(self.postings().select("path", "term", "tf", "places", "lengths").mapInArrow(_repacked(len(self.fields)), PACKED), new.version)
        self._live(self._paths(old), old).filter("lengths is not null").select("path", "lengths").write.mode("overwrite").parquet(f"{self.root}/paths/seg={new.version}")
        new.facts = {"segments": [new.version], "counts": old.facts["counts"], "stems": self._write_stems(None, new.version)}
        new.commit()
        return self

    def _write(self, packed: DataFrame, segment: int) -> None:
        part = F.pmod(F.crc32("term"), F.lit(self.parts))
        # A common term is no hot key: its rows may go to several files of its partition.
        out = packed.withColumn("part", part).hint("rebalance", "part").sortWithinPartitions("part", "term")
        out.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{self.root}/postings/seg={segment}")

    def _write_stems(self, old: Snapshot | None, segment: int) -> list[int]:
        """Stems of the terms of a segment that no earlier one has; the segments with stems."""
        if not self.stemmed:
            return []
        if self.by_term:
            terms = self.spark.read.schema("term string").parquet(f"{self.root}/postings/seg={segment}").distinct()
        else:
            terms = self.spark.read.schema(BLOCKS).parquet(f"{self.root}/blocks/seg={segment}").select(F.explode("terms").alias("term")).distinct()
        before = old.facts.get("stems", []) if old and old.version else []
        if before:
            terms = terms.join(self._stems(before).select("term"), "term", "left_anti")
        out = with_stems(terms).withColumn("part", F.pmod(F.crc32("stem"), F.lit(self.parts))).hint("rebalance", "part").sortWithinPartitions("part", "stem")
        out.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{self.root}/stems/seg={segment}")
        return [*before, segment]

    def _stems(self, segments: list[int]) -> DataFrame:
        return self.spark.read.schema("term string, stem string, seg long, part long").option("basePath", f"{self.root}/stems").parquet(*(f"{self.root}/stems/seg={s}" for s in segments))

    def stems(self) -> DataFrame:
        """term, stem of every term that some document has or had."""
        return self._stems(Snapshot.latest(self.spark, self.root).facts["stems"]).select("term", "stem")

    def _count(self, paths: DataFrame) -> list[int]:
        """Documents, and tokens of each field."""
        r = paths.filter("lengths is not null").agg(F.count("*"), *(F.coalesce(F.sum(F.get("lengths", k)), F.lit(0)) for k in range(len(self.fields)))).first()
        return [int(x) for x in r]

    # Reading

    def _segments(self, version: Snapshot, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*(f"{self.root}/{table}/seg={s}" for s in version.facts["segments"]))

    def _paths(self, version: Snapshot) -> DataFrame:
        return self._segments(version, "paths", "path string, lengths array<long>, seg long")

    def _opened(self, rows: DataFrame, *more: str) -> DataFrame:
        """path, term, tf, places, lengths, seg of each posting of packed rows, and further columns of these (as in a schema)."""
        names = [c.split()[0] for c in more]
        out = rows.select("paths", "sizes", "tf", "len", "at", "term", "seg", *names)
        return out.mapInArrow(_unpacked(len(self.fields)), ", ".join(["path string, tf long, places array<long>, lengths array<long>, term string, seg long", *more]))

    def _live(self, rows: DataFrame, version: Snapshot) -> DataFrame:
        """Rows of segments that no later segment replaces.  Only the paths of later segments are looked up."""
        first, *later = version.facts["segments"]
        if not later:
            return rows
        newest = self._paths(version).filter(F.col("seg") > first).groupBy("path").agg(F.max("seg").alias("_newest"))
        return rows.join(newest, "path", "left").filter("_newest is null or _newest = seg").drop("_newest")

    def postings(self, words: list[str] | None = None, starts: list[str] = ()) -> DataFrame:
        """path, term, tf, places, lengths of live documents: all postings, or those of words and of terms that begin so."""
        version = Snapshot.latest(self.spark, self.root)
        if not self.by_term:
            rows = self._segments(version, "blocks", f"{BLOCKS}, seg long").drop("block").mapInArrow(_postings_of(len(self.fields), words, list(starts)), "path string, tf long, places array<long>, lengths array<long>, term string, seg long")
            return self._live(rows, version).select("path", "term", "tf", "places", "lengths")
        rows = self._segments(version, "postings", SCHEMA)
        if words is not None or starts:
            words = words or []
            wanted = F.col("term").isin(words)
            for s in starts:
                wanted = wanted | F.col("term").startswith(s)
            if not starts:
                rows = rows.filter(F.col("part").isin(sorted({zlib.crc32(w.encode()) % self.parts for w in words})))
            rows = rows.filter(wanted)
        return self._live(self._opened(rows), version).select("path", "term", "tf", "places", "lengths")

    def version(self) -> int:
        """How often the index was written; 0: never."""
        return Snapshot.latest(self.spark, self.root).version

    def counts(self) -> tuple[int, list[int]]:
        """Documents, and tokens of each field."""
        n, *lengths = Snapshot.latest(self.spark, self.root).facts["counts"]
        return n, lengths

    # Searching

    def search(self, every: list[Unit] = (), some: list[Unit] = (), none: list[Unit] = (), fields: list[str] | None = None) -> DataFrame:
        """path, score of the documents that have every unit of ``every``, one of ``some`` (if there are any) and none of ``none``.

        The score is BM25 over the units of every and some, negative, lower is better; a unit's frequency is how often it
        occurs.  fields: those that are searched and whose tokens count; all by default.  One scan of the postings of the
        words, one grouping by path of what it finds, and one row of figures.
        """
        use = [self.fields.index(f) for f in (fields or self.fields)]
        units = list(dict.fromkeys([*every, *some, *none]))
        words = sorted({w for u in units if u.kind != "prefix" for w in u.words})
        starts = sorted({w for u in units if u.kind == "prefix" for w in u.words})
        inside = lambda x: _any([(x >= k * FIELD) & (x < (k + 1) * FIELD) for k in use])
        p = self.postings(words, starts)
        if len(use) < len(self.fields):
            p = p.withColumn("places", F.filter("places", inside))
        length = F.aggregate(F.array(*(F.get("lengths", k) for k in use)), F.lit(0).cast("long"), lambda a, x: a + x)
        at = {w: F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("places")))).alias(f"w{i}") for i, w in enumerate(words)}
        begun = {s: F.coalesce(F.sum(F.when(F.col("term").startswith(s), F.size("places"))), F.lit(0)).alias(f"s{i}") for i, s in enumerate(starts)}
        found = p.groupBy("path").agg(F.max(length).alias("len"), *at.values(), *begun.values())
        place, start = {w: F.col(f"w{i}") for i, w in enumerate(words)}, {s: F.col(f"s{i}") for i, s in enumerate(starts)}
        found = found.select("path", "len", *(_occurrences(u, place, start).cast("long").alias(f"u{i}") for i, u in enumerate(units)))
        has = {u: F.col(f"u{i}") > 0 for i, u in enumerate(units)}
        scored = [i for i, u in enumerate(units) if u in every or u in some]
        figures = found.agg(*(F.count_if(F.col(f"u{i}") > 0).alias(f"df{i}") for i in scored))
        wanted = F.lit(True)
        for u in every:
            wanted = wanted & has[u]
        if some:
            wanted = wanted & _any([has[u] for u in some])
        for u in none:
            wanted = wanted & ~has[u]
        n, lengths = self.counts()
        mean = sum(lengths[k] for k in use) / n if n else 0.0
        score = F.lit(0.0)
        for i in scored:
            tf = F.col(f"u{i}")
            score = score - _idf(F.lit(n), F.col(f"df{i}")) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
        return found.filter(wanted).crossJoin(F.broadcast(figures)).select("path", score.alias("score"))  # figures is one row

    def best(self, questions: DataFrame, k: int, allowed: DataFrame | None = None, fields: list[str] | None = None, stemmed: bool = False) -> DataFrame:
        """query_id, path, score, rank: the k best documents with some term of each question, all questions in one job.

        questions: query_id, term (once each).  allowed: path; ranks count these documents only, while the corpus figures
        count all.  Postings of terms that are asked for move once, to their documents, which are packed in chunks.  Blocks
        of questions meet chunks inside Arrow batches, where scores are summed, so pairs of questions and documents never
        move: a chunk gives a question its own k best at most.

        stemmed: terms with one stem are one term, in questions (where it counts once) and in documents.
        """
        use = [self.fields.index(f) for f in (fields or self.fields)]
        v = Snapshot.latest(self.spark, self.root)
        n, *lengths = v.facts["counts"]
        mean = sum(lengths[i] for i in use) / n if n else 0.0
        by = lambda c: F.pmod(F.crc32(c), F.lit(self.parts))
        if stemmed:
            stems = written(self.spark, with_stems(questions.select("term").distinct()))
            questions = questions.join(stems, "term").select("query_id", F.col("stem").alias("term")).distinct()
            asked = written(self.spark, stems.select(F.col("stem").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()))
            # Each term has one stem, so a posting meets one row at most.
            known = self._stems(v.facts["stems"]).join(asked.select(F.col("term").alias("stem"), "t", by("term").alias("part")), ["part", "stem"])
            known = written(self.spark, known.select("term", "t"))
        else:
            known = asked = written(self.spark, questions.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
        if not self.by_term:
            return self._best_of_blocks(v, questions, asked, known, k, allowed, use, n, mean)
        rows = self._segments(v, "postings", SCHEMA)
        p = self._live(self._opened(rows.join(known.withColumn("part", by("term")), ["part", "term"]), "t long"), v)
        inside = lambda x: _any([(x >= i * FIELD) & (x < (i + 1) * FIELD) for i in use])
        tf = F.col("tf") if len(use) == len(self.fields) else F.size(F.filter("places", inside)).cast("long")
        length = F.aggregate(F.array(*(F.get("lengths", i) for i in use)), F.lit(0).cast("long"), lambda a, x: a + x)
        p = p.select("path", "t", tf.alias("tf"), length.alias("len")).filter("tf > 0")
        # What is allowed comes along as rows of the term -1: no join, whose form Spark may change as it runs.  Documents are
        # dealt by a hash that no join deals by, so this exchange and the order after it are never taken for done before.
        if allowed is not None:
            p = p.unionByName(allowed.select(F.col("path").cast("string").alias("path"), F.lit(-1).cast("long").alias("t"), F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("len")))
        together = p.filter("path is not null").repartition(F.xxhash64("path")).sortWithinPartitions("path")
        packed = written(self.spark, together.mapInArrow(_packed(allowed is None), "paths array<string>, ok binary, len binary, t binary, doc binary, tf binary"))
        df = packed.select("t").mapInArrow(_documents, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
        weight = df.select("t", _idf(F.lit(n), F.col("df")).alias("idf"))
        q = questions.select("query_id", "term").join(asked, "term").join(weight, "t").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("t", "idf"))).alias("e"))
        kind = questions.schema["query_id"].dataType.simpleString()
        q = q.select("query_id", F.col("e.t").alias("t"), F.col("e.idf").alias("idf")).mapInArrow(_blocks, f"q_ids array<{kind}>, q_at binary, q_t binary, q_idf binary")
        pairs = few(packed.withColumn("no", F.monotonically_increasing_id())).crossJoin(written(self.spark, q).withColumn("q_no", F.monotonically_increasing_id()))
        hits = pairs.mapInArrow(_scored(k, mean), f"query_id {kind}, path string, score double")
        return _ranked(hits, k)

    def _best_of_blocks(self, v: Snapshot, questions: DataFrame, asked: DataFrame, known: DataFrame, k: int, allowed: DataFrame | None, use: list[int], n: int, mean: float) -> DataFrame:
        """The same from blocks of documents.  Parts of the vocabulary meet blocks and give how many documents have each
        term; then blocks of questions, with the terms that they ask for, meet blocks and are answered there."""
        rows = self._segments(v, "blocks", f"{BLOCKS}, seg long")
        every, own = rows, rows.select("seg", "block", F.posexplode("paths").alias("i", "path"))
        listed = lambda found, name: found.groupBy("seg", "block").agg(F.collect_list("i").alias(name))
        first, *later = v.facts["segments"]
        if later:
            newest = self._paths(v).filter(F.col("seg") > first).groupBy("path").agg(F.max("seg").alias("_newest"))
            every = every.join(listed(own.join(newest, "path").filter("_newest > seg"), "gone"), ["seg", "block"], "left")
        else:
            every = every.withColumn("gone", F.lit(None).cast("array<int>"))
        columns = ["own", "len", "terms", "first", "doc", "tf", "gone"]
        words = known.repartition(F.xxhash64("t")).sortWithinPartitions("t").select("term", "t").mapInArrow(_vocabulary, "v_terms array<string>, v_t binary")
        met = few(every.select(*columns)).crossJoin(written(self.spark, words))
        df = met.mapInArrow(_having(len(self.fields), use), "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
        weight = df.select("t", _idf(F.lit(n), F.col("df")).alias("idf"))
        terms = known.groupBy("t").agg(F.collect_list("term").alias("terms"))
        e = asked.select("term", "t").join(weight, "t").join(terms, "t")
        q = questions.select("query_id", "term").join(e, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("t", "idf", "terms"))).alias("e"))
        kind = questions.schema["query_id"].dataType.simpleString()
        q = q.select("query_id", F.col("e.t").alias("t"), F.col("e.idf").alias("idf"), F.col("e.terms").alias("terms"))
        q = written(self.spark, q.mapInArrow(_question_blocks, f"q_ids array<{kind}>, q_at binary, q_t binary, q_idf binary, q_terms array<string>, q_slot binary")).withColumn("q_no", F.monotonically_increasing_id())
        if allowed is not None:
            every = every.join(listed(own.join(allowed.select(F.col("path").cast("string").alias("path")).distinct(), "path", "left_semi"), "may"), ["seg", "block"], "left")
        every = every.select("paths", *columns, *(["may"] if allowed is not None else []))
        pairs = few(every.withColumn("no", F.monotonically_increasing_id())).crossJoin(q)
        return _ranked(pairs.mapInArrow(_answered(k, mean, len(self.fields), use), f"query_id {kind}, path string, score double"), k)


def _packed(every: bool):
    """Chunks of documents from postings that stand in order of their paths: arrays of documents and, by term, of postings.

    every: all documents are allowed; otherwise those with a row of the term -1.
    """

    def chunk(x: pa.Table) -> pa.RecordBatch:
        x = x.combine_chunks()
        t, tf, length = (x[c].to_numpy() for c in ("t", "tf", "len"))
        path = x["path"].combine_chunks()
        begin = np.append(0, _changes(path))
        doc = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(x)))
        ok = np.ones(len(begin), bool)
        if not every:
            ok[:] = np.bincount(doc[t < 0], minlength=len(begin))
            doc, t, tf, length = (c[t >= 0] for c in (doc, t, tf, length))
        # Several postings of one term in a document (terms of one stem, rows of one path) are one.
        key = t * len(begin) + doc if t.max(initial=0) < 1 << 40 else None
        order = np.argsort(key, kind="stable") if key is not None else np.lexsort((doc, t))
        t, doc, tf, length = t[order], doc[order], tf[order], length[order]
        first = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        sums = (np.maximum.reduceat(length, first), t[first], doc[first].astype(np.int32), np.add.reduceat(tf, first)) if len(t) else (length, t, doc.astype(np.int32), tf)
        paths = pa.ListArray.from_arrays(pa.array([0, len(begin)], pa.int32()), path.take(pa.array(begin)))
        return pa.RecordBatch.from_arrays([paths, *(pa.array([a.tobytes()], pa.binary()) for a in (ok, *sums))], ["paths", "ok", "len", "t", "doc", "tf"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= POSTINGS:
                x = pa.Table.from_batches(held)
                changes = _changes(x["path"].combine_chunks())
                if len(changes):  # the last document may go on
                    yield chunk(x.slice(0, changes[-1]))
                    x = x.slice(changes[-1])
                held, rows = x.to_batches(), len(x)
        if rows:
            yield chunk(pa.Table.from_batches(held))

    return run


def _changes(paths: pa.Array) -> np.ndarray:
    """The places of a sorted column where a value differs from the one before."""
    return np.flatnonzero(pc.not_equal(paths.slice(1), paths.slice(0, max(len(paths) - 1, 0))).to_numpy(zero_copy_only=False)) + 1


def _documents(batches):
    """The terms of each chunk and how many of its documents have them."""
    for b in batches:
        for x in b.column(0):
            t, n = np.unique(np.frombuffer(x.as_py(), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["t", "df"])


def _blocks(batches):
    """Questions packed in blocks: their ids, where each one's terms begin, terms, weights."""
    for b in batches:
        for i in range(0, len(b), QUESTIONS):
            part = b.slice(i, QUESTIONS)
            at = np.append(0, np.cumsum(pc.list_value_length(part.column(1)).to_numpy()))
            values = (at, part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy())
            ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([a.astype(kind).tobytes()], pa.binary()) for a, kind in zip(values, (np.int64, np.int64, np.float64), strict=True))], ["q_ids", "q_at", "q_t", "q_idf"])


def _scored(k: int, mean: float):
    """The k best of each question among the chunks that a task has: given when it ends."""

    def run(batches):
        seen, ids = {}, Ids()
        for b in batches:
            for row in range(len(b)):
                read = lambda name, kind: np.frombuffer(b.column(name)[row].as_py(), kind)  # noqa: B023, E731
                paths, q_ids = b.column("paths")[row].values, b.column("q_ids")[row].values
                t, at, asked = read("t", np.int64), read("q_at", np.int64), read("q_t", np.int64)
                ranges = np.searchsorted(t, asked), np.searchsorted(t, asked, "right")
                best = _kept_for(seen, b.column("q_no")[row].as_py(), q_ids, k, ids)
                chunk = ids.add(b.column("no")[row].as_py(), paths)
                _score(best, chunk, len(paths), read("doc", np.int32), _weight(read("tf", np.int64), read("len", np.int64), mean), read("ok", bool), at, ranges, read("q_idf", np.float64))
        for q_ids, best in seen.values():
            yield from best.listed(q_ids, ["query_id", "path", "score"])

    return run


def _kept_for(seen: dict, number: int, q_ids: pa.Array, k: int, ids: Ids) -> Best:
    if number not in seen:
        seen[number] = q_ids, Best(len(q_ids), k, ids)
    return seen[number][1]


def _weight(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


#: Scores are sums of a few rounded products; what is below a limit by less than this may round to it.
NEAR = 2e-6


def _score(best: Best, chunk: int, docs: int, doc: np.ndarray, w: np.ndarray, ok: np.ndarray, at: np.ndarray, ranges: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> None:
    """Scores a chunk's documents for each question and keeps the best.  ranges: the postings of each term that is asked for.

    Once a question has k documents, those that have only terms whose weights together do not reach the last one of them
    are not looked at; the others get the sum of all terms, in the order of the terms.
    """
    low, high = ranges
    if not ok.all():  # postings of documents that do not count
        keep = ok[doc]
        to = np.append(0, np.cumsum(keep))
        doc, w, low, high = doc[keep], w[keep], to[low], to[high]
    rows, one, score = {}, np.empty(docs), np.empty(docs)
    there = high > low
    top = np.zeros(len(low))  # the most that each question's term gives to a document
    if there.any():
        lows, back = np.unique(low[there], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[back] = high[there]
        most = np.maximum.reduceat(np.append(w, 0.0), np.stack([lows, highs], 1).ravel())[::2]
        top[there] = most[back] * idf[there]
    entries = list(zip(low.tolist(), high.tolist(), idf.tolist(), top.tolist(), strict=True))
    at = at.tolist()

    def whole(lo: int, hi: int) -> np.ndarray:
        if lo not in rows:  # a common term is a row of all documents
            rows[lo] = np.zeros(docs)
            rows[lo][doc[lo:hi]] = w[lo:hi]
        return rows[lo]

    for i in range(len(at) - 1):
        own = [e for e in entries[at[i] : at[i + 1]] if e[1] > e[0]]
        if not own:
            continue
        limit, some = best.limit(i), None
        if limit < np.inf:
            rest, needed = 0.0, []
            for e in sorted(own, key=lambda e: e[3]):
                rest += e[3]
                if -rest <= limit + NEAR:
                    needed.append(e)
            if not needed:
                continue
            if 4 * sum(hi - lo for lo, hi, *_ in needed) < docs:
                some = doc[needed[0][0] : needed[0][1]] if len(needed) == 1 else np.unique(np.concatenate([doc[lo:hi] for lo, hi, *_ in needed]))
        if some is not None:
            values = np.zeros(len(some))
            for lo, hi, x, _ in own:
                if 16 * (hi - lo) > docs or lo in rows:
                    values -= whole(lo, hi)[some] * x
                else:  # documents of a term stand in order
                    p = np.minimum(np.searchsorted(doc[lo:hi], some), hi - lo - 1) + lo
                    values -= np.where(doc[p] == some, w[p], 0.0) * x
        else:
            score[:] = 0
            for lo, hi, x, _ in own:
                if 4 * (hi - lo) > docs:
                    np.multiply(whole(lo, hi), x, out=one)
                    np.subtract(score, one, out=score)
                else:
                    score[doc[lo:hi]] -= w[lo:hi] * x
            # Hits have less than 0; what is worse than the k best by more than rounding does is not looked at.
            some = np.flatnonzero((score < 0) & (score <= limit + NEAR))
            values = score[some]
        if len(some):
            best.add(i, chunk, some, np.round(values, 6) + 0.0)


def _vocabulary(batches):
    """Parts of the terms that are asked for, with their numbers; terms of one number stand in one part."""
    held, n = [], 0

    def part(x: pa.Table) -> pa.RecordBatch:
        x = x.combine_chunks()
        terms = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x["term"].combine_chunks().cast(pa.string()))
        return pa.RecordBatch.from_arrays([terms, pa.array([x["t"].to_numpy().tobytes()], pa.binary())], ["v_terms", "v_t"])

    for b in batches:
        held, n = [*held, b], n + len(b)
        if n >= VOCABULARY:
            x = pa.Table.from_batches(held)
            changes = _changes(x["t"].combine_chunks())
            if len(changes):
                yield part(x.slice(0, changes[-1]))
                x = x.slice(changes[-1])
            held, n = x.to_batches(), len(x)
    if n:
        yield part(pa.Table.from_batches(held))


def _asked_in(b: pa.RecordBatch, row: int, terms: pa.Array, number: np.ndarray, fields: int, use: list[int]) -> tuple:
    """number, document, tf, len of a block's postings of some terms, by number and document, those of one together.

    number: of each term; several can have one.  The longest of a document's rows with the term counts.
    """
    own, length, first, doc, tf = _numbers(b, row, "own", "len", "first", "doc", "tf")
    at = pc.index_in(b.column("terms")[row].values, value_set=terms)
    mine = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    t = number[at.drop_null().to_numpy()]
    order = np.argsort(t, kind="stable")
    mine, t = mine[order], t[order]
    size = (first[1:] - first[:-1])[mine]
    place = np.repeat(first[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    # Of one term, documents stand in order; of one number's terms they have to be put in order.
    rank = np.cumsum(np.diff(t, prepend=t[:1]) != 0)
    key = np.repeat(rank, size) * len(own) + own[doc[place]]
    if (np.diff(key) < 0).any():
        bits = len(key).bit_length()
        if (int(rank[-1]) + 1) * len(own) < 1 << (63 - bits):
            key = np.sort(key << bits | np.arange(len(key)))
            key, order = key >> bits, key & ((1 << bits) - 1)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        place = place[order]
    tf = tf.reshape(-1, fields)[place][:, use].sum(1, dtype=np.int64)
    length = length.reshape(-1, fields)[:, use].sum(1, dtype=np.int64)[doc[place]]
    keep = tf > 0
    if gone := b.column("gone")[row].as_py():
        keep &= ~np.isin(key % len(own), gone)
    if not keep.all():
        key, tf, length = key[keep], tf[keep], length[keep]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    if len(begin) < len(key):  # terms of one stem, rows of one path
        key, tf, length = key[begin], np.add.reduceat(tf, begin), np.maximum.reduceat(length, begin)
    numbers = t[np.flatnonzero(np.diff(rank, prepend=-1))]
    t, doc = numbers[key // max(len(own), 1)], key % max(len(own), 1)
    return t, doc, tf, length


def _having(fields: int, use: list[int]):
    """How many documents of a task's blocks have each number's terms."""

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for row in range(len(b)):
                t, *_ = _asked_in(b, row, b.column("v_terms")[row].values, np.frombuffer(b.column("v_t")[row].as_py(), np.int64), fields, use)
                held.append(np.unique(t, return_counts=True))
                if sum(len(x) for x, _ in held[1:]) > max(1 << 20, len(held[0][0])):
                    held = [_summed(held)]
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _summed(held))), ["t", "df"])

    return run


def _summed(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    t, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    return t, np.bincount(at, np.concatenate([n for _, n in held]), len(t)).astype(np.int64)


def _question_blocks(batches):
    """Questions packed in blocks, as ``_blocks`` does, with the terms that they ask for and each one's place among their numbers."""
    for b in batches:
        for i, packed in zip(range(0, len(b), QUESTIONS), _blocks([b.select([0, 1, 2])]), strict=True):
            part = b.slice(i, QUESTIONS)
            t, lists = part.column(1).flatten().to_numpy(), part.column(3).flatten()
            _, first = np.unique(t, return_index=True)
            lists = lists.take(pa.array(first))
            slot = np.repeat(np.arange(len(first)), pc.list_value_length(lists).to_numpy()).astype(np.int64)
            terms = lists.flatten()
            yield pa.RecordBatch.from_arrays([*packed.columns, pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms), pa.array([slot.tobytes()], pa.binary())], [*packed.schema.names, "q_terms", "q_slot"])


def _answered(k: int, mean: float, fields: int, use: list[int]):
    """The k best of each question among the blocks of documents that a task has: given when it ends."""

    def run(batches):
        seen, ids = {}, Ids()
        for b in batches:
            for row in range(len(b)):
                read = lambda name, kind: np.frombuffer(b.column(name)[row].as_py(), kind)  # noqa: B023, E731
                paths, q_ids = b.column("paths")[row].values, b.column("q_ids")[row].values
                slot, doc, tf, length = _asked_in(b, row, b.column("q_terms")[row].values, read("q_slot", np.int64), fields, use)
                asked = read("q_t", np.int64)
                mine = np.searchsorted(np.unique(asked), asked)
                ok = np.ones(len(paths), bool)
                if "may" in b.schema.names:
                    ok[:] = False
                    ok[np.array(b.column("may")[row].as_py() or [], np.int64)] = True
                best = _kept_for(seen, b.column("q_no")[row].as_py(), q_ids, k, ids)
                _score(best, ids.add(b.column("no")[row].as_py(), paths), len(paths), doc, _weight(tf, length, mean), ok, read("q_at", np.int64), (np.searchsorted(slot, mine), np.searchsorted(slot, mine, "right")), read("q_idf", np.float64))
        for q_ids, best in seen.values():
            yield from best.listed(q_ids, ["query_id", "path", "score"])

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "path"))).filter(F.col("rank") <= k)


def _idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _occurrences(unit: Unit, place: dict[str, Column], start: dict[str, Column]) -> Column:
    """How often a unit occurs in a document, from the places of its words."""
    if unit.kind == "prefix":
        return start[unit.words[0]]
    first = place[unit.words[0]]
    if unit.kind == "near":
        other = place[unit.words[1]]
        shifted = [F.transform(other, _moved(d)) for d in range(-unit.gap - 1, unit.gap + 2) if d]
        return F.size(F.array_intersect(first, F.flatten(F.array(*shifted))))
    for i, w in enumerate(unit.words[1:], 1):
        first = F.array_intersect(first, F.transform(place[w], _moved(-i)))
    return F.size(first)
