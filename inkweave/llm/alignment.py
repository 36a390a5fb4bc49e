"""Alignment of two tokenizers: which tokens of one end where tokens of the other end, and how often in the whole corpus.

Both vocabularies cut space + text into byte ranges.  Offsets where ranges of both end cut a text into groups; the two
tokens that end there are linked.  A link is one integer, ``b << 32 | a``.  Each task counts its links by sorting them
(np.unique); the partial counts are range-partitioned by key and sorted, equal keys next to one another are summed, and
each range is written as a shard of the count table: two plain files of sorted keys and of counts in the shared folder.
Lookups map these files into memory and search them by bisection, so a task needs memory for the pages that it touches and
nothing of the table is sent to anybody.  The driver sees one row for each shard and the highest count for each id of B,
which its vocabulary bounds.

Long texts are encoded in parts, cut at single spaces between two word characters: no pre-token of A goes on across such a
space and no entry of B has a space but in front (checked when the vocabularies are read), so the parts' tokens are the
whole text's.  A text without such a place is one part.

A is a byte-level vocabulary file of the tokenizers library, read into tiktoken, which gives the same ids about five times
as fast; that needs ids in the order of merges, which is checked too.

Defined results: a null or empty text, and one whose tokens do not spell space + text in either vocabulary, has no tokens:
zeros and an empty digest; an id that is null or repeated stays on its row, and such rows are counted one by one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.bpe import _visible_bytes, default_path
from inkweave.llm.common import octets, settle, shared_folder, tidy

#: Fixed value: the pattern that cuts a text into pre-tokens in byte-level vocabularies.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters encoded at once, about.
PART = 1 << 17
#: Links that a task gathers before it counts them, and distinct ones that it holds before it hands them on.
GATHERED, HELD = 1 << 20, 1 << 21
CUT = re.compile(r"(?<=\w) (?=\w)")

ALIGNED = "doc_id long, _row long, a array<int>, b array<int>, a_sizes array<int>, b_sizes array<int>, groups_sha256 string"
LINKED = "doc_id long, _row long, n_a long, n_b long, links binary, groups_sha256 string"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Strings:
    """Byte strings by number, gathered from one flat table."""

    def __init__(self, strings: list[bytes]) -> None:
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of these strings one after another, and where each ends."""
        length = self.length[which]
        end = np.cumsum(length)
        return self.flat[np.repeat(self.start[which] - (end - length), length) + np.arange(end[-1] if len(end) else 0)], end


@dataclass
class Aligned:
    """Tokens of a part of a text, and how many of them each group has."""

    a: np.ndarray
    b: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    written: bytes  # the groups, each with its semicolon

    def links(self) -> np.ndarray:
        """The key of each group's last tokens."""
        a, b = (ids[np.cumsum(sizes) - 1] for ids, sizes in ((self.a, self.a_sizes), (self.b, self.b_sizes)))
        return b << 32 | a


class Aligner:
    """Two vocabularies, their tokens' bytes, and their tokens' ids as text with what may follow them."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special, byte, model = {t["content"] for t in spec["added_tokens"]}, _visible_bytes(), spec["model"]
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of A are not in the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        of_a = {i: t for t, i in ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i).replace("▁", " ") for i in range(self.b.vocab_size())]
        if any(re.search("[^ ] ", p) for p in pieces):
            raise ValueError("B has entries with a space behind other characters")
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.encode() for i, p in enumerate(pieces)]
        size = max(of_a) + 1
        self.a_bytes, self.b_bytes = Strings([of_a.get(i, b"") for i in range(size)]), Strings(of_b)
        self.b_first = 2 * size
        self.written = Strings([f"{i}{c}".encode() for n, ends in ((size, ",|"), (len(of_b), ",;")) for i in range(n) for c in ends])

    def align(self, parts: list[str]) -> list[Aligned | None]:
        """The alignment of each part, None where tokens do not spell space + part."""
        a, b = [self.a.encode_ordinary(" " + p) for p in parts], self.b.encode(parts, num_threads=1)
        spelt = [b" " + p.encode() for p in parts]
        good = self._spell(a, b, spelt)
        if not all(good):
            rest = iter(self.align([p for p, g in zip(parts, good, strict=True) if g]) if any(good) else [])
            return [next(rest) if g else None for g in good]
        flat_a, flat_b = (np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids))) for ids in (a, b))
        end_a, end_b = np.cumsum(self.a_bytes.length[flat_a]), np.cumsum(self.b_bytes.length[flat_b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # Each token's place among the written ones: those of its own kind before it, and the other kind's groups before it.
        group_a, group_b = np.repeat(np.arange(len(ends)), size_a), np.repeat(np.arange(len(ends)), size_b)
        at_a = np.arange(len(flat_a)) + np.concatenate([[0], last_b[:-1] + 1])[group_a]
        at_b = np.arange(len(flat_b)) + last_a[group_b] + 1
        which = np.empty(len(flat_a) + len(flat_b), np.int64)
        which[at_a], which[at_b] = 2 * flat_a, self.b_first + 2 * flat_b
        which[at_a[last_a]] += 1
        which[at_b[last_b]] += 1
        text, text_end = self.written.gather(which)
        text, text_end = text.tobytes(), np.concatenate([[0], text_end])
        group = np.concatenate([[0], np.searchsorted(ends, np.cumsum([len(s) for s in spelt])) + 1])
        token_a, token_b = (np.concatenate([[0], np.cumsum([len(x) for x in ids])]) for ids in (a, b))
        out = []
        for k in range(len(parts)):
            (g, h), (i, j), (x, y) = group[k : k + 2], token_a[k : k + 2], token_b[k : k + 2]
            out.append(Aligned(flat_a[i:j], flat_b[x:y], size_a[g:h], size_b[g:h], text[text_end[i + x] : text_end[j + y]]))
        return out

    def _spell(self, a: list[list[int]], b: list[list[int]], spelt: list[bytes]) -> list[bool]:
        whole = b"".join(spelt)
        same = [table.gather(np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids))))[0].tobytes() == whole for table, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        if all(same):
            return [True] * len(spelt)
        return [all(table.gather(np.array(x, np.int64))[0].tobytes() == s for table, x in ((self.a_bytes, i), (self.b_bytes, j))) for i, j, s in zip(a, b, spelt, strict=True)]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each pair of files and Python worker."""
    return Aligner(a_path, b_path)


def parts_of(text: str) -> list[str]:
    """The text in parts of about PART characters; the spaces between them, which both encoders put in front, are left out."""
    out, at = [], 0
    while len(text) - at > PART and (cut := CUT.search(text, at + PART)):
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def _blocks(lengths: np.ndarray):
    """(first row, end row) of runs of rows of about PART bytes."""
    first, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > PART:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(lengths):
        yield first, len(lengths)


def _aligned(batches, tool: Aligner):
    """Lists of (doc_id, _row, alignment or None, digest or None) for batches with text, doc_id and _row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
        for first, end in _blocks(lengths):
            texts, ids, keys = (c.slice(first, end - first).to_pylist() for c in batch.columns)
            if len(texts) == 1 and texts[0] and len(texts[0]) > PART:
                found = []
                for part in parts_of(texts[0]):
                    if (got := tool.align([part])[0]) is None:
                        found = []
                        break
                    found.append(got)
                digest = hashlib.sha256()
                for k, part in enumerate(found):
                    digest.update(part.written if k + 1 < len(found) else part.written[:-1])
                    yield [(ids[0], keys[0], part, digest.hexdigest() if k + 1 == len(found) else None)]
                if not found:
                    yield [(ids[0], keys[0], None, "")]
                continue
            full = [i for i, t in enumerate(texts) if t]
            got = dict(zip(full, tool.align([texts[i] for i in full]), strict=True)) if full else {}
            yield [(ids[i], keys[i], x := got.get(i), hashlib.sha256(x.written[:-1]).hexdigest() if x else "") for i in range(len(texts))]


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).withColumn("_row", F.monotonically_increasing_id())


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, _row, a, b (ids), a_sizes, b_sizes (tokens of each group), groups_sha256.

    A row of docs, which has a ``_row`` of its own, is one row here for each part of its text, in order; the last one has
    the digest of all groups.
    """
    a_path, b_path = a_path or default_path(), b_path or piece_path()
    names = ("a", "b", "a_sizes", "b_sizes")

    def run(batches):
        for rows in _aligned(batches, aligner(a_path, b_path)):
            lists = [pa.array([getattr(x, c).tolist() if x else [] for _, _, x, _ in rows], pa.list_(pa.int32())) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *lists, pa.array([r[3] for r in rows], pa.string())], ["doc_id", "_row", *names, "groups_sha256"])

    return _numbered(docs).mapInArrow(tidy(run), ALIGNED)


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, _row, n_a, n_b, links (keys, eight bytes each), groups_sha256 for the same rows as ``align``: written once."""
    a_path, b_path = a_path or default_path(), b_path or piece_path()

    def run(batches):
        for rows in _aligned(batches, aligner(a_path, b_path)):
            ids, keys, n_a, n_b = (pa.array(v, pa.int64()) for v in ([r[0] for r in rows], [r[1] for r in rows], *([len(getattr(r[2], c)) if r[2] else 0 for r in rows] for c in "ab")))
            links = pa.array([r[2].links().tobytes() if r[2] else b"" for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, keys, n_a, n_b, links, pa.array([r[3] for r in rows], pa.string())], ["doc_id", "_row", "n_a", "n_b", "links", "groups_sha256"])

    return settle(_numbered(docs).mapInArrow(tidy(run), LINKED))


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all links of the rows, and how many each row has."""
    raw, at = octets(batch.column("links"))
    return np.frombuffer(raw, np.int64), np.diff(at) // 8


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(rows: DataFrame) -> DataFrame:
    """key, n: links with each key that a task has seen; a key has a row for each task or more."""

    def run(batches):
        waiting, size = [], 0
        keys = counts = np.zeros(0, np.int64)

        def settled():
            fresh, times = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (keys[:0], counts[:0])
            return _summed(np.concatenate([keys, fresh]), np.concatenate([counts, times.astype(np.int64)]))

        def counted():
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(counts[i : i + 100_000])], ["key", "n"])

        for batch in batches:
            found, _ = _links(batch)
            waiting.append(found)
            size += len(found)
            if size > GATHERED:
                keys, counts = settled()
                waiting, size = [], 0
                if len(keys) > HELD:
                    yield from counted()
                    keys = counts = np.zeros(0, np.int64)
        keys, counts = settled()
        yield from counted()

    return rows.select("links").mapInArrow(tidy(run), "key long, n long")


@dataclass
class CountTable:
    """Shards of sorted keys with their counts, files in ``folder``, and the highest count for each id of B."""

    folder: str
    names: list[str]
    sizes: list[int]
    first: np.ndarray
    highest: np.ndarray

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys of the table."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        shard = np.searchsorted(self.first, distinct, side="right") - 1
        for k in np.unique(shard):
            own = np.flatnonzero(shard == k)
            sorted_keys, n = (_mapped(f"{self.folder}/{self.names[k]}.{part}", self.sizes[k]) for part in ("keys", "counts"))
            out[own] = n[np.searchsorted(sorted_keys, distinct[own])]
        return out[back]


def _at(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


@cache
def _mapped(uri: str, n: int) -> np.ndarray:
    """A file of n longs mapped into memory; one on a remote file system by way of a copy that has no name any more."""
    fs, path = _at(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(path, np.int64, "r", shape=(n,))
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, np.int64, "r", shape=(n,))


def count_table(partial: DataFrame) -> CountTable:
    """Range-partitions and sorts partial counts, sums equal keys and writes the shards.

    A task that runs twice writes under another name; only the names that Spark returns are used.
    """
    spark = partial.sparkSession
    folder = f"{shared_folder(spark)}/inkweave-{uuid.uuid4().hex}"

    def run(batches):
        name = uuid.uuid4().hex
        fs, path = _at(f"{folder}/{name}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        size, first, ids, most = 0, None, [], []
        carry = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        with fs.open_output_stream(f"{path}.keys") as to_keys, fs.open_output_stream(f"{path}.counts") as to_counts:

            def write(keys, counts):
                nonlocal size, first
                if len(keys):
                    size, first = size + len(keys), int(keys[0]) if first is None else first
                    to_keys.write(keys.tobytes())
                    to_counts.write(counts.tobytes())
                    b = keys >> 32
                    start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                    ids.append(b[start])
                    most.append(np.maximum.reduceat(counts, start))

            for batch in batches:
                keys, counts = _summed(*(np.concatenate([c, batch.column(k).to_numpy(zero_copy_only=False)]) for k, c in enumerate(carry)))
                write(keys[:-1], counts[:-1])
                carry = (keys[-1:], counts[-1:])  # its sum may go on in the next batch
            write(*carry)
        if size:
            ids, most = np.concatenate(ids), np.concatenate(most)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([first]), pa.array([ids]), pa.array([most])], ["name", "size", "first", "ids", "most"])

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = settle(partial).repartitionByRange(shards, "key").sortWithinPartitions("key")
    found = sorted(ordered.mapInArrow(tidy(run), "name string, size long, first long, ids array<long>, most array<long>").collect(), key=lambda r: r["first"])
    highest = np.zeros(max((max(r["ids"]) for r in found), default=0) + 1, np.int64)
    for r in found:
        np.maximum.at(highest, np.array(r["ids"], np.int64), np.array(r["most"], np.int64))
    return CountTable(folder, [r["name"] for r in found], [r["size"] for r in found], np.array([r["first"] for r in found], np.int64), highest)


def digests(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs."""
    rows = linked(docs, a_path, b_path)
    table = count_table(pair_counts(rows))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def run(batches):
        for batch in batches:
            keys, links = _links(batch)
            counts = table.counts(keys) if len(keys) else keys
            best = counts == table.highest[keys >> 32] if len(keys) else keys
            upto = lambda v: np.concatenate([[0], np.cumsum(v)])
            end = upto(links)
            own = lambda v: np.diff(upto(v)[end])
            columns = [pa.array(np.asarray(v, np.int64)) for v in (links, links, own(best), own(counts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "_row", "n_a", "n_b")), *columns, batch.column("groups_sha256")], ["doc_id", "_row", *names, "groups_sha256"])

    parts = rows.mapInArrow(tidy(run), f"doc_id long, _row long, {', '.join(f'{c} long' for c in names)}, groups_sha256 string")
    return parts.groupBy("_row", "doc_id").agg(*(F.sum(c).alias(c) for c in names), F.max("groups_sha256").alias("groups_sha256")).drop("_row")
