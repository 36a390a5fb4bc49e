"""Cross-entropy difference: two n-gram models over one vocabulary score every document.

Words are runs of non-space bytes, A-Z lower-cased; words and pairs of neighbours are counted apart by 64-bit
fingerprints, so the models grow with the corpus and no two words share a count but by a fingerprint's accident.  Both
models use the same vocabulary (the corpus's distinct words), smoothing and order, so their losses are comparable.  The
background counts cover every document, the target counts every document of the target.

The documents are dealt once into batches of about ``BATCH`` bytes.  A batch counts its distinct words, contexts and
pairs and sends them, sorted and packed, to ranges of keys; a range adds up the counts of all batches and answers each
of them with the sums of its keys, in their order, and the batch scores its documents with them.  A key is sent once a
batch however common it is, and the number of ranges grows with the corpus.  Nothing that stands for the vocabulary is
collected or broadcast: only its size and the two numbers of tokens are.  Fewer ``word_bits`` or ``pair_bits`` fold
words or pairs into that many classes.

The models are matched: the background's counts are scaled to as many tokens as the target has, so that the same prior
weighs as much in both.  A document is scored by what the others hold: its own counts are taken out of the background,
and out of the target where it is part of it.  So what only one document says is new to both models, and what another
one repeats is not.

The loss of a token is ``-log p(word | word before)``, where pair counts are backed by word counts (a Dirichlet prior of
``prior`` tokens).  A document's score is its mean loss under the target less that under the background: low is like
the target.

Defined results: a null or empty text has 0 tokens and null losses and score; without any target document every target
probability is uniform; rows are scored one by one, so ties and repeated rows need no rule; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import mix, octets, pieces, settle, words

WORD_BITS, PAIR_BITS, PRIOR = 64, 64, 8.0
#: Bytes of text whose distinct words and pairs are looked up together; bytes of text for each range of keys; fewest ranges.
BATCH, RANGE, RANGES = 8 << 20, 32 << 20, 256


def token_classes(raw: np.ndarray, at: np.ndarray, word_bits: int, pair_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: its word's key, that of the one before it (a key of its own at a text's start), the pair's key; offsets of texts."""
    h, w = words(raw, at, lower=True)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    starts = w[:-1][w[:-1] < w[1:]]
    before[starts] = 0
    word = (h & np.uint64((1 << word_bits) - 1)).astype(np.int64)
    context = (before & np.uint64((1 << word_bits) - 1)).astype(np.int64)
    context[starts] = 1 << word_bits if word_bits < 63 else 0
    pair = (mix(before * np.uint64(0x9E3779B97F4A7C15) + h) & np.uint64((1 << pair_bits) - 1)).astype(np.int64)
    return word, context, pair, w


def _classes(column: pa.Array, word_bits: int, pair_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of words, contexts and pairs of all tokens of a column; number of tokens of each text."""
    raw, at = octets(column)
    parts = [token_classes(raw[at[i] : at[j]], at[i : j + 1] - at[i], word_bits, pair_bits) for i, j in pieces(at)]
    if not parts:
        return [np.zeros(0, np.int64)] * 3, np.zeros(0, np.int64)
    return [np.concatenate([p[k] for p in parts]) for k in range(3)], np.concatenate([np.diff(p[3]) for p in parts])


def _pack(raw: bytes | np.ndarray) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes, size: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, size, codec="zstd", asbytes=True), kind)


def _pack_keys(keys: list[np.ndarray]) -> bytes:
    """Sorted keys of each kind as differences, byte by byte, so that the leading zeros pack well."""
    steps = np.concatenate([np.diff(k, prepend=np.uint64(0)) for k in keys])
    return _pack(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_keys(packed: bytes, sizes: list[int]) -> list[np.ndarray]:
    steps = _unpack(packed, 8 * sum(sizes), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return [np.cumsum(s, dtype=np.uint64) for s in np.split(steps, np.cumsum(sizes)[:-1])]


def _counted(keys: np.ndarray, chosen: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each token's key stands among them, counts among all and among chosen tokens; offsets of the ranges."""
    found, where = np.unique(keys.view(np.uint64), return_inverse=True)
    n = np.stack([np.bincount(where, minlength=len(found)), np.bincount(where[chosen], minlength=len(found))])
    owner = ((found >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return found, where, n, np.searchsorted(owner, np.arange(ranges + 1, dtype=np.uint64))


def _texts(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


def deal(docs: DataFrame) -> DataFrame:
    """batch, size, texts: rows of docs (doc_id, text, target) packed by about BATCH bytes, or one longer text."""

    def run(batches):
        batch, options = TaskContext.get().partitionId() << 32, pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            _, at = octets(b.column("text"))
            for i, j in pieces(at, BATCH):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                    out.write_batch(b.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([int(at[j] - at[i])]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "size", "texts"])
                batch += 1

    return docs.select("doc_id", "text", "target").mapInArrow(run, "batch long, size long, texts binary")


def _keys_of(texts: pa.RecordBatch, word_bits: int, pair_bits: int, ranges: int) -> tuple[list, np.ndarray]:
    """What _counted gives for words, contexts and pairs; number of tokens of each text."""
    keys, n = _classes(texts.column("text"), word_bits, pair_bits)
    chosen = np.repeat(texts.column("target").fill_null(False).to_numpy(zero_copy_only=False), n)
    return [_counted(k, chosen, ranges) for k in keys], n


def counts(dealt: DataFrame, word_bits: int, pair_bits: int, ranges: int) -> DataFrame:
    """range, batch, sizes (of words, contexts, pairs), keys, n: each batch's keys and counts, packed, by range of keys."""

    def run(batches):
        for b in batches:
            for k in range(len(b)):
                of, _ = _keys_of(_texts(b.column("texts")[k].as_py()), word_bits, pair_bits, ranges)
                rows = []
                for r in range(ranges):
                    cut = [slice(at[r], at[r + 1]) for *_, at in of]
                    sizes = [int(c.stop - c.start) for c in cut]
                    if sum(sizes):
                        n = np.concatenate([of[i][2][:, c] for i, c in enumerate(cut)], axis=1).astype(np.uint32)
                        rows.append((r, b.column("batch")[k].as_py(), sizes, _pack_keys([of[i][0][c] for i, c in enumerate(cut)]), _pack(n.tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary()), strict=True)], ["range", "batch", "sizes", "keys", "n"])

    return dealt.select("batch", "texts").mapInArrow(run, "range int, batch long, sizes array<int>, keys binary, n binary")


def sums(counted: DataFrame) -> DataFrame:
    """range, batch, n (the corpus's counts of the keys that the batch sent to the range), and once a range: words, tokens, target_tokens."""

    def run(t: pa.Table) -> pa.Table:
        sizes = t.column("sizes").to_pylist()
        keys = [_unpack_keys(k.as_py(), s) for k, s in zip(t.column("keys"), sizes, strict=True)]
        own = [_unpack(n.as_py(), 8 * sum(s), np.uint32).reshape(2, -1) for n, s in zip(t.column("n"), sizes, strict=True)]
        own = [np.split(n, np.cumsum(s)[:-1], axis=1) for n, s in zip(own, sizes, strict=True)]
        answers, figures = [[] for _ in keys], None
        for kind in range(3):
            found, where = np.unique(np.concatenate([k[kind] for k in keys]), return_inverse=True)
            # Sums of whole numbers below 2**53, so exact as doubles.
            total = np.stack([np.bincount(where, np.concatenate([n[kind][m] for n in own]), len(found)) for m in (0, 1)]).astype(np.int64)
            for answer, w in zip(answers, np.split(where, np.cumsum([s[kind] for s in sizes])[:-1]), strict=True):
                answer.append(total[:, w])
            if kind == 0:
                figures = [len(found), *map(int, total.sum(axis=1))]
        packed = [_pack(np.concatenate(a, axis=1).tobytes()) for a in answers]
        once = [pa.array([f] + [0] * (len(keys) - 1), pa.int64()) for f in figures]
        return pa.Table.from_arrays([t.column("range"), t.column("batch"), pa.array(packed, pa.binary()), *once], ["range", "batch", "n", "words", "tokens", "target_tokens"])

    return counted.groupBy("range").applyInArrow(run, "range int, batch long, n binary, words long, tokens long, target_tokens long")


def losses(of_word: np.ndarray, of_context: np.ndarray, of_pair: np.ndarray, tokens: np.ndarray, n_words: int, prior: float) -> np.ndarray:
    """-log p of tokens under one model: counts of their words, contexts and pairs; the model's tokens and words."""
    p1 = (of_word + 0.5) / (tokens + 0.5 * n_words)
    return -np.log((np.minimum(of_pair, of_context) + prior * p1) / (of_context + prior))


def scores(docs: DataFrame, target_ids: DataFrame, word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS, prior: float = PRIOR) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of docs.  target_ids: column doc_id."""
    chosen = target_ids.select("doc_id").filter("doc_id is not null").distinct().withColumn("target", F.lit(True))
    # The hint keeps one plan at every size: a broadcast side would grow with the labels.
    dealt = settle(deal(docs.select("doc_id", "text").join(chosen.hint("merge"), "doc_id", "left")))
    ranges = max(RANGES, -(-(dealt.agg(F.sum("size")).first()[0] or 0) // RANGE))
    answers = settle(sums(counts(dealt, word_bits, pair_bits, ranges)))
    n_words, *tokens = (x or 0 for x in answers.agg(F.sum("words"), F.sum("tokens"), F.sum("target_tokens")).first())
    if word_bits < 63:
        n_words = 1 << word_bits
    matched = tokens[1] / tokens[0] if tokens[1] else 1.0
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, target_loss double, background_loss double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _texts(left.column("texts")[0].as_py())
        of, n = _keys_of(texts, word_bits, pair_bits, ranges)
        corpus = [np.zeros_like(c) for _, _, c, _ in of]
        for r, packed in zip(right.column("range").to_pylist(), right.column("n"), strict=True):
            cut = [slice(at[r], at[r + 1]) for *_, at in of]
            sizes = [c.stop - c.start for c in cut]
            got = np.split(_unpack(packed.as_py(), 16 * int(sum(sizes)), np.int64).reshape(2, -1), np.cumsum(sizes)[:-1], axis=1)
            for c, s, g in zip(corpus, cut, got, strict=True):
                c[:, s] = g
        row = np.repeat(np.arange(len(n)), n)
        in_target = texts.column("target").fill_null(False).to_numpy(zero_copy_only=False)
        own = []
        for found, where, *_ in of:
            _, at, often = np.unique(row * max(1, len(found)) + where, return_inverse=True, return_counts=True)
            own.append(often[at])
        means = []
        for m, part, scale in ((0, np.ones(len(n)), matched), (1, in_target.astype(float), 1.0)):
            seen = [(c[m][of[k][1]] - own[k] * part[row]) * scale for k, c in enumerate(corpus)]
            means.append(np.bincount(row, losses(*seen, ((tokens[m] - n * part) * scale)[row], n_words, prior), len(n)) / np.maximum(n, 1))
        background, target = means
        columns = [pa.array(x, pa.float64(), mask=n == 0) for x in (target, background, target - background)]
        return pa.Table.from_arrays([texts.column("doc_id"), pa.array(n, pa.int64()), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    back = answers.select("batch", "range", "n")
    return dealt.select("batch", "texts").groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(run, schema)
