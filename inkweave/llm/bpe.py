"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

For each pre-token an Aho-Corasick automaton gives the longest vocabulary entry that starts at each byte.  The encoder
walks from left to right: it takes the longest entry that is compatible with the one before it, falls back to shorter
prefixes, and backtracks when none fits; a bit for each position remembers dead ends, so each position is left at most
once for each entry length.  Two neighbours are compatible exactly when merging their joint bytes would give these two
entries; a table remembers each pair.  A sequence whose neighbours are all compatible is the one that the merges give.

Decoding gathers the bytes of all ids of a batch from one flat byte table by offsets.

Defined results: a null text encodes to no ids; the special tokens of the file match in the text before anything else,
as the tokenizers library does by default; rows are independent, so ties, repeated rows and clashing columns need no rule.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkweave.llm.common import tidy

#: Fixed value: the pattern that cuts a text into pre-tokens in byte-level vocabularies.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens, and pairs of entries, remembered by a Python worker; beyond, it starts anew.
REMEMBERED = 300_000
#: A pre-token longer than this is not remembered.
LONGEST_REMEMBERED = 32
#: The same cut in the syntax of re, which is faster; it holds for texts without the characters of ODD, among which are
#: all that re counts as letters or white space and Unicode does not.
QUICK = r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
ODD = "[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0900-\U0010ffff]"


def _visible_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Remembered(dict):
    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece.encode())
        if len(piece) <= LONGEST_REMEMBERED:
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes with one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], _visible_bytes()
        raw = lambda token: bytes(byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of = {i: raw(t) for t, i in model["vocab"].items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(bytes_of) + 1
        self.bytes_of = [bytes_of.get(i, b"") for i in range(size)]
        ids = {b: i for i, b in enumerate(self.bytes_of) if b and i not in self.special.values()}
        self.length = [len(b) for b in self.bytes_of]
        # A merge's rank orders merges; single bytes have none.  joins: (left, right) -> (rank, id); parts: the inverse.
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            a, b, c = ids[left], ids[right], ids[left + right]
            self.joins[a, b] = (rank, c)
            self.parts.setdefault(c, (rank, a, b))
        self.shorter: list[int] = [-1] * size  # the longest proper prefix that is an entry
        self.finder = ahocorasick.Automaton()
        for b, i in ids.items():
            self.finder.add_word(b.decode("latin-1"), i)
            self.shorter[i] = next((ids[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ids), -1)
        self.finder.make_automaton()
        self.ids = ids
        self.fits: dict[tuple[int, int], bool] = {}
        self.known = _Remembered(self.encode_piece)
        self.cut, self.quick, self.odd = regex.compile(PRE_TOKENS), re.compile(QUICK), re.compile(ODD)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.starts = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of the joint bytes leave exactly these two entries.

        The merge that joins across the border, or ends it, is found by undoing merges from the border outwards, latest
        first: an inner pair across the border with a lower rank than what has been undone would have been merged.
        """
        a, b, undone, good = left, right, None, True
        while True:
            across = self.joins.get((a, b))
            # undone: (rank, side) of the merge undone last, which is the next to happen; at equal ranks the left goes first
            if across is not None and (undone is None or across[0] < undone[0] or across[0] == undone[0] and undone[1] == 1):
                good = False
                break
            of_a, of_b = self.parts.get(a), self.parts.get(b)
            if of_a is None and of_b is None:
                break
            if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                undone, a = (of_a[0], 0), of_a[2]
            else:
                undone, b = (of_b[0], 1), of_b[1]
        self.fits[left, right] = good
        return good

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.ids.get(piece)
        if whole is not None and (len(piece) == 1 or whole in self.parts):
            return (whole,)
        n, length, fits, shorter = len(piece), self.length, self.fits, self.shorter
        longest = [-1] * n
        for end, i in self.finder.iter(piece.decode("latin-1")):  # of the matches that start at a byte, the last is the longest
            longest[end + 1 - length[i]] = i
        alive, out, at, token, before = [True] * (n + 1), [], 0, longest[0], -1
        while at < n:
            while token >= 0:
                if alive[at + length[token]]:
                    if before < 0:
                        break
                    good = fits.get((before, token))
                    if self.compatible(before, token) if good is None else good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                before, token = token, longest[at] if at < n else -1
            else:
                alive[at] = False
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1
        return tuple(out)

    def _pieces(self, text: str) -> list[str]:
        return (self.cut if self.odd.search(text) else self.quick).findall(text)

    def encode(self, text: str) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        known = self.known.__getitem__
        if not self.marks or not self.marks.search(text):
            return list(chain.from_iterable(map(known, self._pieces(text))))
        out: list[int] = []
        at = 0
        for m in self.marks.finditer(text):
            out += chain.from_iterable(map(known, self._pieces(text[at : m.start()])))
            out.append(self.special[m[0]])
            at = m.end()
        return out + list(chain.from_iterable(map(known, self._pieces(text[at:]))))

    def decode(self, ids: np.ndarray) -> bytes:
        begin = self.starts[ids]
        length = self.starts[ids + 1] - begin
        end = np.cumsum(length)
        return self.flat[np.repeat(begin - (end - length), length) + np.arange(end[-1] if len(end) else 0)].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>): the encoded texts.  path: the vocabulary file, read by each Python worker."""
    path = path or default_path()

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = b.column("text")
            for i in range(len(b)):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), pa.array([c.encode(texts[i].as_py() or "")], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the decoded ids."""
    path = path or default_path()

    def run(batches):
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoding, then decoding what was encoded, in one pass."""
    path = path or default_path()

    def run(batches):
        c = codec(path)
        names = [str(i) for i in range(len(c.bytes_of))]
        for b in batches:
            n, first, second = [], [], []
            for text in b.column("text"):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                first.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                second.append(hashlib.sha256(c.decode(np.array(ids, np.int64)).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
