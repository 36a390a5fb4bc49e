"""Alignment of two tokenizers against a brute-force version with the libraries themselves."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from inkweave.llm import alignment
from inkweave.llm.bpe import _visible_bytes, default_path

SCHEMA = "doc_id long, text string, a int, b string, _row int, n_a string, key int"
WORDS = "the quick brown Füchse 漢字かな привет don't 1234 <|endoftext|> <s> </s> x_y 🙂 naïve\tTab\n\n  spaces   end .".split(" ")


def some_rows(n, seed=3):
    rng = np.random.default_rng(seed)
    out = [(i, " ".join(WORDS[int(k)] for k in rng.integers(0, len(WORDS), int(rng.integers(1, 30))))) for i in range(n)]
    return [*out, (None, None), (100, ""), (100, "again"), (100, "again"), (None, "again"), (101, " "), (102, "\n"), (103, "has ▁ in it"), (104, "ends "), (105, "nul \x00 é é"), (106, "<0x41><unk>")]


def brute(rows):
    """The result row by row with both libraries, byte offsets and lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())
    byte = _visible_bytes()
    of_a = {i: bytes(byte.get(c, 0) for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) and b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.vocab_size()) for p in [b.id_to_piece(i)]]
    found = []
    for i, t in rows:
        groups, ids = [], ([], [])
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            if any(b"".join(of[k] for k in x) != (" " + t).encode() for x, of in zip(ids, (of_a, of_b), strict=True)):
                ids = ([], [])
        ends = []
        for x, of in zip(ids, (of_a, of_b), strict=True):
            at, e = 0, []
            for k in x:
                at += len(of[k])
                e.append(at)
            ends.append(e)
        last, place = (0, 0), [{e: k + 1 for k, e in enumerate(side)} for side in ends]
        for end in sorted(set(ends[0]) & set(ends[1])):
            upto = place[0][end], place[1][end]
            groups.append((ids[0][last[0] : upto[0]], ids[1][last[1] : upto[1]]))
            last = upto
        found.append((i, ids, groups))
    count = Counter((x[-1], y[-1]) for *_, g in found for x, y in g)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = Counter()
    for i, (x, y), g in found:
        links = [(p[-1], q[-1]) for p, q in g]
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)
        out[i, len(x), len(y), len(g), len(links), sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if g else ""] += 1
    return out


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def result(docs):
    return Counter(tuple(r[c] for c in COLUMNS) for r in alignment.digests(docs).collect())


def test_equals_brute_force(spark):
    rows = some_rows(120)
    docs = spark.createDataFrame([(i, t, 1, "x", 2, "y", 3) for i, t in rows], SCHEMA).repartition(4)
    got = result(docs)
    assert got == brute(rows)
    assert got[103, 0, 0, 0, 0, 0, 0, ""] == 1


def test_long_texts_are_cut_where_tokens_end(spark, monkeypatch):
    rows = some_rows(6, 8)
    rows += [(200, " ".join(t for _, t in some_rows(400, 5) if t)), (201, "漢" * 3000), (202, ("word " * 300 + "▁ ") * 3)]
    monkeypatch.setattr(alignment, "PART", 500)
    tool = alignment.aligner(default_path(), alignment.piece_path())
    parts = alignment.parts_of(rows[-3][1])
    assert len(parts) > 20 and " ".join(parts) == rows[-3][1]
    whole = tool.align([rows[-3][1]])
    assert whole == [None]  # one of its texts has a character that B cannot spell
    clean = rows[-3][1].replace("▁", "")
    cut = [tool.align([p])[0] for p in alignment.parts_of(clean)]
    whole = tool.align([clean])[0]
    assert b"".join(p.written for p in cut) == whole.written and np.array_equal(np.concatenate([p.a for p in cut]), whole.a)


def test_very_long_text(spark):
    text = " ".join(t for _, t in some_rows(4000, 5) if t and "▁" not in t)
    assert len(text) > 2 * alignment.PART
    rows = [(1, text), (2, text + " ▁"), (3, "word")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_counts_beyond_what_a_task_holds(spark, monkeypatch):
    keys = np.array([5, 3, 5, 9, 3, 3], np.int64)
    assert [x.tolist() for x in alignment._summed(keys, np.ones(6, np.int64))] == [[3, 5, 9], [3, 2, 1]]
    partial = spark.createDataFrame([(int(k), 1) for k in range(0, 4000, 3) for _ in range(2)] + [(7 << 32 | 1, 5)], "key long, n long").repartition(6)
    table = alignment.count_table(partial)
    assert table.counts(np.array([3, 3999, 0, 7 << 32 | 1, 3])).tolist() == [2, 2, 2, 5, 2] and table.highest.tolist() == [2, 0, 0, 0, 0, 0, 0, 5]
    assert sum(table.sizes) == 1335


def test_empty(spark):
    assert alignment.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert result(spark.createDataFrame([(1, None)], "doc_id long, text string")) == Counter([(1, 0, 0, 0, 0, 0, 0, "")])


@pytest.mark.parametrize("text", ["", "a", "a b c"])
def test_parts_join(text):
    assert " ".join(alignment.parts_of(text)) == text
