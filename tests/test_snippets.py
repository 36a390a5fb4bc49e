"""Snippets against the full-text module of sqlite3, whose rules they follow."""

import random
import sqlite3

import pytest

from inkweave.operators import inverted as I
from inkweave.operators.snippets import snippets


def fts(texts, match, size):
    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE f USING fts5(body, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    c.executemany("INSERT INTO f(rowid, body) VALUES (?, ?)", list(enumerate(texts, 1)))
    return dict(c.execute(f"SELECT rowid - 1, snippet(f, 0, '[', ']', '...', {size}) FROM f WHERE f MATCH ?", (match,)))


def texts(rng, stock, n):
    return ["".join(rng.choice(stock) + rng.choice([" ", " ", " ", ", ", ". ", ".\n", ": ", "-", ".x "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("size", [10, 4])
@pytest.mark.parametrize(
    "units, match",
    [
        ([I.word("fox"), I.word("lazy"), I.word("cafe")], "fox OR lazy OR cafe"),
        ([I.prefix("la"), I.word("fox")], "la* OR fox"),
        ([I.phrase("red", "fox"), I.word("lazy")], '"red fox" OR lazy'),
        ([I.phrase("red", "red"), I.phrase("red", "fox")], '"red red" OR "red fox"'),
    ],
)
def test_same_as_full_text_module(spark, units, match, size):
    rng = random.Random(size)
    rows = texts(rng, ["Fox", "fox", "LAZY", "café", "Cafe", "red", "red", "red", "lamp"] + [f"w{i}" for i in range(25)] + ["straße", "élan", "日本"], 300)
    rows += ["", "fox", "...fox!", "a b c d e f g h i j k l fox", "fox " * 40, "one two. " * 30 + "lazy fox"]
    want = fts(rows, match, size)
    got = {r.path: r.snippet for r in snippets(spark.createDataFrame(list(enumerate(rows)), "path int, text string"), units, size=size).collect()}
    assert len(want) > 50
    assert {k: got[k] for k in want} == want
    assert all("[" not in s for k, s in got.items() if k not in want)


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "...", "x"), (4, "a b", "x"), (4, "a b", "y")]
    frame = spark.createDataFrame(rows, "path int, text string, _w string")
    got = sorted((r.path, r.snippet) for r in snippets(frame, [I.word("b")]).collect())
    assert got == [(1, ""), (2, ""), (3, "..."), (4, "a [b]"), (4, "a [b]")]
    assert snippets(frame.limit(0), [I.word("b")]).count() == 0
    long = "word. fox " * 100_000 + "lazy fox"
    assert snippets(spark.createDataFrame([(1, long)], "path int, text string"), [I.word("fox"), I.word("lazy")]).first().snippet.endswith("[lazy] [fox]")
