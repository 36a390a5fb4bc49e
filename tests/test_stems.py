"""Stems and folded words against the full-text module of sqlite3, and search by stems against brute force."""

import math
import random
import re
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkweave.functions import porter, words as W
from inkweave.operators.inverted import Index
from inkweave.operators.text import K1, B

TEXTS = ["Running runners RUN easily", "the Café, cafés and ÉLAN", "possibly technology: run", "", None, "élan vital ran runs run", "naïve naive NAÏVETÉ 日本 straße", "easy easier"]


def module(tokenizer, rows):
    c = sqlite3.connect(":memory:")
    try:
        c.execute(f"CREATE VIRTUAL TABLE f USING fts5(b, tokenize='{tokenizer}')")
        c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    c.executemany("INSERT INTO f(rowid, b) VALUES (?, ?)", list(enumerate(rows, 1)))
    out = {i: [] for i in range(len(rows))}
    for term, doc, _ in sorted(c.execute("SELECT term, doc, offset FROM v"), key=lambda r: r[2]):
        out[doc - 1].append(term)
    return out


def test_stems_are_the_modules():
    rng, suffixes = random.Random(2), [*porter.STEP_2, *porter.STEP_3, *porter.STEP_4, "s", "sses", "ies", "ed", "eed", "ing", "y", "ll", "e", "es", "ss", ""]
    some = sorted({"".join(rng.choice("abeioytlszwx") for _ in range(rng.randint(0, 6))) + rng.choice(suffixes) + rng.choice(suffixes + [""] * 20) for _ in range(20_000)} - {""})
    some += ["a" * 65 + "ing", "running", "technology", "éding", "x" * 61 + "ing", "x" * 62 + "ing"]
    want = module("porter unicode61 remove_diacritics 0", some)
    assert [porter.stem(w) for w in some] == [want[i][0] for i in range(len(some))]


def test_words_are_the_modules(spark):
    rows = [t or "" for t in TEXTS] + ["áb ΣΑΣ ÅÄÖ ñandú½ x_y ¿qué? ١٢", "́ lone"]
    want = module("unicode61 remove_diacritics 2", rows)
    got = {r.i: list(r.w) for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", W.words(F.col("t")).alias("w")).collect()}
    assert got == want


def brute(texts, questions, k):
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
    bag = {p: [porter.stem(w) for w in re.findall(r"[^\W_]+", fold(t or ""))] for p, t in texts.items()}
    mean, n, out = sum(map(len, bag.values())) / len(bag), len(bag), {}
    for q, terms in questions.items():
        score = {}
        for s in {porter.stem(t) for t in terms}:
            df = sum(s in b for b in bag.values())
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
            for p, b in bag.items():
                if tf := b.count(s):
                    score[p] = score.get(p, 0) - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(b) / mean))
        for i, (s, p) in enumerate(sorted((round(s, 6), p) for p, s in score.items())[:k], 1):
            out[q, p] = (s, i)
    return out


def test_search_by_stems_equals_brute_force_and_follows_upserts(spark, tmp_path):
    docs = {f"d{i}": t for i, t in enumerate(TEXTS * 2)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    questions = {1: ["run", "runs", "easily"], 2: ["cafe", "elan"], 3: ["absent"], 4: ["technologies", "possible", "naive"]}
    asked = spark.createDataFrame([(q, t) for q, ts in questions.items() for t in ts], "query_id int, term string")

    def answers(index):
        return {(r.query_id, r.path): (r.score, r["rank"]) for r in index.best(asked, 4, stemmed=True).collect()}

    def close(got, want):
        return got.keys() == want.keys() and all(got[k][1] == w[1] and abs(got[k][0] - w[0]) < 2e-6 for k, w in want.items())

    index = Index(spark, str(tmp_path / "i"), parts=4, cut=W.words, stemmed=True).upsert(frame(docs))
    assert close(answers(index), brute(docs, questions, 4))
    change = {"d1": "runner Technologie running", "d20": "cafés naïvely"}
    index.upsert(frame(change), frame({"d0": "x"}))
    docs = {k: v for k, v in (docs | change).items() if k != "d0"}
    assert close(answers(index), brute(docs, questions, 4))
    terms = [r.term for r in index.stems().collect()]
    assert len(terms) == len(set(terms)) and {"technologie", "naively"} < set(terms)
    index.compact()
    assert close(answers(index), brute(docs, questions, 4))
    assert {r.term: r.stem for r in index.stems().collect()} == {r.term: porter.stem(r.term) for r in index.postings().collect()}
    assert index.best(asked.limit(0), 4, stemmed=True).count() == 0
