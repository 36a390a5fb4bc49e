"""Each operator against a brute-force version or a round trip, on small frames with awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkweave.llm import bpe, exact, html, licences, lines, lm, minhash, mixing, rules, suffix
from inkweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, node string, bucket int, size int, key string, n int"
A = "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds watch from the wall"
B = A.replace("seven", "eight")
C = "\n".join(f"line number {i} of a longer text with its own words {i * i}" for i in range(12))
ROWS = [
    (1, A), (2, A), (2, A), (3, B), (4, None), (5, ""), (6, " \t\n"), (7, C), (8, C + "\nand one more line"), (None, A), (9, "short text"), (10, "short text"),
    (11, "é" * 70 + " ünï " + A + " 🙂"), (12, C.replace("number 5", "number five")), (13, A.upper()), (14, "spam " * 60), (15, "All rights reserved. CC-BY all rights reserved"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if i != 5 else None, "x", 1, 2, "y", 3) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ws(t):
    return WORD.findall(t or "")


def test_words_of_any_place_hash_alike():
    from inkweave.llm.common import words

    texts = [b"one two  one", b"", b"two\n"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    h, at = words(raw, np.array([0, 12, 12, 16]))
    assert list(at) == [0, 3, 3, 4] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_op1_measures(docs, empty):
    got = Counter(tuple(r) for r in rules.measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for i, t in ROWS:
        w = ws(t)
        runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often = Counter(runs)
        cover = {k + j for k, r in enumerate(runs) if often[r] > 1 for j in range(8)}
        full = [x for x in (t or "").split("\n") if ws(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), len(cover)] += 1
    assert got == want
    assert rules.measures(empty).count() == 0


def test_op1_learns_a_list(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 4 == 0, float(rng.uniform(0.5, 1) if i % 4 == 0 else rng.uniform(0, 0.4)), float(rng.uniform(0, 1))) for i in range(400)]
    found = rules.learn(spark.createDataFrame(rows, "doc_id long, bad boolean, x double, y double"), ["x", "y"])
    assert found and all(r["doc_id"] % 4 for r in spark.createDataFrame(rows, "doc_id long, bad boolean, x double, y double").filter(rules.verdict(found)).collect())


def test_op1_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id for r in rules.quality(docs, none).filter("kept").collect()} == {None, 1, 2, 3, 11, 13}


def brute_winnowed(rows):
    """(doc_id, text left) of each row by the definition: fingerprints, first places, matches extended both ways."""
    full = [[(k, x) for k, x in enumerate((t or "").split("\n")) if ws(x)] for _, t in rows]
    words_of = [[len(ws(x)) for _, x in f] for f in full]
    ids = [math.inf if i is None else i for i, _ in rows]

    def gram(r, p):
        m = 1 if words_of[r][p] >= 25 else 2
        return (m, hashlib.md5("\n".join(x for _, x in full[r][p : p + m]).encode()).hexdigest()) if p + m <= len(full[r]) else None

    picked = defaultdict(set)
    for r, c in enumerate(words_of):
        for p in range(len(c)):
            w = next((w for w in (1, 2) if p + w <= len(c) and sum(c[p : p + w]) >= 50), 3)
            if p + w <= len(c):
                inside = [(g[1], -q) for q in range(p, p + w) if (g := gram(r, q)) and q + g[0] <= p + w]
                picked[min(inside)[0]].add((ids[r], r, -min(inside)[1]))
    pairs = set()
    for places in picked.values():
        first = min(places)
        for i, r, p in places:
            before = [q for _, s, q in places if s == r and q < p]
            if before:
                pairs.add((r, r, p - max(before)))
            elif first[0] < i:
                pairs.add((r, first[1], p - first[2]))
    gone = defaultdict(set)
    for r, s, delta in pairs:
        run = []
        for p in range(len(full[r]) + 1):
            if p < len(full[r]) and 0 <= p - delta < len(full[s]) and full[r][p][1] == full[s][p - delta][1]:
                run.append(p)
            else:
                if len(run) >= 3 or sum(words_of[r][q] for q in run) >= 50:
                    gone[r] |= {full[r][q][0] for q in run}
                run = []
    return Counter((i, "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[r])) for r, (i, t) in enumerate(rows))


def test_op2_lines(docs, empty):
    out = lines.dedup_lines(docs)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == brute_winnowed(ROWS)
    assert set(docs.columns) < set(out.columns) and lines.digests(empty).count() == 0


def test_op2_random_texts(spark):
    rng = np.random.default_rng(6)
    pool = [" ".join(f"w{int(x)}" for x in rng.integers(0, 999, int(n))) for n in rng.integers(1, 40, 25)] + ["", " ", "a", "long " * 60]
    rows = []
    for i in range(150):
        x = [pool[int(k)] for k in rng.integers(0, len(pool), int(rng.integers(0, 14)))]
        if i % 3:
            at = int(rng.integers(0, 18))
            x[1:1] = pool[at : at + int(rng.integers(1, 8))]
        rows.append((i, "\n".join(x)))
    got = Counter((r.doc_id, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == brute_winnowed(rows)
    assert sum(len(t) for _, t in got) < 0.7 * sum(len(t) for _, t in rows)


def test_op2_matches_are_extended_both_ways(spark):
    """Two lines of 25 words or more, and runs of three short lines, around one shared fingerprint each."""
    long = [" ".join(f"{c}{i}" for i in range(26)) for c in "ab"]
    short = ["one", "two", "three", "four"]
    rows = [(1, "\n".join(["x", *long, "y"])), (2, "\n".join(["p", *long, "q"])), (3, "\n".join(["k", *short, "l"])), (4, "\n".join(["m", *short, "n"])), (5, "\n".join(["v", *short[:2], "u"]))]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2], got[4], got[5]) == ("p\nq", "m\nn", rows[4][1]) and got[1] == rows[0][1] and got[3] == rows[2][1]


def test_op2_whole_leaves_out_no_run(spark):
    """Against all runs of all rows, not the first place of each fingerprint: equal runs anywhere earlier go, whole."""
    rng = np.random.default_rng(16)
    pool = [" ".join(f"w{int(x)}" for x in rng.integers(0, 999, int(n))) for n in rng.integers(1, 40, 12)] + ["", " ", "a", "long " * 60, "b c"]
    rows = [(None if i % 17 == 5 else i // 2, "\n".join(pool[int(k)] for k in rng.integers(0, len(pool), int(rng.integers(0, 14))))) for i in range(90)] + [(500, None)]
    full = [[(k, x) for k, x in enumerate((t or "").split("\n")) if ws(x)] for _, t in rows]
    ids = [math.inf if i is None else i for i, _ in rows]
    places = defaultdict(set)
    for r, f in enumerate(full):
        for p in range(len(f)):
            for q in range(p + 1, len(f) + 1):
                if q - p >= 3 or sum(len(ws(x)) for _, x in f[p:q]) >= 50:
                    places[tuple(x for _, x in f[p:q])].add((ids[r], r, p))
    gone = defaultdict(set)
    for run, at in places.items():
        for i, r, p in at:
            if min(at)[0] < i or any(s == r and q < p for _, s, q in at):
                gone[r] |= {full[r][k][0] for k in range(p, p + len(run))}
    want = Counter((i, "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[r])) for r, (i, t) in enumerate(rows))
    got = Counter((r.doc_id, r.text or "") for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), whole=True).collect())
    assert got == want and want != brute_winnowed(rows)


def test_op2_many_null_ids_lose_nothing(spark):
    """Rows without an id: one is a copy of an earlier document, the others are unlike anything."""
    rows = [(1, C), (None, C), *((None, f"own {i}\nlines {i}\nof row {i}\nnumber {i}") for i in range(3000))]
    got = Counter(r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([C, "", *(t for _, t in rows[2:])])


def test_op3_mixing(docs, empty):
    rows = mixing.mix_report(docs).collect()
    assert Counter(rows) == Counter(mixing.mix_report(docs.repartition(5, "bucket", "text")).collect())
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, len(ws(t))) for i, t in ROWS)
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix_report(empty).count() == 0
    texts = mixing.mix_texts(docs).collect()
    assert sum(len(ws(r.text)) for r in texts) == sum(r.taken for r in rows)


def brute_targets(size, weight, passes=3.0):
    out, free, rest = [0.0] * len(size), set(range(len(size))), float(sum(size))
    while free:
        unit = rest / sum(weight[i] for i in free)
        full = {i for i in free if unit * weight[i] > passes * size[i]}
        for i in full or free:
            out[i] = float(passes * size[i]) if full else unit * weight[i]
        if not full:
            break
        rest -= sum(out[i] for i in full)
        free -= full
    return out


def test_op3_targets(spark):
    rng = np.random.default_rng(2)
    for sizes in ([100, 100, 100], [10, 1000], [0, 0], [5, 0, 7], [0], rng.integers(0, 10**6, 50).tolist(), [1, 10, 100, 1000, 10**6]):
        weight = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
        frame = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(zip(sizes, weight, strict=True))], "i long, source_size long, weight double")
        got = {r.i: r.target for r in mixing.with_targets(frame).collect()}
        assert [got[i] for i in range(len(sizes))] == pytest.approx(brute_targets(sizes, weight))
    i = np.arange(1000)
    assert sorted(mixing.permuted(i, np.full(1000, 1000), np.full(1000, 5))) == list(range(1000))


def test_op3_shards_are_drawn_apart():
    """Any range of shards is drawn alone, the ranges fit together, and counts are as even as a multinomial draw's."""
    whole = mixing.draw(1_000_000, 6, 0, 0, 17, 3)
    assert [d for p in range(8) for d in mixing.draw(1_000_000, 6, 3, p, 17, 3)] == whole
    ends = [f + n for _, f, n in whole]
    assert [f for _, f, _ in whole] == [0, *ends[:-1]] and ends[-1] == 1_000_000
    share = [n / 1_000_000 * 64 for _, _, n in whole]
    assert len(whole) == 64 and all(abs(x - 1) < 0.05 for x in share) and len(set(share)) > 32
    assert sum(n for _, _, n in mixing.draw(5, 6, 0, 0, 1, 1)) == 5 and mixing.draw(0, 6, 0, 0, 1, 1) == []


def test_op3_comes_near_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{j}" for j in range(int(rng.integers(1, 300)))), ["a", "b", "b", "b", "c", None][i % 6]) for i in range(1200)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    of = {i: s for i, _, s in rows}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[of[r.doc_id]] += r["size"]
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    order = sorted(size, key=lambda x: (x is None, x or ""))
    want = brute_targets([size[s] for s in order], [5.0, 2.0, 1.0, 5.0])
    for s, t in zip(order, want, strict=True):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 0.02 * t + 128


def test_op3_many_sources(spark):
    rows = [(i, "a b c d", f"s{i}") for i in range(3000)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 3000 and all(0 <= r.taken <= 12 and r.source_size == 4 for r in got)


def test_op3_one_id_in_two_sources(spark):
    """Rows of one doc_id keep their own source and columns, also with equal texts."""
    text = " ".join(f"w{i}" for i in range(640))
    docs = spark.createDataFrame([(5, text, "a", "en"), (5, text, "b", "fr"), (6, text, "c", "de")], "doc_id long, text string, source string, lang string")
    out = mixing.mix_texts(docs).collect()
    assert {(r.doc_id, r.source, r.lang) for r in out} == {(5, "a", "en"), (5, "b", "fr"), (6, "c", "de")}
    taken = Counter()
    for r in out:
        taken[r.source] += len(ws(r.text))
    # Two rows of one id have equal sizes; the report cannot tell them apart, their sum can.
    assert sum(r.taken for r in mixing.mix_report(docs).collect()) == sum(taken.values())


def brute_components(rows, k, percent):
    """(doc_id, n_shingles, component_id, kept) of each row, rows being linked one by one."""
    sets = []
    for _, t in rows:
        w = ws(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[x : x + k]) for x in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), math.inf), math.inf if d is None else d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if least[root(i)] == math.inf else least[root(i)]
        out.append((d, len(sets[i]), c, d == c))
    return Counter(out)


def near(docs, *how):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, *how).collect())


def test_op4_near_duplicates(docs, empty, spark):
    assert near(docs, 3, 85, 4, 20) == brute_components(ROWS, 3, 85)
    assert minhash.near_duplicates(empty).count() == 0
    one = [(i, t) for i, t in ROWS if i not in (None, 2)]
    assert near(spark.createDataFrame(one, "doc_id long, text string"), 3, 85, 4, 20) == brute_components(one, 3, 85)


def test_op4_one_row_of_each_component_stays(spark):
    """A repeated id with a copied and a unique text, repeated rows and null ids."""
    rows = [(1, A), (7, A), (7, C), (7, C), (8, None), (8, ""), (None, A), (None, "only this text " * 9), (None, "only this text " * 9), (0, "x y z " + A + " x y z q r s t u")]
    left = minhash.drop_near_duplicates(spark.createDataFrame([(*r, k, "z") for k, r in enumerate(rows)], "doc_id long, text string, node int, _row string")).collect()
    assert sorted(r.node for r in left)[:3] == [0, 2, 4] or sorted(r.node for r in left)[:3] == [0, 3, 4]
    assert Counter(r.text for r in left) == Counter([A, C, None, "", "only this text " * 9, rows[9][1]])
    assert all(r._row == "z" for r in left)


def test_op4_family_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        w = [f"w{j}" for j in range(120)]
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, 120))] = f"x{int(rng.integers(0, 10**6))}"
        rows.append((i, " ".join(w)))
    assert near(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 4, 20) == brute_components(rows, 3, 85)


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


def test_op5_lm(spark, docs, empty):
    target = spark.createDataFrame([(1,), (2,), (99,), (None,)], "doc_id long")
    rows = lm.scores(docs, target, 6, 8).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, len(ws(t))) for i, t in ROWS)
    assert all((r.score is None) == (r.n_tokens == 0) for r in rows)
    # Brute force over the same classes, token by token.
    from inkweave.llm.common import words

    def classes(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return list(zip(*(x.tolist() for x in lm.token_classes(raw, np.array([0, len(raw)]), 6, 8)[:3]), strict=True))

    assert words(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0].size == 0
    want = brute_losses([(i, classes(t)) for i, t in ROWS], {1, 2}, 64)
    for r in rows:
        assert r.n_tokens == 0 or any((r.target_loss, r.background_loss) == pytest.approx(w, abs=1e-9) for w in want[r.doc_id])
        assert r.n_tokens == 0 or r.score == pytest.approx(r.target_loss - r.background_loss)
    assert lm.scores(empty, target).count() == 0


def brute_losses(rows, target, n_words):
    """id: (target loss, background loss) of each row; rows: (id, (word, context, pair) of each token).  A row's own counts do not count."""
    counts = [[Counter() for _ in range(3)] for _ in range(2)]
    for i, tokens in rows:
        for t in tokens:
            for m in (0, 1) if i in target else (1,):
                for k in range(3):
                    counts[m][k][t[k]] += 1
    total = [sum(c[0].values()) for c in counts]
    out = defaultdict(list)
    for i, tokens in rows:
        own = [Counter(t[k] for t in tokens) for k in range(3)]
        loss = []
        for m, scale in ((0, 1.0), (1, total[0] / total[1] if total[0] else 1.0)):
            part = 1 if m or i in target else 0
            seen = lambda k, x: (counts[m][k][x] - part * own[k][x]) * scale  # noqa: B023, E731
            sum_ = 0.0
            for w, c, p in tokens:
                p1 = (seen(0, w) + 0.5) / ((total[m] - part * len(tokens)) * scale + 0.5 * n_words)
                sum_ -= math.log((min(seen(2, p), seen(1, c)) + lm.PRIOR * p1) / (seen(1, c) + lm.PRIOR))
            loss.append(sum_ / max(1, len(tokens)))
        out[i].append(tuple(loss))
    return out


def test_op5_counts_words_and_pairs_exactly(spark):
    """By words themselves, over more words and pairs than 2**16 and 2**18 classes tell apart; a text that occurs twice stands out."""
    rows = [(i, " ".join(f"w{(i * 997 + j * j) % 100_003}" for j in range(600)) + " the end") for i in range(600)]
    rows += [(1000, rows[3][1])]
    target = set(range(0, 600, 7))
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    tokens = [(i, [(w, c, (c, w)) for c, w in zip([None, *t.split()[:-1]], t.split(), strict=True)]) for i, t in rows]
    n_words, n_pairs = (len({t[k] for _, ts in tokens for t in ts}) for k in (0, 2))
    assert n_words > 1 << 16 and n_pairs > 1 << 18
    want = brute_losses(tokens, target, n_words)
    for r in got:
        assert (r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id][0], abs=1e-9)
    score = {r.doc_id: r.score for r in got}
    assert min(score[3], score[1000]) > max(x for i, x in score.items() if i not in (3, 1000))


def test_op5_clashing_columns(spark, docs):
    rows = docs.withColumn("target", F.lit("x")).withColumn("batch", F.lit(None).cast("int")).withColumn("size", F.lit(1))
    ids = spark.createDataFrame([(1, "x")], "doc_id long, target string")
    assert sorted(map(tuple, lm.scores(rows, ids).collect()), key=repr) == sorted(map(tuple, lm.scores(docs, ids).collect()), key=repr)


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), math.inf if i is None else i
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], math.inf))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (math.inf if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return want


@pytest.mark.parametrize("how", [{}, {"hot": 2}, {"bits": 3}, {"hot": 2, "bits": 2}, {"hot_all": 3}])
def test_op6_repeats(docs, empty, how):
    assert Counter(tuple(r) for r in suffix.remove_repeats(docs, **how).collect()) == brute_repeats(ROWS)
    assert suffix.remove_repeats(empty, **how).count() == 0


@pytest.mark.parametrize("how", [{}, {"bits": 4}, {"hot": 3}, {"hot_all": 5}])
def test_op6_random_texts(spark, how):
    """Texts of few letters, long shared stretches, periods, null ids: everything that hashes may confuse."""
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abé"), int(n))) for n in rng.integers(20, 300, 12)] + ["ab" * 80, "x" * 130]
    rows = [(None if i % 11 == 0 else i // 2 if i % 5 == 0 else i, "".join([pool[int(k)] for k in rng.integers(0, len(pool), int(rng.integers(0, 5)))] + list(rng.choice(list("cd"), int(rng.integers(0, 60)))))) for i in range(120)]
    got = Counter(tuple(r) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), **how).collect())
    assert got == brute_repeats(rows)


def test_op6_digit_passes():
    """The passes against sorting whole windows, through depths that are no multiple of a digit."""
    rng = np.random.default_rng(9)
    raw = np.concatenate([rng.integers(97, 99, 3000), rng.integers(0, 256, 500), np.full(200, 97)]).astype(np.uint8)
    start, eight = rng.integers(0, len(raw) - 60, 2000), suffix.eights(raw)
    least = rng.integers(0, 40, 2000)
    for depth in (1, 7, 8, 9, 16, 50):
        low = {}
        windows = [raw[s : s + depth].tobytes() for s in start]
        for w, x in zip(windows, least, strict=True):
            low[w] = min(low.get(w, 99), x)
        assert suffix.least_of_equals(start, least, eight, depth).tolist() == [low[w] for w in windows]


def test_op6_null_ids_keep_their_own(spark):
    """Many rows without an id: one is a copy of document 1, one is unlike anything, and loses nothing."""
    rows = [(1, A * 2), (None, A * 2), (None, "".join(chr(97 + i * i % 23) for i in range(148))), *((None, f"row {i}") for i in range(2000))]
    got = {(r.n_bytes, r.n_removed) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_bytes > 50}
    assert got == {(len(A) * 2, 0), (len(A) * 2, len(A) * 2), (148, 0)}


def brute_licences(t):
    """The base fields and the labels of phrases, by comparing lists of words at every place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    base = sorted((p, label) for phrase, label in licences.BASE_PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split())
    hits = [(p, p + len(x.split()), label) for x, label in (licences.phrases() | {licences.TAG: ""} | licences.BASE_PHRASES).items() for p in range(len(w)) if w[p : p + len(x.split())] == x.split()]
    labels = {label for _, label in base}
    for a, z, label in hits:
        inside = any(b <= a and z <= y and (b, y) != (a, z) for b, y, _ in hits)
        if label and not inside and not re.search(r"(?:^| )not (?:\w+ ){0,3}(?:under|by) (?:(?:the|a|an|any) )?$", " ".join(w[max(0, a - 8) : a]) + " "):
            labels.add(label)
    return len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))


def test_op7_licences(docs, empty, spark):
    got = {r.doc_id: r for r in licences.licences(docs).collect()}
    r = got[15]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (8, 3, 0, 5, "cc-by,reserved")
    assert (got[4].n_words, got[4].labels, got[4].first_word, got[4].score) == (0, "", None, 0.0)
    assert licences.licences(empty).count() == 0
    rng = np.random.default_rng(10)
    bits = [*licences.BASE_PHRASES, *licences.phrases(), "not under the", "not licensed under", "MIT", "CC-BY", "word", "General", "\n", "é", "by", "cc", "all rights", "x1"]
    rows = [(i, " ".join(str(rng.choice(bits)) for _ in range(int(rng.integers(0, 30))))) for i in range(400)]
    for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute_licences(rows[r.doc_id][1])
        assert 0 <= r.score <= 1


def test_op7_labels():
    f, tags = licences.automaton(), licences.tag_automaton()
    labels = lambda t: licences.scan(t, f, tags)[5]
    assert labels("# SPDX-License-Identifier: MIT OR Apache-2.0\ncode") == "apache-2.0,mit"
    assert labels("SPDX-License-Identifier: see the LICENSE file") == ""
    assert labels("SPDX-License-Identifier: MIT AND the rest") == "mit"
    assert labels("SPDX-License-Identifier:\nhello MIT") == ""
    assert labels("Creative Commons Attribution-NonCommercial 4.0") == "cc-by-nc"
    assert labels("under Creative Commons Attribution NonCommercial-ShareAlike") == "cc-by-nc-sa"
    assert labels("This is not under the MIT license, nor is it free") == ""
    assert labels("licensed under CC BY-NC-SA 4.0") == "cc-by,cc-by-nc-sa"
    assert labels("GNU Lesser General Public License version 3") == "gpl,gpl-3.0,lgpl"


def test_op7_tags_in_every_spelling():
    """Places of tags, labels and score against a look at every place of the text."""
    f, finder = licences.automaton(), licences.tag_automaton()
    for text, want, n in [
        ("SPDX License Identifier: MIT", "mit", 1),
        ("spdx_license-identifier = BlueOak-1.0.0", "blueoak-1.0.0", 1),
        ("not-SPDX-License-Identifier: MIT", "", 0),
        ("xspdx-license-identifier: MIT", "", 0),
        ("SPDX-License\nIdentifier: MIT", "", 0),
        ("SPDX-License-Identifier: see LICENSE", "", 0),
        ("/*SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */", "gpl-2.0", 1),
        ("SPDX-License-Identifier: MPL-2.0-no-copyleft-exception\nSPDX-License-Identifier: Zlib", "mpl-2.0-no-copyleft-exception,zlib", 2),
        ("é SPDX-LICENSE-IDENTIFIER:MIT", "mit", 1),
    ]:
        row = licences.scan(text, f, finder)
        assert (row[5], row[8]) == (want, n), text
        assert row[6] == pytest.approx(1 - (1 - licences.TAG_WEIGHT) ** n)
    rng = np.random.default_rng(7)
    bits = ["SPDX", "spdx", "License", "license", "Identifier", "identifier", "-", "_", " ", "-", " ", ":", " MIT", "\n", "é", "x"]
    for _ in range(3000):
        t = "".join(str(rng.choice(bits)) for _ in range(int(rng.integers(5, 25))))
        t += rng.choice(["", " SPDX-License-Identifier: ISC", "-spdx_license identifier MIT"])
        places = [i for i in range(len(t)) if re.fullmatch("spdx[-_ ]license[-_ ]identifier", t[i : i + 23].lower()) and not (i and (t[i - 1].isascii() and t[i - 1].isalnum() or t[i - 1] in "-_"))]
        want = [t[i + 23 :].split("\n")[0] for i in places]
        assert [x.strip(" \t") for x in licences.tagged(t, finder)] == [re.sub("^[:=]", "", w.strip(" \t")).strip(" \t") for w in want]
    long = "word " * 200_000 + "SPDX-License-Identifier: MIT"
    assert licences.scan(long, f, finder)[5] == "mit"


def brute_expression(tokens):
    """(labels, grant) by recursive descent: or over and over with over operands and parentheses."""

    def over(k, ops, below):
        left, k = below(k)
        while k < len(tokens) and tokens[k].lower() == ops:
            right, k = below(k + 1)
            left = (left[0] | right[0], max(left[1], right[1])) if ops == "or" else (left[0] | right[0], min(left[1], right[1])) if ops == "and" else left
        return left, k

    def one(k):
        if tokens[k] == "(":
            got, k = either(k + 1)
            return got, k + 1
        return ({tokens[k].lower()}, licences.grant(tokens[k].lower())), k + 1

    either = lambda k: over(k, "or", lambda k: over(k, "and", lambda k: over(k, "with", one)))
    return either(0)[0]


def test_op7_expressions():
    assert licences.postfix("MIT OR Apache-2.0 AND (BSD-3-Clause WITH LLVM-exception)") == ["MIT", "Apache-2.0", "BSD-3-Clause", "LLVM-exception", "with", "and", "or"]
    assert licences.evaluate("GPL-2.0-only WITH Classpath-exception-2.0") == ({"gpl-2.0-only"}, 0.5)
    assert licences.evaluate("(MIT OR") == ({"mit"}, 1.0)
    assert licences.evaluate(") AND") == (set(), None)
    rng = np.random.default_rng(11)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            x = [str(rng.choice(["MIT", "GPL-2.0-only", "CC-BY-NC-4.0", "Apache-2.0", "ISC", "LicenseRef-own.1"]))]
            return [*x, "WITH", "GCC-exception-3.1"] if rng.random() < 0.2 else x
        x = [*made(depth - 1), str(rng.choice(["OR", "and", "AND", "or"])), *made(depth - 1)]
        return ["(", *x, ")"] if rng.random() < 0.6 else x

    for _ in range(300):
        tokens = made(4)
        assert licences.evaluate(" ".join(tokens)) == brute_expression(tokens), tokens


@pytest.mark.parametrize("primes", [exact.PRIMES, (7, 5)])
def test_op8_exact(docs, empty, primes):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append((-len(t or ""), math.inf if i is None else i, i))
    rows = exact.exact_groups(docs, primes).collect()
    want = Counter((i, min(groups[norm(t)])[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert exact.exact_groups(empty).count() == 0


def test_op8_many_null_ids_end(spark):
    """100,000 rows without an id, some of them equal, end and stay apart."""
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 99_990).alias("text"))
    got = exact.exact_groups(rows).groupBy("group_size").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).collect()
    assert {(r.group_size, r.n, r.k) for r in got} == {(1, 99_980, 99_980), (2, 20, 10)}


def test_op8_huge_texts_are_hashed_in_parallel(docs):
    from inkweave.llm.common import keyed

    rows = lambda *how: {tuple(r) for r in exact.fingerprints(keyed(docs), exact.PRIMES, *how).select("_id", "n_points", "n_bytes", "fingerprint", "text_sha256").collect()}
    assert rows(0, 7) == rows(64, 16) == rows()


def test_op8_hashes_combine():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    p, t = exact.PRIMES[0], exact.powers(exact.PRIMES[0])
    whole = exact.chunk_hash(data, t, p)
    for cut in (1, 100, 500):
        assert exact.combine(exact.chunk_hash(data[:cut], t, p), exact.chunk_hash(data[cut:], t, p), len(data) - cut, p) == whole


def test_op9_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    more = ["a<|endoftext|>b <|endoftext|>", "don't  stop\n\n x²½ Ⅷ 中文", "x" * 3000, "th" * 2000]
    c = bpe.Codec(bpe.default_path())
    for x in more:
        ids = c.encode(x)
        assert ids == t.encode(x, add_special_tokens=False).ids
        assert c.decode(np.array(ids, np.int64)).decode() == x
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect())
    want = Counter()
    for i, x in ROWS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs)).collect()} == {(i, x or "") for i, x in ROWS}
    assert bpe.digests(empty).count() == 0


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><main><article><h1>Title &amp; more</h1><p>First  para <b>bold</b> text<p>Second &lt;b&gt;<br>line</p><div class="share">Share</div></article><aside>side</aside><section id="comments"><p>I agree</p></section></main><form><label>Mail</label></form><footer>&copy; us</footer><script>if (a<b) "</p>"</script></body></html>'


def test_op10_pages(spark):
    rows = [(i, f"https://a.example.com/{i}", PAGE.replace("Second", f"Second {i}")) for i in range(6)] + [(7, None, None), (8, "x", ""), (8, "x", "plain words"), (9, "https://b.example.com", "<p>one<div class='menu'>two</div><p>three")]
    got = Counter((r.page_id, r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = Counter()
    for i in range(6):
        text = f"Title & more\nFirst para bold text\nSecond {i} <b> line"
        want[i, text, len(text)] += 1
    for i, text in ((7, ""), (8, ""), (8, "plain words"), (9, "one\nthree")):
        want[i, text, len(text)] += 1
    assert got == want
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, pages):
    rows = [(i, f"https://c.example.com/{i}", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_op10_constants_go_without_an_article(spark):
    got = extracted(spark, [f"<body><div><p>Our standard line</p></div><div><p>Own words {i}</p></div></body>" for i in range(8)])
    assert got == {i: f"Own words {i}" for i in range(8)}


def test_op10_slots_by_class(spark):
    """Without an article or telling names: a menu of changing links and a line of date stand in slots of their own and go,
    the text stays, also what an optional class opens inside its slot."""
    menu = lambda i: "".join(f"<span><a href=x>link {i} {k}</a></span>" for k in range(3))
    quote = lambda i: f"<blockquote>A short remark {i}</blockquote>" if i % 3 else ""
    page = lambda i: f"<body><div><section>{menu(i)}</section><table><tr><td>day {i}</td></tr></table><dl><dd>Text {i} {'own words ' * 30}</dd>{quote(i)}<dd>more {i}</dd></dl></div></body>"
    got = extracted(spark, [page(i) for i in range(12)])
    for i in range(12):
        assert got[i] == "\n".join([f"Text {i} {'own words ' * 30}".strip(), *([f"A short remark {i}"] if i % 3 else []), f"more {i}"])


def test_op10_classes_are_those_of_equal_vectors(spark):
    """Tokens, pages and classes of hosts against counting page by page; copies of a page count once."""
    rng = np.random.default_rng(12)
    pages = []
    for i in range(40):
        parts = [x for x, keep in zip(["<nav>menu</nav>", "<p>a</p>", "<p>b</p>", "<h2>c</h2><h3>d</h3>", "<footer>e</footer>"], rng.random(5) < 0.8, strict=True) if keep]
        pages.append((i, f"https://h{i % 3}.org/", f"<body>{''.join(parts)}<p>own {i // 2 if i % 7 == 0 else i}</p></body>"))
    pages += [(100 + i, u, p) for i, u, p in pages[:9]]
    read = html.parsed(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {}
    for r in html.classes(read).collect():
        got[r.host] = {(c.pages, frozenset((t.token, t.is_text) for t in c.tokens)) for c in r.classes}
    for host in ("h0.org", "h1.org", "h2.org"):
        distinct = sorted({p for _, u, p in pages if host in u})
        vector = defaultdict(lambda: [0] * len(distinct))
        for k, p in enumerate(distinct):
            blocks, tags = html.read_page(p)
            for t, x in (*((t, False) for t in tags), *((b[1], True) for b in blocks)):
                vector[html._signed(t), x][k] += 1
        by = defaultdict(set)
        for token, v in vector.items():
            if 2 * sum(map(bool, v)) >= len(distinct):
                by[tuple(v)].add(token)
        assert got[host] == {(sum(map(bool, v)), frozenset(tokens)) for v, tokens in by.items()}


def test_op10_marks_inside_an_article(spark):
    inner = '<p class="notice-board">Board</p><div class="header-image-caption">Caption</div><div class="ad">Buy</div><section id="comments-area"><p>I agree</p></section><aside>Side</aside><p>End</p>'
    assert extracted(spark, [f"<body><article><h1>T</h1>{inner}</article></body>"]) == {0: "T\nBoard\nCaption\nEnd"}


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<p><b>" * 50_000 + "x", "<article>" + "<div>" * 50_000 + "</b></li></p>" * 50_000, "<ul><li>" * 50_000 + "<li>" * 50_000, "<a href='" * 3_000, "&amp;" * 200_000])
def test_op10_broken_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    html.read_page(page)
    assert time.perf_counter() - began < 10


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rng = np.random.default_rng(5)
    vocab = [f"word{i}" for i in range(400)]
    texts = {i: " ".join(rng.choice(vocab, 120)) for i in range(40)}
    texts[40] = texts[3].replace(texts[3].split()[50], "changed", 1)
    texts[41] = "#### $$$$ " * 60
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 41), 0) for i in range(42)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == seen[1] == set(range(41))
    assert seen[2] == set(range(40))
    assert seen[3] <= seen[2]
    assert Counter(r.doc_id for r in p.run(spark, str(tmp_path)).collect()).keys() == seen[3]


@pytest.mark.parametrize("name", ["op4_minhash", "op6_suffix"])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    from inkweave.llm import entry

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = entry.queries()[name](spark, folder)
    want = c.execute(entry.oracle_sql()[name]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))


def test_sql_of_awkward_rows(docs):
    import duckdb

    c = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
    c.register("documents", documents)
    for sql, got in ((minhash.ORACLE_SQL, minhash.near_duplicates(docs, k=3, percent=85, rows=4, bands=20)), (suffix.ORACLE_SQL, suffix.remove_repeats(docs))):
        assert Counter(c.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()) == Counter(map(tuple, got.collect()))
