"""Quality rules: a decision list learned by sequential covering, over measures of whole texts.  DataFrame functions only.

Measures are array expressions inside each row, so a text never moves.  The learner sees at most ``sample`` labelled
rows (chosen by a hash of their id); their measures are cut at quantiles, and each step reads one small table of counts
by measure and cut.  A rule grows by the threshold with the best information gain until it covers no good document of
the growing part, is pruned from its end on the other part, and is taken if it is precise there; then what it covers is
set aside and the next rule grows.  The list becomes one ordered ``CASE`` expression that Spark compiles.

Defined results: a null or empty text has no words and fails the base test; rows are measured one by one, so ties and
repeated rows need no rule; with no labels of both kinds the list is empty and only the base test decides.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import SPACE_RE, settle

#: Words of a window whose repetition counts.
WINDOW = 8
#: Labelled rows that a list is learned from, at most.
SAMPLE = 20_000
#: Shares of words and letters that the learner cuts.  None depends on a text's length, as the share of distinct words does:
#: long clean texts would look like repetition.
SHARES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "twin_share": "n_twins / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
}
#: Quantiles of each kind of document (good, bad) that may be thresholds.
CUTS = 32


def measures(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the learner's own measures of each row."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", *more, text.alias("t"), F.array_remove(F.split(text, SPACE_RE), "").alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    d = d.select(
        "doc_id",
        *more,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    at = lambda a, i: F.get(a, i)
    windows = F.transform(F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(at(F.col("h"), i + j) for j in range(1, WINDOW))))
    d = d.select("*", windows.alias("v"))
    d = d.select("*", F.size(F.filter("h", lambda x, i: x == at(F.col("h"), i + 1))).cast("long").alias("n_twins"), (F.size(F.array_distinct("v")) < F.size("v")).alias("again")).drop("h")
    d = d.select("*", F.when(F.col("again"), F.sort_array(F.transform("v", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s")).drop("v", "again")
    twice = F.filter("s", lambda e, i: (e["x"] == at(F.col("s"), i - 1)["x"]) | (e["x"] == at(F.col("s"), i + 1)["x"]))
    d = d.select("*", F.sort_array(F.transform(twice, lambda e: e["i"])).alias("p")).drop("s")
    steps = F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(at(F.col("p"), i + 1) - x, F.lit(WINDOW))))
    return d.select("*", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words")).drop("p")


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 20) | (100 * F.col(n_repeat_words) > 30 * F.col(n_words))


Rule = list[tuple[str, str, float]]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, ((F.col(f) >= t) if op == ">=" else (F.col(f) < t) for f, op, t in rule), F.lit(True))


def with_shares(measured: DataFrame) -> DataFrame:
    return measured.select("*", *(F.expr(e).alias(n) for n, e in SHARES.items()))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def learn(train: DataFrame, features: list[str], most_rules: int = 8, most_conditions: int = 3, precision: float = 0.98, least: int = 8) -> list[Rule]:
    """train: doc_id, bad (boolean) and the features.  Returns an ordered list of rules; each says that a document is bad.

    Two thirds of the rows (by a hash of the id) grow rules, the others prune them.
    """
    train = train.filter(reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in features))).withColumn("prune", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    rules: list[Rule] = []
    free = F.lit(True)
    while len(rules) < most_rules:
        # Thresholds are quantiles of what is left, so that each rule sees its own documents finely.
        spots = train.filter(free).groupBy("bad").agg(*(F.percentile_approx(f, [i / CUTS for i in range(CUTS)], 1000).alias(f) for f in features)).collect()
        cuts = {f: sorted({float(x) for r in spots for x in r[f] or []}) for f in features}
        bin_of = lambda f: F.size(F.filter(F.array(*(F.lit(c) for c in cuts[f])), lambda c: c <= F.col(f))) if cuts[f] else F.lit(0)  # noqa: B023, E731
        rule: Rule = []
        while len(rule) < most_conditions:
            rows = train.filter(~F.col("prune") & free & holds(rule)).select("bad", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in features))).alias("e"))
            got = rows.groupBy("e.f", "e.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            p0, n0 = (sum(r[c] for r in got if r["f"] == features[0]) for c in ("p", "n"))
            if p0 < least or not n0:
                break
            best = (0.0, None)
            for f in features:
                own = {r["b"]: r for r in got if r["f"] == f}
                for k, cut in enumerate(cuts[f], 1):
                    p, n = (sum(r[c] for b, r in own.items() if b >= k) for c in ("p", "n"))
                    for op, x, y in ((">=", p, n), ("<", p0 - p, n0 - n)):
                        if x >= least and (g := _gain(x, y, p0, n0)) > best[0] + 1e-9:
                            best = (g, (f, op, cut))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        starts = [rule[:k] for k in range(1, len(rule) + 1)]
        got = train.filter(F.col("prune") & free).agg(*(F.count_if(holds(s) & (F.col("bad") if c == "p" else ~F.col("bad"))).alias(f"{c}{k}") for k, s in enumerate(starts) for c in ("p", "n"))).first()
        value = [(got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"]) for k in range(len(starts))]
        k = value.index(max(value))
        p, n = got[f"p{k}"], got[f"n{k}"]
        if p + n < least / 2 or p < precision * (p + n):
            break
        rules.append(starts[k])
        free = free & ~holds(starts[k])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """true: good.  The rules in their order as one conditional expression."""
    out = F.when(F.lit(False), F.lit(True))
    for r in rules:
        out = out.when(holds(r), F.lit(False))
    return out.otherwise(F.lit(True))


def fired(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for k, r in enumerate(rules, 1):
        out = out.when(holds(r), F.lit(k))
    return out.otherwise(F.lit(0))


def _apart(measured: DataFrame, row: Column) -> DataFrame:
    """The fields of a struct, exploded from an array of one: filters on them stay above.

    Otherwise a filter is pushed below the measures with a copy of their expressions for each use, and again below the
    next ones, until planning takes minutes.
    """
    return measured.select(F.explode_outer(F.array(row)).alias("row")).select("row.*")


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The list for labels (doc_id, quality: 0 is bad); null labels are left out, of several the lowest counts."""
    some = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``sample`` rows of 9 bytes
    return learn(settle(with_shares(measures(chosen, "bad")).select("doc_id", "bad", *SHARES)), list(SHARES))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: the measures, base_failed, kept and rule (the number of the rule that rejects, else 0)."""
    rules = learn_from(docs, labels, sample)
    row = F.struct("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"), fired(rules).alias("rule"))
    return _apart(with_shares(measures(docs)), row)


def filter_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the base test and the list keep, with every column; texts stay in their row."""
    rules = learn_from(docs, labels, sample)
    inner = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_all"))
    good = ~base_failed() & verdict(rules)
    d = _apart(with_shares(measures(inner, "_all")), F.struct("_all", good.alias("_good"))).filter("_good")
    return d.select(*(F.col("_all").getField(c).alias(c) for c in docs.columns))
