"""The stretch of each text that shows best what was searched for.

A stretch has ``size`` words.  It is worth 1000 for each different unit in it and 1 for each further occurrence.  Stretches
are looked at that begin with an occurrence, and those that begin with the sentence an occurrence stands in, worth 100 more
(120 for the beginning of the text; only in texts longer than a stretch).  The first of the best is shown, one that does
not begin with a sentence moved so that its occurrences are in the middle.  A sentence begins after a full stop or colon
and white space.

Everything is done in the text's row, in time linear in its length: each occurrence looks at one stretch, each sentence at
its own words.  Words are those of ``functions.words``, without case and accents.

Defined results: a null or empty text gives an empty snippet; a text without an occurrence its beginning without marks;
words with ``near`` are marked wherever they stand; rows that repeat a key are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import words as W
from inkweave.operators.inverted import Unit

#: Fixed values of the score: each different unit, a sentence, the beginning of the text.
UNIT, SENTENCE, BEGINNING = 1000, 100, 120


def _parts(units: list[Unit]) -> list[Unit]:
    """Units as the words, prefixes and phrases to mark; a word of two units is marked for the first."""
    out = [p for u in units for p in ([Unit("word", (w,)) for w in u.words] if u.kind == "near" else [u])]
    return list(dict.fromkeys(out))


def snippets(docs: DataFrame, units: list[Unit], key: str = "path", text: str = "text", size: int = 10, marks: tuple[str, str] = ("[", "]"), more: str = "...") -> DataFrame:
    """key, snippet of every row of docs."""
    parts = _parts(units)
    lengths, longest = F.array(*(F.lit(len(p.words)) for p in parts)).cast("array<int>"), max((len(p.words) for p in parts), default=1)
    d = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.select(key, W.raw_words(F.col("_t")).alias("_w"), W.gaps(F.col("_t")).alias("_g"))
    d = d.select(key, "_w", "_g", F.transform("_w", W.fold).alias("_f"), F.size("_w").alias("_n"))

    def begins(word: Column, at: Column) -> Column:
        """The parts that begin at a word."""
        each = []
        for i, p in enumerate(parts):
            if p.kind == "prefix":
                here = word.startswith(p.words[0])
            else:
                here = word == p.words[0]
                for k, w in enumerate(p.words[1:], 1):
                    here = here & (F.get(F.col("_f"), at + k) == w)
            each.append(F.when(here, F.lit(i)))
        return F.filter(F.array(*each).cast("array<int>"), lambda x: x.isNotNull())

    begin = F.filter(F.transform("_g", lambda g, i: F.when((i < F.col("_n")) & ((i == 0) | g.rlike(r"[.:][ \t\n\r]+\z")), i)), lambda i: i.isNotNull())
    d = d.select(key, "_w", "_g", "_n", F.transform("_f", begins).alias("_m"), begin.alias("_s"))
    hit = F.filter(F.transform("_m", lambda m, i: F.when(F.size(m) > 0, i)), lambda i: i.isNotNull())
    d = d.select("*", hit.alias("_h"))

    def worth(at: Column) -> Column:
        inside = F.flatten(F.slice("_m", at + 1, F.lit(size)))
        return (UNIT - 1) * F.size(F.array_distinct(inside)) + F.size(inside)

    def centred(at: Column) -> Column:
        """Where the stretch begins whose occurrences from a place on are in the middle of it."""
        last = F.array_max(F.transform(F.slice("_m", at + 1, F.lit(size)), lambda m, i: F.when(F.size(m) > 0, F.struct(i.alias("i"), F.array_max(m).alias("p")))))
        spare = F.lit(size) - last["i"] - F.get(lengths, last["p"])
        return F.greatest(F.least(at - (spare / 2).cast("int"), F.col("_n") - size), F.lit(0))

    def sentence(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("_s"), k + 1), F.col("_n"))
        first = F.array_min(F.transform(F.slice("_m", at + 2, end - at - 1), lambda m, i: F.when(F.size(m) > 0, i + at + 1)))
        more_worth = F.when(at == 0, BEGINNING).otherwise(SENTENCE)
        return F.when(first.isNotNull() & (F.col("_n") > size), F.struct((worth(at) + more_worth).alias("worth"), (-first).alias("first"), F.lit(-1).alias("kind"), at.alias("at")))

    by_hit = F.transform("_h", lambda at: F.struct(worth(at).alias("worth"), (-at).alias("first"), F.lit(0).alias("kind"), centred(at).alias("at")))
    best = F.array_max(F.concat(by_hit, F.filter(F.transform("_s", sentence), lambda x: x.isNotNull())))
    d = d.select("*", F.coalesce(best["at"], F.lit(0)).alias("_b")).withColumn("_e", F.least(F.col("_b") + size, F.col("_n")))

    def longer(than: int):
        return lambda p: F.get(lengths, p) > than

    def spans(at: Column, beyond: int) -> Column:
        """Whether an occurrence has the word at a place, and so many words after it."""
        out = F.lit(False)
        for back in range(longest - beyond):
            out = out | F.coalesce(F.exists(F.get(F.col("_m"), at - back), longer(back + beyond)), F.lit(False))
        return out

    def shown(at: Column) -> Column:
        inside = spans(at, 0)
        gap = F.when(at > F.col("_b"), F.get(F.col("_g"), at)).otherwise(F.lit(""))
        opens = F.when(inside & ~spans(at - 1, 1), F.lit(marks[0])).otherwise(F.lit(""))
        closes = F.when(inside & (at >= F.col("_o")) & (~spans(at, 1) | (at == F.col("_e") - 1)), F.lit(marks[1])).otherwise(F.lit(""))
        return F.concat(gap, opens, F.get(F.col("_w"), at), closes)

    # An occurrence that begins before the stretch is not marked: marks may stand from the first word on that begins anew.
    anew = F.array_min(F.filter(F.sequence(F.col("_b"), F.col("_e")), lambda at: ~spans(at - 1, 1)))
    d = d.withColumn("_o", F.coalesce(anew, F.col("_e")))
    body = F.array_join(F.transform(F.sequence(F.col("_b"), F.col("_e") - 1), shown), "")
    head = F.when(F.col("_b") > 0, F.lit(more)).otherwise(F.get(F.col("_g"), F.lit(0)))
    tail = F.when(F.col("_e") < F.col("_n"), F.lit(more)).otherwise(F.get(F.col("_g"), F.col("_n")))
    return d.select(key, F.when(F.col("_n") > 0, F.concat(head, body, tail)).otherwise(F.get(F.col("_g"), F.lit(0))).alias("snippet"))
