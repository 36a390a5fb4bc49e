"""Porter's stemmer (An algorithm for suffix stripping, 1980, with its author's later rules for -bli and -logi), applied to
tables of distinct words."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

# The suffixes of steps 2, 3 and 4 with what replaces them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
STEP_2, STEP_3 = ({s: x[s] for s in sorted(x, key=len, reverse=True)} for x in (STEP_2, STEP_3))
STEP_4 = tuple(sorted(STEP_4, key=len, reverse=True))
#: The last letters of everything that a step takes away or replaces: words with others are their own stems.
LAST = frozenset(s[-1] for s in (*STEP_2, *STEP_3, *STEP_4, "s", "d", "g", "y", "e", "l"))
#: Words of fewer or more UTF-8 bytes are left alone.
SHORTEST, LONGEST = 3, 64


def _shape(word: str) -> str:
    """A letter for each of the word's: v for vowels, with every y after a consonant, else c."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Whether a stem ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix that fits decides; it is replaced after a stem of more than ``least``."""
    for s in rules:
        if word.endswith(s):
            stem = word[: -len(s)]
            return stem + rules[s] if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    if word[-1:] not in LAST or not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    w = word
    if w.endswith(("sses", "ies")) and w not in ("sses", "ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed") and w != "eed":
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and cut[-1] not in "aeioulsz":
            cut = cut[:-1]
        elif _measure(cut) == 1 and _short(cut):
            cut += "e"
        w = cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP_2, 0), STEP_3, 0)
    for s in STEP_4:
        if w.endswith(s):
            if _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def with_stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """terms with a column stem: once for each row, so rows should be distinct words; a null term has a null stem."""

    def run(batches):
        for b in batches:
            stems = [None if t is None else stem(t) for t in b.column(term).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(stems, pa.string())], [*b.schema.names, "stem"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in terms.schema.fields)
    return terms.mapInArrow(run, f"{columns}, stem string")
