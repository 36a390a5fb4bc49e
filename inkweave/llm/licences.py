"""Licence scans: identifier tags and notice phrases by Aho-Corasick, licence expressions by a shunting yard.

A text is lower-cased (A-Z), cut into words and joined again with single spaces; one automaton finds every phrase of
words in one pass.  Where it finds a tag's words, a second automaton finds the tag itself in the lower-cased text, as it is
written: with hyphens, spaces or underscores, and no letter, digit, hyphen or underscore before it.  Of phrases inside longer ones only the longest states its label, and one that ``not ... under`` comes
before states none; base phrases always count.  Behind an identifier tag the rest of its own line is parsed as a licence
expression: operands, ``with`` before ``and`` before ``or``, and parentheses.  Operands must be names of known families or
names with a version, and those behind ``with`` exceptions or notes; reading ends at anything else.  A tag counts for the
score and in n_tags if an operand was read behind it.

Defined results: a null text is empty: no words, no places, empty labels, score 0.  A broken expression gives the labels
of the operands read so far.  Rows are independent, so ties and repeated rows need no rule; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases of words and the label that each of them states.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
MORE_PHRASES = {
    "apache license": "apache",
    "apache license version 1 1": "apache-1.1",
    "apache license version 2 0": "apache-2.0",
    "artistic license": "artistic",
    "boost software license": "bsl-1.0",
    "bsd license": "bsd",
    "cc0 1 0": "cc0",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl",
    "european union public license": "eupl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "gnu lesser general public license": "lgpl",
    "isc license": "isc",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "open database license": "odbl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "sil open font license": "ofl",
    "this is free and unencumbered software": "unlicense",
    "zlib license": "zlib",
}
#: The conditions that a Creative Commons licence may add, as words and as letters.
CONDITIONS = {"nc": ("noncommercial", "non commercial"), "nd": ("noderivatives", "noderivs", "no derivatives", "no derivs"), "sa": ("sharealike", "share alike")}
#: The words of an identifier tag.
TAG = "spdx license identifier"
#: What may stand between them, and what must not stand before the tag.
TAG_JOINTS, NO_TAG_AFTER = "- _", re.compile(r"[A-Za-z0-9_-]")
#: The rest of the line behind a tag.
REST = re.compile(r"[ \t]*[:=]?[ \t]*([^\r\n]*)")
#: Words before a phrase that deny it.
DENIED = re.compile(r" not (?:\w+ ){0,3}(?:under|by) (?:(?:the|a|an|any) )?$")
#: How free the use is that a licence grants; by the start of its label, the first that fits.
GRANTS = (("reserved", 0.0), ("proprietary", 0.0), ("cc-by-nc", 0.25), ("cc-by-nd", 0.25), ("cc-by-sa", 0.5), ("gpl", 0.5), ("agpl", 0.5), ("lgpl", 0.5), ("gfdl", 0.5), ("mpl", 0.5), ("epl", 0.5), ("eupl", 0.5), ("odbl", 0.5), ("", 1.0))
#: The evidence of one tag, and of one label from a phrase.
TAG_WEIGHT, PHRASE_WEIGHT = 0.9, 0.6
# Families of licence identifiers, and of the exceptions behind WITH, in lower case; other names need a version.
IDENTIFIER = re.compile(
    r"(?:0bsd|afl-[123]\.\d|agpl-[13]\.0|apache-(?:1\.[01]|2\.0)|artistic-[12]\.0|bsd-[1-4]-clause(?:-[a-z-]+)?|bsl-1\.0|cc0-1\.0|cc-by(?:-nc)?(?:-nd|-sa)?-[1-4]\.\d|cddl-1\.[01]|ecl-[12]\.0|epl-[12]\.0|eupl-1\.[012]|"
    r"gfdl-1\.[123]|gpl-[123]\.0|isc|lgpl-(?:2\.[01]|3\.0)|lppl-1\.3[ac]|mit(?:-0|-[a-z]+)?|mpl-(?:1\.[01]|2\.0)|ms-(?:pl|rl)|ncsa|odbl-1\.0|ofl-1\.1|openssl|osl-[123]\.\d|postgresql|psf-2\.0|python-2\.0|ruby|unicode-3\.0|unlicense|"
    r"upl-1\.0|vim|w3c|wtfpl|x11|zlib|zpl-2\.[01])(?:-only|-or-later|\+)?|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+|"
    r"[a-z][a-z0-9]*(?:-[a-z][a-z0-9]*)*-[0-9]+(?:\.[0-9]+)*(?:-[a-z][a-z0-9]*)*\+?"
)
EXCEPTION = re.compile(r"[a-z0-9.-]+-(?:exception|note)(?:-[a-z0-9.]+)?")

#: Bytes that are not of a word become spaces, A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+\-:]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """A licence expression in postfix order; operators are lower case.  Reading ends at the first thing out of place."""
    out: list[str] = []
    waiting: list[str] = []
    want = True  # an operand comes next
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if want and token == "(":
            waiting.append(token)
        elif want and (EXCEPTION if waiting[-1:] == ["with"] else IDENTIFIER).fullmatch(word):
            out.append(token)
            want = False
        elif not want and token == ")" and "(" in waiting:
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif not want and word in _RANK:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[word]:
                out.append(waiting.pop())
            waiting.append(word)
            want = True
        else:
            break
    while want and waiting and (waiting[-1] == "(" or waiting[-1] in _RANK):  # what waits for the missing operand
        want = waiting.pop() == "("
    return out + [x for x in reversed(waiting) if x in _RANK]


def grant(label: str) -> float:
    return next(g for start, g in GRANTS if label.startswith(start))


def evaluate(expression: str) -> tuple[set[str], float | None]:
    """The labels of an expression and the use that it grants: ``or`` lets choose, ``and`` binds to both, ``with`` keeps the left."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix(expression):
        if token in _RANK and len(stack) >= 2:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a | b, max(x, y)) if token == "or" else (a | b, min(x, y)) if token == "and" else (a, x))
        elif token not in _RANK:
            label = token.lower()
            stack.append(({label}, grant(label)))
    if not stack:
        return set(), None
    return set().union(*(s for s, _ in stack)), min(g for _, g in stack)


def phrases() -> dict[str, str]:
    """The phrases of the method and their labels; those of Creative Commons by rule."""
    out = dict(MORE_PHRASES) | {"creative commons attribution": "cc-by"}
    for kinds in (("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa")):
        label = "-".join(("cc", "by", *kinds))
        out[label.replace("-", " ")] = label
        for spelled in product(*(CONDITIONS[k] for k in kinds)):
            out[" ".join(("creative commons attribution", *spelled))] = label
    return out


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for found, base in ((phrases(), False), (BASE_PHRASES, True)):
        for phrase, label in found.items():
            a.add_word(f" {phrase} ", (phrase, label, base))
    a.add_word(f" {TAG} ", (TAG, "", False))
    a.make_automaton()
    return a


#: A-Z become a-z, byte by byte, so places stay the same.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tag_automaton() -> ahocorasick.Automaton:
    """Finds the tag in each of its spellings."""
    a = ahocorasick.Automaton()
    first, second, third = TAG.split()
    for x, y in product(TAG_JOINTS, repeat=2):
        tag = f"{first}{x}{second}{y}{third}"
        a.add_word(tag, len(tag))
    a.make_automaton()
    return a


def tagged(text: str, finder: ahocorasick.Automaton) -> list[str]:
    """What stands on the line behind each tag of a text."""
    out = []
    for end, size in finder.iter(text.encode().translate(LOWER_BYTES).decode()):
        start = end + 1 - size
        if not start or not NO_TAG_AFTER.match(text[start - 1]):
            out.append(REST.match(text, end + 1)[1])
    return out


def scan(text: str, finder: ahocorasick.Automaton, tag_finder: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, grants, n_tags."""
    found = text.encode().translate(WORD_BYTES).split()
    joined = (b" " + b" ".join(found) + b" ").decode()
    places, base, labels, maybe_tagged, tags = [], set(), set(), False, 0
    hits = []
    for end, (phrase, label, is_base) in finder.iter(joined):
        start = end - len(phrase) - 1
        if is_base:
            places.append(start)
            base.add(label)
        maybe_tagged |= not label
        hits.append((start, -end, label))
    hits.sort()
    reached = -1
    for start, end, label in hits:
        if -end > reached:  # not inside a longer one
            reached = -end
            if label and not DENIED.search(joined, max(0, start - 60), start + 1):
                labels.add(label)
    labels |= base
    grants = [grant(x) for x in labels]
    n_phrases = len(labels)
    for expression in tagged(text, tag_finder) if maybe_tagged else ():
        more, g = evaluate(expression)
        labels |= more
        grants += [] if g is None else [g]
        tags += g is not None
    starts = [joined.count(" ", 0, min(places)), joined.count(" ", 0, max(places))] if places else [None, None]
    score = 1 - (1 - TAG_WEIGHT) ** tags * (1 - PHRASE_WEIGHT) ** n_phrases
    return len(found), len(places), *starts, ",".join(sorted(base)), ",".join(sorted(labels)), score, min(grants, default=None), tags


_TYPES = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("grants", pa.float64()), ("n_tags", pa.int64()))


def licences(docs: DataFrame) -> DataFrame:
    """The licence statements of each row: doc_id and the fields of ``scan``."""

    def run(batches):
        finder, tag_finder = automaton(), tag_automaton()
        for b in batches:
            rows = [scan(t.as_py() or "", finder, tag_finder) for t in b.column("text")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(columns, _TYPES, strict=True))], ["doc_id", *(n for n, _ in _TYPES)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, grants double, n_tags long")
