"""Sync by size and time, sections without marks and front matter, identifiers with separators: the golden cases."""

import re

from pyspark.sql import functions as F

from inkweave.functions import scalars as S
from inkweave.operators import changes as C
from inkweave.operators.sections import sections


def test_sync_states(spark):
    md5 = lambda t: __import__("hashlib").md5(t.encode()).hexdigest()
    found = [("new", 1, 1), ("same", 3, 7), ("edited", 3, 8), ("touched", 3, 8), ("grown", 4, 7), ("failed", 3, 8), ("failed_same", 3, 7), ("unscanned", 3, 7), ("unscanned_touched", 3, 9)]
    content = [(p, "xyz" if p != "edited" else "abc") for p, *_ in found]
    row = lambda p, status="ok", scanned=True: (p, 3, 7, md5("xyz"), status, scanned)
    index = [row("same"), row("edited"), row("touched"), row("grown"), row("failed", "error"), row("failed_same", "skipped"), row("unscanned", "ok", False), row("unscanned_touched", "ok", False), row("vanished")]
    f, i, c = spark.createDataFrame(found, "path string, size long, mtime long"), spark.createDataFrame(index, "path string, size long, mtime long, md5 string, status string, scanned boolean"), spark.createDataFrame(content, "path string, text string")
    plan = lambda **o: {r.path: r.action for r in C.plan_sync(f, i, c, **o).collect()}
    want = {"new": "add", "same": "skip", "edited": "update", "touched": "touch", "grown": "touch", "failed": "update", "failed_same": "skip", "unscanned": "skip", "unscanned_touched": "touch", "vanished": "delete"}
    assert plan() == want
    assert plan(retry_errors=True) == want | {"failed_same": "retry"}
    assert plan(pii=True) == want | {"unscanned": "update", "unscanned_touched": "update"}


def test_sections_are_without_marks_and_front_matter(spark):
    text = "---\ntags: [a]\n---\nlead\n## Title ##\nbody\n### C# #\nx\n---\nrule\n"
    got = [(r.heading, r.text) for r in sections(spark.createDataFrame([("p", text)], "path string, text string")).orderBy("section").collect()]
    assert got == [("", "lead"), ("Title", "body"), ("Title > C#", "x\n---\nrule")]


def test_identifiers_equal_the_patterns(spark):
    texts = ["4111 1111 1111 1111", "4111-1111-1111-1111x", "ssn 123-45-6789, 9123-45-6789 and 123-45-67890", "4111111111111112", "a 4012888888881881 b 5500 0055 5555 5559", "12345 " * 5, "", "378282246310005"]

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    want = {}
    for t in texts:
        cards = [m for m in re.findall(r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", t) if luhn(re.sub(r"\D", "", m))]
        want[t] = re.findall(r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", t) + cards
    got = {r.t: list(r.v) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.identifiers(F.col("t")).alias("v")).collect()}
    assert got == want and got["4111 1111 1111 1111"] and got["ssn 123-45-6789, 9123-45-6789 and 123-45-67890"] == ["123-45-6789"]
    masked = spark.createDataFrame([(texts[0],)], "t string").select(S.mask(F.col("t"), S.identifiers(F.col("t"))).alias("m")).first().m
    assert masked == "[pii …1111]"
