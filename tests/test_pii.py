"""Masking in one pass against Python's regular expressions, and finds joined by path."""

import random
import re

from pyspark.sql import functions as F

from inkweave.functions import scalars as S
from inkweave.operators import pii as P


def brute(text, values):
    plain = lambda v: re.sub("[^0-9A-Za-z]", "", v)
    use = sorted({v for v in values if v and len(plain(v)) >= 6}, key=len, reverse=True)
    if text is None or not use:
        return text
    edge = lambda v: ("(?<![0-9A-Za-z])" if re.match("[0-9A-Za-z]", v) else "") + re.escape(v) + ("(?![0-9A-Za-z])" if re.search("[0-9A-Za-z]$", v) else "")
    return re.sub("|".join(map(edge, use)), lambda m: f"[pii …{plain(m.group())[-4:]}]", text)


def test_mask_equals_one_pass_of_all_values(spark):
    rng, rows = random.Random(1), []
    for _ in range(200):
        v = ["".join(rng.choice("ab1.$\\-+(") for _ in range(rng.randint(5, 12))) for _ in range(5)]
        v += [v[0] + "x1", v[1][1:], "\\E" + v[2] + "\\Q", None, ""]
        rows.append(("".join(rng.choice([*filter(None, v), " ", "a", ".", "é", "_", "pii …"]) for _ in range(20)), v))
    rows += [(None, ["123456"]), ("", ["123456"]), ("123456", ["123456"]), ("abc", []), ("x 123456 " * 50_000, ["123456", "23456 x 1"])]
    got = [r.m for r in spark.createDataFrame(rows, "t string, v array<string>").select(S.mask(F.col("t"), F.col("v")).alias("m")).collect()]
    assert got == [brute(*r) for r in rows]


def test_a_value_inside_another_and_what_was_put_in(spark):
    one = lambda t, v: spark.createDataFrame([(t, v)], "t string, v array<string>").select(S.mask(F.col("t"), F.col("v")).alias("m")).first().m
    assert one("call 555-123-4567 or 123-4567", ["123-4567", "555-123-4567"]) == "call [pii …4567] or [pii …4567]"
    assert one("pii123 pii1234", ["pii123", "pii1234"]) == "[pii …i123] [pii …1234]"


def test_finds_are_joined_by_path(spark):
    files = spark.createDataFrame([("a", "id 123-45-6789 of jane@x.org", 1), ("b", "id 123-45-6789", 2), ("c", None, 3), ("a", "123-45-6789", 4), (None, "123-45-6789", 5)], "path string, text string, values int")
    finds = spark.createDataFrame([("a", "id_number", "123-45-6789"), ("a", "id_number", "123-45-6789"), ("a", "name", "jane@x.org"), ("b", "name", "123-45-6789"), (None, "id_number", "123-45-6789"), ("z", "id_number", "123-45-6789"), ("a", None, "jane@x.org"), ("a", "id_number", None)], "path string, label string, value string")
    got = {r["values"]: r.text for r in P.masked(files, finds, ["id"]).collect()}
    assert got == {1: "id [pii …6789] of jane@x.org", 2: "id 123-45-6789", 3: None, 4: "[pii …6789]", 5: "123-45-6789"}
    assert P.masked(files.select("path", "text"), finds, ["all"]).filter("path = 'a'").first().text == "id [pii …6789] of [pii …xorg]"
    assert P.masked(files.select("path", "text").limit(0), finds.limit(0), ["all"]).count() == 0
    got = sorted(tuple(r) for r in P.found(files.select("path", "text").filter("path = 'a'")).collect())
    assert got == [("a", "contact_email", "jane@x.org"), ("a", "id_number", "123-45-6789"), ("a", "id_number", "123-45-6789")]
