"""Markdown sections: a text cut at its headings, each with the path of headings above it; fenced code has no headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The formats of headings and of fences.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
FENCE = r"^\s*(```|~~~)"
FRONT = r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)"


def lines_of(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, i, line, level and title of headings (null elsewhere), without a block of front matter and without closing marks;
    running sums over one document's lines find the fences."""
    at = Window.partitionBy(key).orderBy("i")
    d = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, FRONT, ""), "\n")).alias("i", "line"))
    d = d.withColumn("fence", F.col("line").rlike(FENCE)).withColumn("inside", F.sum(F.col("fence").cast("int")).over(at) % 2 == 1)
    heading = ~F.col("fence") & ~F.col("inside") & F.col("line").rlike(HEADING)
    return d.select(key, "i", "line", F.when(heading, F.length(F.regexp_extract("line", HEADING, 1))).alias("level"), F.when(heading, F.regexp_extract("line", HEADING, 2)).alias("title"))


def sections(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, section (from 0: what comes before any heading), heading (``A > B``), text; sections without text go, unless all have none."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = lines_of(docs, key, text)
    of = lambda level, value: F.when(F.col("level") == level, F.col(value))
    d = d.select("*", F.count("level").over(w).alias("section"), *(F.max(of(k, "i")).over(w).alias(f"p{k}") for k in range(1, 7)), *(F.last(of(k, "title"), ignorenulls=True).over(w).alias(f"t{k}") for k in range(1, 7)))
    # A heading counts until one of a smaller level follows.
    above = lambda k: F.greatest(*(F.coalesce(f"p{j}", F.lit(-1)) for j in range(1, k)), F.lit(-1), F.lit(-1))
    crumbs = F.array_compact(F.array(*(F.when(F.col(f"p{k}") > above(k), F.col(f"t{k}")) for k in range(1, 7))))
    d = d.select(key, "section", "i", "level", "line", F.array_join(crumbs, " > ").alias("heading"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("level").isNull(), F.struct("i", "line")))), lambda e: e["line"]), "\n")
    out = d.groupBy(key, "section").agg(F.max("heading").alias("heading"), F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")).alias("text"))
    full = Window.partitionBy(key)
    return out.withColumn("any", F.max(F.col("text") != "").over(full)).filter("text <> '' or (not any and heading <> '')").drop("any")
