"""Personal data: which of the found values are masked, and the texts of files without them.

Found values are a table (path, label, value).  Those whose label begins with one of the masked labels, and that have six
letters or digits, go; the others are an inventory.  A file's values are made distinct before they meet, so its group has
no more of them than its own text; each text meets its values in one join, and is masked in one pass.

Defined results: null paths, labels and values are no finds; a file without values keeps its text; a null text stays null;
values of files that are not there do nothing; rows that repeat a path are masked each.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import scalars as S


def masked_label(label: Column, labels: Iterable[str]) -> Column:
    """Whether a label begins with one of ``labels``; ``all`` among them takes every label."""
    labels = list(labels)
    if "all" in labels:
        return label.isNotNull()
    out = F.lit(False)
    for x in labels:
        out = out | label.startswith(x)
    return out


def found(files: DataFrame) -> DataFrame:
    """path, label, value: what rules find in texts (path, text); values of a label are distinct within a row."""
    t = F.coalesce(F.col("text"), F.lit(""))
    kinds = {"contact_email": S.emails(t), "id_digits": S.digit_runs(t), "id_number": S.identifiers(t)}
    each = F.concat(*(F.transform(F.array_distinct(v), _labelled(k)) for k, v in kinds.items()))
    return files.select("path", F.explode(each).alias("e")).select("path", "e.label", "e.value")


def _labelled(label: str):
    return lambda x: F.struct(F.lit(label).alias("label"), x.alias("value"))


def values(finds: DataFrame, labels: Iterable[str]) -> DataFrame:
    """path, values: what is masked in each file that has something to mask."""
    f = finds.filter(F.col("path").isNotNull() & masked_label(F.col("label"), labels) & S.substantial(F.col("value")))
    return f.groupBy("path").agg(F.collect_set("value").alias("values"))


def masked(files: DataFrame, finds: DataFrame, labels: Iterable[str], text: str = "text") -> DataFrame:
    """files with their texts masked by the finds of their paths."""
    new = S.mask(F.col(f"f.`{text}`"), F.coalesce("v.values", F.array().cast("array<string>"))).alias(text)
    both = files.alias("f").join(values(finds, labels).alias("v"), F.col("f.path") == F.col("v.path"), "left")
    return both.select(*(new if c == text else F.col(f"f.`{c}`") for c in files.columns))
