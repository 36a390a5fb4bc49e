"""Upserts, renames, deletes and change feeds on keyed tables."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last writer wins: a grouped maximum, which combines before the shuffle, instead of a sorted window."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return best.select(*key, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First writer wins."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return best.select(*key, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


def rename_docs(doc: DataFrame, edge: DataFrame, broken: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc, edge and broken_link after renames (path, new_path); documents at both ends of an edge follow."""
    r = renames.select("path", "new_path")
    new = lambda c: F.coalesce("new_path", c)
    doc2 = doc.join(r, "path", "left").withColumn("path", new("path")).drop("new_path")
    parts = []
    # Edges move only for the ends that are documents.
    for ends in product((True, False), repeat=2):
        part = edge
        for side, is_doc in zip(("source", "target"), ends, strict=True):
            of_doc = F.col(f"{side}_type").eqNullSafe("doc")
            part = part.filter(of_doc if is_doc else ~of_doc)
            if is_doc:
                part = part.join(r.withColumnRenamed("path", f"{side}_id"), f"{side}_id", "left").withColumn(f"{side}_id", new(f"{side}_id")).drop("new_path")
        parts.append(part.select(*edge.columns))
    broken2 = broken.join(r.withColumnRenamed("path", "source_doc"), "source_doc", "left").withColumn("source_doc", new("source_doc")).drop("new_path")
    return doc2, reduce(DataFrame.unionByName, parts), broken2


def delete_docs(doc: DataFrame, edge: DataFrame, broken: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc, edge and broken_link without the documents of ``gone`` (path); edges that lead to them stay."""
    g = gone.select("path").distinct()
    mark = g.select(F.col("path").alias("source_id"), F.lit("doc").alias("source_type"))
    return doc.join(g, "path", "left_anti"), edge.join(mark, ["source_type", "source_id"], "left_anti").select(*edge.columns), broken.join(g.withColumnRenamed("path", "source_doc"), "source_doc", "left_anti")


def fold_log(log: DataFrame) -> DataFrame:
    """path, op: the last operation of each path in a log (ts, n, op, path); unknown codes (T) do not count."""
    return log.filter("op in ('A', 'M', 'D', 'R')").groupBy("path").agg(F.max(F.struct("ts", "n", "op")).alias("m")).select("path", F.col("m.op").alias("op"), F.col("m.n").alias("n"))


def parse_name_status(lines: DataFrame, column: str = "line") -> DataFrame:
    """op, path, old_path of tab-separated name-status lines; other codes than A, M, D, R are left out."""
    p = F.split(column, "\t")
    code = F.substring(F.get(p, 0), 1, 1)
    renamed = code == "R"
    return lines.select(code.alias("op"), F.when(renamed, F.get(p, 2)).otherwise(F.get(p, 1)).alias("path"), F.when(renamed, F.get(p, 1)).alias("old_path")).filter(F.col("op").isin("A", "M", "D", "R") & F.col("path").isNotNull())


def latest_dates(log: DataFrame) -> DataFrame:
    """path and the newest time that a log names it."""
    return log.groupBy("path").agg(F.max("ts").alias("latest"))


def sync_action(here: Column, indexed: Column, same_stat: Column, same_md5: Column, status: Column, retry_errors: bool = False, scan: Column | None = None) -> Column:
    """What a sync does with a file: add, skip, touch, update, retry or delete.

    Equal size and time of change: nothing, but for a failed file that is to be tried again and one that still has to be
    scanned for personal data (``scan``).  Otherwise equal contents of a file in order are only touched; a failed file is
    extracted anew even if they are equal.
    """
    failed = status.isin("error", "skipped")
    scan = F.coalesce(scan & ~failed, F.lit(False)) if scan is not None else F.lit(False)
    stale = F.when(failed & F.lit(retry_errors), "retry").when(scan, "update").otherwise("skip")
    return F.when(~here, "delete").when(~indexed, "add").when(same_stat, stale).when(F.coalesce(same_md5, F.lit(False)) & ~failed & ~scan, "touch").otherwise("update")


def plan_sync(found: DataFrame, index: DataFrame, content: DataFrame, retry_errors: bool = False, pii: bool = False) -> DataFrame:
    """path, action.  found: path, size, mtime; index: path, size, mtime, md5, status, scanned; content: path, text.

    Contents are read and hashed for the files whose size or time differs, no others.
    """
    f = found.select("path", F.col("size").alias("f_size"), F.col("mtime").alias("f_mtime"), F.lit(True).alias("_f"))
    i = index.select("path", "size", "mtime", "md5", "status", "scanned", F.lit(True).alias("_i"))
    j = f.join(i, "path", "full").withColumn("same", (F.col("size") == F.col("f_size")) & (F.col("mtime") == F.col("f_mtime")))
    changed = j.filter("_f and _i and not same").select("path")
    now = content.join(changed, "path", "left_semi").select("path", F.md5(F.col("text").cast("binary")).alias("now"))
    here, indexed = F.coalesce("_f", F.lit(False)), F.coalesce("_i", F.lit(False))
    action = sync_action(here, indexed, F.col("same"), F.col("md5") == F.col("now"), F.coalesce("status", F.lit("")), retry_errors, ~F.col("scanned") if pii else None)
    return j.join(now, "path", "left").select("path", action.alias("action"))
