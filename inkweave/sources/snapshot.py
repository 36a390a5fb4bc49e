"""Versions of derived tables in one folder: data first, a small manifest last.

Each change writes new files beside the old ones and then one manifest, a single file whose appearance makes the change
visible as a whole.  What a broken run has left behind is in no manifest; the next run writes the same version again, over
it.  Readers never wait and see the version that they have opened.  One writer at a time.

A table is cut into buckets by a hash of its key; a manifest says in which version each bucket was last written, so a
change rewrites the buckets of the keys that it touches and no others.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(buckets))


@dataclass
class Snapshot:
    """One version of the tables under ``root``; ``facts`` are small figures that go with it (a watermark, counts)."""

    spark: SparkSession
    root: str
    version: int = 0
    tables: dict = field(default_factory=dict)
    facts: dict = field(default_factory=dict)

    @staticmethod
    def latest(spark: SparkSession, root: str) -> Snapshot:
        """The newest version, an empty one (number 0) if there is none."""
        try:
            found = spark.read.schema("content string, v long").json(f"{root}/manifest").orderBy(F.desc("v")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        return Snapshot(spark, root, found["v"], **json.loads(found["content"])) if found else Snapshot(spark, root)

    def next(self) -> Snapshot:
        """The version to come, which starts with the tables of this one."""
        return Snapshot(self.spark, self.root, self.version + 1, json.loads(json.dumps(self.tables)), dict(self.facts))

    def commit(self) -> Snapshot:
        """Makes this version the newest: the last thing that a change writes."""
        content = json.dumps({"tables": self.tables, "facts": self.facts})
        self.spark.createDataFrame([(content,)], "content string").coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/v={self.version}")
        return self

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        table = self.tables[name]
        schema = StructType.fromJson(table["schema"])
        paths = [f"{self.root}/{name}/v={v}/bucket={b}" for b, v in table["written"].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).select(*schema.names)

    def touched(self, key: str, touched: DataFrame, tables: dict[str, Column], buckets: int = 64) -> dict[str, list[int]]:
        """The touched buckets of several tables, from one job.  tables: by name, which keys a table can have rows of."""
        number = lambda name: bucket(F.col(key), self.tables.get(name, {}).get("buckets", buckets)).cast("int")
        found = touched.agg(*(F.collect_set(F.when(holds, number(name))).alias(name) for name, holds in tables.items())).first()
        return {name: sorted(found[name]) for name in tables}

    def replace(self, name: str, key: str, touched: DataFrame, rows: DataFrame, buckets: int = 64, hit: list[int] | None = None) -> list[int]:
        """Drops the rows of the touched keys (a frame with the column ``key``) and adds ``rows``; gives the buckets written.

        rows: of touched keys only; their columns are the table's.  The driver sees the numbers of touched buckets, which
        are counted here unless ``hit`` has them.
        """
        table = self.tables.setdefault(name, {"schema": json.loads(rows.schema.json()), "buckets": buckets, "written": {}})
        if [f.name for f in rows.schema] != [f["name"] for f in table["schema"]["fields"]]:
            raise ValueError(f"the columns of {name} are others")
        number = lambda c: bucket(F.col(c), table["buckets"])
        if hit is None:
            hit = self.touched(key, touched, {name: F.lit(True)}, buckets)[name]
        if not hit:
            return hit
        path = f"{self.root}/{name}/v={self.version}"
        # What stays lies in its bucket's files and is copied where it is read; only new rows move.
        out = rows.withColumn("bucket", number(key)).hint("rebalance", "bucket")
        if any(str(b) in table["written"] for b in hit):
            kept = self.read(name, hit).join(touched.select(key), key, "left_anti").select(*rows.columns)
            out = kept.withColumn("bucket", number(key)).unionByName(out)
        out.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
        schema = StructType([*StructType.fromJson(table["schema"]).fields, StructField("bucket", LongType())])
        there = {int(b) for f in self.spark.read.schema(schema).parquet(path).inputFiles() for b in re.findall(r"/bucket=(\d+)/[^/]*$", f)}
        for b in hit:
            table["written"].pop(str(b), None)
            if b in there:
                table["written"][str(b)] = self.version
        return hit
