"""A training corpus from raw documents: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm import bpe, lines, minhash, mixing, rules
from inkweave.llm.common import settle, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the learned list keep."""
    return rules.filter_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a document of which nothing is left goes."""
    out = lines.dedup_lines(docs, whole=True).filter(~((F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that with the smallest doc_id."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight: a row for each document and pass with the words that the mix takes."""
    return mixing.mix_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the encoded and decoded text of each row of the mix."""
    return bpe.digests(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("encoding", encode)]

#: The learned list, MinHash and the permutations have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one returns is written and read again as the docs of the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
