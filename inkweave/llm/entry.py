"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkweave.llm import alignment, bpe, exact, html, licences, lines, lm, minhash, mixing, rules, sharding, suffix, whitening
from inkweave.llm.common import table


def op1_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and the verdict of the learned list."""
    return rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document without repeated runs of lines."""
    return lines.digests(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on 3-word shingles at similarity 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85, rows=4, bands=20)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; the target is every document labelled good and not toxic."""
    return lm.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte windows that start in an earlier one."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements of every document."""
    return licences.licences(table(spark, sf_dir, "documents"))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encoded and decoded text of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.report(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of every document in two vocabularies."""
    return alignment.digests(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.report(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_rules, op2_lines, op3_mixing, op4_minhash, op5_lm, op6_suffix, op7_licences, op8_exact, op9_bpe, op10_html, op11_shards, op12_alignment, op13_whitening, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_lines": lines.ORACLE_SQL, "op4_minhash": minhash.ORACLE_SQL, "op6_suffix": suffix.ORACLE_SQL, "op8_exact": exact.ORACLE_SQL, "op11_shards": sharding.ORACLE_SQL}
