"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import bpe, budget, format_dedup, leak, mixing, mojibake, pairs, pii, quality
from sievewright.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(table(spark, sf_dir, "document_revisions"))


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(table(spark, sf_dir, "document_revisions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dedup.copy_pairs(table(spark, sf_dir, "source_lines"))


def p2_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dedup.representatives(table(spark, sf_dir, "source_lines"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairs.contribution_pairs(table(spark, sf_dir, "contributions")).unionByName(pairs.conversation_pairs(table(spark, sf_dir, "canonical_conversations")))
    return pairs.defective(both)


def p4_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.token_budget(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_estimates"), table(spark, sf_dir, "release_sources"))


def p4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.token_counts(table(spark, sf_dir, "documents"))


def p4_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.estimate_budget(table(spark, sf_dir, "token_estimates"), table(spark, sf_dir, "release_sources"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_lines(table(spark, sf_dir, "document_revisions"))


def _key(spark: SparkSession) -> bytes | None:
    """The pseudonyms' key from the session, where one is kept; else one is drawn for each run."""
    kept = spark.conf.get("spark.sievewright.pseudonym.key", "")
    return kept.encode() or None


def p5_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(table(spark, sf_dir, "document_revisions"), key=_key(spark))


def p5_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked(table(spark, sf_dir, "document_revisions"), key=_key(spark))


def p6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "release_mixture"))


def p6_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.domain_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "release_mixture"))


def p6_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "release_mixture"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.affected(table(spark, sf_dir, "documents"))


def p9_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repairs(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p4_estimates": budget.ESTIMATE_SQL}
