"""Queries of the training-data operators, each over its whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.llm import answers, budget, encode, languages, leakage, mixing, packing, quality, splitting
from lontar.sources.tables import table


def _limit(spark: SparkSession, sf_dir: str, task: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_limits").where(F.col("task") == task).select("max_tokens", "overlap_tokens").first()
    return int(row[0]), int(row[1] or 0)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.structural(table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "lang_samples"))


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_kinds(table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "lang_samples"))


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p2_evidence(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.below_target(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p3_quotas(spark: SparkSession, d: str) -> DataFrame:
    return mixing.quotas(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p3_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "lang_samples")
    sft = answers.defective_answers(table(spark, d, "sft_pool"), "sft_pool", "instruction", ("output",), samples)
    return sft.unionByName(answers.defective_answers(table(spark, d, "dpo_pool"), "dpo_pool", "prompt", ("chosen", "rejected"), samples))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.wrong_labels(table(spark, d, "documents"), table(spark, d, "lang_samples"), table(spark, d, "labels"))


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_segments(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    return encode.count_tokens(table(spark, d, "documents"))


def p6_slices(spark: SparkSession, d: str) -> DataFrame:
    return budget.slices(table(spark, d, "documents"), table(spark, d, "source_registry"), table(spark, d, "lang_samples"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_ids(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(encode.count_tokens(table(spark, d, "documents")), _limit(spark, d, "container")[0])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_containers(spark, d).where("part = 1").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"), *_limit(spark, d, "piece"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).where("piece = 1").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        p1_found, p1_kinds, p1_statistics, p2_found, p2_evidence, p3_found, p3_shares, p3_quotas, p3_mixture, p4_found,
        p5_found, p5_documents, p5_segments, p6_documents, p6_slices, p7_ids, p8_found, p8_containers, p9_found, p9_pieces,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    key = "replace(lower(trim({})), '-', '_')"
    sizes = f"""
    WITH t AS (SELECT {key.format('name')} AS k, min(name) AS name, max(target_share) AS target_share, max(coalesce(max_repeats, 1)) AS max_repeats
               FROM mix_targets WHERE name IS NOT NULL AND target_share IS NOT NULL GROUP BY 1),
         z AS (SELECT t.name, t.target_share, t.max_repeats, coalesce(sum(length(coalesce(d.text, ''))), 0) AS size
               FROM t LEFT JOIN documents d ON {key.format('d.source')} = t.k GROUP BY ALL)
    """
    quotas = f"""{sizes}, t0 AS (SELECT sum(size) AS total, greatest(1, round(sum(size) / {mixing.SHARD_CHARS})) * {mixing.BLOCKS} AS seats FROM z),
         c AS (SELECT name, target_share, CASE WHEN total > 0 THEN ceil(size * max_repeats / (total / seats) - 1e-9) ELSE 0 END::BIGINT AS cap, CASE WHEN total > 0 THEN seats ELSE 0 END AS seats FROM z, t0),
         q AS (SELECT *, unnest(range(0, least(cap, seats::BIGINT))) AS i FROM c WHERE target_share > 0),
         r AS (SELECT name, seats, row_number() OVER (ORDER BY target_share / (2 * i + 1) DESC, {key.format('name')}) AS r FROM q)
    SELECT name, cap AS cap_blocks, (SELECT count(*) FROM r WHERE r.name = c.name AND r.r <= r.seats) AS quota_blocks FROM c"""
    return {"p3_quotas": quotas, "p3_found": sizes + "SELECT name FROM z WHERE size * max_repeats < target_share * (SELECT sum(size) FROM z)"}
