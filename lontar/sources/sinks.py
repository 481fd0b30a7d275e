"""Writers: Parquet shards, JSON lines, manifests, cards and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.operators.order import running_total

SHARD_CHARS = 1_000_000_000


def shard_numbers(rows: DataFrame, by: list[str], order: str, size: Column, target: int = SHARD_CHARS) -> DataFrame:
    """Adds ``shard``: the running size before a row, divided by the target; a parallel form of filling shards one by one."""
    return running_total(rows, by, order, size, "__before").withColumn("shard", F.floor(F.col("__before") / F.lit(target)).cast("int")).drop("__before")


def write_shards(rows: DataFrame, path: str, order: str, by: list[str], target: int = SHARD_CHARS, prefix: str = "") -> None:
    """Zstandard Parquet in a folder per source (``by``) and shard, named by prefix and number (``p2-shard-00000``), one file each.

    Shards hold texts of about ``target`` characters, at least one text; a source of any size is as many tasks as it has shards.  The
    numbers are made from ids and lengths alone and joined to the texts (order values are expected to be unique); null texts are
    empty ones.
    """
    sized = rows.select(order, *by, F.coalesce(F.length("text"), F.lit(0)).alias("__size"))
    numbered = shard_numbers(sized, by, order, F.col("__size"), target).select(order, F.concat(F.lit(f"{prefix}shard-"), F.lpad(F.col("shard").cast("string"), 5, "0")).alias("shard"))
    dealt = rows.join(numbered, order).repartition(*by, "shard")
    dealt.write.mode("overwrite").partitionBy(*by, "shard").option("compression", "zstd").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A manifest as JSON lines in one file, for tables of a row per source, bucket or reason; larger ones should be written as tables."""
    rows.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_lines(rows: DataFrame, path: str) -> int:
    """One JSON object per line, other letters than ASCII as they are; the number of rows."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def manifest_rows(targets: DataFrame, budgets: DataFrame, stats: DataFrame) -> DataFrame:
    """``section``, ``name``, ``key``, ``value`` of a corpus manifest: targets per bucket, budgets per source, statistics per source."""
    made = targets.select(F.lit("bucket_targets").alias("section"), F.col("bucket").alias("name"), F.lit("tokens").alias("key"), F.col("target_tokens").alias("value"))
    made = made.unionByName(budgets.select(F.lit("per_source_budget").alias("section"), F.col("source").alias("name"), F.lit("tokens").alias("key"), F.col("budget").alias("value")))
    counts = F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("bigint").alias("value")) for c in stats.columns if c != "source")))
    return made.unionByName(stats.select(F.lit("per_source_stats").alias("section"), F.col("source").alias("name"), counts.alias("c")).select("section", "name", "c.*"))


def card(counts: DataFrame) -> DataFrame:
    """``card``: a dataset card, one row, with a line for each ``part`` and its number of rows ``n``; built where the counts are."""
    line = F.concat(F.lit("| "), "part", F.lit(" | "), F.format_number("n", 0), F.lit(" |"))
    lines = counts.groupBy().agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("rows"))
    return lines.select(F.concat(F.lit("# Dataset\n\n| part | rows |\n|---|---|\n"), "rows", F.lit("\n")).alias("card"))


def report(categories: DataFrame, overall: DataFrame) -> DataFrame:
    """``report``: Markdown of an evaluation, one row: score per category, difference from the base where known, and overall; built where the scores are."""
    rounded = lambda c: F.format_string("%.1f", F.round(c, 1))
    delta = F.when(F.col("delta").isNull(), F.lit("–")).otherwise(F.concat(F.when(F.round("delta", 1) >= 0, F.lit("+")).otherwise(F.lit("")), rounded("delta")))
    lines = categories.groupBy().agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("| "), "category", F.lit(" | "), rounded("score"), F.lit(" | "), delta, F.lit(" |")))), "\n").alias("rows"))
    head = overall.select(F.concat(F.lit("# Evaluation\n\nOverall: "), rounded("overall"), F.lit("\n\n| category | score | delta |\n|---|---|---|\n")).alias("head"), F.lit(1).alias("__one"))
    both = head.join(lines.withColumn("__one", F.lit(1)), "__one")  # one row each
    return both.select(F.concat("head", "rows", F.lit("\n")).alias("report"))
