"""Grading of answers by keywords, roll-ups and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.functions import rules as R
from lontar.functions import text as T


def graded(answers: DataFrame) -> DataFrame:
    """Adds ``reasons``, ``pass``, and previews ``a50``, ``a500`` to answers with keywords; null answers are empty ones."""
    rows = answers.withColumn("answer", T.text_or_empty(F.col("answer"))).withColumn("must", F.coalesce("must", F.array().cast("array<string>"))).withColumn("must_not", F.coalesce("must_not", F.array().cast("array<string>")))
    reasons = R.grade(F.col("answer"), F.col("must"), F.col("must_not"), F.coalesce("min_length", F.lit(0)))
    return rows.withColumn("reasons", reasons).withColumn("pass", F.size("reasons") == 0).withColumn("a50", F.substring("answer", 1, 50)).withColumn("a500", F.substring("answer", 1, 500))


def by_category(grades: DataFrame) -> DataFrame:
    correct = F.count_if("pass")
    return grades.groupBy("category").agg(correct.alias("correct"), F.count("*").alias("total"), (correct / F.count("*") * 100).alias("score"), F.max("weight").alias("weight"))


def overall(categories: DataFrame) -> DataFrame:
    weight = F.sum("weight")
    return categories.agg((F.sum(F.col("score") * F.col("weight")) / F.when(weight > 1, weight).otherwise(F.lit(1.0))).alias("overall"))


def delta(model: DataFrame, base: DataFrame) -> DataFrame:
    """Score of the model less that of the base per category; a category that the base lacks has a null delta."""
    b = base.select("category", F.col("score").alias("base_score"))
    return model.join(b, "category", "left").select("category", "score", "base_score", (F.col("score") - F.col("base_score")).alias("delta"))


def perplexity(losses: DataFrame, by: list[str]) -> DataFrame:
    """exp of the token-weighted mean loss; groups without tokens have a null."""
    n = F.sum("n_tokens")
    return losses.groupBy(*by).agg(F.exp(F.sum(F.col("loss") * F.col("n_tokens")) / F.nullif(n, F.lit(0))).alias("perplexity"))


def fertility(rows: DataFrame, by: list[str]) -> DataFrame:
    """Tokens per word; 0 without words."""
    words = F.sum("n_words")
    return rows.groupBy(*by).agg(F.sum("n_tokens").alias("tokens"), words.alias("words"), F.when(words > 0, F.sum("n_tokens") / words).otherwise(F.lit(0.0)).alias("fertility"))
