"""Building a pre-training corpus: registry, filters, decontamination, budgets and the funnel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.functions import rules as R
from lontar.functions import text as T
from lontar.functions.grams import gram_candidates, gram_hashes, gram_hits
from lontar.operators.dedup import near_copies, shingle_sets
from lontar.operators.order import first_wins
from lontar.plans.runtime import broadcast_small, cut, ship, spread
from lontar.sources.readers import stopword_scores

NGRAM = 13
MIN_WORDS, MAX_WORDS, LID_THRESHOLD = 50, 100_000, 0.65
#: Distinct test n-grams up to which their hashes are broadcast (32 MB); beyond, a bitmap of this many 64-bit words is (32 MB, a power of two).
MOST_GRAMS, BITMAP_WORDS = 4_000_000, 1 << 22


def source_key(name: Column) -> Column:
    """Source names differ in case, outer blanks and ``-`` for ``_`` only in spelling."""
    return F.translate(F.lower(T.strip(name)), "-", "_")


def registry(table: DataFrame) -> DataFrame:
    """One row per source: thresholds with their defaults, of repeated rows the one with the first name.

    The rank (by key) orders the sources for everything that depends on their order.
    """
    named = table.where("name is not null").withColumn("source", source_key(F.col("name")))
    columns = ["bucket", "language", "lid_threshold", "min_words", "max_words", "text_field"]
    one = named.groupBy("source").agg(F.min(F.struct("name", *columns)).alias("r"))
    default = {"lid_threshold": LID_THRESHOLD, "min_words": MIN_WORDS, "max_words": MAX_WORDS, "language": ""}
    return one.select("source", *(F.coalesce(F.col(f"r.{c}"), F.lit(default[c])).alias(c) if c in default else F.col(f"r.{c}").alias(c) for c in columns))


def sourced(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """Documents of registered sources with their specification; the registry is a small dimension."""
    text = T.text_or_empty(F.col("text"))
    rows = spread(documents.select("doc_id", text.alias("text"), source_key(F.col("source")).alias("source")))
    return rows.join(broadcast_small(specs), "source")


def filtered(rows: DataFrame) -> DataFrame:
    """Adds the scrubbed text, its exact key and estimated tokens, and the first ``reason`` to drop it: length, gopher or null.

    The text is scrubbed in a projection of its own, before the expressions that read it.
    """
    return verdicts(rows.withColumn("text", T.scrub(F.col("text"))))


def verdicts(rows: DataFrame) -> DataFrame:
    """``filtered`` for scrubbed texts."""
    ship(rows.sparkSession)
    judged = rows.withColumn("verdict", R.gopher(F.col("text"), F.col("min_words"), F.col("max_words")))
    # all by the verdict alone, so that no filter on them is rewritten into one on the text and scrubs it again
    verdict = F.col("verdict.reason")
    tokens = F.greatest(F.lit(1), F.floor(F.col("verdict.n_words") * F.lit(0.75)).cast("int"))
    made = judged.withColumn("gopher", F.when(verdict != "length", verdict)).withColumn("reason", F.when(verdict == "length", "length").when(verdict.isNotNull(), "gopher"))
    return made.withColumn("key", F.sha2("text", 256)).withColumn("tokens", tokens).drop("verdict")


def test_grams(items: DataFrame, n: int = NGRAM) -> DataFrame:
    return items.select(F.explode(gram_hashes(n)("text")).alias("gram")).distinct()


def leaked(rows: DataFrame, items: DataFrame, id_col: str, text: Column, name: str, n: int = NGRAM, most_grams: int = MOST_GRAMS) -> DataFrame:
    """Adds ``name``: whether the text shares a word n-gram with a test item (by 64-bit hashes of the n-grams).

    The distinct n-grams of the items, counted first, are looked up as a broadcast sorted array where the texts are
    read.  Beyond ``most_grams`` a bitmap of fixed size takes its place; only the n-grams that it lets through
    are shuffled, to be compared with those of the items (ids are expected to be unique then).
    """
    spark = rows.sparkSession
    ship(spark)
    grams = cut(test_grams(items, n))
    if grams.limit(most_grams + 1).count() <= most_grams:
        known = np.sort(grams.toArrow()["gram"].to_numpy())
        return rows.withColumn(name, gram_hits(n, spark.sparkContext.broadcast(known))(text))
    place = F.col("gram").bitwiseAND(F.lit(BITMAP_WORDS * 64 - 1))
    words = grams.select(place.alias("p")).select(F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    filled = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(BITMAP_WORDS, np.uint64)
    bitmap[filled["w"].to_numpy()] = filled["b"].to_numpy().view(np.uint64)
    own = rows.select(F.col(id_col).alias("__leak"), F.explode(gram_candidates(n, spark.sparkContext.broadcast(bitmap))(text)).alias("gram"))
    found = own.join(grams, "gram", "left_semi").select("__leak").distinct()
    return rows.join(found, rows[id_col] == found["__leak"], "left").withColumn(name, F.col("__leak").isNotNull()).drop("__leak")


def contaminated(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", n: int = NGRAM, text: Column | None = None) -> DataFrame:
    """Ids of the documents that share a word n-gram with a test item, each once."""
    made = documents.select(id_col, (F.col("text") if text is None else text).alias("__text"))
    return leaked(made, items, id_col, F.col("__text"), "__hit", n).where("__hit").select(id_col).distinct()


def staged(documents: DataFrame, registry_table: DataFrame, items: DataFrame, lexicons: dict[str, list[str]]) -> DataFrame:
    """``doc_id``, ``source``, ``bucket``, ``tokens``, ``reason`` (length, gopher, lid, exact, near, decontam or null) of every document of a registered source.

    Verdicts, exact keys and hits of test n-grams come from one read of the texts and are written, without the texts, to the
    checkpoint folder.  ``near_copies`` makes the shingles from the texts, as they would be larger.  Exact copies are counted
    across sources, the first by source and id wins.  Near copies (Jaccard similarity of word shingles of 0.8 or more, exactly)
    are counted within a source among the first rows of each key, the first by id wins.  Keys and near copies are taken before
    decontamination, so copies of contaminated texts count as copies.

    The language of a text is the one with most function words; it must be the source's, with a share of the
    hits of all languages of ``lid_threshold`` or more.  Sources without a language pass; Malay is judged
    with Indonesian, whose function words it shares; other languages without a lexicon pass.
    """
    scrubbed = sourced(documents, registry(registry_table)).withColumn("text", T.scrub(F.col("text")))
    # all measures of the text alone, so that one Python pass makes them
    rows = verdicts(leaked(scrubbed.withColumn("lid", stopword_scores(F.col("text"), lexicons)), items, "doc_id", F.col("text"), "leak"))
    expected = F.when(F.col("language") == "ms", F.lit("id")).otherwise(F.col("language"))
    asked = F.col("reason").isNull() & expected.isin(*lexicons)
    wrong = asked & ~F.coalesce((F.col("lid.language") == expected) & (F.col("lid.probability") >= F.col("lid_threshold")), F.lit(False))
    marked = rows.withColumn("reason", F.coalesce("reason", F.when(wrong, "lid")))
    small = cut(marked.select("doc_id", "source", "bucket", "tokens", "key", "reason", "leak"))
    winners = cut(first_wins(small.where("reason is null"), ["key"], ["source", "doc_id"]).select("doc_id"))
    texts = documents.select(F.col("doc_id").alias("id"), source_key(F.col("source")).alias("grp"), T.scrub(T.text_or_empty(F.col("text"))).alias("text"))
    near = near_copies(spread(texts), winners.select(F.col("doc_id").alias("id")), shingle_sets(False)(F.col("text")))[0].where("not kept").select(F.col("id").alias("__near"))
    joined = small.join(winners.select(F.col("doc_id").alias("__win")), F.col("doc_id") == F.col("__win"), "left").join(near, F.col("doc_id") == F.col("__near"), "left")
    later = F.when(F.col("__win").isNull(), "exact").when(F.col("__near").isNotNull(), "near").when(F.col("leak"), "decontam")
    return joined.select("doc_id", "source", "bucket", "tokens", F.coalesce("reason", later).alias("reason"))


REASONS = ("length", "gopher", "lid", "exact", "near", "decontam")


def funnel(stages: DataFrame, reasons: tuple[str, ...] = REASONS) -> DataFrame:
    """Per source: documents seen and kept, tokens kept, documents dropped by reason."""
    dropped = [F.count_if(F.col("reason") == r).alias(f"dropped_{r}") for r in reasons]
    kept = F.col("reason").isNull()
    return stages.groupBy("source").agg(F.count("*").alias("seen_docs"), F.count_if(kept).alias("kept_docs"), F.coalesce(F.sum(F.when(kept, F.col("tokens"))), F.lit(0)).alias("kept_tokens"), *dropped)


def bucket_targets(mix: DataFrame, total_tokens: int) -> DataFrame:
    """Tokens of each bucket: the middle of its range, normalised over all buckets, rounded down."""
    middle = (F.col("share_min") + F.col("share_max")) / F.lit(2.0)
    rows = mix.where("bucket is not null").select("bucket", middle.alias("middle"))
    total = rows.agg(F.sum("middle")).first()[0]
    return rows.select("bucket", F.floor(F.lit(total_tokens) * F.col("middle") / F.lit(total)).cast("bigint").alias("target_tokens"))


def source_budgets(specs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each source's equal part of its bucket's target, rounded down."""
    counted = specs.groupBy("bucket").agg(F.count("*").alias("sources"))
    return specs.select("source", "bucket").join(counted, "bucket").join(targets, "bucket").select("source", "bucket", F.floor(F.col("target_tokens") / F.col("sources")).cast("bigint").alias("budget"))
