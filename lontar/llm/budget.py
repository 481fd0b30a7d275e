"""Totals of tokens by source, by language and by bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.arrow import batch, map_batches
from lontar.llm.bpe import piece_counts, tokenizer_path
from lontar.llm.encode import CHUNK_CHARS, chunks
from lontar.llm.languages import LanguageModel
from lontar.llm.mixing import source_key
from lontar.plans.runtime import broadcast_small, spread


def registered(registry: DataFrame) -> DataFrame:
    """One row per source key: ``key``, ``name``, ``bucket``, ``language`` (``code`` where the registry leaves it empty).

    Repeated rows and other spellings of a name fall together; the spelling without
    blanks and capitals is kept.
    """
    named = registry.where("name is not null").withColumn("key", source_key(F.col("name")))
    language = F.coalesce(F.nullif(F.trim("language"), F.lit("")), F.lit("code"))
    return named.groupBy("key").agg(F.max(F.when(F.col("name") == F.col("key"), F.col("name")).otherwise(F.col("key"))).alias("name"), F.max("bucket").alias("bucket"), F.max(language).alias("language"))


def slices(documents: DataFrame, registry: DataFrame, samples: DataFrame, path: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``level``, ``slice``, ``documents``, ``tokens``: totals by source, registered language, true language and bucket.

    Sources that are null or not registered count as ``(unregistered)`` in every level but
    the true language, which is read off the text; texts without words have the true
    language ``(none)``.

    Tokens and language come from one pass over the texts, which gives a row for each source and language of a
    batch, so no document is shuffled.  Oversized texts are cut at the tokenizer's proven boundaries, which are also
    boundaries of words, and salted: their tokens and the scores of their words add up by document (``doc_id`` is expected to be
    unique; rows without one are one document each).
    """
    path = path or tokenizer_path()
    model = LanguageModel.fit(samples)
    names, width = model.languages, len(model.languages)
    rows = spread(documents.select("doc_id", "text", source_key(F.col("source")).alias("key")))
    long = F.coalesce(F.length("text"), F.lit(0)) > 2 * chunk_chars

    def measured(texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Tokens, words and summed language scores of each text."""
        count = piece_counts(path).count
        segments = model.segments(texts)
        words = np.array([sum(s.words for s in x) for x in segments], np.int64)
        scores = np.array([sum((s.mean * s.words for s in x), np.zeros(width)) for x in segments]).reshape(-1, width)
        return [count(t) if t else 0 for t in texts], words, scores

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        tokens, words, scores = measured(b.column(1).to_pylist())
        best = scores.argmax(1) if len(scores) else []
        found: dict[tuple, list[int]] = {}
        for key, n, w, k in zip(b.column(2).to_pylist(), tokens, words, best):
            slot = found.setdefault((key, names[k] if w else None), [0, 0])
            slot[0] += 1
            slot[1] += n
        return batch(key=pa.array([k for k, _ in found], pa.string()), language=pa.array([x for _, x in found], pa.string()), documents=pa.array([v[0] for v in found.values()], pa.int64()), tokens=pa.array([v[1] for v in found.values()], pa.int64()))

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        tokens, words, scores = measured(b.column(1).to_pylist())
        return batch(id=b.column(0), key=b.column(2), tokens=pa.array(tokens, pa.int64()), words=pa.array(words), **{f"s{k}": pa.array(scores[:, k]) for k in range(width)})

    schema = "key string, language string, documents bigint, tokens bigint"
    short = map_batches(rows.where(~long), whole, schema)
    cut = rows.where(long).select(F.coalesce(F.col("doc_id").cast("string"), F.uuid()).alias("id"), "key", F.posexplode(chunks(size=chunk_chars)).alias("part", "text"))
    parts = map_batches(cut.repartition(F.xxhash64("id", "part")).select("id", "text", "key"), part, "id string, key string, tokens bigint, words bigint, " + ", ".join(f"s{k} double" for k in range(width)))
    summed = parts.groupBy("id").agg(F.first("key").alias("key"), F.sum("tokens").alias("tokens"), F.sum("words").alias("words"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(width)))
    scores = F.array(*(F.col(f"s{k}") for k in range(width)))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position(scores, F.array_max(scores)).cast("int"))
    oversized = summed.select("key", F.when(F.col("words") > 0, best).alias("language"), F.lit(1).cast("bigint").alias("documents"), "tokens")

    none = F.lit("(unregistered)")
    counted = short.unionByName(oversized).groupBy("key", F.coalesce("language", F.lit("(none)")).alias("true_language")).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    keyed = counted.join(broadcast_small(registered(registry)), "key", "left")
    cube = keyed.select(F.coalesce("name", none).alias("source"), F.coalesce("language", none).alias("language"), "true_language", F.coalesce("bucket", none).alias("bucket"), "documents", "tokens")
    level = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.col(n).alias("slice")) for n in ("source", "language", "true_language", "bucket"))))
    return cube.select(level.alias("s"), "documents", "tokens").groupBy("s.level", "s.slice").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
