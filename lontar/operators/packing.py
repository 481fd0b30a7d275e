"""Token sequences for training: wrapping, packing, masking, padding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lontar.operators.order import ranged, running_total
from lontar.plans.runtime import ship

IGNORED = -100


def wrapped(ids: Column, bos: int | None = None, eos: int | None = None, max_length: int | None = None) -> Column:
    """Ids without own marks at the ends, cut to leave room, with the asked marks added."""
    if bos is not None:
        ids = F.when(F.get(ids, F.lit(0)) == bos, F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)
    if eos is not None:
        ids = F.when(F.try_element_at(ids, F.lit(-1)) == eos, F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)
    if max_length is not None:
        ids = F.slice(ids, 1, max(0, max_length - (bos is not None) - (eos is not None)))
    first = F.array(F.lit(bos)) if bos is not None else F.array().cast("array<int>")
    last = F.array(F.lit(eos)) if eos is not None else F.array().cast("array<int>")
    return F.concat(first, ids, last)


def padded(ids: Column, length: int, fill: int) -> Column:
    """Exactly ``length`` ids: cut, or filled up."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))


def attention(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def shifted(ids: Column, length: int, pad: int) -> tuple[Column, Column]:
    """Inputs and next-token labels of one sequence."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return padded(F.slice(ids, 1, n), length, pad), padded(F.slice(ids, 2, n), length, IGNORED)


def masked_labels(ids: Column, marker: list[int]) -> Column:
    """Labels with everything up to and with the first marker ignored; unmasked without a marker.

    The search leaves out the last place at which a marker would end the sequence.
    """
    m = len(marker)
    text = F.concat(F.lit(" "), F.array_join(ids.cast("array<string>"), " "), F.lit(" "))
    at = F.instr(text, " " + " ".join(map(str, marker)) + " ")
    before = F.substring(text, F.lit(1), at - 1)
    place = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    until = F.when((at > 0) & (place < F.size(ids) - m), place + m).otherwise(F.lit(0))
    return F.concat(F.array_repeat(F.lit(IGNORED), until), F.slice(ids, until + 1, F.size(ids)))


def decoded(rows: DataFrame, key: str, ids: str, vocabulary: DataFrame, special: tuple[int, ...]) -> DataFrame:
    """``key`` and ``text``: the words of the ids, joined by blanks, without special ids and ids that the vocabulary lacks.

    ``vocabulary`` has ``token`` and ``word``.  It is a tokenizer's, so its size is given beforehand; it is broadcast and looked up
    where the ids are.  Of a token's several words the first in the alphabet counts; null and empty ids give the empty text.
    """
    ship(rows.sparkSession)
    made = vocabulary.where(F.col("token").isNotNull() & ~F.col("token").isin(*special)).groupBy("token").agg(F.min("word").alias("word")).toArrow()
    words = rows.sparkSession.sparkContext.broadcast(dict(zip(made["token"].to_pylist(), made["word"].to_pylist())))

    @F.arrow_udf(StringType())
    def text(ids: pa.Array) -> pa.Array:
        known = words.value
        return pa.array([" ".join(known[i] for i in row if i in known) if row else "" for row in ids.to_pylist()], pa.string())

    return rows.select(key, text(F.col(ids)).alias("text"))


def batches(rows: DataFrame, order: str, ids: str, size: int, pad: int) -> DataFrame:
    """``order``, ``batch``, ``ids``, ``attended``: rows in batches of ``size`` in order, padded to the longest of their batch; ``attended`` ids of each are its own.

    Only the lengths are ranked and aggregated; the ids are joined to their batch's length afterwards (order values are
    expected to be unique).
    """
    numbered = running_total(rows.select(order, F.size(ids).alias("n")), [], order, F.lit(1), "rank").select(order, "n", F.floor(F.col("rank") / size).alias("batch"))
    longest = numbered.groupBy("batch").agg(F.max("n").alias("longest"))
    placed = numbered.join(longest, "batch").select(order, "batch", "longest", "n")
    fill = F.array_repeat(F.lit(pad), (F.col("longest") - F.col("n")).cast("int"))
    return rows.select(order, ids).join(placed, order).select(order, "batch", F.concat(ids, fill).alias("ids"), F.col("n").alias("attended"))


def pack(rows: DataFrame, order: str, ids: str, length: int, bos: int, eos: int) -> DataFrame:
    """``seq``, ``ids``: full sequences of ``length`` ids, each beginning with ``bos``, documents ended by ``eos``.

    Documents are dealt to partitions by ranges of the order.  One number per partition, its ids, tells at which place
    of which sequence each partition begins; from there it cuts its own stream, in order, so that only the
    parts of sequences that run over a partition's ends - two of each partition - are shuffled once more.  The rest that fills
    no sequence is left out, as are documents without ids.
    """
    ship(rows.sparkSession)
    body = length - 1
    full = rows.select(F.col(order).alias("o"), F.col(ids).cast("array<int>").alias("d")).where(F.size("d") > 0)
    placed = ranged(full, ["o"], "part")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum(F.size("d") + 1).alias("n")).collect())  # one row per partition
    starts, total = {}, 0
    for part, n in sizes:
        starts[part] = total
        total += n

    def cut_stream(batches):
        place, rest = None, np.zeros(0, np.int32)
        for batch in batches:
            lists = batch.column(1)
            ends = lists.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            if not len(ends):
                continue
            if place is None:
                place = starts[batch.column(0)[0].as_py()]
            rest = np.concatenate([rest, np.insert(lists.flatten().to_numpy(zero_copy_only=False), ends, eos).astype(np.int32)])
            seq, places, parts = [], [], []
            if place % body and len(rest):
                n = min(len(rest), body - place % body)
                seq, places, parts = [place // body], [place], [rest[:n]]
                place, rest = place + n, rest[n:]
            whole = len(rest) // body
            seq += range(place // body, place // body + whole) if whole else []
            places += range(place, place + whole * body, body)
            parts += list(rest[: whole * body].reshape(whole, body))
            place, rest = place + whole * body, rest[whole * body :]
            yield _parts(seq, places, parts)
        if len(rest):
            yield _parts([place // body], [place], [rest])

    schema = "seq bigint, p bigint, part array<int>"
    sorted_rows = placed.sortWithinPartitions("o", F.xxhash64("o", "d")).select("part", "d")
    parts = sorted_rows.mapInArrow(cut_stream, schema).where(F.col("seq") < F.lit(total // body))
    whole = parts.where(F.size("part") == body).select("seq", "part")
    ends = parts.where(F.size("part") < body).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("p", "part"))).alias("parts")).select("seq", F.flatten(F.col("parts.part")).alias("part"))
    return whole.unionByName(ends).select("seq", F.concat(F.array(F.lit(bos)), "part").alias("ids"))


def _parts(seq: list[int], places: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(places, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], names=["seq", "p", "part"])
