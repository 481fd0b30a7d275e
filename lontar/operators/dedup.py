"""Exact and near duplicates; in all of them the first row in the given order wins."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType

from lontar.functions.grams import rolled, word_hashes
from lontar.operators.order import first_wins
from lontar.plans.runtime import broadcast_small, cut, ship

SHINGLE_WORDS = 5
_FIRST = np.ones(1, bool)
#: Cells of a byte (32 MB at most, a power of two) in which shingles are counted, and how many are one row on the way.
MOST_CELLS, CELL_BLOCK = 1 << 25, 1 << 16
#: Pairs of a bucket for each of its rows up to which all are formed, similar pairs that one task goes through, ids that are broadcast.
PAIRS_EACH, MOST_EDGES, MOST_IDS = 10, 1_000_000, 400_000


def exact(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key: ``key``, the order columns and the number of ``copies``."""
    return first_wins(df.withColumn("key", key), ["key"], order)


def by_two_keys(df: DataFrame, exact_key: Column, fuzzy_key: Column, order: str) -> DataFrame:
    """``order``, ``kept``, ``reason``: exact copies go first, then copies by the coarser key among the rest.

    A row is an ``exact`` copy when an earlier one has its exact key, otherwise a ``fuzzy``
    one when an earlier row that is no exact copy has its coarser key.  The keys are made
    once and written, without the texts, to the checkpoint folder.
    """
    keyed = cut(df.select(order, exact_key.alias("e"), fuzzy_key.alias("f")))
    firsts = first_wins(keyed, ["e"], [order]).select(F.col(order).alias("__e"))
    marked = keyed.join(firsts, keyed[order] == F.col("__e"), "left").withColumn("first", F.col("__e").isNotNull())
    kept = first_wins(marked.where("first"), ["f"], [order]).select(F.col(order).alias("__f"))
    both = marked.join(kept, marked[order] == F.col("__f"), "left").withColumn("kept", F.col("__f").isNotNull())
    reason = F.when(~F.col("first"), "exact").when(~F.col("kept"), "fuzzy")
    return both.select(order, "kept", reason.alias("reason"))


def shingles(texts: list[str | None], short_whole: bool) -> pa.ListArray:
    """The distinct hashes of each text's word shingles, sorted, for an Arrow batch; a null text has none (null).

    Texts of fewer than five words have one shingle, the whole text (``short_whole``), or a mark that all
    texts without shingles share, as there is nothing in which they differ.
    """
    words, sizes = word_hashes(texts)
    runs = rolled(words, SHINGLE_WORDS)
    parts, offsets, at, mark = [], [0], 0, np.zeros(1, np.uint64)
    for text, size in zip(texts, sizes):
        if size >= SHINGLE_WORDS:
            h = np.sort(runs[at : at + size - SHINGLE_WORDS + 1])
            h = h[np.concatenate((_FIRST, h[1:] != h[:-1]))]
        else:
            h = rolled(words[at : at + size], size) if size and short_whole else mark
        at += size
        if text is not None:
            parts.append(h)
        offsets.append(offsets[-1] + (len(h) if text is not None else 0))
    flat = pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))
    missing = pa.array([t is None for t in texts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=missing)


def shingle_sets(short_whole: bool):
    """An Arrow function: text to its sorted shingle hashes."""

    @F.arrow_udf(ArrayType(LongType()))
    def sets(text: pa.Array) -> pa.Array:
        return shingles(text.to_pylist(), short_whole)

    return sets


def shingle_counts(sets: DataFrame, most_cells: int = MOST_CELLS) -> tuple[np.ndarray, bool]:
    """How many texts have the shingles of each cell (a shingle's last bits), 255 at most, and whether all texts were counted.

    There are half as many cells as shingles, or twice that, but at most ``most_cells``; what would fill these more than twice
    on average isn't counted (texts are left out by a hash of the id).  The counts only order the shingles of a
    text, rare ones first; whatever they are, no similar pair is lost.  Each task adds up its cells in an array of bytes.
    The number of shingles is estimated from about a thousand texts.
    """
    of = max(1, sets.select("id").count() // 1000)
    total = of * sets.where(F.pmod(F.xxhash64("id"), F.lit(of)) == 0).agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    size = min(most_cells, max(CELL_BLOCK, 1 << max(0, total // 2 - 1).bit_length()))
    share = max(1, -(-total // (2 * size)))

    def count(batches):
        cells = np.zeros(size, np.uint16)
        for batch in batches:
            for own in range(0, len(batch), 10_000):  # so that no cell overflows
                np.add.at(cells, batch.column(0)[own : own + 10_000].flatten().to_numpy() & (size - 1), 1)
                np.minimum(cells, 255, out=cells)
        blocks = cells.astype(np.uint8).reshape(-1, CELL_BLOCK)
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(blocks[i], 1)], pa.binary())], names=["block", "cells"])

    def add(block):
        summed = np.minimum(np.sum([np.frombuffer(zlib.decompress(b.as_py()), np.uint8) for b in block["cells"]], axis=0, dtype=np.int64), 255)
        return pa.table({"block": block["block"][:1], "cells": pa.array([summed.astype(np.uint8).tobytes()], pa.binary())})

    drawn = sets.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0) if share > 1 else sets
    kind = "block int, cells binary"
    parts = drawn.select("hashes").coalesce(2 * sets.sparkSession.sparkContext.defaultParallelism).mapInArrow(count, kind)
    cells = np.zeros((size // CELL_BLOCK, CELL_BLOCK), np.uint8)
    for batch in parts.groupBy("block").applyInArrow(add, kind).toArrow().to_batches():
        for i, b in zip(batch["block"].to_pylist(), batch["cells"]):
            cells[i] = np.frombuffer(b.as_buffer(), np.uint8)
    return cells.reshape(-1), share == 1


def prefixes(sets: DataFrame, counts: np.ndarray, whole: bool) -> DataFrame:
    """``id``, ``n``, ``skipped``, ``buckets``: the shingles of which two texts of a similarity of 0.8 or more share at least one.

    Such texts share at least 0.8 of the shingles of either.  Of n shingles in a common order, all but the last
    ceil(0.8 n) - 1 are therefore enough: the prefix of each text, a fifth of it.  The order is that of the counts,
    then of the hashes.  If all texts were counted (``whole``), shingles of a single text, which stand first, are skipped.
    Shingles are mixed with a hash of the group; a text without one shares none.
    """
    known = sets.sparkSession.sparkContext.broadcast(counts)

    def work(batches):
        cells, groups = known.value, {}
        for batch in batches:
            n = pc.list_value_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten().to_numpy()
            rank, end = cells[flat & (len(cells) - 1)], np.cumsum(n)
            out, skipped = [], np.zeros(len(n), np.int32)
            for i, (g, size, stop) in enumerate(zip(batch.column(1).to_pylist(), n.tolist(), end.tolist())):
                if g not in groups:
                    groups[g] = np.uint64(xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass")) if g is not None else 0).astype(np.int64)
                own = rank[stop - size : stop]
                order = np.argsort(own, kind="stable")[: size - (4 * size + 4) // 5 + 1]
                skipped[i] = np.count_nonzero(own[order] == 1) if whole else 0
                out.append(flat[stop - size : stop][order[skipped[i] :]] ^ groups[g] if g is not None else flat[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(skipped), pa.array(out, pa.list_(pa.int64()))], names=["id", "n", "skipped", "buckets"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "grp", "hashes").mapInArrow(work, f"id {kind}, n int, skipped int, buckets array<bigint>")


def possible(met: DataFrame) -> DataFrame:
    """The pairs ``first``, ``id`` that can have a similarity of 0.8 or more, of rows that met in a bucket (all that they share must be there).

    ``n`` and ``at`` are the sizes of the sets and the places of the bucket in their orders.  Beyond the last common
    shingle of the prefixes no more can be shared than what is left of either set.
    """
    alike = met.where(F.least("n", "first_n") * 5 >= F.greatest("n", "first_n") * 4)
    pairs = alike.groupBy("first", "id", "first_n", "n").agg(F.count("*").alias("c"), F.max("first_at").alias("x"), F.max("at").alias("y"))
    rest = F.least(F.col("first_n") - 1 - F.col("x"), F.col("n") - 1 - F.col("y"))
    return pairs.where((F.col("c") + rest) * 9 >= (F.col("first_n") + F.col("n")) * 4).select("first", "id")


def similar(pairs: DataFrame, sets: DataFrame, hashes: Column) -> DataFrame:
    """The pairs ``first``, ``id`` (each once) of one group whose shingle sets have a Jaccard similarity of 0.8 or more, exactly."""
    pairs = cut(pairs)
    wanted = pairs.select(F.col("first").alias("id")).union(pairs.select("id")).distinct()
    chosen = sets.join(broadcast_small(wanted, MOST_IDS), "id", "left_semi").select("id", "grp", hashes.alias("hashes"))
    a = chosen.select(F.col("id").alias("first"), F.col("grp").alias("__g"), F.col("hashes").alias("__a"))
    b = chosen.select("id", F.col("grp").alias("__h"), F.col("hashes").alias("__b"))
    both = broadcast_small(pairs, MOST_IDS).join(a, "first").join(b, "id").where("__g = __h")
    # |A and B| / |A or B| >= 4 / 5
    return both.where(F.size(F.array_intersect("__a", "__b")) * 9 >= (F.size("__a") + F.size("__b")) * 4).select("first", "id")


def insertion(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """``id`` of the rows that greedy insertion drops, where ``edges`` has all similar pairs, ``first`` before ``id``.

    Up to ``most`` pairs are gone through in one task, in the order of ``id``, however long their chains are.  More are
    first made fewer by rounds: rows without an earlier neighbour are kept and their neighbours dropped.
    """
    kind, arrow = edges.schema["id"].dataType.simpleString(), to_arrow_type(edges.schema["id"].dataType)
    gone = None
    while edges.count() > most:
        kept = edges.select("first").distinct().join(edges.select(F.col("id").alias("first")), "first", "left_anti")
        step = cut(edges.join(kept, "first", "left_semi").select("id").distinct())
        gone = step if gone is None else gone.unionByName(step)
        edges = cut(edges.join(step, "id", "left_anti").join(step.withColumnRenamed("id", "first"), "first", "left_anti").select("first", "id"))

    def work(batches):
        dropped = {}
        for batch in batches:
            for first, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first not in dropped:
                    dropped[own] = None
        yield pa.RecordBatch.from_arrays([pa.array(list(dropped), arrow)], names=["id"])

    last = edges.select("first", "id").coalesce(1).sortWithinPartitions("id").mapInArrow(work, f"id {kind}")
    return last if gone is None else gone.unionByName(last)


def near_copies(rows: DataFrame, among: DataFrame | None = None, hashes: Column | None = None, each: int = PAIRS_EACH, most_cells: int = MOST_CELLS) -> tuple[DataFrame, DataFrame]:
    """Greedy insertion in the order of ``id``, exactly: a text is dropped iff it is similar (0.8 or more) to an earlier kept one of its group.

    ``rows`` has ``id`` (unique), ``grp`` and what ``hashes`` (a column of that name by default) makes into the hashes of ``shingles``, in their order.
    They are made twice, and once more for the few ids that are compared; from texts this takes less than writing them, as they are
    larger than the texts.  Null ones share nothing.  With ``among`` (a column ``id``) only these of its rows count.  The results are
    ``id``, ``kept`` of every row and the similar pairs ``first``, ``id`` of a kept row and a later, dropped one.

    Candidates share a shingle of their prefixes.  With the rarest of all shingles in front these buckets are small: all their
    pairs are formed, at most ``each`` for each row of a bucket, those that can be similar are compared by the whole sets, and insertion
    goes over the similar ones.  Where buckets are larger (many copies of one text), rounds come before: the first open row
    of every bucket is found by a minimum, combined map-side.  Rows first in all their buckets are kept; the others of these
    buckets are compared with them and dropped or left open.  The rounds go on while each halves the pairs at least.
    """
    ship(rows.sparkSession)
    hashes = F.col("hashes") if hashes is None else hashes
    sets, ids = rows.select("id", "grp", hashes.alias("hashes")), (rows if among is None else among).select("id")
    short = prefixes(sets, *shingle_counts(sets, most_cells))
    short = cut(short.where(F.size("buckets") > 0) if among is None else short.where(F.size("buckets") > 0).join(broadcast_small(ids, MOST_IDS), "id", "left_semi"))
    flat = short.select("id", "n", "skipped", F.posexplode("buckets").alias("at", "bucket")).select("id", "n", (F.col("at") + F.col("skipped")).alias("at"), "bucket")
    open_rows, shared, decided, before = flat, None, None, None
    number = F.sum(F.expr("m * (m - 1) div 2"))
    while True:
        sizes = open_rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
        entries, pairs = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(number, F.lit(0))).first()
        if pairs <= each * entries or before is not None and pairs * 2 > before:
            break
        before = pairs
        if shared is None:
            shared = open_rows = cut(flat.join(sizes.select("bucket"), "bucket", "left_semi"))
        first = open_rows.groupBy("bucket").agg(F.min(F.struct("id", "n", "at")).alias("f")).select("bucket", F.col("f.id").alias("first"), F.col("f.n").alias("first_n"), F.col("f.at").alias("first_at"))
        seen = open_rows.join(first, "bucket").groupBy("id").agg(F.min("first").alias("earliest"))
        kept = cut(seen.where("earliest = id").select("id"))
        lead = first.join(kept.withColumnRenamed("id", "first"), "first", "left_semi")
        dropped = similar(possible(open_rows.join(lead, "bucket").where("first < id")), rows, hashes).select("id").distinct()
        step = cut(kept.select("id", F.lit(True).alias("kept")).unionByName(dropped.select("id", F.lit(False).alias("kept"))))
        decided = step if decided is None else decided.unionByName(step)
        open_rows = cut(open_rows.join(step.select("id"), "id", "left_anti"))
    # columns in the same order as those of the other side, so that one exchange serves both
    other = open_rows.select(F.col("id").alias("first"), F.col("n").alias("first_n"), F.col("at").alias("first_at"), "bucket")
    edges = cut(similar(possible(open_rows.join(other, "bucket").where("first < id")), rows, hashes))
    gone = insertion(edges).select("id", F.lit(False).alias("kept"))
    gone = cut(gone if decided is None else gone.unionByName(decided.where("not kept")))
    marked = ids.join(gone, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))
    lost = gone.select("id")
    if decided is None:
        return marked, edges.join(lost.withColumnRenamed("id", "first"), "first", "left_anti").select("first", "id")
    # rows dropped in rounds have met some of the kept ones only
    leads = shared.join(lost, "id", "left_anti").select("bucket", F.col("id").alias("first"), F.col("n").alias("first_n"), F.col("at").alias("first_at"))
    return marked, similar(possible(shared.join(lost, "id", "left_semi").join(leads, "bucket").where("first < id")), rows, hashes)
