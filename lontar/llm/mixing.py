"""Mixing sources to target shares: Sainte-Laguë quotas of equal blocks, then seeded selection of blocks."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.plans.runtime import broadcast_small, cut

#: Characters of a shard of the mixture; each shard holds the same whole numbers of blocks of each source.
SHARD_CHARS = 256_000_000
#: Blocks of a shard.
BLOCKS = 65_536
#: Sources that are apportioned on the driver; more are apportioned as a table.
DRIVER_SOURCES = 100_000
SEED = 17


def source_key(name: Column) -> Column:
    """A source's name without the differences of spelling: case, outer blanks, ``-`` for ``_``."""
    return F.translate(F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", "")), "-", "_")


@dataclass
class Source:
    name: str
    share: float
    repeats: int
    size: int
    quota: int = 0

    def cap(self, block: float) -> int:
        """Blocks that it can give, the last one perhaps in part."""
        return ceil(self.size * self.repeats / block - 1e-9)


def apportion(shares: list[float], caps: list[int], seats: int) -> list[int]:
    """Whole numbers of seats by highest quotients share / (2 * seats so far + 1), none above its cap.

    The quotas are those of the divisor method: with the right divisor, each share
    rounds to its seats.  The divisor is bracketed first, so the work doesn't grow with
    the seats; the last seats go one by one to the highest quotients, of equal ones to
    the first.
    """
    most = [c if s > 0 else 0 for s, c in zip(shares, caps)]
    if seats >= sum(most):
        return most
    if seats <= 0:
        return [0] * len(shares)

    def at(divisor: float) -> list[int]:
        return [min(c, int(s / divisor + 0.5)) if s > 0 else 0 for s, c in zip(shares, caps)]

    # at the low end every source with a share has more than ``seats`` or its cap
    low, high = min(s for s in shares if s > 0) / (2.0 * seats + 2), 4 * sum(shares) + 1.0
    for _ in range(200):
        middle = (low * high) ** 0.5
        if sum(at(middle)) > seats:
            low = middle
        else:
            high = middle
        if high / low < 1 + 1e-14:
            break
    quotas = at(high)
    while sum(quotas) < seats:
        best = max((s / (2 * q + 1), -i) for i, (s, q, c) in enumerate(zip(shares, quotas, caps)) if s > 0 and q < c)
        quotas[-best[1]] += 1
    return quotas


def _targets(targets: DataFrame) -> DataFrame:
    """One row per source key; of repeated ones the largest share and number of repeats."""
    known = targets.where("name is not null and target_share is not null").withColumn("key", source_key(F.col("name")))
    return known.groupBy("key").agg(F.min("name").alias("name"), F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))


def _sized(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents of the sources with their number of characters (null text is 0)."""
    sized = documents.select("doc_id", source_key(F.col("source")).alias("key"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"))
    return sized.join(broadcast_small(targets.select("key", "name")), "key")


@dataclass
class Plan:
    """Quotas of every source in blocks, over all shards, and what they were made from."""

    sources: list[Source]
    total: int
    shards: int
    block: float

    @property
    def seats(self) -> int:
        return round(self.total / self.block) if self.total else 0


def sized_sources(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``key``, ``name``, ``target_share``, ``max_repeats``, ``size``: the size of every source, aggregated before any shuffle."""
    wanted = _targets(targets)
    sizes = _sized(documents, wanted).groupBy("key").agg(F.sum("size").alias("size"))
    return wanted.join(sizes, "key", "left").select("key", "name", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"), F.coalesce("size", F.lit(0)).alias("size"))


def plan(documents: DataFrame, targets: DataFrame, shard_chars: int = SHARD_CHARS, blocks: int = BLOCKS, driver_sources: int = DRIVER_SOURCES) -> Plan:
    """Sizes of all sources and their quotas of the blocks of all shards.

    The seats are the blocks of all shards together, so that a source of little size or share gets its blocks in some
    shards, where it would round to none in each.  Of more than ``driver_sources`` sources the divisor is found over the
    table of the sources, with one aggregate a step; the list of the quotas is a row a source.
    """
    sized = sized_sources(documents, targets)
    if sized.limit(driver_sources + 1).count() > driver_sources:
        sized = cut(sized)
        total = sized.agg(F.sum("size")).first()[0] or 0
        shards = max(1, round(total / shard_chars))
        block = total / (shards * blocks) if total else 1.0
        rows = apportion_table(sized, shards * blocks if total else 0, block).orderBy("key").collect()
        return Plan([Source(r["name"], r["target_share"], r["max_repeats"], r["size"], r["quota"]) for r in rows], total, shards, block)
    rows = sorted(sized.collect(), key=lambda r: r["key"])
    sources = [Source(r["name"], r["target_share"], r["max_repeats"], r["size"]) for r in rows]
    total = sum(s.size for s in sources)
    shards = max(1, round(total / shard_chars))
    block = total / (shards * blocks) if total else 1.0
    seats = shards * blocks if total else 0
    for s, quota in zip(sources, apportion([s.share for s in sources], [s.cap(block) for s in sources], seats)):
        s.quota = quota
    return Plan(sources, total, shards, block)


def apportion_table(sized: DataFrame, seats: int, block: float) -> DataFrame:
    """Adds ``quota`` to a table of sources: the quotas of ``apportion``, with the divisor bracketed by aggregates.

    The seats that the divisor leaves, fewer than there are sources with equal quotients, go to the highest quotients.
    """
    cap = F.ceil(F.col("size") * F.col("max_repeats") / F.lit(block) - F.lit(1e-9)).cast("bigint")
    rows = sized.withColumn("cap", F.when(F.col("target_share") > 0, cap).otherwise(F.lit(0)))
    at = lambda d: F.least(F.col("cap"), F.floor(F.col("target_share") / F.lit(d) + F.lit(0.5)))
    most, least, shares = rows.agg(F.sum("cap"), F.min(F.when(F.col("target_share") > 0, F.col("target_share"))), F.sum("target_share")).first()
    if seats >= (most or 0):
        return rows.withColumn("quota", F.col("cap"))
    if seats <= 0:
        return rows.withColumn("quota", F.lit(0).cast("bigint"))
    low, high = least / (2.0 * seats + 2), 4 * shares + 1.0
    while high / low >= 1 + 1e-14:
        middle = (low * high) ** 0.5
        if middle in (low, high):
            break
        if rows.agg(F.sum(at(middle))).first()[0] > seats:
            low = middle
        else:
            high = middle
    rows = rows.withColumn("quota", at(high))
    left = seats - rows.agg(F.sum("quota")).first()[0]
    # at this divisor the quotients of the next seats are equal but for rounding
    next_seat = F.struct((F.col("target_share") / (2 * F.col("quota") + 1)).alias("quotient"), F.col("key"))
    first = rows.where("quota < cap").select("key").orderBy(F.desc(next_seat["quotient"]), "key").limit(left).withColumn("more", F.lit(1))
    return rows.join(first, "key", "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0))).drop("more")


def mixture(documents: DataFrame, targets: DataFrame, made: Plan | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``name``, ``shard``, ``size``, ``copies`` of every document that is used.

    Documents are dealt to shards by a hash.  A source's blocks are dealt evenly, so every shard gets whole
    numbers of them, the first ones one more; within a source and shard the documents are put in seeded
    order and cut into blocks.  Blocks of n times the characters that are there use every document n times, and
    the first blocks once more up to the rest, never more than ``max_repeats`` times.  Documents of unknown or
    null sources are left out, as are those without characters.  The order is within a source *and* shard, so a
    source with a third of all rows is still many small groups.
    """
    made = made or plan(documents, targets)
    spark = documents.sparkSession
    rows = [(s.name, s.quota, s.repeats) for s in made.sources]
    quotas = spark.createDataFrame(rows, "name string, quota bigint, repeats bigint") if rows else spark.createDataFrame([], "name string, quota bigint, repeats bigint")
    if len(rows) <= DRIVER_SOURCES:
        quotas = F.broadcast(quotas)
    dealt = _sized(documents, _targets(targets)).where("size > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(made.shards)).cast("int"))
    order = Window.partitionBy("name", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("before", before).withColumn("there", F.sum("size").over(Window.partitionBy("name", "shard"))).join(quotas, "name")
    own = F.floor(F.col("quota") / F.lit(made.shards)) + (F.col("shard") < F.col("quota") % F.lit(made.shards)).cast("bigint")
    asked = own * F.lit(made.block)
    block_begin = F.floor(F.col("before") / F.lit(made.block)) * F.lit(made.block)
    times = F.floor(asked / F.col("there"))
    copies = F.least(times + (block_begin < asked - times * F.col("there")).cast("bigint"), F.col("repeats"))
    return placed.withColumn("copies", copies).where("copies > 0").select("doc_id", "name", "shard", "size", "copies")


def below(made: Plan) -> list[bool]:
    """Of every source, whether it stays below its share even when each record is used ``max_repeats`` times.

    Each source is apportioned against all others together, which are without a cap: the candidates are
    those whose quota ends at their cap.  (In the common apportionment a cap may not be reached where the
    shares add up to more than 1.)  A quota is the share of the seats but for half a seat, so no source is lost;
    which of the candidates are below by a part of a block is decided by the exact sizes.
    """
    out = []
    for s in made.sources:
        cap = s.cap(made.block)
        quota = apportion([s.share, max(0.0, 1.0 - s.share)], [cap, made.seats], made.seats)[0]
        out.append(quota >= cap - 1 and s.size * s.repeats < s.share * made.total)
    return out


def shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """For every source its target, what it has and can give, its quota and the share really reached.

    ``below_target`` marks sources that stay below their share even when each record
    is used ``max_repeats`` times; a source with a target and documents but a quota of 0 has a share of less than half a
    block.  Without documents all sizes are 0 and nothing is below its target.
    """
    made = plan(documents, targets)
    spark = documents.sparkSession
    rows = [(s.name, s.share, s.repeats, s.size, s.size * s.repeats, s.quota, short) for s, short in zip(made.sources, below(made))]
    schema = "name string, target_share double, max_repeats bigint, size bigint, reachable bigint, quota_blocks bigint, below_target boolean"
    report = spark.createDataFrame(rows, schema)
    used = mixture(documents, targets, made).groupBy("name").agg(F.sum(F.col("size") * F.col("copies")).alias("used_chars"), F.max("copies").alias("most_copies"))
    joined = report.join(broadcast_small(used), "name", "left").na.fill(0, ["used_chars", "most_copies"])
    everything = F.sum("used_chars").over(Window.partitionBy(F.lit(0)))  # one row per source
    return joined.withColumn("mixture_chars", everything).withColumn("actual_share", F.when(F.col("mixture_chars") > 0, F.col("used_chars") / F.col("mixture_chars")).otherwise(F.lit(0.0)))


def quotas(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``name``, ``cap_blocks``, ``quota_blocks``: the blocks that each source can give and those apportioned to it."""
    made = plan(documents, targets)
    rows = [(s.name, s.cap(made.block), s.quota) for s in made.sources]
    return documents.sparkSession.createDataFrame(rows, "name string, cap_blocks bigint, quota_blocks bigint")


def below_target(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``name`` of the sources whose quota ends at their cap and that stay below their share even when each record is used ``max_repeats`` times."""
    made = plan(documents, targets)
    short = [(s.name,) for s, x in zip(made.sources, below(made)) if x]
    return documents.sparkSession.createDataFrame(short, "name string")
