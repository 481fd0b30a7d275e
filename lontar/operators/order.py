"""Order-sensitive operators that don't put all rows of a hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.plans.runtime import cut


def ranged(df: DataFrame, keys: list[str], name: str = "__part") -> DataFrame:
    """The rows dealt to partitions by ranges of the keys, written to the checkpoint folder, with the number of the partition in ``name``.

    The ranges are those of a sample of the rows, so they hold about as many rows each whatever the values are - dense
    numbers, hashes, a group with a third of all rows.  Rows with equal keys are spread by a hash of their values.  Numbers
    grow with the keys, nulls first.
    """
    tie = F.xxhash64(*df.columns)
    return cut(df.repartitionByRange(*keys, tie)).withColumn(name, F.spark_partition_id())


def running_total(df: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before each row, by group, in the order of a column (of any sortable type).

    Rows are dealt to partitions by ranges of group and order (``ranged``); the sums of the partitions' groups are
    aggregated, summed up over the partitions (few rows: one for each group and one more for each partition), and
    joined to sums within the partitions, so a group with a third of all rows is spread over a third of the tasks.  All
    columns go through the partitioning and the checkpoint folder: join long texts and arrays afterwards.  Null values
    count 0; rows without an order value come first; equal order values follow each other by a hash of the row.
    """
    part, here, tie = "__part", "__value", "__tie"
    rows = ranged(df.withColumn(here, F.coalesce(value, F.lit(0))), [*by, order], part)
    sums = rows.groupBy(*by, part).agg(F.sum(here).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col(part).alias("__p"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*by, part).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(tie, F.xxhash64(*df.columns)).withColumn("__inside", F.coalesce(F.sum(here).over(inside), F.lit(0)))
    same = F.col(part) == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    joined = summed.join(starts, same)
    return joined.withColumn(name, F.col("__start") + F.col("__inside")).drop("__p", "__start", "__inside", here, part, tie, *(f"__k{i}" for i in range(len(by))))


def within_budget(df: DataFrame, by: list[str], order: str, value: Column, budget: Column) -> DataFrame:
    """Rows up to and including the one that reaches the group's budget (checked before each row)."""
    return running_total(df, by, order, value, "__before").where(F.col("__before") < budget).drop("__before")


def first_rows(df: DataFrame, by: list[str], order: str, count: Column | int, skip: int = 0) -> DataFrame:
    """Rows number skip + 1 to skip + count of each group."""
    numbered = running_total(df, by, order, F.lit(1), "__n")
    most = F.lit(count) if isinstance(count, int) else count
    return numbered.where((F.col("__n") >= skip) & (F.col("__n") < most + F.lit(skip))).drop("__n")


def moving_average(df: DataFrame, by: list[str], order: str, value: str, keep: float, name: str) -> DataFrame:
    """``by`` and ``name``: the exponential mean of each group's values in order, begun with the first: a = keep * a + (1 - keep) * value.

    By its closed form, a sum of the values weighted by ``keep`` to the number of later values, so a group is no
    array and its parts add up map-side.  Rows with a null value or order are left out.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(order).isNotNull()).select(*by, F.col(value).alias("__v"), (-F.col(order)).alias("__back"))
    numbered = running_total(rows, by, "__back", F.lit(1), "__later")
    weight = F.pow(F.lit(keep), F.col("__later").cast("double"))
    first = F.max_by(F.col("__v") * weight, F.col("__later"))
    return numbered.groupBy(*by).agg((F.sum(F.col("__v") * weight) * F.lit(1 - keep) + first * F.lit(keep)).alias(name))


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, with the columns ``key`` and ``order``: the first in that order.

    A minimum per key, combined map-side, so that a key shared by a third of all rows is
    no bottleneck; null keys are one key.
    """
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("__first"), F.count("*").alias("copies"))
    return first.select(*key, *(F.col(f"__first.{c}").alias(c) for c in order), "copies")
