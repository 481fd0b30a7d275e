"""Streaming forms: first-seen texts across batches, cycles that resume."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.plans.runtime import checkpoint_dir


def first_seen(stream: DataFrame, path: str, key: str = "key", keys_first: str = "doc_id") -> None:
    """Write each key's first row to ``path``/rows, once over all batches; ends when the input that is there is read.

    Each batch is reduced to its first rows per key, then anti-joined with the keys
    written so far; both tables are Parquet in the shared folder, under a folder per
    batch, so a batch that is repeated after a failure overwrites its own part.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(keys_first)).alias("r")).select("r.*")
        earlier = [f"{path}/keys/batch={n}" for n in _batches(spark, f"{path}/keys") if n < number]
        if earlier:
            first = first.join(spark.read.parquet(*earlier), key, "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        spark.read.parquet(f"{path}/rows/batch={number}").select(key).write.mode("overwrite").parquet(f"{path}/keys/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches under a folder of any file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return []
    names = [s.getPath().getName() for s in system.listStatus(hadoop)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    import uuid

    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def run_cycles(spark: SparkSession, path: str, names: DataFrame, work, per_cycle: int, most_cycles: int) -> DataFrame:
    """Work through the ``name`` values in order, ``per_cycle`` in each cycle, up to ``most_cycles`` more; returns ``name``, ``cycle``, ``rows`` of all that is processed.

    ``work(names, cycle)`` gives a table with a ``name`` column.  Its rows are written first, then the cycle's names as processed, each to a
    folder of the cycle, so a cycle that broke off is done again and overwrites its own part.  A later call goes on
    where the last one ended, and does nothing where no name is left.
    """
    for _ in range(most_cycles):
        done = _batches(spark, f"{path}/processed")
        cycle = done[-1] + 1 if done else 1
        left = names.select("name").where("name is not null").distinct()
        if done:
            left = left.join(spark.read.parquet(*(f"{path}/processed/batch={n}" for n in done)).select("name"), "name", "left_anti")
        batch = left.orderBy("name").limit(per_cycle)
        made = work(batch, cycle)
        made.write.mode("overwrite").parquet(f"{path}/rows/batch={cycle}")
        counted = batch.join(spark.read.parquet(f"{path}/rows/batch={cycle}").groupBy("name").agg(F.count("*").alias("rows")), "name", "left")
        counted.select("name", F.lit(cycle).alias("cycle"), F.coalesce("rows", F.lit(0)).alias("rows")).write.mode("overwrite").parquet(f"{path}/processed/batch={cycle}")
        if spark.read.parquet(f"{path}/processed/batch={cycle}").isEmpty():
            break
    return spark.read.parquet(*(f"{path}/processed/batch={n}" for n in _batches(spark, f"{path}/processed")))
