"""Session level helpers: parallelism of small inputs and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes up to which an input is repartitioned to use all cores, and up to which a side of a join is broadcast.
SPREAD_BYTES, BROADCAST_BYTES = 1 << 30, 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of the rows, from the files below; known without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a small input has fewer splits than there are cores.

    A single small Parquet file is one split and would run on one core.  Inputs above ``SPREAD_BYTES``, by
    estimate, are returned as they are, however many cores there are, so a large table is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or estimated_bytes(df) > SPREAD_BYTES:
        return df
    return df.repartition(cores)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only where none is configured (local tests)."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(shared)
    return shared


def broadcast_small(df: DataFrame, most_rows: int = 50_000, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint where rows and bytes, both measured first, are within the bounds; otherwise the join may shuffle.

    At most one row more than the bound is looked at; the bytes are those of the rows as JSON.
    """
    row = F.octet_length(F.to_json(F.struct(*df.columns))) if df.columns else F.lit(0)
    rows, size = df.select(row.alias("b")).limit(most_rows + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if rows <= most_rows and size <= most_bytes else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they could not find it by themselves."""
    import os
    import shutil
    from pathlib import Path

    import lontar

    context = spark.sparkContext
    root = Path(lontar.__file__).resolve().parents[1]
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in paths or Path.cwd().resolve() == root or getattr(context, "_lontar_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="package-"), "lontar"), "zip", root, "lontar")
    context.addPyFile(archive)
    context._lontar_shipped = True
