"""Where tables are read and where intermediate results are kept."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than there are
    cores (small files before costly columns); large scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, all if there are no more, and the same ones
    for the same data: those whose key's hash lies under their share of all rows.
    Nothing is sorted or moved, whatever the size."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(97)), F.lit(1 << 40)) < F.lit(int((1 << 40) * rows / total)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``; a folder of our own is
    set only where that is unset and all executors are on this machine (tests);
    on a cluster without a folder this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or Path(tempfile.mkdtemp(prefix="legajo-checkpoint-")).as_uri())
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back from it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
