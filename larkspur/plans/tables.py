"""Reading the input tables and cutting lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory; zone-less timestamps become TIMESTAMP (session zone)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    Only a local session that names no folder gets one here; on a cluster a folder of one machine would lose the data
    with that machine, so there it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "larkspur-checkpoints"))
    return df.checkpoint(eager)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Deal rows round over the cluster when the scan has fewer splits than there are cores.

    A scan of large data has many splits and is left alone: no shuffle is paid there.
    """
    cores = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
