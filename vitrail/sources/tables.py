"""Reading the named tables of a directory, and cutting lineage on storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; a table may be one file or a folder of files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_spread(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table, dealt out over all cores if its files make fewer partitions than that.

    For operators that spend far more on a row than moving it costs. Tables of many files are not shuffled.
    """
    df = read_table(spark, directory, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only where that setting is absent, as in local
    tests, a folder of this machine is used.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="vitrail-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder, so that lost executors cost no recomputation chain."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
