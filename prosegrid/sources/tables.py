"""Tables in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below a folder of any file system that Spark reads."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """``scan``, dealt out evenly if it has fewer splits than there are cores.

    A file with one row group is read by one task whatever its size; tables of many splits stay as they are.
    Only for plain scans, whose plan can be asked for its splits without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan
