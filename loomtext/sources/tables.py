"""Reading the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """When the table's files were last written, and their size."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((str(f.getPath()), f.getModificationTime(), f.getLen()) for f in fs.listStatus(path)))
