"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Tables of this process that are still there, and its own folder in local sessions.
_TABLES: set[str] = set()
_OWN: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set, a session on one machine,
    as in tests, gets a temporary folder that goes with the process; a cluster has to
    name a folder that all its executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="loomtext-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        folder = f"file://{_OWN[app]}"
    return folder.rstrip("/")


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write df as a table in the work folder and read it back: the lineage ends
    there and a lost executor costs no recomputation. The table that `replaces`
    was cut to is deleted afterwards, so that loops keep one generation on disk;
    tables that a result still reads go when the process ends."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/cut-{uuid.uuid4().hex}"
    _TABLES.add(path)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    if replaces is not None:
        drop_cut(replaces)
    return back


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a frame made by cut(); frames made otherwise stay."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
        _TABLES.discard(path)


@atexit.register
def _clean() -> None:
    """Delete the tables that are left, with or without a session."""
    for path in _TABLES:
        try:
            fs, at = pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)
            fs.delete_dir(at)
        except Exception:  # noqa: BLE001 - a folder that can't be reached any more
            continue


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its scan has fewer partitions than there are: rows
    that cost much more to work on than to move. A large scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
