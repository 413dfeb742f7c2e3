"""Tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_open = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_open, "paths"):
        _open.paths = []
    return _open.paths


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are removed at its end; those stored with ``keep`` live as long as the scope around it."""
    scopes = _scopes()
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            remove(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``.

    Only a single-machine session without that setting gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if master not in _fallback:
        _fallback[master] = tempfile.mkdtemp(prefix="prosegrid-")
        atexit.register(shutil.rmtree, _fallback[master], ignore_errors=True)
    return f"file://{os.path.abspath(_fallback[master])}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/prosegrid/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path below the shared folder through the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str, *, keep: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the stages before. The table is
    removed with the ``scope`` it is stored in, if there is one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    scopes = _scopes()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
