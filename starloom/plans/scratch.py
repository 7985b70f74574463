"""Tables between the rounds of an iteration, in the shared folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def _root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a private one only where none is named and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="starloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jvm is None:
        return
    try:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM is gone at exit: the cluster's own cleaning takes over
        return


def folder(spark: SparkSession) -> str:
    """A new place for tables and files in the shared folder; it goes when the driver ends."""
    base = f"{_root(spark)}/starloom-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, base)
    return base


def rounds(spark: SparkSession):
    """A function (df, name) -> the table written and reread: cuts the lineage and survives lost executors. Tables go when the driver ends."""
    base = folder(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    return keep
