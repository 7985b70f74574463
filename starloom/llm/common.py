"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table of known narrow rows is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a private temporary one only where none is named and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(scratch_root, "own", None)
        if root is None:
            root = scratch_root.own = tempfile.mkdtemp(prefix="starloom-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


class Scratch:
    """Tables written once to the shared folder, so that lost executors cost a re-read and not a recomputation.

    ``keep`` writes a table and returns it reread; ``drop`` removes tables whose consumers have finished.
    """

    def __init__(self, spark: SparkSession):
        self.spark = reachable(spark)
        self.base = f"{scratch_root(spark)}/starloom-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.base)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.base}/{name}")

    def _remove(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None or sc._jvm is None:
            return
        try:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM is gone at exit: the cluster's own cleaning takes over
            return


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else unchanged (a shuffle join, split by AQE)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def guarded(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but the ``used`` ones under names that clash with nothing, and the way back to its own columns."""
    names = {c: c if c in used else f"_own_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inner, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns of two tables."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def count_words(text: Column, pattern: str = WORD) -> Column:
    """Words in a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def each_copy(df: DataFrame, copies: str, name: str) -> DataFrame:
    """A row with ``name`` = 0, 1 ... for each of the ``copies`` of a row; no array is longer than the root of their number."""
    side = F.ceil(F.sqrt(F.col(copies).cast("double"))).cast("long")
    outer = df.withColumn("_side", side).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_side"))))
    upto = F.least(F.col("_side"), F.col(copies) - F.col("_block") * F.col("_side"))
    inner = outer.withColumn("_many", upto).where("_many > 0")
    inner = inner.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many") - 1)))
    return inner.withColumn(name, F.col("_block") * F.col("_side") + F.col("_at")).drop("_side", "_block", "_many", "_at")
