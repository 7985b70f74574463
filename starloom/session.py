"""Session settings that the engine expects."""

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("starloom")
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers started from here on import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[1])
    own = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in own.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, own) if x)
    return spark
