"""Component statistics and cutouts of image grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def component_table(pixels: DataFrame) -> DataFrame:
    """comp, n_pixels, bounding box, abs-weighted centroid and signed peak of labelled pixels (y, x, v, comp)."""
    w = F.abs(F.col("v"))
    return pixels.groupBy("comp").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        (F.sum(w * F.col("x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("cy"),
        F.max_by("v", F.struct(w, -F.col("y"), -F.col("x"))).alias("peak"),
    )


def cutouts(centres: DataFrame, pixels: DataFrame, half: int) -> DataFrame:
    """id, dy, dx, v: square stamps around rounded centres (id, y, x); pixels beyond the grid are null."""
    span = F.sequence(F.lit(-half), F.lit(half))
    at = centres.select("id", F.rint("y").cast("int").alias("cy"), F.rint("x").cast("int").alias("cx"))
    at = at.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    at = at.select("id", "dy", "dx", (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"))
    return at.join(pixels.select("y", "x", "v"), ["y", "x"], "left").select("id", "dy", "dx", "v")
