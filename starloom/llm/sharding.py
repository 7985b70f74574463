"""Sharding along a Hilbert curve: metadata dimensions are quantised, rows ordered by curve index and cut into runs.

Neighbours on the curve are neighbours in every dimension, so each shard covers a small box of the metadata space and
file statistics on any of the dimensions prune whole shards.

The law is ``rows`` (shard sizes in rows at most one apart) or ``bytes`` (runs of near equal bytes). The global rank
of a row needs no global sort: it is the rows in lower curve cells, plus those in lower slices of its own cell, plus its
place in its slice. Cells are at most 2 ** (dimensions * bits); slices are bounded, whatever a cell holds.

Defined results: null texts have no bytes (size = overhead) and the crc32 of the empty string; null dimensions sort
below all values; repeated rows are rows of their own; ties fall to crc, doc_id, then size; very long texts count by their
bytes; columns beyond doc_id, text, lang and source are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, each_copy, sized_broadcast, table

BITS = 4
SLICE_ROWS = 500
OVERHEAD = 16


def hilbert_index(axes: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit coordinates.

    From the highest bit down, each axis either reflects or swaps the lower bits of the first axis; the result is
    Gray-coded across axes and its bits are interleaved.
    """
    x = [np.asarray(a).astype(np.int64).copy() for a in axes]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            on = (x[i] >> bit & 1).astype(bool)
            mixed = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, mixed)
            if i:
                x[i] ^= mixed
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for a in x:
            index = index << 1 | ((a ^ flips) >> bit & 1)
    return index


def _curve(n: int, bits: int):
    def place(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for axes in columns:
            yield pd.Series(hilbert_index([a.to_numpy() for a in axes], bits))

    return F.pandas_udf(place, "long")


def text_code(value: Column) -> Column:
    """A string that sorts like the whole value; null below all."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def number_code(value: Column) -> Column:
    """A string that sorts like a non-negative integer kept to its 7 leading bits; null below all."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 7)
    return text_code(F.lpad((value - F.pmod(value, F.pow(F.lit(2), shift).cast("long"))).cast("long").cast("string"), 20, "0"))


def _bins(slim: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """dim, code, bin: equal-frequency bins from the exact histogram of each dimension's codes."""
    every = slim.select(F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("code")) for i, d in enumerate(dims)])).alias("v"), "copies")
    hist = every.groupBy("v.dim", "v.code").agg(F.sum("copies").alias("n"))
    below = F.sum("n").over(W.partitionBy("dim").orderBy("code").rowsBetween(W.unboundedPreceding, 0)) - F.col("n") / 2
    share = below / F.sum("n").over(W.partitionBy("dim"))
    return hist.select("dim", "code", F.least(F.lit((1 << bits) - 1), F.floor(share * (1 << bits))).cast("int").alias("bin"))


def curve_shards(rows: DataFrame, dims: list[str], shards: int, *, law: str = "rows", bits: int = BITS) -> DataFrame:
    """Adds curve, rank, shard and slot to ``rows`` (narrow: doc_id, size, text_crc32 and ``dims``, strings that sort like their values)."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    kept = rows.columns
    rows = rows.groupBy(*kept).agg(F.count(F.lit(1)).alias("copies"))  # equal rows stand side by side
    bins = scratch.keep(_bins(rows, dims, bits), "bins")
    binned = rows
    for i, d in enumerate(dims):
        one = bins.where(F.col("dim") == i).select(F.col("code").alias(f"_c{i}"), F.col("bin").alias(f"_b{i}"))
        binned = binned.join(sized_broadcast(one), binned[d] == one[f"_c{i}"]).drop(f"_c{i}")
    curved = scratch.keep(
        binned.withColumn("curve", _curve(len(dims), bits)(*[F.col(f"_b{i}") for i in range(len(dims))])).drop(*[f"_b{i}" for i in range(len(dims))]),
        "curved",
    )
    both = [F.sum("copies").alias("n_rows"), F.sum(F.col("size") * F.col("copies")).alias("n_bytes")]
    cells = curved.groupBy("curve").agg(*both)
    line = W.partitionBy(F.lit(0)).orderBy("curve").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    cells = scratch.keep(
        cells.select(
            F.col("curve").alias("_curve"),
            F.ceil(F.col("n_rows") / SLICE_ROWS).cast("long").alias("slices"),
            F.coalesce(F.sum("n_rows").over(line), F.lit(0)).alias("rows_below"),
            F.coalesce(F.sum("n_bytes").over(line), F.lit(0)).alias("bytes_below"),
            F.sum("n_rows").over(everything).alias("all_rows"),
            F.sum("n_bytes").over(everything).alias("all_bytes"),
        ),
        "cells",
    )
    sliced = curved.join(sized_broadcast(cells), F.col("curve") == F.col("_curve")).drop("_curve")
    sliced = sliced.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("slices")))
    per_slice = sliced.groupBy("curve", "slice").agg(*both)
    before = W.partitionBy("curve").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    per_slice = per_slice.select(
        F.col("curve").alias("_curve"), F.col("slice").alias("_slice"),
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("slice_rows"),
        F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("slice_bytes"),
    )
    inside = W.partitionBy("curve", "slice").orderBy("text_crc32", F.asc_nulls_first("doc_id"), "size").rowsBetween(W.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in (F.col("copies"), F.col("size") * F.col("copies"))]
    ranked = each_copy(sliced.withColumn("_place", sums[0]).withColumn("_upto", sums[1]), "copies", "_copy")
    ranked = ranked.withColumn("_place", F.col("_place") + F.col("_copy")).withColumn("_upto", F.col("_upto") + F.col("_copy") * F.col("size"))
    ranked = ranked.join(sized_broadcast(per_slice), (F.col("curve") == F.col("_curve")) & (F.col("slice") == F.col("_slice")))
    ranked = ranked.withColumn("rank", (F.col("rows_below") + F.col("slice_rows") + F.col("_place")).cast("long"))
    keep = [*kept, "curve", "rank"]
    if law == "rows":
        cut = F.expr(f"cast(rank * {shards} div all_rows as int)")
        # the first rank of a shard is the least one with rank * shards >= shard * rows
        first = F.expr(f"(shard * all_rows + {shards - 1}) div {shards}")
        return ranked.withColumn("shard", cut).select(*keep, "shard", (F.col("rank") - first).cast("long").alias("slot"))
    middle = F.col("bytes_below") + F.col("slice_bytes") + F.col("_upto") + F.col("size") / 2
    cut = F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("all_bytes"))).cast("int")
    dealt = scratch.keep(ranked.withColumn("shard", cut).select(*keep, "shard"), "dealt")
    firsts = dealt.groupBy(F.col("shard").alias("_shard")).agg(F.min("rank").alias("_first"))
    return dealt.join(F.broadcast(firsts), F.col("shard") == F.col("_shard")).select(
        *keep, "shard", (F.col("rank") - F.col("_first")).cast("long").alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = 40, *, law: str = "rows") -> DataFrame:
    """doc_id, size, text_crc32, lang/source/size codes, curve, rank, law, shard, slot for every document."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = docs.select(
        "doc_id",
        (F.length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        text_code(F.col("lang")).alias("lang_code"),
        text_code(F.col("source")).alias("source_code"),
    ).withColumn("size_code", number_code(F.col("size")))
    slim = Scratch(docs.sparkSession).keep(slim, "slim")
    out = curve_shards(slim, ["lang_code", "source_code", "size_code"], shards, law=law)
    return out.withColumn("law", F.lit(law))


def op2_shards(spark, sf_dir) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
