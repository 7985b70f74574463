"""Spatial joins: positions within a distance meet by tiles (``tiled``), semi joins by an equi join on cells with an exact residual.

Of a semi join one side keeps its cell, the other is offered to the neighbouring ones, so each pair meets once; it is a merge join, never
a nested loop nor a broadcast of repeated rows. Tables need an ``id`` column and coordinate columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sky
from . import tiled


def _cells(df: DataFrame, axes: list[Column], size: float, around: bool, names: list[str]) -> DataFrame:
    own = [F.floor(a / F.lit(size)).cast("long") for a in axes]
    if not around:
        return df.withColumns(dict(zip(names, own, strict=True)))
    shifts = F.array(*[F.struct(*[F.lit(s).cast("long").alias(n) for s, n in zip(v, names, strict=True)]) for v in product((-1, 0, 1), repeat=len(axes))])
    out = df.withColumns({f"_own{n}": o for n, o in zip(names, own, strict=True)}).withColumn("_shift", F.explode(shifts))
    return out.withColumns({n: F.col(f"_own{n}") + F.col(f"_shift.{n}") for n in names}).drop("_shift", *[f"_own{n}" for n in names])


def pairs(left: DataFrame, right: DataFrame, radius: float, *, how: str = "inner", keys: list[str] | None = None) -> DataFrame:
    """All pairs of plane positions (columns x, y) within ``radius`` whose ``keys`` are equal: a_*, b_* columns and ``sep``.

    ``how`` may be inner, left_semi or left_anti; the latter two return the columns a_* only.
    """
    if how == "inner":
        return _on_plane(left, right, radius, "pairs", keys)
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    names = ["_cx", "_cy"]
    a = _cells(a, [F.col("a_x"), F.col("a_y")], radius, False, names)
    b = _cells(b, [F.col("b_x"), F.col("b_y")], radius, True, names)
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    sep = F.sqrt(dx * dx + dy * dy)
    cond = (a["_cx"] == b["_cx"]) & (a["_cy"] == b["_cy"]) & (sep <= F.lit(float(radius)))
    for k in keys or []:
        cond = cond & (a[f"a_{k}"] == b[f"b_{k}"])
    return a.join(b.hint("merge"), cond, how).drop(*names)


def _on_plane(left: DataFrame, right: DataFrame, radius: float, how: str, keys: list[str] | None = None) -> DataFrame:
    found = tiled.met(left, right, ["x", "y"], lambda x, y: [F.col(x), F.col(y)], tiled.plane, float(radius), float(radius), how, keys=keys)
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    return found.withColumn("sep", F.sqrt(dx * dx + dy * dy))


def _on_sky(left: DataFrame, right: DataFrame, most: float, least: float, how: str, keys: list[str] | None = None) -> DataFrame:
    """Arrays find pairs with a little to spare; the haversine in columns decides."""
    reach = 2 * math.sin(math.radians(most / 3600) / 2) * (1 + 1e-8)
    axes = lambda ra, dec: list(sky.unit_vector(ra, dec))
    found = tiled.met(left, right, ["ra", "dec"], axes, tiled.sky, most * (1 + 1e-9), reach, how, least=least * (1 - 1e-9), keys=keys)
    return found.withColumn("sep", sky.separation("a_ra", "a_dec", "b_ra", "b_dec")).where(F.col("sep").between(float(least), float(most)))


def sky_pairs(left: DataFrame, right: DataFrame, most: float, least: float = 0.0, *, keys: list[str] | None = None) -> DataFrame:
    """All pairs of sky positions (ra, dec in degrees) with ``least`` <= sep <= ``most`` arcseconds and equal ``keys``.

    Cells are cubes around the unit vectors with the chord of ``most`` as edge: poles and the wrap of ra need no care.
    """
    return _on_sky(left, right, most, least, "pairs", keys)


def sky_nearest(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """Of each position of ``left`` the nearest of ``right`` within ``most`` arcseconds (ties: the smaller id), as a row of ``sky_pairs``."""
    return _on_sky(left, right, most, 0.0, "nearest")


def sky_mutual(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """The rows of ``sky_pairs`` that are each other's nearest."""
    return _on_sky(left, right, most, 0.0, "mutual")


def sky_counts(points: DataFrame, radius: float, group: str, keep: Callable[[DataFrame, str], DataFrame] | None = None, leaf: int | None = None) -> DataFrame:
    """group, id, other, n: how many positions of every other group lie within ``radius`` arcseconds of each; none has no row.

    No pair of positions is a row: they are counted in their tiles, by strips whose middle parts aren't tried one by one. ``keep`` writes and
    rereads the counts; ``leaf`` is of no use any more.
    """
    chord = 2 * math.sin(math.radians(radius / 3600) / 2) * (1 + 1e-8)
    p = points.select(F.col(group).alias("group"), "id", "ra", "dec")
    n = tiled.met(p, p, ["ra", "dec"], lambda ra, dec: list(sky.unit_vector(ra, dec)), tiled.sky, radius, chord, "counts")
    n = n.select(F.col("a_group").alias(group), F.col("a_id").alias("id"), F.col("b_group").alias("other"), "n")
    return keep(n, "counts") if keep else n


def nearest(found: DataFrame, key: str = "a_id", other: str = "b_id", by: str = "sep") -> DataFrame:
    """Of each key the pair with the least ``by``; ties fall to the smaller other id."""
    cols = [c for c in found.columns if c != key]
    best = F.min_by(F.struct(*cols), F.struct(F.col(by), F.col(other)))
    return found.groupBy(key).agg(best.alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in cols]).select(*found.columns)


def mutual(found: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest (ties fall to the smaller id); minima combine before the shuffle, nothing is sorted."""
    order = F.struct("sep", "b_id")
    best = found.groupBy("a_id").agg(F.min_by(F.struct(*[c for c in found.columns if c != "a_id"]), order).alias("_b"))
    back = found.groupBy("b_id").agg(F.min(F.struct("sep", "a_id")).alias("_a")).select(F.col("b_id").alias("_k"), F.col("_a.a_id").alias("_i"))
    best = best.join(back, (F.col("_b.b_id") == F.col("_k")) & (F.col("a_id") == F.col("_i")), "left_semi")
    return best.select(*[F.col(c) if c == "a_id" else F.col(f"_b.{c}").alias(c) for c in found.columns])


def mutual_matches(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Mutual nearest neighbours within ``radius``; a nearer neighbour would be within it too, so the order of tests doesn't matter."""
    return _on_plane(left, right, radius, "mutual")


def unmatched(left: DataFrame, matches: DataFrame, side: str = "a") -> DataFrame:
    return left.join(matches.select(F.col(f"{side}_id").alias("id")), "id", "left_anti")


def neighbour_counts(left: DataFrame, right: DataFrame, radius: float, *, same: bool = True) -> DataFrame:
    """id, n: sources of ``right`` within ``radius`` of each of ``left``; a source isn't its own neighbour if ``same``."""
    found = pairs(left.select("id", "x", "y"), right.select("id", "x", "y"), radius)
    if same:
        found = found.where("a_id <> b_id")
    n = found.groupBy(F.col("a_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return left.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def in_halo(left: DataFrame, bright: DataFrame, radius: float, inner: float = 0.5) -> DataFrame:
    """Sources with a bright one within ``radius`` that isn't themselves (farther than ``inner``)."""
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = bright.select(F.col("x").alias("b_x"), F.col("y").alias("b_y"))
    names = ["_cx", "_cy"]
    a = _cells(a, [F.col("a_x"), F.col("a_y")], radius, False, names)
    b = _cells(b, [F.col("b_x"), F.col("b_y")], radius, True, names)
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    sep = F.sqrt(dx * dx + dy * dy)
    cond = (a["_cx"] == b["_cx"]) & (a["_cy"] == b["_cy"]) & (sep <= F.lit(float(radius))) & (sep > F.lit(float(inner)))
    return a.join(b.hint("merge"), cond, "left_semi").select(*[F.col(f"a_{c}").alias(c) for c in left.columns])


def greedy_pairs(options: DataFrame, keep) -> DataFrame:
    """One-to-one assignment in ascending (sep, a_id, b_id), as a loop over all options would give it.

    Under this total order the options that are the best of both their ends are in the result; with their ends'
    other options gone the same holds for the rest. ``keep(df, name)`` writes and rereads a table between rounds.
    """
    order = ["sep", "a_id", "b_id"]
    rest = keep(options, "options0")
    out = None
    i = 0
    while True:  # every round but the last takes the best option of all that are left, at least
        i += 1
        best = lambda k: F.row_number().over(W.partitionBy(k).orderBy(*order))
        chosen = keep(rest.withColumn("_i", best("a_id")).withColumn("_j", best("b_id")).where("_i = 1 and _j = 1").drop("_i", "_j"), f"chosen{i}")
        if not chosen.limit(1).count():
            break
        out = chosen if out is None else out.unionByName(chosen)
        rest = keep(rest.join(chosen.select("a_id"), "a_id", "left_anti").join(chosen.select("b_id"), "b_id", "left_anti"), f"options{i}")
    return rest if out is None else out


def alternatives(options: DataFrame) -> DataFrame:
    """Adds how many other options the two ends of each option have."""
    n = F.count(F.lit(1)).over(W.partitionBy("a_id")) + F.count(F.lit(1)).over(W.partitionBy("b_id")) - 2
    return options.withColumn("alternatives", n)


def banded_self_pairs(df: DataFrame, at: str, low: float, high: float, keys: list[str]) -> DataFrame:
    """Pairs of rows with equal keys whose ``at`` differ by low..high: an equi join on keys and bands of width high - low."""
    width = float(high - low)
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns]).withColumn("_band", F.floor((F.col(f"a_{at}") + low) / width).cast("long"))
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    b = b.withColumn("_own", F.floor(F.col(f"b_{at}") / width).cast("long")).withColumn("_band", F.explode(F.array(F.col("_own"), F.col("_own") - 1))).drop("_own")
    cond = a["_band"] == b["_band"]
    for k in keys:
        cond = cond & (a[f"a_{k}"] == b[f"b_{k}"])
    return a.join(b, cond & (F.col(f"b_{at}") - F.col(f"a_{at}")).between(low, high)).drop("_band")


def cone(df: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Rows (ra, dec) within ``radius`` arcseconds of a place, with sep, nearest first; none gives an empty table of the same columns.

    A band of declination reaches the scan; the exact separation decides.
    """
    reach = radius / 3600 * (1 + 1e-9)
    band = df.where(F.col("dec").between(dec - reach, dec + reach))
    return band.withColumn("sep", sky.separation("ra", "dec", F.lit(float(ra)), F.lit(float(dec)))).where(F.col("sep") <= radius)
