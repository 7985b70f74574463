"""Robust statistics: exact percentiles, MAD, sigma clipping, calibration by equal-count bins, grid-search likelihood."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAD = 1.4826


def array_median(a: Column) -> Column:
    """Median of an array without nulls; null of an empty one."""
    return F.aggregate(F.array(F.array_sort(a)), F.lit(None).cast("double"), lambda _, s: F.when(
        F.size(s) > 0, (F.element_at(s, F.floor((F.size(s) + 1) / 2).cast("int")) + F.element_at(s, F.floor((F.size(s) + 2) / 2).cast("int"))) / 2
    ))


def array_scatter(a: Column, med: Column) -> Column:
    return MAD * array_median(F.transform(a, lambda v: F.abs(v - med)))


def clipped_stats(df: DataFrame, keys: list[str], value: str, sigma: float = 3.0, rounds: int = 5) -> DataFrame:
    """keys, med, std, n: median and MAD scatter after up to ``rounds`` of clipping at ``sigma``; nulls and NaN don't count.

    Groups (boxes of an image) are bounded, so each is one array, and the rounds are array expressions.
    """
    ok = F.when(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value).cast("double"))
    out = df.groupBy(*keys).agg(F.collect_list(ok).alias("_v"))
    for _ in range(rounds):
        out = out.withColumn("_m", array_median(F.col("_v")))
        out = out.withColumn("_s", array_scatter(F.col("_v"), F.col("_m")))
        out = out.withColumn("_v", F.when(F.col("_s") > 0, F.filter("_v", lambda v: F.abs(v - F.col("_m")) <= sigma * F.col("_s"))).otherwise(F.col("_v")))
    out = out.withColumn("med", array_median(F.col("_v")))
    return out.select(*keys, "med", array_scatter(F.col("_v"), F.col("med")).alias("std"), F.size("_v").cast("long").alias("n"))


#: Cut points by which the rows of a group are dealt to tasks before they are ranked.
PARTS = 64


def _dealt(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Adds ``_part``: how many of the group's approximate quantiles of ``by`` a row's value reaches. Parts are in order."""
    cut = F.percentile_approx(by, F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), F.lit(20 * PARTS)).alias("_cuts")
    cuts = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(cut)
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(cuts[f"_k_{k}"])
    met = df.join(cuts, cond) if keys else df.join(F.broadcast(cuts))  # one row
    return met.withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col(by)))).drop("_cuts", *[f"_k_{k}" for k in keys])


def _behind(dealt: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Adds ``_n`` and ``_before``: the weight of the group, and that of its lower parts."""
    per = dealt.groupBy(*keys, "_part").agg(F.sum(weight).alias("_s"))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # a row a part
    before = F.sum("_s").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    per = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.sum("_s").over(group).alias("_n"), F.coalesce(before, F.lit(0)).alias("_before"))
    cond = dealt["_part"] == per["_p"]
    for k in keys:
        cond = cond & dealt[k].eqNullSafe(per[f"_k_{k}"])
    return dealt.join(per, cond).drop("_p", *[f"_k_{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0) by ``order`` and the group's size ``n``. No task sorts a whole group: it is dealt in ordered parts."""
    whole = _behind(_dealt(df, keys, order[0]), keys, F.lit(1))
    line = W.partitionBy(*keys, "_part").orderBy(*order)
    return whole.withColumn("rank", F.col("_before") + F.row_number().over(line) - 1).withColumnRenamed("_n", "n").drop("_part", "_before")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """keys and one exact, interpolated quantile of ``value`` for each name in ``probs``; nulls don't count.

    Equal values are counted before the shuffle and the distinct ones ranked in parts, so that no task holds a group.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    whole = _behind(_dealt(hist, keys, "_v"), keys, F.col("_c"))
    line = W.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    whole = whole.withColumn("_hi", F.col("_before") + F.sum("_c").over(line)).withColumn("_lo", F.col("_hi") - F.col("_c"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= place) & (place < F.col("_hi")), F.col("_v")))

    ends = []
    for name, p in probs.items():
        place = F.lit(p) * (F.col("_n") - 1)
        ends += [at(F.floor(place)).alias(f"_a_{name}"), at(F.ceil(place)).alias(f"_b_{name}"), F.max(place - F.floor(place)).alias(f"_f_{name}")]
    out = whole.groupBy(*keys).agg(*ends)
    return out.select(*keys, *[(F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs])


def calibration(df: DataFrame, order: list[str], inv: str, offsets: list[str], keep, least: int = 30) -> DataFrame:
    """One row (sigma_sys, k): scatter of matched pairs against inverse signal squared, by equal-count bins and a line.

    bins = n div 150 between 3 and 12; a bin's y is the mean of its squared MAD scatters per axis, its x the median of ``inv``.
    Fewer than ``least`` pairs give the defaults (0.1, 1.0). ``keep(df, name)`` writes and rereads a table that is used again.
    """
    df = keep(df.select(*order, inv, *offsets), "pairs")
    binned = ranked(df, [], [inv, *order])
    bins = F.greatest(F.lit(3), F.least(F.lit(12), F.floor(F.col("n") / 150))).cast("int")
    # equal counts, the first n mod k bins one larger
    binned = binned.withColumn("_k", bins).withColumns({"_size": F.floor(F.col("n") / F.col("_k")), "_extra": F.col("n") % F.col("_k")})
    edge = F.col("_extra") * (F.col("_size") + 1)
    bin_ = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (F.col("_size") + 1))).otherwise(F.col("_extra") + F.floor((F.col("rank") - edge) / F.greatest(F.lit(1), F.col("_size"))))
    binned = keep(binned.select(bin_.alias("_bin"), inv, *offsets), "binned")
    spread = quantiles(binned, ["_bin"], inv, {"_x": 0.5})
    for o in offsets:
        middle = quantiles(binned, ["_bin"], o, {"_m": 0.5})
        off = binned.join(F.broadcast(middle), "_bin").select("_bin", F.abs(F.col(o) - F.col("_m")).alias("_d"))  # a row for each of 12 bins at most
        spread = spread.join(quantiles(off, ["_bin"], "_d", {f"_s_{o}": 0.5}), "_bin")
    y = sum((F.pow(MAD * F.col(f"_s_{o}"), 2) for o in offsets), F.lit(0.0)) / len(offsets)
    fit = spread.select("_x", y.alias("_y")).agg(F.regr_intercept("_y", "_x").alias("a"), F.regr_slope("_y", "_x").alias("b"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    few = F.col("n") < least
    return total.join(F.broadcast(fit)).select(
        F.when(few, 0.1).otherwise(F.sqrt(F.greatest("a", F.lit(0.0025)))).alias("sigma_sys"),
        F.when(few, 1.0).otherwise(F.sqrt(F.greatest("b", F.lit(0.0)))).alias("k"),
        "n",
    )


def rayleigh_likelihood(df: DataFrame, sep: str, radius: float, sigmas: list[float], shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys and the (sigma, share) of a parameter grid with the highest likelihood of a Rayleigh core on a uniform background, and loglike.

    Each task goes over its rows once and keeps one sum for each parameter and group (groups are few); only these sums are shuffled. Ties:
    the first parameter in grid order.
    """
    keys = keys or []
    s, f = np.array(sigmas), np.array(shares)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            every = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.float64)
            for g in np.unique(group).tolist():
                r = every[group == g]
                held = total.setdefault(g, np.zeros((len(s), len(f))))
                for k in range(0, len(r), 64):
                    part = r[k : k + 64, None]
                    core = part / (s * s) * np.exp(-part * part / (2 * s * s))
                    flat = (1 - f) * 2 * part / (radius * radius)
                    held += np.log(core[:, :, None] * f + flat[:, None, :] + 1e-300).sum(axis=0)
        for g, held in total.items():
            n = held.size
            at = [np.full(n, g, np.int64), np.arange(n, dtype=np.int32), np.repeat(s, len(f)), np.tile(f, len(s)), held.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in at], names=["g", "k", "sigma", "share", "part"])

    # a group goes by the hash of its keys, whose values come back by a join
    named = df.where(F.col(sep).isNotNull()).withColumn("g", F.xxhash64(*keys) if keys else F.lit(0).cast("long"))
    parts = named.select("g", F.col(sep).cast("double")).mapInArrow(sums, "g bigint, k int, sigma double, share double, part double")
    each = parts.groupBy("g", "k", "sigma", "share").agg(F.sum("part").alias("loglike"))
    best = each.groupBy("g").agg(F.max_by(F.struct("sigma", "share", "loglike"), F.struct("loglike", -F.col("k"))).alias("b"))
    names = named.groupBy("g", *keys).agg(F.count(F.lit(1)).alias("n"))
    return best.join(names, "g").select(*keys, "b.sigma", "b.share", "b.loglike", "n")


def clipped_lines(df: DataFrame, keys: list[str], x: str, y: str, keep: Callable[[DataFrame, str], DataFrame], rounds: int = 3, sigma: float = 3.0) -> DataFrame:
    """keys, a, b, n, scatter of y = a * x + b for each group, after rounds of keeping residuals below ``sigma`` MAD scatters.

    A round is joins of the rows with their groups' fits and medians; nothing passes through the driver, and medians are taken in parts.
    ``keep(df, name)`` writes and rereads the rows between the steps of a round.
    """
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")

    def fitted(cur: DataFrame) -> DataFrame:
        fit = cur.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("a"), F.regr_intercept("_y", "_x").alias("b"), F.count(F.lit(1)).alias("n"))
        return fit

    def scatter(cur: DataFrame, name: str) -> DataFrame:
        off = cur.join(quantiles(cur, keys, "_r", {"_m": 0.5}), keys).select(*keys, F.abs(F.col("_r") - F.col("_m")).alias("_d"))
        return keep(quantiles(keep(off, f"off{name}"), keys, "_d", {"_s": 0.5}).select(*keys, (MAD * F.col("_s")).alias("scatter")), f"scatter{name}")

    residual = (F.col("_y") - (F.col("a") * F.col("_x") + F.col("b"))).alias("_r")
    for k in range(rounds + 1):
        fit = fitted(rows)
        left = keep(rows.join(fit, keys).select(*keys, "_x", "_y", residual), f"left{k}")
        spread = scatter(left, str(k))
        if k == rounds:
            return fit.join(spread, keys).select(*keys, "a", "b", "n", "scatter")
        rows = left.join(spread, keys).where(F.abs("_r") < sigma * F.col("scatter")).select(*keys, "_x", "_y")


def clipped_line(df: DataFrame, x: str, y: str, rounds: int = 3, sigma: float = 3.0) -> DataFrame:
    """One row (a, b, n, scatter) of y = a * x + b after rounds of clipping at ``sigma`` MAD scatters of the residuals.

    Each round brings four numbers to the driver; the data are only filtered by what they imply.
    """
    cur = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    for _ in range(rounds):
        a, b = cur.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x")).first()
        if a is None:
            break
        r = F.col("y") - a * F.col("x") - b
        m = quantiles(cur.select(r.alias("r")), [], "r", {"m": 0.5}).first()[0]
        s = MAD * quantiles(cur.select(F.abs(r - m).alias("r")), [], "r", {"m": 0.5}).first()[0]
        cur = cur.where(F.abs(r - m) <= sigma * s)
    a, b, n = cur.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x"), F.count(F.lit(1))).first()
    fit = lambda v: F.lit(v).cast("double")
    left = quantiles(cur.select(F.abs(F.col("y") - fit(a) * F.col("x") - fit(b)).alias("r")), [], "r", {"m": 0.5})
    return left.select(fit(a).alias("a"), fit(b).alias("b"), F.lit(n).alias("n"), (MAD * F.col("m")).alias("scatter"))
