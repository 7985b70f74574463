"""Two-epoch change detection: images of two epochs to ranked candidates and counts of what was rejected why.

Images of a field become detections in one table function per field (arrays); everything after is relational over
all fields at once: matching, the measured error model, vetoes, pairing, kinds. The field is a key of every spatial join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents, imaging, robust, spatial
from ..session import reachable
from .cubes import WCS
from .scratch import rounds

DETECT, FORCED, MIN_SHIFT = 5.0, 3.0, 10.0
EDGE, HALO, HALO_SNR, CROWD = 4.0, 8.0, 200.0, 2.0
MAX_CENTROID, NEGATIVE, SUPPORT = 0.5, -10.0, 5.0
PAIR, RATIO = 300.0, 2.0

_DETECTIONS = (
    "field string, epoch string, id bigint, x double, y double, snr double, peak double, flux double, sharpness double, roundness double, clipped boolean, all_finite boolean, "
    "edge double, corrupted boolean, flagged boolean, other_snr double, diff_snr double, fwhm double"
)


def detections(pixels: DataFrame, height: int, width: int, *, fwhm: float | None = None) -> DataFrame:
    """Sources of both epochs of each field, with all that vetoes need from pixels.

    ``pixels``: field, y, x, a, b (null: invalid) and bad_a, bad_b (flagged).
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        def plane(name: str, fill) -> np.ndarray:
            out = np.full((height, width), fill)
            out[frame.y.to_numpy(), frame.x.to_numpy()] = frame[name].fillna(fill).to_numpy()
            return out

        both = [plane(n, np.nan) for n in ("a", "b")]
        bad = [plane(n, False).astype(bool) for n in ("bad_a", "bad_b")]
        valid = np.isfinite(both[0]) & np.isfinite(both[1])
        subs = [np.where(valid, e, np.nan) for e in both]
        subs = [s - imaging.background(s)[0] for s in subs]
        widths = [fwhm or imaging.measured_fwhm(s) for s in subs]
        common = max(widths)
        subs = [s if w == common else imaging.matched_to(s, w, common) for s, w in zip(subs, widths, strict=True)]
        subs = [s - imaging.background(s)[0] for s in subs]
        noise = [imaging.background(s)[1] for s in subs]
        snr = [imaging.significance(s, common) for s in subs]
        diff = np.where(valid, subs[1] - subs[0], np.nan)
        change = imaging.significance(diff - imaging.background(diff)[0], common)
        edge = imaging.edge_distance(valid)
        frames = []
        for k, epoch in enumerate("AB"):
            d = imaging.sources(subs[k], snr[k], DETECT)
            y, x, n = d["y"], d["x"], len(d["y"])
            lowest = [imaging.extreme(imaging.around(s / q, y, x, 2), np.fmin) for s, q in zip(subs, noise, strict=True)]
            frames.append(pd.DataFrame({
                "field": key[0], "epoch": epoch, "id": 2 * np.arange(n) + k, **d, "edge": imaging.around(edge, y, x, 0)[:, 0],
                "corrupted": np.fmin(*lowest) < NEGATIVE, "flagged": imaging.extreme(imaging.around(bad[k].astype(float), y, x, 1), np.fmax) > 0,
                "other_snr": imaging.extreme(imaging.around(snr[1 - k], y, x, 1), np.fmax), "diff_snr": imaging.strongest(imaging.around(change, y, x, 1)), "fwhm": common,
            }))
        return pd.concat(frames)[[c.split()[0] for c in _DETECTIONS.split(", ")]]

    return pixels.groupBy("field").applyInPandas(run, _DETECTIONS)


def find_candidates(pixels: DataFrame, height: int, width: int, *, fwhm: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejections): field, kind, significance, alternatives, id, x, y, snr, flux at either epoch; and counts per field and reason."""
    spark = pixels.sparkSession
    keep = rounds(spark)
    found = keep(detections(pixels, height, width, fwhm=fwhm), "detections")
    found = found.withColumns({"key": F.concat_ws("/", "field", "id"), **{c: F.nanvl(c, F.lit(None).cast("double")) for c in ("sharpness", "other_snr", "diff_snr")}})
    points = found.select(F.col("key").alias("id"), "x", "y", "snr", "flux", "sharpness", "field", "epoch", "fwhm")
    a, b = points.where("epoch = 'A'"), points.where("epoch = 'B'")
    reach = found.agg(F.coalesce(F.max("fwhm"), F.lit(1.0))).first()[0]  # one number: the cells' edge
    matched = spatial.mutual(spatial.pairs(a, b, reach, keys=["field"]).where("sep <= a_fwhm"))
    matched = keep(matched.withColumns({"dx": F.col("b_x") - F.col("a_x"), "dy": F.col("b_y") - F.col("a_y")}), "matched")

    bright = matched.where("a_snr >= 50 and b_snr >= 50").groupBy(F.col("a_field").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.median("dx").alias("mx"), F.median("dy").alias("my"))
    shift = bright.select("field", F.when(F.col("n") >= 10, F.col("mx")).otherwise(0.0).alias("shift_x"), F.when(F.col("n") >= 10, F.col("my")).otherwise(0.0).alias("shift_y"))
    matched = matched.withColumnRenamed("a_field", "field").join(shift, "field", "left").withColumns({"ox": F.col("dx") - F.coalesce("shift_x", F.lit(0.0)), "oy": F.col("dy") - F.coalesce("shift_y", F.lit(0.0))})
    matched = matched.withColumn("inv", 1 / (F.col("a_snr") * F.col("a_snr")) + 1 / (F.col("b_snr") * F.col("b_snr")))
    # the instrument's error model is measured from the matches of all fields together
    model = robust.calibration(matched, ["a_id"], "inv", ["ox", "oy"], rounds(spark)).select("sigma_sys", "k")
    # the 99th percentiles of shapes of all fields, if twenty matches are bright enough, else fixed ones
    lists = {"sharp_a": (F.col("a_snr"), F.col("a_sharpness"), 0.9), "sharp_b": (F.col("b_snr"), F.col("b_sharpness"), 0.9), "shape": (F.least("a_snr", "b_snr"), F.abs(F.col("a_sharpness") - F.col("b_sharpness")), 0.2)}
    shapes = matched.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.when(snr >= 10, v).alias("v")) for n, (snr, v, _) in lists.items()])).alias("t")).select("t.*").where("v is not null")
    enough = shapes.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(robust.quantiles(shapes, ["name"], "v", {"top": 0.99}), "name").where("n >= 20")
    limits = enough.agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("top"))), F.lit(d)).alias(n) for n, (_, _, d) in lists.items()])
    one = keep(model.join(F.broadcast(limits)), "model")
    partner = matched.select(F.col("a_id").alias("id"), F.col("b_id").alias("partner")).unionByName(matched.select(F.col("b_id").alias("id"), F.col("a_id").alias("partner")))

    # neighbours of either epoch that are neither the source nor its partner
    near = spatial.pairs(points, points, max(HALO, CROWD * reach), keys=["field"]).where("a_id <> b_id")
    near = near.join(partner.withColumnRenamed("id", "a_id"), "a_id", "left").where("partner is null or partner <> b_id")
    around = near.groupBy(F.col("a_id").alias("key")).agg(
        F.bool_or((F.col("b_snr") >= HALO_SNR) & (F.col("sep") <= HALO) & (F.col("sep") > 0.5)).alias("halo"), F.bool_or(F.col("sep") <= CROWD * F.col("a_fwhm")).alias("crowded")
    )
    sharp = F.when(F.col("epoch") == "A", F.col("sharp_a")).otherwise(F.col("sharp_b"))
    expected = F.when(F.col("epoch") == "A", -1).otherwise(1)
    reasons = {
        "footprint_edge": F.col("edge") < EDGE,
        "non_finite_pixels": ~F.col("all_finite"),
        "corrupted_pixel": F.col("corrupted"),
        "flagged_pixel": F.col("flagged"),
        "not_star_like": F.col("sharpness").isNull() | (F.col("sharpness") > sharp),
        "bright_star_halo": F.coalesce("halo", F.lit(False)),
        "crowded_or_blended": F.coalesce("crowded", F.lit(False)),
        "poor_centroid": (F.col("k") / F.col("snr") > MAX_CENTROID) | F.col("clipped"),
    }
    vetoed = found.join(around, "key", "left").join(F.broadcast(one)).withColumn("vetoes", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()])))
    disagrees = ~F.coalesce((F.col("diff_snr") * expected > 0) & (F.abs("diff_snr") >= SUPPORT), F.lit(False))
    vetoed = keep(vetoed.withColumn("signed", F.when(disagrees, F.array(F.lit("difference_disagrees"))).otherwise(F.array().cast("array<string>"))), "vetoed")

    # matched pairs: stationary, or shifted beyond the tolerance
    side = lambda p: vetoed.select(F.col("key").alias(f"{p}_id"), F.col("vetoes").alias(f"{p}_v"))
    sep = F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy"))
    tolerance = 5 * F.sqrt(F.col("sigma_sys") * F.col("sigma_sys") + F.col("k") * F.col("k") * F.col("inv"))
    moved = matched.join(F.broadcast(one)).join(side("a"), "a_id").join(side("b"), "b_id").withColumns({"d": sep, "tolerance": tolerance})
    all_vetoes = F.array_distinct(F.concat("a_v", "b_v", F.when(F.abs(F.col("a_sharpness") - F.col("b_sharpness")) > F.col("shape"), F.array(F.lit("shape_mismatch"))).otherwise(F.array().cast("array<string>"))))
    reason = F.when(F.col("d") <= F.col("tolerance"), "stationary").when(F.least("a_snr", "b_snr") < MIN_SHIFT, "poor_centroid").otherwise(F.try_element_at(all_vetoes, F.lit(1)))
    moved = keep(moved.select("field", "a_id", "b_id", (F.col("d") / (F.col("tolerance") / 5)).alias("significance"), reason.alias("reason")), "moved")

    # singles: absent from the other epoch and supported by the difference
    singles = vetoed.join(partner.select(F.col("id").alias("key")), "key", "left_anti")
    reason = F.when(F.coalesce(F.col("other_snr") >= FORCED, F.lit(False)), "present_in_both").otherwise(F.try_element_at(F.concat("vetoes", "signed"), F.lit(1)))
    singles = keep(singles.select("field", "epoch", "key", "x", "y", "flux", "diff_snr", reason.alias("reason")), "singles")
    good = singles.where("reason is null").select(F.col("key").alias("id"), "x", "y", "flux", "field", "epoch", "diff_snr")
    options = spatial.pairs(good.where("epoch = 'A'"), good.where("epoch = 'B'"), PAIR, keys=["field"])
    options = options.where((F.col("a_flux") > 0) & (F.col("b_flux") > 0) & F.try_divide("b_flux", "a_flux").between(1 / RATIO, RATIO))
    chosen = spatial.greedy_pairs(spatial.alternatives(options.select("a_id", "b_id", "sep", F.col("a_field").alias("field"))), keep)
    paired = chosen.select(F.explode(F.array("a_id", "b_id")).alias("id"))
    alone = good.join(paired, "id", "left_anti")
    cols = lambda df, kind, **c: df.select("field", F.lit(kind).alias("kind"), *[c.get(n, F.lit(None).cast(t)).alias(n) for n, t in (("a_id", "string"), ("b_id", "string"), ("significance", "double"), ("alternatives", "bigint"))])
    out = cols(chosen, "matched_pair", a_id=F.col("a_id"), b_id=F.col("b_id"), alternatives=F.col("alternatives"))
    out = out.unionByName(cols(moved.where("reason is null"), "shifted_match", a_id=F.col("a_id"), b_id=F.col("b_id"), significance=F.col("significance")))
    out = out.unionByName(cols(alone.where("epoch = 'A'"), "seen_only_earlier", a_id=F.col("id"), significance=F.col("diff_snr")))
    out = out.unionByName(cols(alone.where("epoch = 'B'"), "seen_only_later", b_id=F.col("id"), significance=F.col("diff_snr")))
    # what documents say of a candidate: its places, signals and light
    for e in "ab":
        out = out.join(points.select(F.col("id").alias(f"{e}_id"), *[F.col(c).alias(f"{e}_{c}") for c in ("x", "y", "snr", "flux")]), f"{e}_id", "left")
    rejected = moved.select("field", "reason").unionByName(singles.select("field", "reason")).where("reason is not null")
    return out, rejected.groupBy("field", "reason").agg(F.count(F.lit(1)).alias("n"))


SIDE, STAMP = 160, 5


def supplier_sky(spark, d) -> DataFrame:
    """Pixels of two epochs of one field per nation: its suppliers are the stars, hashes of the place the noise.

    Of the second epoch every 17th supplier is missing; every 13th has moved by 1.75 pixels.
    """
    s = reachable(spark).read.parquet(f"{d}/supplier.parquet").select(
        F.col("s_nationkey").cast("string").alias("field"), F.col("s_suppkey").alias("k"), (12 + F.col("s_suppkey") * 37 % 136).alias("cx"), (12 + F.col("s_suppkey") * 53 % 136).alias("cy"),
        (300 + F.col("s_suppkey") * 7 % 900).cast("double").alias("flux"),
    )
    around = F.sequence(F.lit(-STAMP), F.lit(STAMP))
    sigma = 2.4 / imaging.SIGMA_OF_FWHM
    light = s.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around))
    bell = lambda x: F.col("flux") / (2 * np.pi * sigma * sigma) * F.exp(-(F.pow(F.col("dx") - x, 2) + F.pow("dy", 2)) / (2 * sigma * sigma))
    move = F.when(F.col("k") % 13 == 0, 1.75).otherwise(0.0)
    light = light.select("field", (F.col("cy") + F.col("dy")).cast("int").alias("y"), (F.col("cx") + F.col("dx")).cast("int").alias("x"), bell(F.lit(0.0)).alias("a"), F.when(F.col("k") % 17 == 0, 0.0).otherwise(bell(move)).alias("b"))
    light = light.groupBy("field", "y", "x").agg(F.sum("a").alias("la"), F.sum("b").alias("lb"))
    line = F.sequence(F.lit(0), F.lit(SIDE - 1))
    px = s.select("field").distinct().withColumn("y", F.explode(line)).withColumn("x", F.explode(line))
    # the sum of twelve uniform numbers less 6 is close to a normal one
    noise = lambda e: sum((F.pmod(F.xxhash64(F.lit(e * 100 + i), "field", "y", "x"), F.lit(1_000_003)) / 1_000_003.0 for i in range(12)), F.lit(-6.0))
    px = px.join(light, ["field", "y", "x"], "left")
    value = lambda c, e: 10 + noise(e) + F.coalesce(c, F.lit(0.0))
    flag = (F.col("y") * 31 + F.col("x") * 17) % 4096
    return px.select("field", "y", "x", value("la", 1).alias("a"), value("lb", 2).alias("b"), (flag == 7).alias("bad_a"), (flag == 9).alias("bad_b"))


def two_epoch_candidates(spark, d) -> DataFrame:
    """field, outcome, n: kinds of candidates and reasons of rejections over the suppliers' sky."""
    found, rejected = find_candidates(supplier_sky(spark, d), SIDE, SIDE, fwhm=2.4)
    kinds = found.groupBy("field", F.col("kind").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(rejected.select("field", F.concat(F.lit("rejected: "), "reason").alias("outcome"), "n"))


def two_epoch_documents(spark, d) -> DataFrame:
    """Documents of the candidates that two images of each field give, numbered by field: from pixels to positions, motions and rates."""
    found, _ = find_candidates(supplier_sky(spark, d), SIDE, SIDE, fwhm=2.4)
    docs = documents.documented(found, WCS, 182.0, by=["field"])
    return docs.select("field", "candidate_id", "kind", F.col("earlier.x").alias("x"), F.col("earlier.y").alias("y"), F.col("later.x").alias("x2"), F.col("later.y").alias("y2"), "displacement", "rate", "angle")


QUERIES = {"two_epoch_candidates": two_epoch_candidates, "two_epoch_documents": two_epoch_documents}
SQL: dict[str, str] = {}
