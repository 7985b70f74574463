"""Candidate documents: records with sky positions and measures, markers for an image, details, summaries, pairs of observations.

Candidates are rows (kind, a_*, b_*) with the detections' columns x, y, snr, flux of either epoch, null where it has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sky
from . import robust

#: Kinds in the order of documents, with their labels.
KINDS = {"matched_pair": "Matched pair", "shifted_match": "Shifted match", "seen_only_earlier": "Seen only earlier", "seen_only_later": "Seen only later"}
IMAGES = ("earlier", "later")


class UnknownCandidate(LookupError):
    """No candidate has that id."""


class BadRequest(ValueError):
    """A request names something that isn't offered."""


def _round(c: Column, digits: int) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def documented(found: DataFrame, wcs: dict, gap_days: float, prefix: str = "SX6M", by: list[str] | None = None) -> DataFrame:
    """by, candidate_id, kind, kind_label, earlier, later, displacement (arcsec), rate (a day), angle, flux_ratio: numbered by kind, then signal.

    Measures come from unrounded values and are rounded last; those of one epoch only are null. Each group of ``by`` (a pair of images) has
    its own numbers; they come from ranks that are taken in parts, not from one sorted list.
    """
    by = by or []
    place = list(KINDS)
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(place)], F.lit(len(place)))
    sky_of = {e: sky.tan_to_sky(F.col(f"{e}_x"), F.col(f"{e}_y"), wcs) for e in "ab"}
    at = found.withColumns({f"{e}_{n}": c for e, both in sky_of.items() for n, c in zip(("ra", "dec"), both, strict=True)})
    at = at.withColumns({
        "_o": order, "_low": F.coalesce(-F.greatest("a_snr", "b_snr"), F.lit(float("inf"))), "_a0": F.col("a_id").isNull(), "_b0": F.col("b_id").isNull(),
        "displacement": sky.separation("a_ra", "a_dec", "b_ra", "b_dec"), "angle": sky.position_angle("a_ra", "a_dec", "b_ra", "b_dec"),
    })
    each = at.groupBy(*by, "_o").agg(F.count(F.lit(1)).alias("_n"))  # a row a kind
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by, F.lit(0)).orderBy("_o").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = robust.ranked(at, [*by, "_o"], ["_low", "_a0", "a_id", "_b0", "b_id"])
    at = at.join(F.broadcast(each.select(*by, "_o", before.alias("_before"))) if not by else each.select(*by, "_o", before.alias("_before")), [*by, "_o"])
    n = (F.col("_before") + F.col("rank") + 1).cast("int")

    def side(e: str) -> Column:
        digits = {"ra": 6, "dec": 6, "x": 2, "y": 2, "snr": 1, "flux": 4}
        return F.when(F.col(f"{e}_x").isNotNull(), F.struct(*[_round(F.col(f"{e}_{k}"), d).alias(k) for k, d in digits.items()]))

    label = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv]), F.col("kind")), F.col("kind"))
    return at.select(
        *by, F.format_string(f"{prefix}-%03d", n).alias("candidate_id"), "kind", label.alias("kind_label"), side("a").alias("earlier"), side("b").alias("later"),
        _round(F.col("displacement"), 2).alias("displacement"), _round(F.col("displacement") / gap_days, 4).alias("rate"), _round(F.col("angle"), 1).alias("angle"),
        F.when(F.col("a_flux") > 0, _round(F.try_divide("b_flux", "a_flux"), 3)).alias("flux_ratio"),
    )


def markers(docs: DataFrame, image: str, width: int, height: int) -> DataFrame:
    """candidate_id, x, y, own (has a detection in that image), inside, x_frac, y_frac (from above) of all candidates on an image."""
    if image not in IMAGES:
        raise BadRequest(f"image must be one of {', '.join(IMAGES)}")
    other = IMAGES[1 - IMAGES.index(image)]
    at = docs.withColumn("_p", F.coalesce(F.when(F.col(image).isNotNull(), F.struct(f"{image}.x", f"{image}.y")), F.struct(f"{other}.x", f"{other}.y")))
    x, y = F.col("_p.x"), F.col("_p.y")
    return at.select(
        "candidate_id", x.alias("x"), y.alias("y"), F.col(image).isNotNull().alias("own"), F.coalesce(sky.in_frame(x, y, width, height), F.lit(False)).alias("inside"),
        ((x + 0.5) / width).alias("x_frac"), (1 - (y + 0.5) / height).alias("y_frac"),
    )


def detail(docs: DataFrame, candidate_id: str) -> DataFrame:
    """The one candidate of that id (in any case, blanks around it don't count) and the cutouts that can be shown: position and image."""
    one = docs.where(F.upper("candidate_id") == candidate_id.strip().upper())
    if not one.limit(1).count():
        raise UnknownCandidate(candidate_id)
    show = [F.when(F.col(p).isNotNull(), F.struct(F.lit(p).alias("at"), F.lit(k).alias("image"))) for p in IMAGES for k in (*IMAGES, "difference")]
    return one.withColumn("cutouts", F.array_compact(F.array(*show)))


def summary(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row, document: JSON with the candidates in order, counts of every kind, and counts of rejections by reason, most first.

    The candidates of one pair of images are few; their list is the document.
    """
    listed = docs.agg(F.array_sort(F.collect_list(F.struct(*docs.columns))).alias("candidates"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    counts = F.struct(*[F.col(k) for k in KINDS])
    by = rejected.groupBy("reason").agg(F.sum("n").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason", "n"))), lambda r: F.struct(r["reason"].alias("reason"), r["n"].alias("n"))).alias("rejected"))
    return listed.join(F.broadcast(by)).select(F.to_json(F.struct("candidates", counts.alias("counts"), "rejected")).alias("document"))


def verified_pairs(frames: DataFrame, pairs: DataFrame, ra: float, dec: float) -> DataFrame:
    """For pairs (a_id, b_id) of frames (id, mjd, wave, bw, width, height and a world system in columns): does the target lie on both.

    Each frame's pixel of the target is taken there and back; gap, differences of wavelength and what they are of the bandwidth follow, and ok.
    """
    keys = ("crval1", "crval2", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22")
    wcs = {k: F.col(k) for k in keys}
    x, y = sky.tan_to_pixel(F.lit(float(ra)), F.lit(float(dec)), wcs)
    f = frames.withColumns({"x": x, "y": y})
    back = sky.tan_to_sky(F.col("x"), F.col("y"), wcs)
    f = f.withColumn("round_trip", sky.separation(F.lit(float(ra)), F.lit(float(dec)), *back)).withColumn("on_frame", F.coalesce(sky.in_frame("x", "y", "width", "height"), F.lit(False)))
    slim = f.select("id", "mjd", "wave", "bw", "x", "y", "round_trip", "on_frame")
    side = lambda p: slim.select(*[F.col(c).alias(f"{p}_{c}") for c in slim.columns])
    both = pairs.select("a_id", "b_id").join(side("a"), "a_id").join(side("b"), "b_id")
    gap, wave = F.col("b_mjd") - F.col("a_mjd"), F.abs(F.col("b_wave") - F.col("a_wave"))
    share = F.try_divide(wave, F.least("a_bw", "b_bw"))
    ok = F.col("a_on_frame") & F.col("b_on_frame") & (F.greatest("a_round_trip", "b_round_trip") < 1.0) & (share < 0.25)
    return both.select("a_id", "b_id", gap.alias("gap"), wave.alias("wave_delta"), share.alias("share"), F.greatest("a_round_trip", "b_round_trip").alias("round_trip"), F.coalesce(ok, F.lit(False)).alias("ok"))


def nearest_to(found: DataFrame, at: str, target: float, then: list[Column | str], most: int = 20) -> DataFrame:
    """The ``most`` rows whose ``at`` is nearest to ``target``, ties by ``then``."""
    return found.orderBy(F.abs(F.col(at) - target), *then).limit(most)
