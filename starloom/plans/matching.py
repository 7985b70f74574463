"""Queries on source lists: spatial matches, crowding, halos, calibration, observation pairs, sky matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sky
from ..operators import robust, spatial
from .scratch import rounds
from .views import sql, view

RADIUS = 1.5
BAND = (175, 190)


def mutual_match(spark, d):
    m = spatial.mutual_matches(view(spark, d, "src_a"), view(spark, d, "src_b"), RADIUS)
    return m.select("a_id", "b_id", "sep")


def _matches(spark, d):
    return spatial.mutual_matches(view(spark, d, "src_a"), view(spark, d, "src_b"), RADIUS)


_PAIRS = """p as (select a.id as a_id, b.id as b_id, a.x as ax, a.y as ay, b.x as bx, b.y as by_, a.flux as af, b.flux as bf, a.snr as asnr, b.snr as bsnr,
  sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) as sep
  from src_a a join src_b b on b.x between a.x - {r} and a.x + {r} and b.y between a.y - {r} and a.y + {r}
  where sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= {r})"""
_MUTUAL = """m as (select * from (select *, row_number() over (partition by a_id order by sep, b_id) as ra, row_number() over (partition by b_id order by sep, a_id) as rb from p) where ra = 1 and rb = 1)"""
_M = f"with {sql('src_a', 'src_b')}, {_PAIRS.format(r=RADIUS)}, {_MUTUAL}"


def radius_pairs(spark, d):
    p = spatial.pairs(view(spark, d, "src_a"), view(spark, d, "src_b"), 3.0)
    ratio = F.try_divide("b_flux", "a_flux")
    return p.where((F.col("a_flux") > 0) & (F.col("b_flux") > 0) & ratio.between(0.5, 2.0)).select("a_id", "b_id", "sep", ratio.alias("flux_ratio"))


def crowding_count(spark, d):
    a, b = view(spark, d, "src_a"), view(spark, d, "src_b")
    near = spatial.neighbour_counts(a, b, 4.0)
    return near.select("id", F.col("n").alias("n_near"))


def halo_semi(spark, d):
    a = view(spark, d, "src_a")
    return spatial.in_halo(a, a.where("snr >= 200"), 8.0).select("id")


def unmatched_anti(spark, d):
    return spatial.unmatched(view(spark, d, "src_a"), _matches(spark, d)).select("id")


def greedy_pairing(spark, d):
    p = spatial.pairs(view(spark, d, "src_a"), view(spark, d, "src_b"), 3.0)
    p = p.where("a_flux > 0 and b_flux > 0 and b_flux / a_flux between 0.5 and 2").select("a_id", "b_id", "sep")
    return spatial.greedy_pairs(spatial.alternatives(p), rounds(spark)).select("a_id", "b_id", "sep", "alternatives")


def option_degrees(spark, d):
    p = spatial.pairs(view(spark, d, "src_a"), view(spark, d, "src_b"), 3.0).select("a_id", "b_id")
    return spatial.alternatives(p)


def registration_shift(spark, d):
    m = _matches(spark, d).where("a_snr >= 50 and b_snr >= 50")
    m = rounds(spark)(m.select((F.col("b_x") - F.col("a_x")).alias("dx"), (F.col("b_y") - F.col("a_y")).alias("dy")), "offsets")
    n = m.agg(F.count(F.lit(1)).alias("n"))
    one = n.join(F.broadcast(robust.quantiles(m, [], "dx", {"mx": 0.5}))).join(F.broadcast(robust.quantiles(m, [], "dy", {"my": 0.5})))
    enough = F.col("n") >= 10
    return one.select("n", F.when(enough, F.col("mx")).otherwise(0.0).alias("dx"), F.when(enough, F.col("my")).otherwise(0.0).alias("dy"))


def tile_medians(spark, d):
    m = _matches(spark, d).select(F.floor(F.col("a_y") / 250.05).cast("int").alias("ty"), F.floor(F.col("a_x") / 250.05).cast("int").alias("tx"), (F.col("b_x") - F.col("a_x")).alias("dx"))
    return m.groupBy("ty", "tx").agg(F.count(F.lit(1)).alias("n"), F.median("dx").alias("med_dx")).where("n >= 20")


def position_calibration(spark, d):
    m = _matches(spark, d).select(
        "a_id", "b_id", (F.col("b_x") - F.col("a_x")).alias("dx"), (F.col("b_y") - F.col("a_y")).alias("dy"),
        (1 / (F.col("a_snr") * F.col("a_snr")) + 1 / (F.col("b_snr") * F.col("b_snr"))).alias("inv"),
    )
    out = robust.calibration(m, ["a_id"], "inv", ["dx", "dy"], rounds(spark))
    cut = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return out.select(cut("sigma_sys"), cut("k"), "n")


def stationary_tolerance(spark, d):
    m = _matches(spark, d).withColumn("tolerance", 5 * sky.sigma_model("a_snr", "b_snr", 0.1, 1.0))
    return m.select("a_id", "tolerance", (F.col("sep") <= F.col("tolerance")).alias("stationary"))


def sharpness_limit(spark, d):
    m = _matches(spark, d).where("a_snr >= 10").select(F.try_divide("b_flux", F.col("a_flux") + F.col("b_flux")).alias("s"))
    m = rounds(spark)(m, "shares")
    one = m.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(robust.quantiles(m, [], "s", {"q": 0.99})))
    return one.select("n", F.when(F.col("n") >= 20, F.col("q")).otherwise(0.9).alias("limit_"))


def pair_rank(spark, d):
    o = view(spark, d, "obs")
    p = spatial.banded_self_pairs(o, "mjd", *BAND, ["f"])
    gap = F.col("b_mjd") - F.col("a_mjd")
    ratio = F.abs(F.col("b_wave") - F.col("a_wave")) / ((F.col("a_bw") + F.col("b_bw")) / 2)
    out = p.select("a_id", "b_id", gap.alias("gap"), ratio.alias("ratio"))
    return out.orderBy("ratio", F.abs(F.col("gap") - 182.62), "a_id", "b_id").limit(15)


def pair_count_by_field(spark, d):
    p = spatial.banded_self_pairs(view(spark, d, "obs"), "mjd", *BAND, ["f"])
    return p.groupBy(F.col("a_f").alias("f")).agg(F.count(F.lit(1)).alias("n_pairs"))


def nearest_sky(spark, d):
    n = spatial.sky_nearest(view(spark, d, "sky_a"), view(spark, d, "sky_b"), 10.0)
    change = F.when(F.col("a_flux") != 0, 100 * (F.col("b_flux") - F.col("a_flux")) / F.col("a_flux"))
    return n.select("a_id", "b_id", (F.floor(change * 1e4 + 0.5) / 1e4).alias("change_percent"))


def motion_pairs(spark, d):
    p = spatial.sky_mutual(view(spark, d, "sky_a"), view(spark, d, "sky_b"), 120.0)
    ratio = F.try_divide("b_flux", "a_flux")
    return p.where((F.col("sep") >= 2.0) & ratio.between(0.5, 2.0)).select("a_id", "b_id", (F.floor(F.col("sep") / 31 * 1e6 + 0.5) / 1e6).alias("rate"))


def sky_band_join(spark, d):
    p = spatial.sky_pairs(view(spark, d, "sky_a"), view(spark, d, "sky_b"), 20.0, 5.0)
    return p.select("a_id", "b_id")


def best_chi2_match(spark, d):
    p = spatial.sky_pairs(view(spark, d, "sky_a"), view(spark, d, "sky_b"), 60.0)
    sigma = F.lit(1.0) + F.col("b_id") % 3
    p = p.withColumn("chi2", sky.chi_square("sep", sigma, 0.5))
    best = F.min_by("b_id", F.struct((F.floor(F.col("chi2") * 1e9 + 0.5)), "b_id"))
    return p.groupBy("a_id").agg(best.alias("b_id"), F.count_if(F.col("chi2") <= 13.816).alias("n_consistent"))


_HAV = "degrees(2 * asin(least(1.0::double, sqrt(pow(sin((radians(b.dec) - radians(a.dec)) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2))))) * 3600"


def _sky(most: float) -> str:
    return f"""p as (select * from (select a.id as a_id, b.id as b_id, a.flux as af, b.flux as bf, {_HAV} as sep from sky_a a join sky_b b
      on b.dec between a.dec - {most} / 3600.0 and a.dec + {most} / 3600.0 and b.ra between a.ra - {most} / 3600.0 * 1.6 and a.ra + {most} / 3600.0 * 1.6) where sep <= {most})"""


QUERIES = {
    f.__name__: f
    for f in (
        mutual_match, radius_pairs, crowding_count, halo_semi, unmatched_anti, greedy_pairing, option_degrees, registration_shift, tile_medians, position_calibration,
        stationary_tolerance, sharpness_limit, pair_rank, pair_count_by_field, nearest_sky, motion_pairs, sky_band_join, best_chi2_match,
    )
}

_S = f"with {sql('sky_a', 'sky_b')}, "
SQL = {
    "mutual_match": f"{_M} select a_id, b_id, sep from m",
    "radius_pairs": f"with {sql('src_a', 'src_b')}, {_PAIRS.format(r=3.0)} select a_id, b_id, sep, bf / af as flux_ratio from p where af > 0 and bf > 0 and bf / af between 0.5 and 2",
    "crowding_count": f"with {sql('src_a', 'src_b')}, {_PAIRS.format(r=4.0)}, c as (select a_id, count(*) as n from p where a_id <> b_id group by a_id) select id, coalesce(n, 0) as n_near from src_a left join c on id = a_id",
    "halo_semi": f"with {sql('src_a')} select id from src_a a where exists (select 1 from src_a b where b.snr >= 200 and b.x between a.x - 8 and a.x + 8 and b.y between a.y - 8 and a.y + 8 and sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 8 and sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) > 0.5)",
    "unmatched_anti": f"{_M} select id from src_a where id not in (select a_id from m)",
    "option_degrees": f"with {sql('src_a', 'src_b')}, {_PAIRS.format(r=3.0)} select a_id, b_id, count(*) over (partition by a_id) + count(*) over (partition by b_id) - 2 as alternatives from p",
    "registration_shift": f"{_M} select count(*) as n, case when count(*) >= 10 then median(bx - ax) else 0 end as dx, case when count(*) >= 10 then median(by_ - ay) else 0 end as dy from m where asnr >= 50 and bsnr >= 50",
    "tile_medians": f"{_M} select cast(floor(ay / 250.05::double) as int) as ty, cast(floor(ax / 250.05::double) as int) as tx, count(*) as n, median(bx - ax) as med_dx from m group by 1, 2 having count(*) >= 20",
    "position_calibration": f"""{_M}, o as (select a_id, bx - ax as dx, by_ - ay as dy, 1 / (asnr * asnr) + 1 / (bsnr * bsnr) as inv from m),
      c as (select count(*) as n, greatest(3, least(12, count(*) // 150)) as k from o),
      r as (select o.*, row_number() over (order by inv, a_id) - 1 as r, n, k from o, c),
      q as (select *, case when r < (n % k) * (n // k + 1) then r // (n // k + 1) else (n % k) + (r - (n % k) * (n // k + 1)) // (n // k) end as bin from r),
      md as (select bin, median(inv) as x, median(dx) as mx, median(dy) as my from q group by bin),
      sp as (select bin, x, 1.4826::double * median(abs(dx - mx)) as sx, 1.4826::double * median(abs(dy - my)) as sy from q join md using (bin) group by bin, x),
      f as (select regr_intercept((sx * sx + sy * sy) / 2, x) as a, regr_slope((sx * sx + sy * sy) / 2, x) as b from sp)
      select floor(case when n < 30 then 0.1 else sqrt(greatest(a, 0.0025)) end * 1e6 + 0.5) / 1e6 as sigma_sys, floor(case when n < 30 then 1.0 else sqrt(greatest(b, 0.0)) end * 1e6 + 0.5) / 1e6 as k, n from f, c""",
    "stationary_tolerance": f"{_M} select a_id, 5 * sqrt(0.1::double * 0.1::double + 1.0::double * 1.0::double * (1 / (asnr * asnr) + 1 / (bsnr * bsnr))) as tolerance, sep <= 5 * sqrt(0.1::double * 0.1::double + 1.0::double * 1.0::double * (1 / (asnr * asnr) + 1 / (bsnr * bsnr))) as stationary from m",
    "sharpness_limit": f"{_M} select count(*) as n, case when count(*) >= 20 then quantile_cont(bf / (af + bf), 0.99) else 0.9 end as limit_ from m where asnr >= 10",
    "pair_rank": f"with {sql('obs')} select a.id as a_id, b.id as b_id, b.mjd - a.mjd as gap, abs(b.wave - a.wave) / ((a.bw + b.bw) / 2) as ratio from obs a join obs b on a.f = b.f and b.mjd - a.mjd between 175 and 190 order by ratio, abs(gap - 182.62::double), a_id, b_id limit 15",
    "pair_count_by_field": f"with {sql('obs')} select a.f, count(*) as n_pairs from obs a join obs b on a.f = b.f and b.mjd - a.mjd between 175 and 190 group by a.f",
    "nearest_sky": f"{_S}{_sky(10.0)}, n as (select *, row_number() over (partition by a_id order by sep, b_id) as r from p) select a_id, b_id, floor(case when af <> 0 then 100 * (bf - af) / af end * 1e4 + 0.5) / 1e4 as change_percent from n where r = 1",
    "motion_pairs": f"{_S}{_sky(120.0)}, n as (select *, row_number() over (partition by a_id order by sep, b_id) as ra, row_number() over (partition by b_id order by sep, a_id) as rb from p) select a_id, b_id, floor(sep / 31 * 1e6 + 0.5) / 1e6 as rate from n where ra = 1 and rb = 1 and sep >= 2 and bf / af between 0.5 and 2",
    "sky_band_join": f"{_S}{_sky(20.0)} select a_id, b_id from p where sep >= 5",
    "best_chi2_match": f"{_S}{_sky(60.0)}, c as (select a_id, b_id, sep * sep / ((1.0::double + b_id % 3) * (1.0::double + b_id % 3) + 0.25::double) as chi2 from p), r as (select *, row_number() over (partition by a_id order by floor(chi2 * 1e9 + 0.5), b_id) as r from c) select a_id, max(case when r = 1 then b_id end) as b_id, count(*) filter (chi2 <= 13.816) as n_consistent from r group by a_id",
}
