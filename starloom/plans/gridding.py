"""Queries on image grids: boxes, stencils, masks, components, rectangles, differences, stretches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, grid, robust
from .scratch import rounds
from .views import sql, view

SIZE = 64
#: Bits of the flag field that spoil a pixel, as one mask.
BAD_BITS = (0, 1, 2, 4, 5, 6, 9, 10, 11, 15, 17, 19)
BAD_MASK = sum(1 << b for b in BAD_BITS)
HIGH = 90000.0
BRIGHT = 103500.0


def _grid(spark, d):
    return view(spark, d, "grid")


def _flags(spark, d):
    return _grid(spark, d).withColumn("flags", ((F.col("y") * 31 + F.col("x") * 17) % 1024).cast("long"))


def difference_grid(spark, d):
    b = view(spark, d, "grid_b").withColumnRenamed("v", "b")
    return _grid(spark, d).join(b, ["y", "x"]).select("y", "x", (F.col("b") - F.col("v")).alias("diff"))


def flag_filter(spark, d):
    return _flags(spark, d).where(F.col("flags").bitwiseAND(F.lit(BAD_MASK)) == 0).select("y", "x", "v")


def box_background(spark, d):
    g = grid.boxes(_flags(spark, d), 16)
    g = g.withColumn("ok", F.when(F.col("flags") % 5 != 0, F.col("v")))
    share = g.groupBy("j", "i").agg(F.avg(F.col("ok").isNotNull().cast("double")).alias("share")).where("share >= 0.5")
    return robust.clipped_stats(g, ["j", "i"], "ok").join(share, ["j", "i"]).select("j", "i", "med", "std", "n")


def channel_percentiles(spark, d):
    g = _grid(spark, d).select((F.col("y") % 8).cast("int").alias("band"), "v")
    out = robust.quantiles(g, ["band"], "v", {"p_low": 0.005, "p_mid": 0.5, "p_high": 0.995})
    return out.select("band", *[(F.floor(F.col(n) * 1e6 + 0.5) / 1e6).alias(n) for n in ("p_low", "p_mid", "p_high")])


def coverage(spark, d):
    g = _grid(spark, d).withColumn("v", F.when(F.col("v") < HIGH, F.col("v")))
    return grid.boxes(g, 32).groupBy("j", "i").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("covered"), F.count(F.lit(1)).alias("n"))


def coverage_once(spark, d):
    c = _grid(spark, d).groupBy("y", "x").agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("c") != 1).alias("not_once"))


def local_maxima(spark, d):
    return grid.local_maxima(_grid(spark, d), 50000.0)


def convolve(spark, d):
    g = grid.convolved(_grid(spark, d), 1.5)
    return g.select("y", "x", (F.floor(F.col("v") * 1e3 + 0.5) / 1e3).alias("v"))


def psf_match(spark, d):
    g = _flags(spark, d).withColumn("v", F.when(F.col("flags") % 7 != 0, F.col("v")))
    out = grid.psf_matched(g, 1.0, 1.8)
    return out.select("y", "x", (F.floor(F.col("v") * 1e3 + 0.5) / 1e3).alias("v"))


def dilate(spark, d):
    g = _flags(spark, d).withColumn("bad", F.col("flags") % 50 == 0)
    return grid.dilated(g, "bad", 2)


def median3(spark, d):
    return grid.median_filtered(_grid(spark, d), SIZE, SIZE)


def forced_presence(spark, d):
    g = grid.stencil(_grid(spark, d), grid.SQUARE, top=F.max("v"))
    return g.select("y", "x", F.col("top").alias("forced"), (F.col("top") >= HIGH).alias("present"))


def signed_extreme(spark, d):
    g = difference_grid(spark, d).withColumnRenamed("diff", "v")
    best = F.max_by("v", F.struct(F.abs("v"), -F.col("dy"), -F.col("dx")))
    return grid.stencil(g, grid.SQUARE, extreme=best)


def any_neighbour_flagged(spark, d):
    g = _flags(spark, d).withColumn("hit", F.col("flags") % 97 == 0)
    five = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)]
    return grid.stencil(g, five, hit=F.bool_or("hit"))


def edge_distance(spark, d):
    g = _flags(spark, d).withColumn("valid", F.col("flags") % 41 != 0)
    return grid.bounded_distance(g, "valid", 4, SIZE, SIZE).where("d is not null and d < 4")


def bilinear(spark, d):
    g = _grid(spark, d)
    coarse = grid.boxes(g, 16).groupBy("j", "i").agg(F.median("v").alias("v"))
    out = grid.bilinear(g, coarse, 16, 4, 4)
    return out.select("y", "x", (F.floor(F.col("v") * 1e3 + 0.5) / 1e3).alias("v"))


def nearest_box_fill(spark, d):
    """Boxes without a value take that of the nearest box; ties: the first row, then column."""
    coarse = grid.boxes(_grid(spark, d), 16).groupBy("j", "i").agg(F.median("v").alias("v")).withColumn("v", F.when((F.col("j") + 2 * F.col("i")) % 3 != 0, F.col("v")))
    filled = grid.nearest_filled(coarse.select(F.col("j").alias("y"), F.col("i").alias("x"), "v"), SIZE // 16, SIZE // 16)
    return filled.select(F.col("y").alias("j"), F.col("x").alias("i"), "v")


def wide_fill(spark, d):
    """Gaps of the growing image (dim pixels, and those without an order) filled from the nearest bright pixel, and how far that is."""
    g = _wide(spark, d).withColumn("bright", F.col("v") >= 200000)
    height = (g.agg(F.max("y")).first()[0] or 0) + 1
    return grid.nearest_site(g, "bright", height, WIDE).select("y", "x", F.round(F.col("d") * F.col("d")).cast("long").alias("d2"), "ny", "nx")


def exact_aperture(spark, d):
    """Light of the growing image within an exact circle around every 29th order's place, off the pixels' centres."""
    g = _wide(spark, d)
    at = g.where("(y * 256 + x) % 29 = 0").select((F.col("y") * WIDE + F.col("x")).cast("long").alias("id"), (F.col("y") + (F.col("x") % 5 - 2) * 0.2).alias("y"), (F.col("x") + (F.col("y") % 7 - 3) * 0.125).alias("x"))
    r = lambda c: (F.floor(F.col(c) * 1e3 + 0.5) / 1e3).alias(c)
    return grid.aperture(g, at, 2.4).select("id", r("area"), r("flux"))


def components(spark, d):
    g = _grid(spark, d).where(F.col("v") >= BRIGHT)
    comps = grid.components(g, grid.SQUARE, rounds(spark))
    table = geometry.component_table(comps.join(g, ["y", "x"]))
    return table.where("n_pixels between 2 and 100").select("comp", "n_pixels", "y0", "y1", "x0", "x1", "peak")


def flood_fill(spark, d):
    g = _grid(spark, d).where(F.col("v") < HIGH)
    return grid.outside(g, rounds(spark), SIZE, SIZE)


def largest_rectangle(spark, d):
    return grid.largest_rectangle(_grid(spark, d).where("v < 97000"))


def cutout(spark, d):
    g = _grid(spark, d)
    peaks = grid.local_maxima(g, 97000.0).select((F.col("y") * SIZE + F.col("x")).alias("id"), "y", "x")
    return geometry.cutouts(peaks, g, 2)


def crop(spark, d):
    return _grid(spark, d).where("y >= 8 and y < 40 and x >= 16 and x < 56").select((F.col("y") - 8).alias("y"), (F.col("x") - 16).alias("x"), "v")


def top100_changes(spark, d):
    g = difference_grid(spark, d)
    return g.orderBy(F.desc(F.abs("diff")), "y", "x").limit(100)


def stretch(spark, d):
    g = _grid(spark, d)
    lim = robust.quantiles(g, [], "v", {"lo": 0.01, "hi": 0.997})
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return g.join(F.broadcast(lim)).select("y", "x", F.floor(x * 255 + 0.5).cast("int").alias("level"))


def downsample(spark, d):
    return grid.boxes(_grid(spark, d), 4).groupBy("j", "i").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("n"))


def reprojection(spark, d):
    """Bilinear resampling onto a grid shifted by (0.25, 0.5); missing corners give no value."""
    g = _grid(spark, d)
    corners = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit((0.75 if a == 0 else 0.25) * 0.5).alias("w")) for a in (0, 1) for b in (0, 1)])
    asks = g.select("y", "x").withColumn("c", F.explode(corners))
    src = g.select(F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    got = asks.join(src, (F.col("y") + F.col("c.dy") == F.col("sy")) & (F.col("x") + F.col("c.dx") == F.col("sx")))
    out = got.groupBy("y", "x").agg(F.sum(F.col("v") * F.col("c.w")).alias("s"), F.count(F.lit(1)).alias("n"))
    return out.where("n = 4").select("y", "x", (F.floor(F.col("s") * 1e6 + 0.5) / 1e6).alias("v"))


def running_heights(spark, d):
    from pyspark.sql import Window as W

    g = _grid(spark, d).where(F.col("v") < HIGH)
    runs = g.withColumn("g", F.col("y") - F.row_number().over(W.partitionBy("x").orderBy("y")))
    return runs.select("y", "x", F.row_number().over(W.partitionBy("x", "g").orderBy("y")).alias("height"))


WIDE = 256


def _wide(spark, d):
    """An image whose height grows with the orders, 256 pixels wide."""
    from ..session import reachable

    o = reachable(spark).read.parquet(f"{d}/orders.parquet")
    return o.select(F.floor(F.col("o_orderkey") / WIDE).cast("int").alias("y"), (F.col("o_orderkey") % WIDE).cast("int").alias("x"), F.col("o_totalprice").cast("double").alias("v"))


def _change(spark, d):
    """Differences of two epochs of the growing image: a little everywhere, and all of a pixel's light at two neighbours in 997."""
    k = F.col("y").cast("long") * WIDE + F.col("x")
    planted = F.when((k % 997).isin(0, 1), F.col("v")).otherwise(0.0)
    return _wide(spark, d).select("y", "x", (F.col("v") * (k % 7 - 3) / 100 + planted).alias("diff"))


def robust_change(spark, d):
    """Significance of the difference against the scatter of its box, from six sigma on."""
    g = grid.boxes(_change(spark, d), 32)
    med = g.groupBy("j", "i").agg(F.median("diff").alias("m"))  # a box's pixels
    g = g.join(med, ["j", "i"])
    s = g.groupBy("j", "i").agg((robust.MAD * F.median(F.abs(F.col("diff") - F.col("m")))).alias("s"))
    sig = F.try_divide(F.col("diff") - F.col("m"), F.col("s"))
    return g.join(s, ["j", "i"]).select("y", "x", sig.alias("sig")).where("abs(sig) >= 6")


def change_components(spark, d):
    """Connected pixels of significant change: pixels, box and the strongest significance of each."""
    keep = rounds(spark)
    hot = keep(robust_change(spark, d), "hot")
    c = grid.components(hot.select("y", "x"), grid.SQUARE, keep).join(hot, ["y", "x"])
    peak = F.max_by("sig", F.struct(F.abs("sig"), -F.col("y"), -F.col("x")))
    return c.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), (F.floor(peak * 1e6 + 0.5) / 1e6).alias("peak"))


def wide_components(spark, d):
    """Connected bright pixels of the growing image: number of pixels, box and peak of each component of two at least."""
    g = _wide(spark, d).where("v >= 150000")
    c = grid.components(g, grid.PLUS, rounds(spark)).join(g, ["y", "x"])
    table = c.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.max("v").alias("peak"))
    return table.where("n >= 2")


def wide_convolve(spark, d):
    """The growing image smoothed by a narrow kernel."""
    g = grid.convolved(_wide(spark, d), 1.5)
    return g.select("y", "x", (F.floor(F.col("v") * 1e2 + 0.5) / 1e2).alias("v"))


def wide_local_maxima(spark, d):
    return grid.local_maxima(_wide(spark, d), 250000.0)


QUERIES = {
    f.__name__: f
    for f in (
        difference_grid, flag_filter, box_background, channel_percentiles, coverage, coverage_once, local_maxima, convolve, psf_match, dilate, median3, forced_presence, signed_extreme,
        any_neighbour_flagged, edge_distance, bilinear, nearest_box_fill, components, flood_fill, largest_rectangle, cutout, crop, top100_changes, stretch, downsample, reprojection,
        running_heights, robust_change, change_components, wide_fill, exact_aperture, wide_components, wide_convolve, wide_local_maxima,
    )
}

_G = f"with {sql('grid')}"
_GB = f"with {sql('grid', 'grid_b')}, diff as (select y, x, b.v - a.v as diff from grid a join grid_b b using (y, x))"
_F = f"{_G}, flags as (select *, cast((y * 31 + x * 17) % 1024 as bigint) as flags from grid)"


def _values(offs, w=None) -> str:
    return "(values " + ", ".join(f"({a}, {b}, {repr(float(c))}::double)" for (a, b), c in zip(offs, w or [1.0] * len(offs), strict=True)) + ") as o(dy, dx, w)"


def _near(table: str, offs, w=None, cols: str = "b.*") -> str:
    return f"select a.y as ay, a.x as ax, o.dy, o.dx, o.w, {cols} from {table} a cross join {_values(offs, w)} join {table} b on b.y = a.y + o.dy and b.x = a.x + o.dx"


_SQ = grid.SQUARE
_PLUS2 = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) + abs(dx) <= 2]
_FIVE = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)]
_REACH = [(dy, dx) for dy in range(-4, 5) for dx in range(-4, 5) if dy * dy + dx * dx <= 16]
_K15 = grid.kernel(1.5)
_K18 = grid.kernel((1.8**2 - 1.0**2) ** 0.5)
_R3 = lambda e: f"floor(({e}) * 1e3 + 0.5) / 1e3"


def _clip(n: int) -> str:
    return f""", m{n} as (select j, i, median(v) as m from c{n} group by j, i), s{n} as (select c.j, c.i, m, 1.4826::double * median(abs(v - m)) as s from c{n} c join m{n} m on c.j = m.j and c.i = m.i group by c.j, c.i, m),
    c{n + 1} as (select c.j, c.i, v from c{n} c join s{n} s on c.j = s.j and c.i = s.i where not s.s > 0 or abs(v - s.m) <= 3 * s.s)"""


_WIDE = "wide as (select cast(o_orderkey // 256 as int) as y, cast(o_orderkey % 256 as int) as x, o_totalprice::double as v from orders)"
_CHANGE = f"""{_WIDE}, diff as (select y, x, y // 32 as j, x // 32 as i, v * ((y * 256 + x) % 7 - 3) / 100 + case when (y * 256 + x) % 997 in (0, 1) then v else 0 end as diff from wide),
  md as (select j, i, median(diff) as m from diff group by j, i), sc as (select d.j, d.i, m, 1.4826::double * median(abs(diff - m)) as s from diff d join md on d.j = md.j and d.i = md.i group by d.j, d.i, m),
  hot as (select y, x, (diff - m) / s as sig from diff d join sc on d.j = sc.j and d.i = sc.i where s <> 0 and abs((diff - m) / s) >= 6)"""
#: The area of the unit circle's like of radius 2.4 left of u and below v, as SQL; half(t) is the upper half disc's left of t.
_HALF = lambda t: f"(({t}) * sqrt(greatest(0.0::double, 5.76 - ({t}) * ({t}))) + 5.76 * asin(greatest(-1.0::double, least(1.0::double, ({t}) / 2.4))) + 5.76 * pi() / 2) / 2"
_CORNER = f"case when v >= 0 then 2 * ({_HALF('least(u, -h)')} + greatest(0.0::double, {_HALF('greatest(u, h)')} - {_HALF('h')})) else 0 end + v * (greatest(-h, least(h, u)) + h) + {_HALF('greatest(-h, least(h, u))')} - {_HALF('-h')}"
SQL = {
    "wide_fill": f"""with {_WIDE}, b as (select y as ny, x as nx from wide where v >= 200000),
      k as (select w.y, w.x, b.ny, b.nx, (w.y - b.ny) * (w.y - b.ny) + (w.x - b.nx) * (w.x - b.nx) as d2 from wide w join b on b.ny between w.y - 12 and w.y + 12 and b.nx between w.x - 12 and w.x + 12),
      o as (select *, row_number() over (partition by y, x order by d2, ny, nx) as r from k) select y, x, d2::bigint as d2, ny, nx from o where r = 1""",
    "exact_aperture": f"""with {_WIDE}, pos as (select (y * 256 + x)::bigint as id, y + (x % 5 - 2) * 0.2::double as cy, x + (y % 7 - 3) * 0.125::double as cx from wide where (y * 256 + x) % 29 = 0),
      m as (select id, w.y - cy as dy, w.x - cx as dx, w.v as value from pos join wide w on w.y between floor(cy - 3) and ceil(cy + 3) and w.x between floor(cx - 3) and ceil(cx + 3)),
      c as (select id, value, dy, dx, k.a, k.b, greatest(-2.4::double, least(2.4::double, dx + k.a * 0.5)) as u, greatest(-2.4::double, least(2.4::double, dy + k.b * 0.5)) as v from m cross join (values (1, 1), (1, -1), (-1, 1), (-1, -1)) k(a, b)),
      h as (select *, sqrt(greatest(0.0::double, 5.76 - v * v)) as h from c), w as (select id, value, dy, dx, greatest(0.0::double, sum(a * b * ({_CORNER}))) as w from h group by id, value, dy, dx)
      select id, floor(sum(w) * 1e3 + 0.5) / 1e3 as area, floor(sum(w * value) * 1e3 + 0.5) / 1e3 as flux from w where w > 1e-12 group by id""",
    "wide_components": f"""with recursive {_WIDE}, p as (select y, x, v, cast(y as bigint) * 1048576 + x as code from wide where v >= 150000), e as (select a.code as a, b.code as b from p a join p b on (b.y = a.y and b.x between a.x - 1 and a.x + 1) or (b.x = a.x and b.y between a.y - 1 and a.y + 1)),
      r as (select code as n, code as c from p union select e.b, r.c from r join e on e.a = r.n), l as (select n, min(c) as comp from r group by n) select comp, count(*) as n, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1, max(v) as peak from l join p on n = code group by comp having count(*) >= 2""",
    "wide_convolve": f"with {_WIDE} select ay as y, ax as x, floor(sum(v * w) * 1e2 + 0.5) / 1e2 as v from ({_near('wide', *_K15)}) group by ay, ax",
    "wide_local_maxima": f"with {_WIDE}, t as (select ay, ax, max(v) as top from ({_near('wide', _SQ)}) group by ay, ax) select y, x, v from wide join t on ay = y and ax = x where v = top and v >= 250000",
    "difference_grid": f"{_GB} select * from diff",
    "flag_filter": f"{_F} select y, x, v from flags where flags & {BAD_MASK} = 0",
    "box_background": f"{_F}, b as (select y // 16 as j, x // 16 as i, case when flags % 5 <> 0 then v end as v from flags), c0 as (select j, i, v from b where v is not null){''.join(_clip(n) for n in range(5))}, md as (select j, i, median(v) as med, count(*) as n from c5 group by j, i), sh as (select j, i from b group by j, i having avg(case when v is not null then 1.0::double else 0 end) >= 0.5) select cast(md.j as int) as j, cast(md.i as int) as i, med, 1.4826::double * median(abs(v - med)) as std, n from c5 c join md on c.j = md.j and c.i = md.i join sh on sh.j = md.j and sh.i = md.i group by all",
    "channel_percentiles": f"{_G} select cast(y % 8 as int) as band, floor(quantile_cont(v, 0.005) * 1e6 + 0.5) / 1e6 as p_low, floor(quantile_cont(v, 0.5) * 1e6 + 0.5) / 1e6 as p_mid, floor(quantile_cont(v, 0.995) * 1e6 + 0.5) / 1e6 as p_high from grid group by 1",
    "coverage": f"{_G} select cast(y // 32 as int) as j, cast(x // 32 as int) as i, avg(case when v < {HIGH} then 1.0::double else 0 end) as covered, count(*) as n from grid group by 1, 2",
    "coverage_once": f"{_G}, c as (select y, x, count(*) as c from grid group by y, x) select count(*) as pixels, count(*) filter (c <> 1) as not_once from c",
    "local_maxima": f"{_G}, t as (select ay, ax, max(v) as top from ({_near('grid', _SQ)}) group by ay, ax) select y, x, v from grid join t on ay = y and ax = x where v = top and v >= 50000",
    "convolve": f"{_G} select ay as y, ax as x, {_R3('sum(v * w)')} as v from ({_near('grid', *_K15)}) group by ay, ax",
    "psf_match": f"{_F}, g as (select y, x, case when flags % 7 <> 0 then v end as v from flags) select ay as y, ax as x, {_R3('sum(coalesce(v, 0) * w) / sum(case when v is not null then w end)')} as v from ({_near('g', *_K18)}) where (ay, ax) in (select (y, x) from g where v is not null) group by ay, ax",
    "dilate": f"{_F}, g as (select y, x, flags % 50 = 0 as bad from flags) select ay as y, ax as x, bool_or(bad) as bad from ({_near('g', _PLUS2)}) group by ay, ax",
    "median3": f"{_G} select a.y, a.x, median(b.v) as v from grid a cross join {_values(_SQ)} join grid b on b.y = greatest(0, least(63, a.y + o.dy)) and b.x = greatest(0, least(63, a.x + o.dx)) group by a.y, a.x",
    "forced_presence": f"{_G} select ay as y, ax as x, max(v) as forced, max(v) >= {HIGH} as present from ({_near('grid', _SQ)}) group by ay, ax",
    "signed_extreme": f"{_GB} select ay as y, ax as x, (array_agg(diff order by abs(diff) desc, dy, dx))[1] as extreme from ({_near('diff', _SQ)}) group by ay, ax",
    "any_neighbour_flagged": f"{_F}, g as (select y, x, flags % 97 = 0 as hit from flags) select ay as y, ax as x, bool_or(hit) as hit from ({_near('g', _FIVE)}) group by ay, ax",
    "edge_distance": f"{_F}, g as (select y, x, flags % 41 <> 0 as valid from flags), n as (select a.y, a.x, sqrt(o.dy * o.dy + o.dx * o.dx) as d from g a cross join {_values(_REACH)} left join g b on b.y = a.y + o.dy and b.x = a.x + o.dx where not coalesce(b.valid, false)) select y, x, min(d) as d from n group by y, x having min(d) < 4",
    "bilinear": f"{_G}, c as (select y // 16 as j, x // 16 as i, median(v) as v from grid group by 1, 2), p as (select y, x, greatest(0.0::double, least(3.0::double, (y + 0.5::double) / 16 - 0.5::double)) as cy, greatest(0.0::double, least(3.0::double, (x + 0.5::double) / 16 - 0.5::double)) as cx from grid), q as (select y, x, floor(cy) as j0, floor(cx) as i0, cy - floor(cy) as fy, cx - floor(cx) as fx from p) select y, x, {_R3('sum(case when a = 1 then fy else 1 - fy end * case when b = 1 then fx else 1 - fx end * c.v)')} as v from q cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b) join c on c.j = least(3, j0 + a) and c.i = least(3, i0 + b) group by y, x",
    "nearest_box_fill": f"{_G}, c as (select cast(y // 16 as int) as j, cast(x // 16 as int) as i, median(v) as v from grid group by 1, 2), h as (select j, i, case when (j + 2 * i) % 3 <> 0 then v end as v from c) select a.j, a.i, case when a.v is not null then a.v else (select b.v from h b where b.v is not null order by (a.j - b.j) * (a.j - b.j) + (a.i - b.i) * (a.i - b.i), b.j, b.i limit 1) end as v from h a",
    "components": f"with recursive {sql('grid')}, p as (select y, x, v, cast(y as bigint) * 1048576 + x as code from grid where v >= {BRIGHT}), e as (select a.code as a, b.code as b from p a join p b on abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1), r as (select code as n, code as c from p union select e.b, r.c from r join e on e.a = r.n), l as (select n, min(c) as comp from r group by n) select comp, count(*) as n_pixels, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1, (array_agg(v order by abs(v) desc, y, x))[1] as peak from p join l on n = code group by comp having count(*) between 2 and 100",
    "flood_fill": f"with recursive {sql('grid')}, p as (select y, x from grid where v < {HIGH}), r as (select y, x from p where y = 0 or x = 0 or y = 63 or x = 63 union select p.y, p.x from r join p on abs(p.y - r.y) + abs(p.x - r.x) = 1) select y, x from r",
    "crop": f"{_G} select y - 8 as y, x - 16 as x, v from grid where y >= 8 and y < 40 and x >= 16 and x < 56",
    "cutout": f"{_G}, t as (select ay, ax, max(v) as top from ({_near('grid', _SQ)}) group by ay, ax), k as (select y * 64 + x as id, y, x from grid join t on ay = y and ax = x where v = top and v >= 97000) select id, dy::int as dy, dx::int as dx, g.v from k cross join {_values(_FIVE)} left join grid g on g.y = k.y + dy and g.x = k.x + dx",
    "top100_changes": f"{_GB} select * from diff order by abs(diff) desc, y, x limit 100",
    "stretch": f"{_G}, l as (select quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.997) as hi from grid) select y, x, cast(floor(greatest(0.0::double, least(1.0::double, (v - lo) / (hi - lo))) * 255 + 0.5) as int) as level from grid, l",
    "downsample": f"{_G} select cast(y // 4 as int) as j, cast(x // 4 as int) as i, max(v) as v, count(*) as n from grid group by 1, 2",
    "reprojection": f"{_G} select a.y, a.x, floor(sum(b.v * case when o.dy = 0 then 0.75::double else 0.25::double end * 0.5::double) * 1e6 + 0.5) / 1e6 as v from grid a cross join {_values([(0, 0), (0, 1), (1, 0), (1, 1)])} join grid b on b.y = a.y + o.dy and b.x = a.x + o.dx group by a.y, a.x having count(*) = 4",
    "running_heights": f"{_G}, p as (select y, x, y - row_number() over (partition by x order by y) as g from grid where v < {HIGH}) select y, x, row_number() over (partition by x, g order by y) as height from p",
    "robust_change": f"with {_CHANGE} select y, x, sig from hot",
    "change_components": f"""with recursive {_CHANGE}, e as (select a.y::bigint * 1048576 + a.x as a, b.y::bigint * 1048576 + b.x as b from hot a join hot b on b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1),
      r as (select a as n, a as c from e where a = b union select e.b, r.c from r join e on e.a = r.n), l as (select n, min(c) as comp from r group by n)
      select comp, count(*) as n, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1, floor((array_agg(sig order by abs(sig) desc, y, x))[1] * 1e6 + 0.5) / 1e6 as peak from l join hot on n = y::bigint * 1048576 + x group by comp""",
    "largest_rectangle": f"{_G}, p as (select y, x, y - row_number() over (partition by x order by y) as g from grid where v < 97000), h as (select y, x, row_number() over (partition by x, g order by y) as h from p), s as (select *, x - row_number() over (partition by y order by x) as seg from h), c as (select a.y, a.x as x0, b.x as x1, min(m.h) as m from s a join s b on a.y = b.y and a.seg = b.seg and b.x >= a.x join s m on m.y = a.y and m.seg = a.seg and m.x between a.x and b.x group by a.y, a.x, b.x) select cast(y - m + 1 as int) as y0, x0, y as y1, x1, cast((x1 - x0 + 1) * m as bigint) as area from c order by area desc, y0, x0, y1, x1 limit 1",
}
