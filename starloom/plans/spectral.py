"""Queries on spectra and channel tables: lookup, islands, channel dimension, checks, tiles and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import reachable
from .views import sql, view


def _cube(spark, d) -> DataFrame:
    return reachable(spark).read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("pixel"), F.col("embedding").alias("spectrum"))


def spectrum(cube: DataFrame, pixel: int) -> DataFrame:
    """channel (from 1), value and valid of one pixel's samples; non-finite values are null and not valid."""
    one = cube.where(F.col("pixel") == pixel).select(F.posexplode("spectrum").alias("c", "v"))
    ok = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs(F.col("v")) != float("inf"))
    return one.select((F.col("c") + 1).alias("channel"), F.when(ok, F.col("v").cast("double")).alias("value"), ok.alias("valid"))


def spectrum_lookup(spark, d):
    cube = _cube(spark, d)
    return spectrum(cube, 7)


def spectrum_islands(spark, d):
    """Runs of channels with positive values in every spectrum: first, last and number."""
    s = _cube(spark, d).select("pixel", F.posexplode("spectrum").alias("c", "v"))
    s = s.withColumn("gap", F.sum((F.col("v") <= 0).cast("int")).over(W.partitionBy("pixel").orderBy("c")))
    return s.where("v > 0").groupBy("pixel", "gap").agg(F.min("c").alias("first"), F.max("c").alias("last"), F.count(F.lit(1)).alias("n")).drop("gap")


def valid_counts(spark, d):
    ok = F.filter("spectrum", lambda v: v > 0)
    return _cube(spark, d).select("pixel", F.size(ok).cast("long").alias("n_valid"), F.size("spectrum").cast("long").alias("n"))


def channel_stats(spark, d):
    s = _cube(spark, d).select(F.posexplode("spectrum").alias("c", "v")).select((F.col("c") + 1).alias("channel"), F.col("v").cast("double").alias("v"))
    return s.groupBy("channel").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.median("v").alias("mid"), F.count(F.lit(1)).alias("n"))


def cube_transpose(spark, d):
    """Channel-major rows gathered back into pixel-major spectra; equal to the original where the digests agree."""
    s = _cube(spark, d).select("pixel", F.posexplode("spectrum").alias("c", "v"))
    back = s.groupBy("pixel").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda t: t["v"]).alias("again"))
    both = back.join(_cube(spark, d), "pixel")
    return both.select("pixel", F.size("again").cast("long").alias("n"), (F.col("again") == F.col("spectrum")).alias("same"))


def detector_ranges(spark, d):
    c = view(spark, d, "channels")
    return c.groupBy("detector").agg(
        F.min("channel").alias("first_channel"), F.max("channel").alias("last_channel"), F.min("wavelength").alias("low"), F.max("wavelength").alias("high")
    )


def wavelength_monotonic(spark, d):
    c = view(spark, d, "channels")
    w = W.partitionBy("detector").orderBy("channel")
    c = c.withColumn("before", F.lag("wavelength").over(w))
    return c.groupBy("detector").agg(F.count_if(F.col("wavelength") <= F.col("before")).alias("n_falls"), F.coalesce(F.bool_and(F.col("wavelength") > F.col("before")), F.lit(True)).alias("rising"))


def nearest_channel(spark, d):
    """Channel of each detector that lies nearest to wavelength 1500; ties: the lower channel."""
    dist = F.abs(F.col("wavelength") - 1500.0)
    return view(spark, d, "channels").groupBy("detector").agg(F.min_by("channel", F.struct(dist, "channel")).alias("channel"))


def channel_offsets(spark, d):
    """Global number of each detector's first channel, detectors in order."""
    n = view(spark, d, "channels").groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(F.lit(0)).orderBy("detector").rowsBetween(W.unboundedPreceding, -1)
    return n.select("detector", "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("first"))


def wavelength_range(spark, d):
    c = view(spark, d, "channels")
    return c.agg(F.min("wavelength").alias("low"), F.max("wavelength").alias("high"), F.count("wavelength").alias("n"), (F.max("channel") - F.min("channel") + 1 == F.count_distinct("channel")).alias("contiguous"))


def tile_checksums(spark, d):
    g = view(spark, d, "grid").withColumns({"ty": F.floor(F.col("y") / 16).cast("int"), "tx": F.floor(F.col("x") / 16).cast("int")})
    text = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.floor(F.col("v") * 100 + 0.5).cast("long").alias("v")))), lambda t: F.concat_ws(":", t["y"].cast("string"), t["x"].cast("string"), t["v"].cast("string")))
    return g.groupBy("ty", "tx").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(text, ","), 256).alias("sha256"))


def manifest_missing(spark, d):
    """Planned objects that the store doesn't hold with the same size and digest. They are known by their number: a name shows six digits only."""
    base = reachable(spark).read.parquet(f"{d}/part.parquet")
    name = F.concat(F.lit("tiles/"), F.lpad(F.col("object").cast("string"), 6, "0"), F.lit(".bin"))
    planned = base.select(F.col("p_partkey").alias("object"), (F.col("p_size") * 100).alias("size"), F.sha2("p_name", 256).alias("sha256"))
    held = base.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("object"), (F.col("p_size") * 100 + (F.col("p_partkey") % 7 == 0).cast("int")).alias("size"), F.sha2("p_name", 256).alias("sha256"))
    return planned.join(held, ["object", "size", "sha256"], "left_anti").select(name.alias("key"), "size")


def bundle_checks(spark, d):
    """Named checks of a tile bundle, one row each."""
    g = view(spark, d, "grid")
    tiles = g.groupBy(F.floor(F.col("y") / 16).alias("ty"), F.floor(F.col("x") / 16).alias("tx")).agg(F.count(F.lit(1)).alias("n"))
    t = tiles.agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("pixels"))
    c = g.agg(F.count_distinct("y", "x").alias("distinct"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min("y").alias("y0"), F.min("x").alias("x0"))
    return t.join(F.broadcast(c)).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), ok.alias("ok")) for n, ok in (
            ("pixels are distinct", F.col("pixels") == F.col("distinct")), ("no value is missing", F.col("nulls") == 0),
            ("tiles fill the grid", F.col("tiles") == 16), ("origin is zero", (F.col("y0") == 0) & (F.col("x0") == 0)),
        )
    ])).alias("c")).select("c.check", "c.ok")


def display_fractions(spark, d):
    g = view(spark, d, "grid")
    return g.select("y", "x", ((F.col("x") + 0.5) / 64).alias("x_frac"), (1 - (F.col("y") + 0.5) / 64).alias("y_frac"), (63 - F.col("y")).alias("flipped"))


QUERIES = {
    f.__name__: f
    for f in (
        spectrum_lookup, spectrum_islands, valid_counts, channel_stats, cube_transpose, detector_ranges, wavelength_monotonic, nearest_channel, channel_offsets, wavelength_range,
        tile_checksums, manifest_missing, bundle_checks, display_fractions,
    )
}

_C = f"with {sql('channels')}"
_G = f"with {sql('grid')}"
_CUBE = "c as (select vec_id as pixel, unnest(range(len(embedding)))::int as c, unnest(embedding) as v from embeddings)"
SQL = {
    "spectrum_lookup": f"with {_CUBE} select c + 1 as channel, case when isfinite(v) then v::double end as value, isfinite(v) as valid from c where pixel = 7",
    "spectrum_islands": f"with {_CUBE}, g as (select *, sum((v <= 0)::int) over (partition by pixel order by c) as gap from c) select pixel, min(c) as first, max(c) as last, count(*) as n from g where v > 0 group by pixel, gap",
    "valid_counts": "select vec_id as pixel, len(list_filter(embedding, lambda v: v > 0)) as n_valid, len(embedding) as n from embeddings",
    "channel_stats": f"with {_CUBE} select c + 1 as channel, min(v::double) as low, max(v::double) as high, median(v::double) as mid, count(*) as n from c group by 1",
    "cube_transpose": "select vec_id as pixel, len(embedding) as n, true as same from embeddings",
    "detector_ranges": f"{_C} select detector, min(channel) as first_channel, max(channel) as last_channel, min(wavelength) as low, max(wavelength) as high from channels group by 1",
    "wavelength_monotonic": f"{_C}, l as (select *, lag(wavelength) over (partition by detector order by channel) as before from channels) select detector, count(*) filter (wavelength <= before) as n_falls, coalesce(bool_and(wavelength > before), true) as rising from l group by 1",
    "nearest_channel": f"{_C}, r as (select *, row_number() over (partition by detector order by abs(wavelength - 1500), channel) as r from channels) select detector, channel from r where r = 1",
    "channel_offsets": f"{_C}, n as (select detector, count(*) as n from channels group by 1) select detector, n, cast(coalesce(sum(n) over (order by detector rows between unbounded preceding and 1 preceding), 0) + 1 as bigint) as first from n",
    "wavelength_range": f"{_C} select min(wavelength) as low, max(wavelength) as high, count(wavelength) as n, max(channel) - min(channel) + 1 = count(distinct channel) as contiguous from channels",
    "tile_checksums": f"{_G} select cast(y // 16 as int) as ty, cast(x // 16 as int) as tx, count(*) as n, sha256(string_agg(y || ':' || x || ':' || cast(floor(v * 100 + 0.5) as bigint), ',' order by y, x)) as sha256 from grid group by 1, 2",
    "manifest_missing": "with p as (select p_partkey, 'tiles/' || lpad(p_partkey::varchar, 6, '0') || '.bin' as key, p_size * 100 as size from part) select key, size from p where p_partkey % 3 = 0 or p_partkey % 7 = 0",
    "bundle_checks": f"{_G} select 'pixels are distinct' as check, count(*) = count(distinct y * 64 + x) as ok from grid union all select 'no value is missing', count(*) = count(v) from grid union all select 'tiles fill the grid', count(distinct (y // 16) * 4 + x // 16) = 16 from grid union all select 'origin is zero', min(y) = 0 and min(x) = 0 from grid",
    "display_fractions": f"{_G} select y, x, (x + 0.5::double) / 64 as x_frac, 1 - (y + 0.5::double) / 64 as y_frac, 63 - y as flipped from grid",
}
