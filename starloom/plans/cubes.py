"""Queries on a spectral cube in tiles: spectra at positions, planes, metadata, stretches, manifests, checks, upload plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cubes
from ..session import reachable
from ..sources import fits, fits_scan, store
from .scratch import folder

WIDTH, TILE, CHANNELS = 20, 10, 64
#: A world system of the cube of these queries: 6.2 arcseconds a pixel around (150, 2).
WCS = {"crval1": 150.0, "crval2": 2.0, "crpix1": 10.0, "crpix2": 12.0, "cd11": -0.0017222222222222222, "cd12": 0.0, "cd21": 0.0, "cd22": 0.0017222222222222222}


def _tiles(spark, d) -> DataFrame:
    """The embeddings as pixels of a cube, row by row."""
    e = reachable(spark).read.parquet(f"{d}/embeddings.parquet")
    y, x = F.floor(F.col("vec_id") / WIDTH).cast("int"), (F.col("vec_id") % WIDTH).cast("int")
    return e.select(y.alias("y"), x.alias("x"), F.col("embedding").cast("array<float>").alias("spectrum")).withColumns(cubes.tile_of("y", "x", TILE))


def _height(tiles: DataFrame) -> int:
    return (tiles.agg(F.max("y")).first()[0] or 0) + 1


def _channels(spark, d) -> DataFrame:
    p = reachable(spark).read.parquet(f"{d}/part.parquet").where(F.col("p_partkey").between(1, CHANNELS))
    return p.select(F.col("p_partkey").cast("int").alias("channel"), F.col("p_size").cast("int").alias("detector"), F.col("p_retailprice").cast("double").alias("wavelength"))


def spectrum_at(spark, d):
    t = _tiles(spark, d)
    return cubes.spectrum_at(t, _channels(spark, d), WCS, _height(t), WIDTH, ra=150.0051, dec=2.0017, size=TILE).select("channel", "value", "valid", "x_frac", "detector", "wavelength", "x", "y")


def spectra_at_sources(spark, d):
    """Spectra of all orders' positions on the cube: how many samples are positive, and the strongest."""
    o = reachable(spark).read.parquet(f"{d}/orders.parquet")
    at = o.select(F.col("o_orderkey").alias("id"), (150 + (F.col("o_orderkey") % 61 - 30) * 0.0015).alias("ra"), (2 + (F.col("o_orderkey") % 47 - 23) * 0.0015).alias("dec"))
    t = _tiles(spark, d)
    got = cubes.spectra_at(t, at, WCS, _height(t), WIDTH, TILE)
    return got.select("id", "x", "y", F.size(F.filter("spectrum", lambda v: v > 0)).cast("long").alias("n_positive"), F.array_max("spectrum").cast("double").alias("top"))


def channel_plane(spark, d):
    """A plane from the store's second layout."""
    path = folder(spark)
    cubes.write_store(_tiles(spark, d), path, TILE)
    return cubes.read_plane(spark, path, 17)


def fits_rows(spark, d):
    """Rows 3 to 9 of every third channel, from one FITS file of each channel that this query writes: only these rows' bytes are read."""
    t = _planes(_tiles(spark, d))
    root = folder(spark)
    files = fits.to_fits(t.withColumn("wave", F.col("channel") / 8), ["channel"], _height(t), WIDTH, WCS, ["channel", "wave"])
    store.write_objects(files.select(F.format_string("planes/c%03d.fits", "channel").alias("key"), "content"), root)
    found = fits_scan.read_images(spark, root, "planes/*.fits").where(F.col("y").between(3, 9) & F.col("key").isin([f"planes/c{c:03d}.fits" for c in range(3, CHANNELS + 1, 3)]))
    return found.select("key", "y", "x", "value")


def header_scan(spark, d):
    """Frames that show a position near the middle of their sky, by the first bytes of their files: one file for each supplier."""
    s = reachable(spark).read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("bal"))
    px = s.withColumns({"y": F.lit(0), "x": F.lit(0), "value": F.lit(1.0), "key": F.format_string("f/%08d.fits", "id")})
    shift = (F.col("id") % 41 - 20) * 0.0005
    sky = {"crval1": 150 + shift, "crval2": 2 - shift, "crpix1": F.lit(8.5), "crpix2": F.lit(12.5), "cd1_1": F.lit(-0.001), "cd1_2": F.lit(0.0), "cd2_1": F.lit(0.0), "cd2_2": F.lit(0.001), "mjd-obs": 60000 + F.col("id") * 7 % 400}
    px = px.withColumns({k: v.cast("double") for k, v in sky.items()})
    root = folder(spark)
    store.write_objects(fits.to_fits(px, ["key"], 24, 16, None, list(sky)), root)
    keys = s.select(F.format_string("f/%08d.fits", "id").alias("key"))
    scanned = fits_scan.scan_headers(keys.unionByName(keys.where("key like '%1.fits'").withColumn("key", F.concat("key", F.lit(".gone")))), root, None)
    hits = fits_scan.covering(fits_scan.frames(scanned), 150.002, 2.001, 60182.62)
    r = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    failed = scanned.where("error is not null").select("key", F.lit(None).cast("double").alias("delta_days"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    return hits.select("key", r("delta_days"), r("x"), r("y")).unionByName(failed)


def bundle_written(spark, d):
    """Spectra read back from the tiles' objects in the order that the manifest lists, with the tiles' sums compared."""
    t = _tiles(spark, d)
    root = folder(spark)
    store.write_objects(cubes.bundle_objects(t, TILE), root)
    listed = store.read_manifest(spark, root)
    back = store.read_objects(listed, root).join(listed, "key").where((F.sha2("content", 256) == F.col("sha256")) & (F.length("content") == F.col("bytes")))
    files = back.where("key like 'tiles/%'").select(F.col("key").alias("path"), "content")
    places = back.where("key like 'places/%'").select(F.regexp_replace("key", "^places/", "tiles/").alias("path"), F.col("content").alias("places"))
    place = listed.select("key", F.regexp_extract("key", r"y(\d+)_x", 1).cast("int").alias("ty"), F.regexp_extract("key", r"_x(\d+)", 1).cast("int").alias("tx"))
    got = cubes.decode_npy(files.join(places, "path", "left"), TILE, TILE, CHANNELS).join(place.withColumnRenamed("key", "path"), "path")
    return got.select((F.col("ty") * TILE + F.col("row")).alias("y"), (F.col("tx") * TILE + F.col("col")).alias("x"), F.array_max("spectrum").cast("double").alias("top"), F.get("spectrum", F.lit(16)).cast("double").alias("v17"))


def cube_metadata(spark, d):
    t = _tiles(spark, d)
    m = cubes.metadata(t, _channels(spark, d), WCS, _height(t), WIDTH)
    r = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return m.select("total_channels", "detectors", "low", "high", "contiguous", "pixels", "tiles", "shortest", "longest", "width", "height", r("centre_ra"), r("centre_dec"), r("scale"))


def display_stretches(spark, d):
    """A plane's values between its limits under three stretches."""
    p = cubes.plane(_tiles(spark, d), 3, CHANNELS)
    v, lo, hi = F.col("value"), F.col("low"), F.col("high")
    one = p.join(F.broadcast(cubes.display_limits(p, 1.0, 99.0)))
    return one.select("y", "x", *[(F.floor(cubes.stretched(v, lo, hi, how) * 1e9 + 0.5) / 1e9).alias(how) for how in ("asinh", "linear", "log")])


def wavelength_grid(spark, d):
    """Wavelengths at all orders' places on a detector, from a grid of nations (5 x 5 nodes)."""
    n = reachable(spark).read.parquet(f"{d}/nation.parquet")
    grid = n.select(F.floor(F.col("n_nationkey") / 5).cast("int").alias("j"), (F.col("n_nationkey") % 5).cast("int").alias("i"), (0.75 + F.col("n_nationkey") * F.col("n_regionkey") / 64).alias("v"))
    o = reachable(spark).read.parquet(f"{d}/orders.parquet")
    at = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7 % 2100).cast("double").alias("x"), (F.col("o_orderkey") * 11 % 2100).cast("double").alias("y"))
    nodes = [0.0, 512.0, 1024.0, 1536.0, 2040.0]
    w = cubes.wavelength_at(at, grid, nodes, nodes, 2040.0, 2040.0)
    return w.select("id", (F.floor(F.col("wavelength") * 1e9 + 0.5) / 1e9).alias("wavelength"))


def tile_manifest(spark, d):
    return cubes.manifest(_tiles(spark, d)).select("key", "y0", "y1", "x0", "x1", "pixels", "bytes")


def _planes(t: DataFrame) -> DataFrame:
    return t.select("y", "x", F.posexplode("spectrum").alias("c", "value")).select((F.col("c") + 1).alias("channel"), "y", "x", "value")


def bundle_verified(spark, d):
    """Twenty checks of the cube's bundle, one row each."""
    t, c = _tiles(spark, d), _channels(spark, d)
    return cubes.verified(t, cubes.manifest(t), _planes(t), c, c, WCS, WCS, _height(t), WIDTH, TILE)


def bundle_damaged(spark, d):
    """The same checks where one tile has gone, one value has changed and one channel is named otherwise: those that fail."""
    t, c = _tiles(spark, d), _channels(spark, d)
    bad = t.where("ty <> 1 or tx <> 1").withColumn("spectrum", F.when((F.col("y") == 0) & (F.col("x") == 0), F.transform("spectrum", lambda v: v + F.lit(1).cast("float"))).otherwise(F.col("spectrum")))
    listed = c.withColumn("wavelength", F.when(F.col("channel") == 5, -1.0).otherwise(F.col("wavelength")))
    return cubes.verified(bad, cubes.manifest(t), _planes(t), c, listed, WCS, WCS, _height(t), WIDTH, TILE).where("not ok").select("check")


def upload_planned(spark, d):
    """Tiles to send: the store holds every third one, and another digest of every fourth."""
    t, c = _tiles(spark, d), _channels(spark, d)
    planned = cubes.manifest(t)
    held = planned.withColumn("k", F.col("ty") * 2 + F.col("tx")).where("k % 3 = 0").select("key", "bytes", F.when(F.col("k") % 4 == 0, F.lit("-")).otherwise(F.col("sha256")).alias("sha256"))
    checks = cubes.verified(t, planned, _planes(t), c, c, WCS, WCS, _height(t), WIDTH, TILE)
    return cubes.upload_plan(planned, held, checks).select("key", "bytes")


QUERIES = {
    f.__name__: f
    for f in (
        spectrum_at, spectra_at_sources, channel_plane, cube_metadata, display_stretches, wavelength_grid, fits_rows, header_scan, bundle_written, tile_manifest, bundle_verified, bundle_damaged, upload_planned,
    )
}

_T = "t as (select cast(vec_id // 20 as int) as y, cast(vec_id % 20 as int) as x, embedding::float[] as s, cast(vec_id // 200 as int) as ty, cast(vec_id % 20 // 10 as int) as tx from embeddings)"
_CH = "ch as (select p_partkey::int as channel, p_size::int as detector, p_retailprice::double as wavelength from part where p_partkey between 1 and 64)"
#: The tangent-plane pixel of a position under the queries' world system.
_PIX = """select {keys}, cast(floor(-degrees(cos(d) * sin(r) / c) / 0.0017222222222222222 + 9.5) as int) as x,
  cast(floor(degrees((cos(radians(2)) * sin(d) - sin(radians(2)) * cos(d) * cos(r)) / c) / 0.0017222222222222222 + 11.5) as int) as y
  from (select *, radians(ra) - radians(150) as r, radians(dec) as d, sin(radians(2)) * sin(radians(dec)) + cos(radians(2)) * cos(radians(dec)) * cos(radians(ra) - radians(150)) as c from {src})"""
_KEY = "'tiles/y' || lpad(ty::varchar, 3, '0') || '_x' || lpad(tx::varchar, 3, '0')"
_LIM = "l as (select quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from p)"
_F = "least(1.0, greatest(0.0, (v - lo) / (hi - lo)))"
_CHECKS = ("schema", "dtype", "world system", "channel count", "channels unchanged", "channels contiguous", "wavelengths", "detectors", "dimensions", "tile count", "every pixel once", "tile sizes", "tile sums",
           "tile boxes", "tiles aligned", "pixels in their tiles", "spectrum lengths", "values", "gaps", "spot channels, corners and sky")
SQL = {
    "spectrum_at": f"with {_T}, {_CH}, q as ({_PIX.format(keys='1 as one', src='(select 150.0051::double as ra, 2.0017::double as dec)')}), e as (select t.x, t.y, unnest(range(64))::int as c, unnest(s) as v from t join q on t.x = q.x and t.y = q.y) "
    "select e.c + 1 as channel, v::double as value, true as valid, (x + 0.5::double) / 20 as x_frac, detector, wavelength, x, y from e left join ch on ch.channel = e.c + 1",
    "spectra_at_sources": f"with {_T}, o as (select o_orderkey as id, 150 + (o_orderkey % 61 - 30) * 0.0015::double as ra, 2 + (o_orderkey % 47 - 23) * 0.0015::double as dec from orders), q as ({_PIX.format(keys='id', src='o')}) "
    "select id, q.x, q.y, len(list_filter(s, lambda v: v > 0))::bigint as n_positive, list_max(s)::double as top from q join t on t.x = q.x and t.y = q.y",
    "channel_plane": f"with {_T} select y, x, s[17]::double as value from t",
    "fits_rows": f"with {_T} select 'planes/c' || lpad(c::varchar, 3, '0') || '.fits' as key, y, x, s[c]::double as value from t, (select unnest(range(3, 65, 3)) as c) where y between 3 and 9",
    "header_scan": "with f as (select s_suppkey as id, (s_suppkey % 41 - 20) * 0.0005::double as shift, 60000 + s_suppkey * 7 % 400 as mjd from supplier), "
    "a as (select *, radians(150.002) - radians(150 + shift) as r, radians(2.001) as d, radians(2 - shift) as d0 from f), b as (select *, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(r) as c from a), "
    "p as (select *, -degrees(cos(d) * sin(r) / c) / 0.001 + 7.5 as x, degrees((cos(d0) * sin(d) - sin(d0) * cos(d) * cos(r)) / c) / 0.001 + 11.5 as y from b) "
    "select 'f/' || lpad(id::varchar, 8, '0') || '.fits' as key, floor(abs(mjd - 60182.62::double) * 1e6 + 0.5) / 1e6 as delta_days, floor(x * 1e6 + 0.5) / 1e6 as x, floor(y * 1e6 + 0.5) / 1e6 as y from p "
    "where x >= -0.5 and x < 15.5 and y >= -0.5 and y < 23.5 union all select 'f/' || lpad(s_suppkey::varchar, 8, '0') || '.fits.gone', null, null, null from supplier where s_suppkey % 10 = 1",
    "bundle_written": f"with {_T} select y, x, list_max(s)::double as top, s[17]::double as v17 from t",
    "cube_metadata": f"with {_T}, {_CH}, c as (select count(*) as total_channels, count(distinct detector) as detectors, min(wavelength) as low, max(wavelength) as high, max(channel) - min(channel) + 1 = count(*) as contiguous from ch), "
    "m as (select count(*) as pixels, count(distinct ty * 10 + tx) as tiles, min(len(s))::int as shortest, max(len(s))::int as longest, 20::int as width, max(y) + 1 as height from t), "
    "k as (select *, radians(-0.0017222222222222222 * (9.5 + 1 - 10)) as xi, radians(0.0017222222222222222 * ((height - 1) / 2.0::double + 1 - 12)) as eta from m), "
    "s as (select *, cos(radians(2)) - eta * sin(radians(2)) as den from k) "
    "select total_channels, detectors, low, high, contiguous, pixels, tiles, shortest, longest, width, height, floor((150 + degrees(atan2(xi, den))) * 1e6 + 0.5) / 1e6 as centre_ra, "
    "floor(degrees(atan2(sin(radians(2)) + eta * cos(radians(2)), sqrt(xi * xi + den * den))) * 1e6 + 0.5) / 1e6 as centre_dec, floor(3600 * 0.0017222222222222222::double * 1e6 + 0.5) / 1e6 as scale from s, c",
    "display_stretches": f"with {_T}, p as (select y, x, s[3]::double as v from t), {_LIM} select y, x, floor(asinh(10 * {_F}) / asinh(10) * 1e9 + 0.5) / 1e9 as asinh, floor({_F} * 1e9 + 0.5) / 1e9 as linear, floor(ln(1 + 1000 * {_F}) / ln(1001) * 1e9 + 0.5) / 1e9 as log from p, l",
    "wavelength_grid": "with g as (select n_nationkey // 5 as j, n_nationkey % 5 as i, 0.75 + n_nationkey * n_regionkey / 64.0::double as v from nation), "
    "o as (select o_orderkey as id, (o_orderkey * 7 % 2100)::double as x, (o_orderkey * 11 % 2100)::double as y from orders), n as (select unnest(range(4)) as k, unnest([0, 512, 1024, 1536])::double as lo, unnest([512, 1024, 1536, 2040])::double as hi), "
    "c as (select *, least(2040.0, x) as cx, least(2040.0, y) as cy from o), b as (select c.*, a.k as i, (cx - a.lo) / (a.hi - a.lo) as fx, d.k as j, (cy - d.lo) / (d.hi - d.lo) as fy from c join n a on cx >= a.lo and (cx < a.hi or a.k = 3) join n d on cy >= d.lo and (cy < d.hi or d.k = 3)) "
    "select b.id, case when x <= 2040 and y <= 2040 then floor(((g0.v * (1 - fx) + g1.v * fx) * (1 - fy) + (g2.v * (1 - fx) + g3.v * fx) * fy) * 1e9 + 0.5) / 1e9 end as wavelength from b "
    "join g g0 on g0.j = b.j and g0.i = b.i join g g1 on g1.j = b.j and g1.i = b.i + 1 join g g2 on g2.j = b.j + 1 and g2.i = b.i join g g3 on g3.j = b.j + 1 and g3.i = b.i + 1",
    "tile_manifest": f"with {_T} select {_KEY} as key, min(y) as y0, max(y) + 1 as y1, min(x) as x0, max(x) + 1 as x1, count(*) as pixels, (128 + sum(len(s) * 4))::bigint as bytes from t group by ty, tx",
    "bundle_verified": "select unnest([" + ", ".join(f"'{c}'" for c in _CHECKS) + "]) as check, true as ok",
    "bundle_damaged": f"with {_T} select unnest(['channels unchanged', 'every pixel once', 'tile sizes', 'tile sums', 'tile boxes', 'values', 'spot channels, corners and sky']) as check from (select max(ty) as m from t) where m >= 1",
    "upload_planned": f"with {_T}, k as (select {_KEY} as key, ty * 2 + tx as k, (128 + sum(len(s) * 4))::bigint as bytes from t group by ty, tx) select key, bytes from k where k % 3 <> 0 or k % 4 = 0",
}
