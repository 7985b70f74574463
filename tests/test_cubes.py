import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import cubes
from starloom.plans import cubes as plans
from starloom.sources import fits

WCS = plans.WCS


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    cube = r.normal(size=(25, 18, 6)).astype(np.float32)
    cube[3, 4, 2] = np.nan
    rows = [(y, x, [float(v) for v in cube[y, x]]) for y in range(25) for x in range(18)]
    path = str(tmp_path_factory.mktemp("cube") / "tiles")
    cubes.write_tiles(spark.createDataFrame(rows, "y int, x int, spectrum array<float>"), path, 8)
    channels = spark.createDataFrame([(i + 1, i // 3 + 1, 0.7 + i / 10) for i in range(6)], "channel int, detector int, wavelength double")
    return cube, cubes.read_tiles(spark, path), channels


def test_a_spectrum_reads_one_tile(store):
    cube, tiles, channels = store
    got = cubes.spectrum_at(tiles, channels, WCS, 25, 18, x=4, y=3, size=8)
    assert "PartitionFilters: [isnotnull(ty" in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted(got.collect(), key=lambda r: r.channel)
    assert [r.value for r in rows] == [None if np.isnan(v) else float(v) for v in cube[3, 4]]
    assert [r.valid for r in rows] == [i != 2 for i in range(6)] and rows[0].x_frac == 4.5 / 18 and rows[0].y_frac == 1 - 3.5 / 25


@pytest.mark.parametrize("bad", [{"ra": 1.0}, {"ra": 1.0, "dec": 2.0, "x": 1, "y": 1}, {}, {"x": 1}, {"ra": 400.0, "dec": 0.0}, {"ra": 10.0, "dec": 91.0}])
def test_parameters_are_validated(store, bad):
    _, tiles, channels = store
    with pytest.raises(cubes.BadParameter):
        cubes.spectrum_at(tiles, channels, WCS, 25, 18, **bad)


def test_places_outside_are_refused(store):
    _, tiles, channels = store
    for where in ({"x": 18, "y": 0}, {"x": -1, "y": 0}, {"ra": 10.0, "dec": 2.0}, {"ra": 330.0, "dec": -2.0}):
        with pytest.raises(cubes.OutsideFootprint):
            cubes.spectrum_at(tiles, channels, WCS, 25, 18, **where)
    with pytest.raises(cubes.BadParameter):
        cubes.plane(tiles, 7, 6)
    with pytest.raises(cubes.BadParameter):
        cubes.display_limits(cubes.plane(tiles, 1, 6), 60.0, 50.0)


def test_planes_and_limits(store):
    cube, tiles, _ = store
    got = {(r.y, r.x): r.value for r in cubes.plane(tiles, 3, 6).collect()}
    assert got[3, 4] is None and all(got[y, x] == float(cube[y, x, 2]) for y in range(25) for x in range(18) if (y, x) != (3, 4))
    lim = cubes.display_limits(cubes.plane(tiles, 3, 6)).first()
    assert np.allclose([lim.low, lim.high], np.nanpercentile(cube[:, :, 2].astype(float), [0.5, 99.5]))


def test_a_plane_reads_one_channel(spark, store, tmp_path):
    cube, tiles, _ = store
    path = str(tmp_path / "store")
    cubes.write_store(tiles.where("not (y = 24 and x = 17)"), path, 8)
    plane = cubes.read_plane(spark, path, 3)
    assert "PartitionFilters: [isnotnull(channel" in plane._jdf.queryExecution().executedPlan().toString()
    got = {(r.y, r.x): r.value for r in plane.collect()}
    assert len(got) == 25 * 18 - 1 and got[3, 4] is None and (24, 17) not in got
    assert all(v == float(cube[y, x, 2]) for (y, x), v in got.items() if (y, x) != (3, 4))
    sizes = {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in (tmp_path / "store/planes").iterdir() if p.is_dir()}
    assert len(sizes) == 6 and sizes["channel=3"] < 2 * sum(sizes.values()) / 6
    with pytest.raises(cubes.BadParameter):
        cubes.read_plane(spark, path, 7)


def test_sums_are_of_the_bytes_that_are_written(spark, store):
    import hashlib

    cube, tiles, _ = store
    for r in cubes.tile_objects(tiles).collect():
        held = io.BytesIO()
        np.save(held, cube[r.y0 : r.y1, r.x0 : r.x1])
        assert bytes(r.content) == held.getvalue() and r.pixels == (r.y1 - r.y0) * (r.x1 - r.x0)
        same = cubes.manifest(tiles).where((F.col("ty") == r.ty) & (F.col("tx") == r.tx)).first() if (r.ty, r.tx) == (0, 0) else None
        assert same is None or (same.bytes, same.sha256) == (len(r.content), hashlib.sha256(r.content).hexdigest())


def test_another_store_is_refused(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "y int, x int").write.parquet(str(tmp_path / "t"))
    with pytest.raises(cubes.BadParameter):
        cubes.read_tiles(spark, str(tmp_path / "t"))


def test_npy_tiles(spark):
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    held = io.BytesIO()
    np.save(held, a)
    files = spark.createDataFrame([("t1", bytearray(held.getvalue()))], "path string, content binary")
    got = {(r.row, r.col): list(r.spectrum) for r in cubes.decode_npy(files, 8, 8, 4).collect()}
    assert got == {(y, x): a[y, x].tolist() for y in range(2) for x in range(3)}
    with pytest.raises(Exception, match="BadParameter"):
        cubes.decode_npy(files, 8, 8, 5).collect()


def test_a_failed_check_stops_the_upload(spark, store):
    _, tiles, _ = store
    planned = cubes.manifest(tiles)
    none = planned.limit(0).select("key", "bytes", "sha256")
    ok = spark.createDataFrame([("a", True), ("b", False)], "check string, ok boolean")
    assert cubes.upload_plan(planned, none, ok).count() == 0
    assert cubes.upload_plan(planned, none, ok.where("ok")).count() == planned.count() == 12


def test_cube_of_several_files(spark, tmp_path):
    r = np.random.default_rng(5)
    planes = r.normal(size=(3, 4, 5)).astype(np.float32)
    rows = [(k, y, x, float(planes[k, y, x])) for k in range(3) for y in range(4) for x in range(5)]
    made = fits.to_fits(spark.createDataFrame(rows, "k int, y int, x int, value double"), ["k"], 4, 5).collect()
    for m in made:
        (tmp_path / f"part{m.k}.fits").write_bytes(bytes(m.content))
    cube = fits.read_cube(spark, str(tmp_path / "*.fits"))
    got = {(c.channel, c.y, c.x): c.value for c in cube.collect()}
    assert len(got) == 60 and all(abs(got[k + 1, y, x] - planes[k, y, x]) < 1e-6 for k in range(3) for y in range(4) for x in range(5))
    (tmp_path / "part9.fits").write_bytes(bytes(fits.to_fits(spark.createDataFrame([(9, 0, 0, 1.0)], "k int, y int, x int, value double"), ["k"], 2, 2).first().content))
    with pytest.raises(ValueError, match="grids"):
        fits.read_cube(spark, str(tmp_path / "*.fits"))
