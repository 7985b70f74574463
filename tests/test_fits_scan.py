import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import cubes
from starloom.sources import fits, fits_scan, store


def unit(cards, body=b""):
    head = "".join(c.ljust(80) for c in [*cards, "END"]).encode()
    return head.ljust(-(-len(head) // 2880) * 2880) + body + bytes(-len(body) % 2880)


def cube_file(planes, extra=0, **more):
    first = unit(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", *["COMMENT x"] * extra])
    k, h, w = planes.shape
    cards = ["XTENSION= 'IMAGE   '", "BITPIX  =                  -32", "NAXIS   =                    3", f"NAXIS1  = {w}", f"NAXIS2  = {h}", f"NAXIS3  = {k}", "EXTNAME = 'IMAGE   '"]
    return first + unit([*cards, *[fits.card(n.replace("_", "-") if n == "MJD_OBS" else n, v) for n, v in more.items()]], planes.astype(">f4").tobytes())


@pytest.fixture(scope="module")
def planes():
    p = np.random.default_rng(1).normal(size=(12, 50, 40)).astype(np.float32)
    p[3, 4, 5] = np.nan
    return p


@pytest.fixture(scope="module")
def root(planes, tmp_path_factory):
    base = tmp_path_factory.mktemp("fits")
    (base / "a").mkdir()
    (base / "a/plain.fits").write_bytes(cube_file(planes))
    (base / "a/packed.fits.gz").write_bytes(gzip.compress(cube_file(planes)))
    return str(base)


def pixels(df):
    return {(r.key, r.plane, r.y, r.x): r.value for r in df.collect()}


def test_all_pixels(spark, root, planes):
    got = pixels(fits_scan.read_images(spark, root, hdu="IMAGE", band=3000))
    assert len(got) == 2 * planes.size
    for key in ("a/plain.fits", "a/packed.fits.gz"):
        assert got[key, 3, 4, 5] is None
        assert all(got[key, k, y, x] == float(planes[k, y, x]) for k in range(12) for y in range(50) for x in range(40) if (k, y, x) != (3, 4, 5))


def test_filters_reach_the_source(spark, root, planes):
    df = fits_scan.read_images(spark, root).where("key = 'a/plain.fits' and plane in (2, 3, 7) and y >= 10 and y < 13 and x = 5")
    left = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter " in x]
    assert len(left) == 1 and left[0].count(" = ") == 1 and "x#" in left[0] and "plane#" not in left[0] and ">=" not in left[0]
    got = pixels(df)
    assert got == {("a/plain.fits", k, y, 5): float(planes[k, y, 5]) for k in (2, 3, 7) for y in (10, 11, 12)}
    assert fits_scan.read_images(spark, root).where("plane = 99").count() == 0
    assert fits_scan.read_images(spark, root, keys="none*").count() == 0


@pytest.mark.parametrize(("planes_", "rows"), [([4], (0, 50)), ([4, 5], (10, 20)), ([0], (49, 50))])
def test_bytes_read_are_those_wanted(root, planes, planes_, rows):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    reader = fits_scan.ImageReader({"root": root})
    asked = [EqualTo(("key",), "a/plain.fits"), In(("plane",), tuple(planes_)), GreaterThanOrEqual(("y",), rows[0]), LessThan(("y",), rows[1])]
    assert list(reader.pushFilters([*asked, EqualTo(("x",), 3)])) == [EqualTo(("x",), 3)]
    parts = reader.partitions()
    heads = reader.n_read
    assert heads <= 2 + 2 * fits_scan.STEP
    count = sum(b.num_rows for p in parts for b in reader.read(p))
    wanted = len(planes_) * (rows[1] - rows[0]) * 40
    assert count == wanted and reader.n_read - heads == 4 * wanted


def test_a_plane_is_read_from_a_file_whose_end_is_missing(spark, planes, tmp_path):
    """Nothing behind the wanted rows is touched, in plain and in packed files."""
    whole = cube_file(planes)
    cut = 2 * 2880 + 4 * 5 * 2000
    (tmp_path / "cut.fits").write_bytes(whole[:cut])
    (tmp_path / "cut.gz").write_bytes(gzip.compress(whole[:cut]))
    got = pixels(fits_scan.read_images(spark, str(tmp_path)).where("plane = 4"))
    assert len(got) == 4000 and got["cut.gz", 4, 49, 39] == float(planes[4, 49, 39])
    with pytest.raises(Exception, match="end early"):
        fits_scan.read_images(spark, str(tmp_path)).where("plane = 5").count()


def test_scaled_and_blank_integers(spark, tmp_path):
    body = struct.pack(">4h", 1, -7, 3, 4)
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    2", "NAXIS2  =                    2", "BSCALE  =                  0.5", "BZERO   =                   10", "BLANK   =                   -7"]
    (tmp_path / "i.fits").write_bytes(unit(cards, body))
    assert {(r.y, r.x): r.value for r in fits_scan.read_images(spark, str(tmp_path)).collect()} == {(0, 0): 10.5, (0, 1): None, (1, 0): 11.5, (1, 1): 12}


@pytest.mark.parametrize("key", ["", "/etc/passwd", "../x", "a/../../x", "a//b", "a/./b", "..\\x", "a\0b"])
def test_keys_stay_inside(root, key):
    with pytest.raises(store.BadKey):
        store.Store(root).read(key)


def test_links_stay_inside(tmp_path):
    (tmp_path / "out").write_bytes(b"secret")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/link").symlink_to(tmp_path / "out")
    with pytest.raises(store.BadKey):
        store.Store(str(tmp_path / "in")).read("link")


def test_header_scan(spark, planes, tmp_path):
    sky = {"CRVAL1": 155.352, "CRVAL2": -42.7, "CRPIX1": 20.5, "CRPIX2": 25.5, "CD1_1": -0.0017, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": 0.0017, "MJD_OBS": 60000.5}
    (tmp_path / "good.fits").write_bytes(cube_file(planes, **sky, WAVE=1.5))
    (tmp_path / "far.fits").write_bytes(cube_file(planes, **{**sky, "CRVAL1": 155.352 + 51, "MJD_OBS": 60010.0}))
    (tmp_path / "late.fits").write_bytes(cube_file(planes, extra=2000, **sky))
    (tmp_path / "text.fits").write_bytes(b"no header at all" * 1000)
    (tmp_path / "short.fits").write_bytes(cube_file(planes)[:1000])
    keys = spark.createDataFrame([(k,) for k in ("good.fits", "far.fits", "late.fits", "text.fits", "short.fits", "none.fits", "../x")], "key string").repartition(3)
    scanned = fits_scan.scan_headers(keys, str(tmp_path))
    got = {r.key: r for r in scanned.collect()}
    assert len(got) == 7 and got["good.fits"].error is None and got["good.fits"].header["EXTNAME"] == "IMAGE"
    assert all(r.n_bytes <= fits_scan.FIRST for r in got.values()) and got["good.fits"].n_bytes <= 2 * fits_scan.STEP
    assert {k: r.error.split(":")[0] for k, r in got.items() if r.error} == {"late.fits": "ValueError", "text.fits": "ValueError", "short.fits": "ValueError", "none.fits": "FileNotFoundError", "../x": "BadKey"}
    found = fits_scan.frames(scanned, wave="WAVE")
    assert {r.key: (r.width, r.mjd, r.wave) for r in found.collect()} == {"good.fits": (40.0, 60000.5, 1.5), "far.fits": (40.0, 60010.0, None)}
    hits = fits_scan.covering(found, 155.352, -42.7, 60003.0).collect()
    assert [h.key for h in hits] == ["good.fits"] and abs(hits[0].x - 19.5) < 1e-9 and abs(hits[0].y - 24.5) < 1e-9 and hits[0].delta_days == 2.5


def test_retries(tmp_path, monkeypatch):
    s = store.Store(str(tmp_path), tries=3, wait=0)
    (tmp_path / "k").write_bytes(b"abc")
    left = [2]
    opened = s.fs.open_input_file

    class Flaky:
        def __getattr__(self, name):
            return getattr(s_fs, name)

        def open_input_file(self, path):
            if left[0]:
                left[0] -= 1
                raise OSError("reset")
            return opened(path)

    s_fs = s.fs
    s.fs = Flaky()
    monkeypatch.setattr(store.Store, "path", lambda self, key: f"{self.base}/{key}")
    assert s.read("k", 1) == b"bc"
    left[0] = 3
    with pytest.raises(OSError, match="reset"):
        s.read("k")


def objects(spark, fail=None):
    df = spark.range(40).repartition(8, "id").select(F.format_string("t/%03d", "id").alias("key"), F.encode(F.repeat(F.col("id").cast("string"), 50), "UTF-8").alias("content"))
    if fail is not None:
        df = df.withColumn("content", F.when(F.col("key") == fail, F.raise_error(F.lit("killed")).cast("binary")).otherwise(F.col("content")))
    return df


def test_a_write_that_is_killed_is_taken_up_again(spark, tmp_path):
    root = str(tmp_path / "r")
    with pytest.raises(Exception, match="killed"):
        store.write_objects(objects(spark, "t/023"), root)
    s = store.Store(root)
    there = set(s.keys("t/*"))
    assert "t/023" not in there and s.size("_manifest.json") is None and store.read_manifest(spark, root).count() == 0
    s.put("t/000", b"damaged")
    times = {k: (tmp_path / "r" / k).stat().st_mtime_ns for k in there - {"t/000"}}
    store.write_objects(objects(spark), root)
    listed = {r.key: (r.bytes, r.sha256) for r in store.read_manifest(spark, root).collect()}
    assert set(listed) == set(s.keys("t/*")) and len(listed) == 40
    assert all((tmp_path / "r" / k).stat().st_mtime_ns == t for k, t in times.items())
    back = store.read_objects(spark.createDataFrame([(k,) for k in [*listed, "t/none"]], "key string"), root)
    got = {r.key: (r.content, r.error) for r in back.collect()}
    assert got["t/none"][1].startswith("FileNotFoundError") and bytes(got["t/000"][0]) == b"0" * 50 and not [k for k in s.keys() if "part" in k and k.endswith(".part")]
    with pytest.raises(store.BadKey, match="more than once"):
        store.write_objects(objects(spark).unionByName(objects(spark)), root)


def test_headers_of_written_images(spark, tmp_path):
    wcs = {"crval1": 150.25, "crval2": -2.5, "crpix1": 1.5, "crpix2": 2.0, "cd11": -1e-3, "cd12": 0.0, "cd21": 0.0, "cd22": 1e-3}
    px = spark.createDataFrame([("g", 0, 0, 1.5, "it's", 60000.25, 7), ("g", 1, 2, -2.0, "it's", 60000.25, 7), ("h", 0, 1, None, None, None, None)], "key string, y int, x int, value double, object string, mjd double, band bigint")
    made = fits.to_fits(px, ["key"], 2, 3, wcs, ["object", "mjd", "band"]).withColumn("key", F.concat("key", F.lit(".fits")))
    store.write_objects(made, str(tmp_path))
    heads = {r.key: r.header for r in fits_scan.scan_headers(made, str(tmp_path), None).collect()}
    assert heads["g.fits"]["OBJECT"] == "it's" and float(heads["g.fits"]["MJD"]) == 60000.25 and heads["g.fits"]["BAND"] == "7" and "OBJECT" not in heads["h.fits"]
    frame = {r.key: r for r in fits_scan.frames(fits_scan.scan_headers(made, str(tmp_path), None)).collect()}["g.fits"]
    assert {k: frame[k] for k in wcs} == wcs
    assert {(r.y, r.x): r.value for r in fits_scan.read_images(spark, str(tmp_path), "*.fits").where("key = 'g.fits'").collect()}[1, 2] == -2


def bintable(columns, body, rows, width, heap=b"", name="T"):
    cards = ["XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", f"NAXIS1  = {width}", f"NAXIS2  = {rows}", f"PCOUNT  = {len(heap)}", "GCOUNT  =                    1", f"TFIELDS = {len(columns)}", fits.card("EXTNAME", name)]
    for i, (label, form, dim) in enumerate(columns, 1):
        cards += [fits.card(f"TTYPE{i}", label), fits.card(f"TFORM{i}", form), *([fits.card(f"TDIM{i}", dim)] if dim else [])]
    return unit(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"]) + unit(cards, body + heap)


def test_shaped_columns_feed_the_wavelength_grid(spark, tmp_path):
    """A calibration grid X[9], Y[14], VALUES[14, 9, 2] in one row."""
    xs, ys = np.linspace(0, 2040, 9), np.linspace(0, 2040, 14)
    values = np.random.default_rng(3).uniform(0.7, 5, (14, 9, 2))
    body = xs.astype(">f8").tobytes() + ys.astype(">f8").tobytes() + values.astype(">f8").tobytes()
    (tmp_path / "w.fits").write_bytes(bintable([("X", "9D", None), ("Y", "14D", None), ("VALUES", "252D", "(2,9,14)")], body, 1, len(body), name="WCS-WAVE"))
    table = fits.read_table(spark, str(tmp_path / "w.fits"), "WCS-WAVE", "X array<double>, Y array<double>, VALUES array<array<array<double>>>")
    grid = cubes.calibration_grid(table)
    assert {(r.j, r.i): (r.v, r.width) for r in grid.collect()} == {(j, i): tuple(values[j, i]) for j in range(14) for i in range(9)}
    at = spark.createDataFrame([(float(xs[3]), float(ys[5])), (3000.0, 0.0)], "x double, y double")
    got = cubes.wavelength_at(at, grid.select("j", "i", "v"), xs.tolist(), ys.tolist(), 2040.0, 2040.0).collect()
    assert {round(r.wavelength, 9) if r.wavelength else None for r in got} == {round(values[5, 3, 0], 9), None}
    odd = bintable([("X", "9D", "(2,5)")], xs.astype(">f8").tobytes(), 1, 72)
    with pytest.raises(ValueError, match="isn't"):
        fits.binary_table(odd, "T")


def test_variable_arrays_and_other_types():
    heap = struct.pack(">3f", 1.5, 2.5, 3.5) + b"hello" + struct.pack(">2h", 7, -8) + bytes([0b10110000])
    rows = struct.pack(">ii", 3, 0) + struct.pack(">qq", 5, 12) + b"T" + bytes([0b01000000]) + struct.pack(">2f", 1, -2) + b"abcdef" + struct.pack(">ii", 4, 21)
    rows += struct.pack(">ii", 0, 0) + struct.pack(">qq", 2, 12) + b"F" + bytes([0b10000000]) + struct.pack(">2f", 0, 0) + b"xy\0zz " + struct.pack(">ii", 1, 21)
    columns = [("P", "1PE(3)", None), ("Q", "1QA(5)", None), ("L", "L", None), ("X", "3X", None), ("C", "C", None), ("A", "6A", "(3,2)"), ("B", "1PX(4)", None)]
    got = fits.binary_table(bintable(columns, rows, 2, len(rows) // 2, heap), "T")
    assert got["P"] == [[1.5, 2.5, 3.5], []] and got["Q"] == ["hello", "he"] and got["L"] == [True, False]
    assert got["X"] == [[False, True, False], [True, False, False]] and got["C"] == [[1.0, -2.0], [0.0, 0.0]] and got["A"] == [["abc", "def"], ["xy", "zz"]]
    assert got["B"] == [[True, False, True, True], [True]]
    with pytest.raises(ValueError, match="heap"):
        fits.binary_table(bintable([("P", "PE", None)], struct.pack(">ii", 3, 8), 1, 8, heap[:12]), "T")
