import gzip
import struct

import pytest

from starloom.sources import fits, tables
from starloom.streaming import events


def unit(cards, body=b""):
    head = "".join(c.ljust(80) for c in [*cards, "END"]).encode()
    return head.ljust(-(-len(head) // 2880) * 2880) + body + bytes(-len(body) % 2880)


def sample():
    first = unit(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"])
    body = struct.pack(">6h", 1, 2, 3, -4, 5, 6)
    second = unit(
        ["XTENSION= 'IMAGE   '", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    3", "NAXIS2  =                    2", "EXTNAME = 'IMAGE   ' / it''s", "BSCALE  =                  0.5", "BZERO   =                   10"],
        body,
    )
    return first + second


def test_pixels_and_headers(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(sample())
    (tmp_path / "b.fits.gz").write_bytes(gzip.compress(sample()))
    got = fits.read_pixels(spark, str(tmp_path / "*"), "IMAGE").collect()
    assert len(got) == 12
    assert {(x.y, x.x): x.value for x in got if x.path.endswith("a.fits")} == {(0, 0): 10.5, (0, 1): 11, (0, 2): 11.5, (1, 0): 8, (1, 1): 12.5, (1, 2): 13}
    heads = fits.read_headers(spark, str(tmp_path / "a.fits")).collect()
    assert [h.header.get("EXTNAME") for h in sorted(heads, key=lambda h: h.unit)] == [None, "IMAGE"]


def test_writing_and_reading_back(spark):
    px = spark.createDataFrame([("g", 0, 0, 1.5), ("g", 1, 2, -2.0), ("h", 0, 1, None)], "grid string, y int, x int, value double")
    made = {r.grid: bytes(r.content) for r in fits.to_fits(px, ["grid"], 2, 3).collect()}
    _, a = fits.image(made["g"])
    assert a.shape == (1, 2, 3) and a[0, 0, 0] == 1.5 and a[0, 1, 2] == -2 and a[0, 0, 1] != a[0, 0, 1]
    with pytest.raises(ValueError):
        list(fits.units(made["g"][:2890]))


def test_tables(spark, tmp_path):
    p = tmp_path / "t.ecsv"
    p.write_text("# %ECSV 1.0\n# ---\n# datatype:\n# - {name: source_id, datatype: int64}\n# - {name: ra, unit: deg, datatype: float64}\nsource_id ra\n5365912345678901234 1.5\n7 \"\"\n")
    df = tables.read_ecsv(spark, str(p))
    assert df.dtypes == [("source_id", "bigint"), ("ra", "double")]
    assert sorted((r.source_id, r.ra) for r in df.collect()) == [(7, None), (5365912345678901234, 1.5)]
    (tmp_path / "e.csv").write_text("x,y\n")
    assert tables.read_csv(spark, str(tmp_path / "e.csv"), "x double, y string").dtypes == [("x", "double"), ("y", "string")]
    (tmp_path / "v.csv").write_text('<VOTABLE><INFO name="QUERY_STATUS" value="ERROR">no such table</INFO></VOTABLE>')
    with pytest.raises(tables.ErrorDocument, match="no such table"):
        tables.read_csv(spark, str(tmp_path / "v.csv"), "x double")
    assert tables.reindexed(df, {"ra": "double", "dec": "double"}).columns == ["ra", "dec"]
    f = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, k int")
    assert sorted((r.k, r.v) for r in tables.finite(f).collect()) == [(1, None), (2, 2.0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 7) as ts, id % 3 as user_id, concat('t', id % 2) as event_type, id * 1.0D as value, '' as props from range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    q = events.windowed(events.stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = events.windowed(rows)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))


def test_binary_tables(spark, tmp_path):
    """Channel lists and calibration grids come as binary tables: scalars, strings and arrays, big-endian."""
    body = b"".join(struct.pack(">i", i) + f"D{i}".ljust(4).encode() + struct.pack(">2d", 0.5 + i, 1.5 * i) for i in (1, 2, 3))
    table = unit(
        ["XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                   24", "NAXIS2  =                    3", "PCOUNT  =                    0", "GCOUNT  =                    1",
         "TFIELDS =                    3", "TTYPE1  = 'CHANNEL '", "TFORM1  = 'J       '", "TTYPE2  = 'DETECTOR'", "TFORM2  = '4A      '", "TTYPE3  = 'WAVE    '", "TFORM3  = '2D      '", "EXTNAME = 'CHANNELS'"],
        body,
    )
    (tmp_path / "t.fits").write_bytes(sample() + table)
    got = sorted(fits.read_table(spark, str(tmp_path / "t.fits"), "CHANNELS", "CHANNEL int, DETECTOR string, WAVE array<double>").collect(), key=lambda r: r.CHANNEL)
    assert [(r.CHANNEL, r.DETECTOR, list(r.WAVE)) for r in got] == [(i, f"D{i}", [0.5 + i, 1.5 * i]) for i in (1, 2, 3)]
    with pytest.raises(Exception, match="no table"):
        fits.read_table(spark, str(tmp_path / "t.fits"), "OTHER", "X int").collect()
    heads = fits.read_headers(spark, str(tmp_path / "t.fits"), whole=False).collect()
    assert len(heads) == 2
