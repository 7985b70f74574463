import json

import pytest

from starloom.functions import sky
from starloom.operators import documents, linking
from starloom.plans.cubes import WCS
from starloom.sources import tables

SCHEMA = "kind string, a_id long, a_x double, a_y double, a_snr double, a_flux double, b_id long, b_x double, b_y double, b_snr double, b_flux double"
ROWS = [
    ("seen_only_later", None, None, None, None, None, 9, 40.0, 41.0, 30.0, 5.0),
    ("shifted_match", 1, 10.0, 10.0, 20.0, 2.0, 2, 13.0, 14.0, 80.0, 3.0),
    ("shifted_match", 3, 20.0, 20.0, 90.0, 0.0, 4, 20.0, 21.0, 10.0, 3.0),
    ("seen_only_earlier", 5, 900.0, 5.0, 11.0, 1.0, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return documents.documented(spark.createDataFrame(ROWS, SCHEMA), WCS, 10.0)


def test_documents_are_ordered_and_measured(docs):
    got = docs.orderBy("candidate_id").collect()
    assert [x.candidate_id for x in got] == [f"SX6M-00{i}" for i in (1, 2, 3, 4)]
    assert [x.kind for x in got] == ["shifted_match", "shifted_match", "seen_only_earlier", "seen_only_later"]
    assert got[0].earlier.snr == 90 and got[0].flux_ratio is None and got[1].flux_ratio == 1.5
    assert abs(got[1].displacement - 5 * 6.2) < 0.05 and abs(got[1].rate - 3.1) < 0.01 and got[2].displacement is None
    assert got[0].angle == pytest.approx(0.0, abs=0.1) or got[0].angle == pytest.approx(360.0, abs=0.1)


def test_markers_details_and_refusals(docs):
    m = {x.candidate_id: x for x in documents.markers(docs, "earlier", 100, 100).collect()}
    assert m["SX6M-004"].x == 40 and not m["SX6M-004"].own and m["SX6M-004"].inside and not m["SX6M-003"].inside
    one = documents.detail(docs, " sx6m-003").first()
    assert [(c["at"], c["image"]) for c in one.cutouts] == [("earlier", i) for i in ("earlier", "later", "difference")]
    with pytest.raises(documents.UnknownCandidate):
        documents.detail(docs, "SX6M-999")
    with pytest.raises(documents.BadRequest):
        documents.markers(docs, "middle", 10, 10)


def test_summary_is_written_and_read_back(spark, docs, tmp_path):
    rejected = spark.createDataFrame([("f1", "stationary", 5), ("f2", "stationary", 2), ("f1", "flagged_pixel", 9)], "field string, reason string, n long")
    tables.write_document(documents.summary(docs, rejected), str(tmp_path / "d"))
    doc = json.loads(spark.read.text(str(tmp_path / "d")).first()[0])
    assert [c["candidate_id"] for c in doc["candidates"]] == ["SX6M-001", "SX6M-002", "SX6M-003", "SX6M-004"]
    assert doc["counts"] == {"matched_pair": 0, "shifted_match": 2, "seen_only_earlier": 1, "seen_only_later": 1}
    assert doc["rejected"] == [{"reason": "flagged_pixel", "n": 9}, {"reason": "stationary", "n": 7}]


def test_tables_in_and_out(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "a int, b double")
    tables.write_csv(df, str(tmp_path / "c"), {"b": "double", "z": "string", "a": "int"})
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["b", "z", "a"]
    (tmp_path / "ok.csv").write_text("x\n1.5\n")
    found, failed = tables.read_many(spark, {"ok": (str(tmp_path / "ok.csv"), "x double"), "gone": (str(tmp_path / "none.csv"), "x double")})
    assert found["ok"].first().x == 1.5 and set(failed) == {"gone"}
    (tmp_path / "keys.txt").write_text("2025-01-01 10:00:00  123 a/b level2.fits\nbroken line\n2025-01-02 11:00:00 5 c/d.fits\n")
    got = sorted((r.size, r.key) for r in tables.read_keys(spark, str(tmp_path / "keys.txt"), "fits").collect())
    assert got == [(5, "c/d.fits"), (123, "a/b level2.fits")]
    nan = float("nan")
    deep = spark.createDataFrame([(1, [1.0, nan], {"k": nan}, (nan, 2.0))], "i int, v array<double>, m map<string,double>, s struct<p:double,q:double>")
    one = tables.finite(deep).first()
    assert list(one.v) == [1.0, None] and one.m == {"k": None} and one.s.p is None and one.s.q == 2.0
    assert tables.with_suffix(spark.createDataFrame([], "a_ra int, a_dec int, x int"), "_ra", "_dec") == ["a_ra", "a_dec"]
    (tmp_path / "j.json").write_text('{"a": 1,\n "b": {"k": 2}}')
    j = tables.read_json(spark, str(tmp_path / "j.json"), "a int, b map<string,int>")
    assert [tuple(r) for r in tables.explode_map(j, "b", "name", "n").collect()] == [(1, "k", 2)]


def test_distortion_there_and_back(spark):
    """The forward and the inverse polynomial of a small distortion undo each other to a hundredth of a pixel."""
    sip = {**WCS, "a": {(2, 0): 1e-5, (1, 1): -2e-6}, "b": {(0, 2): 2e-5}, "ap": {(2, 0): -1e-5, (1, 1): 2e-6}, "bp": {(0, 2): -2e-5}}

    df = spark.createDataFrame([(float(x), float(y)) for x in (0, 13, 40) for y in (2, 25, 60)], "x double, y double")
    plain = df.select("x", "y", *[c.alias(n) for c, n in zip(sky.tan_to_sky("x", "y", WCS), ("r0", "d0"), strict=True)], *[c.alias(n) for c, n in zip(sky.tan_to_sky("x", "y", sip), ("ra", "dec"), strict=True)])
    back = plain.select("*", *[c.alias(n) for c, n in zip(sky.tan_to_pixel("ra", "dec", sip), ("bx", "by"), strict=True)], sky.separation("r0", "d0", "ra", "dec").alias("moved")).collect()
    assert all(abs(r.bx - r.x) < 0.01 and abs(r.by - r.y) < 0.01 for r in back) and max(r.moved for r in back) > 0.05


def test_a_mover_among_stars_is_linked(spark):
    """Two stars that stay, one mover, and a chain over stars: only the mover is accepted."""
    rows = []
    for e, share in (("A", 0.0), ("C", 0.5), ("B", 1.0)):
        rows += [(e, 1, 10.0, 20.0, 5.0, 0.1), (e, 2, 10.0, 20.0 + 30 / 3600, 5.0, 0.1), (e, 3, 10.05, 20.0 + 24 * share / 3600, 6.0, 0.1)]
    found = linking.statuses(spark.createDataFrame(rows, "epoch string, id long, ra double, dec double, flux double, sigma double"), 6.5)
    assert {(r.epoch, r.id): r.status for r in found.collect()} == {(e, i): "STATIONARY" if i < 3 else "ISOLATED" for e in "ACB" for i in (1, 2, 3)}
    t = linking.tracks(found, 0.5, most=40.0).collect()
    assert [(r.a_id, r.c_id, r.b_id) for r in t if r.reason is None] == [(3, 3, 3)]
    v = linking.validated(linking.tracks(found, 0.5, most=40.0).where("reason is null"), 10.0, 10.0).first()
    assert v.turn < 1e-3 and v.steady > 0.999 and not v.rejected and v.validation > 95
