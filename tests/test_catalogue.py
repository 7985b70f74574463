import math

import pytest
from pyspark.sql import functions as F

from starloom.functions import sky
from starloom.operators import catalogue, spatial

STARS = "id long, ra double, dec double, pmra double, pmdec double, sigma double, mag double"
PLACES = "cand string, epoch string, ra double, dec double, sigma double, flux double"
CANDS = "cand string, epochs int, observed_rate double, n_persistent int, n_bodies int, steady_body boolean"
YEARS = {"A": 2016.0, "C": 2017.0, "B": 2018.0}


def test_errors_of_a_star_grow_with_the_years(spark):
    one = spark.range(1)
    got = one.select(sky.catalogue_sigma(F.lit(3.0), F.lit(4.0), F.lit(2.0), F.lit(6.0), F.lit(10.0), F.lit(True)), sky.catalogue_sigma(F.lit(3.0), F.lit(4.0), F.lit(None).cast("double"), F.lit(-1.0), F.lit(10.0), F.lit(False)), sky.months(F.lit(365.25))).first()
    assert got[0] == pytest.approx(math.sqrt(12.5 + 400 + 9) / 1000) and got[1] == pytest.approx(math.sqrt(12.5 + 40000) / 1000) and got[2] == pytest.approx(12)


def test_cone_is_exact_and_typed_when_empty(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 20.0 + 1 / 3600), (3, 10.01, 20.0), (4, None, None)], "id long, ra double, dec double")
    assert [r.id for r in spatial.cone(df, 10.0, 20.0, 1.5).orderBy("sep").collect()] == [1, 2]
    none = spatial.cone(df, 200.0, -20.0, 60.0)
    assert none.count() == 0 and none.columns == ["id", "ra", "dec", "sep"]


def test_brightness_relation_and_associations(spark):
    pairs = spark.createDataFrame([(0.5, 10 ** (-0.4 * (0.9 * m / 10 + 2 + (m * 7 % 5 - 2) * 0.01)), m / 10) for m in range(100, 180)] + [(0.5, 1.0, 15.0), (9.0, 5.0, 3.0)], "sep double, flux double, mag double")
    a, b, scatter = catalogue.calibrated(pairs)
    assert a == pytest.approx(0.9, abs=5e-3) and b == pytest.approx(2, abs=0.05) and scatter < 0.03
    assert catalogue.calibrated(pairs.limit(10)) is None
    # star 1 moves by 1 arcsec a year; star 2 is near but far in errors
    stars = spark.createDataFrame([(1, 10.0, 20.0, 0.0, 1000.0, 0.1, 12.0), (2, 10.0, 20.0 + 5 / 3600, None, None, 0.1, 12.0)], STARS)
    places = spark.createDataFrame([("x", e, 10.0, 20.0 + k / 3600, 0.1, 1.0) for e, k in (("A", 0), ("C", 1), ("B", 2))] + [("y", "A", 50.0, 0.0, 0.1, 1.0)], PLACES)
    got = {(r.cand, r.epoch): r for r in catalogue.associations(places, stars, YEARS, line=(1.0, -12.0, 0.1)).collect()}
    assert set(got) == {("x", "A"), ("x", "C"), ("x", "B")}
    assert all(r.star == 1 and r.sep < 0.01 and r.n_cone == 2 and r.n_consistent == 1 and r.mag_ok and r.p_chance < 1e-4 for r in got.values())
    assert got["x", "A"].rate == pytest.approx(1 / 365.25)


def test_the_first_rule_that_holds_decides(spark):
    cands = spark.createDataFrame([
        ("body", 3, 1.0, 0, 2, True), ("static", 3, 1.0, 3, 0, False), ("fast", 3, 0.001, 0, 0, False), ("linked", 3, 1.0, 3, 0, False), ("shaky", 3, 1.0, 1, 0, False), ("none", 3, 1.0, 0, 0, False),
    ], CANDS)
    found = spark.createDataFrame(
        [("static", e, 5, 1, 7, 0.1, 1.0, 0.001, True, 0.0) for e in "AC"] + [("fast", "A", 5, 1, 8, 0.1, 1.0, 0.001, True, 0.9)]
        + [("linked", e, 5, 1, i, 0.1, 1.0, 0.01, True, 0.0) for i, e in enumerate("ACB")] + [("shaky", e, 5, 1, i, 0.1, 1.0, 0.01, True, 0.0) for i, e in enumerate("ACB")]
        + [("none", "A", 5, 0, 9, 30.0, 900.0, 0.9, True, 0.0)],
        "cand string, epoch string, n_cone long, n_consistent long, star long, sep double, chi2 double, p_chance double, mag_ok boolean, rate double",
    )
    got = {r.cand: r for r in catalogue.classified(cands, found).collect()}
    assert {k: r.explanation for k, r in got.items()} == {
        "body": "KNOWN_SOLAR_SYSTEM_OBJECT", "static": "STATIC_KNOWN_STAR", "fast": "HIGH_PM_STAR_CANDIDATE", "linked": "LINKED_KNOWN_STARS", "shaky": "INSUFFICIENT_OR_AMBIGUOUS", "none": "NO_ASSOCIATION",
    }
    assert got["linked"].confidence == "HIGH" and "1 of 3 places" in got["shaky"].reason and "star 7" in got["static"].reason
    late = {r.cand: r["class"] for r in catalogue.classified(cands, found, complete=False).collect()}
    assert late["none"] == "UNCERTAIN"
