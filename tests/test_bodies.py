import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import bodies, catalogue, linking, robust
from starloom.plans.scratch import rounds
from starloom.sources import tables

EPOCHS = {"A": 0.0, "C": 12.0, "B": 24.0}


def test_places_between_samples(spark):
    rows = [("x", -6.0, 359.99, 89.0, 0.2), ("x", 6.0, 0.03, 89.0, 0.4), ("x", 18.0, 0.05, 89.2, 0.1), ("y", 0.0, 10.0, 5.0, 0.3), ("y", 12.0, 10.5, 5.0, 0.3), ("z", 1.0, 1.0, 1.0, 0.1), ("y", 3.0, None, 5.0, 0.3)]
    got = {(r.body, r.epoch): r for r in bodies.at_epochs(spark.createDataFrame(rows, "body string, mjd double, ra double, dec double, sigma double"), EPOCHS).collect()}
    assert set(got) == {("x", "A"), ("x", "C"), ("y", "A"), ("y", "C")}  # a place needs a sample on either side
    assert abs(got["y", "A"].ra - 10.0) < 1e-9 and abs(got["y", "A"].dec - 5.0) < 1e-9 and abs(got["y", "C"].ra - 10.5) < 1e-9
    assert abs(got["x", "A"].ra - 0.01) < 1e-9 and abs(got["x", "C"].dec - 89.1) < 1e-6 and got["x", "A"].sigma == 0.4


def test_a_body_must_move_as_the_track_does(spark):
    arc = 1 / 3600
    tracks = {"same": 24.0, "slower": 24.0, "turned": 24.0, "once": 24.0, "none": 24.0}
    places, eph = [], []
    for k, (name, motion) in enumerate(tracks.items()):
        ra, dec = 100.0 + k, 10.0
        for e, t in EPOCHS.items():
            places.append((name, e, ra, dec + motion * arc * t / 24, 0.2))
        rate = {"same": (0, 1.0), "slower": (0, 0.97), "turned": (0.2, 1.0), "once": (0, -1.0)}.get(name)
        if rate:
            for t in (-1.0, 30.0):
                eph.append((name, t, ra + rate[0] * motion * arc * t / 24, dec + rate[1] * motion * arc * t / 24, 2.0 if name in ("slower", "turned") else 0.1))
    p = spark.createDataFrame(places, "cand string, epoch string, ra double, dec double, sigma double")
    at = bodies.at_epochs(spark.createDataFrame(eph, "body string, mjd double, ra double, dec double, sigma double"), EPOCHS)
    got = {r.cand: r for r in bodies.evidence(spark.createDataFrame([(k,) for k in tracks], "cand string"), p, at, "A", "B", 24.0).collect()}
    assert {k: (r.n_bodies, r.steady_body) for k, r in got.items()} == {"same": (3, True), "slower": (3, True), "turned": (3, False), "once": (1, False), "none": (0, False)}


def test_fast_stars_are_found_where_they_were(spark):
    """A star that has moved by minutes of arc since the catalogue's year."""
    pm = 70_000.0  # milliarcseconds a year
    stars = spark.createDataFrame([(1, 100.0, 10.0 - pm * 9 / 3_600_000, 0.0, pm, 0.1, 12.0)], "id bigint, ra double, dec double, pmra double, pmdec double, sigma double, mag double")
    cands = spark.createDataFrame([("c", "A", 100.0, 10.0, 0.2, 1.0), ("c", "B", 100.0, 10.0, 0.2, 1.0)], "cand string, epoch string, ra double, dec double, sigma double, flux double")
    got = {r.epoch: r for r in catalogue.associations(cands, stars, {"A": 2025.0, "B": 2025.5}).collect()}
    assert got["A"].star == 1 and got["A"].sep < 1e-6 and got["A"].chi2 < 1 and abs(got["B"].sep - 35.0) < 1e-3


@pytest.mark.parametrize("seed", range(2))
def test_lines_of_groups_equal_loops(spark, seed):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(4):
        x = r.uniform(10, 20, 150)
        y = (1 + g / 10) * x - g + r.normal(0, 0.1, 150) + np.where(r.random(150) < 0.1, 3.0, 0.0)
        rows += [(g, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    rows += [(9, 1.0, None), (9, None, 2.0)]
    got = {q.g: q for q in robust.clipped_lines(spark.createDataFrame(rows, "g int, x double, y double").repartition(3), ["g"], "x", "y", rounds(spark)).collect()}
    assert set(got) == {0, 1, 2, 3}
    for g, found in got.items():
        x, y = (np.array([t[k] for t in rows if t[0] == g]) for k in (1, 2))
        a, b = np.polyfit(x, y, 1)
        for _ in range(3):
            left = y - (a * x + b)
            keep = np.abs(left) < 3 * 1.4826 * np.median(np.abs(left - np.median(left)))
            x, y = x[keep], y[keep]
            a, b = np.polyfit(x, y, 1)
        left = y - (a * x + b)
        assert found.n == len(x) and np.allclose([found.a, found.b, found.scatter], [a, b, 1.4826 * np.median(np.abs(left - np.median(left)))], atol=1e-8)


def test_scatter_of_each_range_of_flux(spark):
    r = np.random.default_rng(5)
    rows = []
    for flux, sigma in ((1.0, 1.2), (4.0, 0.8), (10.0, 0.4)):
        for _ in range(800):
            rows.append((flux, float(np.hypot(*r.normal(0, sigma, 2)))))
    rows += [(20.0, 0.1)] * 5
    pairs = spark.createDataFrame(rows, "flux double, sep double")
    scatter = catalogue.position_scatter(pairs)
    got = {q.range: q.sigma for q in scatter.collect()}
    assert set(got) == {0, 1, 2} and all(abs(got[k] - s) < 0.08 for k, s in enumerate((1.2, 0.8, 0.4)))
    given = {q.flux: q.sigma for q in catalogue.with_scatter(spark.createDataFrame([(0.5,), (7.0,), (99.0,)], "flux double"), scatter).collect()}
    assert given == {0.5: got[0], 7.0: got[2], 99.0: max(got.values())}


def test_offsets_of_epochs_are_taken_away(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(900):
        ra, dec = 150 + (i % 30) * 0.01, 2 + (i // 30) * 0.01
        for e, (east, north) in {"A": (0, 0), "B": (0.6, -0.4)}.items():
            rows.append((e, i, ra + (east + r.normal(0, 0.02)) / 3600 / math.cos(math.radians(dec)), dec + (north + r.normal(0, 0.02)) / 3600))
    moved, residual = linking.registered(spark.createDataFrame(rows, "epoch string, id bigint, ra double, dec double"), "A", rounds(spark))
    assert residual < 0.02
    got = moved.groupBy("id").agg((F.max("dec") - F.min("dec")).alias("d")).agg(F.max("d")).first()[0] * 3600
    assert got < 0.2


def test_headers_of_any_length(spark, tmp_path):
    names = [f"c{i}" for i in range(300)]
    head = ["# %ECSV 1.0", "# ---", "# datatype:", *[f"# - {{name: {n}, datatype: {'int64' if i % 2 else 'float64'}}}" for i, n in enumerate(names)]]
    (tmp_path / "t.ecsv").write_text("\n".join([*head, " ".join(names), " ".join(map(str, range(300)))]) + "\n")
    df = tables.read_ecsv(spark, str(tmp_path / "t.ecsv"))
    assert df.columns == names and df.first().c299 == 299
