import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions import sky, text
from starloom.operators import geometry, grid, robust, spatial
from starloom.plans.scratch import rounds


def points(spark, rows, names=("x", "y")):
    return spark.createDataFrame([(i, float(a), float(b), float(i % 7 + 1)) for i, (a, b) in enumerate(rows)], f"id bigint, {names[0]} double, {names[1]} double, flux double")


@pytest.mark.parametrize("seed", [1, 2])
def test_mutual_matches_equal_brute_force(spark, seed):
    r = random.Random(seed)
    a = [(r.uniform(-20, 20), r.uniform(-20, 20)) for _ in range(150)]
    b = [(x + r.gauss(0, 0.4), y + r.gauss(0, 0.4)) for x, y in a[:120]] + [(r.uniform(-20, 20), r.uniform(-20, 20)) for _ in range(30)]
    near = lambda p, q: min(range(len(q)), key=lambda j: (math.dist(p, q[j]), j))
    want = {(i, j) for i, p in enumerate(a) if near(b[j := near(p, b)], a) == i and math.dist(p, b[j]) <= 1.5}
    got = {(x.a_id, x.b_id) for x in spatial.mutual_matches(points(spark, a), points(spark, b), 1.5).collect()}
    assert got == want


def test_no_nested_loop_in_spatial_joins(spark):
    a = points(spark, [(i, i) for i in range(50)])
    for df in (spatial.pairs(a, a, 2.0), spatial.in_halo(a, a, 2.0), spatial.banded_self_pairs(a, "x", 3, 5, ["flux"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sky_pairs_at_the_pole_and_across_zero(spark):
    r = random.Random(3)
    a = [(r.uniform(0, 360), 89.99 + r.uniform(0, 0.01)) for _ in range(60)] + [(359.999, 0.0), (0.001, 0.0), (10, -90), (200, -90)]
    b = [((x + r.uniform(-0.001, 0.001)) % 360, max(-90, min(90, y + r.uniform(-0.001, 0.001)))) for x, y in a]

    def sep(p, q):
        d1, d2, dr = math.radians(p[1]), math.radians(q[1]), math.radians(q[0] - p[0])
        h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin(dr / 2) ** 2
        return math.degrees(2 * math.asin(min(1, math.sqrt(h)))) * 3600

    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if sep(p, q) <= 10}
    got = {(x.a_id, x.b_id) for x in spatial.sky_pairs(points(spark, a, ("ra", "dec")), points(spark, b, ("ra", "dec")), 10.0).collect()}
    assert got == want and len(want) > 60


@pytest.mark.parametrize("seed", range(3))
def test_greedy_pairs_equal_the_loop(spark, seed):
    r = random.Random(seed)
    options = sorted({(float(r.randint(1, 6)), r.randint(0, 15), r.randint(0, 15)) for _ in range(70)})
    used, want = (set(), set()), []
    for s, i, j in options:
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            want.append((i, j))
    df = spark.createDataFrame([(i, j, s) for s, i, j in options], "a_id int, b_id int, sep double")
    got = spatial.greedy_pairs(df, rounds(spark)).collect()
    assert sorted((x.a_id, x.b_id) for x in got) == sorted(want)
    assert spatial.greedy_pairs(df.limit(0), rounds(spark)).count() == 0


def test_clipped_stats_equal_the_loop(spark):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(6):
        v = np.concatenate((r.normal(10, 1, 80), r.normal(60, 1, 5 * k)))
        rows += [(k, float(x)) for x in v] + [(k, float("nan")), (k, None), (k, float("inf"))]
        for _ in range(5):
            m = np.median(v)
            s = 1.4826 * np.median(np.abs(v - m))
            keep = np.abs(v - m) <= 3 * s
            if s <= 0 or keep.all():
                break
            v = v[keep]
        m = np.median(v)
        want[k] = (m, 1.4826 * np.median(np.abs(v - m)), len(v))
    rows += [(9, 5.0)] * 4
    want[9] = (5.0, 0.0, 4)
    for x in robust.clipped_stats(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect():
        assert np.allclose((x.med, x["std"], x.n), want[x.k], rtol=1e-12)


def test_clipped_line(spark):
    r = random.Random(2)
    rows = [(x / 10, 3 * x / 10 - 1 + r.gauss(0, 0.1)) for x in range(300)] + [(5.0, 500.0)] * 5 + [(None, 1.0)]
    out = robust.clipped_line(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert abs(out.a - 3) < 0.01 and abs(out.b + 1) < 0.1 and out.n <= 300 and abs(out.scatter - 0.1) < 0.02


def test_calibration_defaults_and_bins(spark):
    few = spark.createDataFrame([(i, 1.0, 0.1, 0.1) for i in range(5)], "a_id int, inv double, dx double, dy double")
    assert tuple(robust.calibration(few, ["a_id"], "inv", ["dx", "dy"], rounds(spark)).first()) == (0.1, 1.0, 5)


def flood(cells, h, w):
    out, todo = set(), [c for c in cells if c[0] in (0, h - 1) or c[1] in (0, w - 1)]
    while todo:
        c = todo.pop()
        if c in out or c not in cells:
            continue
        out.add(c)
        todo += [(c[0] + dy, c[1] + dx) for dy, dx in grid.PLUS]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fill_components_and_rectangle(spark, seed):
    r = random.Random(seed)
    h, w = 14, 17
    cells = {(y, x) for y in range(h) for x in range(w) if r.random() < 0.55}
    df = spark.createDataFrame([(y, x, float((y * 7 + x * 3) % 11 - 5)) for y, x in cells], "y int, x int, v double")
    assert {(p.y, p.x) for p in grid.outside(df, rounds(spark), h, w).collect()} == flood(cells, h, w)
    comps = grid.components(df, grid.SQUARE, rounds(spark))
    groups = {}
    for p in comps.collect():
        groups.setdefault(p.comp, set()).add((p.y, p.x))
    left, want = set(cells), []
    while left:
        todo, got = [min(left)], set()
        while todo:
            c = todo.pop()
            if c in left:
                left.discard(c)
                got.add(c)
                todo += [(c[0] + dy, c[1] + dx) for dy, dx in grid.SQUARE]
        want.append(got)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
    assert all(k == min(y * (1 << 20) + x for y, x in v) for k, v in groups.items())
    table = geometry.component_table(comps.join(df, ["y", "x"])).collect()
    assert sum(t.n_pixels for t in table) == len(cells)
    best = max((y1 - y0 + 1) * (x1 - x0 + 1) for y0, x0 in cells for y1 in range(y0, h) for x1 in range(x0, w) if all((y, x) in cells for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)))
    assert grid.largest_rectangle(df).first().area == best


def test_bounded_distance(spark):
    h, w, reach = 12, 12, 4
    bad = {(3, 4), (8, 9)}
    df = spark.createDataFrame([(y, x, (y, x) not in bad) for y in range(h) for x in range(w)], "y int, x int, ok boolean")
    for p in grid.bounded_distance(df, "ok", reach, h, w).collect():
        around = [math.dist((p.y, p.x), (y, x)) for y in range(-reach, h + reach) for x in range(-reach, w + reach) if not (0 <= y < h and 0 <= x < w) or (y, x) in bad]
        assert (p.d if p.d is not None else None) == (min(around) if min(around) <= reach else None)


def test_world_system_round_trip(spark):
    wcs = {"crval1": 359.9, "crval2": 88.0, "crpix1": 50.5, "crpix2": 40.5, "cd11": -0.0017, "cd12": 0.0001, "cd21": 0.0001, "cd22": 0.0017}
    df = spark.createDataFrame([(float(x), float(y)) for x in range(0, 100, 9) for y in range(0, 80, 9)], "x double, y double")
    ra, dec = sky.tan_to_sky("x", "y", wcs)
    back = df.select("x", "y", ra.alias("ra"), dec.alias("dec")).select("x", "y", *[c.alias(n) for c, n in zip(sky.tan_to_pixel("ra", "dec", wcs), "uv", strict=True)])
    assert all(abs(p.x - p.u) < 1e-7 and abs(p.y - p.v) < 1e-7 for p in back.collect())


def test_text_expressions(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first().v
    assert v(text.designation(F.lit("(2010 HK)"))) == "2010 HK" and v(text.designation(F.lit("313052 (2000 RL52)"))) == "313052"
    assert abs(v(text.sexagesimal_degrees(F.lit("-42 10'20.1"))) + (42 + 10 / 60 + 20.1 / 3600)) < 1e-12
    assert abs(v(text.hours_to_degrees(F.lit("10:21:55.11"))) - 15 * (10 + 21 / 60 + 55.11 / 3600)) < 1e-9
    assert v(text.marker_label(F.lit("SX6M-007"))) == "#7" and v(text.version_of(F.lit("a/b"))) == ""
    assert v(text.object_prefix(F.lit("//a/b/"))) == "a/b/" and v(text.object_prefix(F.lit("/"))) == ""
