import numpy as np
import pytest

from starloom.operators import grid, robust
from starloom.plans.scratch import rounds


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    rows = [(int(k), float(v)) for k, v in zip(r.integers(0, 3, 4000), np.round(r.exponential(size=4000), 2), strict=True)]
    rows += [(1, 0.5)] * 3000 + [(2, None), (7, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    got = {x.k: (x.low, x.mid, x.high) for x in robust.quantiles(df, ["k"], "v", {"low": 0.01, "mid": 0.5, "high": 0.99}).collect()}
    for k in (0, 1, 2, 7):
        v = [x for i, x in rows if i == k and x is not None]
        assert np.allclose(got[k], np.quantile(v, [0.01, 0.5, 0.99]))
    whole = robust.quantiles(df, [], "v", {"mid": 0.5}).first()[0]
    assert whole == pytest.approx(np.median([x for _, x in rows if x is not None]))
    assert robust.quantiles(df.where("k = 99"), ["k"], "v", {"mid": 0.5}).count() == 0


def test_ranks_equal_a_sort(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), int(i) % 2, float(v)) for i, v in enumerate(r.integers(0, 50, 2000))]
    got = robust.ranked(spark.createDataFrame(rows, "id int, k int, v double").repartition(5), ["k"], ["v", "id"]).collect()
    for k in (0, 1):
        order = [i for i, g, v in sorted(rows, key=lambda x: (x[2], x[0])) if g == k]
        assert {x.id: x["rank"] for x in got if x.k == k} == {i: n for n, i in enumerate(order)}
        assert all(x.n == 1000 for x in got if x.k == k)


def by_hand(pixels, offsets):
    left, out = set(pixels), {}
    while left:
        todo, part = [left.pop()], set()
        while todo:
            p = todo.pop()
            part.add(p)
            for dy, dx in offsets:
                q = (p[0] + dy, p[1] + dx)
                if q in left:
                    left.remove(q)
                    todo.append(q)
        least = min(y * (1 << 20) + x for y, x in part)
        out |= {p: least for p in part}
    return out


@pytest.mark.parametrize("offsets", [grid.SQUARE, grid.PLUS])
@pytest.mark.parametrize("size", [4, 256])
def test_components_across_tiles(spark, offsets, size):
    r = np.random.default_rng(3)
    pixels = [(int(y), int(x)) for y, x in np.argwhere(r.random((30, 26)) < 0.55)]
    snake = [(40, x) for x in range(30)] + [(y, 29) for y in range(41, 60)] + [(59, x) for x in range(29)]
    df = spark.createDataFrame([*pixels, *snake], "y int, x int")
    got = {(p.y, p.x): p.comp for p in grid.components(df, offsets, rounds(spark), size).collect()}
    assert got == by_hand([*pixels, *snake], offsets)


def test_chains_of_labels_end(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201)], "a bigint, b bigint")
    got = {x.node: x.comp for x in grid.connected(links, rounds(spark)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


@pytest.mark.parametrize("seed", range(3))
def test_largest_rectangle_by_hand(spark, seed):
    r = np.random.default_rng(seed)
    mask = r.random((12, 14)) < 0.75
    best = None
    for y0 in range(12):
        for x0 in range(14):
            for y1 in range(y0, 12):
                for x1 in range(x0, 14):
                    if mask[y0 : y1 + 1, x0 : x1 + 1].all():
                        key = (-(y1 - y0 + 1) * (x1 - x0 + 1), y0, x0, y1, x1)
                        best = key if best is None else min(best, key)
    got = grid.largest_rectangle(spark.createDataFrame([(int(y), int(x)) for y, x in np.argwhere(mask)], "y int, x int")).first()
    assert (got.y0, got.x0, got.y1, got.x1, got.area) == (*best[1:], -best[0])


def test_likelihood_finds_the_width(spark):
    r = np.random.default_rng(4)
    sep = np.concatenate((0.5 * np.sqrt(r.normal(size=3000) ** 2 + r.normal(size=3000) ** 2), 3 * np.sqrt(r.random(300))))
    df = spark.createDataFrame([(float(s),) for s in sep[sep < 3]], "sep double").repartition(3)
    best = robust.rayleigh_likelihood(df, "sep", 3.0, [0.1 + 0.01 * i for i in range(100)], [0.5 + 0.05 * i for i in range(10)]).first()
    assert abs(best.sigma - 0.5) < 0.03 and best.share >= 0.8
