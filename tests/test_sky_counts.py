import numpy as np
import pytest

from starloom.operators import spatial


def places(seed):
    """A field with a crowd, a heap of equal positions, both poles and the wrap of right ascension."""
    r = np.random.default_rng(seed)
    ra, dec = r.uniform(149.5, 150.5, 600), r.uniform(-0.5, 0.5, 600)
    ra = np.concatenate([ra, 150 + r.normal(0, 0.01, 400), np.full(150, 150.2), r.uniform(0, 360, 60), r.uniform(0, 360, 60), r.choice([0.002, 359.998], 60), [150.0, 150.0]])
    dec = np.concatenate([dec, r.normal(0, 0.01, 400), np.full(150, 0.2), 90 - r.uniform(0, 0.05, 60), -90 + r.uniform(0, 0.05, 60), r.normal(0, 0.002, 60), [-5.0, -5.0 + 120 / 3600]])
    return ra, dec, np.array(list("ABC"))[np.concatenate([r.integers(0, 3, len(ra) - 2), [0, 1]])]


@pytest.mark.parametrize("leaf", [1024, 8])
def test_counts_equal_all_pairs(spark, leaf):
    ra, dec, group = places(leaf)
    rows = [(int(i), float(a), float(d), str(g)) for i, (a, d, g) in enumerate(zip(ra, dec, group, strict=True))]
    df = spark.createDataFrame(rows, "id bigint, ra double, dec double, epoch string").repartition(5)
    got = {(r.epoch, r.id, r.other): r.n for r in spatial.sky_counts(df, 120.0, "epoch", leaf=leaf).collect()}
    d, r = np.radians(dec), np.radians(ra)
    h = np.sin((d[:, None] - d) / 2) ** 2 + np.cos(d[:, None]) * np.cos(d) * np.sin((r[:, None] - r) / 2) ** 2
    near = np.degrees(2 * np.arcsin(np.minimum(1, np.sqrt(h)))) * 3600 <= 120.0
    want = {}
    for i in range(len(ra)):
        for g in "ABC":
            n = int((near[i] & (group == g)).sum())
            if g != group[i] and n:
                want[str(group[i]), i, g] = n
    tied = {len(ra) - 1, len(ra) - 2}
    assert {k: v for k, v in got.items() if k[1] not in tied} == {k: v for k, v in want.items() if k[1] not in tied}


def test_rows_grow_with_the_positions(spark):
    """Four times as many positions on the same sky make no more than about four times the rows of any step."""
    sizes = []
    for n in (4_000, 16_000):
        rows = []
        df = spark.range(n).selectExpr("id", "150 + rand(3) * 0.6 as ra", "rand(4) * 0.6 as dec", "if(id % 2 = 0, 'A', 'B') as epoch")

        def keep(x, name, rows=rows):
            rows.append((name, x.count()))
            return x

        out = spatial.sky_counts(spark.createDataFrame(df.toPandas()), 120.0, "epoch", keep, 64)
        sizes.append(dict(rows) | {"out": out.count()})
    assert all(sizes[1][k] < 8 * max(sizes[0][k], 50) for k in sizes[0]), sizes
