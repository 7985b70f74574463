import math

import numpy as np
import pytest

from starloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, component string, x string, n string"


def by_hand(rows):
    """Exact integers in loops; the covariance and its eigenvectors from them."""
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(x) for _, x in ok]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    ok = [(i, x) for i, x in ok if len(x) == d]
    fit = sorted({tuple(x) for _, x in ok})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    v = np.array([[(n * sum(r[i] * r[j] for r in fit) - s[i] * s[j]) / n**2 for j in range(d)] for i in range(d)])
    return ok, n, s, v


@pytest.mark.parametrize("seed", range(4))
def test_scatter_is_exact(seed):
    r = np.random.default_rng(seed)
    for n, d, reach in ((1, 3, 5), (64, 5, 200), (129, 4, 1 << 40), (70, 3, (1 << 63) - 1), (40, 2, 0)):
        x = r.integers(-reach, reach, (n, d), dtype=np.int64, endpoint=True)
        got_n, sums, cross = whitening.scatter(x)
        plain = [[int(c) for c in row] for row in x]
        assert got_n == n and sums == [sum(c) for c in zip(*plain, strict=True)]
        assert cross == {(i, j): sum(row[i] * row[j] for row in plain) for i in range(d) for j in range(i, d)}
    for v in (0, 1, -1, 1 << 200, -(1 << 130) + 5):
        assert sum(x * (1 << 60) ** k for k, x in enumerate(whitening._digits(v))) == v


def odd_rows(seed=2, d=6):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d))
    rows = [(i, [float(c) for c in r.normal(size=d) @ mix * 0.3 + 0.1]) for i in range(300)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (900, None), (901, []), (902, [0.5] * (d - 1) + [None]), (903, [0.5] * (d - 1) + [math.nan]), (904, [math.inf] * d), (905, [1.0, 2.0]), (906, [0.0] * d), (907, [-0.0] * d)]
    return rows


def test_rows_equal_loops(spark):
    rows = odd_rows()
    ok, n, s, v = by_hand(rows)
    d = len(s)
    values, vectors = np.linalg.eigh(v)
    data = spark.createDataFrame([(i, e, 0, "c", "x", "n") for i, e in rows], SCHEMA).repartition(5)
    got = whitening.whitened(data).collect()
    assert len(got) == 4 * len(ok)
    want = {}
    for i, x in ok:
        want.setdefault(str(i), []).append((sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), np.array(x) - np.array(s) / n))
    seen = set()
    for k in range(4):
        axis, e = vectors[:, d - 1 - k], values[d - 1 - k]
        mine = sorted((str(g.vec_id), g.deviation, g.whitened) for g in got if g.component == k + 1)
        sign = None
        for (i, deviation, value), (j, wanted, centred) in zip(mine, sorted(((i, w, tuple(c)) for i, all_ in want.items() for w, c in all_), key=lambda t: (t[0], t[1])), strict=True):
            assert (i, deviation) == (j, wanted)
            plain = float(np.array(centred) @ axis / math.sqrt(e))
            if abs(plain) > 1e-6 and sign is None:
                sign = math.copysign(1, plain * value)
            assert abs(value - (sign or 1) * plain) < 1e-8
        seen |= {(g.n, round(g.explained - e / np.trace(v), 10)) for g in got if g.component == k + 1}
    assert seen == {(n, 0.0)}
    errors = {g.identity_error for g in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_partitions_change_nothing(spark):
    data = spark.createDataFrame([(i, e, 0, "c", "x", "n") for i, e in odd_rows()], SCHEMA)
    one, many = ({(g.vec_id, g.component, g.whitened, g.deviation) for g in whitening.whitened(data.repartition(k)).collect()} for k in (1, 9))
    assert one == many


def test_no_variance_wide_values_and_empty(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i], 0, "", "", "") for i in range(5)], SCHEMA)
    got = whitening.whitened(flat).collect()
    assert {g.component for g in got} == {1, 2, 3} and all((g.whitened is None) == (g.component > 1) for g in got)
    assert all(g.identity_error < 1e-9 for g in got) and abs(got[0].explained - 1) < 1e-12
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0, "", "", "")] * 3, SCHEMA)).collect()
    assert len(same) == 6 and all(g.n == 1 and g.deviation == 0 and g.whitened is None and g.explained is None and g.identity_error is None for g in same)
    wide = whitening.whitened(spark.createDataFrame([(1, [1e30, 0.0], 0, "", "", ""), (2, [-1e30, 1.0], 0, "", "", "")], SCHEMA)).collect()
    assert {g.deviation for g in wide} == {None} and all(abs(abs(g.whitened) - 1) < 1e-9 for g in wide if g.component == 1)
    for none in ([], [(1, None, 0, "", "", ""), (2, [], 0, "", "", "")]):
        assert whitening.whitened(spark.createDataFrame(none, SCHEMA)).count() == 0
