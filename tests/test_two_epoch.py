import numpy as np
import pytest

from starloom.operators import documents, imaging
from starloom.plans import two_epoch
from starloom.plans.cubes import WCS

H = W = 160
FWHM = 2.4


def star(img, x, y, flux):
    s = FWHM / imaging.SIGMA_OF_FWHM
    yy, xx = np.mgrid[0:H, 0:W]
    img += flux / (2 * np.pi * s * s) * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * s * s))


def field(seed):
    r = np.random.default_rng(seed)
    a, b = (10 + r.normal(0, 1, (H, W)) for _ in range(2))
    grid = [(x + r.uniform(-2, 2), y + r.uniform(-2, 2)) for x in range(16, 150, 16) for y in range(16, 150, 16)]
    # a centroid between two pixels would be vetoed
    grid[52] = (round(grid[52][0]) + 0.1, round(grid[52][1]) + 0.2)
    for k, (x, y) in enumerate(grid):
        flux = 200 + 40 * (k % 20)
        if k not in (11, 30, 52):
            star(a, x, y, flux)
            star(b, x, y, flux)
    star(a, *grid[11], 500)  # gone later
    star(b, *grid[30], 520)  # new later
    star(a, *grid[52], 600)  # moved by 1.8 pixels
    star(b, grid[52][0] + 1.8, grid[52][1], 600)
    a[100, 40] = np.nan
    return a, b


@pytest.fixture(scope="module")
def result(spark):
    rows = []
    for name, seed in (("f1", 1), ("f2", 2)):
        a, b = field(seed)
        rows += [(name, y, x, None if np.isnan(a[y, x]) else float(a[y, x]), float(b[y, x]), False, False) for y in range(H) for x in range(W)]
    px = spark.createDataFrame(rows, "field string, y int, x int, a double, b double, bad_a boolean, bad_b boolean")
    found, rejected = two_epoch.find_candidates(px, H, W)
    n = two_epoch.detections(px, H, W).groupBy("field", "epoch").count().collect()
    docs = documents.documented(found, WCS, 182.0, by=["field"]).collect()
    return found.collect(), rejected.collect(), {(r.field, r.epoch): r["count"] for r in n}, docs


def test_planted_changes_are_found_in_both_fields(result):
    found, _, _, _ = result
    for f in ("f1", "f2"):
        kinds = sorted(x.kind for x in found if x.field == f)
        assert kinds == ["matched_pair", "shifted_match"] or kinds == ["seen_only_earlier", "seen_only_later", "shifted_match"]


def test_every_detection_is_accounted_for(result):
    found, rejected, n, _ = result
    for f in ("f1", "f2"):
        pairs = sum(x.n for x in rejected if x.field == f and x.reason == "stationary")
        kept = sum((x.a_id is not None) + (x.b_id is not None) for x in found if x.field == f)
        assert pairs > 60
        assert 2 * pairs + kept <= n[f, "A"] + n[f, "B"]


def test_width_and_noise_are_measured():
    a, _ = field(3)
    a = np.nan_to_num(a, nan=10.0)
    back, noise = imaging.background(a)
    assert abs(np.median(back) - 10) < 0.2 and abs(np.median(noise) - 1) < 0.15
    assert abs(imaging.measured_fwhm(a - back) - FWHM) < 0.35


def test_smoothing_equals_the_plain_sum():
    r = np.random.default_rng(1)
    a = r.normal(size=(12, 15))
    s = 1.5 / imaging.SIGMA_OF_FWHM
    k = np.exp(-(np.add.outer(np.arange(-2, 3) ** 2, np.arange(-2, 3) ** 2)) / (2 * s * s))
    k /= k.sum()
    p = np.pad(a, 2)
    want = sum(k[dy, dx] * p[dy : dy + 12, dx : dx + 15] for dy in range(5) for dx in range(5))
    assert np.allclose(imaging.smooth(a, 1.5), want)


def test_documents_follow_from_pixels(result):
    """Numbers by field, kind and signal; positions, motion and direction of every candidate as its places give them."""
    found, _, _, docs = result
    assert len(docs) == len(found) and {d.field for d in docs} == {"f1", "f2"}
    kinds = list(documents.KINDS)
    for f in ("f1", "f2"):
        rows = sorted((x for x in found if x.field == f), key=lambda x: (kinds.index(x.kind), -max(v for v in (x.a_snr, x.b_snr) if v is not None)))
        mine = sorted((d for d in docs if d.field == f), key=lambda d: d.candidate_id)
        assert [d.candidate_id for d in mine] == [f"SX6M-{i:03d}" for i in range(1, len(rows) + 1)] and [d.kind for d in mine] == [r.kind for r in rows]
        for d, r in zip(mine, rows, strict=True):
            for side, e in (("earlier", "a"), ("later", "b")):
                place = getattr(r, f"{e}_x"), getattr(r, f"{e}_y")
                assert (d[side] is None) == (place[0] is None)
                assert d[side] is None or (abs(d[side].x - place[0]) <= 0.0051 and abs(d[side].y - place[1]) <= 0.0051 and d[side].snr > 5)
            if d.earlier and d.later:
                step = np.array([r.b_x - r.a_x, r.b_y - r.a_y]) * WCS["cd22"] * 3600
                assert abs(d.displacement - np.hypot(*step)) < 0.02 and abs(d.rate - np.hypot(*step) / 182) < 2e-4
                # x runs against the right ascension
                turn = (d.angle - np.degrees(np.arctan2(-step[0], step[1])) + 180) % 360 - 180
                assert abs(turn) < 1.0
    shifted = [d for d in docs if d.kind == "shifted_match"]
    assert shifted and all(abs(d.displacement - 1.8 * WCS["cd22"] * 3600) < 2.5 for d in shifted)
