"""Neighbours by tiles against loops, and what is broadcast on the way."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from starloom import catalog
from starloom.operators import spatial, tiled
from starloom.plans import candidates, evidence, matching

DATA = Path("/root/testdata/sf0.01")
POSITIONS = "mutual_match best_chi2_match binned_scatter candidate_detail candidate_documents candidate_markers candidate_summary linker_tracks marker_semi_join mle_rayleigh motion_pairs nearest_sky position_calibration registration_shift sharpness_limit sky_band_join".split()


def parts(plan, what):
    """The subtrees of a plan below each line with ``what``."""
    lines = plan.split("\n")
    depth = [next((k for k, c in enumerate(x) if c not in " :+-*("), 0) for x in lines]
    for i, x in enumerate(lines):
        if what in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


@pytest.mark.skipif(not DATA.exists(), reason="needs the tables")
@pytest.mark.parametrize("name", POSITIONS)
def test_positions_in_several_cells_are_not_broadcast(spark, monkeypatch, name):
    """Spark takes a table for as small as before its rows went to 9 or 27 cells, and would send all of them through the driver."""
    for module in (candidates, evidence, matching):
        monkeypatch.setattr(module, "rounds", lambda spark: lambda df, name: df)
    if name == "candidate_detail":
        monkeypatch.setattr(candidates.documents, "detail", lambda docs, _: docs.withColumn("cutouts", F.array(F.struct(F.lit("a").alias("at"), F.lit("b").alias("image")))))
    plan = catalog.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    sent = [p for p in parts(plan, "BroadcastExchange") if "Generate explode" in p and "Aggregate" not in p and "MapInArrow" not in p]
    assert not sent, sent[0]


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(tiled, "PIECE", 50)
    monkeypatch.setattr(tiled, "ROWS", 40)


def test_plane_equals_loops(spark, small_pieces):
    r = random.Random(4)
    at = lambda n: [(i, r.choice("uv"), round(r.uniform(-60, 60) if i % 2 else r.gauss(5, 1), 1), round(r.gauss(0, 2), 1)) for i in range(n)]
    a, b = at(300), at(300)
    df = lambda rows: spark.createDataFrame([*rows, (-1, None, 5.0, 0.0), (-2, "u", float("nan"), 0.0), (-3, "u", None, 0.0)], "id bigint, k string, x double, y double")
    sep = lambda p, q: math.sqrt((q[2] - p[2]) ** 2 + (q[3] - p[3]) ** 2)
    got = sorted((x.a_id, x.b_id) for x in spatial.pairs(df(a), df(b), 1.5, keys=["k"]).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and sep(p, q) <= 1.5)
    best = lambda p, rows: min((sep(p, q), q[0]) for q in rows)
    want = sorted((p[0], best(p, b)[1]) for p in a if best(p, b)[0] <= 1.5 and best(b[best(p, b)[1]], a)[1] == p[0])
    none = lambda rows: df(rows).where("k is not null and id >= 0").drop("k")
    assert sorted((x.a_id, x.b_id) for x in spatial.mutual_matches(none(a), none(b), 1.5).collect()) == want


def test_nearest_on_the_sky_equals_all_pairs(spark, small_pieces):
    r = random.Random(5)
    at = lambda n: [(i, (r.gauss(0, 0.01) if i % 3 else r.uniform(0, 360)) % 360, r.gauss(0, 0.01) if i % 2 else 89.99 + r.uniform(0, 0.01)) for i in range(n)]
    a, b = (spark.createDataFrame([*rows, *[(i + 1000, ra, dec) for i, ra, dec in rows[:20]]], "id bigint, ra double, dec double") for rows in (at(200), at(200)))
    everything = spatial.sky_pairs(a, b, 60.0)
    ids = lambda df: sorted((x.a_id, x.b_id) for x in df.collect())
    assert ids(spatial.sky_nearest(a, b, 60.0)) == ids(spatial.nearest(everything)) != []
    assert ids(spatial.sky_mutual(a, b, 60.0)) == ids(spatial.mutual(everything)) != []


def test_counts_send_neither_arrays_nor_pairs(spark):
    """Each position goes to its tile and to those that its reach enters: arrays of neighbours aren't sent from cell to cell."""
    df = spark.range(4000).selectExpr("id", "150 + id % 61 / 500.0D as ra", "id % 67 / 500.0D as dec", "if(id % 2 = 0, 'A', 'B') as epoch")
    kept = []
    out = spatial.sky_counts(df, 120.0, "epoch", lambda t, name: (kept.append(t), t)[1])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and not any(kind.startswith("array") for t in kept for _, kind in t.dtypes)
    met = [p for p in parts(plan, "Exchange") if "hashpartitioning" in p]
    assert len(met) == 1 and out.count() == 8 * 500
