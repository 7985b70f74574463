"""Numbers longer than the digits that a name shows."""

from pathlib import Path

import pytest

from starloom import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the tables")
def test_objects_whose_names_are_cut_alike_stay_apart(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    # 1,000,002 is shown as 100000, which the store holds
    con.execute(f"create table part as select * replace (k as p_partkey) from (select * from '{DATA}/part.parquet' limit 1), (select unnest([100000, 1000002, 7]) as k)")
    con.execute(f"copy part to '{tmp_path}/part.parquet'")
    mine = catalog.QUERIES["manifest_missing"](spark, str(tmp_path)).select("key", "size")
    want = con.execute(f"select key, size from ({catalog.ORACLE_SQL['manifest_missing']})").fetchall()
    assert sorted(map(tuple, mine.collect())) == sorted(want) and len(want) == 2
