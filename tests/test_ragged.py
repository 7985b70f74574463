"""A cube whose last line is unfinished: rows as the SQL gives them."""

from pathlib import Path

import pytest

from starloom import catalog

DATA = Path("/root/testdata/sf0.001")


def tables(root, first):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"copy (select * from '{DATA}/embeddings.parquet' where vec_id between {first} and 192) to '{root}/embeddings.parquet'")
    (root / "part.parquet").symlink_to(DATA / "part.parquet")
    for t in ("embeddings", "part"):
        con.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    return con, str(root)


@pytest.mark.skipif(not DATA.exists(), reason="needs the tables")
@pytest.mark.parametrize(("name", "first"), [("tile_manifest", 0), ("bundle_written", 0), ("bundle_written", 21), ("bundle_verified", 0), ("upload_planned", 0)])
def test_same_rows_as_sql(spark, tmp_path, name, first):
    con, root = tables(tmp_path, first)
    mine = catalog.QUERIES[name](spark, root)
    cols = ", ".join(f'"{c}"' for c in mine.columns)
    want = con.execute(f"select {cols} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, mine.collect())) == sorted(want)
