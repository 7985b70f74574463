import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from starloom import catalog

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_corpus_package(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries() if q[2:3].isdigit()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "False"], out.stderr


def plain(value):
    """A value as both engines may give it: rounded, without NaN, lists as tuples."""
    if value is None or isinstance(value, float) and value != value:
        return None
    if isinstance(value, bool | str):
        return value
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if hasattr(value, "__float__"):
        return round(float(value), 5)
    return None if str(value) == "NaT" or str(value) == "<NA>" else str(value)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA / t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    mine = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    sql = con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)), key=repr)
    assert rows(mine) == rows(sql)
