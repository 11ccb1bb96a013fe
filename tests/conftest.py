import glob
import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from weirlog.session import local_session

    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


def rows_of(table):
    """Column names in order, and rows as sorted text."""
    names = sorted(table.column_names)
    return names, sorted(repr([r[c] for c in names]) for r in table.to_pylist())


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        assert rows_of(query(spark, SF).toArrow()) == rows_of(duck.sql(sql).to_arrow_table())

    return check
