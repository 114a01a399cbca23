import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from driftline.session import session

    s = session(app="tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(df, con, sql):
    """Rows of a Spark result and of SQL, columns by name, as sorted tuples."""
    rows = con.execute(sql)
    names = [c[0] for c in rows.description]
    want = rows.fetchall()
    assert sorted(names) == sorted(df.columns)
    by = sorted(range(len(names)), key=lambda i: names[i])
    mine = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    a = sorted(tuple(repr(r[i]) for i in mine) for r in df.collect())
    b = sorted(tuple(repr(r[i]) for i in by) for r in want)
    assert a == b
