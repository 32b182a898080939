import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    top = tempfile.mkdtemp(prefix="spark-")
    conf = {
        "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.local.dir": top, "spark.checkpoint.dir": f"file://{top}/shared",
        "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(tables):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(tables).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def plain(rows):
    """Rows of values that compare across engines: integers of any kind alike, null as None."""

    def value(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, (bytes, bytearray, memoryview)):
            return bytes(v)
        try:
            return int(v) if v == int(v) and not isinstance(v, str) else float(v)
        except (TypeError, ValueError):
            return str(v)

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, tables, duck):
    """Asserts that a query and its SQL give the same rows."""

    def check(query, sql):
        df = query(spark, tables)
        cols = sorted(df.columns)
        want = duck.sql(sql)
        assert sorted(want.columns) == cols
        got = plain(tuple(r) for r in df.select(*cols).collect())
        assert got == plain(want.select(*[f'"{c}"' for c in cols]).fetchall())

    return check
