import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, f"{ROOT}/tests", os.environ.get("PYTHONPATH")]))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from quirefold.session import session

    s = session("local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="6g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Hold a query's rows against its SQL on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")

    def check(run, sql):
        df = run(spark, DATA)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        found = con.sql(sql)
        assert sorted(found.columns) == columns
        want = found.project(", ".join(f'"{c}"' for c in columns)).fetchall()
        assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)
        spark.catalog.clearCache()

    return check
