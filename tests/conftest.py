import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(float(f"{v:.9g}") + 0.0)
    if isinstance(v, list):
        return [plain(x) for x in v]
    if hasattr(v, "tzinfo"):
        v = v.replace(tzinfo=None) if hasattr(v, "hour") else v
    return str(v)


def rows_of(table):
    cols = sorted(table.column_names)
    return sorted(tuple(map(str, map(plain, r))) for r in zip(*(table[c].to_pylist() for c in cols), strict=True))


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir, duck):
    """Check that a query and its SQL give the same columns and rows."""

    def check(query, sql):
        got, want = query(spark, sf_dir).toArrow(), duck.sql(sql).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows_of(got) == rows_of(want)

    return check
