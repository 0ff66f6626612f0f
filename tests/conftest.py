import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    """A value as both engines' results show it."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        value = round(value, 6) + 0.0
        return int(value) if value.is_integer() else value  # whole numbers beside nulls are floats in one of the frames
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.fixture
def same(spark, duck):
    def check(query, sql):
        got, want = rows_of(query(spark, SF).toPandas()), rows_of(duck.sql(sql).df())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert [x for x in zip(got[1], want[1]) if x[0] != x[1]][:3] == []

    return check
