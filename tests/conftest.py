import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def agree(spark, sf_dir):
    """Compare a query with its SQL on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def plain(v):
        return None if v is None or v != v else int(v) if isinstance(v, float) and v.is_integer() else v

    def rows(frame):
        names = sorted(frame.columns)
        return names, sorted(repr([plain(v) for v in r]) for r in frame[names].astype(object).where(frame[names].notna(), None).values.tolist())

    def check(f, sql):
        got, want = rows(f(spark, sf_dir).toPandas()), rows(con.execute(sql).fetchdf())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return check
