import os
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-tests-")
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    s = builder.config("spark.local.dir", folder).config("spark.checkpoint.dir", f"{folder}/shared").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Assert that a query's rows equal those of its SQL, as multisets, columns by name."""

    def plain(v):
        return None if v != v else round(v, 9) if isinstance(v, float) else v

    def check(f, sql):
        df = f(spark, DATA)
        names = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        rel = duck.sql(sql)
        assert sorted(rel.columns) == names
        order = [rel.columns.index(c) for c in names]
        want = sorted((tuple(plain(r[k]) for k in order) for r in rel.fetchall()), key=repr)
        assert got == want

    return check
