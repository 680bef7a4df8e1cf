import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    import decimal
    import math

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "NaN" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


@pytest.fixture(scope="session")
def same_as_duckdb(spark):
    """Compare a query with its SQL form on one folder of tables."""
    import duckdb

    def check(query, sql, folder=SMALL):
        db = duckdb.connect()
        for name in os.listdir(folder):
            db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
        df = query(spark, folder)
        found = [tuple(_plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()]
        cursor = db.execute(sql)
        names = [d[0] for d in cursor.description]
        at = sorted(range(len(names)), key=names.__getitem__)
        wanted = [tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()]
        assert sorted(df.columns) == sorted(names)
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(found, key=key) == sorted(wanted, key=key)
        return found

    return check
