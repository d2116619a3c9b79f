import os

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
    session = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def cells(rows, columns):
    """Rows as sorted tuples of text, floats rounded, so that engines compare."""
    text = lambda v: str(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[c]) for c in columns) for r in rows)


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    names = relation.columns
    assert cells([r.asDict() for r in df.collect()], columns) == cells([dict(zip(names, r)) for r in relation.fetchall()], columns)
