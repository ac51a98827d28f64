"""Queries against their SQL twins."""

import duckdb
import pandas as pd
import pytest

from tabscope.plans import catalogue

#: The tables for which the twins state what the inference rules say.
FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def shown(frame: pd.DataFrame) -> list:
    def cell(v):
        if pd.isna(v):
            return "missing"
        return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v if isinstance(v, str) else f"{float(v):.3f}"

    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if not n.startswith("time_buckets") or n.endswith("week_median")])
def test_query(spark, sql, name):
    found = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalogue.ORACLE_SQL:
        truth = sql.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(truth.columns)
        assert shown(found) == shown(truth)
    assert len(found)


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
