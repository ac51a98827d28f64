"""Distinct counts of all columns at once."""

import math

from pyspark.sql import functions as F

from tabscope.operators import schema


def test_odd_values(spark):
    rows = [(0.0, 1, "a", None), (-0.0, 2**60, "A", None), (math.nan, 2**60 + 1, "", None), (math.inf, None, None, None), (-math.inf, 1, "a", None), (2.5, 2, "b", None)]
    data = spark.createDataFrame(rows, "x double, n long, t string, void string").withColumn("d", F.col("n").cast("decimal(30,2)"))
    r = schema.column_statistics(data).first()
    assert [r[f"u_{k}"] for k in range(5)] == [4, 4, 4, 0, 4]
    assert (r["d_0"], r["d_1"], r["d_4"]) == (2, 3, 3)  # as doubles
    assert [r[f"n_{k}"] for k in range(5)] == [5, 5, 5, 0, 5]


def test_against_sets(spark):
    data = spark.range(5000).select(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10 ** (k + 1))).alias(f"c{k}") for k in range(4)], F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    r = schema.column_statistics(data).first()
    rows = data.collect()
    assert [r[f"u_{k}"] for k in range(5)] == [len({x[k] for x in rows} - {None}) for k in range(5)]
    plan = schema.column_statistics(data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_no_columns_and_no_rows(spark):
    none = spark.createDataFrame([], "x double, t string")
    r = schema.column_statistics(none).first()
    assert (r["rows"], r["u_0"], r["u_1"], r["d_0"]) == (0, 0, 0, 0)
