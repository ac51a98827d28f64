"""Exploration: missing values, distributions, outliers, frequencies and pairs."""

from __future__ import annotations

from functools import reduce
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.selection import QUARTILES, quantiles
from tabscope.functions.values import (
    data_columns,
    finite,
    is_count,
    is_infinite,
    is_missing,
    require_column,
    require_number,
    with_ordinal,
    ORDINAL,
)
from tabscope.operators.records import (
    CategoricalFrequencySummary,
    CategoryFrequency,
    ColumnMissingness,
    HistogramBin,
    NumericDistribution,
    NumericOutlierSummary,
    NumericPairData,
)
from tabscope.operators.schema import countable


def missingness_frame(df: DataFrame) -> DataFrame:
    """Missing count and ratio of each column, with its position."""
    columns = data_columns(df)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(is_missing(df, c)).alias(f"m_{k}") for k, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(c).alias("column"), F.col(f"m_{k}").alias("missing_count")) for k, c in enumerate(columns)]))
    ratio = F.when(F.col("rows") > 0, F.col("missing_count") / F.col("rows")).otherwise(0.0)
    return one.select("rows", rows.alias("r")).select("rows", "r.*").withColumn("missing_ratio", ratio).drop("rows")


def summarize_missingness(df: DataFrame) -> tuple[ColumnMissingness, ...]:
    rows = sorted(missingness_frame(df).collect(), key=lambda r: r["position"])
    return tuple(ColumnMissingness(r["column"], r["missing_count"], r["missing_ratio"]) for r in rows)


def missingness_ranking(df: DataFrame) -> DataFrame:
    """Columns with missing values, most first."""
    return missingness_frame(df).where("missing_count > 0").orderBy(F.desc("missing_count"), "column")


def distribution_frame(df: DataFrame, column: str) -> DataFrame:
    """One row of counts, moments and exact quartiles."""
    x = finite(df, column)
    q = quantiles(df.select(x.alias("x")), [], "x", QUARTILES).select("q")
    own = df.agg(
        F.count(F.lit(1)).alias("total_count"), F.count(x).alias("valid_count"),
        F.count_if(is_missing(df, column)).alias("missing_count"),
        F.count_if(F.coalesce(is_infinite(df, column), F.lit(False))).alias("non_finite_count"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("standard_deviation"), F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
    )
    return own.join(F.broadcast(q)).select(  # one row each
        "total_count", "valid_count", "missing_count", "non_finite_count", "mean", "standard_deviation", "minimum",
        F.col("q")[0].alias("first_quartile"), F.col("q")[1].alias("median"), F.col("q")[2].alias("third_quartile"), "maximum",
    )


def histogram_frame(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal bins from least to greatest finite value, empty ones included.

    Bins hold their left edge, the last its right one as well; a single value gets a
    width of 1.  The place found by division is moved to where the edges say.
    """
    x = finite(df, column)
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("lo is not null")
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ends = ends.select((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    edge = lambda k: F.when(k >= bins, F.col("hi")).otherwise(F.col("lo") + k * step)
    near = F.least(F.floor((F.col("x") - F.col("lo")) / step), F.lit(bins - 1))
    placed = df.select(x.alias("x")).where("x is not null").join(F.broadcast(ends)).withColumn("near", near)  # one row
    moved = F.when(F.col("x") < edge(F.col("near")), F.col("near") - 1).when(
        (F.col("x") >= edge(F.col("near") + 1)) & (F.col("near") < bins - 1), F.col("near") + 1
    )
    counts = placed.groupBy(F.coalesce(moved, "near").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    k = F.col("bin")
    return every.join(counts, "bin", "left").select(
        "bin", edge(k).alias("left"), edge(k + 1).alias("right"), F.coalesce("count", F.lit(0)).alias("count")
    )


def summarize_numeric_distribution(df: DataFrame, column: str, *, bins: int = 20) -> NumericDistribution:
    require_number(df, column)
    if not is_count(bins, 1):
        raise ValueError("Histogram bins must be a positive integer.")
    own = distribution_frame(df, column).first()
    bars = sorted(histogram_frame(df, column, bins).collect(), key=lambda r: r["bin"])
    return NumericDistribution(column, *own, tuple(HistogramBin(r["left"], r["right"], r["count"]) for r in bars))


def outlier_frame(df: DataFrame, column: str, multiplier: float = 1.5) -> DataFrame:
    """One row: quartiles, Tukey's fences and the counts strictly beyond them."""
    x = finite(df, column)
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    quartiles = quantiles(df.select(x.alias("x")), [], "x", (0.25, 0.75)).withColumnRenamed("n", "valid_count")
    fences = total.join(F.broadcast(quartiles)).select("total_count", "valid_count", F.col("q")[0].alias("first_quartile"), F.col("q")[1].alias("third_quartile"))
    iqr = F.col("third_quartile") - F.col("first_quartile")
    fences = fences.withColumn("iqr", iqr).withColumn("lower_bound", F.col("first_quartile") - multiplier * F.col("iqr")).withColumn(
        "upper_bound", F.col("third_quartile") + multiplier * F.col("iqr")
    )
    counts = df.select(x.alias("x")).join(F.broadcast(fences.select("lower_bound", "upper_bound"))).agg(  # one row
        F.count_if(F.coalesce(F.col("x") < F.col("lower_bound"), F.lit(False))).alias("lower_outlier_count"),
        F.count_if(F.coalesce(F.col("x") > F.col("upper_bound"), F.lit(False))).alias("upper_outlier_count"),
    )
    both = F.col("lower_outlier_count") + F.col("upper_outlier_count")
    return fences.join(F.broadcast(counts)).withColumn("outlier_count", both).withColumn(
        "outlier_ratio", F.when(F.col("valid_count") > 0, F.col("outlier_count") / F.col("valid_count"))
    )


def summarize_numeric_outliers(df: DataFrame, column: str, *, multiplier: float = 1.5) -> NumericOutlierSummary:
    require_number(df, column)
    text = "IQR multiplier must be a positive finite number."
    if isinstance(multiplier, bool):
        raise TypeError(text)
    try:
        multiplier = float(multiplier)
    except (TypeError, ValueError):
        raise ValueError(text) from None
    if not isfinite(multiplier) or multiplier <= 0:
        raise ValueError(text)
    return NumericOutlierSummary(column, *outlier_frame(df, column, multiplier).first())


def frequency_frame(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """The most frequent values; of equally frequent ones those seen first, if the order is known."""
    tie = F.min(ORDINAL) if ORDINAL in df.columns else F.min("value")
    own = df.select(countable(df, column).alias("value"), *[c for c in (ORDINAL,) if c in df.columns])
    counts = own.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("count"), tie.alias("tie"))
    return counts.orderBy(F.desc("count"), F.asc("tie")).limit(top_n).drop("tie")


def frequencies_with_other(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """Value, count and ratio over all rows, and one row "Other categories" if there are more."""
    top = frequency_frame(df, column, top_n).withColumn("value", F.col("value").cast("string"))
    sums = df.agg(F.count(F.lit(1)).alias("rows"), F.count(countable(df, column)).alias("held"))
    shown = top.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("shown"))
    other = sums.join(F.broadcast(shown)).select(F.lit("Other categories").alias("value"), (F.col("held") - F.col("shown")).alias("count"))
    rows = top.unionByName(other.where("count > 0"))
    return rows.join(F.broadcast(sums.select("rows"))).select("value", "count", (F.col("count") / F.col("rows")).alias("ratio"))


def summarize_categorical_frequencies(df: DataFrame, column: str, *, top_n: int = 10) -> CategoricalFrequencySummary:
    require_column(df, column)
    if not is_count(top_n, 1):
        raise ValueError("top_n must be a positive integer.")
    value = countable(df, column)
    total, held, unique = df.agg(F.count(F.lit(1)), F.count(value), F.count_distinct(value)).first()
    share = lambda n: n / total if total else 0.0
    top = tuple(CategoryFrequency(r["value"], r["count"], share(r["count"])) for r in frequency_frame(df, column, top_n).collect())
    other = held - sum(c.count for c in top)
    return CategoricalFrequencySummary(column, total, held, total - held, unique, top, other, share(other))


def pair_frame(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows in which both numbers are finite, with their place in the source."""
    own = with_ordinal(df)
    return own.select(ORDINAL, finite(own, x).alias(x), finite(own, y).alias(y)).where(both_present(x, y))


def both_present(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])


def prepare_numeric_pair(df: DataFrame, x: str, y: str) -> NumericPairData:
    require_number(df, x)
    require_number(df, y)
    if x == y:
        raise ValueError("Numeric pair columns must be different.")
    data = pair_frame(df, x, y)
    total, valid = df.count(), data.count()
    return NumericPairData(x, y, total, valid, total - valid, data)
