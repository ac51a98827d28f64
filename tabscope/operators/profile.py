"""Profiles: the schema, the quality report and a summary of each column."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.formats import day_micros, parsed
from tabscope.functions.selection import quantiles, with_medians
from tabscope.functions.values import data_columns, family_of, finite, kept_counts, quoted
from tabscope.operators.quality import quality_from
from tabscope.operators.records import (
    CategoricalSummary,
    ColumnProfile,
    ColumnSchema,
    DatasetProfile,
    DatasetSchema,
    DatetimeSummary,
    NumericSummary,
    SemanticType,
    TimeSummary,
)
from tabscope.operators.schema import column_statistics, countable, schema_from

NUMERIC = (SemanticType.NUMERIC_DISCRETE, SemanticType.NUMERIC_CONTINUOUS)
COUNTED = (SemanticType.IDENTIFIER, SemanticType.BINARY, SemanticType.CATEGORICAL, SemanticType.TEXT)


def numeric_frame(df: DataFrame, column: str) -> DataFrame:
    x = finite(df, column)
    own = df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("standard_deviation"),
        F.min(x).alias("minimum"), F.max(x).alias("maximum"),
    )
    both = with_medians(own, df.select(x.alias("x")), [], "x", "median")
    return both.select("count", "mean", "median", "standard_deviation", "minimum", "maximum")


def top_value_frame(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value and its count; of equally frequent ones the smallest."""
    own = df.select(countable(df, column).alias("value")).where("value is not null")
    return own.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("value")).limit(1)


def datetime_frame(df: DataFrame, column: str, form: str | None) -> DataFrame:
    ts = quoted(column).cast("timestamp_ntz") if family_of(df, column) == "time" else parsed(quoted(column), form)
    return df.agg(F.count(ts).alias("count"), F.min(ts).alias("earliest"), F.max(ts).alias("latest"))


def time_frame(df: DataFrame, column: str, form: str) -> DataFrame:
    """Bounds in microseconds since midnight."""
    at = day_micros(parsed(quoted(column), form))
    return df.agg(F.count(at).alias("count"), F.min(at).alias("earliest"), F.max(at).alias("latest"))


def numeric_summaries(df: DataFrame, columns: list[str], counts: DataFrame) -> dict[str, NumericSummary]:
    """What ``numeric_frame`` says of each column, from one scan and the counts of values; columns without finite values don't appear."""
    parts = [f(finite(df, c)) for c in columns for f in (F.count, F.avg, F.stddev_samp, F.min, F.max)]
    row = df.agg(*[p.alias(f"a{k}") for k, p in enumerate(parts)]).first()
    found = quantiles(counts.where(F.col("column").isin(columns)), ["column"], "x", (0.5,), "w").collect()  # a row for each column
    middle = {r["column"]: r["q"][0] for r in found}
    own = {c: row[5 * k : 5 * k + 5] for k, c in enumerate(columns)}
    return {c: NumericSummary(n, mean, middle[c], sd, low, high) for c, (n, mean, sd, low, high) in own.items() if n}


def top_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value and count of its most frequent value, the smallest of equals, for columns of one type at once."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), countable(df, c).alias("value")) for c in columns]))
    counts = df.select(cells.alias("v")).select("v.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("b"))
    return best.select("column", F.col("b.value").alias("value"), (-F.col("b.less")).alias("count"))


def summaries_of(df: DataFrame, schema: DatasetSchema, counts: DataFrame | None) -> tuple[dict[str, NumericSummary], dict[str, tuple]]:
    """Of number columns, and the top values of counted ones: a job for the numbers and one for each type of value."""
    numbers = [c.name for c in schema.columns if c.semantic_type in NUMERIC]
    found = numeric_summaries(df, numbers, counts) if numbers else {}
    by_type: dict[str, list[str]] = {}
    for c in schema.columns:
        if c.semantic_type in COUNTED:
            by_type.setdefault(df.select(countable(df, c.name)).schema[0].dataType.simpleString(), []).append(c.name)
    tops = {r["column"]: (r["value"], r["count"]) for names in by_type.values() for r in top_values(df, names).collect()}
    return found, tops


def column_profile(df: DataFrame, column: ColumnSchema, present: int, numbers: dict[str, NumericSummary], tops: dict[str, tuple]) -> ColumnProfile:
    kind, name, form = column.semantic_type, column.name, column.temporal_format
    if kind in NUMERIC:
        return ColumnProfile(column, numeric=numbers.get(name, NumericSummary(0, None, None, None, None, None)))
    if kind in COUNTED:
        return ColumnProfile(column, categorical=CategoricalSummary(present, column.unique_count, *tops.get(name, (None, None))))
    if kind == SemanticType.DATETIME:
        if family_of(df, name) != "time" and form is None:
            return ColumnProfile(column, datetime=DatetimeSummary(present, None, None))
        return ColumnProfile(column, datetime=DatetimeSummary(*datetime_frame(df, name, form).first()))
    if kind == SemanticType.TIME:
        if form is None:
            return ColumnProfile(column, time=TimeSummary(present, None, None))
        n, low, high = time_frame(df, name, form).first()
        clock = lambda x: None if x is None else (datetime(1970, 1, 1) + timedelta(microseconds=x)).time()
        return ColumnProfile(column, time=TimeSummary(n, clock(low), clock(high)))
    return ColumnProfile(column)


def profile_dataset(df: DataFrame) -> DatasetProfile:
    stats = column_statistics(df).first()
    schema = schema_from(df, stats)
    with kept_counts(df) as counts:
        quality = quality_from(df, stats, schema, counts, 0.40, 0.80, 20)
        found = summaries_of(df, schema, counts)
    columns = tuple(column_profile(df, c, stats[f"n_{k}"], *found) for k, c in enumerate(schema.columns))
    return DatasetProfile(schema.row_count, len(data_columns(df)), schema, quality, columns)


def compare_profiles(raw: DatasetProfile, working: DatasetProfile) -> dict[str, int]:
    """How the working table differs from the raw one."""
    return {
        "rows": working.row_count - raw.row_count,
        "columns": working.column_count - raw.column_count,
        "missing_cells": working.quality.missing_cell_count - raw.quality.missing_cell_count,
        "duplicate_rows": working.quality.duplicate_row_count - raw.quality.duplicate_row_count,
        "issues": working.quality.issue_count - raw.quality.issue_count,
    }
