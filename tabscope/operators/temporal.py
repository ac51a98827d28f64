"""Time: an axis of timestamps, its sampling and gaps, series and calendar buckets."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.formats import day_micros, micros, parsed
from tabscope.functions.selection import ACCURACY, CELLS, quantiles, with_medians, with_place
from tabscope.functions.values import ORDINAL, family_of, finite, quoted, require_column, require_number, with_ordinal
from tabscope.operators.records import (
    TemporalAggregation,
    TemporalAggregationResult,
    TemporalAxis,
    TemporalFrequency,
    TemporalGapSummary,
    TemporalNumericSeries,
    TemporalSamplingSummary,
)

EPOCH = datetime(1970, 1, 1)
DAY = 86_400_000_000
# The units of duration texts, in microseconds.
UNITS = {
    "us": 1, "ms": 1000, "s": 10**6, "sec": 10**6, "second": 10**6, "seconds": 10**6, "min": 60 * 10**6, "m": 60 * 10**6,
    "t": 60 * 10**6, "minute": 60 * 10**6, "minutes": 60 * 10**6, "h": 3600 * 10**6, "hr": 3600 * 10**6, "hour": 3600 * 10**6,
    "hours": 3600 * 10**6, "d": DAY, "day": DAY, "days": DAY, "w": 7 * DAY, "week": 7 * DAY, "weeks": 7 * DAY,
}


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def date_value(df: DataFrame, column: str, form: str | None) -> Column:
    if family_of(df, column) == "time":
        return quoted(column).cast("timestamp_ntz")
    if form is None:
        raise ValueError("date_format is required for non-datetime date columns.")
    return parsed(quoted(column).cast("string"), form)


def time_value(df: DataFrame, column: str, form: str | None) -> Column:
    """Microseconds since midnight."""
    if family_of(df, column) == "time":
        return day_micros(quoted(column).cast("timestamp_ntz"))
    if form is None:
        raise ValueError("time_format is required for non-datetime time columns.")
    return day_micros(parsed(quoted(column).cast("string"), form))


def axis_frame(df: DataFrame, date_column: str, date_format: str | None = None, time_column: str | None = None, time_format: str | None = None) -> DataFrame:
    """``df`` with ``timestamp``, null where it doesn't parse, and the order of its rows."""
    at = date_value(df, date_column, date_format)
    if time_column is not None:
        day = micros(at) - day_micros(at)
        at = from_micros(day + time_value(df, time_column, time_format))
    return with_ordinal(df).withColumn("timestamp", at)


def prepare_temporal_axis(df: DataFrame, date_column: str, *, date_format=None, time_column=None, time_format=None) -> TemporalAxis:
    require_column(df, date_column)
    if time_column is not None:
        require_column(df, time_column)
        if time_column == date_column:
            raise ValueError("Date and time columns must be different.")
    data = axis_frame(df, date_column, date_format, time_column, time_format)
    total, valid = data.agg(F.count(F.lit(1)), F.count("timestamp")).first()
    return TemporalAxis(date_column, time_column, total, valid, total - valid, data)


def counts_frame(axis: DataFrame) -> DataFrame:
    """(at, n): how many rows have each timestamp, in microseconds, those without one among them."""
    return axis.groupBy(micros(F.col("timestamp")).alias("at")).agg(F.count(F.lit(1)).alias("n"))


def distinct_frame(axis: DataFrame) -> DataFrame:
    return axis.where("timestamp is not null").select(micros(F.col("timestamp")).alias("at")).distinct()


def placed_frame(axis: DataFrame) -> DataFrame:
    """(at, day, cell): the distinct timestamps in microseconds, with the stretch that each is in."""
    return placed_of(distinct_frame(axis))


def placed_of(distinct: DataFrame) -> DataFrame:
    grid = [k / CELLS for k in range(1, CELLS)]
    bounds = distinct.agg(F.array_distinct(F.percentile_approx("at", grid, ACCURACY)).alias("edges"))  # one row
    placed = with_place(distinct.join(F.broadcast(bounds)), "at", "edges", "cell")
    return placed.select("at", F.floor(F.col("at") / DAY).alias("day"), "cell")


def steps_frame(axis: DataFrame) -> DataFrame:
    """Consecutive distinct timestamps with the microseconds between: start, end, duration.

    Timestamps are dealt out to stretches, by day and, within crowded days, between
    approximate quantiles of all of them; so a table of a single day makes many stretches
    too.  A stretch's last is joined to the first of the next that has any, so no task sorts
    them all; one row for each stretch is ordered.
    """
    return steps_of(distinct_frame(axis))


def steps_of(distinct: DataFrame) -> DataFrame:
    """As ``steps_frame``, of distinct timestamps in microseconds."""
    dealt = placed_of(distinct)
    inner = dealt.withColumn("end", F.lead("at").over(Window.partitionBy("day", "cell").orderBy("at")))
    edges = dealt.groupBy("day", "cell").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    across = edges.withColumn("next", F.lead("first").over(Window.orderBy("day", "cell"))).select(F.col("last").alias("at"), F.col("next").alias("end"))
    steps = inner.select("at", "end").where("end is not null").unionByName(across.where("end is not null"))
    return steps.select(from_micros(F.col("at")).alias("start"), from_micros(F.col("end")).alias("end"), (F.col("end") - F.col("at")).alias("duration"))


def durations_frame(steps: DataFrame) -> DataFrame:
    """(duration, w): how often each step occurs."""
    return steps.groupBy("duration").agg(F.count(F.lit(1)).alias("w"))


def sampling_frame(axis: DataFrame) -> DataFrame:
    """One row: counts, bounds, and the least, median and greatest step in microseconds."""
    return sampling_of(counts_frame(axis), durations_frame(steps_frame(axis)))


def sampling_of(counts: DataFrame, durations: DataFrame) -> DataFrame:
    known = F.col("at").isNotNull()
    one = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("valid_count"),
        F.count("at").alias("unique_timestamp_count"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("duplicate_row_count"),
        F.count_if(known & (F.col("n") > 1)).alias("duplicate_timestamp_count"),
        F.min("at").alias("earliest"),
        F.max("at").alias("latest"),
    )
    middle = quantiles(durations, [], "duration", (0.5,), "w").select(F.col("q")[0].alias("median_interval"))
    own = durations.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("interval_count"), F.min("duration").alias("minimum_interval"), F.max("duration").alias("maximum_interval")
    ).join(F.broadcast(middle))  # one row
    return one.join(F.broadcast(own.select("interval_count", "minimum_interval", "median_interval", "maximum_interval")))  # one row


def dominant_frame(axis: DataFrame) -> DataFrame:
    """The most frequent step (microseconds) if no other is as frequent, and its count."""
    return dominant_of(durations_frame(steps_frame(axis)))


def dominant_of(durations: DataFrame) -> DataFrame:
    best = durations.groupBy(F.col("w").alias("n")).agg(F.count(F.lit(1)).alias("tied"), F.min("duration").alias("duration"))
    most = best.agg(F.max(F.struct("n", "tied", "duration")).alias("b")).select("b.*")
    return most.where("tied = 1").select(F.col("duration").alias("dominant_interval"), F.col("n").alias("dominant_interval_count"))


def is_sorted(axis: DataFrame) -> bool:
    """Whether timestamps never step back in source order: within stretches of it, and from one to the next."""
    rows = axis.where("timestamp is not null").select(F.col(ORDINAL).alias("o"), micros(F.col("timestamp")).alias("at"), F.shiftright(ORDINAL, 16).alias("part"))
    before = F.lag("at").over(Window.partitionBy("part").orderBy("o"))
    parts = (
        rows.withColumn("back", before > F.col("at"))
        .groupBy("part")
        .agg(F.max(F.coalesce("back", F.lit(False))).alias("back"), F.min_by("at", "o").alias("first"), F.max_by("at", "o").alias("last"))
    )
    across = parts.withColumn("back", F.col("back") | F.coalesce(F.lag("last").over(Window.orderBy("part")) > F.col("first"), F.lit(False)))
    return not across.agg(F.coalesce(F.max("back"), F.lit(False))).first()[0]


def span_of(value: float | None) -> timedelta | None:
    return None if value is None else timedelta(microseconds=value)


def analyze_temporal_sampling(temporal: TemporalAxis) -> TemporalSamplingSummary:
    counts = counts_frame(temporal.data).persist()
    durations = durations_frame(steps_of(counts.where("at is not null").select("at"))).persist()
    r, best = sampling_of(counts, durations).first(), dominant_of(durations).first()
    durations.unpersist()
    counts.unpersist()
    at = lambda x: None if x is None else EPOCH + timedelta(microseconds=x)
    n, low, high = r["interval_count"], r["earliest"], r["latest"]
    return TemporalSamplingSummary(
        r["total_count"], r["valid_count"], r["total_count"] - r["valid_count"], r["unique_timestamp_count"],
        r["duplicate_row_count"], r["duplicate_timestamp_count"], is_sorted(temporal.data), at(low), at(high),
        None if low is None else timedelta(microseconds=high - low), n, span_of(r["minimum_interval"]), span_of(r["median_interval"]),
        span_of(r["maximum_interval"]), span_of(best["dominant_interval"]) if best else None,
        best["dominant_interval_count"] if best else 0, best["dominant_interval_count"] / n if best else None,
    )


def interval_of(value: object) -> timedelta:
    if isinstance(value, timedelta):
        out = value
    elif isinstance(value, str):
        parts = re.findall(r"(\d+(?:\.\d+)?|(?=[A-Za-z]))\s*([A-Za-z]+)", value.strip())
        rest = re.sub(r"(\d+(?:\.\d+)?)?\s*[A-Za-z]+\s*", "", value.strip())
        if not parts or rest or any(u.lower() not in UNITS for _, u in parts):
            raise ValueError("expected_interval is not a valid duration.")
        out = timedelta(microseconds=sum(float(n or 1) * UNITS[u.lower()] for n, u in parts))
    else:
        raise TypeError("expected_interval must be a timedelta or duration string.")
    if out <= timedelta(0):
        raise ValueError("expected_interval must be greater than zero.")
    return out


def gaps_frame(axis: DataFrame, expected: timedelta) -> DataFrame:
    """Steps longer than expected: start, end, duration and excess in microseconds."""
    limit = expected // timedelta(microseconds=1)
    return steps_frame(axis).where(F.col("duration") > limit).withColumn("excess", F.col("duration") - limit)


def detect_time_gaps(temporal: TemporalAxis, expected_interval: object) -> TemporalGapSummary:
    expected = interval_of(expected_interval)
    found = gaps_frame(temporal.data, expected)
    unique = temporal.data.agg(F.count_distinct("timestamp")).first()[0]
    return TemporalGapSummary(expected, unique, found.count(), found)


def series_frame(axis: DataFrame, value: str) -> DataFrame:
    """timestamp, value and source order of the rows that have both, sorted by time."""
    rows = axis.select(ORDINAL, "timestamp", finite(axis, value).alias("value"))
    return rows.where("timestamp is not null and value is not null").orderBy("timestamp", ORDINAL)


def prepare_temporal_numeric_series(temporal: TemporalAxis, value_column: str) -> TemporalNumericSeries:
    require_number(temporal.data, value_column)
    data = series_frame(temporal.data, value_column)
    total, valid = temporal.data.count(), data.count()
    return TemporalNumericSeries(value_column, total, valid, total - valid, data)


def choice(value: object, kind: type, name: str):
    if not isinstance(value, str):
        raise TypeError(f"{name} must be a string or {kind.__name__}.")
    try:
        return kind(value.lower())
    except ValueError:
        raise ValueError(f"Unsupported temporal {name}: {value!r}.") from None


def bucket(ts: Column, frequency: str) -> Column:
    """Start of the hour, day, week (Monday) or month."""
    return F.date_trunc(frequency, ts).cast("timestamp_ntz")


def buckets_frame(axis: DataFrame, value: str, frequency: str, aggregation: str) -> DataFrame:
    """bucket, value and count; buckets without rows don't appear."""
    x = finite(axis, value)
    rows = axis.select(bucket(F.col("timestamp"), frequency).alias("bucket"), x.alias("x")).where("bucket is not null and x is not null")
    if aggregation == "median":
        found = with_medians(rows.groupBy("bucket").agg(F.count("x").alias("count")), rows, ["bucket"], "x", "value")
        return found.select("bucket", "value", "count")
    how = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[aggregation]
    return rows.groupBy("bucket").agg(how("x").alias("value"), F.count("x").alias("count"))


def aggregate_temporal_numeric_series(
    temporal: TemporalAxis, value_column: str, *, frequency="day", aggregation="mean"
) -> TemporalAggregationResult:
    often, how = choice(frequency, TemporalFrequency, "frequency"), choice(aggregation, TemporalAggregation, "aggregation")
    series = prepare_temporal_numeric_series(temporal, value_column)
    data = buckets_frame(temporal.data, value_column, often, how).orderBy("bucket")
    return TemporalAggregationResult(
        value_column, often, how, series.total_count, series.valid_count, series.excluded_count, data.count(), data
    )
