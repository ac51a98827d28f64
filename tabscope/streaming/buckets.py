"""Calendar buckets over a stream, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.values import finite
from tabscope.operators.temporal import bucket

#: Length, step and start of each bucket's window; the epoch's first Monday is its fifth day.
WINDOWS = {"hour": ("1 hour",), "day": ("1 day",), "week": ("7 days", "7 days", "4 days")}
AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def streaming_buckets(stream: DataFrame, timestamp: str, value: str, frequency: str = "hour", aggregation: str = "mean", late: str = "1 day") -> DataFrame:
    """bucket, value and count, as they change; hours, days and weeks older than the watermark are dropped.

    Months have no fixed length and so no watermark: their state, one row for each, stays,
    and append mode refuses them.  Medians need all values of a bucket and are left to the
    batch operator.
    """
    if aggregation not in AGGREGATES:
        raise ValueError(f"Unsupported streaming aggregation: {aggregation!r}.")
    rows = stream.withColumn("__at", F.col(timestamp).cast("timestamp")).withWatermark("__at", late)
    x = finite(rows, value)
    own = rows.where(x.isNotNull())
    if frequency in WINDOWS:
        start = F.window("__at", *WINDOWS[frequency])
        found = own.groupBy(start).agg(AGGREGATES[aggregation](x).alias("value"), F.count(x).alias("count"))
        return found.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "value", "count")
    found = own.groupBy(bucket(F.col("__at"), frequency).alias("bucket"))
    return found.agg(AGGREGATES[aggregation](x).alias("value"), F.count(x).alias("count"))
