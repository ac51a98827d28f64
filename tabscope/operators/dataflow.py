"""Small steps between the analyses: column choices, previews, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.ranks import STRETCHES
from tabscope.functions.values import ORDINAL, with_ordinal
from tabscope.operators.records import DatasetSchema, PivotCardinality, SemanticType
from tabscope.operators.schema import countable

#: Points of a chart, and the seed of its sample.
CHART_POINTS, SEED = 5_000, 42
NUMERIC = (SemanticType.NUMERIC_DISCRETE, SemanticType.NUMERIC_CONTINUOUS)
CATEGORICAL_LIKE = (SemanticType.CATEGORICAL, SemanticType.BINARY, SemanticType.NUMERIC_DISCRETE)


def columns_of(schema: DatasetSchema, *kinds: SemanticType) -> list[str]:
    return [c.name for c in schema.columns if c.semantic_type in kinds]


def numeric_columns(schema: DatasetSchema) -> list[str]:
    return columns_of(schema, *NUMERIC)


def categorical_columns(schema: DatasetSchema) -> list[str]:
    return columns_of(schema, *CATEGORICAL_LIKE)


def observed_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in the order in which they first appear."""
    own = with_ordinal(df).select(countable(df, column).alias("value"), ORDINAL).where("value is not null")
    return own.groupBy("value").agg(F.min(ORDINAL).alias("first")).orderBy("first").select("value")


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows, in source order where it is known."""
    return (df.orderBy(ORDINAL) if ORDINAL in df.columns else df).limit(rows)


def chart_sample(df: DataFrame, points: int = CHART_POINTS, seed: int = SEED) -> DataFrame:
    """All rows, or as many as a chart shows, drawn at random."""
    total = df.count()
    return df if total <= points else df.orderBy(F.rand(seed)).limit(points)


def downsample_chronological(df: DataFrame, order: str, points: int = CHART_POINTS) -> DataFrame:
    """Rows at even places of the order, the first and last among them; all rows if they are few.

    Rows get their places per stretch of the order, not in one task: counts of the stretches'
    rows, one small row each, shift the places within.
    """
    total = df.count()
    if total <= points:
        return df
    timed = isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    key = F.unix_micros(F.col(order).cast("timestamp")) if timed else F.col(order).cast("double")
    bounds = df.agg(F.percentile_approx(key, [k / STRETCHES for k in range(1, STRETCHES)]).alias("b")).first()["b"]
    stretched = df.withColumn("__stretch", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < key)))
    sums = stretched.groupBy("__stretch").agg(F.count(F.lit(1)).alias("n"))
    shift = sums.select("__stretch", (F.sum("n").over(Window.orderBy("__stretch")) - F.col("n")).alias("__before"))
    ties = [c for c in (ORDINAL,) if c in df.columns]
    place = F.row_number().over(Window.partitionBy("__stretch").orderBy(order, *ties)) - 1
    placed = stretched.withColumn("__in", place).join(F.broadcast(shift), "__stretch").withColumn("__place", F.col("__before") + F.col("__in"))
    wanted = df.sparkSession.range(points).select(F.floor(F.col("id") * (total - 1) / (points - 1)).cast("long").alias("__place")).distinct()
    return placed.join(F.broadcast(wanted), "__place", "left_semi").select(*df.columns)


def advisories(size: PivotCardinality, groups: int = 0) -> dict[str, bool]:
    """Warnings before a long job: a pivot near its limit, very many groups."""
    return {"pivot_near_limit": size.potential_cell_count > 0.75 * size.max_cells, "many_groups": groups > 50}
