"""Semantic types of columns, from one aggregate over the table and a look at first values."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.formats import DATETIME_FORMATS, TIME_FORMATS, parsed
from tabscope.functions.values import (
    ORDINAL,
    data_columns,
    family_of,
    finite,
    is_infinite,
    is_missing,
    number,
    present,
    quoted,
)
from tabscope.operators.records import ColumnSchema, DatasetSchema, SemanticType

# Names that mark identifiers, and the limits of the rules.
IDENTIFIER = re.compile(r"(^id$|_id$|^id_|uuid|guid|_key$|^key$)", re.IGNORECASE)
IDENTIFIER_RATIO = 0.90
FORMAT_SAMPLE = 500
FORMAT_RATIO = 0.80
FEW, SEVERAL, SEVERAL_RATIO = 20, 50, 0.20


def countable(df: DataFrame, column: str) -> Column:
    """The value in a form that can be counted and compared, missing ones null."""
    if family_of(df, column) == "other":
        c = quoted(column)
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    return present(df, column)


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row: for each name the count of its column's distinct non-null values.

    Every value becomes a row of its column's place and a 128-bit hash; these are counted by
    one aggregate, with partial counts before the shuffle, for all columns together.
    """
    names = list(values)
    cells = []
    for k, c in enumerate(values.values()):
        if isinstance(df.select(c).schema[0].dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0)  # -0.0 is 0.0
        cells.append(F.struct(F.lit(k).alias("k"), F.when(c.isNotNull(), F.xxhash64(c)).alias("h"), F.xxhash64(F.lit(1), c).alias("i")))
    if not cells:
        return df.sparkSession.range(1).select()
    rows = df.select(F.explode(F.array(*cells)).alias("v")).select("v.*").where("h is not null").distinct()
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(name) for k, name in enumerate(names)])


def column_statistics(df: DataFrame) -> DataFrame:
    """One row: row count, and for the k-th column n_k present, u_k distinct and i_k all whole.

    With inf_k, f_k, d_k (finite ones, all and distinct), lo_k and hi_k for the quality rules.
    """
    aggregates, values = [F.count(F.lit(1)).alias("rows")], {}
    for k, c in enumerate(data_columns(df)):
        aggregates.append(F.count(countable(df, c)).alias(f"n_{k}"))
        values[f"u_{k}"] = countable(df, c)
        if family_of(df, c) == "number":
            high, low = (number(df, c) == F.lit(float(side)) for side in ("inf", "-inf"))
            aggregates += [
                F.min(F.coalesce(number(df, c) % 1 == 0, number(df, c).isNull())).alias(f"i_{k}"),
                F.count_if(F.coalesce(is_infinite(df, c), F.lit(False))).alias(f"inf_{k}"),
                F.count(finite(df, c)).alias(f"f_{k}"),
                F.min(finite(df, c)).alias(f"lo_{k}"),
                F.max(finite(df, c)).alias(f"hi_{k}"),
                (F.coalesce(F.max(high.cast("long")), F.lit(0)) + F.coalesce(F.max(low.cast("long")), F.lit(0))).alias(f"ends_{k}"),
            ]
            if isinstance(df.schema[c].dataType, (T.LongType, T.DecimalType)):  # several may be one double
                values[f"d_{k}"] = finite(df, c)
    both = df.agg(*aggregates).join(F.broadcast(distinct_counts(df, values)))  # one row each
    for k, c in enumerate(data_columns(df)):
        if family_of(df, c) == "number" and f"d_{k}" not in values:
            both = both.withColumn(f"d_{k}", F.col(f"u_{k}") - F.col(f"ends_{k}"))
    return both


def format_scores(df: DataFrame, column: str) -> DataFrame:
    """One row: ``sampled`` and for each format the count of first values it parses, in order."""
    own = df.where(~is_missing(df, column))
    if ORDINAL in df.columns:
        own = own.orderBy(ORDINAL)
    first = own.select(quoted(column).alias("value")).limit(FORMAT_SAMPLE)
    formats = [*TIME_FORMATS, *DATETIME_FORMATS]
    return first.agg(
        F.count("value").alias("sampled"),
        *[F.count(parsed(F.col("value"), f)).alias(f"score_{k}") for k, f in enumerate(formats)],
    )


def best_format(scores: dict[str, int], sampled: int) -> tuple[str | None, float, bool]:
    """Best format, its share of the sample, and whether others share the best."""
    most = max(scores.values(), default=0)
    if not sampled or not most:
        return None, 0.0, False
    best = [f for f, n in scores.items() if n == most]
    return (best[0] if len(best) == 1 else None), most / sampled, len(best) > 1


def temporal_type(scores: dict[str, int], sampled: int) -> tuple[SemanticType, float, str, str | None] | None:
    """What the formats say of a text column: times before dates."""
    form, ratio, tied = best_format({f: scores[f] for f in TIME_FORMATS}, sampled)
    if ratio >= FORMAT_RATIO:
        if tied:
            return SemanticType.TIME, 0.60, "Values appear to represent times, but the format is ambiguous.", None
        return SemanticType.TIME, ratio, f"String values match time format {form}.", form
    form, ratio, tied = best_format({f: scores[f] for f in DATETIME_FORMATS}, sampled)
    if ratio >= FORMAT_RATIO:
        if tied:
            reason = "Values appear to represent dates, but day/month order is ambiguous and requires confirmation."
            return SemanticType.DATETIME, 0.60, reason, None
        return SemanticType.DATETIME, ratio, f"String values match datetime format {form}.", form
    return None


def semantic_type(name: str, kind: str, n: int, unique: int, whole: bool, categorical: bool, temporal) -> tuple:
    """Type, confidence, reason and format of a column; the first rule that holds."""
    ratio = unique / n if n else 0.0
    few = unique <= SEVERAL and ratio <= SEVERAL_RATIO
    if n == 0:
        return SemanticType.UNKNOWN, 1.0, "Column contains no non-missing values.", None
    if kind == "time":
        return SemanticType.DATETIME, 1.0, "Column has a native datetime type.", None
    if kind == "boolean":
        return SemanticType.BINARY, 1.0, "Column has a native boolean type.", None
    if IDENTIFIER.search(name) and ratio >= IDENTIFIER_RATIO:
        return SemanticType.IDENTIFIER, 0.95, "Name looks like an identifier and values are mostly unique.", None
    if temporal is not None:
        return temporal
    if kind == "other":
        return SemanticType.UNKNOWN, 0.50, "Column type is not supported for inference.", None
    if unique == 2:
        return SemanticType.BINARY, 0.95, "Column has exactly two distinct values.", None
    if kind == "number":
        if not whole:
            return SemanticType.NUMERIC_CONTINUOUS, 0.90, "Numeric values have fractions.", None
        if unique <= FEW or few:
            return SemanticType.NUMERIC_DISCRETE, 0.85, "Whole numbers with few distinct values.", None
        return SemanticType.NUMERIC_CONTINUOUS, 0.80, "Whole numbers with many distinct values.", None
    if categorical:
        return SemanticType.CATEGORICAL, 0.95, "Column is marked as categorical.", None
    if (unique <= FEW and ratio < IDENTIFIER_RATIO) or few:
        return SemanticType.CATEGORICAL, 0.85, "Text with few distinct values.", None
    return SemanticType.TEXT, 0.75, "Text with many distinct values.", None


def schema_from(df: DataFrame, stats) -> DatasetSchema:
    """The schema, from a row of ``column_statistics`` and one job over the texts' first values."""
    columns = data_columns(df)
    texts = [(k, c) for k, c in enumerate(columns) if family_of(df, c) == "text" and stats[f"n_{k}"]]
    scored: dict[int, tuple[dict[str, int], int]] = {}
    if texts:
        rows = reduce(DataFrame.unionByName, [format_scores(df, c).withColumn("k", F.lit(k)) for k, c in texts])
        for r in rows.collect():
            scored[r["k"]] = ({f: r[f"score_{i}"] for i, f in enumerate([*TIME_FORMATS, *DATETIME_FORMATS])}, r["sampled"])
    out, total = [], stats["rows"]
    for k, c in enumerate(columns):
        n, unique = stats[f"n_{k}"], stats[f"u_{k}"]
        kind, field = family_of(df, c), df.schema[c]
        whole = kind == "number" and bool(stats[f"i_{k}"])
        temporal = temporal_type(*scored[k]) if k in scored else None
        own, confidence, reason, form = semantic_type(c, kind, n, unique, whole, bool(field.metadata.get("categorical")), temporal)
        out.append(
            ColumnSchema(
                c, field.dataType.simpleString(), own, total - n, (total - n) / total if total else 0.0,
                unique, unique / n if n else 0.0, confidence, reason, form,
            )
        )
    return DatasetSchema(total, len(columns), tuple(out))


def infer_schema(df: DataFrame) -> DatasetSchema:
    return schema_from(df, column_statistics(df).first())


def schema_frame(df: DataFrame) -> DataFrame:
    """The schema as a table, one row for each column."""
    rows = [
        (k, c.name, c.physical_dtype, str(c.semantic_type), c.missing_count, c.missing_ratio, c.unique_count, c.unique_ratio,
         c.confidence, c.reason, c.temporal_format)
        for k, c in enumerate(infer_schema(df).columns)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "position int, column string, physical_dtype string, semantic_type string, missing_count long, missing_ratio double, "
        "unique_count long, unique_ratio double, confidence double, reason string, temporal_format string",
    )
