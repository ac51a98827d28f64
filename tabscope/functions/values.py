"""Missing, finite and ordered values: the rules that all operators share.

Missing is null or NaN; infinities are present but not finite.  Numbers become doubles
before statistics; booleans are not numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDINAL = "_ordinal"


def family(kind: T.DataType) -> str:
    """number, boolean, text, time or other."""
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "other"


def family_of(df: DataFrame, column: str) -> str:
    return family(df.schema[column].dataType)


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the row order."""
    return [c for c in df.columns if c != ORDINAL]


def quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def is_missing(df: DataFrame, column: str) -> Column:
    c = quoted(column)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, column: str) -> Column:
    """The value, NaN as null."""
    c = quoted(column)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes null everywhere."""
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def number(df: DataFrame, column: str) -> Column:
    """A number as double, NaN as null; infinities stay."""
    return present(df, column).cast("double")


def finite(df: DataFrame, column: str) -> Column:
    """A finite number as double, all else null."""
    c = number(df, column)
    return F.when(F.abs(c) != F.lit(float("inf")), c)


def number_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if family_of(df, c) == "number"]


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x, w): how many rows have each finite value of each number column."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite(df, c).alias("x")) for c in columns]))
    return df.select(cells.alias("v")).select("v.*").where("x is not null").groupBy("column", "x").agg(F.count(F.lit(1)).alias("w"))


@contextmanager
def kept_counts(df: DataFrame) -> Iterator[DataFrame | None]:
    """``value_counts`` of all number columns, worked out once for the steps within; None if there are no such columns."""
    columns = number_columns(df)
    counts = value_counts(df, columns).persist() if columns else None
    try:
        yield counts
    finally:
        if counts is not None:
            counts.unpersist()


def is_infinite(df: DataFrame, column: str) -> Column:
    return F.abs(number(df, column)) == F.lit(float("inf"))


def with_ordinal(df: DataFrame) -> DataFrame:
    """``df`` with the place of each row in source order, kept if there already."""
    return df if ORDINAL in df.columns else df.withColumn(ORDINAL, F.monotonically_increasing_id())


def require_column(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"Unknown column: {column}.")


def require_number(df: DataFrame, column: str) -> None:
    require_column(df, column)
    if family_of(df, column) != "number":
        raise ValueError(f"Column {column!r} must be numeric.")


def is_count(value: object, least: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least
