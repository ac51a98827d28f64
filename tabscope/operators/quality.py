"""Data-quality findings over a whole table."""

from __future__ import annotations

import re
from functools import reduce
from math import ceil, isnan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.selection import quantiles
from tabscope.functions.values import data_columns, family_of, is_missing, kept_counts, value_counts
from tabscope.operators.records import DataQualityReport, DatasetSchema, QualityIssue, QualityIssueCode, QualitySeverity, SemanticType
from tabscope.operators.schema import column_statistics, countable, schema_from

# The limits of the sentinel rule, and the name of columns without one.
SENTINEL_ROWS, SENTINEL_DISTINCT, SENTINEL_COUNT, SENTINEL_SHARE, SENTINEL_REST, SENTINEL_SCORE = 10, 3, 5, 0.01, 3, 2.5
NORMAL_MAD = 1.4826
UNNAMED = re.compile(r"^Unnamed:\s*\d+$")


def empty_row(df: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [is_missing(df, c) for c in data_columns(df)])


def row_findings(df: DataFrame) -> DataFrame:
    """One row: rows, missing_cells, empty_rows and duplicate_rows (after the first, among populated rows)."""
    columns = data_columns(df)
    cells = reduce(lambda a, b: a + b, [is_missing(df, c).cast("long") for c in columns])
    alike = df.select(*[countable(df, c).alias(f"c{k}") for k, c in enumerate(columns)], cells.alias("gaps"))
    groups = alike.groupBy(*alike.columns).agg(F.count(F.lit(1)).alias("n"))
    empty = F.col("gaps") == len(columns)
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") * F.col("gaps")), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("empty_rows"),
        F.coalesce(F.sum(F.when(~empty, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
    )


def sentinel_scores(df: DataFrame, candidates: list[tuple[str, float]], counts: DataFrame | None = None) -> DataFrame:
    """For each (column, value): the count of the value and of the others, and how far off it lies.

    All columns go through together, as the counts of their values; what is known of a case,
    two for a column, comes back before the distances from its median are ordered.
    """
    counts = value_counts(df, list(dict.fromkeys(c for c, _ in candidates))) if counts is None else counts
    make, x, v, w = df.sparkSession.createDataFrame, F.col("x"), F.col("v"), F.col("w")
    cases = make([(k, c, float(value)) for k, (c, value) in enumerate(candidates)], "case long, column string, v double")
    long = counts.join(F.broadcast(cases), "column")
    rest = long.where("x <> v")
    hits = {r["case"]: r["n"] for r in long.where("x = v").groupBy("case").agg(F.sum("w").alias("n")).collect()}
    known = {r["case"]: r for r in rest.groupBy("case").agg(F.sum("w").alias("n"), (F.sum(w * x) / F.sum("w")).alias("mean")).collect()}
    middle = {r["case"]: r["q"][0] for r in quantiles(rest, ["case"], "x", (0.5,), "w").collect()}
    found = make(
        [(k, c, float(value), hits.get(k, 0), known[k]["n"] if k in known else 0, known[k]["mean"] if k in known else None, middle.get(k)) for k, (c, value) in enumerate(candidates)],
        "case long, column string, v double, hits long, others long, mean double, middle double",
    )
    off = counts.join(F.broadcast(found), "column").where("x <> v").withColumn("away", F.abs(x - F.col("middle")))
    gap = x - F.col("mean")
    spread = off.groupBy("case").agg(F.sqrt(F.sum(w * gap * gap) / F.nullif(F.sum("w") - 1, F.lit(0))).alias("spread"))
    mad = quantiles(off, ["case"], "away", (0.5,), "w").select("case", F.col("q")[0].alias("mad"))
    scale = F.when(F.col("mad") > 0, F.col("mad") * NORMAL_MAD).when(F.col("spread") > 0, F.col("spread"))
    both = found.join(F.broadcast(spread), "case", "left").join(F.broadcast(mad), "case", "left")  # a row for each case
    return both.select("case", "v", "hits", "others", (F.abs(v - F.col("middle")) / scale).alias("score"))


def sentinels(df: DataFrame, stats, counts: DataFrame | None) -> dict[str, tuple[float, int, float]]:
    """For each number column with a suspicious extreme: value, count and share of finite values."""
    candidates = []
    for k, c in enumerate(data_columns(df)):
        if family_of(df, c) == "number" and stats[f"f_{k}"] >= SENTINEL_ROWS and stats[f"d_{k}"] >= SENTINEL_DISTINCT:
            candidates += [(c, stats[f"lo_{k}"], stats[f"f_{k}"]), (c, stats[f"hi_{k}"], stats[f"f_{k}"])]
    if not candidates:
        return {}
    best: dict[str, tuple[float, float, int, float]] = {}
    for r in sorted(sentinel_scores(df, [x[:2] for x in candidates], counts).collect(), key=lambda r: r["case"]):
        column, value, n = candidates[r["case"]]
        often = r["hits"] >= max(SENTINEL_COUNT, ceil(SENTINEL_SHARE * n))
        score = r["score"]
        if often and r["others"] >= SENTINEL_REST and score is not None and not isnan(score) and score >= SENTINEL_SCORE:
            if column not in best or score > best[column][0]:  # of equal ones the smaller value
                best[column] = (score, value, r["hits"], r["hits"] / n)
    return {c: x[1:] for c, x in best.items()}


def analyze_data_quality(
    df: DataFrame,
    *,
    high_missingness_threshold: float = 0.40,
    high_cardinality_ratio: float = 0.80,
    high_cardinality_min_unique: int = 20,
) -> DataQualityReport:
    check_limits(high_missingness_threshold, high_cardinality_ratio, high_cardinality_min_unique)
    stats = column_statistics(df).first()
    with kept_counts(df) as counts:
        return quality_from(
            df, stats, schema_from(df, stats), counts, high_missingness_threshold, high_cardinality_ratio, high_cardinality_min_unique
        )


def check_limits(missingness: float, ratio: float, least: int) -> None:
    if not 0 <= missingness <= 1:
        raise ValueError("high_missingness_threshold must be between 0 and 1.")
    if not 0 <= ratio <= 1:
        raise ValueError("high_cardinality_ratio must be between 0 and 1.")
    if least < 1:
        raise ValueError("high_cardinality_min_unique must be at least 1.")


def quality_from(df: DataFrame, stats, schema: DatasetSchema, counts: DataFrame | None, missingness: float, ratio: float, least: int) -> DataQualityReport:
    found = row_findings(df).first() if data_columns(df) else None
    rows, width = schema.row_count, schema.column_count
    gaps, empty, again = (int(found[x]) if found else 0 for x in ("missing_cells", "empty_rows", "duplicate_rows"))
    empty_ratio = empty / rows if rows else 0.0
    again_ratio = again / (rows - empty) if rows > empty else 0.0
    code, info, warning = QualityIssueCode, QualitySeverity.INFO, QualitySeverity.WARNING
    issues: list[QualityIssue] = []
    if empty:
        text = f"{empty} completely empty row(s) detected ({empty_ratio:.1%} of rows)."
        issues.append(QualityIssue(code.ALL_MISSING_ROWS, warning, text, affected_count=empty, affected_ratio=empty_ratio))
    if again:
        text = f"{again} duplicate populated row(s) detected ({again_ratio:.1%} of populated rows)."
        issues.append(QualityIssue(code.DUPLICATE_ROWS, warning, text, affected_count=again, affected_ratio=again_ratio))
    suspicious = sentinels(df, stats, counts)
    for k, column in enumerate(schema.columns):
        issues += column_issues(column, stats, k, suspicious.get(column.name), missingness, ratio, least)
    cells = rows * width
    return DataQualityReport(rows, width, gaps, gaps / cells if cells else 0.0, empty, empty_ratio, again, again_ratio, tuple(issues))


def column_issues(column, stats, k: int, sentinel, missingness: float, ratio: float, least: int) -> list[QualityIssue]:
    code, info, warning = QualityIssueCode, QualitySeverity.INFO, QualitySeverity.WARNING
    name = column.name
    if column.missing_count == stats["rows"]:
        if UNNAMED.fullmatch(name):
            text = "Unnamed column contains only missing values and may have been created by a trailing delimiter."
            return [QualityIssue(code.STRUCTURAL_EMPTY_COLUMN, info, text, name)]
        return [QualityIssue(code.ALL_MISSING, warning, "Column contains only missing values.", name)]
    out = []
    infinite = stats[f"inf_{k}"] if f"inf_{k}" in stats.__fields__ else 0
    if infinite:
        text = f"Column contains {infinite} infinite or non-finite numeric value(s)."
        out.append(QualityIssue(code.NON_FINITE_VALUES, warning, text, name, affected_count=infinite))
    if sentinel:
        value, count, share = sentinel
        text = (
            f"Extreme value {value:g} occurs {count} time(s) ({share:.1%}). "
            "It may represent a sentinel or encoded missing value and should be reviewed."
        )
        out.append(QualityIssue(code.POSSIBLE_SENTINEL, info, text, name, value, count, share))
    if column.unique_count == 1:
        out.append(QualityIssue(code.CONSTANT, warning, "Column contains only one distinct non-null value.", name))
    if column.missing_ratio >= missingness:
        text = f"Column has {column.missing_ratio:.1%} missing values."
        out.append(QualityIssue(code.HIGH_MISSINGNESS, warning, text, name, None, column.missing_count, column.missing_ratio))
    if column.semantic_type == SemanticType.IDENTIFIER:
        text = "Column appears to be an identifier and may not be appropriate as a predictive feature."
        out.append(QualityIssue(code.PROBABLE_IDENTIFIER, info, text, name))
    wordy = column.semantic_type in (SemanticType.CATEGORICAL, SemanticType.TEXT)
    if wordy and column.unique_count >= least and column.unique_ratio >= ratio:
        text = f"Column has {column.unique_count} distinct values ({column.unique_ratio:.1%} of non-null rows)."
        out.append(QualityIssue(code.HIGH_CARDINALITY, info, text, name, None, column.unique_count, column.unique_ratio))
    return out


def findings_frame(df: DataFrame, **limits) -> DataFrame:
    """The findings as a table, in order."""
    rows = [
        (k, str(i.code), str(i.severity), i.message, i.column, None if i.observed_value is None else float(i.observed_value), i.affected_count, i.affected_ratio)
        for k, i in enumerate(analyze_data_quality(df, **limits).issues)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "position int, code string, severity string, message string, column string, observed_value double, affected_count long, affected_ratio double",
    )
