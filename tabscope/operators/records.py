"""Reports and their parts.  Tables within a report are DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, time, timedelta
from enum import StrEnum

from pyspark.sql import DataFrame


# Names and values of all enumerations and fields below, which callers see.
class SemanticType(StrEnum):
    IDENTIFIER = "identifier"
    DATETIME = "datetime"
    TIME = "time"
    BINARY = "binary"
    CATEGORICAL = "categorical"
    NUMERIC_DISCRETE = "numeric_discrete"
    NUMERIC_CONTINUOUS = "numeric_continuous"
    TEXT = "text"
    UNKNOWN = "unknown"


class QualitySeverity(StrEnum):
    INFO = "info"
    WARNING = "warning"
    ERROR = "error"


class QualityIssueCode(StrEnum):
    ALL_MISSING = "all_missing"
    ALL_MISSING_ROWS = "all_missing_rows"
    CONSTANT = "constant"
    HIGH_MISSINGNESS = "high_missingness"
    HIGH_CARDINALITY = "high_cardinality"
    PROBABLE_IDENTIFIER = "probable_identifier"
    DUPLICATE_ROWS = "duplicate_rows"
    STRUCTURAL_EMPTY_COLUMN = "structural_empty_column"
    POSSIBLE_SENTINEL = "possible_sentinel"
    NON_FINITE_VALUES = "non_finite_values"


class PivotAggregation(StrEnum):
    ROW_COUNT = "row_count"
    COUNT = "count"
    SUM = "sum"
    MEAN = "mean"
    MEDIAN = "median"
    MIN = "min"
    MAX = "max"


class CorrelationMethod(StrEnum):
    PEARSON = "pearson"
    SPEARMAN = "spearman"


class RelationshipStatus(StrEnum):
    OK = "ok"
    INSUFFICIENT_PAIRS = "insufficient_pairs"
    CONSTANT_INPUT = "constant_input"


class TwoGroupMethod(StrEnum):
    WELCH_T = "welch_t"
    MANN_WHITNEY = "mann_whitney"


class MultiGroupMethod(StrEnum):
    ONE_WAY_ANOVA = "one_way_anova"
    KRUSKAL_WALLIS = "kruskal_wallis"


class TemporalFrequency(StrEnum):
    HOUR = "hour"
    DAY = "day"
    WEEK = "week"
    MONTH = "month"


class TemporalAggregation(StrEnum):
    MEAN = "mean"
    MEDIAN = "median"
    SUM = "sum"
    MIN = "min"
    MAX = "max"


record = dataclass(frozen=True, slots=True)


@record
class ColumnSchema:
    name: str
    physical_dtype: str
    semantic_type: SemanticType
    missing_count: int
    missing_ratio: float
    unique_count: int
    unique_ratio: float
    confidence: float
    reason: str
    temporal_format: str | None = None


@record
class DatasetSchema:
    row_count: int
    column_count: int
    columns: tuple[ColumnSchema, ...]


@record
class QualityIssue:
    code: QualityIssueCode
    severity: QualitySeverity
    message: str
    column: str | None = None
    observed_value: object | None = None
    affected_count: int | None = None
    affected_ratio: float | None = None


@record
class DataQualityReport:
    row_count: int
    column_count: int
    missing_cell_count: int
    missing_cell_ratio: float
    all_missing_row_count: int
    all_missing_row_ratio: float
    duplicate_row_count: int
    duplicate_row_ratio: float
    issues: tuple[QualityIssue, ...]

    @property
    def issue_count(self) -> int:
        return len(self.issues)


@record
class NumericSummary:
    count: int
    mean: float | None
    median: float | None
    standard_deviation: float | None
    minimum: float | None
    maximum: float | None


@record
class CategoricalSummary:
    count: int
    unique_count: int
    most_frequent_value: object | None
    most_frequent_count: int | None


@record
class DatetimeSummary:
    count: int
    earliest: datetime | None
    latest: datetime | None


@record
class TimeSummary:
    count: int
    earliest: time | None
    latest: time | None


@record
class ColumnProfile:
    schema: ColumnSchema
    numeric: NumericSummary | None = None
    categorical: CategoricalSummary | None = None
    datetime: DatetimeSummary | None = None
    time: TimeSummary | None = None


@record
class DatasetProfile:
    row_count: int
    column_count: int
    schema: DatasetSchema
    quality: DataQualityReport
    columns: tuple[ColumnProfile, ...]


@record
class RemoveEmptyRows:
    pass


@record
class DropColumns:
    columns: tuple[str, ...]


@record
class ReplaceValueWithMissing:
    columns: tuple[str, ...]
    value: object


@record
class TransformationPlan:
    operations: tuple[RemoveEmptyRows | DropColumns | ReplaceValueWithMissing, ...] = ()


@record
class TransformationLogEntry:
    operation: str
    affected_rows: int
    affected_cells: int
    affected_columns: tuple[str, ...]
    message: str


@record
class TransformationResult:
    data: DataFrame
    original_shape: tuple[int, int]
    final_shape: tuple[int, int]
    log: tuple[TransformationLogEntry, ...]

    @property
    def operation_count(self) -> int:
        return len(self.log)


@record
class ColumnMissingness:
    column: str
    missing_count: int
    missing_ratio: float


@record
class HistogramBin:
    left: float
    right: float
    count: int


@record
class NumericDistribution:
    column: str
    total_count: int
    valid_count: int
    missing_count: int
    non_finite_count: int
    mean: float | None
    standard_deviation: float | None
    minimum: float | None
    first_quartile: float | None
    median: float | None
    third_quartile: float | None
    maximum: float | None
    histogram: tuple[HistogramBin, ...]


@record
class NumericOutlierSummary:
    column: str
    total_count: int
    valid_count: int
    first_quartile: float | None
    third_quartile: float | None
    iqr: float | None
    lower_bound: float | None
    upper_bound: float | None
    lower_outlier_count: int
    upper_outlier_count: int
    outlier_count: int
    outlier_ratio: float | None


@record
class CategoryFrequency:
    value: object
    count: int
    ratio: float


@record
class CategoricalFrequencySummary:
    column: str
    total_count: int
    non_missing_count: int
    missing_count: int
    unique_count: int
    frequencies: tuple[CategoryFrequency, ...]
    other_count: int
    other_ratio: float


@record
class NumericPairData:
    x_column: str
    y_column: str
    total_count: int
    valid_count: int
    excluded_count: int
    data: DataFrame


@record
class PivotCardinality:
    row_group_count: int
    column_group_count: int
    potential_cell_count: int
    max_cells: int


@record
class PivotResult:
    row_dimensions: tuple[str, ...]
    column_dimensions: tuple[str, ...]
    value_column: str | None
    aggregation: PivotAggregation
    include_missing_dimensions: bool
    source_row_count: int
    included_row_count: int
    excluded_dimension_row_count: int
    group_count: int
    cardinality: PivotCardinality
    tidy: DataFrame
    table: DataFrame


@record
class NumericRelationship:
    x_column: str
    y_column: str
    method: CorrelationMethod
    total_count: int
    valid_count: int
    excluded_count: int
    minimum_pairs: int
    coefficient: float | None
    status: RelationshipStatus


@record
class CorrelationMatrix:
    """``cells`` is tidy: x, y, coefficient (null if undefined), valid_count; both triangles."""

    columns: tuple[str, ...]
    method: CorrelationMethod
    minimum_pairs: int
    cells: DataFrame

    def dense(self, field: str = "coefficient") -> dict[str, dict[str, float | None]]:
        out = {x: dict.fromkeys(self.columns) for x in self.columns}
        for r in self.cells.collect():
            out[r["x_column"]][r["y_column"]] = r[field]
        return out


@record
class CorrelationPair:
    x_column: str
    y_column: str
    coefficient: float
    absolute_coefficient: float
    valid_count: int


@record
class NumericGroupSummary:
    group: object
    count: int
    mean: float
    median: float
    standard_deviation: float | None
    minimum: float
    maximum: float


@record
class TwoGroupComparison:
    value_column: str
    group_column: str
    group_a: object
    group_b: object
    method: TwoGroupMethod
    alpha: float
    source_row_count: int
    selected_row_count: int
    used_row_count: int
    excluded_value_row_count: int
    group_a_summary: NumericGroupSummary
    group_b_summary: NumericGroupSummary
    statistic: float
    p_value: float
    significant: bool | None
    effect_size_name: str
    effect_size: float | None


@record
class MultiGroupComparison:
    value_column: str
    group_column: str
    groups: tuple[object, ...]
    method: MultiGroupMethod
    alpha: float
    source_row_count: int
    selected_row_count: int
    used_row_count: int
    excluded_value_row_count: int
    group_summaries: tuple[NumericGroupSummary, ...]
    statistic: float
    p_value: float
    significant: bool | None
    effect_size_name: str
    effect_size: float | None


@record
class CategoricalAssociation:
    row_column: str
    column_column: str
    alpha: float
    source_row_count: int
    used_row_count: int
    excluded_missing_row_count: int
    row_level_count: int
    column_level_count: int
    cell_count: int
    statistic: float
    degrees_of_freedom: int
    p_value: float
    significant: bool | None
    cramers_v: float | None
    minimum_expected_frequency: float
    expected_below_five_count: int
    expected_below_five_ratio: float
    observed: DataFrame
    expected: DataFrame


@record
class TemporalAxis:
    """``data`` is the source with the column ``timestamp``."""

    date_column: str
    time_column: str | None
    total_count: int
    valid_count: int
    invalid_count: int
    data: DataFrame


@record
class TemporalSamplingSummary:
    total_count: int
    valid_count: int
    invalid_count: int
    unique_timestamp_count: int
    duplicate_row_count: int
    duplicate_timestamp_count: int
    is_chronologically_sorted: bool
    earliest: datetime | None
    latest: datetime | None
    span: timedelta | None
    interval_count: int
    minimum_interval: timedelta | None
    median_interval: timedelta | None
    maximum_interval: timedelta | None
    dominant_interval: timedelta | None
    dominant_interval_count: int
    dominant_interval_ratio: float | None


@record
class TemporalGap:
    start: datetime
    end: datetime
    duration: timedelta
    expected_interval: timedelta
    excess_duration: timedelta


@record
class TemporalGapSummary:
    expected_interval: timedelta
    unique_timestamp_count: int
    gap_count: int
    #: start, end, duration and excess in microseconds; there may be as many as timestamps
    frame: DataFrame

    @property
    def gaps(self) -> tuple[TemporalGap, ...]:
        """All of them on the driver, in order; read anew each time."""
        span = lambda n: timedelta(microseconds=n)
        rows = self.frame.orderBy("start").collect()
        return tuple(TemporalGap(r["start"], r["end"], span(r["duration"]), self.expected_interval, span(r["excess"])) for r in rows)


@record
class TemporalNumericSeries:
    value_column: str
    total_count: int
    valid_count: int
    excluded_count: int
    data: DataFrame


@record
class TemporalAggregationResult:
    value_column: str
    frequency: TemporalFrequency
    aggregation: TemporalAggregation
    total_count: int
    valid_count: int
    excluded_count: int
    bucket_count: int
    data: DataFrame


class DatasetError(Exception):
    """A dataset can't be used."""


class UnsupportedFileTypeError(DatasetError):
    """The file's extension isn't known."""


class DatasetReadError(DatasetError):
    """The file can't be read."""


class EmptyDatasetError(DatasetError):
    """The file has no columns or no rows."""


class TransformationError(Exception):
    """A plan can't be applied."""


class UnknownColumnError(TransformationError):
    """A plan names a column that isn't there."""


class InvalidTransformationError(TransformationError):
    """A plan asks for something that can't be done."""
