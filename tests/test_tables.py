"""Schema, quality, profiles, exploration and transformations on literal tables."""

from datetime import datetime, time, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.functions import selection
from tabscope.functions.values import with_ordinal
from tabscope.operators import dataflow, explore, profile, quality, schema, transform
from tabscope.operators.records import (
    DropColumns,
    InvalidTransformationError,
    QualityIssueCode,
    RemoveEmptyRows,
    ReplaceValueWithMissing,
    SemanticType,
    TransformationPlan,
    UnknownColumnError,
)

NAN, INF = float("nan"), float("inf")


def make(spark, types, *rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], types)


def column(spark, name, kind, *values):
    return make(spark, f"`{name}` {kind}", *[(v,) for v in values])


def kinds(df):
    return [(str(c.semantic_type), c.temporal_format, c.confidence) for c in schema.infer_schema(df).columns]


def codes(df, **limits):
    return [str(i.code) for i in quality.analyze_data_quality(df, **limits).issues]


def test_schema_of_generated_columns(spark):
    """Columns drawn to fall on either side of each limit."""
    rng = np.random.default_rng(4)
    n = 240
    drawn = pd.DataFrame(
        {
            "parcel_uuid": [f"{k:x}-{k * 7919:x}" for k in rng.permutation(n)],
            "fragile": rng.random(n) < 0.3,
            "crates": rng.integers(1, 19, n),
            "kilos": np.round(rng.gamma(3, 4, n), 3),
            "depot": rng.choice(["quay", "hangar", "yard", "annex", "silo"], n),
            "remark": [f"seal {k} of lot {k % 11}" for k in range(n)],
            "lane": rng.choice(["left", "right"], n),
        }
    )
    df = make(
        spark, "parcel_uuid string, fragile boolean, crates long, kilos double, depot string, remark string, lane string",
        *[(u, bool(f), int(c), float(k), str(d), m, str(e)) for u, f, c, k, d, m, e in drawn.itertuples(index=False)],
    )
    found = schema.infer_schema(df)
    assert [str(c.semantic_type) for c in found.columns] == ["identifier", "binary", "numeric_discrete", "numeric_continuous", "categorical", "text", "binary"]
    assert [c.unique_count for c in found.columns] == drawn.nunique().tolist()
    assert (found.row_count, found.column_count) == drawn.shape


@pytest.mark.parametrize(
    ("pattern", "first", "step", "expected"),
    [
        ("%Y-%m-%d", datetime(1987, 5, 20), timedelta(days=9), ("datetime", "%Y-%m-%d", 1.0)),
        ("%d/%m/%Y", datetime(1987, 5, 20), timedelta(days=9), ("datetime", "%d/%m/%Y", 1.0)),
        ("%H.%M.%S", datetime(1987, 5, 20, 6, 2, 41), timedelta(minutes=47), ("time", "%H.%M.%S", 1.0)),
        ("%d/%m/%Y", datetime(1987, 1, 1), timedelta(days=31 + 1), ("datetime", None, 0.60)),  # days stay below 13
        ("ref %d of %Y;", datetime(1987, 5, 20), timedelta(days=9), ("text", None, 0.75)),
        ("%Y-%j-%d", datetime(1987, 5, 20), timedelta(days=9), ("text", None, 0.75)),
    ],
)
def test_schema_formats(spark, pattern, first, step, expected):
    values = [(first + k * step).strftime(pattern) for k in range(6)]
    assert kinds(column(spark, "stamp", "string", *values)) == [expected]


@pytest.mark.parametrize(("bad", "told"), [(0, 1.0), (1, 0.9), (2, 0.8), (3, None)])
def test_schema_formats_need_four_fifths(spark, bad, told):
    days = [(datetime(1991, 8, 14) + timedelta(days=5 * k)).strftime("%Y-%m-%d") for k in range(10 - bad)]
    odd = [f"{1991 + k}-02-30" for k in range(bad)]
    ((kind, form, sure),) = kinds(column(spark, "stamp", "string", *days, *odd))
    assert (kind, form, sure) == (("datetime", "%Y-%m-%d", told) if told else ("text", None, 0.75))


def test_schema_numbers_and_gaps(spark):
    one = lambda kind, *values: kinds(column(spark, "depth", kind, *values))[0]
    assert one("bigint", 7, 3, 3, 7)[0] == "binary"
    assert one("double", *[k * 4.0 for k in range(51)]) == ("numeric_continuous", None, 0.80)
    assert one("double", *[k % 20 * 4.0 for k in range(60)]) == ("numeric_discrete", None, 0.85)
    assert one("double", 8.0, -INF, 6.0, 9.0)[0] == "numeric_continuous"
    assert one("timestamp_ntz", None, datetime(1969, 7, 20, 20, 17)) == ("datetime", None, 1.0)
    assert one("map<string,int>", {"k": 1}, {"k": 2}) == ("unknown", None, 0.50)
    void = schema.infer_schema(column(spark, "depth", "double", NAN, None, NAN, None)).columns[0]
    assert (void.semantic_type, void.missing_count, void.missing_ratio) == (SemanticType.UNKNOWN, 4, 1.0)
    gaps = schema.infer_schema(column(spark, "depth", "double", 6.5, None, 6.5, NAN, 0.25, 6.5, 1.5, None)).columns[0]
    assert (gaps.unique_count, gaps.missing_count, gaps.missing_ratio) == (3, 3, 0.375)


def test_quality_rows(spark):
    """Missing cells, empty rows and repeats of drawn tables, against pandas."""
    rng = np.random.default_rng(12)
    for n in (1, 9, 60):
        drawn = pd.DataFrame({"reed": rng.choice([0.5, 2.5, np.nan], n), "key": rng.choice(["c", "d", None], n), "bars": rng.choice([8.0, np.nan], n)})
        rows = [tuple(None if isinstance(x, float) and x != x and j != 0 else x for j, x in enumerate(r)) for r in drawn.itertuples(index=False)]
        r = quality.analyze_data_quality(make(spark, "reed double, key string, bars double", *rows))
        gaps, empty = drawn.isna(), drawn.isna().all(axis=1)
        assert (r.missing_cell_count, r.missing_cell_ratio) == (gaps.sum().sum(), gaps.sum().sum() / (3 * n))
        assert (r.all_missing_row_count, r.all_missing_row_ratio) == (empty.sum(), empty.mean())
        again = drawn[~empty].duplicated()
        assert (r.duplicate_row_count, r.duplicate_row_ratio) == (again.sum(), again.mean() if len(again) else 0)  # of populated rows
    (said,) = [i.message for i in r.issues if "empty row" in i.message]
    assert said.startswith(f"{empty.sum()} completely empty row(s)")


def test_quality_columns(spark):
    void = make(spark, "moor string, `Unnamed: 3` string, peat int", *[(None, None, k * k) for k in range(7)])
    assert codes(void) == ["all_missing", "structural_empty_column"]
    assert "constant" in codes(column(spark, "harbour", "double", 0.75, NAN, 0.75))
    for gaps, limit, told in ((5, 0.5, True), (4, 0.5, False), (4, 0.4, True)):
        values = [None] * gaps + [11 + k % 2 for k in range(10 - gaps)]
        assert ("high_missingness" in codes(column(spark, "ebb", "int", *values), high_missingness_threshold=limit)) is told
    assert codes(column(spark, "vessel_key", "string", *[f"{k:03}/W" for k in range(12)])) == ["probable_identifier"]
    assert codes(column(spark, "logbook", "string", *[f"wind {k} knots" for k in range(64)])) == ["high_cardinality"]
    infinite = quality.analyze_data_quality(column(spark, "swell", "double", INF, 0.5, INF, 3.5, -INF, 2.5, 1.5)).issues
    assert [(i.code, i.affected_count) for i in infinite if i.column] == [(QualityIssueCode.NON_FINITE_VALUES, 3)]


def test_quality_sentinel(spark):
    rng = np.random.default_rng(8)
    rest = np.round(rng.normal(42, 3, 36), 2)
    df = column(spark, "salinity", "double", *[999.0] * 14, *map(float, rest))
    (issue,) = [i for i in quality.analyze_data_quality(df).issues if i.column]
    assert (issue.code, issue.observed_value, issue.affected_count, issue.affected_ratio) == (QualityIssueCode.POSSIBLE_SENTINEL, 999.0, 14, 0.28)
    middle = np.median(rest)
    own = abs(999 - middle) / (1.4826 * np.median(abs(rest - middle)))
    assert quality.sentinel_scores(df, [("salinity", 999.0)]).first()["score"] == pytest.approx(own)


@pytest.mark.parametrize("limits", [{"high_missingness_threshold": -0.1}, {"high_missingness_threshold": 1.1}, {"high_cardinality_ratio": 1.1}, {"high_cardinality_min_unique": 0}])
def test_quality_limits(spark, limits):
    with pytest.raises(ValueError, match="must be"):
        quality.analyze_data_quality(column(spark, "x", "int", 1), **limits)


def test_profiles(spark):
    one = lambda df: profile.profile_dataset(df).columns[0]
    drawn = np.round(np.random.default_rng(2).normal(5, 2, 41), 3)
    n = one(column(spark, "loaf", "double", *map(float, drawn), None, NAN)).numeric
    assert (n.count, n.minimum, n.maximum, n.median) == (41, drawn.min(), drawn.max(), np.median(drawn))
    assert (n.mean, n.standard_deviation) == pytest.approx((drawn.mean(), drawn.std(ddof=1)))
    c = one(column(spark, "grain", "string", "rye", "oat", *["spelt"] * 4, "oat", None, "rye", "rye")).categorical
    assert (c.count, c.unique_count, c.most_frequent_value, c.most_frequent_count) == (9, 3, "spelt", 4)
    t = one(column(spark, "baked", "string", "05.40.10", "21.15.00", "04.59.59", "13.00.30")).time
    assert (t.earliest, t.latest) == (time(4, 59, 59), time(21, 15))
    d = one(column(spark, "sold", "string", "07/08/1999", "09/10/1999", "11/12/1999")).datetime
    assert (d.count, d.earliest, d.latest) == (3, None, None)  # which is the day isn't known
    d = one(column(spark, "sold", "string", "28/11/1999", "07/08/1999", "30/01/1998")).datetime
    assert (d.earliest, d.latest) == (datetime(1998, 1, 30), datetime(1999, 11, 28))
    nothing = one(column(spark, "crumb", "string", *[None] * 5))
    assert (nothing.numeric, nothing.categorical, nothing.datetime, nothing.time) == (None,) * 4


def plan(*operations):
    return TransformationPlan(tuple(operations))


def test_transformations(spark):
    """A drawn table through each operation, against pandas."""
    rng = np.random.default_rng(21)
    drawn = pd.DataFrame({"up": rng.choice([9.0, 4.0, np.nan], 50), "down": rng.choice([9.0, 1.5, np.nan], 50)})
    df = make(spark, "up double, down double", *[tuple(map(float, r)) for r in drawn.itertuples(index=False)])
    empty = int(drawn.isna().all(axis=1).sum())
    r = transform.apply_transformation_plan(df, plan(RemoveEmptyRows()))
    assert (r.original_shape, r.final_shape, r.log[0].affected_rows, r.log[0].affected_cells) == ((50, 2), (50 - empty, 2), empty, 2 * empty)
    r = transform.apply_transformation_plan(df, plan(DropColumns(("up",))))
    assert (r.final_shape, r.data.columns, r.log[0].message) == ((50, 1), ["down"], "Dropped column(s): up.")
    hits = drawn == 9
    r = transform.apply_transformation_plan(df, plan(ReplaceValueWithMissing(("up", "down"), 9)))
    assert (r.log[0].affected_cells, r.log[0].affected_rows, r.operation_count) == (hits.sum().sum(), hits.any(axis=1).sum(), 1)
    only = transform.transform_frame(df, plan(ReplaceValueWithMissing(("down",), 9))).agg(F.count_if(F.col("down") == 9), F.count_if(F.col("up") == 9)).first()
    assert tuple(only) == (0, hits["up"].sum())
    text = column(spark, "s", "string", "9", "nine", None)
    assert transform.apply_transformation_plan(text, plan(ReplaceValueWithMissing(("s",), 9))).log[0].affected_cells == 0


def test_transformation_order_counts(spark):
    """Rows that a replacement empties go only if the removal comes later; the log counts at each place."""
    df = make(spark, "up int, down int", *[(6, 6)] * 5, *[(6, 2)] * 3, *[(None, 6)] * 2, (None, None))
    replace, remove = ReplaceValueWithMissing(("up", "down"), 6), RemoveEmptyRows()
    late = transform.apply_transformation_plan(df, plan(replace, remove, DropColumns(("up",)), remove))
    assert (late.final_shape, [x.affected_rows for x in late.log]) == ((3, 1), [10, 8, 3, 0])
    early = transform.apply_transformation_plan(df, plan(remove, replace))
    assert (early.final_shape, [(x.affected_rows, x.affected_cells) for x in early.log]) == ((10, 2), [(1, 2), (10, 15)])
    assert transform.apply_transformation_plan(df, plan()).log == () and df.count() == 11


@pytest.mark.parametrize(
    ("operation", "error"),
    [
        (DropColumns(("z",)), UnknownColumnError), (DropColumns(("a", "b")), InvalidTransformationError),
        (DropColumns(()), InvalidTransformationError), (DropColumns(("a", "a")), InvalidTransformationError),
        (ReplaceValueWithMissing(("a",), None), InvalidTransformationError), (ReplaceValueWithMissing(("a",), [1]), InvalidTransformationError),
        ("drop", InvalidTransformationError),
    ],
)
def test_transformation_errors(spark, operation, error):
    with pytest.raises(error):
        transform.apply_transformation_plan(make(spark, "a int, b int", (1, 2)), plan(operation))


def test_plan_builder():
    built = transform.build_operations([("mast", 9.5), ("keel", "n/a"), ("boom", 9.5), ("mast", 9.5)], True, ["log", "bell", "log"])
    by_value = (ReplaceValueWithMissing(("mast", "boom"), 9.5), ReplaceValueWithMissing(("keel",), "n/a"))
    assert built.operations == (*by_value, RemoveEmptyRows(), DropColumns(("log", "bell")))


def test_missingness_and_distribution(spark):
    rng = np.random.default_rng(31)
    drawn = rng.choice([2.0, 7.0, np.nan, np.inf, -np.inf], 80, p=[0.3, 0.3, 0.2, 0.1, 0.1])
    df = column(spark, "tide", "double", *map(float, drawn)).withColumn("whole", F.lit(1))
    gaps = int(np.isnan(drawn).sum())
    assert [(x.missing_count, x.missing_ratio) for x in explore.summarize_missingness(df)] == [(gaps, gaps / 80), (0, 0.0)]
    d = explore.summarize_numeric_distribution(df, "tide", bins=5)
    own = drawn[np.isfinite(drawn)]
    assert (d.total_count, d.valid_count, d.missing_count, d.non_finite_count) == (80, len(own), gaps, np.isinf(drawn).sum())
    assert d.mean == pytest.approx(own.mean())
    assert [b.count for b in d.histogram] == [(own == 2).sum(), 0, 0, 0, (own == 7).sum()]
    assert d.histogram[0].right == pytest.approx(3)
    none = explore.summarize_numeric_distribution(column(spark, "tide", "double", -INF, None, NAN), "tide")
    assert (none.valid_count, none.histogram, none.mean) == (0, (), None)


def test_histogram_edges(spark):
    flat = explore.summarize_numeric_distribution(column(spark, "v", "double", *[-2.5] * 3), "v", bins=8).histogram
    assert (flat[0].left, flat[-1].right, [b.count for b in flat]) == (-3.0, -2.0, [0, 0, 0, 0, 3, 0, 0, 0])
    rng = np.random.default_rng(0)
    for bins in (1, 7, 10):
        values = np.round(rng.normal(0, 3, 400), 1)
        own = explore.summarize_numeric_distribution(column(spark, "v", "double", *map(float, values)), "v", bins=bins).histogram
        assert [b.count for b in own] == np.histogram(values, bins)[0].tolist()


def test_outliers_frequencies_pairs(spark):
    drawn = np.r_[np.round(np.random.default_rng(6).normal(0, 1, 90), 2), [14.0, -9.0, 11.5]]
    low, high = np.quantile(drawn, [0.25, 0.75])
    o = explore.summarize_numeric_outliers(column(spark, "v", "double", *map(float, drawn), NAN), "v")
    assert (o.first_quartile, o.third_quartile, o.lower_bound, o.upper_bound) == pytest.approx((low, high, low - 1.5 * (high - low), high + 1.5 * (high - low)))
    assert (o.lower_outlier_count, o.upper_outlier_count) == ((drawn < o.lower_bound).sum(), (drawn > o.upper_bound).sum())
    fish = column(spark, "fish", "string", *["roach"] * 2, *["tench"] * 6, *["perch"] * 5, *["bream"] * 3, None, None)
    f = explore.summarize_categorical_frequencies(fish, "fish", top_n=3)
    assert [(x.value, x.count, x.ratio) for x in f.frequencies] == [("tench", 6, 6 / 18), ("perch", 5, 5 / 18), ("bream", 3, 3 / 18)]
    assert (f.other_count, f.other_ratio) == (2, 2 / 18)
    ties = with_ordinal(column(spark, "v", "string", "z", "m", "m", "k", "z", "k", "q").coalesce(1))
    assert [x.value for x in explore.summarize_categorical_frequencies(ties, "v").frequencies] == ["z", "m", "k", "q"]
    sides = [0.5, -3.0, NAN, INF, -INF]
    every = make(spark, "x double, y double", *[(x, y) for x in sides for y in sides])
    p = explore.prepare_numeric_pair(every, "x", "y")
    assert (sorted((r["x"], r["y"]) for r in p.data.collect()), p.excluded_count) == ([(-3.0, -3.0), (-3.0, 0.5), (0.5, -3.0), (0.5, 0.5)], 21)


def test_exploration_errors(spark):
    df = make(spark, "v double, s string, b boolean", (1.0, "x", True))
    for call, error, text in (
        (lambda: explore.summarize_numeric_distribution(df, "z"), ValueError, "Unknown column: z."),
        (lambda: explore.summarize_numeric_distribution(df, "b"), ValueError, "must be numeric"),
        (lambda: explore.summarize_numeric_distribution(df, "v", bins=0), ValueError, "positive integer"),
        (lambda: explore.summarize_numeric_outliers(df, "v", multiplier=True), TypeError, "positive finite"),
        (lambda: explore.summarize_numeric_outliers(df, "v", multiplier=-1), ValueError, "positive finite"),
        (lambda: explore.summarize_categorical_frequencies(df, "s", top_n=0), ValueError, "top_n"),
        (lambda: explore.prepare_numeric_pair(df, "v", "v"), ValueError, "must be different"),
    ):
        with pytest.raises(error, match=text):
            call()


def test_dataflow(spark):
    df = with_ordinal(spark.range(1000).select((F.col("id") * 7 % 1000).alias("t"), F.lit("x").alias("s")).coalesce(1))
    kept = dataflow.downsample_chronological(df, "t", 50)
    assert sorted(r["t"] for r in kept.collect()) == sorted({k * 999 // 49 for k in range(50)})
    assert [r["value"] for r in dataflow.observed_values(df.limit(3), "t").collect()] == [0, 7, 14]
    assert dataflow.preview(df, 2).collect()[1]["t"] == 7
    assert dataflow.chart_sample(df, 10).count() == 10


def test_profile_reads_the_table_a_few_times(spark, tmp_path, monkeypatch):
    """Medians and sentinels come from counts of values; so rounds of selection add no reads of the table."""
    monkeypatch.setattr(selection, "STRETCH", 50)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(4000).select((F.col("id") % 997).cast("double").alias("x"), (F.col("id") % 7).alias("k")).repartition(2)
    one = profile.profile_dataset(rows.mapInArrow(seen, "x double, k long"))
    assert one.columns[0].numeric.median == float(np.median([k % 997 for k in range(4000)]))
    assert read.value <= 8 * 4000
