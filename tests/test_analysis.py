"""Pivots, correlations, tests, time and sources on literal tables."""

import zipfile
from datetime import datetime, timedelta
from io import BytesIO
from itertools import combinations
from math import atan, erfc, exp, pi

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.functions import special
from tabscope.functions.ranks import average_ranks
from tabscope.functions.values import with_ordinal
from tabscope.operators import pivot, relate, stats, temporal
from tabscope.operators.records import DatasetReadError, EmptyDatasetError, UnsupportedFileTypeError
from tabscope.sources import reader
from tests.test_tables import INF, NAN, column, make


def tidy(r):
    return {tuple(x)[:-1]: x["value"] for x in r.tidy.collect()}


@pytest.mark.parametrize("how", ["count", "sum", "mean", "median", "min", "max"])
def test_pivot_against_pandas(spark, how):
    rng = np.random.default_rng(5)
    drawn = pd.DataFrame({"reef": rng.choice(["r1", "r2", "r3"], 70), "net": rng.choice(["n1", "n2"], 70), "catch": rng.choice([0.5, 3.0, 8.25, np.nan, np.inf], 70)})
    df = make(spark, "reef string, net string, catch double", *[(a, b, float(c)) for a, b, c in drawn.itertuples(index=False)])
    own = drawn.groupby(["reef", "net"])["catch"].agg(how)
    r = pivot.build_pivot_table(df, ["reef"], ["net"], value_column="catch", aggregation=how.upper())
    assert tidy(r) == pytest.approx(own.to_dict())
    assert r.cardinality.potential_cell_count == 6
    assert {(x["reef"], c): x[c] for x in r.table.collect() for c in ("n1", "n2")} == pytest.approx(own.to_dict())
    assert tidy(pivot.build_pivot_table(df, ["reef"])) == {(k,): n for k, n in drawn["reef"].value_counts().items()}


def test_pivot_of_groups_without_values(spark):
    df = make(spark, "reef string, net string, catch double", ("r8", "n1", NAN), ("r8", "n1", None), ("r9", "n2", 6.5))
    found = {how: tidy(pivot.build_pivot_table(df, "reef", value_column="catch", aggregation=how)) for how in ("sum", "count", "max")}
    assert found == {"sum": {("r8",): None, ("r9",): 6.5}, "count": {("r8",): 0, ("r9",): 1}, "max": {("r8",): None, ("r9",): 6.5}}
    assert {x["reef"]: (x["n1"], x["n2"]) for x in pivot.build_pivot_table(df, ["reef"], ["net"]).table.collect()} == {"r8": (2, None), "r9": (None, 1)}


def test_pivot_missing_and_guard(spark):
    df = column(spark, "depth", "double", NAN, 30.0, NAN, None, 12.5, 30.0)
    r = pivot.build_pivot_table(df, ["depth"])
    assert (r.excluded_dimension_row_count, r.group_count) == (3, 2)
    r = pivot.build_pivot_table(df, ["depth"], include_missing_dimensions=True)
    assert (r.excluded_dimension_row_count, r.group_count, tidy(r)[(None,)]) == (0, 3, 3)
    square = make(spark, "r string, c string", *[(a, b) for a in "jkl" for b in "uvwxy"])
    with pytest.raises(ValueError, match="too large: 15 potential cells exceeds the limit of 14"):
        pivot.build_pivot_table(square, ["r"], ["c"], max_cells=14)
    for call, error in (
        (lambda: pivot.build_pivot_table(square, []), ValueError), (lambda: pivot.build_pivot_table(square, ["r"], ["r"]), ValueError),
        (lambda: pivot.build_pivot_table(square, ["r"], aggregation="mode"), ValueError), (lambda: pivot.build_pivot_table(square, ["r"], aggregation=3), TypeError),
        (lambda: pivot.build_pivot_table(square, ["r"], value_column="c"), ValueError), (lambda: pivot.build_pivot_table(square, ["r"], aggregation="sum"), ValueError),
        (lambda: pivot.build_pivot_table(square, ["r"], aggregation="sum", value_column="c"), ValueError), (lambda: pivot.build_pivot_table(square, ["r"], max_cells=True), TypeError),
        (lambda: pivot.build_pivot_table(square, [1]), TypeError), (lambda: pivot.build_pivot_table(square, ["z"]), ValueError),
    ):
        with pytest.raises(error):
            call()


def drawn_numbers(n=60):
    """Four number columns with gaps, infinities, ties and a constant."""
    rng = np.random.default_rng(17)
    a = np.round(rng.normal(0, 2, n), 1)
    df = pd.DataFrame({"a": a, "b": np.round(a**3 + rng.normal(0, 4, n), 1), "c": rng.integers(0, 5, n).astype(float), "d": 2.5})
    df.loc[rng.random(n) < 0.2, "b"] = np.nan
    df.loc[rng.random(n) < 0.1, "c"] = np.inf
    return df


def numbers_table(spark, drawn):
    return make(spark, ", ".join(f"{c} double" for c in drawn), *[tuple(map(float, r)) for r in drawn.itertuples(index=False)])


@pytest.mark.parametrize("method", ["pearson", "SPEARMAN"])
def test_relationships(spark, method):
    drawn = drawn_numbers()
    df = numbers_table(spark, drawn)
    for x, y in (("a", "b"), ("c", "b"), ("a", "c")):
        whole = drawn[[x, y]].replace(np.inf, np.nan).dropna()
        r = relate.analyze_numeric_relationship(df, x, y, method=method)
        assert (r.valid_count, r.excluded_count, str(r.status)) == (len(whole), len(drawn) - len(whole), "ok")
        own = whole if method == "pearson" else whole.rank()
        assert r.coefficient == pytest.approx(own[x].corr(own[y]))
    assert str(relate.analyze_numeric_relationship(df, "d", "a", method=method).status) == "constant_input"
    short = relate.analyze_numeric_relationship(df, "d", "a", method=method, minimum_pairs=61)
    assert (str(short.status), short.coefficient) == ("insufficient_pairs", None)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_matrix(spark, method):
    drawn = drawn_numbers()
    m = relate.build_correlation_matrix(numbers_table(spark, drawn), list("abcd"), method=method)
    counts, values = m.dense("valid_count"), m.dense()
    finite = drawn.replace(np.inf, np.nan)
    own = finite.corr(method)
    for x in "abcd":
        for y in "abcd":
            assert counts[x][y] == finite[[x, y]].dropna().shape[0]
            assert values[x][y] == (None if "d" in (x, y) else pytest.approx(own[x][y]))
    best = sorted(((abs(own[x][y]), x, y) for x, y in combinations("abc", 2)), reverse=True)
    pairs = relate.strongest_correlations(m, top_n=9)
    assert [(p.x_column, p.y_column) for p in pairs] == [(x, y) for _, x, y in best]
    assert [p.absolute_coefficient for p in pairs] == pytest.approx([v for v, *_ in best])


def test_correlation_matrix_errors(spark):
    df = numbers_table(spark, drawn_numbers(4))
    for columns, error, text in (("ab", TypeError, "sequence"), (["c", "a", "c"], ValueError, "unique"), (["b"], ValueError, "two numeric")):
        with pytest.raises(error, match=text):
            relate.build_correlation_matrix(df, columns)


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_correlation_far_from_zero(spark, shift):
    """Sums of squares of large values would lose all digits; centred ones don't."""
    drawn = drawn_numbers()[["a", "c"]].replace(np.inf, 0) + shift
    r = relate.build_correlation_matrix(numbers_table(spark, drawn), ["a", "c"]).dense()
    assert r["a"]["c"] == pytest.approx(np.corrcoef(drawn["a"], drawn["c"])[0, 1], rel=1e-6)


def test_average_ranks(spark):
    values = np.random.default_rng(3).integers(0, 90, 700).astype(float)
    got = {r["v"]: r["rank"] for r in average_ranks(column(spark, "v", "double", *map(float, values)), "v").collect()}
    assert [got[v] for v in values] == pd.Series(values).rank().tolist()


def groups(spark, **values):
    return make(spark, "g string, v double", *[(g, float(v)) for g, own in values.items() for v in own])


def test_two_groups(spark):
    rng = np.random.default_rng(23)
    a, b = np.round(rng.normal(3, 1, 12), 2), np.round(rng.normal(4, 2, 9), 2)
    r = stats.compare_two_numeric_groups(groups(spark, wet=a, dry=b), "v", "g", "wet", "dry")
    sa, sb = a.var(ddof=1) / 12, b.var(ddof=1) / 9
    pooled = ((11 * a.var(ddof=1) + 8 * b.var(ddof=1)) / 19) ** 0.5
    assert (r.statistic, r.effect_size) == pytest.approx(((a.mean() - b.mean()) / (sa + sb) ** 0.5, (a.mean() - b.mean()) / pooled * (1 - 3 / 75)))
    assert r.p_value == pytest.approx(special.t_two_sided(r.statistic, (sa + sb) ** 2 / (sa**2 / 11 + sb**2 / 8)))
    assert (r.group_a_summary.mean, r.group_b_summary.mean) == pytest.approx((a.mean(), b.mean()))
    r = stats.compare_two_numeric_groups(groups(spark, wet=[0.5, 3, 4], dry=[9, 2, 8, 7], fog=[1, 1]), "v", "g", "wet", "dry", method="mann_whitney")
    assert (r.statistic, r.effect_size, r.source_row_count, r.selected_row_count) == (2, pytest.approx(2 * 2 / 12 - 1), 9, 7)
    assert r.p_value == pytest.approx(8 / 35)  # 1 + 1 + 2 of the 35 orders lie as low, and as many as high
    odd = groups(spark, A=[-INF, 6, NAN, INF], B=[NAN, 2.5])
    r = stats.compare_two_numeric_groups(odd, "v", "g", "A", "B", method="mann_whitney")
    assert (r.selected_row_count, r.used_row_count, r.excluded_value_row_count) == (6, 2, 4)
    same = stats.compare_two_numeric_groups(groups(spark, wet=[0.75] * 3, dry=[0.75] * 4), "v", "g", "wet", "dry")
    assert same.significant is None and same.effect_size is None
    for call, error in (
        (lambda: stats.compare_two_numeric_groups(odd, "v", "g", "A", "A"), ValueError), (lambda: stats.compare_two_numeric_groups(odd, "v", "g", "A", None), ValueError),
        (lambda: stats.compare_two_numeric_groups(odd, "v", "g", "A", []), TypeError), (lambda: stats.compare_two_numeric_groups(odd, "v", "g", "A", "B", alpha=True), TypeError),
        (lambda: stats.compare_two_numeric_groups(odd, "v", "g", "A", "B"), ValueError), (lambda: stats.compare_two_numeric_groups(odd, "g", "v", "A", "B"), ValueError),
    ):
        with pytest.raises(error):
            call()


def test_many_groups(spark):
    rng = np.random.default_rng(29)
    own = {g: np.round(rng.normal(m, 1, n), 1) for g, m, n in (("ash", 2, 7), ("elm", 3, 5), ("fir", 2.5, 9))}
    everything = np.concatenate(list(own.values()))
    between = sum(len(v) * (v.mean() - everything.mean()) ** 2 for v in own.values())
    within = sum(((v - v.mean()) ** 2).sum() for v in own.values())
    f = between / 2 / (within / 18)
    r = stats.compare_multiple_numeric_groups(groups(spark, **own), "v", "g", ["fir", "ash", "elm"])
    assert (r.statistic, r.p_value, r.effect_size) == pytest.approx((f, (1 + f / 9) ** -9.0, between / (between + within)))
    assert [s.group for s in r.group_summaries] == ["fir", "ash", "elm"]
    ranks = pd.Series(everything).rank()
    parts = np.split(ranks.to_numpy(), np.cumsum([len(v) for v in own.values()])[:-1])
    ties = sum(k**3 - k for k in pd.Series(everything).value_counts())
    h = (12 / (21 * 22) * sum(p.sum() ** 2 / len(p) for p in parts) - 3 * 22) / (1 - ties / (21**3 - 21))
    r = stats.compare_multiple_numeric_groups(groups(spark, **own), "v", "g", ["ash", "elm", "fir"], method="kruskal_wallis")
    assert (r.statistic, r.p_value, r.effect_size) == pytest.approx((h, exp(-h / 2), max(0, (h - 2) / 18)))
    with pytest.raises(ValueError, match="Kruskal-Wallis could not be computed"):
        stats.compare_multiple_numeric_groups(groups(spark, A=[1, 1], B=[1]), "v", "g", ["A", "B"], method="kruskal_wallis")


def test_association(spark):
    table = {("calm", "in"): 9, ("calm", "out"): 3, ("gale", "in"): 2, ("gale", "out"): 10}
    rows = [pair for pair, n in table.items() for _ in range(n)]
    r = stats.analyze_categorical_association(make(spark, "s string, o string", *rows, ("calm", None), (None, None)), "s", "o")
    q = 24 * (9 * 10 - 3 * 2) ** 2 / (12 * 12 * 11 * 13)
    assert (r.statistic, r.degrees_of_freedom, r.cramers_v) == pytest.approx((q, 1, (q / 24) ** 0.5)) and r.p_value == pytest.approx(erfc((q / 2) ** 0.5))
    assert (r.excluded_missing_row_count, r.expected_below_five_count, r.minimum_expected_frequency) == (2, 0, 5.5)
    with pytest.raises(ValueError, match="Contingency table is too large"):
        stats.analyze_categorical_association(make(spark, "s string, o string", *rows), "s", "o", max_cells=3)


def test_special_functions():
    for n1, n2 in ((1, 4), (3, 5)):
        us = [sum(x < y for x in set(range(n1 + n2)) - set(c) for y in c) for c in combinations(range(n1 + n2), n2)]
        for u in range(n1 * n2 + 1):
            high = max(u, n1 * n2 - u)
            assert special.mann_whitney_exact(u, n1, n2) == pytest.approx(min(1, 2 * sum(x >= high for x in us) / len(us)))
    for t in (0.3, 1.7, 6.0):
        assert special.t_two_sided(t, 1) == pytest.approx(1 - 2 * atan(t) / pi)
        assert special.t_two_sided(t, 2) == pytest.approx(1 - t / (2 + t * t) ** 0.5)
        for d in (2, 7, 40):
            assert special.f_above(t, 2, d) == pytest.approx((1 + 2 * t / d) ** (-d / 2))
    for x in (0.1, 1.0, 5.0, 40.0):
        assert special.chi2_above(x, 2) == pytest.approx(exp(-x / 2))
        assert special.chi2_above(x, 4) == pytest.approx(exp(-x / 2) * (1 + x / 2))
        assert special.chi2_above(x, 1) == pytest.approx(erfc((x / 2) ** 0.5))


def hours(spark, *at):
    return with_ordinal(make(spark, "t timestamp_ntz", *[(datetime(2026, 1, 1) + timedelta(hours=h),) for h in at]).coalesce(1))


def test_axis(spark):
    df = make(spark, "sighted string, clock string", ("1911-12-14", "15:00:09"), ("1911-12-14", None), ("1911-13-14", "15:00:09"), ("1912-01-17", "24:00:00"))
    a = temporal.prepare_temporal_axis(df, "sighted", date_format="%Y-%m-%d", time_column="clock", time_format="%H:%M:%S")
    assert (a.valid_count, a.invalid_count) == (1, 3)
    assert {r["timestamp"] for r in a.data.collect()} == {datetime(1911, 12, 14, 15, 0, 9), None}
    only = temporal.prepare_temporal_axis(df, "sighted", date_format="%Y-%m-%d")
    assert (only.valid_count, only.invalid_count) == (3, 1)
    with pytest.raises(ValueError, match="date_format is required"):
        temporal.prepare_temporal_axis(df, "sighted")
    with pytest.raises(ValueError, match="must be different"):
        temporal.prepare_temporal_axis(df, "sighted", date_format="%Y", time_column="sighted")


def test_sampling_and_gaps(spark):
    at = [0, 0, 5, 10, 10, 10, 15, 38, 43, 48]
    for order, is_sorted in ((at, True), ([*at[3:], *at[:3]], False)):
        s = temporal.analyze_temporal_sampling(temporal.prepare_temporal_axis(hours(spark, *order), "t"))
        assert (s.unique_timestamp_count, s.duplicate_row_count, s.duplicate_timestamp_count, s.is_chronologically_sorted) == (7, 3, 2, is_sorted)
        assert (s.dominant_interval, s.dominant_interval_count, s.dominant_interval_ratio) == (timedelta(hours=5), 5, 5 / 6)
        assert (s.maximum_interval, s.span) == (timedelta(hours=23), timedelta(hours=48))
    g = temporal.detect_time_gaps(temporal.prepare_temporal_axis(hours(spark, *at), "t"), "5h")
    assert [(x.duration, x.excess_duration) for x in g.gaps] == [(timedelta(hours=23), timedelta(hours=18))]
    assert temporal.interval_of("3D") == timedelta(days=3) and temporal.interval_of("2h 5min") == timedelta(minutes=125)
    for bad, error in ((True, TypeError), (5, TypeError), ("x", ValueError), ("0h", ValueError), (timedelta(0), ValueError)):
        with pytest.raises(error):
            temporal.interval_of(bad)


def test_series_and_buckets(spark):
    rng = np.random.default_rng(37)
    at = [datetime(2011, 2, 25) + timedelta(minutes=int(m)) for m in rng.choice(60_000, 90, replace=False)]
    drawn = pd.DataFrame({"t": at, "v": rng.choice([0.5, 4.0, 9.5, np.nan, np.inf], 90)})
    axis = temporal.prepare_temporal_axis(make(spark, "t timestamp_ntz, v double", *[(t, float(v)) for t, v in zip(at, drawn["v"], strict=True)]), "t")
    whole = drawn[np.isfinite(drawn["v"])].sort_values("t")
    s = temporal.prepare_temporal_numeric_series(axis, "v")
    assert ([r["value"] for r in s.data.collect()], s.excluded_count) == (whole["v"].tolist(), 90 - len(whole))
    for frequency, start in (("day", "D"), ("WEEK", "W-SUN"), ("month", "M")):
        own = whole.groupby(whole["t"].dt.to_period(start).dt.start_time)["v"].agg(["mean", "count"])
        rows = temporal.aggregate_temporal_numeric_series(axis, "v", frequency=frequency, aggregation="mean").data.collect()
        assert [r["bucket"] for r in rows] == list(own.index.to_pydatetime())
        assert [(r["value"], r["count"]) for r in rows] == [(pytest.approx(m), n) for m, n in own.itertuples(index=False)]
    with pytest.raises(ValueError, match="Unsupported temporal frequency"):
        temporal.aggregate_temporal_numeric_series(axis, "v", frequency="year")


class Named(BytesIO):
    def __init__(self, text: str, name: str | None):
        super().__init__(text.encode())
        if name:
            self.name = name


def test_csv(spark, tmp_path):
    df = reader.read_dataset(spark, Named("berth,draught,pilot\nN4,11,yes\nS2,9,\nS2,,no\n", "port.csv"))
    assert (df.dtypes[0], df.columns, df.count()) == (("berth", "string"), ["berth", "draught", "pilot"], 3)
    text = "moored;at;m(LAT);tide\n28/02/1999;06.10.00;1,25;-0,5\n01/03/1999;07.45.30;3,0;0,75\n"
    row = reader.read_dataset(spark, Named(text, "TIDES.CSV")).first()
    assert (row["m(LAT)"], row["tide"], row["moored"], row["at"]) == (1.25, -0.5, "28/02/1999", "06.10.00")
    df = reader.read_dataset(spark, Named("berth;;m(LAT);\nN4;;1,25;\nN5;;0,5;\n", "gaps.csv"))
    assert df.columns == ["berth", "Unnamed: 1", "m(LAT)", "Unnamed: 3"] and tuple(df.first()) == ("N4", None, 1.25, None)
    path = tmp_path / "b.csv"
    path.write_bytes("a|a|b\n1|x|NA\n2|\"y|z\"|TRUE\n".encode("latin-1"))
    df = reader.read_dataset(spark, str(path))
    assert df.columns == ["a", "a.1", "b"] and [tuple(r) for r in df.collect()] == [(1, "x", None), (2, "y|z", True)]


@pytest.mark.parametrize(
    ("source", "error"),
    [
        (Named("<t/>", "tides.xml"), UnsupportedFileTypeError), (Named("berth;pilot;tide\n", "port.csv"), EmptyDatasetError),
        (Named("m;n\n5;6\n", None), DatasetReadError), (Named("", "a.csv"), DatasetReadError), (Named("not a book", "port.xlsx"), DatasetReadError),
        (Named("m;n\n5;6\n5;6;7;8\n", "port.csv"), DatasetReadError),
    ],
)
def test_reader_errors(spark, source, error):
    with pytest.raises(error):
        reader.read_dataset(spark, source)


def test_xlsx(spark):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = lambda *c: "<row>" + "".join(c) + "</row>"
    s = lambda k: f'<c t="s"><v>{k}</v></c>'
    sheet = cells(s(0), s(1), s(4)) + cells(s(2), "<c><v>64</v></c>", '<c s="1"><v>0.75</v></c>') + cells(s(3), "<c><v>58</v></c>", '<c s="1"><v>0.5</v></c>')
    book = BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{x}</t></si>" for x in ("ship", "draught", "Alba", "Brent", "due")) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="21"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
    for name in (0, "One"):
        df = reader.read_dataset(spark, BytesIO(book.getvalue()), "ships.xlsx", sheet_name=name)
        assert [tuple(r) for r in df.collect()] == [("Alba", 64, "18:00:00"), ("Brent", 58, "12:00:00")]
    assert len(reader.fingerprint(book.getvalue())) == 64


def test_streaming_buckets(spark, tmp_path):
    from tabscope.streaming.buckets import streaming_buckets

    rows = make(spark, "ts timestamp_ntz, v double", (datetime(2026, 1, 1, 1, 5), 1.0), (datetime(2026, 1, 1, 1, 50), 3.0), (datetime(2026, 1, 1, 2), NAN))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming_buckets(stream, "ts", "v").writeStream.format("memory").queryName("buckets").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("buckets").collect()] == [(datetime(2026, 1, 1, 1), 2.0, 2)]


def test_shared_places_of_the_source(spark):
    assert with_ordinal(with_ordinal(spark.range(3))).agg(F.count_distinct("_ordinal")).first()[0] == 3


def test_pivot_keeps_missing_apart_from_its_label(spark):
    """A text that reads as the label of missing values has a column of its own."""
    df = spark.createDataFrame([("a", None, 1), ("a", "(missing)", 10), ("a", "\\(missing)", 100)], "g string, c string, v int")
    r = pivot.build_pivot_table(df, ["g"], ["c"], value_column="v", aggregation="sum", include_missing_dimensions=True)
    assert sorted(r.table.collect()[0][1:]) == [1, 10, 100]


def test_streaming_weeks_in_append_mode(spark, tmp_path):
    """Weeks start on Monday and are given out once the watermark has passed them."""
    from tabscope.streaming.buckets import streaming_buckets

    days = [(datetime(2026, 1, 1), 1.0), (datetime(2026, 1, 4, 23), 3.0), (datetime(2026, 1, 5), 5.0), (datetime(2026, 2, 1), 7.0)]
    rows = spark.createDataFrame(days, "ts timestamp, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming_buckets(stream, "ts", "v", "week").writeStream.format("memory").queryName("weeks").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("weeks").collect()) == [(datetime(2025, 12, 29), 2.0, 2), (datetime(2026, 1, 5), 5.0, 1)]


def test_sampling_reads_the_axis_a_few_times(spark):
    """Timestamps and steps are counted once, for the summary and the dominant step alike."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    ids = spark.range(2000).repartition(2).mapInArrow(seen, "id long")
    axis = ids.select(F.col("id").alias("_ordinal"), F.timestamp_micros(F.col("id") * 1000 + F.when(F.col("id") > 1000, 5).otherwise(0)).cast("timestamp_ntz").alias("ts"))
    s = temporal.analyze_temporal_sampling(temporal.prepare_temporal_axis(axis, "ts"))
    assert (s.unique_timestamp_count, s.interval_count, s.dominant_interval_count, s.is_chronologically_sorted) == (2000, 1999, 1998, True)
    assert (s.median_interval.microseconds, s.maximum_interval.microseconds) == (1000, 1005)
    assert read.value <= 4 * 2000
