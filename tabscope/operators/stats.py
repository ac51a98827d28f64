"""Tests of groups and of association.  Spark aggregates; the driver does the last arithmetic."""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from math import inf, isfinite, nan, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions import special
from tabscope.functions.ranks import average_ranks
from tabscope.functions.selection import with_medians
from tabscope.functions.values import family_of, finite, is_missing, present, require_column
from tabscope.operators.records import (
    CategoricalAssociation,
    MultiGroupComparison,
    MultiGroupMethod,
    NumericGroupSummary,
    TwoGroupComparison,
    TwoGroupMethod,
)
from tabscope.operators.transform import matches

#: Rows of the smaller group up to which the exact distribution of U is used.
EXACT_ROWS = 8


def check_alpha(alpha: object) -> None:
    if isinstance(alpha, bool) or not isinstance(alpha, (int, float)):
        raise TypeError("alpha must be numeric.")
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1.")


# The argument names and error texts of the checks below, which callers see.
def method_of(value: object, kind: type):
    own = "two-group" if kind is TwoGroupMethod else "multi-group"
    if not isinstance(value, str):
        raise TypeError(f"{own.capitalize()} method must be a string or {kind.__name__}.")
    try:
        return kind(value.lower())
    except ValueError:
        raise ValueError(f"Unsupported {own} method: {value!r}.") from None


def check_group(value: object, name: str) -> None:
    if not isinstance(value, Hashable):
        raise TypeError(f"{name} must be hashable.")
    if value is None or value != value:
        raise ValueError(f"{name} must not be missing.")


def check_columns(df: DataFrame, value: str, group: str) -> None:
    require_column(df, value)
    require_column(df, group)
    if value == group:
        raise ValueError("Analysis columns must be distinct.")
    if family_of(df, value) != "number":
        raise ValueError(f"Column {value!r} must be numeric and non-boolean.")


def selected(df: DataFrame, value: str, group: str, groups: Sequence[object]) -> DataFrame:
    """(g, x) of the rows in the groups: the group's place, and the finite number or null."""
    place = F.coalesce(*[F.when(matches(df, group, g), F.lit(k)) for k, g in enumerate(groups)])
    return df.select(place.alias("g"), finite(df, value).alias("x")).where("g is not null")


def group_frame(rows: DataFrame) -> DataFrame:
    own = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("selected"), F.count("x").alias("n"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("sd"), F.var_samp("x").alias("var"), F.min("x").alias("low"), F.max("x").alias("high"),
    )
    return with_medians(own, rows, ["g"], "x", "median")


def summary_frame(df: DataFrame, value: str, group: str) -> DataFrame:
    """Count, mean, median, deviation, least and greatest finite value of every group."""
    rows = df.select(present(df, group).alias("group"), finite(df, value).alias("x")).where("group is not null and x is not null")
    own = rows.groupBy("group").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("standard_deviation"),
        F.min("x").alias("minimum"), F.max("x").alias("maximum"),
    )
    both = with_medians(own, rows, ["group"], "x", "median")
    return both.select("group", "count", "mean", "median", "standard_deviation", "minimum", "maximum")


def rank_sums(rows: DataFrame) -> DataFrame:
    """For each group the number and rank sum of its values among all groups'; and ``tied``, the sum of t^3 - t."""
    own = rows.where("x is not null")
    ranks = average_ranks(own.select("x"), "x")
    tied = ranks.agg(F.coalesce(F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")), F.lit(0.0)).alias("tied"))
    counts = own.groupBy("g", "x").agg(F.count(F.lit(1)).alias("k"))
    sums = counts.join(ranks, "x").groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("rank_sum"))
    return sums.join(F.broadcast(tied))


def summaries(stats: dict, groups: Sequence[object]) -> tuple[NumericGroupSummary, ...]:
    out = []
    for k, g in enumerate(groups):
        r = stats.get(k)
        if r is None or not r["n"]:
            raise ValueError(f"Group {g!r} has no finite numeric observations.")
        out.append(NumericGroupSummary(g, r["n"], r["mean"], r["median"], r["sd"], r["low"], r["high"]))
    return tuple(out)


def welch(a, b) -> tuple[float, float, float]:
    """t, degrees of freedom and two-sided p of (n, mean, var) rows."""
    va, vb = a["var"] / a["n"], b["var"] / b["n"]
    gap = a["mean"] - b["mean"]
    if va + vb == 0:
        t = nan if gap == 0 else gap / abs(gap) * inf
        return t, nan, nan if gap == 0 else 0.0
    t = gap / sqrt(va + vb)
    df = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    return t, df, special.t_two_sided(t, df)


def hedges_g(a, b) -> float | None:
    na, nb = a["n"], b["n"]
    if na < 2 or nb < 2:
        return None
    df = na + nb - 2
    pooled = ((na - 1) * a["var"] + (nb - 1) * b["var"]) / df
    if not isfinite(pooled) or pooled <= 0:
        return None
    return (a["mean"] - b["mean"]) / sqrt(pooled) * (1 - 3 / (4 * df - 1))


def mann_whitney(rank_sum: float, n1: int, n2: int, tied: float) -> tuple[float, float]:
    """U of the first group and its two-sided p."""
    u = rank_sum - n1 * (n1 + 1) / 2
    if min(n1, n2) <= EXACT_ROWS and not tied:
        return u, special.mann_whitney_exact(u, n1, n2)
    n = n1 + n2
    spread = sqrt(n1 * n2 / 12 * (n + 1 - tied / (n * (n - 1))))
    high = max(u, n1 * n2 - u)
    if not spread:
        return u, 1.0
    return u, min(1.0, 2 * special.normal_above((high - n1 * n2 / 2 - 0.5) / spread))


def significance(p: float, alpha: float) -> bool | None:
    return p < alpha if isfinite(p) else None


def compare_two_numeric_groups(
    df: DataFrame, value_column: str, group_column: str, group_a: object, group_b: object, *, method="welch_t", alpha: float = 0.05
) -> TwoGroupComparison:
    how = method_of(method, TwoGroupMethod)
    check_alpha(alpha)
    check_columns(df, value_column, group_column)
    check_group(group_a, "group_a")
    check_group(group_b, "group_b")
    if group_a == group_b:
        raise ValueError("group_a and group_b must be different.")
    rows = selected(df, value_column, group_column, (group_a, group_b))
    stats = {r["g"]: r for r in group_frame(rows).collect()}
    n = [stats[k]["n"] if k in stats else 0 for k in (0, 1)]
    if how is TwoGroupMethod.WELCH_T:
        if min(n) < 2:
            raise ValueError("Welch's t-test requires at least two finite observations in each selected group.")
        statistic, _, p = welch(stats[0], stats[1])
        name, effect = "hedges_g", hedges_g(stats[0], stats[1])
    else:
        if min(n) < 1:
            raise ValueError("Mann-Whitney U requires at least one finite observation in each selected group.")
        first = next(r for r in rank_sums(rows).collect() if r["g"] == 0)
        statistic, p = mann_whitney(first["rank_sum"], *n, first["tied"])
        name, effect = "rank_biserial", max(-1.0, min(1.0, 2 * statistic / (n[0] * n[1]) - 1))
    a, b = summaries(stats, (group_a, group_b))
    chosen, used = sum(r["selected"] for r in stats.values()), sum(n)
    return TwoGroupComparison(
        value_column, group_column, group_a, group_b, how, alpha, df.count(), chosen, used, chosen - used, a, b,
        statistic, p, significance(p, alpha), name, effect,
    )


def anova(stats: Sequence) -> tuple[float, float, float | None]:
    """F, p and eta squared of (n, mean, var) rows."""
    total, k = sum(r["n"] for r in stats), len(stats)
    mean = sum(r["n"] * r["mean"] for r in stats) / total
    between = sum(r["n"] * (r["mean"] - mean) ** 2 for r in stats)
    within = sum((r["n"] - 1) * (r["var"] or 0.0) for r in stats)
    if within:
        f = (between / (k - 1)) / (within / (total - k))
    else:
        f = inf if between else nan
    return f, special.f_above(f, k - 1, total - k), between / (between + within) if between + within > 0 else None


def kruskal(sums: Sequence, tied: float) -> tuple[float, float, float | None]:
    """H, p and epsilon squared of (n, rank_sum) rows."""
    total, k = sum(r["n"] for r in sums), len(sums)
    correction = 1 - tied / (total**3 - total) if total > 1 else 0.0
    if correction <= 0:
        raise ValueError("Kruskal-Wallis could not be computed for the selected observations.")
    h = (12 / (total * (total + 1)) * sum(r["rank_sum"] ** 2 / r["n"] for r in sums) - 3 * (total + 1)) / correction
    effect = max(0.0, min(1.0, (h - k + 1) / (total - k))) if total > k else None
    return h, special.chi2_above(h, k - 1), effect


def compare_multiple_numeric_groups(
    df: DataFrame, value_column: str, group_column: str, group_values: Sequence[object], *, method="one_way_anova", alpha: float = 0.05
) -> MultiGroupComparison:
    how = method_of(method, MultiGroupMethod)
    check_alpha(alpha)
    check_columns(df, value_column, group_column)
    groups = tuple(group_values)
    for g in groups:
        check_group(g, "group_values")
    if len(groups) < 2:
        raise ValueError("At least two group values are required.")
    if len(set(groups)) != len(groups):
        raise ValueError("group_values must not contain duplicates.")
    rows = selected(df, value_column, group_column, groups)
    stats = {r["g"]: r for r in group_frame(rows).collect()}
    n = [stats[k]["n"] if k in stats else 0 for k in range(len(groups))]
    if how is MultiGroupMethod.ONE_WAY_ANOVA:
        if min(n) < 2:
            raise ValueError("One-way ANOVA requires at least two finite observations in every selected group.")
        statistic, p, effect = anova([stats[k] for k in range(len(groups))])
        name = "eta_squared"
    else:
        if min(n) < 1:
            raise ValueError("Kruskal-Wallis requires at least one finite observation in every selected group.")
        sums = rank_sums(rows).collect()
        statistic, p, effect = kruskal(sums, sums[0]["tied"])
        name = "epsilon_squared"
    chosen, used = sum(r["selected"] for r in stats.values()), sum(n)
    return MultiGroupComparison(
        value_column, group_column, groups, how, alpha, df.count(), chosen, used, chosen - used, summaries(stats, groups),
        statistic, p, significance(p, alpha), name, effect,
    )


def crosstab_frame(df: DataFrame, row: str, column: str) -> DataFrame:
    """Every observed pair of levels with its count, its margins and what is expected; complete rows only."""
    pairs = df.where(~is_missing(df, row) & ~is_missing(df, column)).select(present(df, row).alias("row"), present(df, column).alias("column"))
    counts = pairs.groupBy("row", "column").agg(F.count(F.lit(1)).alias("observed"))
    rows = counts.groupBy("row").agg(F.sum("observed").alias("row_total"))
    columns = counts.groupBy("column").agg(F.sum("observed").alias("column_total"))
    total = counts.agg(F.sum("observed").alias("total"))
    met = counts.join(rows, "row").join(columns, "column").join(F.broadcast(total))  # one row
    expected = F.col("row_total") * F.col("column_total") / F.col("total")
    return met.select("row", "column", "observed", expected.alias("expected"), "row_total", "column_total", "total")


def full_crosstab(cells: DataFrame) -> DataFrame:
    """All pairs of levels, those never observed with a count of 0; for tables within the cell guard."""
    rows, columns = (cells.groupBy(c).agg(F.first(f"{c}_total").alias("n")).withColumnRenamed("n", f"{c}_n") for c in ("row", "column"))
    total = cells.agg(F.first("total").alias("total"))
    every = rows.crossJoin(columns).join(cells.select("row", "column", "observed"), ["row", "column"], "left").join(F.broadcast(total))
    expected = F.col("row_n") * F.col("column_n") / F.col("total")
    return every.select("row", "column", F.coalesce("observed", F.lit(0)).alias("observed"), expected.alias("expected"))


def chi_square_frame(cells: DataFrame) -> DataFrame:
    """One row over all pairs of levels: rows, columns, n, statistic, least (expected at least) and below (expected under 5).

    Pairs never observed aren't listed.  Each adds what is expected of it, so together they
    add what the observed ones leave of the total; the least expected is that of the smallest
    margins; and pairs under 5 are counted for each row total over running counts of column
    totals, as many as there are distinct totals.
    """
    sides = [cells.groupBy(F.col(c).alias("level")).agg(F.first(f"{c}_total").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("k")) for c in ("row", "column")]
    ends = [s.agg(F.sum("k").alias(f"{c}s"), F.min("m").alias(f"{c}_m")) for s, c in zip(sides, ("row", "column"), strict=True)]
    gap = F.col("observed") - F.col("expected")
    sums = cells.agg(F.sum("observed").alias("n"), F.sum(gap * gap / F.col("expected")).alias("seen"), F.sum("expected").alias("covered"))
    one = sums.join(F.broadcast(ends[0])).join(F.broadcast(ends[1]))  # one row each
    # column totals under 5 n / m, for each row total m: whole numbers, so counted up to the last below it
    limit = F.ceil(5 * F.col("n") / F.col("m")) - 1
    marks = sides[0].join(F.broadcast(sums.select("n"))).select(limit.alias("at"), F.col("k").alias("rows"), F.lit(0).cast("long").alias("columns"))
    line = marks.union(sides[1].select("m", F.lit(0).cast("long"), "k"))
    upto = F.sum("columns").over(Window.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    below = line.withColumn("upto", upto).agg(F.coalesce(F.sum(F.col("rows") * F.col("upto")), F.lit(0)).alias("below"))
    return one.join(F.broadcast(below)).select(
        "rows", "columns", "n", (F.col("seen") + F.greatest(F.lit(0.0), F.col("n") - F.col("covered"))).alias("statistic"),
        (F.col("row_m") * F.col("column_m") / F.col("n")).alias("least"), "below",
    )


def analyze_categorical_association(df: DataFrame, row_column: str, column_column: str, *, alpha: float = 0.05, max_cells: int = 400) -> CategoricalAssociation:
    check_alpha(alpha)
    if isinstance(max_cells, bool) or not isinstance(max_cells, int):
        raise TypeError("max_cells must be an integer.")
    if max_cells < 1:
        raise ValueError("max_cells must be at least 1.")
    require_column(df, row_column)
    require_column(df, column_column)
    if row_column == column_column:
        raise ValueError("Analysis columns must be distinct.")
    complete = ~is_missing(df, row_column) & ~is_missing(df, column_column)
    total, used, rows, columns = df.agg(
        F.count(F.lit(1)), F.count_if(complete),
        F.count_distinct(F.when(complete, present(df, row_column))), F.count_distinct(F.when(complete, present(df, column_column))),
    ).first()
    if not used:
        raise ValueError("No complete categorical observations are available.")
    if rows < 2 or columns < 2:
        raise ValueError("Chi-square association requires at least two observed levels in each selected column.")
    if rows * columns > max_cells:
        raise ValueError(f"Contingency table is too large: {rows * columns:,} potential cells exceeds the limit of {max_cells:,}.")
    cells = crosstab_frame(df, row_column, column_column)
    full, r = full_crosstab(cells), chi_square_frame(cells).first()
    dof, size = (rows - 1) * (columns - 1), rows * columns
    p = special.chi2_above(r["statistic"], dof)
    strength = sqrt(r["statistic"] / (used * min(rows - 1, columns - 1)))
    return CategoricalAssociation(
        row_column, column_column, alpha, total, used, total - used, rows, columns, size, r["statistic"], dof, p,
        significance(p, alpha), strength, r["least"], r["below"], r["below"] / size,
        full.select("row", "column", "observed"), full.select("row", "column", "expected"),
    )


def is_sparse(result: CategoricalAssociation) -> bool:
    """Whether the chi-square approximation is doubtful."""
    return result.minimum_expected_frequency < 1 or result.expected_below_five_ratio > 0.20
