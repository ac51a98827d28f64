"""Correlation matrices with gaps, ties and constant columns, against pandas."""

import numpy as np
import pandas as pd
import pytest

from tabscope.functions import gram, ranks
from tabscope.operators import relate
from tabscope.operators.records import CorrelationMethod


def drawn(seed, n=700):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=n)
    data = pd.DataFrame(
        {
            "a": base + rng.normal(size=n), "b": 1e9 + base, "c": rng.integers(0, 4, n).astype(float), "d": np.exp(5 * base), "flat": 2.5,
            "hot": np.where(rng.random(n) < 0.8, 0.0, base), "few": np.where(rng.random(n) < 0.003, base, np.nan), "none": np.nan,
        }
    )
    gap = rng.random(n) < 0.2
    data.loc[gap, ["b", "c"]] = np.nan  # gaps in the same rows
    data.loc[rng.random(n) < 0.3, "d"] = np.nan
    data.loc[rng.random(n) < 0.5, "flat"] = 2.5
    return data


@pytest.mark.parametrize("method", ["pearson", "spearman"])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_pandas(spark, method, seed):
    data = drawn(seed)
    columns = list(data.columns)
    frame = spark.createDataFrame(data.astype(object).where(data.notna(), None), ", ".join(f"{c} double" for c in columns)).repartition(4)
    found = {(r["x_column"], r["y_column"]): (r["coefficient"], r["valid_count"]) for r in relate.matrix_cells(frame, columns, CorrelationMethod(method)).collect()}
    assert len(found) == len(columns) ** 2
    for x in columns:
        for y in columns:
            both = data[[x, y]].dropna() if x != y else data[[x]].dropna()
            told = len(both) >= 3 and all(both[c].nunique() > 1 for c in both)
            want = (1.0 if x == y else (both[x].rank().corr(both[y].rank()) if method == "spearman" else both[x].corr(both[y]))) if told else None
            coefficient, n = found[x, y]
            assert n == len(both)
            assert (coefficient is None) == (want is None), (x, y)
            assert want is None or coefficient == pytest.approx(want, abs=1e-7)


def test_blocks_merge(monkeypatch):
    x = drawn(5, 300)[["a", "b", "d", "few"]].to_numpy()
    whole = gram.block_moments(x)
    parts = gram.block_moments(x[:7])
    for k in range(7, 300, 31):
        parts = gram.merged(parts, gram.block_moments(x[k : k + 31]))
    for a, b in zip(whole, parts, strict=True):
        a, b = (np.where(whole[0] > 0, m, 0) for m in (a, b))  # nothing is said of pairs without rows
        np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-6)


def test_many_columns_are_one_aggregate(spark):
    frame = spark.range(2000).selectExpr(*[f"cast(hash(id, {k}) as double) AS c{k}" for k in range(50)])
    cells = relate.matrix_cells(frame, frame.columns, CorrelationMethod.PEARSON)
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    found = cells.where("x_column = 'c3' and y_column = 'c40'").first()
    assert found["coefficient"] == pytest.approx(frame.toPandas().corr().loc["c3", "c40"], abs=1e-12)


def test_ranks_of_series(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), s, float(rng.choice([1.0, 1.0, 2.0, rng.normal()]))) for s in range(3) for k in range(800)]
    data = spark.createDataFrame(rows, "row long, s int, x double").repartition(3)
    found = {(r["row"], r["s"]): r["rank"] for r in ranks.ranked_series(data, 3).collect()}
    for s in range(3):
        own = pd.Series({k: x for k, t, x in rows if t == s}).rank()
        assert all(found[k, s] == own[k] for k in own.index)


@pytest.mark.parametrize(("small", "spread"), [(0, 3), (0, 10**6), (10**6, 3)])
def test_ranks_reach_rows_by_value(spark, monkeypatch, small, spread):
    """By broadcast and by a join in tasks of a bounded size, frequent values and gaps among them."""
    for name, value in (("SMALL", small), ("SPREAD", spread), ("JOINED", 100)):
        monkeypatch.setattr(ranks, name, value)
    data = drawn(3)[["a", "b", "d"]].round(1)
    frame = spark.createDataFrame(data.astype(object).where(data.notna(), None), "a double, b double, d double").repartition(3)
    made = relate.ranked(frame, ["a", "b", "d"], [(0, 0), (0, 1), (1, 2)])
    assert made.count() == len(data)
    both = data.dropna(subset=["b", "d"])
    want = [data["a"].rank(), data.dropna(subset=["a", "b"])["a"].rank(), both["b"].rank()]
    for s, own in enumerate(want):
        assert sorted(r[0] for r in made.select(f"r{s}").dropna().collect()) == sorted(own.dropna())
