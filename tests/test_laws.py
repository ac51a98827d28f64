"""The exact rank-sum law, steps between timestamps of one day, and chi-square without absent cells."""

import random
import time
from datetime import datetime, timedelta
from itertools import combinations
from math import comb

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.functions import special
from tabscope.operators import stats, temporal


def ways(n1, n2):
    """Of each U, by products of lists."""
    out = [1]
    for k in range(1, n1 + 1):
        top = [0] * (len(out) + n2 + k)
        for i, w in enumerate(out):
            top[i] += w
            top[i + n2 + k] -= w
        for i in range(k, len(top)):
            top[i] += top[i - k]
        out = top[: n2 * k + 1]
    return out


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (1, 9), (2, 5), (3, 4), (5, 30), (8, 8), (8, 41)])
def test_partitions(n1, n2):
    held, total = ways(n1, n2), 0
    for u, w in enumerate(held):
        total += w
        assert special.bounded_partitions(u, n1, n2) == total
    assert special.bounded_partitions(n1 * n2 + 7, n1, n2) == comb(n1 + n2, n1)


def test_exact_law():
    us = [sum(r) - 6 for r in combinations(range(1, 9), 3)]
    for u in range(16):
        low = min(u, 15 - u)
        assert special.mann_whitney_exact(u, 3, 5) == pytest.approx(min(1, 2 * sum(x <= low for x in us) / len(us)))
        assert special.mann_whitney_exact(u, 3, 5) == special.mann_whitney_exact(u, 5, 3)


def test_exact_law_of_many_rows():
    """The larger group costs nothing; the law nears the normal one."""
    began = time.perf_counter()
    n = 10**9
    mean, spread = 4 * n, (8 * n * (n + 9) / 12) ** 0.5
    assert special.mann_whitney_exact(round(mean - 1.5 * spread), 8, n) == pytest.approx(2 * special.normal_above(1.5), rel=0.05)
    assert time.perf_counter() - began < 2


@pytest.mark.parametrize("seed", [1, 2])
def test_steps(spark, seed):
    rng = random.Random(seed)
    start = datetime(2024, 3, 1)
    within = [start + timedelta(microseconds=rng.randrange(86_400_000_000)) for _ in range(3000)]  # a day
    rows = within + within[:50] + [None] + [start + timedelta(days=rng.randrange(-900, 900), seconds=rng.randrange(86_400)) for _ in range(60)]
    axis = spark.createDataFrame([(t,) for t in rows], "timestamp timestamp_ntz").repartition(3)
    found = sorted((r["start"], r["end"], r["duration"]) for r in temporal.steps_frame(axis).collect())
    at = sorted({t for t in rows if t})
    assert found == [(a, b, (b - a) // timedelta(microseconds=1)) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert temporal.steps_frame(axis.where("timestamp is null")).collect() == []


def test_one_day_is_many_stretches(spark):
    """No stretch of a single day's timestamps is more than a small part of them."""
    axis = spark.range(20_000).select(F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(86_400_000_000))).cast("timestamp_ntz").alias("timestamp"))
    steps = temporal.steps_frame(axis)
    assert "cell" in steps._jdf.queryExecution().analyzed().toString()
    at = temporal.placed_frame(axis).groupBy("day", "cell").count().agg(F.max("count")).first()[0]
    assert at < 20_000 / 50


@pytest.mark.parametrize("seed", [3, 4])
def test_chi_square(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{int(rng.paretovariate(0.6)) % 60}", rng.randrange(40) if rng.random() < 0.9 else None) for _ in range(900)]
    cells = stats.crosstab_frame(spark.createDataFrame(rows, "r string, c int"), "r", "c")
    data = pd.DataFrame(rows, columns=["r", "c"]).dropna()
    observed = pd.crosstab(data["r"], data["c"])
    expected = pd.DataFrame({c: observed.sum(axis=1) * observed[c].sum() / len(data) for c in observed})
    found = stats.chi_square_frame(cells).first()
    assert (found["rows"], found["columns"], found["n"]) == (*observed.shape, len(data))
    assert found["statistic"] == pytest.approx(float((((observed - expected) ** 2) / expected).sum().sum()))
    assert found["least"] == pytest.approx(float(expected.min().min()))
    assert found["below"] == int((expected < 5).sum().sum())
    full = {(r["row"], r["column"]): (r["observed"], r["expected"]) for r in stats.full_crosstab(cells).collect()}
    assert full == {(r, c): (observed.loc[r, c], pytest.approx(expected.loc[r, c])) for r in observed.index for c in observed}
