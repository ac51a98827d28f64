"""Exact quantiles by selection, against numpy."""

import math
import random

import numpy as np
import pytest

from tabscope.functions import selection
from tabscope.functions.selection import medians, quantiles, with_medians

SHARES = (0.0, 0.25, 0.5, 0.9, 1.0)


def truth(rows, shares):
    groups = {}
    for *key, x in rows:
        if x is not None:
            groups.setdefault(tuple(key), []).append(x)
    return {k: (len(v), np.quantile(v, shares).tolist()) for k, v in groups.items()}


def held(frame, keys):
    return {tuple(r[k] for k in keys): (r["n"], list(r["q"])) for r in frame.collect()}


def same(found, wanted):
    assert found.keys() == wanted.keys()
    for k, (n, q) in wanted.items():
        assert found[k][0] == n
        assert found[k][1] == pytest.approx(q, rel=1e-12)


def drawn(rng):
    rows = [("distinct", None, rng.random() * 10 ** rng.randint(-200, 200)) for _ in range(4000)]  # a group of only distinct values
    rows += [("hot", 1, rng.choice([0.0, 0.0, 0.0, -1.0, rng.random()])) for _ in range(3000)]
    rows += [("one", 1, 5.0)] * 900 + [(None, None, float(k)) for k in range(1500)]
    rows += [(f"small{k % 40}", k % 3, rng.gauss(0, 1)) for k in range(500)]
    rows += [("small1", 1, None), ("nothing", 2, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("stretch", [selection.STRETCH, 700, 20])
@pytest.mark.parametrize("broadcast", [selection.BROADCAST, 0])
def test_groups(spark, monkeypatch, stretch, broadcast):
    monkeypatch.setattr(selection, "STRETCH", stretch)
    monkeypatch.setattr(selection, "BROADCAST", broadcast)
    rows = drawn(random.Random(3))
    data = spark.createDataFrame(rows, "`a.b` string, k int, x double").repartition(4)
    same(held(quantiles(data, ["a.b", "k"], "x", SHARES), ["a.b", "k"]), truth(rows, SHARES))


@pytest.mark.parametrize("stretch", [selection.STRETCH, 50])
def test_one_group(spark, monkeypatch, stretch):
    monkeypatch.setattr(selection, "STRETCH", stretch)
    rng = random.Random(5)
    for values in ([rng.gauss(0, 1) for _ in range(3001)], [rng.randrange(5) for _ in range(999)], [7], [1, 2], [-(2**40), 2**40 + 1] * 60):
        data = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
        same(held(quantiles(data, [], "x", SHARES), []), truth([(v,) for v in values], SHARES))
    whole = spark.createDataFrame([(k,) for k in range(1000)], "x long")
    assert medians(whole, [], "x", "m").first()["m"] == 499.5


def test_few_rows_of_a_stretch_are_left(spark, monkeypatch):
    """A round leaves a bounded part of a group, whatever its values."""
    monkeypatch.setattr(selection, "STRETCH", 100)
    rng = random.Random(1)
    values = [rng.random() ** 50 for _ in range(20_000)]
    data = spark.createDataFrame([(0, v) for v in values], "g int, x double")
    from pyspark.sql import functions as F

    rows = data.select(F.struct("g").alias("g"), "x")
    one = F.array(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"), F.lit(0).cast("long").alias("before"), F.count(F.lit(1)).alias("rows")))
    plan = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), one.alias("stretches"))
    left = selection.narrowed(rows, plan, (0.5,), True).first()["stretches"]
    assert all(s["rows"] <= len(values) / selection.SHRINK for s in left)


def test_no_rows_and_infinities(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert quantiles(none, ["g"], "x", (0.5,)).collect() == []
    one = quantiles(none, [], "x", (0.5,)).first()
    assert (one["n"], list(one["q"])) == (0, [None])
    ends = spark.createDataFrame([(math.inf,), (-math.inf,), (3.0,)], "x double")
    assert medians(ends, [], "x", "m").first()["m"] == 3.0


def test_joined_to_groups(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)]
    data = spark.createDataFrame(rows, "g string, x double")
    found = with_medians(data.groupBy("g").count(), data, ["g"], "x", "m").collect()
    assert {r["g"]: (r["count"], r["m"]) for r in found} == {None: (2, 2.0), "a": (1, None), "b": (1, 2.0)}


@pytest.mark.parametrize("stretch", [10, 10**6])
def test_weights_stand_for_rows(spark, monkeypatch, stretch):
    monkeypatch.setattr(selection, "STRETCH", stretch)
    rng = random.Random(6)
    rows = [(g, float(x), rng.choice([1, 2, 50])) for g in "ab" for x in range(300)]
    data = spark.createDataFrame(rows, "g string, x double, w long").repartition(3)
    found = {r["g"]: (r["n"], r["q"]) for r in quantiles(data, ["g"], "x", SHARES, "w").collect()}
    for g in "ab":
        own = [x for k, x, w in rows if k == g for _ in range(w)]
        assert found[g][0] == len(own)
        assert found[g][1] == pytest.approx([float(np.quantile(own, p)) for p in SHARES])
