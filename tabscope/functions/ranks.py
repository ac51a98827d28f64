"""Average ranks without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.selection import ACCURACY, CELLS, with_place

#: Stretches of the value range that are ranked side by side.
STRETCHES = 64
#: Rows of one value that may meet.
SPREAD = 100_000
#: Rows in a task of a join that brings ranks to rows, about.
JOINED = 1_000_000
#: Numbers of a column's rank table up to which it is broadcast.
SMALL = 4_000_000
#: Series whose edges are broadcast: as many times CELLS numbers.
BROADCAST = 400


def average_ranks(values: DataFrame, column: str) -> DataFrame:
    """``column`` (distinct values), ``ties`` (rows with the value) and ``rank`` (their average rank).

    Rows are first counted by value; distinct values are dealt out to stretches between
    approximate quantiles, ranked within each, and shifted by the rows before it.
    """
    counts = values.groupBy(column).agg(F.count(F.lit(1)).alias("ties"))
    shares = [k / STRETCHES for k in range(1, STRETCHES)]
    bounds = values.agg(F.percentile_approx(column, shares).alias("bounds"))  # one row
    dealt = counts.join(F.broadcast(bounds)).withColumn(
        "stretch", F.size(F.filter(F.coalesce("bounds", F.array()), lambda b: b < F.col(column)))
    )
    sums = dealt.groupBy("stretch").agg(F.sum("ties").alias("rows"))
    before = sums.select("stretch", (F.sum("rows").over(Window.orderBy("stretch")) - F.col("rows")).alias("before"))
    upto = F.sum("ties").over(Window.partitionBy("stretch").orderBy(column))
    ranked = dealt.drop("bounds").withColumn("upto", upto).join(F.broadcast(before), "stretch")  # a row for each stretch
    return ranked.select(column, "ties", (F.col("before") + F.col("upto") - (F.col("ties") - 1) / 2).alias("rank"))


def value_ranks(counts: DataFrame, groups: int, series: int) -> DataFrame:
    """(s, x, n0, n1 ..., r0, r1 ...) of distinct values x of a series s: for each of the ``groups`` of rows the average rank.

    ``counts`` (s, x, n0, n1 ...) says how many rows of a group have a value.  Edges between
    approximate quantiles cut the distinct values of a series into cells, which are ordered
    side by side and shifted by the rows of the cells before.
    """
    grid = [k / CELLS for k in range(1, CELLS)]
    hint = F.broadcast if series <= BROADCAST else lambda d: d
    ns = [f"n{j}" for j in range(groups)]
    edges = counts.groupBy("s").agg(F.array_distinct(F.percentile_approx("x", grid, ACCURACY)).alias("edges"))
    placed = with_place(counts.join(hint(edges), "s"), "x", "edges", "at").select("s", "x", *ns, "at")
    cells = placed.groupBy("s", "at").agg(*[F.sum(n).alias(n) for n in ns])  # CELLS rows for each series at most
    line = Window.partitionBy("s").orderBy("at")
    before = cells.select("s", "at", *[(F.sum(n).over(line) - F.col(n)).alias(f"b{j}") for j, n in enumerate(ns)])
    own = Window.partitionBy("s", "at").orderBy("x")
    upto = placed.select("*", *[F.sum(n).over(own).alias(f"u{j}") for j, n in enumerate(ns)]).join(hint(before), ["s", "at"])
    rank = [(F.col(f"b{j}") + F.col(f"u{j}") - (F.col(n) - 1) / 2).alias(f"r{j}") for j, n in enumerate(ns)]
    return upto.select("s", "x", *ns, *rank)


def with_ranks(rows: DataFrame, x: str, table: DataFrame, ranks: list[str], values: int, n: int) -> DataFrame:
    """``rows`` with the columns ``ranks`` of a rank table (x, ``rows``, ranks) of so many values, null where x is.

    A small table is broadcast.  Of a large one the values that very many rows share are, and
    the others meet their rows in tasks of about ``JOINED`` rows; rows that look for nothing
    there are dealt out by ``_row``.  ``n`` is the number of rows that have x.
    """
    key = table.withColumnRenamed("x", "_x")
    if values * (len(ranks) + 1) <= SMALL:
        return rows.join(F.broadcast(key.drop("rows")), F.col(x) == F.col("_x"), "left").drop("_x")
    hot = key.where(F.col("rows") > SPREAD).select("_x", F.struct(*ranks).alias("_hot"))  # n / SPREAD values at most
    met = rows.join(F.broadcast(hot), F.col(x) == F.col("_x"), "left").drop("_x")
    parts = n // JOINED + 1
    looks = F.col(x).isNotNull() & F.col("_hot").isNull()
    dealt = met.withColumn("_salt", F.when(looks, 0).otherwise(1 + F.pmod(F.xxhash64("_row"), F.lit(1_000_000))).cast("int")).withColumn("_k", F.when(looks, F.col(x)).otherwise(0.0))
    cold = key.where(F.col("rows") <= SPREAD).select(F.col("_x").alias("_k"), F.lit(0).alias("_salt"), F.struct(*ranks).alias("_cold"))
    both = dealt.repartition(parts, "_k", "_salt").join(cold.repartition(parts, "_k", "_salt"), ["_k", "_salt"], "left")
    found = F.coalesce("_hot", "_cold")
    return both.select(*rows.columns, *[found[r].alias(r) for r in ranks])


def ranked_series(values: DataFrame, series: int) -> DataFrame:
    """``values`` (row, s, x) with the average rank of x among the rows of its series s, counted from 0 up to ``series``."""
    counts = values.groupBy("s", "x").agg(F.count(F.lit(1)).alias("n0"))
    return values.join(value_ranks(counts, 1, series), ["s", "x"]).select("row", "s", F.col("r0").alias("rank"))
