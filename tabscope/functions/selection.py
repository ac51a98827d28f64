"""Exact quantiles of all groups at once, by selection instead of a buffer of all values.

A group's rows are never held together while they are many.  Rank-bounded histograms say in
which small stretch of its values each wanted rank lies: cells between approximate quantiles
are counted exactly, those that hold a wanted rank are kept, with the number of rows before
them, and cut again.  Rounds are
worked out one after the other where few groups are large.  A round leaves at most one row in ``SHRINK`` of a stretch, unless they
all have one value, so the number of rounds follows from the largest group.  Values that are
an edge have a cell of their own; so a value that very many rows share ends as a stretch of
one value.  What is left, ``STRETCH`` rows of a group at most, is counted by value and the
ranks read off running counts.

Nothing hangs on the approximation: cells hold exact counts and their own least and greatest
value.  Every round aggregates on the map side; only cells, edges and stretches are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.values import quoted

#: Rows of a stretch that one task may order.
STRETCH = 1_000_000
#: Cells of a stretch; a power of two, for the search.
CELLS = 256
#: Accuracy of the quantiles between cells, and the share of a stretch that a cell then has at most.
ACCURACY = 2000
SHRINK = 1 / (1 / CELLS + 3 / ACCURACY)
#: Groups with several stretches that are broadcast with their edges: 100 * 6 * CELLS numbers.
BROADCAST = 100

QUARTILES = (0.25, 0.5, 0.75)


def wanted(shares: tuple[float, ...], n: Column) -> list[Column]:
    """Ranks, from 0, of the values on both sides of each share."""
    return [side(F.lit(p) * (n - 1)).cast("long") for p in shares for side in (F.floor, F.ceil)]


def holds(ranks: list[Column], before: Column, rows: Column) -> Column:
    """Whether any of the ranks is among so many rows after so many others."""
    found = F.lit(False)
    for r in ranks:
        found = found | ((before <= r) & (r < before + rows))
    return found


def with_place(rows: DataFrame, x: str, edges: str, name: str) -> DataFrame:
    """``rows`` with how many of the sorted edges are below x, by bisection: a projection for each step, in generated code."""
    rows = rows.withColumn(name, F.lit(0))
    for k in range(1, CELLS.bit_length()):
        step = CELLS >> k
        rows = rows.withColumn(name, F.col(name) + F.when(F.get(edges, F.col(name) + (step - 1)) < F.col(x), step).otherwise(0))
    return rows


def attached(rows: DataFrame, plan: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with their group's stretches (g, n, stretches)."""
    return rows.join(F.broadcast(plan) if few else plan, "g", how)


def within(rows: DataFrame) -> DataFrame:
    """The rows that lie in a stretch of their group, with that stretch as ``st``."""
    own = F.filter("stretches", lambda s: (s["lo"] <= F.col("x")) & (F.col("x") <= s["hi"]))
    return rows.withColumn("st", F.get(own, F.lit(0))).where("st is not null").drop("stretches")


def narrowed(rows: DataFrame, plan: DataFrame, shares: tuple[float, ...], few: bool) -> DataFrame:
    """The plan after one more round: (g, n, stretches), each stretch (lo, hi, before, rows)."""
    dealt = within(attached(rows, plan, few)).select("g", "n", "x", "w", F.col("st.before").alias("before"))
    grid = [k / CELLS for k in range(1, CELLS)]
    edges = dealt.groupBy("g", "before").agg(F.array_distinct(F.percentile_approx("x", grid, ACCURACY)).alias("edges"))
    placed = with_place(dealt.join(F.broadcast(edges) if few else edges, ["g", "before"]), "x", "edges", "at")
    cell = 2 * F.col("at") + F.when(F.get("edges", "at") == F.col("x"), 1).otherwise(0)
    cells = placed.groupBy("g", "n", "before", cell.alias("cell")).agg(F.sum("w").alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    upto = F.sum("rows").over(Window.partitionBy("g", "before").orderBy("cell"))
    cells = cells.withColumn("before", F.col("before") + upto - F.col("rows"))
    kept = cells.where(holds(wanted(shares, F.col("n")), F.col("before"), F.col("rows")))
    return kept.groupBy("g", "n").agg(F.collect_list(F.struct("lo", "hi", "before", "rows")).alias("stretches"))  # two for each share at most


def told(plan: DataFrame) -> DataFrame:
    """The plan of a few groups as values, so that later rounds don't work it out again."""
    if "timestamp" in plan.schema["g"].dataType.simpleString():  # would change with the driver's time zone
        return plan
    return plan.sparkSession.createDataFrame(plan.collect(), plan.schema)  # BROADCAST groups at most


def quantiles(values: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], weight: str | None = None) -> DataFrame:
    """``keys``, ``n`` and ``q``: for each group the count of non-null values and their exact quantiles.

    Quantiles lie between neighbours in proportion.  Null keys are a group; groups without
    values don't appear, but without ``keys`` there is always one row.  With ``weight``, a
    row stands for as many equal ones.
    """
    g = F.struct(*[quoted(k).alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    w = quoted(weight) if weight else F.lit(1)
    rows = values.select(g.alias("g"), quoted(value).alias("x"), w.cast("long").alias("w")).where("x is not null")
    sized = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    large = F.col("size") > STRETCH
    most, several = sized.agg(F.max("size"), F.count_if(large)).first()

    if not several:
        left = rows.select("g", "x", "w", F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("n"))
    else:
        few = several <= BROADCAST
        one = F.array(F.struct("lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("rows")))
        plan = sized.where(large).select("g", "n", one.alias("stretches"))
        plan = told(plan) if few else plan
        while most > STRETCH:
            plan, most = narrowed(rows, plan, shares, few), most / SHRINK
            plan = told(plan) if few else plan
        met = attached(rows, plan, few, "left")
        small = met.where("n is null").select("g", "x", "w", F.lit(0).cast("long").alias("before"), "n")
        left = small.union(within(met.where("n is not null")).select("g", "x", "w", "st.before", "n"))

    counts = left.groupBy("g", "before", "x").agg(F.sum("w").alias("rows"), F.max("n").alias("n"))
    own = Window.partitionBy("g", "before")
    upto = F.sum("rows").over(own.orderBy("x"))
    counts = counts.withColumn("n", F.coalesce("n", F.sum("rows").over(own))).withColumn("before", F.col("before") + upto - F.col("rows"))
    here = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("rows")), F.col("x"))).cast("double")
    ranks = wanted(shares, F.col("n"))
    found = counts.groupBy(*(["g"] if keys else [])).agg(F.max("n").alias("n"), *[here(r).alias(f"x{k}") for k, r in enumerate(ranks)])
    q = []
    for k, p in enumerate(shares):
        low, high, at = F.col(f"x{2 * k}"), F.col(f"x{2 * k + 1}"), F.lit(p) * (F.col("n") - 1)
        q.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return found.select(*[F.col("g")[k].alias(k) for k in keys], F.coalesce("n", F.lit(0)).alias("n"), F.array(*q).alias("q"))


def medians(values: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys`` and each group's exact median; without ``keys`` one row."""
    return quantiles(values, keys, value, (0.5,)).select(*map(quoted, keys), F.col("q")[0].alias(name))


def with_medians(grouped: DataFrame, values: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``grouped``, a row for each group of ``keys``, with the group's exact median; null keys are equal."""
    found = medians(values, keys, value, name)
    if not keys:
        return grouped.join(F.broadcast(found))  # one row
    g = F.struct(*[quoted(k).alias(k) for k in keys])
    return grouped.withColumn("_g", g).join(found.select(g.alias("_g"), name), "_g", "left").drop("_g")
