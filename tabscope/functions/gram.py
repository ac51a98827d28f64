"""Moments of all pairs of columns at once, each over the rows in which both are present.

A task turns its rows into blocks: a matrix of values and one of presence.  A few matrix
products give, for every pair, the count, both means and the centred second moments, with
zeros where a value is missing.  Blocks are merged pairwise within the task, and the tasks'
numbers by one aggregate, again centred, so that large means don't swallow small spreads.
Least and greatest values come along, since a column is constant if and only if they agree.
Work is rows times pairs of plain multiplications; what is shuffled is a row for each pair
and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.workers import ship

#: Rows of a block.
BLOCK = 4096
MOMENTS = ("mx", "my", "cxx", "cyy", "cxy")
ENDS = ("lox", "hix", "loy", "hiy")


def block_moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, mean, own and joint moments, least and greatest of column i where column j is present, as matrices over (i, j)."""
    there = ~np.isnan(x)
    m = there.astype(np.float64)
    n = m.T @ m
    with np.errstate(invalid="ignore", divide="ignore"):
        reference = np.where(there, x, 0).sum(axis=0) / m.sum(axis=0)
        reference = np.where(np.isfinite(reference), reference, 0.0)
        own = np.where(there, x - reference, 0.0)
        sums = own.T @ m
        part = np.where(n > 0, sums / n, 0.0)
    square = (own * own).T @ m - sums * part
    joint = own.T @ own - sums * part.T
    low, high = np.where(there, x, np.inf), np.where(there, x, -np.inf)
    least, most = (np.repeat(side[:, None], x.shape[1], axis=1) for side in (low.min(axis=0), high.max(axis=0)))
    for j in np.flatnonzero(~there.all(axis=0)):  # where column j has gaps, the others' ends are of fewer rows
        least[:, j], most[:, j] = low[there[:, j]].min(axis=0, initial=np.inf), high[there[:, j]].max(axis=0, initial=-np.inf)
    return n, reference[:, None] + part, np.maximum(square, 0.0), joint, least, most


def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    n = a[0] + b[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(n > 0, b[0] / n, 0.0)
    gap = b[1] - a[1]
    weight = a[0] * share
    mean = np.where(a[0] > 0, a[1] + gap * share, b[1])
    return n, mean, a[2] + b[2] + gap * gap * weight, a[3] + b[3] + gap * gap.T * weight, np.minimum(a[4], b[4]), np.maximum(a[5], b[5])


def pair_moments(df: DataFrame, columns: list[Column], pairs: list[tuple[int, int]]) -> DataFrame:
    """(pair, n, mx, my, cxx, cyy, cxy, lox, hix, loy, hiy) for each pair of places in ``columns``.

    ``columns`` are doubles without NaN; a pair that no row has both of doesn't appear.
    """
    ship(df.sparkSession)
    names = [f"c{k}" for k in range(len(columns))]
    first, second = (np.array([p[side] for p in pairs], np.int64) for side in (0, 1))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in part.columns])
                total = block_moments(x) if total is None else merged(total, block_moments(x))
        if total is not None:
            n, mean, square, joint, least, most = total
            i, j = first, second
            values = [n[i, j], mean[i, j], mean[j, i], square[i, j], square[j, i], joint[i, j], least[i, j], most[i, j], least[j, i], most[j, i]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(i))), *map(pa.array, values)], names=["pair", "n", *MOMENTS, *ENDS])

    own = df.select(*[c.cast("double").alias(name) for c, name in zip(columns, names, strict=True)])
    kind = "pair long, n double, " + ", ".join(f"{c} double" for c in (*MOMENTS, *ENDS))
    tasks = own.mapInArrow(blocks, kind).where("n > 0")
    whole = Window.partitionBy("pair")  # a row for each task
    centre = lambda c: F.sum(F.col(c) * F.col("n")).over(whole) / F.sum("n").over(whole)
    tasks = tasks.withColumn("x", centre("mx")).withColumn("y", centre("my"))
    dx, dy = F.col("mx") - F.col("x"), F.col("my") - F.col("y")
    return tasks.groupBy("pair").agg(
        F.sum("n").cast("long").alias("n"), F.first("x").alias("mx"), F.first("y").alias("my"),
        F.sum(F.col("cxx") + F.col("n") * dx * dx).alias("cxx"), F.sum(F.col("cyy") + F.col("n") * dy * dy).alias("cyy"),
        F.sum(F.col("cxy") + F.col("n") * dx * dy).alias("cxy"),
        F.min("lox").alias("lox"), F.max("hix").alias("hix"), F.min("loy").alias("loy"), F.max("hiy").alias("hiy"),
    )
