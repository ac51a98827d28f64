"""Centroid clustering in integers, with Hamerly's bounds.

Vectors with the right number of finite components become integers, in blocks: one row
holds a matrix, and for each of its vectors the cluster, an upper bound of the distance to
its centroid and a lower bound of the distance to any other.  A round loosens the bounds by
how far the centroids have moved.  A vector whose upper bound is below its lower one, or
below half the way from its centroid to the next one, keeps its cluster without a look at
its components; all others are ambiguous and are held against every centroid in exact
integers.  Each round is written to the shared folder, bounds included, and the one before
deleted.  A block also tells by how much its clusters' sums and sizes have changed; these
are added up by Spark, so that the driver sees k times d numbers a round.

Bounds are rounded away from the truth, and only strictly smaller ones count, so ties go to
the smaller number as in a full scan.  Distances and sums are exact at any size: vectors
with components beyond 2^27 are computed in unbounded integers, and a distance or inertia
that no long can hold is null.

Vectors that are null, of another length, or with a null, NaN or infinite component are left
out.  Of rows that share an id each is clustered; among them the seeds take the
lexicographically smaller vector first.  Rows without an id are clustered and never seed.
With fewer vectors than clusters there are as many clusters as vectors; an empty table gives
an empty one.  Further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.shared import Scratch, prepare, quoted

#: Vectors of a block.
BLOCK = 4096
#: Components up to this size have squared distances that a long holds, for 512 of them at most.
SMALL = 1 << 27


@dataclass(frozen=True)
class Clustering:
    clusters: int = 8
    components: int = 64
    rounds: int = 10
    scale: int = 1024
    seed: int = 3


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of c, in Python's integers where a long may not do."""
    if not len(x) or max(abs(x).max(), abs(c).max()) <= SMALL:
        x, c = x.astype(np.int64), c.astype(np.int64)
        out = np.empty((len(x), len(c)), np.int64)
    else:
        x, c = x.astype(object), c.astype(object)
        out = np.empty((len(x), len(c)), object)
    for j in range(len(c)):
        gap = x - c[j]
        out[:, j] = (gap * gap).sum(axis=1)
    return out


def root(square: np.ndarray, up: bool) -> np.ndarray:
    """Square roots, rounded up or down."""
    near = np.sqrt(square.astype(np.float64))
    toward = np.inf if up else -np.inf
    return np.nextafter(np.nextafter(near, toward), toward)  # one step for the number as a double, one for the root


def scanned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, an upper bound of its distance and a lower one of the second nearest's."""
    every = squared(x, centroids)
    own = every.argmin(axis=1) if len(x) else np.empty(0, np.int64)  # the first of equals
    at = np.arange(len(x))
    nearest = every[at, own]
    if len(centroids) == 1:
        return own, root(nearest, True), np.full(len(x), np.inf)
    others = every.copy()
    others[at, own] = every.max(axis=1) + 1
    second = others.min(axis=1)
    second = np.minimum(second, every.max(axis=1))
    return own, root(nearest, True), root(second, False)


def moved(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each centroid has gone, rounded up."""
    return root(np.array([squared(b[None], a[None])[0, 0] for b, a in zip(before, after, strict=True)]), True)


def reassigned(x, own, upper, lower, before: np.ndarray, after: np.ndarray):
    """Clusters and bounds after the centroids have moved; and how many vectors were scanned."""
    if len(after) == 1:
        return own, upper, lower, 0
    drift = moved(before, after)
    most = np.array([np.delete(drift, j).max() for j in range(len(drift))])
    upper = np.nextafter(upper + drift[own], np.inf)
    lower = np.nextafter(lower - most[own], -np.inf)
    apart = squared(after, after)
    far = apart.max() + 1
    half = np.array([root(np.array([min(far if i == j else apart[i, j] for j in range(len(after)))]), False)[0] / 2 for i in range(len(after))])
    ambiguous = ~(upper < np.maximum(lower, np.nextafter(half, -np.inf)[own]))
    if ambiguous.any():
        own, rows = own.copy(), np.flatnonzero(ambiguous)
        own[rows], upper[rows], lower[rows] = scanned(x[rows], after)
    return own, upper, lower, int(ambiguous.sum())


def change(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> np.ndarray:
    """Sums and, last, sizes that the clusters win or lose, flat, in Python's integers."""
    out = np.zeros((k, x.shape[1] + 1), object)
    for sign, own in ((-1, old), (1, new)):
        if own is not None:
            rows = np.flatnonzero(own != new) if sign < 0 else np.flatnonzero(own != old) if old is not None else np.arange(len(own))
            for j in np.unique(own[rows]):
                part = x[rows[own[rows] == j]]
                whole = part.sum(axis=0) if abs(part).max() <= SMALL else part.astype(object).sum(axis=0)
                out[j] += sign * np.r_[whole.astype(object), len(part)]
    return out.ravel()


def integers(vectors: DataFrame, how: Clustering, key: str, vector: str) -> DataFrame:
    """(key, x): the vectors with as many finite components as asked for, scaled and floored."""
    v = F.col(quoted(vector))
    sound = (F.size(v) == how.components) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(v, lambda c: F.floor(how.scale * c.cast("double")))
    bounded = F.forall(v, lambda c: F.abs(how.scale * c.cast("double")) < 2.0**62)
    return vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col(quoted(key)).alias("key"),
        F.when(bounded, scaled).alias("x"),
        F.when(~bounded, F.transform(v, lambda c: c.cast("double"))).alias("wide"),
    )


def whole(x: list | None, wide: list | None, scale: int) -> list[int]:
    """The integers of a row; what no long holds is a multiple of its own unit already."""
    return [int(c) for c in x] if x is not None else [int(np.floor(scale * float(c))) for c in wide]


def packed(m: np.ndarray) -> bytes:
    """A matrix of integers in as many bytes as its largest one needs; text where none do."""
    for size in ("<i2", "<i4", "<i8"):
        if not m.size or np.iinfo(size).min <= m.min() and m.max() <= np.iinfo(size).max:
            return size.encode() + m.astype(size).tobytes()
    return b"txt" + " ".join(map(str, m.ravel())).encode()


def unpacked(raw: bytes, d: int) -> np.ndarray:
    if raw[:3] == b"txt":
        return np.array([int(c) for c in raw[3:].split()], object).reshape(-1, d)
    return np.frombuffer(raw[3:], raw[:3].decode()).reshape(-1, d).astype(np.int64)


STATE = "keys array<{kind}>, x binary, own binary, upper binary, lower binary, scanned long, change array<decimal(38,0)>"


def decimals(values: np.ndarray) -> list:
    from decimal import Decimal

    return [Decimal(int(v)) for v in values]


def blocks(rows: DataFrame, seeds: np.ndarray, how: Clustering, kind: str) -> DataFrame:
    """The first assignment: every vector is scanned."""

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def block() -> pd.DataFrame:
            every = [x for _, x in held]
            small = all(abs(c) < 1 << 62 for x in every for c in (min(x), max(x)))
            x = np.array(every, np.int64 if small else object).reshape(-1, how.components)
            own, upper, lower = scanned(x, seeds)
            return pd.DataFrame(
                [([k for k, _ in held], packed(x), own.astype("<i4").tobytes(), upper.tobytes(), lower.tobytes(), len(x), decimals(change(x, None, own, len(seeds))))],
                columns=["keys", "x", "own", "upper", "lower", "scanned", "change"],
            )

        for batch in batches:
            for key, x, wide in zip(batch["key"].astype(object).where(batch["key"].notna(), None), batch["x"], batch["wide"], strict=True):
                held.append((key, whole(x, wide, how.scale)))
                if len(held) == BLOCK:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return rows.mapInPandas(start, STATE.format(kind=kind))


def stepped(state: DataFrame, before: np.ndarray, after: np.ndarray, how: Clustering, kind: str) -> DataFrame:
    """One round later."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, raw, own, upper, lower in batch[["keys", "x", "own", "upper", "lower"]].itertuples(index=False):
                x, old = unpacked(raw, how.components), np.frombuffer(own, "<i4").astype(np.int64)
                new, upper, lower, n = reassigned(x, old, np.frombuffer(upper).copy(), np.frombuffer(lower).copy(), before, after)
                row = (keys, raw, new.astype("<i4").tobytes(), upper.tobytes(), lower.tobytes(), n, decimals(change(x, old, new, len(after))))
                yield pd.DataFrame([row], columns=batch.columns)

    columns = ["keys", "x", "own", "upper", "lower", "scanned", "change"]
    return state.select(*columns).mapInPandas(step, STATE.format(kind=kind))


def summed(state: DataFrame, k: int, d: int) -> np.ndarray:
    """The changes of all blocks: k rows of d sums and a size."""
    parts = state.select(F.posexplode("change").alias("place", "by")).groupBy("place").agg(F.sum("by").alias("by")).collect()  # k * (d + 1) rows
    out = np.zeros(k * (d + 1), object)
    for r in parts:
        out[r["place"]] = int(r["by"])
    return out.reshape(k, d + 1)


def clustered(vectors: DataFrame, how: Clustering | None = None, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of each sound vector, and the final centroids; distance is squared."""
    how = how or Clustering()
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "clusters")
    kind = vectors.schema[key].dataType.simpleString()
    rows = integers(vectors, how, key, vector)
    named = F.concat(F.lit(f"{how.seed}:"), F.col("key").cast("string"))
    first = rows.where("key is not null").orderBy(F.sha2(named, 256), "x", "wide").limit(how.clusters).collect()  # k rows
    if not first:  # also where no vector has an id
        first = rows.orderBy("x", "wide").limit(how.clusters).collect()
    result = f"{quoted(key)} {kind}, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], result), np.empty((0, how.components), object)
    centroids = np.array([whole(r["x"], r["wide"], how.scale) for r in first], object).reshape(len(first), how.components)

    # blocks are few, so they are dealt out anew where the input is one file
    state = scratch.keep(blocks(rows, centroids, how, kind), "round0")
    totals = summed(state, len(first), how.components)
    for number in range(1, how.rounds + 1):
        after = centroids.copy()
        for j in np.flatnonzero(totals[:, -1] > 0):
            after[j] = [s // totals[j, -1] for s in totals[j, :-1]]
        if (after == centroids).all():  # nothing will change any more
            break
        fresh = scratch.keep(stepped(state, centroids, after, how, kind), f"round{number}")
        scratch.drop(f"round{number - 1}")
        state, centroids = fresh, after
        totals = totals + summed(state, len(first), how.components)

    final = centroids

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, raw, own in batch.itertuples(index=False):
                x, own = unpacked(raw, how.components), np.frombuffer(own, "<i4")
                far = np.empty(len(x), object)
                for j in np.unique(own):
                    far[own == j] = squared(x[own == j], final[j : j + 1])[:, 0]
                yield pd.DataFrame({"key": keys, "cluster": own, "distance": pd.array([int(f) if f < 1 << 63 else None for f in far], "Int64")})

    found = state.select("keys", "x", "own").mapInPandas(measure, f"key {kind}, cluster int, distance long")
    return found.withColumnRenamed("key", key), final


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256."""
    sums = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.max(F.col("distance").isNull()).alias("beyond")
    ).collect()  # k rows
    held = lambda s: s if s is not None and s < 1 << 63 else None
    per = {r["cluster"]: None if r["beyond"] else held(int(r["sum"])) for r in sums}
    total = held(sum(per.values())) if None not in per.values() else None
    digests = {j: hashlib.sha256(",".join(str(int(c)) for c in row).encode()).hexdigest() for j, row in enumerate(centroids)}
    rows = [(j, per[j], total, digests[j]) for j in sorted(per)]
    about = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster")  # k rows
