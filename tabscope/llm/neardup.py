"""Near-duplicate documents by an inverted join over MinHash coordinates.

A document's set holds its distinct word shingles; its signature has ``COORDINATES``
minima.  Documents with equal sets form a class, which its smallest key stands for.
Classes are posted under the coordinate-value pairs of a signature prefix so long that a
pair at the threshold shares one of them but for a chance of ``MISS``; and it agrees in
at least ``matches`` coordinates but for the same chance.

No list of postings is ever turned into all of its pairs.  First each list's members
are held against its smallest member, and confirmed links give components.  Then only
lists that hold several components are merged: equal coordinates are counted between
members that are not yet in one cluster, pairs below the match threshold are skipped,
and a list gives one row for each member of a cluster that joins components.  Lists longer than
``LIST`` are split by a second coordinate, which such pairs share in a longer prefix,
and those that are longer even so into blocks.  Clusters hold all pairs that may be alike; within them, in
blocks, the intersections of the full sets are counted as a matrix product and the links
confirmed.  Links of the first step are confirmed on full sets as well.

Documents with fewer words than a shingle have their whole sequence as the only
shingle.  Documents without words, null or empty, link with nothing.  Rows that share a
key count as one document with both texts.  A null key is never linked nor kept.  Texts of
any length are taken whole; of a component the smallest key stays.  An empty table gives an
empty one; further columns aren't read.  Thresholds so low that ``POSTED`` coordinates
can't keep the miss are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.components import components
from tabscope.llm.shared import FILTER_BITS, Scratch, key_filter, passing, prepare
from tabscope.llm.words import STEP, joined, mixed, slices, words_of

COORDINATES = 128
#: Coordinates that are posted, at most; these keep 32 bits, for counting 8 bits of each do.
POSTED = 20
#: Chance that a pair at the threshold isn't found, for each of the bounds.
MISS = 1e-9
#: Members beyond which a list is split by a second coordinate, and beyond that into blocks.
LIST = 4000
#: Members of all lists in a task, about.
MEET = 20_000
#: Documents of a cluster whose sets meet in one task, for each of the two blocks.
BLOCK = 400
#: Shingles in a slice of the matrix product.
COLUMNS = 4000


def below(n: int, p: float, r: int) -> float:
    """Chance of fewer than r successes in n draws."""
    return sum(comb(n, t) * p**t * (1 - p) ** (n - t) for t in range(r))


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``words`` words; linked if 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    @property
    def matches(self) -> int:
        """Coordinates that a pair at the threshold agrees in, but for a chance of MISS."""
        p = self.percent / 100
        return max((t for t in range(1, COORDINATES + 1) if below(COORDINATES, p, t) <= MISS), default=1)

    @property
    def bits(self) -> int:
        """Bits in which half the coordinates, 8 bits each, of such a pair differ at most, but for that chance.

        A coordinate that differs has 4 bits that do, more or less.
        """
        half, p = COORDINATES // 2, self.percent / 100
        differing = half - max((t for t in range(half + 1) if below(half, p, t) <= MISS), default=0)
        return int(4 * differing + 6.5 * (2 * differing) ** 0.5)

    def prefix(self, shared: int) -> int:
        """Coordinates of which such a pair shares so many, but for a chance of MISS."""
        p = self.percent / 100
        found = next((n for n in range(shared, POSTED + 1) if below(n, p, shared) <= MISS), None)
        if found is None:
            raise ValueError(f"{POSTED} posted coordinates don't find pairs at {self.percent} percent with a miss of {MISS}")
        return found


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found = words_of(texts)
    grams = joined(found.hash, n)
    out = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(joined(found.hash[a:b], b - a) ^ (np.array([b - a], np.uint64) * STEP))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Minima of the set under COORDINATES hash functions: the posted ones whole, and 8 bits of each."""
    factors = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * STEP) | np.uint64(1)
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        least = np.minimum(least, (factors[:, None] * hashes[None, a : a + 2048]).min(axis=1))
    short = mixed(least)
    return (short[:POSTED] >> np.uint64(32)).astype("<u4").tobytes(), (short >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, like: Likeness, key: str, text: str) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(zip(batch["key"], batch["text"], strict=True))
            for part in slices(rows, lambda r: len(r[1] or "")):
                sets = shingle_sets([t for _, t in part], like.words)
                signs = [signature(s) if len(s) else (None, None) for s in sets]
                yield pd.DataFrame(
                    {
                        "key": pd.array([k for k, _ in part], dtype="Int64"),
                        "n_shingles": [len(s) for s in sets],
                        "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        "posted": [p for p, _ in signs],
                        "signature": [s for _, s in signs],
                    }
                )

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(
        sign, "key long, n_shingles long, digest binary, posted binary, signature binary"
    )


def sets_of(needed: DataFrame, docs: DataFrame, like: Likeness, key: str, text: str) -> DataFrame:
    """(node, grams): the sets of the documents in ``needed``, and of a few more.

    A fixed-size filter of the needed keys spares the others the way through the shuffle.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).alias("place")
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(needed.select(place("node"))))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[passing(bits.value, batch["place"].to_numpy())]
            rows = list(zip(batch["node"], batch["text"], strict=True))
            for part in slices(rows, lambda r: len(r[1] or "")):
                found = shingle_sets([t for _, t in part], like.words)
                yield pd.DataFrame({"node": [k for k, _ in part], "grams": [s.tobytes() for s in found]})

    rows = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("node"), place(F.col(key).cast("long")), F.col(text).alias("text")
    )
    return rows.mapInPandas(sets, "node long, grams binary")


def confirmed(pairs: DataFrame, docs: DataFrame, like: Likeness, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    held = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, like, key, text)

    @F.pandas_udf("boolean")
    def alike(one: pd.Series, other: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(one, other, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= like.percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    first = held.withColumnRenamed("node", "a").withColumnRenamed("grams", "grams_a")
    second = held.withColumnRenamed("node", "b").withColumnRenamed("grams", "grams_b")
    return pairs.join(first, "a").join(second, "b").where(alike("grams_a", "grams_b")).select("a", "b")


def posted(nodes: DataFrame, length: int) -> DataFrame:
    """(node, place, value) of the first coordinates of each signature."""
    value = lambda i: F.substring(F.col("posted"), i * 4 + 1, F.lit(4))
    cells = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.struct(i.alias("place"), value(i).alias("value")))
    return nodes.select("node", F.explode(cells).alias("c")).select("node", "c.place", "c.value")


def agreeing(pairs: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that agree in enough coordinates."""

    @F.pandas_udf("long")
    def count(one: pd.Series, other: pd.Series) -> pd.Series:
        if not len(one):
            return pd.Series([], dtype="int64")
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, COORDINATES) for s in (one, other))
        return pd.Series((x == y).sum(axis=1))

    first = nodes.select(F.col("node").alias("a"), F.col("signature").alias("s_a"))
    second = nodes.select(F.col("node").alias("b"), F.col("signature").alias("s_b"))
    return pairs.join(first, "a").join(second, "b").where(count("s_a", "s_b") >= like.matches).select("a", "b")


def clustered(linked, labels: np.ndarray) -> np.ndarray:
    """Labels after joining those of rows that ``linked(k, others)`` connects to row k.

    Rows that already share a label are never compared, so a cluster costs no more than
    its members.
    """
    for k in range(len(labels) - 1):
        other = np.flatnonzero(labels[k + 1 :] != labels[k]) + k + 1
        if len(other):
            hit = other[linked(k, other)]
            if len(hit):
                labels[np.isin(labels, labels[hit])] = labels[k]
    return labels


def stars(node: np.ndarray, before: np.ndarray, after: np.ndarray) -> pd.DataFrame:
    """For each label one edge from each of the labels that joined it to its first node."""
    _, joined_at = np.unique(before, return_index=True)  # a node of each label as it was
    _, head, which = np.unique(after[joined_at], return_index=True, return_inverse=True)
    a, b = node[joined_at[head]][which], node[joined_at]
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]}, dtype="int64")


def gathered(node: np.ndarray, before: np.ndarray, after: np.ndarray) -> pd.DataFrame:
    """An edge from the first node of each label that has joined others to each of its nodes."""
    labels, head, which = np.unique(after, return_index=True, return_inverse=True)
    low, high = np.full(len(labels), before.max()), np.full(len(labels), before.min())
    np.minimum.at(low, which, before)
    np.maximum.at(high, which, before)
    joined_ones = (low < high)[which]
    a, b = node[head][which][joined_ones], node[joined_ones]
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]}, dtype="int64")


def merged(lists: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """Edges (a, b) that hold together, within each list of (list, node, component), what may be alike."""
    matches, bits = like.matches, like.bits

    def merge(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("list", kind="stable")
        node, component = batch["node"].to_numpy(), batch["component"].to_numpy()
        every = np.frombuffer(b"".join(batch["signature"]), np.uint8).reshape(-1, COORDINATES)
        halves = np.ascontiguousarray(every[:, : COORDINATES // 2]).view(np.uint64)

        def agree(one: np.ndarray, other: np.ndarray) -> np.ndarray:
            near = np.bitwise_count(halves[other] ^ halves[one]).sum(axis=1, dtype=np.uint16) <= bits
            near[near] = (every[other[near]] == every[np.broadcast_to(one, near.shape)[near]]).sum(axis=1) >= matches
            return near

        starts, sizes = np.unique(batch["list"].to_numpy(), return_index=True, return_counts=True)[1:]
        two = starts[sizes == 2]
        hit = two[agree(two, two + 1)] if len(two) else two
        found = [pd.DataFrame({"a": node[hit], "b": node[hit + 1]}, dtype="int64")]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = component[start : start + size]
            linked = lambda k, other: agree(np.array([start + k]), start + other)  # noqa: B023, E731
            found.append(gathered(node[start : start + size], own, clustered(linked, own.copy())))
        return pd.concat(found).drop_duplicates()

    rows = lists.join(nodes.select("node", "signature"), "node")
    return rows.groupBy(together("list", lists.count(), MEET)).applyInPandas(merge, "a long, b long").distinct()


def together(name: str, rows: int, most: int) -> Column:
    """Deals groups out so that about ``most`` rows meet: a call for each small group would cost more than its work."""
    return F.pmod(F.xxhash64(name), F.lit(rows // most + 1))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets, by a matrix product over slices of their elements."""
    sizes = np.array([len(s) for s in sets])
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.flatnonzero(np.bincount(at, minlength=len(every)) > 1)
    column = np.full(len(every), -1)
    column[shared] = np.arange(len(shared))
    row, col = np.repeat(np.arange(len(sets)), sizes), column[at]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, len(shared), COLUMNS):
        i, j = np.searchsorted(col, [a, a + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[i:j], col[i:j] - a] = 1
        out += held @ held.T
    return out


def linked_within(clusters: DataFrame, docs: DataFrame, like: Likeness, key: str, text: str) -> DataFrame:
    """Links between different components within each cluster of (node, cluster, component).

    Large clusters meet block by block; each task gives the edges that join its components.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks)
    met = clusters.join(sizes, "cluster").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    task = F.struct("cluster", F.least("own", "other"), F.greatest("own", "other"))
    met = met.select(F.xxhash64(task).alias("task"), "node", "component")
    rows = met.join(sets_of(clusters, docs, like, key, text), "node")

    def link_one(batch: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(g, np.uint64) for g in batch["grams"]]
        both = intersections(sets)
        size = np.array([len(s) for s in sets])
        component = batch["component"].to_numpy()
        linked = lambda k, other: 100 * both[k, other] >= like.percent * (size[k] + size[other] - both[k, other])
        return stars(batch["node"].to_numpy(), component, clustered(linked, component.copy()))

    def link(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([link_one(own) for _, own in batch.groupby("task")])

    return rows.groupBy(together("task", met.count(), BLOCK)).applyInPandas(link, "a long, b long")


def lists_of(posts: DataFrame, *keys: str) -> DataFrame:
    """Lists with several components: (list, node, component, size)."""
    mixed_lists = posts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    return posts.join(mixed_lists.where("low < high").drop("low", "high"), list(keys))


def near_duplicates(
    docs: DataFrame, like: Likeness | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each document: its key, n_shingles, component_id and kept."""
    like = like or Likeness()
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "neardup")
    signed = scratch.keep(signatures(docs, like, key, text), "signed")
    classes = (
        signed.where("digest is not null and key is not null")
        .groupBy("digest")
        .agg(F.min("key").alias("node"), F.first("posted").alias("posted"), F.first("signature").alias("signature"))
    )
    classes = scratch.keep(classes, "classes")
    nodes = classes.select("node", "posted", "signature")

    posts = scratch.keep(posted(nodes, like.prefix(1)), "posts")
    heads = posts.groupBy("place", "value").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pairs = posts.join(heads, ["place", "value"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    pairs = scratch.keep(agreeing(pairs, nodes, like), "pairs")
    links = scratch.keep(confirmed(pairs, docs, like, key, text), "links")
    known = scratch.keep(components(links, scratch, "first"), "known")

    labelled = posts.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = scratch.keep(lists_of(labelled, "place", "value"), "lists")
    short = lists.where(F.col("size") <= LIST).select(F.xxhash64("place", "value").alias("list"), "node", "component")
    # a pair within a long list shares a second, later coordinate of a longer prefix
    long = lists.where(F.col("size") > LIST).select("node", F.col("place").alias("place1"), F.col("value").alias("value1"), "component")
    second = posted(nodes.join(long.select("node").distinct(), "node", "semi"), like.prefix(2))
    longer = lists_of(long.join(second, "node").where("place > place1"), "place1", "value1", "place", "value")
    blocks = F.ceil(F.col("size") / LIST).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks)
    met = longer.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        F.xxhash64("place1", "value1", "place", "value", F.least("own", "other"), F.greatest("own", "other")).alias("list"),
        "node",
        "component",
    )
    lists = scratch.keep(short.union(met), "dealt")
    near = scratch.keep(merged(lists, nodes, like), "near")
    groups = components(near, scratch, "near").withColumnRenamed("component", "cluster")
    clusters = groups.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = scratch.keep(linked_within(scratch.keep(clusters, "clusters"), docs, like, key, text), "more")
    final = scratch.keep(components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch, "second"), "final")

    member = classes.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return (
        signed.drop("posted", "signature")
        .join(member, "digest", "left")
        .select(
            F.col("key").alias(key),
            "n_shingles",
            F.coalesce("component", "key").alias("component_id"),
            F.coalesce(F.coalesce("component", "key") == F.col("key"), F.lit(False)).alias("kept"),
        )
    )
