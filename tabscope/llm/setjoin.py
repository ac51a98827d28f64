"""Jaccard join of word n-gram sets, heavy and light sets apart.

Two sets of n and m elements are linked if they share at least ``needed(n, m)`` of them.
Equal sets form a class first, which its smallest key stands for.

Light sets, up to a boundary, are joined by enumeration: for each size m that a partner may
have, every subset of ``needed(n, m)`` elements is a key, and sets under one key are linked,
all of them.  So a key gives one link from each of its sets to the smallest, never all pairs.

Heavy sets scan inverted lists.  Elements are put in one order for all sets, rare ones first
as far as a sketch of frequencies tells; a set of n can't have a partner without sharing one
of its first ``prefix(n)`` elements, so only these are posted.  Light sets near the boundary
are posted too, since heavy ones may be their partners.  Each list is first held against its
smallest member; links confirmed on whole sets give components.  Then only lists with several
components are scanned: members outside the list's most frequent component against all
others, in blocks of bounded size.  Sizes, places in the order and parity bitmaps bound what
two sets can share; what these bounds don't rule out meets on whole sets, and each block
gives a few links that join its components.  The bounds are exact: no pair at the threshold
is lost, and none below it linked.

The boundary is where the fewest rows are made: subsets of the light sets, postings of the
others and, for each posting, as many comparisons as small sets' lists are long on average.

Shingles are compared by 64-bit hashes, classes and subsets by 128 bits.  Documents with
fewer words than a shingle have their whole sequence as the only element.  Documents without
words, null or empty, link with nothing.  Rows that share a key count as one document with
several sets.  A null key is never linked: its component is null.  Texts of any length are
taken whole.  An empty table gives an empty one; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.components import components
from tabscope.llm.neardup import Likeness, clustered, confirmed, sets_of, shingle_sets, stars
from tabscope.llm.shared import Scratch, prepare, quoted
from tabscope.llm.words import STEP, mixed, slices

#: Largest boundary between light and heavy sets that is considered.
LIGHT = 24
#: Buckets of the frequency sketch, a byte each; its size is fixed.  A fuller sketch tells less.
SKETCH = 1 << 20
#: One document in so many is asked for frequencies.  They only order elements and change no result.
ASKED = 16
#: Elements of the sets that meet in a block, about; and of all the blocks of a task.
BLOCK = 1_000_000


def needed(n: int, m: int, percent: int) -> int:
    """Elements that linked sets of n and m share at least."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """Elements, in any order common to all sets, among which a set of n shares one with any partner."""
    return n - needed(n, -(-percent * n // 100), percent) + 1


def partners(n: int, percent: int) -> range:
    """Sizes that a partner of a set of n may have."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def width(n: int) -> int:
    """Bits of the parity bitmap of a set of n: a power of two from 2 n to 4 n, and 64 at least."""
    return max(64, 2 << max(n - 1, 0).bit_length())


def parity(hashes: np.ndarray, bits: int) -> bytes:
    """For each of the places that elements fall on, whether an odd number does."""
    places = (mixed(hashes) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bitmap: bytes, bits: int) -> bytes:
    """The parity bitmap of the same set with so many bits."""
    while 8 * len(bitmap) > bits:
        half = len(bitmap) // 2
        bitmap = (int.from_bytes(bitmap[:half]) ^ int.from_bytes(bitmap[half:])).to_bytes(half)
    return bitmap


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - SKETCH.bit_length())).astype(np.int64)


def frequencies(docs: DataFrame, like: Likeness, key: str, text: str) -> np.ndarray:
    """For each bucket of hashes the logarithm of how many elements fell into it, in asked documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for part in slices(list(batch["text"]), lambda t: len(t or "")):
                total += np.bincount(bucket_of(np.concatenate(shingle_sets(part, like.words))), minlength=SKETCH)
        bucket = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": bucket, "n": total[bucket]})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        levels = np.zeros(4096, np.uint8)
        levels[rows["bucket"].to_numpy() & 4095] = np.minimum(4 * np.log2(1 + rows["n"].to_numpy()), 255).astype(np.uint8)
        return pd.DataFrame([(int(rows["bucket"].iloc[0]) >> 12, levels.tobytes())], columns=["part", "levels"])

    asked = docs.where(F.pmod(F.xxhash64(quoted(key), F.lit(1)), F.lit(ASKED)) == 0).select(F.col(quoted(text)).alias("text"))
    counts = asked.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    parts = counts.groupBy(F.shiftright("bucket", 12)).applyInPandas(pack, "part long, levels binary").collect()  # SKETCH / 4096 rows
    out = np.zeros(SKETCH, np.uint8)
    for r in parts:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["levels"], np.uint8)
    return out


def signed(docs: DataFrame, like: Likeness, key: str, text: str) -> DataFrame:
    """(key, n_shingles, digest, grams, bitmap, width, low): grams are all of a light set and the prefix of others, in order."""
    levels = docs.sparkSession.sparkContext.broadcast(frequencies(docs, like, key, text))  # SKETCH bytes

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(zip(batch["key"], batch["text"], strict=True))
            for part in slices(rows, lambda r: len(r[1] or "")):
                out = []
                for (k, _), found in zip(part, shingle_sets([t for _, t in part], like.words), strict=True):
                    n = len(found)
                    if not n:
                        out.append((k, 0, None, None, None, None, None))
                        continue
                    order = np.lexsort((found, levels.value[bucket_of(found)]))
                    first = found[order if n <= LIGHT else order[: prefix(n, like.percent)]]
                    bits, low = width(n), width(-(-like.percent * n // 100))
                    out.append((k, n, xxhash.xxh3_128_digest(found.tobytes()), first.view(np.int64), parity(found, bits), bits, low))
                frame = pd.DataFrame(out, columns=["key", "n_shingles", "digest", "grams", "bitmap", "width", "low"])
                yield frame.astype({"key": "Int64", "width": "Int64", "low": "Int64"})

    rows = docs.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(text)).alias("text"))
    return rows.mapInPandas(sign, "key long, n_shingles long, digest binary, grams array<long>, bitmap binary, width long, low long")


def subsets(n: int, boundary: int, percent: int) -> int:
    """Keys that a light set of n gives."""
    return sum(comb(n, needed(n, m, percent)) for m in partners(n, percent) if m <= boundary)


def posted_from(boundary: int, percent: int) -> int:
    """Size from which sets are posted: partners of heavy sets are."""
    return -(-percent * (boundary + 1) // 100)


def boundary_of(classes: DataFrame, percent: int) -> int:
    """The largest size of light sets, by the cost of both ways over all sets up to ``LIGHT``."""
    small = classes.where(F.col("n_shingles") <= LIGHT)
    counts = {r["n"]: r["c"] for r in small.groupBy(F.col("n_shingles").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}  # LIGHT rows
    lists = small.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).cast("double").alias("l"))
    scan = lists.agg(F.sum(F.col("l") * F.col("l")) / F.sum("l")).first()[0] or 0.0

    def cost(x: int) -> float:
        light = sum(c * subsets(n, x, percent) for n, c in counts.items() if n <= x)
        return light + sum(c * prefix(n, percent) * (1 + scan) for n, c in counts.items() if n >= posted_from(x, percent))

    return min(range(LIGHT + 1), key=cost)


def light_pairs(classes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(a, b): under each subset key from a set of the smaller size to every other one.

    Two sets of the larger size needn't share enough; they have a key of their own if they do.
    """

    def enumerate_subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, n, grams in zip(batch["node"], batch["n_shingles"], batch["grams"], strict=True):
                one = mixed(np.asarray(grams, np.int64).view(np.uint64) + STEP)
                two = mixed(one ^ STEP)
                for m in partners(n, percent):
                    size = needed(n, m, percent)
                    if m > boundary or size > n:
                        continue
                    left = np.array(list(combinations(range(n), n - size)), np.int64).reshape(comb(n, size), n - size)
                    tag = np.uint64(min(n, m) << 8 | max(n, m)) * STEP
                    sums = [mixed((h.sum() - h[left].sum(axis=1, dtype=np.uint64)) ^ tag).view(np.int64) for h in (one, two)]
                    yield pd.DataFrame({"k1": sums[0], "k2": sums[1], "node": node, "lower": n <= m})

    keys = classes.where(F.col("n_shingles") <= boundary).select("node", "n_shingles", "grams")
    keys = keys.mapInPandas(enumerate_subsets, "k1 long, k2 long, node long, lower boolean")
    ends = F.min(F.when(F.col("lower"), F.col("node"))).alias("a"), F.min("node").alias("least"), F.max("node").alias("most")
    heads = keys.groupBy("k1", "k2").agg(*ends).where("a is not null and least < most").select("k1", "k2", "a")
    return keys.join(heads, ["k1", "k2"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()


def may_share(n: Column, m: Column, reach_n: Column, reach_m: Column, percent: int) -> Column:
    """Whether sets whose first common element leaves so many from it on can share enough."""
    return F.least(reach_n, reach_m) * (100 + percent) >= percent * (n + m)


def near_bitmaps(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps differ in no more places than linked sets' may."""

    @F.pandas_udf("boolean")
    def near(n: pd.Series, m: pd.Series, one: pd.Series, other: pd.Series) -> pd.Series:
        out = []
        for x, y, p, q in zip(n, m, one, other, strict=True):
            bits = 8 * min(len(p), len(q))
            differing = (int.from_bytes(folded(p, bits)) ^ int.from_bytes(folded(q, bits))).bit_count()
            out.append(differing <= x + y - 2 * needed(int(x), int(y), percent))
        return pd.Series(out, dtype=bool)

    side = lambda name, s: nodes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{s}"), F.col("bitmap").alias(f"bits_{s}"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.where(near("n_x", "n_y", "bits_x", "bits_y")).select("a", "b").distinct()


def scannable(posts: DataFrame) -> DataFrame:
    """(task, node, component, outside, n, reach, bits): lists of (gram, bits) with several components, in blocks.

    Members outside the most frequent component meet every block; what is within it meets
    them, and not one another.
    """
    keys = ["gram", "bits"]
    by_component = posts.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("elements"))
    inside = F.max_by(F.struct("component", "elements"), F.struct("c", "component"))
    lists = by_component.groupBy(*keys).agg(
        inside.alias("most"), F.sum("elements").alias("all"), F.count(F.lit(1)).alias("components")
    ).where("components > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    lists = lists.select(*keys, F.col("most.component").alias("most"), blocks(F.col("all")).alias("blocks"), blocks(F.col("all") - F.col("most.elements")).alias("others"))
    rows = posts.join(lists, keys).withColumn("outside", F.col("component") != F.col("most"))
    hashed = F.xxhash64("node")
    as_any = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(F.pmod(hashed, F.col("blocks")).alias("i"), o.alias("j"), F.lit(False).alias("outside")))
    as_outside = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), F.pmod(hashed, F.col("others")).alias("j"), F.lit(True).alias("outside"))
    )
    # a member outside is among all members too, and stands once in a task that has it as both
    met = rows.withColumn("at", F.explode(F.when(F.col("outside"), F.concat(as_outside, as_any)).otherwise(as_any)))
    return met.groupBy(F.xxhash64(*keys, "at.i", "at.j").alias("task"), "node", "component", "n", "bits").agg(
        F.max("at.outside").alias("outside"), F.max("reach").alias("reach")
    )


def together(name: str, elements: int) -> Column:
    """Deals groups out so that the sets of about ``BLOCK`` elements meet."""
    return F.pmod(F.xxhash64(name), F.lit(elements // BLOCK + 1))


def filtered(tasks: DataFrame, elements: int, nodes: DataFrame, percent: int) -> DataFrame:
    """(same, node, component, outside, n): members of a block that sizes, places and bitmaps leave a partner of another component.

    Blocks with the same members left are the same work; one of them stays.
    """

    def scan(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("task", kind="stable")
        node, component, n, reach, outside, bits = (batch[c].to_numpy() for c in ("node", "component", "n", "reach", "outside", "bits"))
        bitmap = batch["bitmap"].to_numpy()
        starts = np.unique(batch["task"].to_numpy(), return_index=True)[1]
        hits, same = [], []
        for start, end in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
            # what sizes and places rule out for every pair of the block needs no look at bitmaps
            rows = np.arange(start, end)
            own = rows[outside[start:end]]
            share = -(-percent * (n[own, None] + n[None, rows]) // (100 + percent)) if len(own) * len(rows) <= 64 else None
            if share is not None and not ((np.minimum(reach[own, None], reach[None, rows]) >= share) & (component[own, None] != component[None, rows])).any():
                continue
            maps = np.frombuffer(b"".join(folded(m, int(bits[start])) for m in bitmap[start:end]), np.uint64).reshape(end - start, -1)
            hit = np.zeros(end - start, bool)
            for k in own:
                share = -(-percent * (n[rows] + n[k]) // (100 + percent))
                other = np.flatnonzero((component[rows] != component[k]) & (np.minimum(reach[rows], reach[k]) >= share))
                differing = np.bitwise_count(maps[other] ^ maps[k - start]).sum(axis=1, dtype=np.int64)
                other = other[differing <= n[rows[other]] + n[k] - 2 * share[other]]
                hit[other] = True
                hit[k - start] |= bool(len(other))
            if hit.any():
                left = rows[hit]
                hits.append(left)
                same += [xxhash.xxh3_128_digest(np.sort(node[left]).tobytes() + np.sort(node[left][outside[left]]).tobytes())] * len(left)
        at = np.concatenate(hits) if hits else np.empty(0, np.int64)
        return pd.DataFrame({"same": same, "node": node[at], "component": component[at], "outside": outside[at], "n": n[at]}).drop_duplicates()

    rows = tasks.join(nodes.select("node", F.col("n_shingles").alias("n"), "bitmap"), ["node", "n"])
    kind = "same binary, node long, component long, outside boolean, n long"
    return rows.groupBy(together("task", elements // 32)).applyInPandas(scan, kind).distinct()


def joined_by(blocks: DataFrame, elements: int, docs: DataFrame, like: Likeness, key: str, text: str) -> DataFrame:
    """Links (a, b) that join the components of each block, confirmed on whole sets."""
    percent = like.percent

    def link_one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("outside", ascending=False, kind="stable")
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        size = np.array([len(s) for s in sets])
        bits = width(int(size.min()))
        maps = np.frombuffer(b"".join(folded(parity(s, width(len(s))), bits) for s in sets), np.uint64).reshape(len(sets), -1)

        def linked(k: int, other: np.ndarray) -> np.ndarray:
            share = -(-percent * (size[other] + size[k]) // (100 + percent))
            near = np.bitwise_count(maps[other] ^ maps[k]).sum(axis=1, dtype=np.int64) <= size[other] + size[k] - 2 * share
            for j in np.flatnonzero(near):
                near[j] = len(np.intersect1d(sets[k], sets[other[j]], assume_unique=True)) >= share[j]
            return near

        component = rows["component"].to_numpy()
        return stars(rows["node"].to_numpy(), component, clustered(linked, component.copy()))

    def link(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([link_one(own) for _, own in batch.groupby("same")])

    rows = blocks.join(sets_of(blocks.select("node"), docs, like, key, text), "node")
    return rows.groupBy(together("same", elements)).applyInPandas(link, "a long, b long")


def linked(classes: DataFrame, docs: DataFrame, like: Likeness, key: str, text: str, scratch: Scratch) -> DataFrame:
    """Links (a, b) between classes that join all that are connected."""
    percent = like.percent
    x = boundary_of(classes, percent)
    nodes = classes.select("node", "n_shingles", "bitmap")

    n = F.col("n_shingles")
    low = F.ceil(percent * n / 100)
    most = n - F.ceil(percent * (n + low) / (100 + percent)) + 1
    heavy = classes.where(n >= posted_from(x, percent))
    posts = heavy.select("node", n.alias("n"), "width", "low", F.posexplode(F.slice("grams", 1, most.cast("int"))).alias("place", "gram"))
    lists = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram")
    posts = posts.join(lists, "gram").select("gram", "node", "n", (F.col("n") - F.col("place")).alias("reach"), F.explode(F.array_distinct(F.array("width", "low"))).alias("bits"))
    posts = scratch.keep(posts, "posts")

    head = F.min(F.struct("node", "n", "reach")).alias("h")
    heads = posts.groupBy("gram", "bits").agg(head, F.max("node").alias("last")).where("h.node < last").drop("last")
    pairs = posts.join(heads, ["gram", "bits"]).where(F.col("node") != F.col("h.node"))
    pairs = pairs.where(may_share(F.col("n"), F.col("h.n"), F.col("reach"), F.col("h.reach"), percent))
    pairs = near_bitmaps(pairs.select(F.col("h.node").alias("a"), F.col("node").alias("b")).distinct(), nodes, percent)
    pairs = scratch.keep(pairs.union(light_pairs(classes, x, percent)).distinct(), "pairs")
    links = scratch.keep(confirmed(pairs, docs, like, key, text), "links")
    known = scratch.keep(components(links, scratch, "first"), "known")

    labelled = posts.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tasks = scratch.keep(scannable(labelled), "tasks")
    elements = tasks.agg(F.sum("n")).first()[0] or 0
    blocks = scratch.keep(filtered(tasks, elements, nodes, percent), "blocks")
    elements = blocks.agg(F.sum("n")).first()[0] or 0
    more = scratch.keep(joined_by(blocks, elements, docs, like, key, text), "more")
    return links.union(more)


def similar_sets(docs: DataFrame, like: Likeness | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its key, n_shingles and component_id."""
    like = like or Likeness()
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "setjoin")
    rows = scratch.keep(signed(docs, like, key, text), "signed")
    sound = rows.where("digest is not null and key is not null")
    first = [F.first(c).alias(c) for c in ("n_shingles", "grams", "bitmap", "width", "low")]
    classes = scratch.keep(sound.groupBy("digest").agg(F.min("key").alias("node"), *first), "classes")
    links = linked(classes, docs, like, key, text, scratch)

    member = sound.select("key", "digest").join(classes.select("digest", "node"), "digest").select("key", "node").distinct()
    member = scratch.keep(member, "members")
    several = member.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key")
    own = member.join(several, "key").select(F.col("key").alias("a"), F.col("node").alias("b"))  # sets of one document
    final = scratch.keep(components(links.union(own), scratch, "final"), "final")
    found = member.join(final, "node", "left").groupBy("key").agg(F.min(F.coalesce("component", "node")).alias("component"))
    return rows.select("key", "n_shingles").join(found, "key", "left").select(
        F.col("key").alias(key), "n_shingles", F.coalesce("component", "key").alias("component_id")
    )
