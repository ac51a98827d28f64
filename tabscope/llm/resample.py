"""Importance resampling towards a target distribution of hashed n-grams.

Texts are cut into slices.  A slice lists its distinct words once, its distinct n-grams as
tuples of places in that list, and for each document which of these n-grams it holds.
The words of all slices make one dictionary that maps every distinct word to an integer;
n-grams become tuples of these integers, which are counted over the corpus and over the
target.  The bytes of each distinct tuple are put together once, from the dictionary, and
hashed to a bucket.  What a bucket gains is joined back by tuple to the slices, where the
documents add it up.  No row is ever made for a single occurrence of a word.

A document's score is its weight plus noise drawn from its key (Gumbel), so that the highest
scores are a sample without replacement.  Ranks are made within stretches of the scores and
shifted by the rows before; no task sorts all documents.

Null texts have no words, and the longest are taken whole (a slice is at least one text).
Rows that share a key count one by one, with equal noise.  Rows with a null key count in all
statistics and have a weight, but neither score nor rank.  Empty tables give empty ones;
without a target every bucket's gain stands for no target words.  Further columns pass through
no step; names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.shared import Scratch, prepare, quoted

# A word is a run of digits, letters a-z and everything beyond ASCII; A-Z are lower-cased.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Distinct words and occurrences of words in a slice, about; no more than the text over which it gets there.
WORDS = 500_000
OCCURRENCES = 2_000_000
#: Drawn or considered rows of a stretch of scores, about, and the most stretches.
STRETCH_ROWS = 100_000
STRETCHES = 2000


@dataclass(frozen=True)
class Draw:
    """Features are runs of ``shortest`` to ``longest`` words, hashed to ``buckets``; ``percent`` of the
    documents with ``least_words`` words are drawn."""

    shortest: int = 1
    longest: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def grams_of(tokens: np.ndarray, text: np.ndarray, n_words: int, draw: Draw) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The n-grams of a slice: which one, and whose, for each occurrence; and the distinct ones as word places.

    A run of n words is told by its first n - 1, as a number, and its last.
    """
    which, whose, distinct = [], [], []
    run, parts = tokens, np.arange(n_words)[:, None]
    for n in range(1, draw.longest + 1):
        if n > 1:
            pairs = run[:-1] * n_words + tokens[n - 1 :]
            pairs, run = np.unique(pairs, return_inverse=True)
            parts = np.column_stack([parts[pairs // max(n_words, 1)], pairs % max(n_words, 1)])
        if n >= draw.shortest:
            inside = text[: len(run)] == text[n - 1 :]
            seen, own = np.unique(run[inside], return_inverse=True)
            which.append(own + sum(map(len, distinct)))
            whose.append(text[: len(run)][inside])
            distinct.append(parts[seen])
    return np.concatenate(which), np.concatenate(whose), distinct


def small(values: np.ndarray) -> bytes:
    """Numbers from 0 up in two bytes each if these do, else in four."""
    size = "<u2" if not len(values) or values.max() < 1 << 16 else "<u4"
    return size.encode() + values.astype(size).tobytes()


def opened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[3:], raw[:3].decode())


def sliced(docs: DataFrame, draw: Draw, key: str, text: str) -> DataFrame:
    """Rows of slices: words, grams (places in words, by length), how often each, and of each document its key, n_words and grams."""
    kind = docs.schema[key].dataType.simpleString()

    def slice_of(index: dict[bytes, int], keys: list, texts: list[np.ndarray]) -> dict:
        sizes = np.array([len(t) for t in texts], np.int64)
        tokens = np.concatenate(texts).astype(np.int64)
        which, whose, distinct = grams_of(tokens, np.repeat(np.arange(len(texts)), sizes), len(index), draw)
        return {
            "words": [w.decode("utf-8", "replace") for w in index],
            "grams": [small(grams.ravel()) for grams in distinct],
            "often": small(np.bincount(which, minlength=sum(map(len, distinct)))),
            "keys": keys,
            "n_words": sizes,
            "n_features": np.bincount(whose, minlength=len(texts)),
            "held": small(which[np.argsort(whose, kind="stable")]),
        }

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, keys, texts, size = {}, [], [], 0
        for batch in batches:
            for k, t in zip(batch["key"].astype(object).where(batch["key"].notna(), None), batch["text"], strict=True):
                words = (t or "").encode("utf-8", "replace").translate(LETTERS).split()
                keys.append(k)
                texts.append(np.array([index.setdefault(w, len(index)) for w in words], np.int32))
                size += len(words)
                if len(index) >= WORDS or size >= OCCURRENCES or len(keys) >= OCCURRENCES:
                    yield pd.DataFrame([slice_of(index, keys, texts)])
                    index, keys, texts, size = {}, [], [], 0
        if keys:
            yield pd.DataFrame([slice_of(index, keys, texts)])

    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    return rows.mapInPandas(
        cut,
        f"words array<string>, grams array<binary>, often binary, keys array<{kind}>, n_words array<long>, n_features array<long>, held binary",
    ).withColumn("slice", F.monotonically_increasing_id())


def numbered(slices: DataFrame, dictionary: DataFrame, draw: Draw) -> DataFrame:
    """(slice, place, tuple, often): the distinct n-grams of each slice as tuples of the dictionary's integers."""

    def number(whole: pd.DataFrame, local: pd.DataFrame) -> pd.DataFrame:
        ids = np.empty(len(local), np.int64)
        ids[local["place"].to_numpy()] = local["id"].to_numpy()
        tuples = []
        for n, raw in zip(range(draw.shortest, draw.longest + 1), whole["grams"].iloc[0], strict=True):
            tuples += list(ids[opened(raw).reshape(-1, n)])
        return pd.DataFrame({"slice": whole["slice"].iloc[0], "place": np.arange(len(tuples)), "tuple": tuples, "often": opened(whole["often"].iloc[0])})

    local = slices.select("slice", F.posexplode("words").alias("place", "word")).join(dictionary, "word").select(F.col("slice").alias("of"), "place", "id")
    grams = slices.where(F.size("words") > 0).select("slice", "grams", "often")
    met = grams.groupBy("slice").cogroup(local.groupBy("of"))  # one row of grams, and as many of words as the slice has
    return met.applyInPandas(number, "slice long, place int, tuple array<long>, often long")


def hashed(tuples: DataFrame, dictionary: DataFrame, buckets: int) -> DataFrame:
    """``tuples`` (one row each) with the bucket of the bytes that each stands for."""
    words = tuples.select("tuple", F.posexplode("tuple").alias("place", "id")).join(dictionary, "id")
    whole = words.groupBy("tuple").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    text = F.array_join(F.transform("w", lambda w: w["word"]), " ")
    return whole.select("tuple", F.pmod(F.crc32(text.cast("binary")), F.lit(buckets)).alias("bucket")).join(tuples, "tuple")


def gains(counted: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for the buckets that hold features: ``buckets`` rows at most."""
    each = counted.groupBy("bucket").agg(F.sum("raw").cast("double").alias("s"), F.sum("target").cast("double").alias("t"))
    total = each.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return each.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the key alone."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296)))


def weighed(docs: DataFrame, target: DataFrame, draw: Draw | None = None, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row for each document: its key, n_words, n_features and weight."""
    draw = draw or Draw()
    prepare(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "resample")
    kind = docs.schema[key].dataType.simpleString()
    own = scratch.keep(sliced(docs, draw, key, text), "slices", "zstd")
    aim = scratch.keep(sliced(target.select(F.lit(0).alias("key"), F.col(quoted(text)).alias("text")), draw, "key", "text"), "target")

    words = own.select("words").union(aim.select("words")).select(F.explode("words").alias("word")).distinct()
    dictionary = scratch.keep(words.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    grams = scratch.keep(numbered(own, dictionary, draw), "grams", "zstd")
    nothing = F.lit(0).cast("long")
    both = grams.select("tuple", F.col("often").alias("raw"), nothing.alias("target")).union(
        numbered(aim, dictionary, draw).select("tuple", nothing, "often")
    )
    distinct = both.groupBy("tuple").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counted = scratch.keep(hashed(scratch.keep(distinct, "tuples"), dictionary, draw.buckets), "counted")
    gain = counted.join(F.broadcast(gains(counted, draw.buckets)), "bucket").select("tuple", "gain")
    back = grams.select("slice", "place", "tuple").join(gain, "tuple").select(F.col("slice").alias("of"), "place", "gain")

    def add_up(whole: pd.DataFrame, gains: pd.DataFrame) -> pd.DataFrame:
        keys, n_words, n_features, held = whole[["keys", "n_words", "n_features", "held"]].iloc[0]
        each = np.zeros(len(gains), np.int64)
        each[gains["place"].to_numpy()] = gains["gain"].to_numpy()
        total = np.r_[0, np.cumsum(each[opened(held)])]
        ends = np.cumsum(n_features)
        return pd.DataFrame({"key": keys, "n_words": n_words, "n_features": n_features, "weight": total[ends] - total[ends - n_features]})

    rows = own.select("slice", "keys", "n_words", "n_features", "held").groupBy("slice").cogroup(back.groupBy("of"))
    return rows.applyInPandas(add_up, f"key {kind}, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def resample(docs: DataFrame, target: DataFrame, draw: Draw | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``weighed`` with ``score`` and ``rank``: 1, 2, 3 ... for the drawn documents, by score and then key; else null."""
    draw = draw or Draw()
    scratch = Scratch(docs.sparkSession, "resample")
    scored = weighed(docs, target, draw, key, text, scratch)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col(quoted(key)), draw.seed))
    scored = scratch.keep(scored, "scored")
    fit = (F.col("n_words") >= draw.least_words) & F.col("score").isNotNull()
    count = scored.where(fit).count()
    n_drawn = draw.percent * count // 100

    parts = min(count // STRETCH_ROWS + 2, STRETCHES)
    bounds = scored.where(fit).agg(F.percentile_approx("score", [k / parts for k in range(1, parts)]).alias("b")).first()["b"] or []
    higher = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b > F.col("score"))) if bounds else F.lit(0)
    dealt = scored.withColumn("stretch", F.when(fit, higher))
    sizes = {r["stretch"]: r["n"] for r in dealt.where(fit).groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).collect()}  # STRETCHES rows at most
    before, start = [], 0
    for stretch in sorted(sizes):
        if start < n_drawn:
            before.append((stretch, start))
        start += sizes[stretch]
    last = before[-1][0] if before else -1
    shift = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else F.create_map(F.lit(-1), F.lit(0))
    order = Window.partitionBy("stretch").orderBy(F.desc("score"), quoted(key), "n_features", "weight")
    place = (F.row_number().over(order) + F.get(F.map_values(F.map_filter(shift, lambda k, _: k == F.col("stretch"))), F.lit(0))).cast("long")
    ranked = dealt.where(F.col("stretch") <= last).withColumn("place", place)
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= n_drawn, F.col("place"))).drop("place")
    rest = dealt.where(F.coalesce(F.col("stretch") > last, F.lit(True))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.union(rest).drop("stretch")
