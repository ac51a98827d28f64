"""Language-model scores by deleted interpolation of word n-grams.

The probability of a token after another mixes the maximum-likelihood bigram and unigram
estimates and a uniform one.  The weights depend on how often the context was seen, in
buckets of powers of two, and are learned by expectation-maximisation on counts that are
held out: one fold of the training documents is deleted from the counts and predicted.

Counting keeps to keys.  Documents are dealt out evenly to chunks of about
``CHUNK_CHARS``, whatever their keys; each chunk sends its distinct n-grams, with their
counts in training documents, once to the range of the key space that they belong to, as
sorted and compressed arrays.  The range adds up the counts of all chunks and answers each
in the order of its question.  Where there are more than ``1 << LEVEL_BITS`` ranges they
are dealt in levels: as many chunks as a level has ranges merge their keys first, range by
range, and ask the next level as one; the answers come back the same way.  So a level has
at most ``1 << LEVEL_BITS`` rows for each chunk, the rows grow with the corpus and not with
its square, no range or chunk outgrows a task, and a frequent word is one key for each
chunk.  N-grams are compared as 64-bit hashes.

Null and empty texts have one token, the end.  Documents with a null key are scored but
neither held out nor learned from.  Repeated rows count and are scored as often as they
occur.  Without training documents every estimate but the uniform one is 0.  An empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.shared import Scratch, prepare
from tabscope.llm.words import STEP, mixed, slices, words_of

#: Characters of the texts in a chunk, and distinct keys in a range, about.
CHUNK_CHARS = 12_000_000
RANGE_KEYS = 1_500_000
#: Ranges that a chunk sends rows to, as a power of two; beyond them ranges are dealt in levels.
LEVEL_BITS = 8
#: Documents whose crc32 of the key leaves these when divided by FOLDS.
FOLDS, HELD_OUT, DELETED = 7, 2, 3

BUCKETS = 32
#: Steps of each halving in the histogram of held-out estimates.
FINE = 4
EM_ROUNDS = 60

END = mixed(np.array([0x656E64], np.uint64))[0]
UNIGRAM, BIGRAM = 0, 1


def fold(key: str) -> Column:
    return F.crc32(F.col(key).cast("string")) % FOLDS


def pressed(numbers: np.ndarray) -> bytes:
    """Whole numbers, byte by place, compressed."""
    planes = numbers.view(np.uint8).reshape(len(numbers), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpressed(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def packed(docs: DataFrame, key: str, text: str, chunk: Column) -> DataFrame:
    """(chunk, docs): the documents of each batch, by chunk, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for table in joined_batches(batches):
            order = table["chunk"].to_numpy()
            table = table.take(pa.array(np.argsort(order, kind="stable")))
            names, first = np.unique(table["chunk"].to_numpy(), return_index=True)
            blobs = []
            for a, b in zip(first, [*first[1:], table.num_rows], strict=True):
                sink = pa.BufferOutputStream()
                part = table.slice(a, b - a).drop_columns(["chunk"]).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                    out.write_table(part)
                blobs.append(sink.getvalue().to_pybytes())
            if blobs:
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(names, pa.int64()), "docs": pa.array(blobs, pa.binary())})

    rows = docs.select(
        chunk.alias("chunk"), F.col(key).cast("long").alias("key"), fold(key).alias("fold"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return rows.mapInArrow(pack, "chunk long, docs binary")


def joined_batches(batches: Iterator[pa.RecordBatch], most: int = 16_000_000) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Chunk:
    """Tokens of a chunk's documents and its distinct n-grams."""

    def __init__(self, blobs: pd.Series):
        table = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])
        self.key = table["key"]
        self.fold = table["fold"].fill_null(HELD_OUT).to_numpy()  # not learned from
        self.held_out = (table["fold"].fill_null(-1).to_numpy()) == HELD_OUT
        hashes, counts = [], []
        for part in slices(table["text"].to_pylist(), len):
            found = words_of(part)
            hashes.append(np.insert(found.hash, found.first[1:], END))
            counts.append(np.diff(found.first) + 1)
        token = np.concatenate(hashes)
        self.sizes = np.concatenate(counts)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.keys: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        self.keys[UNIGRAM], self.at[UNIGRAM] = np.unique(token, return_inverse=True)
        before = np.r_[END, token[:-1]]  # a document follows the end of another
        self.keys[BIGRAM], self.at[BIGRAM] = np.unique(mixed(before * STEP + token), return_inverse=True)
        self.context = np.r_[np.searchsorted(self.keys[UNIGRAM], END), self.at[UNIGRAM][:-1]]

    def questions(self, unit: int, bits: int, deleted: bool) -> Iterator[dict]:
        """Its keys in each range with their counts in training documents."""
        learned = np.repeat(self.fold != HELD_OUT, self.sizes)
        for kind, keys in self.keys.items():
            counts = np.bincount(self.at[kind], weights=learned, minlength=len(keys)).astype(np.int64)
            yield from ranges(kind, unit, bits, keys, counts, counts * deleted)

    def answers(self, rows: pd.DataFrame, column: str) -> dict[int, np.ndarray]:
        """For each kind, the answered counts in the order of its keys."""
        rows = rows.sort_values(["kind", "part"])
        return {
            kind: np.concatenate([unpressed(d, n, np.int64) for d, n in zip(own[column], own["n"], strict=True)])
            for kind, own in rows.groupby("kind")
        }


ASKED = "kind int, part long, unit long, n long, keys binary, total binary, deleted binary"
ANSWERED = "kind int, part long, unit long, n long, total binary, deleted binary"


def ranges(kind: int, unit: int, bits: int, keys: np.ndarray, total: np.ndarray, deleted: np.ndarray) -> Iterator[dict]:
    """The sorted keys of a unit (a chunk, or a block of them) in each range of the first ``bits``."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    names, first = np.unique(part, return_index=True)
    for name, a, b in zip(names.tolist(), first, [*first[1:], len(keys)], strict=True):
        yield {
            "kind": kind, "part": name, "unit": unit, "n": b - a, "keys": pressed(np.diff(keys[a:b], prepend=np.uint64(0))),
            "total": pressed(total[a:b]), "deleted": pressed(deleted[a:b]),
        }


class Merged:
    """The distinct keys of some questions of one range, with their counts added up."""

    def __init__(self, asked: pd.DataFrame):
        self.rows = asked
        keys = [np.cumsum(unpressed(d, n, np.uint64), dtype=np.uint64) for d, n in zip(asked["keys"], asked["n"], strict=True)]
        self.keys, self.at = np.unique(np.concatenate(keys), return_inverse=True)

    def summed(self, column: str) -> np.ndarray:
        counts = np.concatenate([unpressed(d, n, np.int64) for d, n in zip(self.rows[column], self.rows["n"], strict=True)])
        return np.bincount(self.at, weights=counts, minlength=len(self.keys)).astype(np.int64)  # exact below 2 ** 53

    def replies(self, total: np.ndarray, deleted: np.ndarray) -> pd.DataFrame:
        """The counts of the distinct keys, for each question in its order."""
        ends = np.cumsum(self.rows["n"].to_numpy())
        own = [self.at[e - n : e] for n, e in zip(self.rows["n"], ends, strict=True)]
        out = self.rows[["kind", "part", "unit", "n"]].copy()
        return out.assign(total=[pressed(total[at]) for at in own], deleted=[pressed(deleted[at]) for at in own])


def levels_of(bits: int) -> list[int]:
    """Bits of the ranges at each level, the last one with all of them."""
    levels = max(1, -(-bits // LEVEL_BITS))
    return [bits * (k + 1) // levels for k in range(levels)]


def answered(asked: DataFrame, levels: list[int], scratch: Scratch, before: int = 0) -> tuple[DataFrame, DataFrame]:
    """The counts of all units for every question, and rows of what each range has seen.

    ``levels`` are the bits of the ranges here and at each further level, ``before`` those of the level before.
    """
    group = ["kind", "part"]
    if len(levels) == 1:

        def add_up(batch: pd.DataFrame) -> pd.DataFrame:
            own = Merged(batch)
            total, deleted = own.summed("total"), own.summed("deleted")
            out = own.replies(total, deleted).assign(seen=0, tokens=0, gone=0)
            last = {"kind": batch["kind"].iloc[0], "part": batch["part"].iloc[0], "unit": -1, "n": 0, "total": b"", "deleted": b""}
            last |= {"seen": int((total > 0).sum()), "tokens": int(total.sum()), "gone": int(deleted.sum())}
            return pd.concat([out, pd.DataFrame([last])])

        found = asked.groupBy(*group).applyInPandas(add_up, ANSWERED + ", seen long, tokens long, gone long")
        found = scratch.keep(found, "counts")
        return found.where("unit >= 0").drop("seen", "tokens", "gone"), found.where("unit < 0")

    # as many units as the level has ranges become one: a group of one range of a block holds about a unit's keys
    asked = scratch.keep(asked, f"asked{len(levels)}")
    own_bits = levels[0] - before
    block = F.shiftright("unit", own_bits).alias("block")

    def merge(batch: pd.DataFrame) -> pd.DataFrame:
        own = Merged(batch)
        kind, unit = batch["kind"].iloc[0], batch["unit"].iloc[0] >> own_bits
        return pd.DataFrame(list(ranges(kind, unit, levels[1], own.keys, own.summed("total"), own.summed("deleted"))))

    def reply(batch: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total, deleted = (np.concatenate([unpressed(d, n, np.int64) for d, n in zip(rows[c], rows["n"], strict=True)]) for c in ("total", "deleted"))
        return Merged(batch).replies(total, deleted)

    asked_next = asked.groupBy(*group, block).applyInPandas(merge, ASKED)
    replies, seen = answered(asked_next, levels[1:], scratch, levels[0])
    coarse = F.shiftright("part", levels[1] - levels[0])
    back = asked.groupBy(*group, block).cogroup(
        replies.groupBy("kind", coarse.alias("coarse"), F.col("unit").alias("block"))
    ).applyInPandas(reply, ANSWERED)
    return back, seen


def estimates(context: np.ndarray, pair: np.ndarray, word: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the context, and the bigram and unigram estimates."""
    bucket = np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)
    return bucket, pair / np.maximum(context, 1), word / max(tokens, 1)


def expected(histogram: pd.DataFrame, uniform: float) -> np.ndarray:
    """Weights (bucket x bigram, unigram, uniform) that maximise the held-out likelihood."""
    value = lambda step: np.where(step == 0, 0.0, 2.0 ** (-(step - 1) / FINE))
    weights = np.full((BUCKETS, 3), 1 / 3)
    pooled = histogram.assign(bucket=-1)
    start = None
    for bucket, own in [(-1, pooled), *histogram.groupby("bucket")]:
        if not len(own):
            continue
        likely = np.stack([value(own["q2"].to_numpy()), value(own["q1"].to_numpy()), np.full(len(own), uniform)])
        n = own["n"].to_numpy()
        lam = np.full(3, 1 / 3)
        for _ in range(EM_ROUNDS):
            share = lam[:, None] * likely
            lam = (share / share.sum(axis=0) * n).sum(axis=1) / n.sum()
        lam = np.maximum(lam, 1e-6)
        if start is None:
            start = lam / lam.sum()
            weights[:] = start  # buckets without held-out tokens
        else:
            weights[bucket] = lam / lam.sum()
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]  # an unseen context says nothing
    return weights


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: held_out, n_tokens, n_known, train_tokens, base_score and score."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lm")
    chars = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    chunks = chars // CHUNK_CHARS + 1
    bits = max(0, int(np.ceil(np.log2(max(1, chars / 4 / RANGE_KEYS)))))
    # drawn by the row's place, since keys and texts may repeat; kept, so that all steps see the same chunks
    drawn = F.xxhash64(F.monotonically_increasing_id())
    is_deleted = F.coalesce(fold(key) == DELETED, F.lit(False))
    # the deleted fold has chunks of its own, so that it can be read alone
    chunk = F.when(is_deleted, chunks + F.pmod(drawn, F.lit(chunks // (FOLDS - 1) + 1))).otherwise(F.pmod(drawn, F.lit(chunks)))
    dealt = scratch.keep(packed(docs, key, text, chunk), "dealt")

    def ask(batch: pd.DataFrame) -> pd.DataFrame:
        own = batch["chunk"].iloc[0]
        return pd.DataFrame(list(Chunk(batch["docs"]).questions(own, levels[0], own >= chunks)))

    levels = levels_of(bits)
    asked = dealt.groupBy("chunk").applyInPandas(ask, ASKED)
    replies, totals = answered(asked, levels, scratch)
    replies = replies.withColumnRenamed("unit", "chunk")
    sums = totals.where(F.col("kind") == UNIGRAM).agg(F.sum("seen"), F.sum("tokens"), F.sum("gone")).first()
    seen, tokens, gone = (int(x or 0) for x in sums)

    def predict(docs_of: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(docs_of["docs"])
        total, deleted = c.answers(rows, "total"), c.answers(rows, "deleted")
        left = {kind: total[kind] - deleted[kind] for kind in total}
        bucket, p2, p1 = estimates(left[UNIGRAM][c.context], left[BIGRAM][c.at[BIGRAM]], left[UNIGRAM][c.at[UNIGRAM]], tokens - gone)
        with np.errstate(divide="ignore"):
            steps = [np.where(p > 0, 1 + np.round(-np.log2(p) * FINE), 0).astype(np.int64) for p in (p1, p2)]
        cells, n = np.unique(np.stack([bucket, *steps]), axis=1, return_counts=True)
        return pd.DataFrame({"bucket": cells[0], "q1": cells[1], "q2": cells[2], "n": n})

    histogram = (
        dealt.where(F.col("chunk") >= chunks)
        .groupBy("chunk")
        .cogroup(replies.where(F.col("chunk") >= chunks).groupBy("chunk"))
        .applyInPandas(predict, "bucket long, q1 long, q2 long, n long")
        .groupBy("bucket", "q1", "q2")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most buckets x steps x steps, whatever the corpus
    )
    weights = expected(histogram, 1 / (seen + 1))

    def score(docs_of: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(docs_of["docs"])
        total = c.answers(rows, "total")
        word = total[UNIGRAM][c.at[UNIGRAM]]
        bucket, p2, p1 = estimates(total[UNIGRAM][c.context], total[BIGRAM][c.at[BIGRAM]], word, tokens)
        lam = weights[bucket]
        mixed_p = lam[:, 0] * p2 + lam[:, 1] * p1 + lam[:, 2] / (seen + 1)
        add = lambda x: np.add.reduceat(x, c.first)
        return pd.DataFrame(
            {
                "key": c.key.to_pandas(integer_object_nulls=True),
                "held_out": c.held_out,
                "n_tokens": c.sizes,
                "n_known": add((word > 0).astype(np.int64)),
                "train_tokens": tokens,
                "base_score": add(np.log10((word + 1) / (tokens + seen + 1))),
                "score": add(np.log10(mixed_p)),
            }
        )

    found = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(
        score, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return found.withColumnRenamed("key", key)
