"""Near-duplicate passages across documents by compact windows.

A document is the sequence of its word shingles.  Under one hash function, the Cartesian
tree of the hashed sequence groups all subsequences by the place of their minimum: the
compact window (left, place, right) stands for every subsequence within left and right
that holds the place.  Windows of at least the least passage length are posted under
their minimum; passages that two documents share have the same minimum, so their windows
meet in its list.

Within a list, windows are laid over each other at their places and the shingles in
reach are compared, with the other side of one insertion or deletion moved by up to
``DRIFT``.  The list's first window meets all others, then the next one meets those that
are still without a partner, and so on: copies cost one comparison each, and a window
stays alone only if it was held against every other one of its list.  The intervals
confirmed under all hash functions are then joined, for each document, into passages.

* Equal passages share a list under every hash function, so they are never missed; two at
  the threshold share none with a chance of (1 - SIMILARITY) ** HASHES, 0.0016.
* Shingles that many documents have (``COMMON`` or more, counted over all of them) are
  ranked behind all others, so that a frequent line isn't the minimum of windows that
  reach beyond it.  The ranking is the same for all documents; it changes how long the
  lists are, not what equal passages share.
* Lists beyond ``BLOCK`` windows are dealt to blocks, more of them the longer a list is:
  first each block by itself, then what stays alone against all other blocks.
* Fixed-size filters of the minima that several documents have, and of those with long
  lists, tell each window what to do without a join; a fuller filter only lets more pass or
  deals more blocks.
* Shingles are compared by 8 bits of their hashes: an unlike one passes for equal once in
  255, so that a passage of similarity 0.77 passes for one of 0.8 with a chance of 0.02.

Null and empty texts and those shorter than a passage have no windows.  Texts of any
length are taken whole; one that repeats a shingle over and over posts it at the ends of
the repetition and every ``SPARSE`` words within.  Rows with a null key are left out; rows
that share a key count as one document.  Repeats within one document alone aren't
reported.  Equally good partners: the smallest key.  An empty table gives an empty one;
further columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.shared import FILTER_BITS, Scratch, key_filter, passing, prepare
from tabscope.llm.words import STEP, joined, mixed, slices, words_of

#: Words in a shingle, and in the shortest passage.
SHINGLE = 5
LEAST_WORDS = 50
HASHES = 4
SIMILARITY = 0.8
#: Words that an insertion or deletion may move the rest of a passage by.
DRIFT = 8
#: Documents from which on a shingle is ranked behind others.
COMMON = 1024
#: Without effect since all rows are counted; the name stays for callers that set it.
SAMPLED = 1
#: Cells that shingles are first counted in, and cells of a range.
CELLS, RANGE = 1 << 24, 1 << 17
#: Distinct shingles that a task counts before it sends them.
HELD = 500_000
#: Windows of a list that meet in one group, and windows of all lists in a task, about.
BLOCK = 2000
MEET = 20_000
#: Such groups in a partition: the work hangs on the windows, not on their bytes.
GROUPS = 4
#: Windows that ask in a group of the second meeting, about.
ASKERS = 50
#: Pairs of windows compared at once.
PAIRS = 20_000
#: Blocks of a list grow by this factor with its size, as often as LEVELS.
FACTOR, LEVELS = 4, 9
#: Bits of the filter of minima.
MINIMA_BITS = 1 << 26
#: Windows sent at once.
SENT = 50_000
#: Words from one post of an evenly repeated shingle to the next.
SPARSE = 16

FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * STEP) | np.uint64(1)
#: Outweighs all places that agree.
OUTSIDE = np.int8(-120)
BEHIND = np.uint64(1) << np.uint64(63)
LINKED = pa.schema(
    [("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("of", pa.int64()), ("of_start", pa.int32()), ("similarity", pa.float64())]
)
LINKS = "key long, start int, end int, of long, of_start int, similarity double"
MEMBERS = "value long, own int, blocks int, key long, place int, before int, around binary"
ASKING = "value long, one int, other int, asks boolean, key long, place int, before int, around binary"


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    found = words_of(texts)
    grams = joined(found.hash, SHINGLE)
    ends = np.maximum(found.first[1:] - SHINGLE + 1, found.first[:-1])
    return [grams[a:b] for a, b in zip(found.first[:-1].tolist(), ends.tolist(), strict=True)]


def sliding(best: np.ufunc, values: np.ndarray, n: int) -> np.ndarray:
    """The least or greatest of each n values in a row."""
    size = 1
    while 2 * size <= n:
        values, size = best(values[:-size], values[size:]), 2 * size
    return best(values[: len(values) - n + size], values[n - size :]) if size < n else values


def compact_windows(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, place of the minimum, right) of the nodes of the Cartesian trees that are wide enough.

    Zeros part one sequence from the next.  Equal minima of one node share its bounds.
    """
    if len(values) < least:
        return (np.empty(0, np.int64),) * 3
    # only minima of some ``least`` values in a row have wide windows, and only such ones bound them
    edge = np.zeros(least - 1, values.dtype)
    lowest = np.concatenate([edge, sliding(np.minimum, values, least), edge])
    places = np.flatnonzero(values <= sliding(np.maximum, lowest, least))
    place = np.r_[-1, places, len(values)]
    value = np.r_[np.zeros(1, values.dtype), values[places], np.zeros(1, values.dtype)]
    inner = np.flatnonzero(value)

    def nearest_smaller(step: int) -> np.ndarray:
        """The nearest smaller value on one side, by jumps over what is known to be no smaller."""
        to = np.arange(len(value)) + step
        live = inner
        while len(live):
            live = live[value[to[live]] >= value[live]]
            to[live] = to[to[live]]
        return to

    left, right = place[nearest_smaller(-1)[inner]] + 1, place[nearest_smaller(1)[inner]] - 1
    wide = right - left + 1 >= least
    return left[wide], place[inner][wide], right[wide]


def thinned(left: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which windows to keep where a minimum repeats closely within one node: the ends, and one in SPARSE words."""
    order = np.lexsort((place, left, value))
    v, p = value[order], place[order]
    joins = np.r_[False, (v[1:] == v[:-1]) & (left[order][1:] == left[order][:-1]) & (p[1:] - p[:-1] < SPARSE)]
    first = np.maximum.accumulate(np.where(joins, 0, np.arange(len(p))))
    part = (p - p[first]) // SPARSE
    keep = ~joins | ~np.r_[joins[1:], False] | (part != np.r_[-1, part[:-1]])
    out = np.empty(len(p), bool)
    out[order] = keep
    return out


def crowded_cells(texts: DataFrame) -> np.ndarray:
    """Filter of the cells, of ``CELLS``, that ``COMMON`` shingles or more fall in, a text's repeated ones included.

    A task counts in an array of a fixed size and sends it in ranges, each count up to ``COMMON``.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part in slices(batch["text"].tolist(), lambda t: len(t or "")):
                np.add.at(counts, (np.concatenate(shingles(part)) & np.uint64(CELLS - 1)).view(np.int64), np.uint32(1))
        for k, own in enumerate(counts.reshape(-1, RANGE)):
            if own.any():
                yield pd.DataFrame({"part": [k], "counts": [zlib.compress(np.minimum(own, COMMON).astype(np.uint16).tobytes(), 1)]})

    def crowded(sent: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(RANGE, np.int64)
        for data in sent["counts"]:
            total += np.frombuffer(zlib.decompress(data), np.uint16)
        return pd.DataFrame({"place": np.flatnonzero(total >= COMMON) + int(sent["part"].iloc[0]) * RANGE})

    return key_filter(texts.mapInPandas(count, "part long, counts binary").groupBy("part").applyInPandas(crowded, "place long"), CELLS)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of some counts and their sums."""
    gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    gram, at = np.unique(gram, return_inverse=True)
    return gram, np.bincount(at, n, len(gram)).astype(np.int64)


def counted_grams(batches: Iterator[pd.DataFrame], cells: np.ndarray) -> Iterator[pd.DataFrame]:
    """How many texts have each shingle of the cells: sums over all batches, or over runs with ``HELD`` distinct ones and more."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch["text"].tolist(), lambda t: len(t or "")):
            own = shingles(part)
            flat = np.concatenate(own)
            hit = np.flatnonzero(passing(cells, (flat & np.uint64(CELLS - 1)).view(np.int64)))
            ends = np.searchsorted(hit, np.cumsum([len(g) for g in own]))
            some = np.flatnonzero(np.diff(ends, prepend=0))
            if len(some):
                each = [np.unique(flat[hit[a:b]]) for a, b in zip([0, *ends[some[:-1]]], ends[some], strict=True)]
                held.append(np.unique(np.concatenate(each), return_counts=True))
                size += len(held[-1][0])
            if size >= 2 * HELD:
                held = [summed(held)]
                size = len(held[0][0])
                if size >= HELD:
                    yield pd.DataFrame({"gram": held[0][0].view(np.int64), "n": held[0][1]})
                    held, size = [], 0
    if held:
        gram, n = summed(held)
        yield pd.DataFrame({"gram": gram.view(np.int64), "n": n})


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Filter of the shingles that ``COMMON`` rows or more have, counted exactly over all of them.

    Only shingles of crowded cells can be; so only these are counted one by one, and sent as
    sums: a task's rows hang on its distinct shingles there, not on how often they occur.
    """
    texts = rows.select("text")
    cells = crowded_cells(texts)
    if not cells.any():
        return np.zeros(FILTER_BITS // 8, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from counted_grams(batches, sent.value)

    grams = texts.mapInPandas(cut, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return key_filter(grams.where(F.col("n") >= COMMON).select(F.col("gram").bitwiseAND(FILTER_BITS - 1)))


def posted(texts: list[str | None], least: int, common: np.ndarray):
    """Shingles of all texts, zeros between; and for each hash function minima, their texts and windows."""
    own = shingles(texts)
    sizes = np.array([len(g) + 1 for g in own])
    flat = np.concatenate([x for g in own for x in (g, np.zeros(1, np.uint64))])
    ends = np.cumsum(sizes)
    flat[ends - 1] = 0
    behind = passing(common, (flat & np.uint64(FILTER_BITS - 1)).astype(np.int64)).astype(np.uint64) * BEHIND if common.any() else np.uint64(0)
    found = []
    for factor in FACTORS:
        rank = (((flat * factor) >> np.uint64(1)) | np.uint64(1)) | behind
        rank[ends - 1] = 0
        left, place, right = compact_windows(rank, least)
        value = rank[place] * STEP  # spread again, as minima are small numbers
        text = np.searchsorted(ends, place, side="right")
        keep = thinned(left, place, value)
        found.append((value[keep], text[keep], left[keep], place[keep], right[keep]))
    return flat, ends - sizes, [np.concatenate(x) for x in zip(*found, strict=True)]


def in_slices(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    for part in slices(list(zip(batch["key"].tolist(), batch["text"].tolist(), strict=True)), lambda x: len(x[1] or "")):
        yield np.array([k for k, _ in part], np.int64), [t for _, t in part]


def posts(rows: DataFrame, least: int, common) -> DataFrame:
    """(value, key) of every window of (key, text) rows."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, texts in in_slices(batch):
                value, text, *_ = posted(texts, least, common.value)[2]
                yield pd.DataFrame({"value": value.view(np.int64), "key": keys[text]})

    return rows.mapInPandas(post, "value long, key long")


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of bytes as they follow one another."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def spot(*numbers: np.ndarray) -> np.ndarray:
    """Where some numbers together stand in a filter."""
    out = np.zeros(len(numbers[0]), np.uint64)
    for x in numbers:
        out = mixed(out * STEP + x.astype(np.int64).view(np.uint64) + STEP)
    return (out & np.uint64(FILTER_BITS - 1)).astype(np.int64)


class Filters:
    """What tells a window its way: fixed-size filters of minima, and, for the second meeting, of who asks."""

    def __init__(self, repeated: np.ndarray, longer: list[np.ndarray]):
        self.repeated, self.longer = repeated, longer
        self.lists = self.blocks = self.windows = self.keys = None

    def blocks_of(self, value: np.ndarray) -> np.ndarray:
        at = (value & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        out = np.ones(len(value), np.int32)
        for k, bits in enumerate(self.longer, 1):
            out = np.where(passing(bits, at), np.int32(FACTOR**k), out)
        return out


def members_of(keys: np.ndarray, texts: list[str | None], least: int, common: np.ndarray, filters: Filters):
    """Windows of a slice of texts whose minima several documents have, with the shingles about the place."""
    reach = least - 1 + DRIFT
    flat, first, (value, text, left, place, right) = posted(texts, least, common)
    hit = passing(filters.repeated, (value & np.uint64(MINIMA_BITS - 1)).astype(np.int64))
    blocks = filters.blocks_of(value)
    if filters.lists is not None:
        hit &= (blocks > 1) & passing(filters.lists, spot(value.view(np.int64)))
    value, text, place, blocks = value[hit], text[hit], place[hit], blocks[hit]
    left, right = np.maximum(left[hit], place - reach), np.minimum(right[hit], place + reach)
    own_place = (place - first[text]).astype(np.int32)
    key = keys[text]
    own = (mixed(key.view(np.uint64) * STEP + own_place.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int32)
    sizes = right - left + 1
    ends = np.cumsum(sizes)
    inner = np.arange(ends[-1] if len(ends) else 0) + np.repeat(left - (ends - sizes), sizes)
    around = np.maximum(flat[inner] >> np.uint64(56), np.uint64(1)).astype(np.uint8)
    return pa.table({
        "value": value.view(np.int64), "own": own, "blocks": blocks, "key": key, "place": own_place,
        "before": (place - left).astype(np.int32), "around": binary(around, sizes),
    })


def members(rows: DataFrame, least: int, common, filters) -> DataFrame:
    """Windows that may meet others.

    ``around`` holds 8 bits of each shingle about the place, ``before`` of them before it;
    ``own`` is the window's block of its list.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in in_slices(batch.to_pandas()):
                yield from members_of(keys, texts, least, common.value, filters.value).to_batches()

    return rows.mapInArrow(post, MEMBERS)


def asking(rows: DataFrame, least: int, common, filters) -> DataFrame:
    """Windows without a partner for each other block of their list, and all windows for the blocks that ask.

    Only documents with windows in split lists are cut into shingles again.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passing(filters.value.keys, spot(batch["key"].to_numpy()))))
            for keys, texts in in_slices(batch.to_pandas()):
                table = members_of(keys, texts, least, common.value, filters.value)
                most = max([1, *table["blocks"].to_pylist()])
                for a in range(0, table.num_rows, SENT // most + 1):
                    yield from addressed(table.slice(a, SENT // most + 1), filters.value).to_batches()

    return rows.mapInArrow(post, ASKING)


def addressed(table: pa.Table, filters: Filters) -> pa.Table:
    value, own, blocks, key, place = (table[c].to_numpy() for c in ("value", "own", "blocks", "key", "place"))
    row = np.repeat(np.arange(len(value)), blocks)
    block = (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)).astype(np.int32)
    other = block != own[row]
    asks = np.flatnonzero(other & passing(filters.windows, spot(value, key, place))[row])
    asked = np.flatnonzero(other & passing(filters.blocks, spot(value[row], block)))
    out = table.take(np.r_[row[asks], row[asked]]).drop_columns(["own", "blocks"])
    one, two = np.r_[own[row[asks]], block[asked]], np.r_[block[asks], own[row[asked]]]
    flag = np.r_[np.ones(len(asks), bool), np.zeros(len(asked), bool)]
    named = {"value": out["value"], "one": pa.array(one, pa.int32()), "other": pa.array(two, pa.int32()), "asks": pa.array(flag)}
    return pa.table(named | {c: out[c] for c in ("key", "place", "before", "around")})


def laid(before: np.ndarray, around: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """One row for each window with its place in the middle, and where shingles stand; 0 where none does."""
    lengths = np.fromiter(map(len, around), np.int64, len(around))
    data = np.frombuffer(b"".join(around), np.uint8)
    width = 2 * reach + 1
    out, there = np.zeros((len(around), width), np.uint8), np.zeros((len(around), width), bool)
    starts = np.arange(len(around)) * width + reach - before
    at = np.arange(len(data)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out.ravel()[at], there.ravel()[at] = data, True
    return out, there


def best_windows(equal: np.ndarray, moved: int | np.ndarray, least: int | np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """For each row the interval about the middle that is alike: start, end and similarity (0 if none).

    ``equal`` is 1 where shingles agree, 0 where not, and ``OUTSIDE`` beyond either window.
    The interval holds the ``least`` places in a row, the middle among them, that have most
    in common, and what is equal right beside them; the other side has ``moved`` words more.
    ``moved`` and ``least`` are one number for all rows, or one for each.
    """
    rows, width = np.arange(len(equal)), equal.shape[1]
    total = np.zeros((len(equal), width + 1), np.int16)
    np.cumsum(equal, axis=1, out=total[:, 1:])
    if np.ndim(least):
        places = np.arange(reach + 1)
        held = np.take_along_axis(total, places + least[:, None], 1) - total[:, : reach + 1]
        held[places <= reach - least[:, None]] = np.iinfo(np.int16).min
        start = held.argmax(axis=1)
        fine = (1 + SIMILARITY) * held[rows, start] >= SIMILARITY * (2 * least + moved) - 1e-9
    else:
        low = reach - least + 1
        held = total[:, low + least : reach + least + 1] - total[:, low : reach + 1]
        start = held.argmax(axis=1)
        fine = (1 + SIMILARITY) * held[rows, start] >= SIMILARITY * (2 * least + moved) - 1e-9
        start = start + low
    begin, end, alike = start.copy(), start + least, np.zeros(len(equal))
    rows = np.flatnonzero(fine)  # only these grow
    at, agree = np.arange(width, dtype=np.int16), equal[rows] > 0
    before = np.full((len(rows), width + 1), -1, np.int16)  # the last unequal place before each
    np.maximum.accumulate(np.where(agree, np.int16(-1), at), axis=1, out=before[:, 1:])
    after = np.full((len(rows), width + 1), width, np.int16)
    np.minimum.accumulate(np.where(agree, np.int16(width), at)[:, ::-1], axis=1, out=after[:, -2::-1])
    own = np.arange(len(rows))
    begin[rows], end[rows] = before[own, begin[rows]].astype(np.int64) + 1, after[own, end[rows]]
    both = total[rows, end[rows]] - total[rows, begin[rows]]
    more = moved[rows] if np.ndim(moved) else moved
    alike[rows] = both / np.maximum(2 * (end[rows] - begin[rows]) + more - both, 1)
    return begin, end, alike


def beyond(grams: np.ndarray, turn: np.ndarray, after: bool) -> np.ndarray:
    """Of each row the places from the first whole shingle beyond ``turn`` on, outwards; 0 beyond the row."""
    steps = SHINGLE - 1 + np.arange(DRIFT + 3)
    edge = int(steps[-1]) + 1
    out = np.zeros((len(grams), grams.shape[1] + 2 * edge), grams.dtype)
    out[:, edge:-edge] = grams
    return np.take_along_axis(out, edge + turn[:, None] + (steps if after else -steps), 1)


def compared(grams: np.ndarray, there: np.ndarray, a: np.ndarray, b: np.ndarray, least: int, reach: int) -> tuple[np.ndarray, ...]:
    """Intervals of the rows ``a`` of the grid that the rows ``b`` have alike: start, end, start and end in b, similarity.

    Rows that don't come out alike as they lie are tried with one side moved: an insertion
    or deletion leaves the middle's own side where it is.
    """
    width = grams.shape[1]
    mine = grams[a]
    agree = mine == grams[b]
    agree &= mine != 0
    own = agree.sum(axis=1, dtype=np.uint8)
    start, end, first, last = (np.zeros(len(a), np.int64) for _ in range(4))
    alike = np.zeros(len(a))
    enough = SIMILARITY * 2 * least / (1 + SIMILARITY) - 1e-9
    few = np.flatnonzero(own >= enough)
    start[few], end[few], alike[few] = best_windows(np.where(there[a[few]] & there[b[few]], agree[few], OUTSIDE), 0, least, reach)
    first[few], last[few] = start[few], end[few]

    todo = np.flatnonzero((alike == 0) & (own >= least // 4))
    moves = np.array([m for d in range(1, DRIFT + 1) for m in (d, -d)])
    ours, theirs = mine[todo], grams[b[todo]]
    for after in (True, False):
        side = agree[todo, reach:] if after else agree[todo, reach::-1]
        gap = np.where(side.all(axis=1), reach + 1, side.argmin(axis=1))
        turn = reach + gap if after else reach - gap
        x, y = beyond(ours, turn, after), beyond(theirs, turn, after)
        resumes = np.zeros((len(todo), len(moves)), bool)  # whether they agree again right beyond the edit
        longer, shorter = (resumes[:, 0::2], resumes[:, 1::2]) if after else (resumes[:, 1::2], resumes[:, 0::2])
        for k in (0, 2):
            one, far = x[:, k, None], slice(k + 1, k + 1 + DRIFT)
            longer |= (one == y[:, far]) & (one != 0)
            one = y[:, k, None]
            shorter |= (one == x[:, far]) & (one != 0)
        resumes &= alike[todo, None] == 0
        m, row = np.nonzero(resumes.T)  # smaller moves first
        for k in range(0, len(m), PAIRS):
            few = todo[row[k : k + PAIRS]]
            found = turned(grams, a[few], b[few], moves[m[k : k + PAIRS]], after, least, reach)
            good = np.flatnonzero((found[-1] > 0) & (alike[few] == 0))
            good = good[np.unique(few[good], return_index=True)[1]]
            for out, x in zip((start, end, first, last, alike), found, strict=True):
                out[few[good]] = x[good]
    return start, end, first, last, alike


def turned(grams: np.ndarray, a: np.ndarray, b: np.ndarray, moved: np.ndarray, after: bool, least: int, reach: int) -> tuple[np.ndarray, ...]:
    """As ``compared``, with one side of b, ``after`` or before the middle, moved."""
    width, at = grams.shape[1], np.arange(grams.shape[1])
    mine, theirs = grams[a], np.zeros((len(a), width + 2 * DRIFT), grams.dtype)
    theirs[:, DRIFT:-DRIFT] = grams[b]

    def alike_at(other: np.ndarray) -> np.ndarray:
        return np.where((mine != 0) & (other != 0), mine == other, OUTSIDE)

    kept = alike_at(theirs[:, DRIFT:-DRIFT])
    gone = alike_at(np.take_along_axis(theirs, at + DRIFT + moved[:, None], 1))
    if not after:
        kept, gone = kept[:, ::-1], gone[:, ::-1]
    # up to which place the own side goes on
    score = np.cumsum((kept > 0).astype(np.int16) - (gone > 0), axis=1)
    score[:, :reach] = -2 * width
    turn = score.argmax(axis=1)
    path = np.where(at <= turn[:, None], kept, gone)
    if not after:
        path, turn = path[:, ::-1], width - 1 - turn
    more = moved if after else -moved
    # both sides are as long as a passage
    start, end, alike = best_windows(path, more, least + np.maximum(0, -more), reach)
    first = start + np.where(start < turn, 0 if after else moved, 0)
    last = end + np.where(end > turn + 1, moved if after else 0, 0)
    return start, end, first, last, alike


def met(value: np.ndarray, key: np.ndarray, asks: np.ndarray, against: np.ndarray | None, look) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, sorted by value, that hold together; ``look`` tells which of given pairs do.

    A few rows of each list after the other meet the later ones; pairs in which both have a
    partner, that belong to one document or, with ``against``, to one side are left out.
    ``asks`` tells which rows need a partner, and does so afterwards.
    """
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    ends = np.r_[starts[1:], len(value)]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    live = ends - starts > 1
    pivot, ends = starts[live], ends[live]
    while len(pivot):
        few = max(1, PAIRS // int((ends - pivot).sum()))
        first = (pivot[:, None] + np.arange(few)).ravel()
        end = np.repeat(ends, few)
        first, end = first[first < end - 1], end[first < end - 1]
        sizes = end - first - 1
        cuts = np.cumsum(sizes)
        row = np.arange(cuts[-1]) + np.repeat(first + 1 - (cuts - sizes), sizes)
        first = np.repeat(first, sizes)
        pick = (asks[row] | asks[first]) & (key[row] != key[first])
        if against is not None:
            pick &= against[row] != against[first]
        first, row = first[pick], row[pick]
        for k in range(0, len(row), PAIRS):
            good = look(first[k : k + PAIRS], row[k : k + PAIRS])
            one, other = first[k : k + PAIRS][good], row[k : k + PAIRS][good]
            asks[one] = asks[other] = False
            out.append((one, other))
        open_after = np.r_[0, np.cumsum(asks)]
        pivot = np.minimum(pivot + few, ends)
        live = (ends - pivot > 1) & (open_after[ends] > open_after[pivot])
        pivot, ends = pivot[live], ends[live]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2


def copied(lists: np.ndarray, key: np.ndarray, before: np.ndarray, around: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one list that are equal as far as they go, each with the first of its kind, but for those of one document."""
    kinds: dict[tuple, int] = {}
    named = enumerate(zip(lists.tolist(), before.tolist(), around, strict=True))
    head = np.fromiter((kinds.setdefault(kind, i) for i, kind in named), np.int64, len(key))
    two = np.flatnonzero(key != key[head])
    return head[two], two


def linked(table: pa.Table, by: list[str], least: int, sides: bool = False) -> tuple[pa.Table, pa.Table, pa.Table]:
    """Links of the windows of some lists, those windows, and the windows that stay alone; with ``sides``, of who asks with who doesn't."""
    reach = least - 1 + DRIFT
    columns = [table[c].to_numpy() for c in ("place", "key", *by)]
    if sides:  # who asks comes first
        columns.insert(2, ~table["asks"].to_numpy(zero_copy_only=False))
    table = table.take(np.lexsort(columns))
    lists = table[by[0]].to_numpy()
    for c in by[1:]:
        lists = mixed(lists.view(np.uint64) * STEP + table[c].to_numpy().astype(np.uint64)).view(np.int64)
    key, place, before, around = table["key"].to_numpy(), table["place"].to_numpy(), table["before"].to_numpy(), table["around"].to_pylist()
    grams, there = laid(before, around, reach)
    against = table["asks"].to_numpy(zero_copy_only=False) if sides else None
    asks = against.copy() if sides else np.ones(len(key), bool)
    one, two = (np.empty(0, np.int64),) * 2 if sides else copied(lists, key, before, around)
    asks[one] = asks[two] = False
    from_, to = reach - before[one].astype(np.int64), reach - before[one] + there[one].sum(axis=1)
    kept = [(from_, to, from_, to, np.ones(len(one)))]

    def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = compared(grams, there, a, b, least, reach)
        good = found[-1] > 0
        kept.append(tuple(x[good] for x in found))
        return good

    one, two = (np.concatenate(x) for x in zip((one, two), met(lists, key, asks, against, look), strict=True))
    start, end, first, last, alike = (np.concatenate(x) for x in zip(*kept, strict=True))
    mine, theirs = place[one] - reach, place[two] - reach  # where the rows of the grid begin
    found = pd.DataFrame(
        {
            "row": np.r_[two, one], "key": np.r_[key[two], key[one]],
            "start": np.r_[theirs + first, mine + start], "end": np.r_[theirs + last, mine + end],
            "of": np.r_[key[one], key[two]], "of_start": np.r_[mine + start, theirs + first], "similarity": np.r_[alike, alike],
        }
    )
    # a window needs one partner, that with the smallest key
    found = found.sort_values(["row", "of"], kind="stable").drop_duplicates("row")
    return pa.Table.from_pandas(found, LINKED, preserve_index=False), table.take(found["row"].to_numpy()), table.filter(pa.array(asks))


def linked_lists(windows: DataFrame, least: int, rows: int) -> DataFrame:
    """Links within lists or their blocks; and, with no ``of`` but ``own``, windows of split lists that stay alone.

    Both have the list's ``value`` where it is split.
    """

    def meet(table: pa.Table) -> pa.Table:
        links, mine, alone = linked(table, ["value", "own"], least)
        alone = alone.filter(pc.greater(alone["blocks"], 1))
        none = lambda kind: pa.nulls(len(alone), kind)
        left = {c.name: none(c.type) for c in LINKED} | {"key": alone["key"], "start": alone["place"]}
        split = pc.if_else(pc.greater(mine["blocks"], 1), mine["value"], pa.scalar(None, pa.int64()))
        links = links.append_column("value", split).append_column("own", pa.nulls(len(links), pa.int32()))
        return pa.concat_tables([links, pa.table(left | {"value": alone["value"], "own": alone["own"]}, links.schema)])

    # lists share a group: a call for each would cost more than its work
    groups = rows // MEET + 1
    dealt = windows.withColumn("near", F.pmod(F.xxhash64("value", "own"), F.lit(groups))).repartition(groups // GROUPS + 1, "near")
    return dealt.groupBy("near").applyInArrow(meet, f"{LINKS}, value long, own int")


def linked_blocks(windows: DataFrame, least: int, alone: int) -> DataFrame:
    """Links of the windows that ask with those of other blocks."""

    def meet(table: pa.Table) -> pa.Table:
        return linked(table, ["value", "one", "other"], least, sides=True)[0]

    near = F.pmod(F.xxhash64("value", "one", "other"), F.lit(alone // ASKERS + 1))
    return windows.groupBy(near).applyInArrow(meet, LINKS)


def passages(links: DataFrame) -> DataFrame:
    """Intervals of a document and a partner that overlap on one diagonal as one; those within another left out."""
    shift = (F.col("start") - F.col("of_start")).alias("shift")
    own = links.withColumn("shift", shift)
    line = Window.partitionBy("key", "of").orderBy("start", "end", "shift")
    so_far = line.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce((F.col("start") > F.max("end").over(so_far)) | (F.abs(F.col("shift") - F.lag("shift").over(line)) > DRIFT), F.lit(True))
    islands = own.withColumn("island", F.sum(fresh.cast("int")).over(line)).groupBy("key", "of", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("of_start").alias("of_start"), F.min("similarity").alias("similarity")
    )
    order = Window.partitionBy("key").orderBy("start", F.col("end").desc(), "of", "of_start")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return islands.withColumn("reached", reached).where(F.col("reached").isNull() | (F.col("end") > F.col("reached"))).drop("island", "reached")


def spots_of(rows: DataFrame, *columns: str) -> DataFrame:
    """As ``spot``, of columns."""

    @F.pandas_udf("long")
    def place(*values: pd.Series) -> pd.Series:
        return pd.Series(spot(*[v.to_numpy() for v in values]))

    return rows.select(*columns).distinct().select(place(*columns))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each passage of a document that another document has nearly alike.

    ``start_word`` and ``end_word`` bound the passage; ``of`` and ``of_word`` say with which
    document, and where in it, it was found alike, and ``similarity`` how much, at the
    least.  Passages of one document may overlap; none lies within another.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "substring")
    least = least_words - SHINGLE + 1
    send = spark.sparkContext.broadcast
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    common = send(common_shingles(rows))
    counted = posts(rows, least, common).groupBy("value").agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("size")
    )
    repeated = scratch.keep(counted.where("low < high").select("value", "size"), "repeated")
    total, longest = repeated.agg(F.sum("size"), F.max("size")).first()
    at = lambda bits: F.col("value").bitwiseAND(bits - 1)
    limits = [BLOCK * FACTOR**k for k in range(LEVELS) if (longest or 0) > BLOCK * FACTOR**k]
    filters = Filters(
        key_filter(repeated.select(at(MINIMA_BITS)), MINIMA_BITS),
        [key_filter(repeated.where(F.col("size") > most).select(at(FILTER_BITS))) for most in limits],
    )
    met = scratch.keep(linked_lists(members(rows, least, common, send(filters)), least, total or 0), "links")
    links = met.where("of is not null").drop("value", "own")
    alone = met.where("of is null")
    left = alone.count() if limits else 0
    if left:
        filters.lists = key_filter(spots_of(alone, "value"))
        filters.blocks = key_filter(spots_of(alone, "value", "own"))
        filters.windows = key_filter(spots_of(alone, "value", "key", "start"))
        filters.keys = key_filter(spots_of(met.where("value is not null"), "key"))
        more = linked_blocks(asking(rows, least, common, send(filters)), least, left)
        links = links.unionByName(scratch.keep(more, "links_of_blocks"))
    return passages(links).select(
        F.col("key").alias(key), F.col("start").alias("start_word"), (F.col("end") + SHINGLE - 1).alias("end_word"),
        "of", F.col("of_start").alias("of_word"), "similarity",
    )
