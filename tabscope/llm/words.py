"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# A word is a run without these; A-Z are lower-cased.
BLANKS = frozenset([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in BLANKS else b for b in range(256))

#: Multipliers of the hashes; any odd numbers do.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)

#: Bytes up to which the hashes of all words are read off running sums; longer texts go word by word.
SUMMED = 1 << 21

_powers = np.cumprod(np.r_[np.uint64(1), np.full(255, STEP)], dtype=np.uint64)
_inverses = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, STEP)], dtype=np.uint64)
    return _powers[:n]


def inverses(n: int) -> np.ndarray:
    """What the first n powers must be multiplied by to give 1."""
    global _inverses
    if n > len(_inverses):
        inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, inverse)], dtype=np.uint64)
    return _inverses[:n]


@dataclass
class Words:
    """The words of some texts, one after the other."""

    text: np.ndarray  # index of each word's text
    hash: np.ndarray
    first: np.ndarray  # for each text its first word, and at last the number of words
    start: np.ndarray  # byte offsets in data
    end: np.ndarray
    data: bytes  # the texts as the table maps them, with a blank between


def words_of(texts: list[str | None], table: bytes = LOWER) -> Words:
    """Split on what ``table`` maps to blanks and hash each word."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = b" ".join(raw).translate(table)
    starts_of = np.cumsum([0, *(len(r) + 1 for r in raw)])
    points = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(points) + 2, bool)
    np.not_equal(points, 32, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, starts_of)
    if not len(start):
        return Words(np.empty(0, np.int64), np.empty(0, np.uint64), first, start, end, data)
    sizes = end - start
    if len(points) <= SUMMED:
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * powers(len(points)), out=total[1:])
        sums = (total[end] - total[start]) * inverses(len(points))[start]
    else:
        kept = points[inside[1:-1]].astype(np.uint64) + np.uint64(1)
        places = np.cumsum(sizes) - sizes
        offset = np.arange(len(kept)) - np.repeat(places, sizes)
        kept *= powers(int(sizes.max()))[offset]
        sums = np.add.reduceat(kept, places)
    hashed = mixed(sums ^ (sizes.astype(np.uint64) * STEP))
    return Words(np.repeat(np.arange(len(texts)), np.diff(first)), hashed, first, start, end, data)


def joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n items from each place on; the caller drops places that cross texts."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = mixed(total + STEP) * MIX + hashes[k : k + len(total)]
    return mixed(total)


def slices(rows: list, size_of, most: int = 300_000) -> Iterator[list]:
    """Runs of rows of about ``most`` in size."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += size_of(row)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
