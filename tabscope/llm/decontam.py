"""Benchmark decontamination by template canonicalisation.

Tokens become templates: numbers, names (capitalised within a sentence) and units turn
into typed placeholders, all others stay as lower-case literals without punctuation.
Items with one template are one class, which its smallest item stands for.  Windows of
``WINDOW`` template tokens of the classes are hash-joined with those of the documents,
which finds a question again after its numbers, names or units were changed.  For each
document and class, every place is judged: the windows near one diagonal give the share of
the item's tokens found there, and the slots must be consistent, each value of the item
standing for one value in the document and the other way round.

Template windows hold at least ``LITERALS`` literals.  What they can't tell, such as items
of few tokens, or full of numbers and names, is found when it is there verbatim but for
case and punctuation: windows of the plain tokens are joined in the same way, an item
shorter than a window being one window, and all tokens of the item must be covered.

A fixed-size filter of the benchmark's window hashes, whatever the benchmark's size,
keeps the documents' other windows from the shuffle; the join is salted by document, so
that a phrase which many documents have doesn't meet in one task.

Null and empty texts, and items without a token, are never found.  Texts of any length are
taken whole.  Rows that share a key count as one; a null key is not reported; of items with
equal words the smallest is reported.  Empty tables give an empty table; further columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.shared import FILTER_BITS, Scratch, key_filter, passing, prepare
from tabscope.llm.words import joined, mixed, powers, slices, STEP

WINDOW = 8
LITERALS = 5
#: Share of an item's tokens that a document must hold close together.
COVERED = 0.5
#: Share of the item's slots whose values must map consistently.
CONSISTENT = 0.8
#: Diagonals that small edits move a window by.
DRIFT = 4
#: Parts that a window shared by many documents is dealt to.
SALTS = 16

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million"
UNIT_WORDS = (
    "mm cm m km in ft yd mi g kg mg lb oz t l ml s sec min h hr ms second seconds minute minutes hour hours day days week weeks "
    "month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram "
    "kilograms pound pounds liter liters litre litres dollar dollars cent cents euro euros percent degree degrees usd eur"
)
LITERAL, NUMBER, NAME, UNIT = range(4)

BLANK, LETTER, DIGIT, OTHER = range(4)
KINDS = np.array(
    [
        BLANK if b == 32 or 9 <= b <= 13 else DIGIT if 48 <= b <= 57 else LETTER if b >= 128 or chr(b).isalpha() else OTHER
        for b in range(256)
    ],
    np.uint8,
)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
ENDS = np.array([chr(b) in ".!?:" for b in range(256)])


def plain_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8).astype(np.uint64) + np.uint64(1)
    return mixed(np.add.reduceat(raw * powers(len(raw)), [0]) ^ (np.array([len(raw)], np.uint64) * STEP))[0]


NUMBER_HASHES = np.sort([plain_hash(w) for w in NUMBER_WORDS.split()])
UNIT_HASHES = np.sort([plain_hash(w) for w in UNIT_WORDS.split()])


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and kind of every token, and for each text its first token (at last, their number)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    cuts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    kind = KINDS[data]
    solid = np.flatnonzero(kind % OTHER != BLANK)  # letters and digits
    if not len(solid):
        return np.empty(0, np.uint64), np.empty(0, np.int8), np.zeros(len(texts) + 1, np.int64)
    run = np.cumsum(kind == BLANK)  # blanks so far tell one token from the next
    of = run[solid]
    place = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    sizes = np.diff(np.r_[place, len(solid)])
    offset = np.arange(len(solid)) - np.repeat(place, sizes)
    values = (LOWER[data[solid]] + np.uint64(1)) * powers(int(sizes.max()))[offset]
    hashed = mixed(np.add.reduceat(values, place) ^ (sizes.astype(np.uint64) * STEP))
    start = solid[place]
    head, second = data[start], data[np.minimum(start + 1, len(data) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    digits = np.add.reduceat((kind[solid] == DIGIT).astype(np.int64), place) > 0
    # a sentence starts with a text or line, or after a token that ends in . ! ? :
    blanks = np.flatnonzero(kind == BLANK)
    before = np.r_[False, ENDS[data[np.maximum(blanks - 1, 0)]]]
    line = np.r_[True, data[blanks] == 10]
    opens = (before | line)[of[place]]
    sort = np.full(len(place), LITERAL, np.int8)
    sort[capital & ~opens] = NAME
    sort[among(hashed, UNIT_HASHES)] = UNIT
    sort[digits | among(hashed, NUMBER_HASHES)] = NUMBER
    return hashed, sort, np.searchsorted(start, cuts)


def windows_of(tokens: tuple[np.ndarray, np.ndarray, np.ndarray], size: int, plain: bool, bits: np.ndarray | None = None):
    """(text, hash, first token, slot values) of all windows, one row for each; with ``bits``, of those that it passes.

    Plain windows have no slots.
    """
    hashed, sort, first = tokens
    whole = joined(hashed if plain else template_of(hashed, sort), size) ^ mixed(np.array([2 * size + plain], np.uint64))
    fine = np.ones(len(whole), bool) if bits is None else passing(bits, (whole & np.uint64(FILTER_BITS - 1)).astype(np.int64))
    if not plain:
        literal = np.cumsum(np.r_[0, sort == LITERAL])
        fine &= literal[size:][: len(whole)] - literal[: len(whole)] >= LITERALS
    at = np.flatnonzero(fine)
    text = np.searchsorted(first, at, side="right") - 1
    inside = at + size <= first[text + 1]
    at, text = at[inside], text[inside]
    slots = np.where(plain | (sort == LITERAL), np.uint64(0), hashed)
    return text, whole[at], at - first[text], slots[at[:, None] + np.arange(size)]


def template_of(hashed: np.ndarray, sort: np.ndarray) -> np.ndarray:
    return np.where(sort == LITERAL, hashed, sort.astype(np.uint64))


ROWS = "key long, hash long, size int, plain boolean, at long, slots binary, tokens long"


def windows(rows: DataFrame, kinds: list[tuple[int, bool]], bits=None, short: bool = False) -> DataFrame:
    """Windows of (key, text) rows, for each size, plain or not; with ``bits``, those that the filter passes.

    With ``short``, plain windows smaller than WINDOW are only those of texts as short.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(list(zip(batch["key"], batch["text"], strict=True)), lambda r: len(r[1] or "")):
                keys = np.array([k for k, _ in part], np.int64)
                tokens = tokens_of([t for _, t in part])
                sizes = np.diff(tokens[2])
                for size, plain in kinds:
                    text, hashes, at, slots = windows_of(tokens, size, plain, None if bits is None else bits.value)
                    if short and size < WINDOW:
                        own = sizes[text] == size
                        text, hashes, at, slots = text[own], hashes[own], at[own], slots[own]
                    if len(at):
                        yield pd.DataFrame(
                            {
                                "key": keys[text], "hash": hashes.view(np.int64), "size": size, "plain": plain, "at": at,
                                "slots": [s.tobytes() for s in slots], "tokens": sizes[text],
                            }
                        )

    return rows.mapInPandas(cut, ROWS)


def fingerprints(items: DataFrame) -> DataFrame:
    """Hashes of each item's template, of its slot values and of its plain tokens."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(list(zip(batch["key"], batch["text"], strict=True)), lambda r: len(r[1] or "")):
                hashed, sort, first = tokens_of([t for _, t in part])
                template = template_of(hashed, sort)
                out = []
                for (key, text), a, b in zip(part, first[:-1], first[1:], strict=True):
                    if b > a:
                        out.append((key, text, folded(template[a:b]), folded(hashed[a:b][sort[a:b] != LITERAL])))
                yield pd.DataFrame(out, columns=["key", "text", "template", "values"])

    return items.mapInPandas(name, "key long, text string, template long, values long")


def folded(numbers: np.ndarray) -> int:
    """One number for all of a sequence."""
    whole = joined(numbers, len(numbers)) if len(numbers) else np.zeros(1, np.uint64)
    return int((whole ^ mixed(np.array([len(numbers)], np.uint64))).view(np.int64)[0])


def judged(at: np.ndarray, of: np.ndarray, slots: np.ndarray, item_slots: np.ndarray, sizes: np.ndarray, tokens: int):
    """(covered, consistent, values, first, end) of the best place of an item in a document.

    ``at`` are window places in the document, ``of`` those in the item.  Windows of one
    place lie near one diagonal; each window of the item counts once for a place, where it
    is nearest.  A consistent place goes before one that isn't, then the greater coverage.
    ``values`` is a hash of the document's slot values if all tokens are covered, else 0.
    """
    order = np.argsort(at - of, kind="stable")
    at, of, slots, item_slots, sizes = at[order], of[order], slots[order], item_slots[order], sizes[order]
    diagonal = at - of
    best, seen = None, set()
    for d in np.unique(diagonal).tolist():
        for drift in (DRIFT, tokens // 2):  # insertions and deletions move the windows after them
            a, b = np.searchsorted(diagonal, [d - drift, d + drift + 1])
            near = a + np.lexsort((np.abs(diagonal[a:b] - d), sizes[a:b], of[a:b]))
            first = np.r_[True, (of[near[1:]] != of[near[:-1]]) | (sizes[near[1:]] != sizes[near[:-1]])]
            own = near[first]
            if own.tobytes() in seen:
                continue
            seen.add(own.tobytes())
            held = np.zeros(tokens + 1, np.int64)
            np.add.at(held, of[own], 1)
            np.add.at(held, of[own] + sizes[own], -1)
            share = int((np.cumsum(held)[:tokens] > 0).sum()) / tokens
            if share < COVERED and best is not None:
                continue
            mine, theirs = np.concatenate(item_slots[own]), np.concatenate(slots[own])
            used = mine != 0
            slot = np.concatenate([np.arange(o, o + n) for o, n in zip(of[own], sizes[own], strict=True)]).astype(np.uint64)
            # each slot once, not for each window that holds it
            once = np.unique(np.stack([slot[used], mine[used], theirs[used]]), axis=1)
            pairs, counts = np.unique(once[1:], axis=1, return_counts=True)
            total = int(counts.sum())
            # either value of a pair stands for one other
            agreeing = [sum(int(counts[side == v].max()) for v in np.unique(side)) for side in pairs] if pairs.size else [0]
            consistent = min(agreeing) / total if total else 1.0
            exact = bool((mine == theirs).all())
            rank = (share >= COVERED and consistent >= CONSISTENT, share, exact, consistent)
            if best is None or rank > best[0]:
                _, place = np.unique(once[0], return_index=True)
                values = folded(once[2][place]) if share == 1 else 0
                best = rank, (share, consistent, values, int(at[own].min()), int((at[own] + sizes[own]).max()))
    return best[1]


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and class of items with one template that it holds.

    ``item`` is the item that the document holds word for word, else the class's smallest;
    ``template_id`` is the class's smallest item.  ``covered`` is the share of the item's
    tokens, ``consistent`` that of its slots, ``exact`` whether all slot values are the
    item's own, ``first_token`` and ``end_token`` the place in the document.
    """
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "decontam")
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("key"), F.col(item_text).alias("text"))
    named = scratch.keep(fingerprints(items), "items")
    # one item for each template, and for the plain windows one for each wording
    classes = named.groupBy("template").agg(F.min_by("text", "key").alias("text"), F.min("key").alias("key"))
    wordings = named.groupBy("template", "values").agg(F.min_by("text", "key").alias("text"), F.min("key").alias("key"))
    of_class = windows(classes.select("key", "text"), [(WINDOW, False)])
    plain = windows(wordings.select("key", "text"), [(n, True) for n in range(1, WINDOW + 1)], short=True)
    asked = scratch.keep(of_class.unionByName(plain), "asked")
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(asked.select(F.col("hash").bitwiseAND(FILTER_BITS - 1))))
    kinds = [(r["size"], r["plain"]) for r in asked.select("size", "plain").distinct().collect()]  # at most WINDOW + 1
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    found = windows(rows, kinds, bits).select("key", "hash", "at", "slots", salt.alias("salt"))
    wanted = asked.select(
        "hash", "size", "plain", F.col("key").alias("item"), F.col("at").alias("of"), F.col("slots").alias("item_slots"), "tokens",
        F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt"),
    )
    met = found.join(wanted, ["hash", "salt"])
    match = F.struct("at", "of", "slots", "item_slots", "size")
    pairs = met.groupBy("key", "item", "plain").agg(F.first("tokens").alias("tokens"), F.collect_list(match).alias("found"))

    @F.pandas_udf("covered double, consistent double, values long, first_token long, end_token long")
    def judge(founds: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        out = []
        for found, n in zip(founds, tokens, strict=True):
            column = lambda name: [f[name] for f in found]  # noqa: B023, E731
            arrays = [np.empty(len(found), object) for _ in range(2)]
            for own, name in zip(arrays, ("slots", "item_slots"), strict=True):
                own[:] = [np.frombuffer(x, np.uint64) for x in column(name)]
            out.append(judged(np.array(column("at")), np.array(column("of")), *arrays, np.array(column("size")), n))
        return pd.DataFrame(out, columns=["covered", "consistent", "values", "first_token", "end_token"])

    enough = F.when(F.col("plain"), F.col("j.covered") == 1).otherwise((F.col("j.covered") >= COVERED) & (F.col("j.consistent") >= CONSISTENT))
    held = pairs.withColumn("j", judge("found", "tokens")).where(enough).select("key", "item", "plain", "j.*")
    # the item whose own values these are
    template = named.groupBy("template").agg(F.min("key").alias("template_id"))
    known = named.join(template, "template").groupBy("template_id", "values").agg(F.min("key").alias("own_item"))
    of_item = named.join(template, "template").select(F.col("key").alias("item"), "template_id").distinct()
    judged_rows = held.join(of_item, "item").join(known, ["template_id", "values"], "left")
    own_item = F.when(F.col("plain"), F.col("item")).otherwise(F.when(F.col("covered") == 1, F.col("own_item")))
    # of a template and a plain match of one class, the exact one counts
    best = F.struct(own_item.isNotNull().alias("exact"), "covered", "consistent", (-F.coalesce(own_item, "template_id")).alias("item"), "first_token", "end_token")
    return (
        judged_rows.groupBy("key", "template_id")
        .agg(F.max(best).alias("b"))
        .select(F.col("key").alias(key), (-F.col("b.item")).alias(item), "template_id", "b.covered", "b.consistent", "b.exact", "b.first_token", "b.end_token")
    )
