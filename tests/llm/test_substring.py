"""Shared passages against all exact ones, and compact windows against their definition."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.llm import substring
from tests.llm import corpus


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def cases():
    rng = random.Random(4)
    passages = [corpus.prose(rng, n) for n in (51, 60, 90, 200)]
    line, long_line = corpus.prose(rng, 12), corpus.prose(rng, 35)
    rows = []
    for k in range(60):
        parts = [corpus.prose(rng, rng.randint(0, 80)), corpus.prose(rng, rng.randint(0, 80))]
        middle = passages[k % 4] if k % 2 else line if k % 3 else long_line
        rows.append((k, f"{parts[0]}\n{middle} {parts[1]}"))
    chain = [corpus.prose(rng, 40) for _ in range(12)]  # neighbours share 80 words, others less
    rows += [(100 + k, " ".join(chain[k : k + 3])) for k in range(10)]
    near = corpus.prose(rng, 120).split()
    near[60] = "other"
    rows += [(200, " ".join(near)), (201, " ".join([*near[:60], "changed", *near[61:]]))]
    return rows + [(300, corpus.prose(rng, 70)), (301, None), (302, ""), (303, "same " * 200)]


def shared_by_brute(rows, least=50):
    """Word places of each document that lie in a run of ``least`` words that another has."""
    runs = {}
    for key, text in rows:
        words = words_of(text)
        for i in range(len(words) - least + 1):
            runs.setdefault(tuple(words[i : i + least]), set()).add(key)
    out = {}
    for key, text in rows:
        words = words_of(text)
        for i in range(len(words) - least + 1):
            if len(runs[tuple(words[i : i + least])]) > 1:
                out.setdefault(key, set()).update(range(i, i + least))
    return out


def test_passages_against_brute_force(spark):
    rows = cases()
    found = substring.repeated_passages(spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string").repartition(3)).collect()
    covered = {}
    for r in found:
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    exact = shared_by_brute(rows)
    for key, places in exact.items():
        missing = places - covered.get(key, set())
        assert not missing, (key, len(missing))
    assert {*exact, 200, 201} == {*covered}
    for r in found:
        assert r["end_word"] - r["start_word"] >= 50
        assert 0.8 <= r["similarity"] <= 1


def near_cases(rng, n):
    """Pairs of documents that share a passage of 50 to 90 words with one edit each: at the threshold or above."""
    rows, kinds = [], []
    for k in range(n):
        size = rng.randint(50, 90)
        one = corpus.prose(rng, size).split()
        at, kind = rng.randrange(8, size - 8), k % 3
        other = [*one[:at], *([f"new{k}"] if kind < 2 else []), *one[at + (kind != 1) :]]  # changed, inserted, left out
        if len(other) < 50 or not alike(one, other):
            continue
        kinds.append(kind)
        for j, words in enumerate((one, other)):
            rows.append((10 * k + j, f"{corpus.prose(rng, 40)} {' '.join(words)} {corpus.prose(rng, 40)}"))
    return rows, kinds


def alike(one, other):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, other)]
    return len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def test_recall_of_near_passages(spark):
    """Near passages, found by brute force over all pairs of their words, are found with a recall of 0.9 or more."""
    rows, kinds = near_cases(random.Random(33), 300)
    found = {r["doc_id"] for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows) > 300
    by_kind = {kind: [rows[2 * i][0] in found and rows[2 * i + 1][0] in found for i, k in enumerate(kinds) if k == kind] for kind in range(3)}
    for kind, hits in by_kind.items():
        assert sum(hits) >= 0.9 * len(hits), (kind, sum(hits), len(hits))


@pytest.mark.parametrize("block", [5, 2000])
def test_blocks_and_common_shingles_lose_nothing(spark, monkeypatch, block):
    """Lists dealt to blocks, and frequent lines ranked behind, find the same exact passages."""
    monkeypatch.setattr(substring, "BLOCK", block)
    monkeypatch.setattr(substring, "SAMPLED", 2)
    monkeypatch.setattr(substring, "COMMON", 8)
    rows = cases()
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    covered = {}
    for r in found:
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    for key, places in shared_by_brute(rows).items():
        assert not places - covered.get(key, set())


def test_empty(spark):
    assert substring.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def windows_of(values, least):
    return list(zip(*(x.tolist() for x in substring.compact_windows(values, least)), strict=True))


def test_compact_windows_hold_every_minimum():
    """Of each subsequence, exactly the windows of its least values bound it; equal minima share their bounds."""
    rng = np.random.default_rng(0)
    for n in (1, 5, 30, 200):
        values = rng.integers(1, 12 if n < 100 else 1 << 60, n).astype(np.uint64)
        for least in (1, 3, 8):
            windows = windows_of(values, least)
            for i in range(n):
                for j in range(i + least - 1, min(n, i + 60)):
                    own = [c for left, c, right in windows if left <= i <= c <= j <= right]
                    assert own == (i + np.flatnonzero(values[i : j + 1] == values[i : j + 1].min())).tolist()


def test_compact_windows_stop_at_zeros():
    rng = np.random.default_rng(1)
    parts = [rng.integers(1, 1 << 60, n).astype(np.uint64) for n in (40, 3, 0, 25)]
    flat = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.uint64))])
    apart, first = [], 0
    for p in parts:
        apart += [(left + first, c + first, right + first) for left, c, right in windows_of(p, 6)]
        first += len(p) + 1
    assert sorted(windows_of(flat, 6)) == sorted(apart)


def test_repetitions_take_little_time():
    import time

    began = time.perf_counter()
    common = np.zeros(1 << 20, np.uint8)
    text = "same " * 300_000 + "one two three four five six " * 50_000
    _, _, (value, _, left, place, right) = substring.posted([text], 46, common)
    assert time.perf_counter() - began < 20
    assert len(value) < 4 * 600_000 / 8
    covered = np.zeros(600_000, bool)
    for a, b in zip(np.maximum(left, place - 53), np.minimum(right, place + 53) + 1, strict=True):
        covered[a:b] = True
    assert covered[: 600_000 - 4].all()


def test_near_passages_behind_an_unrelated_head(spark):
    """Near passages meet although the smallest document of their lists shares a line only."""
    rng = random.Random(12)
    rows, expected = [(0, "")], set()
    lines = []
    for k in range(40):
        line, before = corpus.prose(rng, 36).split(), corpus.prose(rng, 20).split()
        lines += [*corpus.prose(rng, 50).split(), *line]
        edited = [*before[:14], "changed", *before[15:]]
        for n, first in enumerate((before, edited)):
            rows.append((1 + 2 * k + n, f"{corpus.prose(rng, 60)} {' '.join([*first, *line])} {corpus.prose(rng, 60)}"))
            expected.add(1 + 2 * k + n)
    rows[0] = (0, " ".join([*lines, *corpus.prose(rng, 50).split()]))
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == expected


def test_common_shingles_are_counted_over_all_rows(spark):
    """Rows that no sample by key of one in 64 would draw."""
    keys = spark.range(1200).where("pmod(xxhash64(id), 64) <> 0").limit(substring.COMMON).withColumn("n", F.expr("row_number() over (order by id)"))
    text = F.concat(F.lit("the line that all have, "), F.col("n").cast("string"), F.when(F.col("n") > 1, " and one that all but one have").otherwise(""))
    rows = keys.select(F.col("id").alias("key"), F.concat(text, F.lit("\n"), text).alias("text")).repartition(3)
    common = substring.common_shingles(rows)
    holds = lambda line: [bool(x) for x in substring.passing(common, (substring.shingles([line])[0] & np.uint64(substring.FILTER_BITS - 1)).astype(np.int64))]
    assert holds("the line that all have,") == [True]
    assert holds("and one that all but one have") == [False, False, False]
    assert not substring.common_shingles(rows.limit(substring.COMMON - 1)).any()


def test_counts_of_shingles_are_summed_within_a_task(monkeypatch):
    """A line of very many texts makes one row of each of its shingles, not one for each slice of texts; sums stay exact."""
    line, n = "a line that very many texts of this task have", 4000
    texts = [f"{line} {k} {line}\n" + "x" * 300 for k in range(n)] + [None, "", "short"]
    batches = [pd.DataFrame({"text": texts[k : k + 500]}) for k in range(0, len(texts), 500)]
    every = np.full(substring.CELLS // 8, 255, np.uint8)
    expected = {}
    for text in texts:
        for gram in set(substring.shingles([text])[0].view(np.int64).tolist()):
            expected[gram] = expected.get(gram, 0) + 1
    whole = pd.concat(substring.counted_grams(iter(batches), every))
    assert dict(zip(whole["gram"], whole["n"], strict=True)) == expected
    assert len(whole) == len(expected)
    monkeypatch.setattr(substring, "HELD", 1000)
    parts = list(substring.counted_grams(iter(batches), every))
    assert len(parts) > 3
    assert pd.concat(parts).groupby("gram")["n"].sum().to_dict() == expected
    none = np.zeros_like(every)
    assert not list(substring.counted_grams(iter(batches), none))


def test_only_documents_of_split_lists_are_cut_again(spark, monkeypatch):
    """The second meeting of long lists leaves out the documents that have no window in any."""
    monkeypatch.setattr(substring, "BLOCK", 5)
    asked, own = [], substring.asking
    monkeypatch.setattr(substring, "asking", lambda *x: asked.append(x[-1].value) or own(*x))
    rng = random.Random(8)
    line = corpus.prose(rng, 12)
    rows = [(k, f"{corpus.prose(rng, 60)} {line} {corpus.prose(rng, 60)}") for k in range(40)]
    rows += [(100 + k, corpus.prose(rng, 60)) for k in range(200)]
    passage = corpus.prose(rng, 90)
    rows += [(400 + k, f"{corpus.prose(rng, 20)} {passage}") for k in range(2)]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {400, 401}
    keys = np.array([k for k, _ in rows])
    again = keys[substring.passing(asked[0].keys, substring.spot(keys))]
    assert {*range(40)} >= {*again.tolist()} and len(again) > 5


def near_grids(rng, n, reach, distinct):
    """Rows of shingle bytes about a place: copies of one with an edit that moves one side by up to ``DRIFT``."""
    width = 2 * reach + 1
    base, before, around = rng.integers(1, distinct, width).tolist(), [], []
    for _ in range(n):
        at, cut, moved = rng.integers(width), rng.integers(6), rng.integers(-substring.DRIFT, substring.DRIFT + 1)
        new, fill = rng.integers(1, distinct, max(0, cut + moved)).tolist(), rng.integers(1, distinct, 40).tolist()
        row = (base[:at] + new + base[at + cut :] + fill)[:width] if at >= reach else (fill + base[: max(0, at - cut)] + new + base[at:])[-width:]
        low, up = rng.integers(30) if rng.random() < 0.5 else 0, width - (rng.integers(30) if rng.random() < 0.5 else 0)
        before.append(reach - low)
        around.append(bytes(row[low:up]))
    return substring.laid(np.array(before), around, reach)


def test_moved_sides_compare_alike_alone_and_together():
    """Pairs compared at once come out as each by itself, at its smallest move that holds."""
    rng, least = np.random.default_rng(5), 46
    reach, moved = least - 1 + substring.DRIFT, 0
    for distinct in (6, 256):
        grams, there = near_grids(rng, 25, reach, distinct)
        a, b = np.nonzero(~np.eye(len(grams), dtype=bool))
        together = substring.compared(grams, there, a, b, least, reach)
        for k in range(len(a)):
            alone = [x[0] for x in substring.compared(grams, there, a[k : k + 1], b[k : k + 1], least, reach)]
            assert alone[-1] == together[-1][k]
            if alone[-1]:
                assert alone == [x[k] for x in together]
                moved += alone[1] - alone[0] != alone[3] - alone[2]
    assert moved > 20
