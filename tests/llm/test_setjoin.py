"""The set join against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from tabscope.llm import queries, setjoin
from tabscope.llm.neardup import Likeness
from tests.llm import corpus
from tests.llm.test_neardup import brute, cases, edited


def light_cases():
    """Short texts about the threshold, of which many share their beginning."""
    rng = random.Random(4)
    rows, base = [], corpus.prose(rng, 40).split()
    for k in range(300):
        n = rng.randint(5, 30)
        words = base[:n]
        for _ in range(rng.randrange(3)):
            words[rng.choice([0, n - 1, rng.randrange(n)])] = f"w{rng.randrange(4)}"
        rows.append((10_000 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize(
    ("boundary", "words", "percent", "block"),
    [(None, 5, 80, setjoin.BLOCK), (0, 5, 80, 300), (10, 5, 80, 2000), (None, 3, 60, 2000), (7, 1, 90, 500)],
)
def test_against_all_pairs(spark, monkeypatch, boundary, words, percent, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    if boundary is not None:
        monkeypatch.setattr(setjoin, "boundary_of", lambda *_: boundary)
    rows = cases() + light_cases()
    if words == 3:
        rows = rows[::2]
    data = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = setjoin.similar_sets(data, Likeness(words, percent)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, words, percent)


def test_groups_in_steps(spark, monkeypatch):
    """Versions that drift apart, so that a list's smallest member isn't like most of it."""
    monkeypatch.setattr(setjoin, "BLOCK", 3000)
    rng = random.Random(9)
    rows = []
    for group in range(3):
        text = corpus.prose(rng, 120)
        for k in range(40):
            rows.append((group * 1000 + k, text))
            text = edited(rng, text, group + 1)
    rng.shuffle(rows)
    data = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = setjoin.similar_sets(data).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 5, 80)


def test_odd_rows(spark):
    rows = [(None, "a b c d"), (None, None), (1, "a b c d"), (1, "x y z"), (2, "x y z"), (3, ""), (4, "A  b C\nd"), (5, "p q"), (2, "p q"), (9, "one")]
    data = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, node int, component int")
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in setjoin.similar_sets(data).collect())
    assert found == [(0, 0, 0), (0, 1, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 1), (5, 1, 1), (9, 1, 9)]
    assert setjoin.similar_sets(data.limit(0)).collect() == []


def test_bounds():
    for percent in (50, 80, 93):
        for n in range(1, 60):
            for m in setjoin.partners(n, percent):
                least = setjoin.needed(n, m, percent)
                assert 100 * least >= percent * (n + m - least) and 100 * (least - 1) < percent * (n + m - least + 1)
                assert least >= n - setjoin.prefix(n, percent) + 1
    rng = np.random.default_rng(1)
    for n, m in combinations(rng.integers(1, 400, 12).tolist(), 2):
        a, b = (np.unique(rng.integers(0, 500, k)).astype(np.uint64) for k in (n, m))
        bits = min(setjoin.width(len(a)), setjoin.width(len(b)))
        maps = [setjoin.folded(setjoin.parity(x, setjoin.width(len(x))), bits) for x in (a, b)]
        assert maps == [setjoin.parity(x, bits) for x in (a, b)]
        differing = (int.from_bytes(maps[0]) ^ int.from_bytes(maps[1])).bit_count()
        assert differing <= len(np.setxor1d(a, b))


def test_query(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op11_setjoin(spark, tables).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 5, 80)
