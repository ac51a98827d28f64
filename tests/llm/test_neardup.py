"""Near duplicates against all pairs, and components against union-find."""

import random
import re

import pytest

from tabscope.llm import neardup, queries
from tabscope.llm.components import components
from tabscope.llm.shared import Scratch
from tests.llm import corpus


def brute(rows, n, percent):
    """Key -> (set size, component) by comparing every pair."""
    sets = {}
    for key, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[key] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def cases():
    rng = random.Random(11)
    rows = [(k, t) for k, t, *_ in corpus.documents(3, 80)]
    line = corpus.prose(rng, 60)
    base = corpus.prose(rng, 150)
    for k in range(40):  # a chain of edits: neighbours are alike, ends aren't
        base = edited(rng, base, 1)
        rows.append((1000 + k, base))
    for k in range(40):  # one passage in many different documents
        rows.append((2000 + k, corpus.prose(rng, 90) + "\n" + line))
    for k in range(60):  # around the threshold
        t = corpus.prose(rng, 120)
        rows += [(3000 + 2 * k, t), (3001 + 2 * k, edited(rng, t, k % 6))]
    return rows + [(5000, "two words"), (5001, "TWO  words"), (5002, "one"), (5003, "words two"), (5004, "one one")]


@pytest.mark.parametrize(("words", "percent", "longest"), [(3, 85, 4000), (5, 80, 4000), (3, 85, 7)])
def test_against_all_pairs(spark, monkeypatch, words, percent, longest):
    monkeypatch.setattr(neardup, "LIST", longest)
    monkeypatch.setattr(neardup, "BLOCK", longest)
    monkeypatch.setattr(neardup, "COLUMNS", 10 * longest)
    rows = cases()
    data = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = neardup.near_duplicates(data, neardup.Likeness(words, percent)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, words, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_query_against_all_pairs(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op7_neardup(spark, tables).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 3, 85)


def test_odd_rows(spark):
    rows = [(None, "a b c d"), (None, None), (1, "a b c d"), (1, "x y z"), (2, "x y z"), (3, "")]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(data).collect())
    assert found == [(0, 0, 0, False), (0, 1, 1, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert neardup.near_duplicates(data.limit(0)).collect() == []


def test_miss_bound():
    for like in (neardup.Likeness(3, 85), neardup.Likeness(5, 80)):
        p = like.percent / 100
        assert neardup.below(neardup.COORDINATES, p, like.matches) <= neardup.MISS
        assert all(neardup.below(like.prefix(r), p, r) <= neardup.MISS for r in (1, 2))


def test_low_thresholds_are_refused():
    with pytest.raises(ValueError, match="coordinates"):
        neardup.Likeness(3, 30).prefix(1)


def test_intersections(monkeypatch):
    import numpy as np

    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(9)]
    truth = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = ~np.eye(9, dtype=bool)  # of different sets
    assert (neardup.intersections(sets)[off] == truth[off]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(70)] + [(7, 7)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()
    truth = {k: find(k) for e in edges for k in e if e[0] != e[1]}
    assert {r["node"]: r["component"] for r in found} == truth
    assert len(found) == len(truth)
