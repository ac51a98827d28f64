"""Language-model scores against plain counting."""

import re
from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest

from tabscope.llm import lm
from tests.llm import corpus


def plain(rows):
    """Tokens of each row, and unigram and bigram counts of those learned from."""
    tokens = {}
    for key, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        tokens[key] = [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]
    learned = [k for k in tokens if crc32(str(k).encode()) % 7 != 2]
    words = Counter(t for k in learned for t in tokens[k])
    return tokens, learned, words


@pytest.mark.parametrize(("chars", "keys", "bits"), [(12_000_000, 1_500_000, 8), (3000, 300, 8), (1000, 300, 2)])
def test_base_and_total(spark, monkeypatch, chars, keys, bits):
    monkeypatch.setattr(lm, "CHUNK_CHARS", chars)
    monkeypatch.setattr(lm, "RANGE_KEYS", keys)
    monkeypatch.setattr(lm, "LEVEL_BITS", bits)
    rng = np.random.default_rng(bits)
    fixed = rng.dirichlet(np.ones(3), lm.BUCKETS)
    fixed[0, 0] = 0
    learned_weights = []
    monkeypatch.setattr(lm, "expected", lambda h, uniform: learned_weights.append(h) or fixed)
    rows = [(k, t) for k, t, *_ in corpus.documents(9, 90)]
    found = {r["doc_id"]: r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokens, learned, words = plain(rows)
    n, v = sum(words.values()), len(words)
    pairs, context = Counter(), Counter()
    for k in learned:
        for a, b in zip([None, *tokens[k]], tokens[k], strict=False):
            pairs[a, b] += 1
            context[a] += 1
    assert {k: context[k] for k in context} == {k: words[k] for k in context}
    for k, own in tokens.items():
        r = found[k]
        assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(own), n, k not in learned)
        assert r["n_known"] == sum(words[t] > 0 for t in own)
        assert r["base_score"] == pytest.approx(sum(log10((words[t] + 1) / (n + 1 * (v + 1))) for t in own))
        # the mixture of the three estimates, token by token
        score = 0.0
        for a, b in zip([None, *own], own, strict=False):
            two, one, flat = fixed[min(int(np.log2(context[a] + 1)), lm.BUCKETS - 1)]
            score += log10(two * pairs[a, b] / max(context[a], 1) + one * words[b] / n + flat / (v + 1))
        assert r["score"] == pytest.approx(score)
    # the deleted fold is predicted from the others' counts
    gone = [k for k in learned if crc32(str(k).encode()) % 7 == 3]
    left = words - Counter(t for k in gone for t in tokens[k])
    (histogram,) = learned_weights
    cells = Counter()
    for k in gone:
        for a, b in zip([None, *tokens[k]], tokens[k], strict=False):
            cells[int(np.log2(left[a] + 1)), 0 if not left[b] else 1 + round(-np.log2(left[b] / left.total()) * lm.FINE)] += 1
    assert histogram.groupby(["bucket", "q1"])["n"].sum().to_dict() == cells


def test_learned_weights_beat_single_words(spark):
    rows = [(k, t) for k, t, *_ in corpus.documents(9, 90)]
    held = [r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 1.2


def test_levels():
    """Each level adds at most LEVEL_BITS, the last has all; one level where they suffice."""
    assert lm.levels_of(0) == [0] and lm.levels_of(8) == [8] and lm.levels_of(13) == [6, 13]
    for bits in range(40):
        found = lm.levels_of(bits)
        assert found[-1] == bits and all(b - a <= lm.LEVEL_BITS for a, b in zip([0, *found], found, strict=False))


def test_weights_raise_the_likelihood():
    import pandas as pd

    rng = np.random.default_rng(0)
    hist = pd.DataFrame({"bucket": rng.integers(1, 4, 300), "q1": rng.integers(20, 60, 300), "q2": rng.integers(0, 30, 300), "n": rng.integers(1, 9, 300)}).drop_duplicates(["bucket", "q1", "q2"])
    weights = lm.expected(hist, 1e-6)
    assert np.allclose(weights.sum(axis=1), 1)

    def likelihood(w, own):
        value = lambda s: np.where(s == 0, 0.0, 2.0 ** (-(s - 1) / lm.FINE))
        return (np.log(w[0] * value(own["q2"].to_numpy()) + w[1] * value(own["q1"].to_numpy()) + w[2] * 1e-6) * own["n"]).sum()

    for bucket, own in hist.groupby("bucket"):
        best = likelihood(weights[bucket], own)
        for _ in range(40):
            assert best >= likelihood(rng.dirichlet(np.ones(3)), own) - 1e-3


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (1, ""), (1, "a a a")]
    found = lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_tokens"] for r in found) == [1, 1, 3, 4]
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_key_in_most_rows(spark, monkeypatch):
    """Rows of one key go to all chunks alike."""
    monkeypatch.setattr(lm, "CHUNK_CHARS", 200)
    rows = [(5, "red green blue")] * 80 + [(None, "red red")] * 40 + [(k, "green") for k in range(100, 110)]
    found = lm.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(found) == 130
    assert len({(r["doc_id"], r["n_tokens"], r["base_score"], round(r["score"], 9)) for r in found}) == 12


def test_pressed_numbers():
    numbers = np.sort(np.random.default_rng(1).integers(0, 2**63, 999, dtype=np.int64)).astype(np.uint64)
    assert (lm.unpressed(lm.pressed(numbers), 999, np.uint64) == numbers).all()
