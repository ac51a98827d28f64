"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tabscope.llm import queries, resample
from tabscope.llm.resample import Draw
from tests.llm import corpus


def grams(text, draw):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = [" ".join(words[i : i + n]) for n in range(draw.shortest, draw.longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % draw.buckets for r in runs]


def brute(rows, target, draw):
    """Rows of (key, n_features, weight, score, rank) in no order."""
    found = [(k, *grams(t, draw)) for k, t in rows]
    s = Counter(b for _, _, held in found for b in held)
    t = Counter(b for text in target for b in grams(text, draw)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + draw.buckets) / ((s[b] + 1) * (all_t + draw.buckets))))
    out = []
    for k, n, held in found:
        weight = sum(map(gain, held))
        score = None
        if k is not None:
            h = int(hashlib.sha256(f"{draw.seed}:{k}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([k, n, len(held), weight, score, None])
    fit = sorted((r for r in out if r[1] >= draw.least_words and r[4] is not None), key=lambda r: (-r[4], r[0], r[2], r[3]))
    for place, r in enumerate(fit[: draw.percent * len(fit) // 100], 1):
        r[5] = place
    return sorted(([r[0], *r[2:]] for r in out), key=str)


def found_by(frame, columns=("doc_id", "n_features", "weight", "score", "rank")):
    return sorted(([r[c] for c in columns] for r in frame.collect()), key=str)


@pytest.mark.parametrize("draw", [Draw(longest=1), Draw(), Draw(shortest=2, longest=3, buckets=50, least_words=3, percent=60, seed=7)])
@pytest.mark.parametrize("size", [resample.WORDS, 90])
def test_against_plain_python(spark, monkeypatch, draw, size):
    monkeypatch.setattr(resample, "WORDS", size)
    monkeypatch.setattr(resample, "STRETCH_ROWS", 20)
    rows = [(k, t) for k, t, *_ in corpus.documents(5, 90)] + [(None, "a b c " * 10), (12, "one more row of a key " * 5), (12, "one more row of a key " * 5)]
    target = [t for _, t, *_ in corpus.documents(8, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert found_by(resample.resample(docs, aim, draw)) == brute(rows, target, draw)


def test_clashing_columns_and_text_keys(spark):
    rows = [("a`b", "x y " * 15, 1, 2), ("c", None, 3, 4)]
    docs = spark.createDataFrame(rows, "key string, `te.xt` string, weight int, slice int")
    aim = spark.createDataFrame([("x z",)], "`te.xt` string")
    draw = Draw(longest=1, percent=100)
    found = resample.resample(docs, aim, draw, key="key", text="te.xt")
    assert found_by(found, ("key", "n_features", "weight", "score", "rank")) == brute([r[:2] for r in rows], ["x z"], draw)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string")
    assert resample.resample(none, some, Draw()).collect() == []
    assert found_by(resample.resample(some, none, Draw())) == brute([(1, "a b c"), (2, "")], [], Draw())
    assert found_by(resample.resample(some.where("text = ''"), none, Draw())) == brute([(2, "")], [], Draw())


def test_query(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    assert found_by(queries.op13_resample(spark, tables)) == brute(rows, target, Draw(longest=1))
