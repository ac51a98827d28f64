"""The pipeline against a plain version of all its stages."""

import random
import re

import pytest

import corpus_pipeline
from tabscope.llm.secrets import RULES
from tests.llm import corpus
from tests.llm.test_neardup import brute

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    items = [(k, corpus.prose(rng, 25)) for k in range(5)]
    docs = corpus.documents(21, 90)
    docs += [(500 + k, f"{corpus.prose(rng, 30)} {items[k][1]} {corpus.prose(rng, 30)}", "en", "s", 0) for k in range(5)]
    corpus.write(spark, tmp_path, docs)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [r for r in docs if r[1] and re.search(r"[^\W\d_]", r[1])]
    root = brute([(r[0], r[1]) for r in kept], 5, 80)
    kept = [r for r in kept if root[r[0]][1] == r[0]]
    kept = [r for r in kept if not any(t in r[1] for _, t in items)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for key, text, *_ in kept:
        spans = sorted(
            (m.start(), m.end(), rule.kind)
            for rule in RULES
            for m in re.finditer(rule.pattern, text, re.I | re.A if rule.any_case else 0)
            if len(m[rule.group]) >= rule.least
        )
        out, at = "", 0
        for a, b, kind in spans:
            if a >= at:
                out += f"{text[at:a]}[{kind}]"
            at = max(at, b)
        clean = out + text[at:]
        expected[key] = (len(clean), len(library.encode(clean, add_special_tokens=False).ids), True)

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_chars"], r["n_tokens"], r["round_trip"]) for r in found} == expected


def test_stage_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns


ODD = "doc_id long, text string, lang string, source string, n_chars long, spans string, lang_pred string, Lang_Score int, `a.b` string, row_key int"


def odd_rows():
    """Null ids and texts, repeated rows, and columns called like the stages' own."""
    text = "password: hunter22 " + corpus.prose(random.Random(3), 60)
    other = corpus.prose(random.Random(4), 60)
    tail = ("mine", "own", 7, "dotted", 1)
    rows = [(1, text), (1, text), (2, text), (None, other), (None, other), (None, None), (3, None), (4, "??!"), (5, corpus.prose(random.Random(5), 60))]
    return [(k, t, "en", "s", len(t or ""), *tail) for k, t in rows]


def test_odd_columns_and_rows(spark, tables):
    docs = spark.createDataFrame(odd_rows(), ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), ODD)  # as the next stage reads it
        assert all(tuple(r)[5:] == ("mine", "own", 7, "dotted", 1) for r in docs.collect()), name
        assert all(r["text"] for r in docs.collect())
    kept = sorted((r["doc_id"] or 0, r["text"][:10]) for r in docs.collect())
    assert [k for k, _ in kept] == [0, 0, 1, 1, 5]
    assert all(t.startswith("[assign] ") for k, t in kept if k == 1)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == 5


def test_empty_table(spark, tmp_path, tables):
    corpus.write(spark, tmp_path, [])
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
