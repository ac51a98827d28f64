"""The operators that work row by row, against plain Python."""

import hashlib
import re

import numpy as np
import pytest

from tabscope.llm import queries
from tabscope.llm.secrets import ALWAYS, BASE_RULES, RULES, trigram_query
from tests.llm import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return corpus.write(spark, tmp_path_factory.mktemp("rows"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return corpus.write(spark, tmp_path_factory.mktemp("none"), [])


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts():
    return {r[0]: r[1] or "" for r in corpus.documents()}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_bpe_is_the_library(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = rows(queries.op1_bpe(spark, sf))
    for k, text in texts().items():
        ids = library.encode(text, add_special_tokens=False).ids
        r = found[k]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False).encode()) == sha(text.encode())


def test_bpe_words_of_all_kinds():
    import random

    from tokenizers import Tokenizer

    from tabscope.llm.bpe import Vocabulary

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        own = Vocabulary(f.read())
    library, rng = Tokenizer.from_file(path), random.Random(3)
    parts = ["a", "aa", "the", "  ", "\n", "é", "漢", "🙂", "<|endoftext|>", "<|", "12", "'s", "\xa0", "\x1c", "0000", "----", "ing", "՘"]
    cases = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)] + ["ab" * 900, " " * 700, "-" * 333]
    for text, packed in zip(cases, own.encode(cases), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([own.byte_id[0xFF]], "<u4").tobytes()) == "�"


def test_bpe_small_batches():
    """Batches in which no word needs merging, or none is new, are encoded like others."""
    import random

    from tokenizers import Tokenizer

    from tabscope.llm.bpe import Vocabulary

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        text = f.read()
    library, rng = Tokenizer.from_file(path), random.Random(4)
    words = ["abc", "the", "hello", " world", "", "x", "qzx", "ing", " of", "zzzzqq", "é", "1", "\n"]
    own = Vocabulary(text)
    for n in range(10_000):
        if n % 2000 == 0:
            own = Vocabulary(text)
        batch = ["".join(rng.choices(words, k=rng.randint(0, 2))) for _ in range(rng.randint(0, 2))]
        for t, packed in zip(batch, own.encode(batch), strict=True):
            assert np.frombuffer(packed, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    for batch in (["abc"], ["the"], ["hello world"], [None], [""], []):
        fresh = Vocabulary(text)
        assert fresh.encode(batch) == fresh.encode(batch)


@pytest.mark.parametrize("text", ["abc", "hello world", "a", "", None])
def test_bpe_one_row_tables(spark, tmp_path, text):
    folder = corpus.write(spark, tmp_path, [(1, text, None, None, 0), (1, text, "en", "s", 0)])
    found = queries.op1_bpe(spark, folder).collect()
    assert len(found) == 2 and found[0] == found[1]
    assert found[0]["decoded_sha256"] == sha((text or "").encode())


def test_licenses_base(spark, sf):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    found = rows(queries.op2_licenses(spark, sf))
    for k, text in texts().items():
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        hits = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
        r = found[k]
        assert (r["n_words"], r["n_base"]) == (len(words), len(hits))
        assert r["first_word"] == min([i for i, _ in hits], default=None)
        assert r["last_word"] == max([i for i, _ in hits], default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")}
        assert 0 <= r["score"] <= 1


def test_licenses_edits_and_spans():
    from tabscope.llm.licenses import Scanner

    scanner = Scanner()
    text = "Ö!  Licensed under the Apache Licence, Version 2.0. More"
    n, spans = scanner.scan(text)
    assert n == 10
    (label, base, first, last, start, end, edits, score) = next(s for s in spans if s[0] == "apache-2.0")
    assert (base, first, last, edits) == (False, 1, 8, 1)
    assert text[start:end] == "Licensed under the Apache Licence, Version 2.0"
    assert 0.9 < score < 1
    assert scanner.scan("licensed to the apache chief of version twenty")[1] == []


def test_licenses_lose_no_match_to_seeds():
    """The bounded-error search of the whole text finds no notice that the seeds miss."""
    import random

    from tabscope.llm.licenses import NOTICES, Scanner

    rng = random.Random(5)
    for words, label in [*rng.sample(NOTICES, 40), *NOTICES[-11:]]:
        scanner = Scanner(base=(), notices=[(words, label)])
        plain = words.replace("{", "").replace("}", "")
        for n in range(9):
            edited = list(plain)
            for _ in range(n and rng.randint(0, len(plain) // 8)):
                k = rng.randrange(len(edited))
                edited[k] = rng.choice(["", "x", edited[k] + "q"])
            line = " ".join(("before " + "".join(edited) + " after").split())
            there = scanner.notices[0].pattern.search(f" {line} ")
            found = scanner.scan(line)[1]
            assert bool(there) == bool(found) and (n or found)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under CC BY-SA 4.0", {"cc-by-sa"}),
        ("licensed under CC BY-NC 4.0", {"cc-by-nc"}),
        ("licensed under CC BY-ND 4.0", {"cc-by-nd"}),
        ("licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
        ("Licensed under the Apache License, Version 1.1", {"apache-1.1"}),
        ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("released under the zib license", set()),
        ("released under the MIT license", {"mit"}),
        ("released under the zlib license", {"zlib"}),
        ("under the terms of the GNU Lesser General Public License", {"lgpl"}),
        ("SPDX-License-Identifier: MIT License", {"mit"}),
        ("permission is hereby granted free of charge to any person or organization obtaining a copy", {"bsl-1.0"}),
        ("permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
    ],
)
def test_licenses_that_differ_by_letters(text, labels):
    from tabscope.llm.licenses import Scanner

    assert {s[0] for s in Scanner().scan(f"Some words. {text} and more")[1] if not s[1]} == labels


def test_licenses_in_long_texts():
    import time

    from tabscope.llm.licenses import Scanner

    scanner, began = Scanner(), time.perf_counter()
    n, spans = scanner.scan("word cc by " * 100_000)
    assert (n, len(spans)) == (300_000, 100_000)
    assert len(scanner.scan("licensed under the mit license " * 5000)[1]) == 5000
    assert time.perf_counter() - began < 40


def test_quality_base(spark, sf):
    found = rows(queries.op5_quality(spark, sf))
    for k, text in texts().items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        held = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)} if len(set(windows)) < len(windows) else set()
        r = found[k]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(held), text[:80]
        failed = len(words) < 10 or 100 * len(held) > 20 * len(words)
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])
        if "###" in text:
            assert not r["kept"]


def test_quality_distance_is_the_robust_one(spark):
    """Half-known rows: distances match numpy's on the closest rows, and planted outliers stand out."""
    from tabscope.llm import quality
    from tabscope.llm.shared import Scratch

    rng = np.random.default_rng(1)
    good = rng.normal([1.5, 0.3, 0.2, 0.2, 0.3], [0.5, 0.1, 0.2, 0.3, 0.2], (900, 5))
    bad = rng.normal([4, 2, 2, 2, 2], 0.05, (100, 5))
    names = list(quality.SPREADS)
    data = spark.createDataFrame([("g", *map(float, x)) for x in np.vstack([good, bad])], ["g", *names])
    estimate = quality.robust_estimates(data, Scratch(spark, "test"))
    measured = quality.distance(data.join(estimate, "g")).select("d2", *names).toPandas()
    e = estimate.collect()[0]
    factor = np.array([[e[f"l_{a}_{b}"] if j <= i else 0 for j, b in enumerate(names)] for i, a in enumerate(names)])
    inverse = np.linalg.inv(factor @ factor.T)
    off = measured[names].to_numpy() - np.array([e[f"m_{a}"] for a in names])
    assert np.allclose(measured["d2"], np.einsum("ij,jk,ik->i", off, inverse, off))
    far = measured["s_length"] > 3.5
    assert (measured["d2"][far] > quality.CUTOFF).all()
    assert (measured["d2"][~far] < quality.CUTOFF).mean() > 0.99


def test_secrets_base(spark, sf):
    found = rows(queries.op10_secrets(spark, sf))
    for k, text in texts().items():
        spans = []
        for order, (rule, flags) in enumerate(zip(BASE_RULES, (re.I | re.A, 0, 0), strict=True)):
            for m in re.finditer(rule.pattern, text, flags):
                if len(m[rule.group]) >= rule.least:
                    spans.append((m.start(), order, rule.kind, m.end()))
        r = found[k]
        assert [r[f"n_{x.kind}"] for x in BASE_RULES] == [sum(s[2] == x.kind for s in spans) for x in BASE_RULES]
        shown = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        assert r["base_sha256"] == sha(shown.encode())
        assert {*shown.split(",")} - {""} <= {*r["spans"].split(",")}


def test_trigram_queries():
    queries_of = {r.kind: trigram_query(r.pattern) for r in RULES}
    assert queries_of["hex"] == ALWAYS
    assert queries_of["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in queries_of["assign"]
    assert frozenset({"api", "pik", "ike", "key"}) in queries_of["assign"]
    assert all(q != ALWAYS for kind, q in queries_of.items() if kind != "hex")


def test_secrets_more_rules_and_redaction(spark):
    from tabscope.llm.secrets import redacted, scan
    from pyspark.sql import functions as F

    pem = "-----BEGIN RSA PRIVATE KEY-----"
    data = [
        (1, f"é {pem} x ghp_{'a' * 36}. token = abcdef123", "clash"),
        (1, "nothing", "clash"),
        (None, "token=abcdefgh", None),
        (3, None, None),
    ]
    found = scan(spark.createDataFrame(data, "doc_id long, text string, spans_of string")).withColumn("clean", redacted(F.col("text"), F.col("spans"))).collect()
    assert sorted(r["clean"] or "" for r in found) == ["", "[assign]", "nothing", "é [private_key] x [code_host]. [assign]"]


def test_secrets_many_matches(spark):
    """Thousands of matches in one text are listed and redacted as plain Python does."""
    import time

    from pyspark.sql import functions as F

    from tabscope.llm.secrets import redacted, scan

    text = " ".join(f"é{k} token=abc{k:06d} x" for k in range(20_000))
    data = spark.createDataFrame([(1, text), (2, "token=abc123 " * 300)], "doc_id long, text string")
    began = time.perf_counter()
    found = rows(scan(data).withColumn("clean", redacted(F.col("text"), F.col("spans"))))
    assert time.perf_counter() - began < 60
    for key, own in ((1, text), (2, "token=abc123 " * 300)):
        pattern = re.compile(BASE_RULES[0].pattern, re.I | re.A)
        assert [(s["start"], s["end"]) for s in found[key]["spans"]] == [m.span() for m in pattern.finditer(own)]
        assert found[key]["clean"] == pattern.sub("[assign]", own)


def test_langid(spark, tables):
    found = queries.op4_langid(spark, tables).toPandas()
    truth = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(truth, on="doc_id")
    assert (both[both["held_out"]]["lang_pred"] == both[both["held_out"]]["lang"]).mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_langid_awkward(spark, sf):
    found = rows(queries.op4_langid(spark, sf))
    assert {found[k]["lang_pred"] for k in (0, 1, 2, 3)} == {"und"}
    assert found[0]["score"] == 0.0


def test_langid_against_plain_scoring(spark):
    """Learned counts, priors and posteriors are those of a naive Bayes written out n-gram by n-gram."""
    import random
    from math import exp, log

    from tabscope.llm import langid

    rng = random.Random(2)
    rows = [(k, corpus.prose(rng, 12) if k % 3 else "Ça va été où " * rng.randint(1, 4), "en" if k % 3 else "fr") for k in range(60)]
    rows += [(100, None, "en"), (101, "no label", None), (102, "!!", "fr"), (None, "Le mot", "fr")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts, docs = {}, {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            docs[lang] = docs.get(lang, 0) + 1
            own = counts.setdefault(lang, {})
            for b in langid.features([text])[0].tolist():
                own[b] = own.get(b, 0) + 1
    assert model.languages == sorted(counts) == ["en", "fr"]
    texts = ["Le mot est là", "thered onti ea", "", None, "?!", "éa"]
    best, chance = model.guess(texts)
    for text, b, c in zip(texts, best, chance, strict=True):
        grams = langid.features([text])[0].tolist()
        if not grams:
            assert (b, c) == (-1, 0)
            continue
        score = []
        for lang in model.languages:
            total = sum(counts[lang].values()) + langid.SMOOTHING * langid.BUCKETS
            score.append(log(docs[lang] / sum(docs.values())) + sum(log((counts[lang].get(g, 0) + langid.SMOOTHING) / total) for g in grams))
        assert b == score.index(max(score))
        assert c == pytest.approx(1 / sum(exp(s - max(score)) for s in score), rel=1e-3)


def test_langid_refuses_too_many_labels(spark, monkeypatch):
    from tabscope.llm import langid

    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        langid.fit(spark.createDataFrame([(k, "a", str(k)) for k in range(3)], "doc_id long, text string, lang string"))


def test_langid_rows_do_not_touch():
    from tabscope.llm.langid import features

    one = features(["abc"])[0]
    many, owner, _ = features(["zzz", "abc", None, "abc"])
    for k in (1, 3):
        assert sorted(many[owner == k]) == sorted(one)


@pytest.mark.parametrize("name", ["op1_bpe", "op2_licenses", "op4_langid", "op5_quality", "op10_secrets"])
def test_empty_table(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


NAMES = "token_ids n_tokens decoded n_words spans found found_ lang_pred lang_score own_text hit_key hit_rules rules_hit key label draw"


@pytest.fixture(scope="module")
def clashing(spark):
    """A row whose further columns have the names of results and of what the operators use within."""
    names = NAMES.split()
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in [*names, "a.b"])
    rows = [(1, "token=abcdef12 released under the mit license", "en", "s", *["old"] * (len(names) + 1)), (None, None, None, None, *[None] * (len(names) + 1))]
    return spark.createDataFrame(rows, schema)


def operators():
    from tabscope.llm import bpe, langid, licenses, secrets

    path = public_tokenizers.path("byte_bpe_50k.json")
    return {
        "bpe": (lambda d: bpe.encode_documents(d, path), ("token_ids", "n_tokens", "decoded")),
        "licenses": (licenses.scan, ("n_words", "spans")),
        "langid": (lambda d: langid.predict(d, langid.fit(d)), ("lang_pred", "lang_score")),
        "secrets": (secrets.scan, ("spans",)),
    }


@pytest.mark.parametrize("name", ["bpe", "licenses", "langid", "secrets"])
def test_clashing_columns(clashing, name):
    """Columns with the name of a result give way to it, all others pass through."""
    apply, results = operators()[name]
    found = apply(clashing)
    assert found.columns == [c for c in clashing.columns if c not in results] + list(results)
    row = found.where("doc_id = 1").first()
    assert all(row[c] == "old" for c in [*NAMES.split(), "a.b"] if c not in results)
    assert all(row[c] != "old" for c in results)
    assert found.count() == 2


def test_quality_estimate_is_the_smaller_one(spark):
    """On a small group the estimate's determinant is near the least of all covers, which plain search finds."""
    from itertools import combinations

    from tabscope.llm import quality
    from tabscope.llm.shared import Scratch

    rng = np.random.default_rng(3)
    names = list(quality.SPREADS)
    data = np.vstack([rng.normal(0, 1, (9, 5)), rng.normal(25, 0.5, (3, 5))])
    repeated = np.repeat(data, 10, axis=0)  # a group of 120 rows
    table = spark.createDataFrame([("g", *map(float, x)) for x in repeated], ["g", *names])
    e = quality.robust_estimates(table, Scratch(spark, "test")).collect()[0]
    found = 2 * sum(np.log(e[f"l_{a}_{a}"]) for a in names)
    floor = np.diag([quality.SPREADS[a] ** 2 for a in names])
    cover = [quality.CONSISTENCY * np.cov(data[list(c)].T, bias=True) + floor for c in combinations(range(12), 9)]
    assert found <= min(np.linalg.slogdet(c)[1] for c in cover) + 1.0
    assert abs(e["m_s_length"]) < 2
