"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are folded to lower case, everything else to a space; n-grams are hashed into
``BUCKETS``.  The model is a matrix of log probabilities, one row for each bucket and
one column for each language, and is broadcast.  Scoring treats a batch of texts as a
sparse matrix (a bucket list for each text) times that matrix.

The model is fitted on at most about ``SAMPLE_ROWS`` labelled rows of each language,
taken by a hash of the row, which is the documented bound of the fit; class priors come
from all labelled rows.  The rows are counted first, one number for each language, so only
the sample leaves the scan.  The matrix holds ``BUCKETS`` x languages numbers; more than
``MOST_LANGUAGES`` languages are refused.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if
nothing was learned.  Null languages aren't learned.  Ties go to the language that
sorts first.  Repeated rows count and are predicted like others; an empty table gives
an empty one.  Other columns pass through, but for those that have the name of a result,
which it replaces.  Texts of any length are taken whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.shared import prepare, with_results

#: Labelled rows of each language that the fit takes, about.
SAMPLE_ROWS = 3000
BUCKETS = 1 << 15
ORDERS = (2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
#: Bounds the model at 33 MB.
MOST_LANGUAGES = 256
#: Texts are scored in slices of this many characters.
SLICE_CHARS = 250_000

_tables: dict[str, np.ndarray] = {}


def folding() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    if "fold" not in _tables:
        fold = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if unicodedata.category(x)[0] == "L":
                low = x.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _tables["fold"] = fold
    return _tables["fold"]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams that hold a letter, the text of each, and which texts have letters."""
    gap = max(ORDERS) - 1  # blanks after each text, so that no n-gram holds letters of two
    joined = "".join([(t or "") + "\n" * gap for t in texts])
    points = folding()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    sizes = np.array([len(t or "") + gap for t in texts])
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    lettered = np.bincount(text, weights=points != 32, minlength=len(texts)) > 0
    points = np.r_[np.full(gap, 32), points].astype(np.uint64)  # a word starts at a space
    buckets, owner = [], []
    for n in ORDERS:
        code = np.zeros(len(text), np.uint64)
        live = np.zeros(len(text), bool)
        for k in range(gap - n + 1, gap + 1):  # the n-gram that ends at each character
            part = points[k : k + len(text)]
            code = (code + part) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
            live |= part != 32
        buckets.append((code[live] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owner.append(text[live])
    return np.concatenate(buckets), np.concatenate(owner), lettered


def slices(texts: pd.Series) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


@dataclass(frozen=True)
class Model:
    """Languages, log probabilities (buckets x languages) and log priors."""

    languages: list[str]
    table: np.ndarray
    priors: np.ndarray

    def guess(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language of each text (-1 if none) and its posterior probability."""
        if not self.languages or not texts:
            return np.full(len(texts), -1), np.zeros(len(texts))
        buckets, owner, lettered = features(texts)
        own = [np.bincount(owner, weights=self.table[:, k][buckets], minlength=len(texts)) for k in range(len(self.languages))]
        total = np.stack(own, axis=1) + self.priors
        chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return np.where(lettered, total.argmax(axis=1), -1), np.where(lettered, chance, 0.0)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """The model of the labelled rows."""
    prepare(docs.sparkSession)
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(text).alias("text"))
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    size = {r["label"]: r["n"] for r in sizes}
    languages = sorted(size)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    below = F.create_map(*[F.lit(x) for name in languages for x in (name, SAMPLE_ROWS * 2.0**20 / size[name])])
    sample = labelled.where(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < below[F.col("label")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, own in batch.groupby("label"):
                total = np.zeros(BUCKETS, np.int64)
                for part in slices(own["text"]):
                    total += np.bincount(features(part)[0], minlength=BUCKETS)
                used = np.flatnonzero(total)
                yield pd.DataFrame({"label": language, "bucket": used, "n": total[used]})

    counts = (
        sample.select("label", "text")
        .mapInPandas(count, "label string, bucket long, n long")
        .groupBy("label", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most BUCKETS rows for each language
    )
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    if len(counts):
        table[counts["bucket"], np.searchsorted(languages, counts["label"])] += counts["n"]
    priors = np.log(np.array([size[name] for name in languages]) / sum(size.values()))
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32), priors)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, the posterior probability."""
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([*shipped.value.languages, UNKNOWN], dtype=object)
        for texts in batches:
            found = [shipped.value.guess(part) for part in slices(texts)]
            best = np.concatenate([b for b, _ in found]) if found else np.empty(0, np.int64)
            chance = np.concatenate([c for _, c in found]) if found else np.empty(0)
            yield pd.DataFrame({"lang_pred": names[best], "lang_score": chance})

    # so that a filter on the result doesn't ask for it a second time
    return with_results(docs, guess.asNondeterministic()(F.col(text)), ("lang_pred", "lang_score"))


def held_out(key: str = "doc_id"):
    """Rows kept from the fit: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
