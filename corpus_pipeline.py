"""From raw documents to token files: five stages over the documents table.

Each stage takes what the one before it kept.  Rows that share a ``doc_id`` count as one
document and stay or go together; those without one are known by their text.  Null and
empty texts are in no language and go; texts of any length are taken whole; of equally
good duplicates the smallest ``doc_id`` stays.  Columns beyond those of ``documents`` pass
through up to the last stage.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import bpe, decontam, langid, neardup, secrets
from tabscope.llm.shared import Scratch, quoted, unused


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that every row has, and its name: the id, or a hash of the text beyond all ids."""
    key = unused(docs, "row_key")
    of_text = F.xxhash64("text").bitwiseAND((1 << 61) - 1).bitwiseOR(1 << 62)
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), of_text)), key


def set_aside(docs: DataFrame, *results: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """``docs`` with other names for columns that are called like results, and what gives a column its name back."""
    taken = {c: unused(docs, f"aside_{k}") for k, c in enumerate(docs.columns) if c.lower() in results}
    return docs.withColumnsRenamed(taken), lambda c: F.col(quoted(taken.get(c, c))).alias(c)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language, those without text or letters; ``lang`` becomes the predicted one."""
    own, back = set_aside(docs, "lang_pred", "lang_score")
    found = langid.predict(own, langid.fit(own)).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else back(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group that shares four fifths of its 5-word shingles."""
    rows, key = keyed(docs)
    kept = neardup.near_duplicates(rows, key=key).where("kept").select(key).distinct()
    return rows.join(kept, key, "left_semi").select(*map(quoted, docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark items, re-parameterised ones included."""
    rows, key = keyed(docs)
    found = decontam.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key)
    return rows.join(found.select(key).distinct(), key, "left_anti").select(*map(quoted, docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by markers of their kind."""
    own, back = set_aside(docs, "spans")
    found = secrets.scan(own).withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return found.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else back(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    import public_tokenizers

    found = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", tokenize),
]

#: No SQL can express these stages; the tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
