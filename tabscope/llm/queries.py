"""The queries of this folder's operators over the documents and pages tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE round trip of every document, as digests."""
    import public_tokenizers

    from tabscope.llm.bpe import encode_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    from tabscope.llm.licenses import scan

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["base"])
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        label(base).alias("base_labels"),
        label(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    from tabscope.llm.lm import scores

    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from those not held out."""
    from tabscope.llm import langid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics, base rule and robust outlier verdict of every document."""
    from tabscope.llm.quality import judged

    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, as they are or with other numbers, names and units."""
    from tabscope.llm.decontam import leaks

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their 3-word shingles."""
    from tabscope.llm.neardup import Likeness, near_duplicates

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, Likeness(words=3, percent=85))


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tabscope.llm.pages import main_texts

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    text = F.col("main_text")
    return main_texts(pages).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents share."""
    from tabscope.llm.substring import repeated_passages

    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    from tabscope.llm.secrets import BASE_RULES, scan, spans_text

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    base = F.filter("spans", lambda s: s["order"] < len(BASE_RULES))
    kinds = F.transform("spans", lambda s: s["kind"])
    count = {f"n_{r.kind}": F.size(kinds) - F.size(F.array_remove(kinds, r.kind)) for r in BASE_RULES}
    return found.select(
        "doc_id",
        *[c.cast("long").alias(name) for name, c in count.items()],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def op11_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 % of their 5-word shingles, by an exact join."""
    from tabscope.llm.setjoin import similar_sets

    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and exact distance of every sound vector after ten rounds."""
    from tabscope.llm.clusters import clustered, with_inertia

    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return with_inertia(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents towards the benchmark texts, and the tenth that is drawn."""
    from tabscope.llm.resample import Draw, resample

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target, Draw(longest=1)).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_licenses": op2_licenses,
    "op3_lm": op3_lm,
    "op4_langid": op4_langid,
    "op5_quality": op5_quality,
    "op6_decontam": op6_decontam,
    "op7_neardup": op7_neardup,
    "op8_pages": op8_pages,
    "op9_substring": op9_substring,
    "op10_secrets": op10_secrets,
    "op11_setjoin": op11_setjoin,
    "op12_centroids": op12_centroids,
    "op13_resample": op13_resample,
}

NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM r JOIN both_ways ON x = doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def secrets_sql() -> str:
    """The secret scan in SQL: texts between matches and the matches alternate."""
    from tabscope.llm.secrets import BASE_RULES, RULES

    found = []
    for k, rule in enumerate(RULES):
        pattern = rule.regex.replace("'", "''")
        found.append(f"""
  SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
      'own': length(g[i]), 's': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
      'n': length(m[i])}}), lambda x: x.own >= {rule.least})) AS x
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
    string_split_regex(t, '{pattern}') AS p FROM d)""")
    count = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    listed = "coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k){}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(found)}),
x AS (SELECT doc_id, k, kind, CAST(x.s AS BIGINT) AS s, x.n AS n FROM f)
SELECT d.doc_id, {count}, sha256({listed.format(f" FILTER (WHERE k < {len(BASE_RULES)})")}) AS base_sha256, {listed.format("")} AS spans
FROM d LEFT JOIN x ON x.doc_id = d.doc_id GROUP BY d.doc_id
"""


def centroids_sql(rounds: int = 10) -> str:
    """The clustering in SQL, a few steps for each round."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.c[i]) * (v.x[i] - c.c[i])))"
    nearest = "(SELECT vec_id, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT v.vec_id, c.j, {gap} AS d FROM v CROSS JOIN c{r} c) GROUP BY vec_id)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED {nearest.format(gap=gap, r=r)}")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT j, list(f ORDER BY i) AS c FROM (
  SELECT a.j, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS f FROM a{r} a JOIN v USING (vec_id), range(1, 65) AS t(i) GROUP BY a.j, i) GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.j = c.j)""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, x AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8),
{", ".join(steps)}
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j
"""


RESAMPLE_SQL = r"""
WITH code AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
o AS (SELECT doc_id, unnest(w) AS w FROM d),
h AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS k
  FROM (SELECT w FROM o UNION SELECT w FROM b), code),
s AS (SELECT k, count(*) AS s FROM o JOIN h USING (w) GROUP BY k), t AS (SELECT k, count(*) AS t FROM b JOIN h USING (w) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM o) + 10000.0::DOUBLE)
    / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM s FULL JOIN t USING (k)),
x AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM o JOIN h USING (w) JOIN g USING (k) GROUP BY doc_id),
y AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN x USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS n, 10 * count(*) OVER () // 100 AS most FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN n <= most THEN n END AS rank FROM y LEFT JOIN r ON r.doc_id = y.doc_id
"""

#: Only for queries that SQL can express; tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {"op7_neardup": NEARDUP_SQL, "op10_secrets": secrets_sql(), "op12_centroids": centroids_sql(), "op13_resample": RESAMPLE_SQL}
