"""Quality rules: text statistics, two plain rules, and robust multivariate outliers.

``text_statistics`` counts with DataFrame functions.  ``robust_outliers`` estimates, for
each language and source, the minimum covariance determinant of the transformed
statistics and rejects rows at a large Mahalanobis distance from it.

The estimate takes the ``COVER`` share of a group's rows whose covariance has the least
determinant.  From two starts, medians with spreads and the plain mean with covariance,
concentration steps follow: estimate mean and covariance of the closest rows, measure all
rows anew, take the closest again, which never raises the determinant; of both ends the
one with the smaller determinant stays.  "Closest" is read off a histogram of distances,
so a group needs one small row for each step of distance and never meets in one task.
Groups of fewer than ``LEAST_ROWS`` rows use the estimate of
their language, then that of all rows; without any of these nothing is rejected.

Null and empty texts have no words and fail the base rule.  Null languages or sources
count as empty ones.  Repeated rows weigh as often as they occur, and rows at one distance
count alike; texts of any length are taken whole.  An empty table gives an empty one.
``text_statistics`` passes other columns through, but for those with the name of a result,
which it replaces; ``judged`` returns the key and its results only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.shared import Scratch

# The classes that define words and symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Statistics and the least spread that counts for each, so that a value which nearly
#: all rows share doesn't make every other value an outlier.
SPREADS = {"s_length": 0.35, "s_symbols": 0.05, "s_repeats": 0.10, "s_lines": 0.15, "s_upper": 0.08}
COVER = 0.75
#: Makes the covariance of the closest 75 % that of all rows if those are normal, in 5 dimensions.
CONSISTENCY = 1.41
STEPS = 4
LEAST_ROWS = 50
#: Squared distance; normal rows lie beyond it with a chance of about 1e-7.
CUTOFF = 40.0
#: Steps of the distance histogram in each doubling of 1 + distance.
HISTOGRAM = 64


def repeated_words() -> Column:
    """Words within windows of five that occur twice or more; needs the columns of ``text_statistics``."""
    same = lambda k, by: F.coalesce(F.get("__sorted", k)["h"] == F.get("__sorted", k + by)["h"], F.lit(False))
    found = F.filter(
        F.sequence(F.lit(0), F.size("__sorted") - 1), lambda k: same(k, F.lit(-1)) | same(k, F.lit(1))
    )
    places = F.sort_array(F.transform(found, lambda k: F.get("__sorted", k)["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(5), p - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return F.when(F.col("__sorted").isNotNull(), covered).otherwise(0)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper.

    Windows are compared by 64-bit hashes of their words' 64-bit hashes.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    filled = F.filter(F.split(own, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(F.filter(F.split(own, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    counted = docs.withColumns(
        {
            "__words": hashes,
            "__lines": filled,
            "word_chars": (F.length(own) - F.regexp_count(own, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
            "n_symbols": F.regexp_count(own, F.lit(SYMBOL)).cast("long"),
            "n_upper": F.regexp_count(own, F.lit(r"\p{Lu}")).cast("long"),
        }
    )
    windowed = counted.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__windows": F.when(
                F.size("__words") >= 5,
                F.transform(
                    F.sequence(F.lit(0), F.size("__words") - 5),
                    lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(5)]),
                ),
            ),
        }
    )
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ranked = windowed.withColumn(
        "__sorted",
        F.when(repeated, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    return ranked.withColumn("n_repeat_words", repeated_words().cast("long")).drop(
        "__words", "__lines", "__windows", "__sorted"
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def transformed() -> dict[str, Column]:
    """The statistic vector: logarithms of sizes, square roots of shares."""
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return {
        "s_length": F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        "s_symbols": share("n_symbols", "word_chars"),
        "s_repeats": share("n_repeat_words", "n_words"),
        "s_lines": share("n_dup_lines", "n_lines"),
        "s_upper": share("n_upper", "word_chars"),
    }


def factored(moments: DataFrame) -> DataFrame:
    """Means m_* and the Cholesky factor l_*_* of the covariance, from n, sums and sums of products."""
    names = list(SPREADS)
    means = moments.select("g", "n", *[(F.col(a) / F.col("n")).alias(f"m_{a}") for a in names],
                           *[c for c in moments.columns if c.startswith("p_")])
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            spread = CONSISTENCY * (F.col(f"p_{a}_{b}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}"))
            inner = reduce(lambda x, y: x + y, [F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}") for c in names[:j]], F.lit(0.0))
            if i == j:
                cell = F.sqrt(F.greatest(spread, F.lit(0.0)) + SPREADS[a] ** 2 - F.least(inner, F.greatest(spread, F.lit(0.0))))
            else:
                cell = (spread - inner) / F.col(f"l_{b}_{b}")
            means = means.withColumn(f"l_{a}_{b}", cell)
    return means.drop(*[c for c in moments.columns if c.startswith("p_")])


def distance(rows: DataFrame) -> DataFrame:
    """``rows``, joined with their group's estimate, with the squared distance ``d2``."""
    names = list(SPREADS)
    for i, a in enumerate(names):
        known = reduce(lambda x, y: x + y, [F.col(f"l_{a}_{b}") * F.col(f"y_{b}") for b in names[:i]], F.lit(0.0))
        rows = rows.withColumn(f"y_{a}", (F.col(a) - F.col(f"m_{a}") - known) / F.col(f"l_{a}_{a}"))
    return rows.withColumn("d2", reduce(lambda x, y: x + y, [F.col(f"y_{a}") ** 2 for a in names]))


def moments_of(rows: DataFrame) -> DataFrame:
    names = list(SPREADS)
    return rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(a).alias(a) for a in names],
        *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]],
    )


def histogram_step() -> Column:
    return F.floor(F.log2(1 + F.col("d2")) * HISTOGRAM)


def limits(rows: DataFrame) -> DataFrame:
    """The histogram step up to which the COVER share of each group's rows lies."""
    held = rows.groupBy("g", histogram_step().alias("step")).agg(F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy("g")
    running = held.withColumn("below", F.sum("k").over(whole.orderBy("step")) - F.col("k")).withColumn(
        "all", F.sum("k").over(whole)
    )
    return running.where(F.col("below") < COVER * F.col("all")).groupBy("g").agg(F.max("step").alias("most"))


def robust_estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Estimate of each group ``g`` from rows of (g, statistics), with the group's size as ``rows``.

    Each step writes one row for each group, so no step computes an earlier one again.
    """
    names = list(SPREADS)
    sizes = scratch.keep(
        rows.groupBy("g").agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.percentile_approx(a, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q_{a}") for a in names],
        ),
        "sizes",
    )
    spread = reduce(
        lambda x, y: x + y,
        [
            ((F.col(a) - F.col(f"q_{a}")[1]) / F.greatest((F.col(f"q_{a}")[2] - F.col(f"q_{a}")[0]) / 1.35, F.lit(SPREADS[a]))) ** 2
            for a in names
        ],
    )
    plain = scratch.keep(factored(moments_of(rows)), "plain")
    # both starts go on side by side, as groups of their own
    from_ = lambda name: F.struct(F.lit(name).alias("start"), F.col("g").alias("own")).alias("g")
    median = rows.join(sizes, "g").withColumn("d2", spread).select(from_("median"), *names, "d2")
    measured = median.unionByName(distance(rows.join(plain, "g")).select(from_("plain"), *names, "d2"))
    both = rows.select(from_("median"), *names).unionByName(rows.select(from_("plain"), *names))
    for step in range(STEPS):
        limit = scratch.keep(limits(measured), f"limit{step}")
        closest = measured.join(limit, "g").where(histogram_step() <= F.col("most"))
        estimate = scratch.keep(factored(moments_of(closest)), f"estimate{step}")
        measured = distance(both.join(estimate, "g"))
    # the product of the factor's diagonal is the root of the determinant
    size = reduce(lambda x, y: x + y, [F.log(f"l_{a}_{a}") for a in names])
    own = [c for c in estimate.columns if c != "g"]
    best = estimate.groupBy(F.col("g.own").alias("g")).agg(F.min_by(F.struct(*own), F.struct(size.alias("size"), *own)).alias("e")).select("g", "e.*")
    return best.drop("n").join(sizes.select("g", "rows"), "g").where(F.col("rows") >= LEAST_ROWS)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each document: its key, the statistics, base_failed, distance2 and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    counted = text_statistics(
        docs.select(F.col(key), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"),
                    F.coalesce(F.col(source), F.lit("")).alias("source"))
    ).drop("text")
    stats = scratch.keep(counted.withColumn("base_failed", base_failed()).withColumns(transformed()), "statistics")
    groups = [F.struct(F.lit("all").alias("level"), F.lit("").alias("lang"), F.lit("").alias("source")),
              F.struct(F.lit("lang").alias("level"), F.col("lang"), F.lit("").alias("source")),
              F.struct(F.lit("source").alias("level"), F.col("lang"), F.col("source"))]
    sound = stats.where(~F.col("base_failed")).select(F.explode(F.array(*groups)).alias("g"), *SPREADS)
    estimates = scratch.keep(robust_estimates(sound, scratch), "estimates")
    own = [c for c in estimates.columns if c[:2] in ("m_", "l_")]
    rows = stats
    for level, group in zip(("all", "lang", "source"), groups, strict=True):
        named = estimates.select(F.col("g").alias(f"g_{level}"), F.struct(*own).alias(f"e_{level}"))
        rows = rows.withColumn(f"g_{level}", group).join(named, f"g_{level}", "left").drop(f"g_{level}")
    rows = rows.withColumn("e", F.coalesce("e_source", "e_lang", "e_all")).drop("e_source", "e_lang", "e_all")
    measured = distance(rows.select("*", *[F.col(f"e.{c}").alias(c) for c in own]))
    return measured.withColumn("distance2", F.col("d2")).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    ).select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
