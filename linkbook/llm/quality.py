"""Quality rules: base counts and robust multivariate outliers.

Each (language, source) group gets a minimum-covariance-determinant estimate of its documents'
transformed statistics. Concentration steps run for all groups and starting points at once, as
aggregates over a narrow table; the start with the least determinant wins. A document far from
its group by Mahalanobis distance is rejected. Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkbook.llm.common import WORD, words
from linkbook.plans.staging import stage

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Share of a group that the estimate rests on, and the chance that a document of a normal group is rejected.
CORE = 0.75
ALPHA = 1e-3
# A group of fewer judged documents is judged by the estimate of its language, or of all documents.
MIN_ROWS = 50
# Statistic -> rounding noise, the deviation that half a count makes (added to the variance): half a symbol in
# 100 words, half a duplicate line, half a repeated window in 300 words (asin of the root of its share).
FLOORS = {"log_words": 0.01, "word_length": 0.01, "symbols": 0.4, "dup_lines": 0.4, "repeats": 0.1}
# Relative deviation of one word's length; a text of n words has its mean within this / sqrt(n).
WORD_LENGTH_CV = 0.6
GRID = 1000  # steps per unit of the histograms that give medians
P = len(FLOORS)


def _chi2_cdf(x: float, k: int) -> float:
    term = total = 1.0 / (k / 2)
    for i in range(1, 1000):
        term *= (x / 2) / (k / 2 + i)
        total += term
        if term < total * 1e-16:
            break
    return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2)) if x > 0 else 0.0


def _chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - _chi2_cdf(middle, k) > 1 - q else (low, middle)
    return high


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Repeated three-word windows are found inside the row: the hashes of all windows are sorted
    with their positions, and neighbours are compared. Null and empty texts have zero counts
    and fail. Further columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    listed = docs.select("doc_id", "lang", "source", text.alias("text")).withColumn("words", words(F.col("text")))
    last = F.size("words") - 3
    hashed = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.xxhash64(*[F.get("words", i + k) for k in range(3)]).alias("h"), i.alias("p")),
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    counted = listed.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(last >= 0, F.sort_array(hashed)).alias("sorted"),
    )
    same = lambda x, i, k: F.coalesce(F.get("sorted", i + k)["h"] == x["h"], F.lit(False))
    repeated = F.filter("sorted", lambda x, i: same(x, i, -1) | same(x, i, 1))
    placed = counted.select(
        "*", F.sort_array(F.transform(repeated, lambda x: x["p"])).alias("at")
    ).drop("sorted")
    steps = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    repeats = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    return placed.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def _transformed() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p("n_words"),
        "word_length": F.log(F.greatest(F.col("word_chars") / n, F.lit(0.5))),
        "symbols": F.log1p(100 * F.col("n_symbols") / n),
        "dup_lines": F.log1p("n_dup_lines"),
        "repeats": F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
    }


def _quantile(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """``keys``, ``bucket``, ``n`` -> the first bucket that holds ``share`` of the rows (rounded up)."""
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    marked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
    return marked.where(F.col("upto") >= F.ceil(F.lit(share) * F.col("all"))).groupBy(*keys).agg(F.min("bucket").alias("cut"))


def _medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Median of each column per group, to one step of the grid."""
    long = rows.select("grp", F.posexplode(F.array(*[F.round(F.col(c) * GRID).cast("long") for c in columns])).alias("dim", "bucket"))
    cuts = _quantile(long.groupBy("grp", "dim", "bucket").agg(F.count("*").alias("n")), ["grp", "dim"], 0.5)
    return cuts.groupBy("grp").agg(
        *[F.max(F.when(F.col("dim") == i, F.col("cut") / F.lit(GRID))).alias(f"med_{c}") for i, c in enumerate(columns)]
    )


_L = [(i, j) for i in range(P) for j in range(i + 1)]


def _factored(moments: DataFrame, scale: Column) -> DataFrame:
    """Means ``m{i}`` and covariances ``c{i}{j}`` -> with the Cholesky factor of scale * C + I and its log determinant."""
    df = moments
    for i, j in _L:
        value = scale * F.col(f"c{i}{j}") + (1.0 if i == j else 0.0)
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, P)), 2 * F.log("l00"))
    return df.select("grp", "start", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _L], logdet.alias("logdet"))


def _distance(df: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` of ``z0``.. by forward substitution."""
    for i in range(P):
        value = F.col(f"z{i}") - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", value / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))).drop(
        *[f"y{i}" for i in range(P)]
    )


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    n = F.count("*")
    sums = rows.groupBy(*keys).agg(
        n.alias("n"), *[F.avg(f"z{i}").alias(f"m{i}") for i in range(P)],
        *[F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}{j}") for i, j in _L],
    )
    return sums.withColumns({f"c{i}{j}": F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in _L})


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and factor of the minimum-covariance-determinant estimate of each group of ``z0``..

    Three starts: median with the spread around it, mean with covariance, median with
    covariance. Each step keeps the ``CORE`` share nearest to the estimate (whole histogram
    buckets) and estimates anew, until no determinant falls any further.
    """
    core_factor = CORE / _chi2_cdf(_chi2_quantile(CORE, P), P + 2)
    starts = _moments(rows, "grp").withColumn("start", F.explode(F.array(*map(F.lit, range(3)))))
    away = {f"m{i}": F.when(F.col("start") == 1, F.col(f"m{i}")).otherwise(F.lit(0.0)) for i in range(P)}
    apart = {
        f"c{i}{j}": F.when(F.col("start") > 0, F.col(f"c{i}{j}")).otherwise(F.lit(1.0 if i == j else 0.0)) for i, j in _L
    }
    current = stage(_factored(starts.withColumns(apart | away), F.lit(1.0)), "mcd")
    # z is a few times 10 to the power of 0 to 4; its squared distance has 200 buckets per factor of e.
    bucket = F.floor(F.log(F.col("d2") + 1e-3) * 200)
    best = None
    while True:
        near = _distance(rows.join(current, "grp")).withColumn("bucket", bucket)
        cut = _quantile(near.groupBy("grp", "start", "bucket").agg(F.count("*").alias("n")), ["grp", "start"], CORE)
        core = near.select("grp", "start", "bucket", *[f"z{i}" for i in range(P)]).join(cut, ["grp", "start"]).where("bucket <= cut")
        stepped = stage(_factored(_moments(core, "grp", "start"), F.lit(core_factor)), "mcd")
        total = stepped.agg(F.sum("logdet")).first()[0]
        if total is None or (best is not None and total > best - 1e-6 * max(1.0, abs(best))):
            break
        best, current = total, stepped
    least = current.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    return current.join(least, ["grp", "start"], "left_semi")


def _pools(judged: DataFrame) -> DataFrame:
    """``own``, ``grp``, ``pools``: each group's estimate, and all estimates that its documents are part of.

    A group of ``MIN_ROWS`` judged documents has its own estimate, another one that of its language
    if that has so many, else that of all documents. Pools hold their large groups too.
    """
    of_lang = Window.partitionBy("tongue")
    sizes = judged.groupBy("tongue", "own").agg(F.count("*").alias("n")).withColumn("in_lang", F.sum("n").over(of_lang))
    level = F.when(F.col("n") >= MIN_ROWS, 0).when(F.col("in_lang") >= MIN_ROWS, 1).otherwise(2)
    placed = stage(sizes.withColumn("level", level).withColumn("lang_pool", F.max((F.col("level") == 1).cast("int")).over(of_lang)), "quality-pools")
    all_pool = placed.where("level = 2").limit(1).count() > 0
    keys = [F.concat(F.lit(f"{i}"), *k) for i, k in enumerate([[F.col("own")], [F.col("tongue")], []])]
    used = [F.col("level") == 0, F.col("lang_pool") == 1, F.lit(all_pool)]
    pools = F.filter(F.array(*[F.when(u, k) for u, k in zip(used, keys, strict=True)]), lambda x: x.isNotNull())
    return placed.select("own", F.get(F.array(*keys), F.col("level")).alias("grp"), pools.alias("pools"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: the columns of :func:`statistics`, ``distance`` and ``kept``.

    Documents that fail the base rules are neither part of the estimates nor kept. A null
    language or source is a group of its own. A group with fewer than ``MIN_ROWS`` judged
    documents is judged by a pooled estimate (:func:`_pools`); a distance is null only where a group's
    documents all fail the base rules. Repeated rows count as often as they stand. An empty table
    gives no rows.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    base = stage(
        statistics(docs).withColumns({"tongue": part("lang"), "own": F.concat_ws("\x01", part("lang"), part("source"))}).withColumns(_transformed()),
        "quality",
    )
    judged = base.where("not base_failed")
    pools = _pools(judged)
    members = judged.join(pools.select("own", F.explode("pools").alias("grp")), "own")
    medians = stage(_medians(members, list(FLOORS)), "quality-medians")
    spread = {k: F.lit(v) for k, v in FLOORS.items()}
    spread["word_length"] = F.sqrt(F.lit(FLOORS["word_length"] ** 2) + F.lit(WORD_LENGTH_CV**2) / F.greatest("n_words", F.lit(1)))
    z = {f"z{i}": (F.col(k) - F.col(f"med_{k}")) / spread[k] for i, k in enumerate(FLOORS)}
    scaled = lambda df: df.join(medians, "grp").withColumns(z)
    fitted = stage(scaled(members).select("grp", *z), "quality-z")
    found = estimates(fitted).drop("start", "logdet")
    placed = base.join(pools.select("own", "grp"), "own", "left").join(medians, "grp", "left").withColumns(z).join(found, "grp", "left")
    far = F.col("d2") > _chi2_quantile(1 - ALPHA, P)
    return _distance(placed).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round(F.sqrt("d2"), 6).alias("distance"),  # sums of doubles differ in their last digits
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op9: base counts and verdicts of all documents."""
    return judge(spark.read.parquet(f"{folder}/documents.parquet")).drop("lang", "source", "distance")
