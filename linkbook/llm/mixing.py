"""Mix sources to target weights.

Every document gets a hash-random key; documents are range-sorted by source and key, and
distributed prefix sums of their words cut each source at its exact budget. A budget above the
source's size repeats the source: whole epochs first, then the head of the random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkbook.llm.common import fresh, n_words, running_totals, with_row_ids
from linkbook.plans.staging import stage

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def random_key(doc_id: Column, seed: str = "mix") -> Column:
    """60 random bits that depend on the id alone, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``source``, ``source_size`` -> with ``target`` and ``source_start`` (words of the sources before).

    Sources by code point, null last, take the weights in turn. A target stops at ``max_epochs``
    times its source's size; the level that shares the rest by weight is the largest of
    (all words - capped words) / (all weights - capped weights) over the sources in the order
    of size by weight, so nothing is iterated.
    """
    listed = stage(
        running_totals(
            sizes.withColumn("one", F.lit(1).cast("long")),
            ["source"],
            {"place": "one", "source_start": "source_size"},
            "mix-sources",
        )
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.lit(max_epochs).cast("long") * F.col("source_size"))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .drop("one"),
        "mix-sources",
    )
    whole = listed.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, weight = whole["t"] or 0, whole["w"] or 0
    filled = running_totals(
        listed, ["ratio", "source"], {"cap_before": "cap", "weight_before": "weight"}, "mix-levels"
    )
    levels = filled.select(
        ((F.lit(total) - F.col("cap_before")).cast("double") / (F.lit(weight) - F.col("weight_before"))).alias("v")
    )
    level = levels.agg(F.max("v")).first()[0] or 0.0
    return listed.select(
        "source", "source_size", "source_start",
        F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"),
    )


def _plan(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``source``, ``key``, ``tie``, ``size`` and any other columns -> with the source's figures and the words taken."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs).withColumnRenamed("source", "of")
    placed = running_totals(rows, ["source", "key", "tie"], {"before": "size"}, "mix-order")
    budget, size = F.floor("target").cast("long"), F.col("source_size")
    epochs = F.when(size > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    tail = budget - F.col("epochs") * size - (F.col("before") - F.col("source_start"))
    return (
        placed.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("epochs", epochs)
        .withColumn("tail", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), tail)))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("tail"))
        .drop("of", "before", "source_start", "key")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, tail, taken.

    ``epochs`` times the whole text plus its first ``tail`` words are ``taken``; a source's taken
    words are its target, rounded down. Null and empty texts have no words and are never taken. A
    null source is a source of its own, the last. Equal ids share a key and are ordered by their
    text's hash; equal rows are interchangeable. An empty table gives no rows. Further columns of
    ``docs`` are not read.
    """
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
        random_key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("tie"),
    )
    return _plan(stage(rows, "mix-sizes"), weights, max_epochs).drop("tie")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: the columns of ``docs`` plus ``taken`` (words) for each document taken at all.

    A document stands once, whole; a trainer reads its words in a circle until ``taken`` of them
    are read. Names that clash get underscores. Cases as in :func:`mix`.
    """
    kept, row_id = with_row_ids(docs, "mix-rows")
    rows = kept.select(
        F.col(row_id).alias("row"), F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"), random_key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("tie"),
    )
    plan = _plan(stage(rows, "mix-sizes"), weights, max_epochs)
    taken = fresh(docs, "taken")
    plan = plan.where("taken > 0").select(F.col("row").alias(row_id), F.col("taken").alias(taken))
    return kept.join(plan, row_id).drop(row_id)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op1: all documents, their source's target and the words the mix takes."""
    mixed = mix(spark.read.parquet(f"{folder}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0
    ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS cap,
    (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS ws,
    coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT max((t - cap_before)::DOUBLE / (ws - weight_before)::DOUBLE) AS level FROM l),
g AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM w, v),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
r AS (SELECT p.*, g.source_size, g.target, CASE WHEN g.source_size > 0
    THEN floor(g.target)::BIGINT // g.source_size ELSE 0 END AS epochs
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken,
  source
FROM r
"""
