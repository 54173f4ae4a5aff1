"""Benchmark decontamination: find windows of benchmark items in documents.

The items' windows become a hash set, broadcast once its size is checked. Every word position
of every document hashes its window in generated code and probes the set; hits are verified
word by word. Spans or documents go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkbook.llm.common import LOWER, UPPER, fresh, text_key
from linkbook.plans.staging import stage

WINDOW = 10
# Above this many bytes of windows the set is joined by a shuffle instead of being broadcast.
BROADCAST_BYTES = 64 << 20

# ASCII apart from letters and digits separates words; the pattern is a fixed value of the contract.
SEPARATORS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def terms(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters; none for null."""
    plain = F.translate(
        F.coalesce(text, F.lit("")), SEPARATORS + UPPER, " " * len(SEPARATORS) + LOWER
    )
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _window_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + i) for i in range(length)])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id``, ``length``, ``wording``, ``hash``: the distinct windows of each item.

    An item of fewer words than ``window`` is one window; one without words has none.
    """
    items = benchmark.select("item_id", terms(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    at = items.select(
        "item_id", "words", length.alias("length"),
        F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("at"),
    )
    spelled = at.select("item_id", "length", F.slice("words", F.col("at") + 1, F.col("length")).alias("w"))
    hashes = F.lit(None).cast("long")
    for n in range(1, window + 1):
        hashes = F.when(F.col("length") == n, _window_hash(F.col("w"), F.lit(0), n)).otherwise(hashes)
    return spelled.select(
        "item_id", "length", F.array_join("w", " ").alias("wording"), hashes.alias("hash")
    ).distinct()


def hits(docs: DataFrame, windows: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of each document once with a null ``length``, and once per verified hit.

    A hit has the word position ``at``, the ``length`` and the ``wording`` of its window.
    """
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most ``window`` of them
    size = windows.agg(F.sum(F.length("wording") + 40)).first()[0] or 0
    known = windows.select("length", "wording", "hash").distinct()
    known = F.broadcast(known) if size <= BROADCAST_BYTES else known
    listed = docs.withColumn("words", terms(F.col("text"))).drop("text").withColumn("n_words", F.size("words").cast("long"))
    # Position -1 is the document itself, which no window can match.
    at = listed.withColumn("at", F.explode(F.sequence(F.lit(-1), F.col("n_words").cast("int") - 1)))
    fits = [
        F.when((F.col("at") >= 0) & (F.col("at") + n <= F.col("n_words")), _window_hash(F.col("words"), F.col("at"), n))
        for n in lengths
    ]
    if len(fits) == 1:
        probed = at.withColumn("probe", fits[0])
    else:
        own = F.array(*fits, F.when(F.col("at") < 0, F.lit(0).cast("long")))
        probed = at.withColumn("probe", F.explode(own)).where(F.col("probe").isNotNull() | (F.col("at") < 0))
        probed = probed.where((F.col("at") >= 0) | F.col("probe").isNotNull())
    probed = probed.withColumn("probe", F.when(F.col("at") >= 0, F.col("probe")))
    joined = probed.join(known, F.col("probe") == F.col("hash"), "left").where(
        (F.col("at") < 0) | F.col("hash").isNotNull()
    )
    spelled = F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ")
    verified = joined.where((F.col("at") < 0) | (spelled == F.col("wording")))
    return verified.select(*keep, "n_words", "at", "length", "wording")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``spans`` lists the hit word ranges [from, to). ``items_sha256`` digests the item ids,
    sorted as strings and comma-joined; of no items it is the digest of the empty string. Null
    and empty texts have no words and no hits. Rows with equal texts have equal results. Items
    with a null id hit, but are not named. Empty tables on either side give no hits; further
    columns are not read.
    """
    windows = stage(item_windows(benchmark, window), "bench-windows")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").alias("text"))
    found = stage(hits(rows, windows, ["doc_id", "key"]), "bench-hits")
    hit = found.where("at >= 0").select("key", "at", "length", "wording").distinct()
    places = hit.select("key", "at", (F.col("at") + F.col("length")).alias("end")).distinct()
    ordered = Window.partitionBy("key").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = places.withColumn("reach", F.coalesce(F.max("end").over(ordered), F.lit(-1)))
    runs = covered.groupBy("key").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("at", "reach"))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_list(F.struct("at", "end"))).alias("spans"),
    )
    item = hit.select("key", "wording").distinct().join(windows.select("wording", "item_id").distinct(), "wording")
    items = (
        item.where("item_id is not null").select("key", F.col("item_id").cast("string").alias("i")).distinct()
        .groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("i")), ",").alias("ids"))
    )
    results = runs.join(items, "key", "left")
    return (
        found.where("at < 0").select("doc_id", "key", "n_words")
        .join(results, "key", "left")
        .select(
            "doc_id", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
            "spans",
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with no hit, all columns as they are. Cases as in :func:`contamination`."""
    windows = stage(item_windows(benchmark, window), "bench-windows")
    rows = docs.select(text_key(F.col("text")).alias("key"), F.col("text").alias("text"))
    found = stage(hits(rows, windows, ["key"]).where("at >= 0").select("key").distinct(), "bench-hits")
    return docs.join(found, text_key(docs["text"]) == found["key"], "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all rows and columns, with ``text`` cut to the words that no benchmark window covers.

    The words of a text that is cut are lower-cased and joined by one space, as they are compared;
    other texts stay as they are, null and empty ones too. Hits go by the text, so ids may be null
    or repeat. Without a benchmark nothing is cut; empty tables give no rows.
    """
    windows = stage(item_windows(benchmark, window), "bench-windows")
    key, spans = fresh(docs, "text_key"), fresh(docs, "spans")
    rows = docs.select(text_key(F.col("text")).alias("key"), F.col("text").alias("text"))
    places = hits(rows, windows, ["key"]).where("at >= 0").select("key", "at", (F.col("at") + F.col("length")).alias("end")).distinct()
    found = stage(places.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("at", "end")).alias(spans)), "bench-spans")
    covered = lambda i: F.exists(spans, lambda s: (s["at"] <= i) & (i < s["end"]))
    kept = F.filter(terms(F.col("text")), lambda w, i: ~covered(i))
    joined = docs.withColumn(key, text_key(F.col("text"))).join(found, key, "left")
    cut = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(kept, " "))
    return joined.withColumn("text", cut).drop(key, spans)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op4: contamination of all documents by all benchmark items."""
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("spans")


_SQL_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH i AS (SELECT item_id, {_SQL_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT item_id, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, m, array_to_string(w[p + 1 : p + m], ' ') AS g
  FROM (SELECT item_id, w, m, unnest(range(0, len(w) - m + 1)) AS p FROM n)),
d AS (SELECT doc_id, coalesce({_SQL_WORDS.format("text")}, []) AS w FROM documents),
q AS (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d),
c AS (SELECT doc_id, p, m, array_to_string(w[p + 1 : p + m], ' ') AS g
  FROM q, (SELECT DISTINCT m FROM b) WHERE p + m <= len(w)),
h AS (SELECT c.doc_id, c.p, c.m, b.item_id FROM c JOIN b USING (m, g)),
k AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit
  FROM (SELECT DISTINCT doc_id, p, m FROM h), range(0, 10) r(o) WHERE o < m GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_hit, 0)::BIGINT AS n_hit,
  coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
  coalesce(k.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""
