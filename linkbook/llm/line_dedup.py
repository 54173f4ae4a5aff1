"""Line dedup: of lines that are equal or nearly so, one occurrence stays in the whole corpus.

Lines are normalised and get a SimHash of their words. Lines that agree in enough blocks of its
bits are candidates (pigeonhole), an edit distance verifies them, and one occurrence of each
connected group stays. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkbook.llm.common import column, components, fresh, with_row_ids, words
from linkbook.plans.staging import stage

BITS = 63  # three 21-bit counters share a long, so a line may have two million words
LANE = 21
# Fingerprints at most this far apart always share a bucket.
DISTANCE = 3
# Pairs of a bucket further apart than this are not similar lines but chance.
FAR = 12
# Lines are alike if their edit distance is at most this share of the longer one.
MAX_EDIT_SHARE = 0.1
FEATURE_LETTERS = 4
# Letters of the pieces that two lines are compared by before they are compared as a whole.
PIECES = (64, 256, 1024, 4096, 16384)
BROADCAST_BYTES = 32 << 20
HEADS = 2


def normalised(line: Column) -> Column:
    """Words of a line in lower case."""
    return words(F.lower(line))


def blocks_for(n_lines: int, distance: int = DISTANCE) -> int:
    """The fewest blocks whose buckets hold at most about one chance partner per line.

    With b blocks, two fingerprints at ``distance`` agree on b - distance of them; a bucket is a
    choice of so many blocks. More blocks make more but smaller buckets and lose nothing.
    """
    blocks = distance + 1
    while blocks < 12 and comb(blocks, distance) * n_lines / 2 ** (BITS * (blocks - distance) / blocks) > 1:
        blocks += 1
    return blocks


def _bit_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of all choices of ``blocks`` - ``distance`` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    single = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(choice) for choice in combinations(single, blocks - distance)]


def _lines(rows: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``text`` -> one row per line: with ``at``, ``w`` (its words), ``k1``, ``k2``, ``len``."""
    at = rows.select("row", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    split = at.select("row", "doc_id", "at", F.xxhash64("line").alias("raw"), normalised(F.col("line")).alias("w"))
    joined = split.withColumn("norm", F.array_join("w", " "))
    return joined.withColumns(
        {"k1": F.xxhash64("norm"), "k2": F.xxhash64("norm", F.lit("second")), "len": F.length("norm")}
    )


def _wordings(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id``, ``norm`` of the lines whose unchanged text has a hash of ``wanted`` (``raw``, ``id``, ``k1``, ``k2``)."""
    line = rows.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    found = line.withColumn("raw", F.xxhash64("line")).join(wanted, "raw")
    # One of equal lines is normalised. Two lines of one hash stay apart by another one.
    once = found.groupBy("id", "k1", "k2", F.xxhash64("line", F.lit("second"))).agg(F.first("line").alias("line"))
    spelled = once.withColumn("norm", F.array_join(normalised(F.col("line")), " "))
    exact = spelled.where((F.xxhash64("norm") == F.col("k1")) & (F.xxhash64("norm", F.lit("second")) == F.col("k2")))
    return exact.dropDuplicates(["id"]).select("id", "norm")


def _fingerprinted(lines: DataFrame) -> DataFrame:
    """Each line once with ``n_words`` and its SimHash ``sim``; lines without words have no words counted."""
    long = F.filter("w", lambda x: F.length(x) >= FEATURE_LETTERS)
    features = F.when(F.size(long) > 0, long).otherwise(F.col("w"))
    keys = ["row", "doc_id", "at", "k1", "k2", "len", "raw"]
    each = lines.select(*keys, F.explode_outer(features).alias("word")).withColumn(
        "h", F.when(F.col("word").isNotNull(), F.xxhash64("word"))
    )
    lanes = (1 << 2 * LANE) | (1 << LANE) | 1
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(lanes))).alias(f"s{j}") for j in range(LANE)]
    counted = each.groupBy(*keys).agg(F.count("h").alias("n"), *sums)
    # Added to a counter, this sets its top bit if more than half of the words count; the three of a long at once.
    counted = counted.withColumn("more", (F.lit((1 << (LANE - 1)) - 1) - F.shiftright("n", 1)) * F.lit(lanes))
    sim = F.lit(0).cast("long")
    for j in range(LANE):
        many = F.shiftrightunsigned(F.col(f"s{j}") + F.col("more"), LANE - 1).bitwiseAND(F.lit(lanes))
        sim = sim.bitwiseOR(F.shiftleft(many, j))
    return counted.select(*keys, "n", F.coalesce(sim, F.lit(0).cast("long")).alias("sim"))


def _may_be_alike(sim: str, other_sim: str, size: str, other_size: str) -> Column:
    """Whether fingerprints and lengths allow two lines to be alike."""
    near = F.bit_count(F.col(sim).bitwiseXOR(F.col(other_sim))) <= FAR
    return near & (F.abs(F.col(size) - F.col(other_size)) <= _most_edits(F.greatest(size, other_size)))


def _most_edits(longest: Column) -> Column:
    return F.floor(longest * MAX_EDIT_SHARE).cast("int")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(pair: Column, end: bool) -> Column:
    """A pair of texts ``a``, ``b`` without the beginning or end that they share, which takes no edits."""
    steps = F.array(*[F.lit(1 << i) for i in range(16, -1, -1)])

    def longest(sizes: Column) -> Column:
        def grow(n: Column, step: Column) -> Column:
            a, b = (F.substr(pair[k], sizes[k] - n - step + 1 if end else n + 1, step) for k in "ab")
            return F.when((n + step <= F.least(sizes["a"], sizes["b"])) & (a == b), n + step).otherwise(n)

        return F.aggregate(steps, F.lit(0), grow)

    def rest(n: Column) -> Column:
        return F.struct(*[F.substr(pair[k], F.lit(1) if end else n + 1, F.length(pair[k]) - n).alias(k) for k in "ab"])

    return _let(_let(F.struct(*[F.length(pair[k]).alias(k) for k in "ab"]), longest), rest)


def _within(pair: Column, most: Column) -> Column:
    """Whether ``most`` edits make the texts of a pair equal.

    The distance takes time with the square of the length. That of the pieces at equal places, all
    together, is never less, and settles most pairs that are alike; longer pieces bear longer shifts.
    """

    def pieces(size: Column, piece: int) -> Column:
        def edits(sum_: Column, at: Column) -> Column:
            a, b = (F.substr(pair[k], at, F.lit(piece)) for k in "ab")
            # Beyond half of its letters (-1) a piece counts in full.
            own = F.pmod(F.call_function("levenshtein", a, b, F.lit(piece // 2)), F.lit(piece + 1))
            return sum_ + F.when(a == b, 0).otherwise(own)

        return F.aggregate(F.sequence(F.lit(1), size, F.lit(piece)), F.lit(0), edits)

    def decided(size: Column) -> Column:
        found = F.call_function("levenshtein", pair["a"], pair["b"], most) >= 0
        for piece in reversed(PIECES):
            found = F.when((size > 2 * piece) & (pieces(size, piece) <= most), True).otherwise(found)
        return found

    return _let(F.greatest(*[F.length(pair[k]) for k in "ab"]), decided)


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose wordings are alike."""
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("norm").alias("ta")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("norm").alias("tb")), "b"
    )
    most = _most_edits(F.greatest(F.length("ta"), F.length("tb")))
    whole = F.struct(F.col("ta").alias("a"), F.col("tb").alias("b"))
    cut = _let(_cut(whole, end=False), lambda pair: _cut(pair, end=True))
    return joined.where(_let(cut, lambda pair: _within(pair, most))).select("a", "b")


def _similar_lines(distinct: DataFrame, rows: DataFrame, n_lines: int) -> DataFrame:
    """Links ``a``, ``b`` between ids of distinct lines, enough to connect every group.

    In a bucket every line is compared with one head; there are ``HEADS`` orders that choose it,
    so near copies meet few different heads. What this
    connects needs no further comparison; lines of a bucket that are still apart are compared.
    """
    masks = _bit_masks(blocks_for(n_lines), DISTANCE)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("sim").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)])
    entries = distinct.select("id", "sim", "len", F.posexplode(keys).alias("choice", "bucket"))
    order = Window.partitionBy("bucket").orderBy(F.xxhash64(F.col("choice") % HEADS, "id"), "id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    headed = entries.withColumns({f"head_{c}": F.first(c).over(upto) for c in ("id", "sim", "len")})
    # Every line of a bucket but its head.
    members = stage(headed.where("id != head_id"), "lines-buckets")
    stars = members.where(_may_be_alike("sim", "head_sim", "len", "head_len")).select(
        F.least("id", "head_id").alias("a"), F.greatest("id", "head_id").alias("b")
    ).distinct()
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    crowd = members.join(crowded, "bucket", "left_semi")
    heads = crowd.select("bucket", *[F.col(f"head_{c}").alias(c) for c in ("id", "sim", "len")], F.lit(True).alias("is_head")).distinct()
    crowd = stage(crowd.select("bucket", "id", "sim", "len", F.lit(False).alias("is_head")).union(heads), "lines-crowds")
    wanted = stars.select(F.col("a").alias("id")).union(stars.select("b")).union(crowd.select("id")).distinct()
    wanted = stage(distinct.join(wanted, "id", "left_semi").select("id", "raw", "k1", "k2"), "lines-wanted")
    small = F.broadcast(wanted) if wanted.count() * 64 <= BROADCAST_BYTES else wanted
    texts = stage(_wordings(rows, small), "lines-texts")
    alike = stage(_alike(stars, texts), "lines-stars")
    parts = stage(components(alike, "lines-parts"), "lines-parts").select(F.col("node").alias("id"), F.col("group").alias("part"))
    placed = crowd.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    split = placed.groupBy("bucket").agg(
        F.min("part").alias("p"), F.max("part").alias("q"), F.max(F.when(F.col("is_head"), F.col("part"))).alias("core")
    ).where("p < q").select("bucket", "core")
    apart = stage(placed.join(split, "bucket"), "lines-apart")
    lone = apart.where("part != core").select("bucket", "core", *[F.col(c).alias(f"lone_{c}") for c in ("id", "sim", "len", "part")])
    pairs = (
        lone.join(apart.select("bucket", "id", "sim", "len", "part"), "bucket")
        .where((F.col("lone_part") != F.col("part")) & ((F.col("part") == F.col("core")) | (F.col("lone_id") < F.col("id"))))
        .where(_may_be_alike("sim", "lone_sim", "len", "lone_len"))
        .select(F.least("lone_id", "id").alias("a"), F.greatest("lone_id", "id").alias("b")).distinct()
    )
    return alike.union(stage(_alike(pairs, texts), "lines-more"))


def _removed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, removed): every line with words, as row and ``at``; the ones to remove."""
    lines = stage(_fingerprinted(_lines(rows)), "lines")
    distinct = stage(
        lines.where("n > 0").groupBy("k1", "k2").agg(
            F.count("*").alias("times"), F.first("sim").alias("sim"), F.first("len").alias("len"), F.first("raw").alias("raw")
        ).withColumn("id", F.monotonically_increasing_id()),
        "lines-distinct",
    )
    links = _similar_lines(distinct, rows, distinct.count())
    groups = stage(components(links, "lines-groups"), "lines-groups")
    grouped = distinct.select("id", "k1", "k2", "times").join(groups.withColumnRenamed("node", "id"), "id", "left")
    repeated = grouped.where("times > 1 or group is not null").select("k1", "k2", F.coalesce("group", "id").alias("group"))
    # Only lines that stand more than once are ordered.
    members = stage(lines.where("n > 0").join(repeated, ["k1", "k2"]).select("group", "doc_id", "row", "at"), "lines-repeated")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "at")
    stays = members.groupBy("group").agg(F.min(place).alias("stays")).select("group", F.col("stays.row").alias("stay_row"), F.col("stays.at").alias("stay_at"))
    removed = members.join(stays, "group").where((F.col("row") != F.col("stay_row")) | (F.col("at") != F.col("stay_at"))).select("row", "at")
    return lines, removed


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines (with words), n_removed, removed (line numbers from 0).

    Lines end at \\n and are compared in lower case with single blanks. The occurrence that
    stays is the one in the document with the smallest id (null last), then the one that stands
    first. Lines without words are never removed; null and empty texts have none. Documents
    that repeat lose their lines but for one. An empty table gives no rows; further columns are
    not read.
    """
    # The lines are read again for their wording alone, so the row ids of the two reads need not agree.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    lines, removed = _removed(rows)
    lost = removed.groupBy("row").agg(F.count("*").alias("n_removed"), F.array_sort(F.collect_list("at")).alias("removed"))
    counts = lines.groupBy("row", "doc_id").agg(F.count(F.when(F.col("n") > 0, 1)).alias("n_lines"))
    return counts.join(lost, "row", "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; a document that loses all its words goes, others keep all columns.

    A column ``n_chars`` is counted anew where lines went. Cases as in :func:`duplicate_lines`.
    """
    kept, row_id = with_row_ids(docs, "lines-docs")
    _, removed = _removed(kept.select(F.col(row_id).alias("row"), "doc_id", F.col("text").cast("string").alias("text")))
    name = fresh(kept, "removed")
    lost = stage(removed.groupBy(F.col("row").alias(row_id)).agg(F.collect_list("at").alias(name)), "lines-removed")
    joined = kept.join(lost, row_id, "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(name))
    text = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    changed = F.col(name).isNotNull()
    cut = joined.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    cut = cut.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*[column(cut, c) for c in docs.columns])


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op3: removed lines of all documents."""
    return duplicate_lines(spark.read.parquet(f"{folder}/documents.parquet"))
