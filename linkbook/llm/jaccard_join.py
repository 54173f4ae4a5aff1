"""N-gram Jaccard join: MinHash bands find candidates, full shingle sets verify them.

Copies of a text are one row from the start. In a band's bucket every text is compared with one
head, another one in each band. Texts that this connects need no further comparison; two texts
of a bucket that are still apart are compared, unless the sizes of their sets rule it out; in
buckets of more than ``CROWD`` texts this happens inside blocks, without listing the pairs. So a
bucket of near copies is not expanded into pairs, and no similar pair of a bucket is missed.
Connected groups are the classes. The links of a text are then counted inside its class, block
by block, without emitting pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkbook.llm.common import components, text_key, with_row_ids
from linkbook.llm.hashing import scramble, sequences, slices, word_hashes
from linkbook.plans.staging import stage

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 320
# Buckets of more texts are compared inside blocks; pairs of the others are listed.
CROWD = 16
# Shingles of one block of a class or of a crowded bucket; those with more are cut into blocks.
BLOCK_SHINGLES = 400_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose bands reach the recall at the threshold within the hashes."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if miss > 0 else 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _row_shingles(hashes: np.ndarray, runs: np.ndarray, a: int, b: int, n: int) -> np.ndarray:
    """Distinct shingles of the words a..b of a slice; fewer than n words are one shingle."""
    if b - a >= n:
        return np.unique(runs[a : b - n + 1])
    return sequences(hashes[a:b], b - a)[:1] ^ np.uint64(b - a) if b > a else runs[:0]


def _signatures(shingle: int, bands: int, rows: int):
    """Arrow function: (doc_id, key, text) -> (doc_id, key, size, bands); no bands for a text without words."""
    mixers = np.random.default_rng(8).integers(0, 2**63, bands * rows, dtype=np.int64).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, content, offsets in slices(batch.column("text")):
                hashes, first = word_hashes(content, offsets, lower=True)
                runs = sequences(hashes, shingle)
                out: list[np.ndarray | None] = []
                sizes = []
                for i in range(to - at):
                    own = _row_shingles(hashes, runs, first[i], first[i + 1], shingle)
                    sizes.append(len(own))
                    if not len(own):
                        out.append(None)
                        continue
                    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                    for part in range(0, len(own), 512):
                        mixed = (own[part : part + 512, None] ^ mixers) * np.uint64(0x9FB21C651E98DF25)
                        np.minimum(least, mixed.min(axis=0), out=least)
                    table = scramble(least).reshape(bands, rows)
                    band = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        band = scramble(band * np.uint64(31) + table[:, r])
                    out.append(band.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, to - at), batch.column("key").slice(at, to - at),
                        pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "key", "size", "bands"],
                )

    return run


def _sets(shingle: int):
    """Arrow function: (key, text) -> (key, grams), the sorted distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, content, offsets in slices(batch.column("text")):
                hashes, first = word_hashes(content, offsets, lower=True)
                runs = sequences(hashes, shingle)
                out = [_row_shingles(hashes, runs, first[i], first[i + 1], shingle).view(np.int64) for i in range(to - at)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(at, to - at), pa.array(out, pa.list_(pa.int64()))], ["key", "grams"]
                )

    return run


def _sizes_allow(a: str, b: str, threshold: float) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b) - 1e-9


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets are similar."""
    joined = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b"
    )
    same = F.size(F.array_intersect("ga", "gb")).cast("double")
    return joined.where(same >= F.lit(threshold) * (F.size("ga") + F.size("gb") - same) - 1e-9).select("a", "b")


def _count_links(threshold: float):
    """Pandas function over one pair of blocks of a class: links of each text into the other block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] != 1], rows[rows["side"] != 0]
        same_block = bool((rows["side"] == 2).any())
        grams = [np.asarray(g, np.int64) for g in right["grams"]]
        sizes = np.array([len(g) for g in grams])
        copies = right["copies"].to_numpy()
        flat, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        to_left, to_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for i, (own, n) in enumerate(zip(left["grams"], left["copies"], strict=True)):
            own = np.asarray(own, np.int64)
            a, b = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            counts = b - a
            at = np.repeat(a, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            same = np.bincount(owner[at], minlength=len(grams))
            hit = same >= threshold * (len(own) + sizes - same) - 1e-9
            to_left[i] = copies[hit].sum() - (n if same_block else 0)
            to_right[hit] += n
        out = [pd.DataFrame({"key": left["key"], "links": to_left})]
        if not same_block:
            out.append(pd.DataFrame({"key": right["key"], "links": to_right}))
        return pd.concat(out)

    return run


def _placed(rows: DataFrame, by: list[str], more: list[str]) -> DataFrame:
    """``by``, key, grams and ``more`` of each text for every pair ``i``, ``j`` of blocks that it takes part in.

    ``side``: 0 left, 1 right, 2 both, where a block meets itself. Groups of one text have no rows.
    """
    big = rows.groupBy(*by).agg(F.sum(F.size("grams").cast("long")).alias("grams_all"), F.count("*").alias("texts")).where("texts > 1")
    blocks = F.ceil(F.col("grams_all") / BLOCK_SHINGLES).cast("int")
    cut = rows.join(big, by).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # A text of block i takes part in the pairs (i, j) with j >= i on the left and (j, i) with j < i on the right.
    kept = [*by, "key", "grams", *more]
    paired = cut.select(*kept, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    return paired.select(
        *kept, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
        F.when(F.col("block") == F.col("with"), 2).when(F.col("block") < F.col("with"), 0).otherwise(1).cast("int").alias("side"),
    )


def _connect(threshold: float):
    """Pandas function over one pair of blocks of a bucket: similar texts of different parts, enough to connect them.

    Pairs that an earlier band puts into one bucket are left to that one.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = np.arange(len(rows))
        side, band = rows["side"].to_numpy(), int(rows["band"].iloc[0])
        keys, root = rows["key"].tolist(), pd.factorize(rows["part"])[0]
        earlier = np.stack([np.asarray(b, np.int64) for b in rows["bands"]])[:, :band]
        grams = [np.sort(np.asarray(g, np.int64)) for g in rows["grams"]]
        sizes = np.array([len(g) for g in grams])
        links = []
        for i in at[side != 1]:
            own, n = grams[i], sizes[i]
            other = (side != 0) & (root != root[i]) & ((side != 2) | (at > i))
            other &= np.minimum(sizes, n) >= threshold * np.maximum(sizes, n) - 1e-9
            other &= ~(earlier == earlier[i]).any(axis=1)
            found = np.flatnonzero(other)
            if not len(found):
                continue
            flat = np.concatenate([grams[j] for j in found])
            hit = own[np.minimum(np.searchsorted(own, flat), n - 1)] == flat
            same = np.add.reduceat(hit, np.cumsum(sizes[found]) - sizes[found], dtype=np.int64)
            for j in found[same >= threshold * (n + sizes[found] - same) - 1e-9]:
                if root[i] != root[j]:
                    links.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, sets) of the join.

    ``rows``: doc_id, key and has_words of each document. ``sets``: key and shingles of the texts
    that share a band with another. ``texts``: for each distinct text its key, the
    smallest doc_id (``first_id``), the number of copies, and ``group``, the smallest key of
    its class.
    """
    bands, band_rows = bands_for(threshold, recall)
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    signed = stage(
        keyed.mapInArrow(_signatures(shingle, bands, band_rows), f"doc_id {id_type}, key binary, size bigint, bands array<bigint>"), "join-bands"
    )
    texts = stage(
        signed.groupBy("key").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")
        ),
        "join-texts",
    )
    entries = texts.select("key", "size", F.posexplode("bands").alias("band", "hash"))
    order = F.struct(F.xxhash64("band", "key"), "key", "size")
    heads = entries.groupBy("band", "hash").agg(F.min(order).alias("h"), F.count("*").alias("n")).where("n > 1")
    heads = heads.select("band", "hash", F.col("h.key").alias("head"), F.col("h.size").alias("head_size"))
    bucketed = stage(entries.join(heads, ["band", "hash"]), "join-buckets")
    stars = bucketed.where((F.col("key") != F.col("head")) & _sizes_allow("size", "head_size", threshold)).select(
        F.least("head", "key").alias("a"), F.greatest("head", "key").alias("b")
    ).distinct()
    shared = bucketed.select("key").distinct()
    candidates = keyed.select("key", "text").join(shared, "key", "left_semi").dropDuplicates(["key"])
    sets = stage(candidates.mapInArrow(_sets(shingle), "key binary, grams array<bigint>"), "join-sets")
    alike = stage(_similar(stars, sets, threshold), "join-stars")
    # What the heads have connected needs no comparison. In each bucket the rest is compared.
    joined = stage(components(alike, "join-groups"), "join-groups").withColumnRenamed("group", "part")
    member = bucketed.join(joined, bucketed["key"] == joined["node"], "left").withColumn("part", F.coalesce("part", "key")).drop("node")
    split = member.groupBy("band", "hash").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n")).where("p < q").select("band", "hash", "n")
    apart = stage(member.join(split, ["band", "hash"]), "join-apart")
    crowded = apart.where(F.col("n") > CROWD).select("band", "hash", "key", "part").join(sets, "key").join(texts.select("key", "bands"), "key")
    apart = apart.where(F.col("n") <= CROWD)
    core = apart.where("key = head").select("band", "hash", F.col("part").alias("core"))
    apart = apart.join(core, ["band", "hash"])
    lone = apart.where("part != core").select("band", "hash", "core", *[F.col(c).alias(f"lone_{c}") for c in ("key", "size", "part")])
    others = apart.select("band", "hash", "key", "size", "part")
    pairs = (
        lone.join(others, ["band", "hash"])
        .where((F.col("lone_part") != F.col("part")) & ((F.col("part") == F.col("core")) | (F.col("lone_key") < F.col("key"))))
        .where(_sizes_allow("size", "lone_size", threshold))
        .select(F.least("lone_key", "key").alias("a"), F.greatest("lone_key", "key").alias("b")).distinct()
    )
    dense = _placed(crowded, ["band", "hash"], ["part", "bands"]).groupBy("band", "hash", "i", "j").applyInPandas(
        _connect(threshold), "a binary, b binary"
    )
    more = stage(_similar(pairs, sets, threshold).union(dense), "join-more")
    links = joined.select(F.col("node").alias("a"), F.col("part").alias("b")).union(more)
    groups = components(links, "join-groups")
    grouped = texts.drop("bands", "size").join(groups.withColumnRenamed("node", "key"), "key", "left")
    grouped = grouped.withColumn("group", F.coalesce("group", "key"))
    rows = signed.select("doc_id", "key", F.col("bands").isNotNull().alias("has_words"))
    return rows, stage(grouped, "join-classes"), sets


def link_counts(texts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``key``, ``links``: similar documents of other texts, for each text of a class of several."""
    placed = _placed(texts.join(sets, "key"), ["group"], ["copies"])
    counted = placed.groupBy("group", "i", "j").applyInPandas(_count_links(threshold), "key binary, links bigint")
    return counted.groupBy("key").agg(F.sum("links").alias("links"))


def join(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, text_id.

    Texts are compared as sets of ``shingle`` successive words (lower-cased A-Z, split at ASCII
    white space); a text of fewer words is one shingle. ``class_id`` is the smallest doc_id of
    the class, ``text_id`` that of the exact copies, ``n_links`` the number of other documents
    at ``threshold`` or above, copies included. A text without words (null, empty) is alone: its
    class is its own doc_id. Null ids are rows like others and never the smallest unless alone.
    Rows that repeat link to each other. An empty table gives no rows; further columns are not
    read. A pair at the threshold shares a band with probability ``recall`` at least.
    """
    rows, texts, sets = classes(docs, threshold, shingle, recall)
    whole = texts.groupBy("group").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    counted = texts.join(link_counts(texts, sets, threshold), "key", "left").join(whole, "group")
    facts = counted.select(
        F.col("key"), "class_id", "class_size", F.col("first_id").alias("text_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    own = lambda c, alone: F.when(F.col("has_words"), F.col(c)).otherwise(alone).alias(c)
    return rows.join(facts, "key").select(
        "doc_id", own("class_id", F.col("doc_id")), own("class_size", F.lit(1).cast("long")),
        own("n_links", F.lit(0).cast("long")), own("text_id", F.col("doc_id")),
    )


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest doc_id (null last, then any one).

    Texts without words all stay. Cases as in :func:`join`.
    """
    kept, row_id = with_row_ids(docs, "join-rows")
    _, texts, _ = classes(kept, threshold, shingle, recall)
    # The text that stays for each class; of its copies, the row that stays.
    best = F.min_by("key", F.struct(F.col("first_id").isNull(), "first_id", "key"))
    stays = texts.groupBy("group").agg(best.alias("key")).select("key")
    narrow = kept.select(
        F.col(row_id).alias("row"), "doc_id", text_key(F.col("text")).alias("key"),
        F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("has_words"),
    )
    first = (
        narrow.where("has_words").join(stays, "key", "left_semi").groupBy("key")
        .agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    )
    chosen = stage(first.select("row").union(narrow.where("not has_words").select("row")), "join-kept")
    return kept.join(chosen.withColumnRenamed("row", row_id), row_id, "left_semi").drop(row_id)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op8: the class, size and links of all documents."""
    return join(spark.read.parquet(f"{folder}/documents.parquet"))
