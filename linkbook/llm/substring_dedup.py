"""Substring dedup: remove word windows that a document with a smaller id holds too.

Level-wise doubling: runs of a short length that occur in two texts are extended to twice the
length, until the window's length is reached or nothing survives. A level does not keep every
run: each window stands for itself by the least hash of the runs inside it, so equal windows
always send the same run, and a level ships about 2 / (window - length) of all positions. Windows
whose run occurs in one text only are out; the last level compares whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkbook.llm.common import text_key
from linkbook.llm.hashing import scramble, sequences, slices, word_hashes
from linkbook.plans.staging import stage

WINDOW = 50
FIRST_LENGTH = 13  # the shortest level is at most this long


def levels(window: int = WINDOW, first: int = FIRST_LENGTH) -> list[int]:
    """Run lengths, each at most twice the one before; the last is the window."""
    lengths = [window]
    while lengths[0] > first:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


def _runs(hashes: np.ndarray, length: int, window: int, first: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words, each made of two runs of the level below."""
    below = [n for n in levels(window, first) if n < length]
    if not below:
        return sequences(hashes, length)
    half = _runs(hashes, below[-1], window, first)
    n, shift = len(hashes) - length + 1, length - below[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    return scramble(half[:n] * np.uint64(0x9E3779B97F4A7C15) + half[shift : shift + n])


def _least(runs: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done, out = 1, runs
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _standing(hashes: np.ndarray, length: int, window: int, first: int) -> np.ndarray:
    """For each window, the hash of the run of ``length`` that stands for it."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    return _least(_runs(hashes, length, window, first), window - length + 1)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _binary(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "").cast(pa.large_binary())


def _read(window: int, first: int):
    """(doc_id, key, text) -> (doc_id, key, n_words, digest, runs of the shortest level)."""
    length = levels(window, first)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _binary(batch.column("text"))
            for at, to, content, offsets in slices(batch.column("text")):
                hashes, starts = word_hashes(content, offsets, lower=False)
                words = [t.as_py().split() for t in texts.slice(at, to - at)]
                runs = [
                    np.unique(_standing(hashes[starts[i] : starts[i + 1]], length, window, first)).view(np.int64)
                    for i in range(to - at)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, to - at), batch.column("key").slice(at, to - at),
                        pa.array([len(w) for w in words], pa.int64()), pa.array([_digest(w) for w in words]),
                        pa.array(runs, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "key", "n_words", "digest", "runs"],
                )

    return run


def _surviving(batch: pa.RecordBatch, i: int, standing: np.ndarray) -> np.ndarray:
    known = np.sort(batch.column("runs")[i].values.to_numpy()).view(np.int64)
    mine = standing.view(np.int64)
    at = np.searchsorted(known, mine)
    return known[np.minimum(at, len(known) - 1)] == mine


def _extend(length: int, window: int, first: int):
    """(row, text, repeated runs of the level below) -> (row, runs of ``length`` of the windows that survive)."""
    below = [n for n in levels(window, first) if n < length][-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, content, offsets in slices(batch.column("text")):
                hashes, starts = word_hashes(content, offsets, lower=False)
                out = []
                for i in range(to - at):
                    own = hashes[starts[i] : starts[i + 1]]
                    alive = _surviving(batch, at + i, _standing(own, below, window, first))
                    out.append(np.unique(_standing(own, length, window, first)[alive]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(at, to - at), pa.array(out, pa.list_(pa.int64()))], ["row", "runs"]
                )

    return run


def _whole_windows(window: int, first: int):
    """(row, doc, text, repeated runs) -> (row, doc, at, hash, check) of the windows that survive, in full."""
    below = levels(window, first)[-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, content, offsets in slices(batch.column("text")):
                hashes, starts = word_hashes(content, offsets, lower=False)
                for i in range(to - at):
                    own = hashes[starts[i] : starts[i + 1]]
                    alive = np.flatnonzero(_surviving(batch, at + i, _standing(own, below, window, first)))
                    if not len(alive):
                        continue
                    row, doc = batch.column("row")[at + i], batch.column("doc")[at + i]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(row, len(alive)), pa.repeat(doc, len(alive)), pa.array(alive, pa.int32()),
                            pa.array(_runs(own, window, window, first)[alive].view(np.int64)),
                            pa.array(sequences(own, window)[alive].view(np.int64)),
                        ],
                        ["row", "doc", "at", "hash", "check"],
                    )

    return run


def _cut(window: int):
    """(row, text, starts of removed windows) -> (row, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, starts in zip(_binary(batch.column("text")), batch.column("starts"), strict=True):
                words = text.as_py().split()
                change = np.zeros(len(words) + 1, np.int64)
                at = starts.values.to_numpy()
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_removed", "kept"]
            )

    return run


def _repeated(runs: DataFrame, label: str) -> DataFrame:
    """``row``, ``runs`` -> the same with only those runs that occur in two rows; rows without any go."""
    long = runs.select("row", F.explode("runs").alias("run"))
    shared = long.groupBy("run").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("run")
    return stage(long.join(shared, "run", "left_semi").groupBy("row").agg(F.collect_list("run").alias("runs")), label)


def _removals(docs: DataFrame, window: int, first: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, cuts): every document; every distinct text; the texts with removed words, and what is kept of them."""
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    rows = stage(
        keyed.mapInArrow(_read(window, first), f"doc_id {id_type}, key binary, n_words bigint, digest string, runs array<bigint>")
        .withColumn("row", F.monotonically_increasing_id()),
        "windows-rows",
    )
    # One row stands for all copies of a text, with their smallest id.
    texts = stage(rows.groupBy("key").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc")), "windows-texts")
    one = rows.select("row", "runs").join(texts.select("row"), "row", "left_semi")
    alive = _repeated(one, "windows-level")
    chosen = texts.join(alive.select("row"), "row", "left_semi")
    content = stage(
        keyed.select("key", "text").join(chosen, "key").dropDuplicates(["key"]).select("row", "doc", "text"), "windows-content"
    )
    for length in levels(window, first)[1:-1]:
        extended = content.select("row", "text").join(alive, "row").mapInArrow(_extend(length, window, first), "row bigint, runs array<bigint>")
        alive = _repeated(stage(extended, "windows-extended"), "windows-level")
        if alive.isEmpty():
            break
    doc_type = content.schema["doc"].dataType.simpleString()
    spelled = stage(
        content.join(alive, "row").mapInArrow(
            _whole_windows(window, first), f"row bigint, doc {doc_type}, at int, hash bigint, check bigint"
        ),
        "windows-full",
    )
    firsts = spelled.groupBy("hash", "check").agg(F.min("doc").alias("first"), F.min("row").alias("a"), F.max("row").alias("b"))
    gone = spelled.join(firsts.where("a < b").select("hash", "check", "first"), ["hash", "check"]).where("doc > first")
    starts = gone.groupBy("row").agg(F.collect_list("at").alias("starts"))
    cuts = content.select("row", "text").join(starts, "row").mapInArrow(_cut(window), "row bigint, n_removed bigint, kept string")
    return rows.drop("runs"), texts, cuts


def dedup(docs: DataFrame, window: int = WINDOW, first: int = FIRST_LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept.

    ``kept`` is the text that is left, null where nothing was removed. Words are runs of
    non-blanks, unchanged; a null text has none. Windows are judged on the input. Of equal texts
    every one but those with the smallest id loses all words, if it has ``window`` of them. Rows
    that repeat with the same id do not remove each other. Documents with a null id remove
    nothing and keep everything. An empty table gives no rows; further columns are not read.
    """
    rows, texts, cuts = _removals(docs, window, first)
    cut = cuts.select(F.col("row").alias("text_row"), "n_removed", "kept")
    facts = texts.select("key", F.col("row").alias("text_row"), "doc").join(cut, "text_row", "left")
    copy = (F.col("doc_id") > F.col("doc")) & (F.col("n_words") >= window)
    own = F.col("doc_id").isNotNull() & F.col("n_removed").isNotNull()
    joined = rows.join(facts, "key")
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    return joined.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(own, digest).otherwise(F.col("digest")).alias("kept_sha256"),
        F.when(copy, F.lit("")).when(own, F.col("kept")).alias("kept"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op6: removed words of all documents."""
    return dedup(spark.read.parquet(f"{folder}/documents.parquet")).drop("kept")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS i FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
r AS (SELECT DISTINCT g.doc_id, g.i + o AS j FROM g JOIN f USING (h), range(0, 50) x(o) WHERE g.doc_id > f.first),
u AS (SELECT d.doc_id, d.w, unnest(range(0, len(d.w))) AS j FROM d),
n AS (SELECT u.doc_id, count(*) AS n_kept, string_agg(u.w[u.j + 1], ' ' ORDER BY u.j) AS kept
  FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.j = u.j WHERE r.j IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(n.n_kept, 0))::BIGINT AS n_removed,
  sha256(coalesce(n.kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""
