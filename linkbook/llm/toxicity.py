"""Toxicity by compression distance.

Two zstandard dictionaries are trained from a bounded sample of labelled texts. Both begin with the
same part, trained on ordinary text; after it stands a part of each class's own, of equal size: words of toxic
texts whose letter sequences are significantly commoner there (so stems with varying endings
count), and further ordinary text. Each window is compressed with both; how many bytes the toxic
dictionary saves, over calibrated thresholds, gives the score.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkbook.llm.common import fresh
from linkbook.plans.staging import stage

# Bytes of the part that the dictionaries share, and of each one's own.
SHARED_BYTES, OWN_BYTES = 64 << 10, 16 << 10
LEVEL = 12
# Labelled texts that dictionaries are trained on, about so many of a class at most, chosen by hash;
# texts of more characters are not sampled.
SAMPLE_ROWS, SAMPLE_CHARS = {1: 2_000, 0: 4_000}, 50_000
PIECE_BYTES, PIECES = 400, 10_000
# A letter sequence is typical of toxic texts if so many have it, at so large log odds and score.
WORD_COPIES = 3
GRAMS, GRAM_TEXTS, GRAM_ODDS, GRAM_SCORE = (5, 6, 7, 8), 3, 2.0, 4.0
# Words of a window. The matcher of short inputs skips their last bytes, so a pad that both
# dictionaries hold ends every window; it costs both the same.
WINDOW = 1
PAD = b"@0q7Zk#9vX!2mW~5jQ^8rT&1hL%4dS*6"
# Labelled documents whose features calibrate the thresholds, about so many at most, chosen by hash.
CALIBRATION_ROWS = 40_000
# Byte savings that count a window as a hit, as features.
SAVINGS = (2, 3, 4, 5, 6, 7, 8, 10)
TOPS = (1, 2, 3, 5)
# Labelled ids are broadcast up to this size; a row takes about so many bytes of a task's memory.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64
MEMO_WINDOWS = 200_000
# The calibration counts so many average texts as ordinary beside its own rows, so a handful of labels rejects no corpus.
PRIOR_ROWS = 10
N_FEATURES = len(SAVINGS) + len(TOPS) + 1
PUNCTUATION = ".,;:!?\"()"


@dataclass(frozen=True)
class Model:
    """Dictionary contents, and the weights of the calibrated score."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def score(self, features: np.ndarray) -> np.ndarray:
        value = features @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(value, -50, 50)))


class _Savings(dict):
    """Window -> bytes that the toxic dictionary saves; windows seen before are remembered, within a bound."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self._toxic, self._ordinary = (
            zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw), **plain).compress
            for d in (model.toxic, model.ordinary)
        )

    def __missing__(self, window: bytes) -> int:
        text = b" " + window + b" " + PAD
        saved = min(100, max(-100, len(self._ordinary(text)) - len(self._toxic(text))))
        if len(self) >= MEMO_WINDOWS:
            self.clear()
        self[window] = saved
        return saved


_BREAKS = re.compile(rb'[.,;:!?"()\s]+')


def _words(text: bytes) -> list[bytes]:
    return _BREAKS.sub(b" ", text.lower()).split()


def _features(text: bytes, savings: _Savings) -> list[float]:
    tokens = _words(text)
    if WINDOW > 1:
        tokens = [b" ".join(tokens[i : i + WINDOW]) for i in range(0, len(tokens), WINDOW)]
    saved = np.fromiter(map(savings.__getitem__, tokens), np.int16, len(tokens))
    top = np.sort(saved)[::-1][: max(TOPS)]
    sums = [float(top[:n].sum()) for n in TOPS]
    return [*sums, *(float(np.log1p((saved >= n).sum())) for n in SAVINGS), float(np.log1p(len(saved)))]


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in pc.fill_null(column, "").cast(pa.large_binary()):
        yield x.as_py()


def _feature_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = _Savings(model)
        for batch in batches:
            rows = [_features(t, savings) for t in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["label", "features"]
            )

    return run


def _scored(model: Model, at: int):
    """Arrow function that appends the score of the column in place ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = _Savings(model)
        for batch in batches:
            rows = np.array([_features(t, savings) for t in _texts(batch.column(at))]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.score(rows), pa.float64())], [*batch.schema.names, "score"]
            )

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; of too few samples, their own text."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _grams(words: Iterable[bytes]) -> set[bytes]:
    return {x[i : i + n] for w in words for x in (b" " + w,) for n in GRAMS for i in range(len(x) - n + 1)}


def _typical_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words of the toxic texts that hold a letter sequence typical of them, up to ``WORD_COPIES`` times each."""
    ours, theirs, words = Counter(), Counter(), Counter()
    for text in toxic:
        ours.update(_grams(set(text.split())))
        words.update(text.split())
    candidates = {gram for gram, k in ours.items() if k >= GRAM_TEXTS}
    for text in ordinary:  # only sequences that can be typical are counted
        theirs.update(_grams(set(text.split())) & candidates)
    n, m = len(toxic), len(ordinary)

    def typical(gram: bytes) -> bool:
        expected = n * (ours[gram] + theirs[gram]) / (n + m)
        odds = np.log((ours[gram] + 0.5) / (n + 1)) - np.log((theirs[gram] + 0.5) / (m + 1))
        return odds >= GRAM_ODDS and (ours[gram] - expected) / np.sqrt(expected) >= GRAM_SCORE

    strong = {gram for gram in candidates if typical(gram)}
    return [b" " + w + b" " for w, k in sorted(words.items()) if not strong.isdisjoint(_grams((w,))) for _ in range(min(k, WORD_COPIES))]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary; both begin with the same shared part."""
    shuffled = random.Random(7).shuffle  # the same for equal samples
    ours, theirs = ([b" ".join(_words(t)) for t in sorted(set(texts))] for texts in (toxic, ordinary))
    typical = _typical_words(ours, theirs)
    samples = [b"".join(typical[i : i + 8]) for i in range(0, len(typical), 8)]
    pieces = [t[i : i + PIECE_BYTES] for t in theirs for i in range(0, len(t), PIECE_BYTES)]
    shuffled(samples)
    shuffled(pieces)
    half = min(PIECES, (len(pieces) + 1) // 2)
    shared = _trained(pieces[:half], SHARED_BYTES)
    return tuple(shared + _filled(_trained(own, OWN_BYTES), own) + PAD for own in (samples, pieces[half : 2 * half]))


def _filled(content: bytes, samples: list[bytes]) -> bytes:
    """``content`` with samples before it, of ``OWN_BYTES``: what stands before it lies equally far back in both dictionaries."""
    spare = b"".join(dict.fromkeys(samples))[: OWN_BYTES - len(content)] + content
    return b" " * (OWN_BYTES - len(spare)) + spare


def _fitted(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps on standardised features."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-9] + [penalty] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        curvature, slope = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w
        average = 1 / (1 + np.exp(-np.clip(w[0], -50, 50)))
        curvature[0, 0] += PRIOR_ROWS * average * (1 - average)
        slope[0] -= PRIOR_ROWS * average
        step = np.linalg.solve(curvature, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[1:] / spread
    return (float(w[0] - slopes @ mean), *slopes.tolist())


def _lookup(rows: DataFrame) -> DataFrame:
    """Labelled ids to join: broadcast if they fit ``BROADCAST_BYTES``, else joined by a shuffle."""
    return F.broadcast(rows) if rows.count() * ROW_BYTES <= BROADCAST_BYTES else rows


def _sampled(marks: DataFrame, rows: int, salt: str) -> DataFrame:
    """About ``rows`` of ``marks`` at most, chosen by hash."""
    share = min(1.0, rows / max(1, marks.count()))
    return marks.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 20)) < int(share * (1 << 20)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries from one half of the labelled rows that are not held out, thresholds from the other.

    The dictionaries take about ``SAMPLE_ROWS`` texts of a class at most, the calibration about
    ``CALIBRATION_ROWS`` rows, by hash. Without rows of both labels the score is the share of toxic
    rows, ``PRIOR_ROWS`` ordinary ones counted in, 0 without rows. Null labels are not used; of several labels of an id the largest holds.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2))
    marks = stage(marks.withColumn("half", half), "toxic-labels")
    rows = docs.select("doc_id", F.col("text").alias("text"))
    samples = [_sampled(marks.where((F.col("half") == 0) & (F.col("label") == k)), n, "sample") for k, n in SAMPLE_ROWS.items()]
    sampled = rows.join(_lookup(stage(samples[0].union(samples[1]), "toxic-sample")), "doc_id")
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    # Bounded by SAMPLE_ROWS and SAMPLE_CHARS, and read a partition at a time.
    for r in sampled.where(F.length("text") <= SAMPLE_CHARS).select("label", "text").toLocalIterator():
        texts[r["label"]].append(r["text"].encode("utf-8", "surrogatepass"))
    draft = Model(*dictionaries(texts[1], texts[0]), ())
    other = _sampled(marks.where("half = 1"), CALIBRATION_ROWS, "calibration")
    sample = rows.join(_lookup(stage(other, "toxic-calibration")), "doc_id")
    measured = sample.select("label", "text").mapInArrow(_feature_batches(draft), "label int, features array<double>").collect()
    y = np.array([r["label"] for r in measured], float)
    if len(set(y)) < 2:
        share = float(y.sum()) / (len(y) + PRIOR_ROWS)
        return Model(draft.toxic, draft.ordinary, (float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))), *[0.0] * N_FEATURES))
    order = np.lexsort([*np.array([r["features"] for r in measured]).T, y])
    return Model(draft.toxic, draft.ordinary, _fitted(np.array([r["features"] for r in measured])[order], y[order]))


def scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with the score of ``text`` in a new column ``name``; a null text counts as empty."""
    # Plain names on the way, for names with dots cannot be handed to Python.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(_scored(model, docs.columns.index("text")), schema).toDF(*docs.columns, name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without windows. Rows that repeat get equal
    scores. Empty tables give no rows. Further columns are not read.
    """
    model = train(docs, labels)
    rows = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, "score")
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score 0.5 or more; all columns stay. Cases as in :func:`classify`."""
    name = fresh(docs, "score")
    rows = scored(docs, train(docs, labels), name)
    return rows.where(F.col(name) < 0.5).drop(name)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op7: toxicity scores of all documents."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
