"""Held-out recall of the toxicity score, also of stems with varying endings, and texts cut at benchmark passages."""

import random
import re
import zlib

import pytest

import corpus_pipeline
from linkbook.llm import decontamination, toxicity

FOLDER = "/root/testdata/sf0.1"


def _rates(rows, labels):
    seen = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic, clean = ([p for p, y in seen if y == k] for k in (1, 0))
    return sum(toxic) / len(toxic), 1 - sum(clean) / len(clean)


def test_recall_on_the_labelled_rows(spark):
    rows = toxicity.query(spark, FOLDER).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    recall, specificity = _rates(rows, labels)
    assert recall > 0.8 and specificity > 0.99


def test_stems_with_varying_endings(spark):
    """No toxic word repeats: only the stems are common."""
    rng = random.Random(3)
    syllables = ["an", "er", "on", "ti", "re", "sh", "ou", "le", "ar", "mi", "ko", "du"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    stems = ["vexgrum", "zolpiq"]
    rows, labels = [], []
    for i in range(1500):
        words = [word() for _ in range(rng.randint(30, 120))]
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(stems) + word() + word()
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    recall, specificity = _rates(got, dict(labels))
    assert recall > 0.95 and specificity > 0.98


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_without_spans(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    passage, short = words(25), ["tiny", "item"]
    texts = [" ".join(words(20) + passage[5:19] + words(10)), "A tiny, ITEM here", "Nothing to See", None, "", " ".join(passage)]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, texts[0], "y", 7), (0, texts[5], "z", 8), (0, texts[0], "z", 9), (0, texts[0], "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, text_key long")
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(short)), (None, None)], "item_id long, text string")
    got = decontamination.without_spans(docs, bench)
    assert got.columns == docs.columns

    def cut(text):
        have, gone = _terms(text), set()
        for item in (passage, short):
            n = min(10, len(item))
            known = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
            gone |= {k for i in range(len(have) - n + 1) if tuple(have[i : i + n]) in known for k in range(i, i + n)}
        return " ".join(w for i, w in enumerate(have) if i not in gone) if gone else text

    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((a, cut(t), b, c) for a, t, b, c in rows), key=key)
    assert sorted(map(tuple, decontamination.without_spans(docs, bench.limit(0)).collect()), key=key) == sorted(rows, key=key)


def test_stages_delete_the_scratch_before(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of text number {i} " * 20, "en", "s", 10) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    first = corpus_pipeline.mix(spark, docs, str(tmp_path))
    kept = list(corpus_pipeline._scratch[spark.sparkContext.applicationId])
    read = {p for p in kept if any(p.rpartition("/")[2] in f for f in first.inputFiles())}
    assert read and first.count() > 0
    second = corpus_pipeline.mix(spark, first, str(tmp_path))  # it reads them: they stay
    assert read <= set(corpus_pipeline._scratch[spark.sparkContext.applicationId])
    assert second.count() > 0
    corpus_pipeline.mix(spark, docs, str(tmp_path))
    assert not read & set(corpus_pipeline._scratch[spark.sparkContext.applicationId])


@pytest.mark.parametrize("position", [0, 3])
def test_stages_keep_what_their_operators_accept(spark, position):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[position][1](spark, docs, folder).collect()}
    if position == 0:
        rows = toxicity.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
        assert kept == {r["doc_id"] for r in rows if r["score"] < 0.5}
    else:
        bench = [_terms(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
        known = {}
        for item in bench:
            n = min(10, len(item))
            if n:
                known.setdefault(n, set()).update(tuple(item[i : i + n]) for i in range(len(item) - n + 1))
        clean = set()
        for r in docs.collect():
            have = _terms(r["text"])
            if not any(tuple(have[i : i + n]) in w for n, w in known.items() for i in range(len(have) - n + 1)):
                clean.add(r["doc_id"])
        assert kept == clean
