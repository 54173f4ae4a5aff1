"""Buckets of many texts that are similar to some, not all, of each other."""

import random

import pytest
from pyspark.sql import functions as F

from linkbook.llm import jaccard_join


@pytest.fixture(scope="module")
def near(spark):
    """Copies of one text with some words changed each, about as far apart as the threshold."""
    rng = random.Random(5)
    base = [f"word{i}" for i in range(300)]
    rows = []
    for d in range(150):
        text = list(base)
        for _ in range(rng.randint(3, 9)):
            text[rng.randrange(300)] = f"new{rng.randrange(10**9)}"
        rows.append((d, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).cache()


def shingle_sets(docs):
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    return {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in texts.items()}


def test_a_crowded_bucket_is_not_listed_as_pairs(near, monkeypatch):
    looked_up = []
    similar = jaccard_join._similar

    def counting(pairs, sets, threshold):
        looked_up.append(pairs.count())
        return similar(pairs, sets, threshold)

    monkeypatch.setattr(jaccard_join, "_similar", counting)
    monkeypatch.setattr(jaccard_join, "CROWD", 1)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(near).collect()}
    stars, more = looked_up
    bands = jaccard_join.bands_for()[0]
    assert stars <= 150 * bands and more == 0
    sets = shingle_sets(near)
    for d, own in sets.items():
        alike = [e for e, other in sets.items() if e != d and len(own & other) >= 0.8 * len(own | other) - 1e-9]
        assert got[d][1] == len(alike)
        assert all(got[e][0] == got[d][0] for e in alike)


@pytest.mark.parametrize("blocks", [400_000, 4_000])
def test_blocks_find_the_same_classes_as_pairs(near, monkeypatch, blocks):
    few = near.where(F.col("doc_id") < 60)
    plain = sorted(map(tuple, jaccard_join.join(few).collect()))
    monkeypatch.setattr(jaccard_join, "CROWD", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", blocks)
    assert sorted(map(tuple, jaccard_join.join(few).collect())) == plain
