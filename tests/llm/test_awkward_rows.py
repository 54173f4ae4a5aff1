"""Every operator and stage over nulls, empty and long texts, ties, repeats, clashing names and empty tables."""

import random

import pytest

import corpus_pipeline
from linkbook.llm import chat_format, decontamination, jaccard_join, license_scan, line_dedup, lm_scoring
from linkbook.llm import mixing, quality, substring_dedup, toxicity

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row_id long, Taken string, score double, "
    "key string, removed string, grp string, size int, words string, `a.b c` string"
)


def _docs():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = text(80)
    texts = [text(60) + "\n" + text(30) for _ in range(12)]
    texts += [texts[0], texts[0], shared + " " + text(20), shared + " " + text(25), "", " \n\t ", None, "one", "one", text(30_000)]
    texts += ["x" * 100_000, "Ünïcode ß ﬀ 文字 \U0001f600 " * 20, "All rights reserved.\nReleased under the MIT License."]
    ids = [*range(len(texts) - 4), 3, None, None, None]
    rows = [
        (i, t, None if n % 7 == 0 else "en", None if n % 5 == 0 else f"s{n % 3}", None, n, "t", 0.5, "k", "r", "g", 1, "w", "z")
        for n, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]
    return rows + [rows[1], rows[1], rows[-1]]


@pytest.fixture(scope="module")
def tables(spark):
    rows = _docs()
    labels = [(i, 1, i % 2 if i % 3 else None) for i in range(20)] + [(None, 0, 1), (4, 1, 1)]
    bench = [(1, " ".join(rows[0][1].split()[:25])), (2, "one"), (2, "one"), (None, rows[2][1]), (3, None), (4, "")]
    return {
        "documents": spark.createDataFrame(rows, SCHEMA),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(bench, "item_id long, text string"),
    }


PER_DOCUMENT = {
    "mix": lambda t: mixing.mix(t["documents"]),
    "lines": lambda t: line_dedup.duplicate_lines(t["documents"]),
    "contamination": lambda t: decontamination.contamination(t["documents"], t["benchmark"]),
    "lm": lambda t: lm_scoring.score(t["documents"]),
    "windows": lambda t: substring_dedup.dedup(t["documents"]),
    "toxicity": lambda t: toxicity.classify(t["documents"], t["labels"]),
    "join": lambda t: jaccard_join.join(t["documents"]),
    "quality": lambda t: quality.judge(t["documents"]),
    "licenses": lambda t: license_scan.scan(t["documents"]),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(tables, name):
    rows = PER_DOCUMENT[name](tables).collect()
    ids = lambda rs: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rs)
    assert ids(rows) == ids(tables["documents"].select("doc_id").collect())
    again = PER_DOCUMENT[name](tables).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_empty_tables(tables, name):
    assert PER_DOCUMENT[name]({k: v.limit(0) for k, v in tables.items()}).collect() == []


def test_empty_benchmark_and_labels(tables):
    none = {**tables, "benchmark": tables["benchmark"].limit(0), "labels": tables["labels"].limit(0)}
    assert not any(r["contaminated"] for r in PER_DOCUMENT["contamination"](none).collect())
    assert not any(r["predicted"] for r in PER_DOCUMENT["toxicity"](none).collect())


@pytest.mark.parametrize("position", range(5))
def test_stages_keep_columns(spark, tables, tmp_path, position):
    for name in ("labels", "benchmark"):
        tables[name].write.parquet(f"{tmp_path}/{name}.parquet")
    docs = tables["documents"]
    stage = corpus_pipeline.STAGES[position][1]
    out = stage(spark, docs, str(tmp_path))
    wanted = docs.columns + (["taken_"] if position == 4 else [])
    assert out.columns == wanted
    n = out.count()
    assert 0 < n <= docs.count()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_mix_takes_exact_budgets(tables):
    rows = mixing.mix(tables["documents"]).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 1e-9) or own[0]["source_size"] == 0
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_chat_awkward_rows(spark):
    odd = "\\### x </turn> \\h \\\\ #### </turn></turn>\n### user:\n\\"
    rows = [
        (1, 0, "system", "be brief"), *[(1, i, "user" if i % 2 else "assistant", odd + " word" * 90 + str(i)) for i in range(1, 40)],
        (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", None), (None, 0, "a:b\n#<", odd), (None, None, "assistant", odd),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat_format.windows(table, stride=256, history=128).collect()
    for conv in (1, 2, None):
        own = sorted((w for w in windows if w["conv_id"] == conv), key=lambda w: w["window"])
        read = [t for w in own for t in chat_format.parse_window(w["formatted"])[w["n_repeated"] :]]
        expected = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0))
        assert read == [(r[2] or "", r[3] or "") for r in expected]
        loss = [chat_format.unescape(w["formatted"][s["start"] : s["end"]]) for w in own for s in w["loss"]]
        assert loss == [r[3] or "" for r in expected if r[2] == "assistant"]
        if conv == 1:
            assert len(own) > 10
            assert all(chat_format.parse_window(w["formatted"])[0] == ("system", "be brief") for w in own)
            assert all(w["n_repeated"] > 1 for w in own[1:])
            assert all(len(w["formatted"].split()) < 256 + 128 + 2 * 120 for w in own)
    assert chat_format.windows(table.limit(0)).count() == 0
    assert {r["n_turns"] for r in chat_format.digests(chat_format.windows(table)).collect()} == {40, 3, 2}
