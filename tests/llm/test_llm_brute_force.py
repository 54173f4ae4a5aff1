"""Operators without a statement, against plain Python over small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkbook.llm import common, jaccard_join, license_scan, line_dedup, lm_scoring, quality, substring_dedup, toxicity

FOLDER = "/root/testdata/sf0.001"


def _lower(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = [make(rng.randint(3, 160)) for _ in range(150)]
    base = make(200)
    for _ in range(40):  # a family of near copies, some of them more than a few words apart
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(copy)
    passage = make(70)  # shared by texts that are otherwise unlike
    out += [make(40) + passage + make(60) for _ in range(25)]
    out += [list(out[3]), list(out[3]), [w.upper() for w in out[5]], [], ["a"], ["a"], ["a", "b"]]
    rng.shuffle(out)
    return {i: "\n".join(" ".join(t[k : k + 12]) for k in range(0, len(t), 12)) for i, t in enumerate(out)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").repartition(3)


def _shingles(text):
    words = _lower(text).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_join(docs, texts):
    sets = {i: _shingles(t) for i, t in texts.items()}
    links, group = Counter(), {i: i for i in texts}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            same = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and same >= 0.8 * (len(sets[a]) + len(sets[b]) - same) - 1e-9:
                links.update((a, b))
                group[max(root(a), root(b))] = min(root(a), root(b))
    rows = jaccard_join.join(docs).collect()
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in rows} == {i: (links[i], root(i)) for i in texts}
    sizes = Counter(root(i) for i in texts)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in rows)
    kept = {r["doc_id"] for r in jaccard_join.one_per_class(docs).collect()}
    assert kept == set(sizes)


def test_join_counts_links_across_blocks(docs, monkeypatch):
    whole = {r["doc_id"]: r["n_links"] for r in jaccard_join.join(docs).collect()}
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 1500)
    assert {r["doc_id"]: r["n_links"] for r in jaccard_join.join(docs).collect()} == whole


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = jaccard_join.bands_for(threshold, 0.999, 320)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 320


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    expected = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in expected:
                expected[x] = start
                stack += near[x]
    found = common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    loops = {a for a in near if near[a] == {a}}
    assert {r["node"]: r["group"] for r in found} == {k: v for k, v in expected.items() if k not in loops}
    assert common.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_windows(docs, texts):
    words = {i: t.encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), i)
    for r in substring_dedup.dedup(docs).collect():
        own, gone = words[r["doc_id"]], set()
        for p in range(len(own) - 49):
            if first[tuple(own[p : p + 50])] < r["doc_id"]:
                gone.update(range(p, p + 50))
        kept = b" ".join(w for k, w in enumerate(own) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(own), len(gone), hashlib.sha256(kept).hexdigest())
    levels = substring_dedup.levels()
    assert levels[-1] == 50 and all(b <= 2 * a for a, b in zip(levels, levels[1:], strict=False))


def test_language_model(docs, texts):
    tokens = lambda t: [*_lower(t).split(), None]
    learnt = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    one, two, three = Counter(), Counter(), Counter()
    for i in learnt:
        one.update(tokens(texts[i]))
    n, z = sum(one.values()), sum(one.values()) + 0.1 * (len(one) + 1)
    least = max(2, 1e-6 * n)
    numbered = {w for w, c in one.items() if c >= least} | {"<s>"}
    for i in learnt:
        s = ["<s>", *tokens(texts[i])]
        two.update(x for x in zip(s, s[1:], strict=False) if numbered.issuperset(x))
        three.update(x for x in zip(s, s[1:], s[2:], strict=False) if numbered.issuperset(x))
    two, three = ({k: c for k, c in x.items() if c >= least} for x in (two, three))
    history = {**one, "<s>": len(learnt)}
    p1 = lambda w: (one.get(w, 0) + 0.1) / z
    kept, below = defaultdict(float), defaultdict(float)
    for (a, b), c in two.items():
        kept[a] += (c - 0.75) / history[a]
        below[a] += p1(b)
    back = lambda h: max(1 - kept[h], 1e-12) / max(1 - below[h], 1e-12) if h in kept else 1
    p2 = lambda a, b: (two[a, b] - 0.75) / history[a] if (a, b) in two else back(a) * p1(b)
    for (a, b, w), c in three.items():
        kept[a, b] += (c - 0.75) / two[a, b]
        below[a, b] += p2(b, w)
    p3 = lambda a, b, w: (three[a, b, w] - 0.75) / two[a, b] if (a, b, w) in three else back((a, b)) * p2(b, w)
    for a in ["<s>", *list(one)[:5]]:  # a history's probabilities, with one unknown word, sum to 1
        assert math.isclose(sum(p2(a, w) for w in [*one, "unknown"]), 1, rel_tol=1e-9)
    few = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm_scoring.score(docs, table_words=300).collect()}
    for r in lm_scoring.score(docs).collect():
        assert few[r["doc_id"]] == (r["n_known"], round(r["base_score"], 6))
        s = ["<s>", *tokens(texts[r["doc_id"]])]
        score = math.log10(p2(s[0], s[1])) + sum(math.log10(p3(*s[i - 2 : i + 1])) for i in range(2, len(s)))
        base = sum(math.log10(p1(w)) for w in s[1:])
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(s) - 1, n, sum(w in one for w in s[1:]))
        assert math.isclose(r["score"], score, rel_tol=1e-9) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


def test_frequent_grams_survive_small_chunks(docs, monkeypatch):
    """Many small chunks lose no n-gram: the same scores at a share that prunes."""
    whole = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, share=4e-4).collect()}
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 2500)
    cut = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, share=4e-4).collect()}
    assert all(math.isclose(whole[i], cut[i], rel_tol=1e-12) for i in whole)


def test_grams_outside_the_automaton_count_fully(docs):
    """What the automaton leaves out, by its share or its table of words, is joined: the scores do not change."""
    whole = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs).collect()}
    for r in lm_scoring.score(docs, share=4e-3, table_words=50).collect():
        assert math.isclose(r["score"], whole[r["doc_id"]], rel_tol=1e-9)


def test_quality_counts_and_outliers(spark, docs, texts):
    rng = random.Random(3)
    junk = {1000 + i: " ".join(w + "$$$" for w in rng.choices(texts[1].split() + ["odd", "word"], k=90)) for i in range(6)}
    junk[1100] = "same words again " * 30
    both = {**texts, **junk}
    rows = quality.judge(spark.createDataFrame([(i, t, "en", "s") for i, t in both.items()], docs.schema)).collect()
    for r in rows:
        t = both[r["doc_id"]]
        w = t.split()
        runs = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + k for i in range(len(w) - 2) for k in range(3) if runs[tuple(w[i : i + 3])] > 1}
        lines = [x for x in t.split("\n") if x.split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"] and r["doc_id"] < 1000)


def test_quality_judges_small_groups(spark, texts):
    """Groups under MIN_ROWS are judged by their language, languages under it by all documents."""
    rng = random.Random(4)
    words = texts[1].split() + ["odd", "word", "more"]
    make = lambda mark: " ".join(w + mark for w in rng.choices(words, k=90))
    rows = [(i, make(""), "en", f"s{i % 3}" if i < 60 else "big") for i in range(130)] + [(i, make(""), "fr", None) for i in range(200, 210)]
    junk = [(1000 + i, make("$$$"), "en", f"s{i}") for i in range(3)] + [(1010, make("$$$"), "fr", None), (1011, make("$$$"), None, "lone")]
    out = quality.judge(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")).collect()
    judged = [r for r in out if not r["base_failed"]]
    assert len(judged) > 100 and all(r["distance"] is not None for r in judged)
    assert all(r["kept"] == (r["doc_id"] < 1000) for r in judged) and {r["doc_id"] for r in judged} >= {j[0] for j in junk}


def _mcd_distances(z, core, factor, rng):
    """Distances by the least determinant of concentration steps from many random starts; the identity is added."""
    best = None
    for _ in range(100):
        chosen = rng.choice(len(z), 8, replace=False)
        for _ in range(50):
            c = factor * np.cov(z[chosen].T, bias=True) + np.eye(z.shape[1])
            y = z - z[chosen].mean(axis=0)
            d2 = np.einsum("ij,jk,ik->i", y, np.linalg.inv(c), y)
            nearest = np.argsort(d2, kind="stable")[: math.ceil(core * len(z))]
            if set(nearest) == set(chosen):
                break
            chosen = nearest
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], np.sqrt(d2)
    return best[1]


def test_quality_graded_faults(spark):
    """Single faults of 10, 20 and 40 %, against a brute-force estimate of the same statistics."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    rows = [(i, " ".join(text(rng.randint(150, 250)))) for i in range(150)]
    for k, share in enumerate((0.1, 0.2, 0.4)):
        run = text(round(100 * share))
        rows.append((1000 + k, " ".join(run + text(200 - 2 * len(run)) + run)))
        rows.append((1010 + k, " ".join(w + ("#" if i < 200 * share else "") for i, w in enumerate(text(200)))))
        lines = [" ".join(text(5)) for _ in range(40)]
        rows.append((1020 + k, "\n".join(lines + [" ".join(text(1))] * round(40 * share))))
    judged = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")).collect()}
    n = np.array([judged[i]["n_words"] for i, _ in rows], float)
    column = lambda c: np.array([judged[i][c] for i, _ in rows], float)
    stats = {
        "log_words": np.log1p(n), "word_length": np.log(column("word_chars") / n), "symbols": np.log1p(100 * column("n_symbols") / n),
        "dup_lines": np.log1p(column("n_dup_lines")), "repeats": np.arcsin(np.sqrt(column("n_repeat_words") / n)),
    }
    spread = {k: np.full(len(n), v) for k, v in quality.FLOORS.items()}
    spread["word_length"] = np.sqrt(quality.FLOORS["word_length"] ** 2 + quality.WORD_LENGTH_CV**2 / n)
    z = np.column_stack([(v - np.median(v)) / spread[k] for k, v in stats.items()])
    factor = quality.CORE / quality._chi2_cdf(quality._chi2_quantile(quality.CORE, 5), 7)
    distances = dict(zip([i for i, _ in rows], _mcd_distances(z, quality.CORE, factor, np.random.default_rng(1)), strict=True))
    limit = math.sqrt(quality._chi2_quantile(0.999, 5))
    clear = {i for i, d in distances.items() if abs(d - limit) > 0.1 * limit}
    assert all(judged[i]["kept"] == (distances[i] <= limit) for i in clear) and len(clear) > 140
    assert not any(judged[i]["kept"] for i in (1001, 1002, 1010, 1011, 1012, 1021, 1022))
    assert sum(judged[i]["kept"] for i in range(150)) >= 147


def test_chi_square():
    assert math.isclose(quality._chi2_cdf(3.0, 2), 1 - math.exp(-1.5), rel_tol=1e-12)
    assert math.isclose(quality._chi2_cdf(quality._chi2_quantile(0.75, 5), 5), 0.75, rel_tol=1e-9)


def test_lines(docs, texts, spark):
    seen, first, removed = set(), {}, defaultdict(list)
    for i in sorted(texts):
        for p, line in enumerate(texts[i].split("\n")):
            key = " ".join(line.lower().split())
            if key and key in seen:
                removed[i].append(p)
            elif key:
                seen.add(key)
                first[i, p] = key
    rows = {r["doc_id"]: r for r in line_dedup.duplicate_lines(docs).collect()}
    near = Counter()
    for i, r in rows.items():
        assert set(removed[i]) <= set(r["removed"])  # all exact repeats go
        near["extra"] += len(set(r["removed"]) - set(removed[i]))
        assert r["n_lines"] == sum(bool(x.split()) for x in texts[i].split("\n")) and r["n_removed"] == len(r["removed"])
    line = " ".join(f"distinctive{i} wording{i}" for i in range(30))
    planted = [(1, f"{line}\nfirst"), (2, f"second\n{line[:-1]}"), (3, line.replace("wording7", "wordjng7")), (4, line.upper() + "\n \nlast"), (5, line)]
    out = line_dedup.without_duplicate_lines(spark.createDataFrame(planted, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == [(1, f"{line}\nfirst"), (2, "second"), (4, " \nlast")]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).collect()
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [(marks[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert sum(a == 1 and b == 0 for b, a in held) <= 0.05 * len(held)


def test_licenses(spark):
    lines = {
        "Released under the MIT License.": "MIT",
        "this work is licensed under the GNU General Public License, version 3": "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "Licensed under CC BY-NC 4.0. All rights reserved.": "CC-BY-NC-4.0,all-rights-reserved",
        "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
        "Licensed under the Apache License, Version 3.0.": "",
        "My driving license was renewed.": "",
        "word " * 300 + "Licensed under the Apache License, Version 2.0. " + "word " * 300: "Apache-2.0",
    }
    docs = spark.createDataFrame([(i, f"text before\n{t}\ntext after") for i, t in enumerate(lines)], "doc_id long, text string")
    assert [r["licenses"] for r in license_scan.scan(docs).orderBy("doc_id").collect()] == list(lines.values())


def test_licenses_in_prose_and_over_lines(spark, texts):
    """Notices inside sentences and wrapped over lines, against a search of every wording word by word."""
    rng = random.Random(8)
    prose = [w for i in sorted(texts) for w in texts[i].split()]
    wordings = [(n, t) for kind in (license_scan.TEMPLATES, license_scan.OPENINGS) for n, ts in kind.items() for t in ts]
    spell = lambda t: [w.lower().strip("#.,;:()") for w in t.split() if w.strip("#.,;:()")]
    rows, expected = [], []
    for k, (_, wording) in enumerate(wordings * 3):
        words = rng.choices(prose, k=rng.choice([0, 6, 25, 90])) + wording.split() + rng.choices(prose, k=rng.choice([0, 6, 25, 90]))
        gaps = [("\n# " if k % 2 else "\n") if rng.random() < 0.2 else " " for _ in words]
        text = "".join(w + g for w, g in zip(words, gaps, strict=True))
        found = {n for n, t in wordings if f" {' '.join(spell(t))} " in f" {' '.join(spell(text))} "}
        assert found
        if "BSD" in found:
            found = (found - {"BSD"}) | ({"BSD-2-Clause"} if "BSD-3-Clause" not in found else set())
        rows.append((k, text))
        expected.append(",".join(sorted(found)))
    long = "Licensed under the Apache License, Version 2.0 (the License); you may never use this file except in compliance with the License."
    rows += [(1000, " ".join(prose[:30]) + " " + long.replace(" ", "\n * ")), (1001, "All rights\nreserved."), (1002, "All wrongs\nreserved. Rights reserved.")]
    expected += ["Apache-2.0", "all-rights-reserved", ""]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in out] == expected


def test_long_lines_may_differ_by_a_tenth(spark):
    """A long line without its last twentieth is alike, without its last fifth it is not."""
    line = " ".join(f"distinctive{i % 50:02d}" for i in range(857))
    assert len(line) > 11_900
    rows = [(1, line), (2, line[: -700 + 14 * 7]), (3, line[: int(0.8 * len(line))])]
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == 0 and out[2] == 1
    pair = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    texts = spark.createDataFrame(rows, "id long, norm string")
    assert [tuple(r) for r in line_dedup._alike(pair, texts).collect()] == [(1, 2)]


def test_rare_ngrams_are_counted_in_small_chunks(monkeypatch):
    """A task holds few tokens at once, and chunks add up to the same counts."""
    import numpy as np
    import pyarrow as pa

    from linkbook.llm import lm_scoring

    none = np.zeros(0, np.int64)
    table = lm_scoring.Table(none.astype(np.uint64), none, none, 0, 0)
    texts = [" ".join(f"w{(i * k) % 7}" for i in range(60)) for k in range(1, 9)]
    batches = [pa.RecordBatch.from_pydict({"text": [t]}) for t in texts]

    def counts(most):
        monkeypatch.setattr(lm_scoring, "REST_TOKENS", most)
        chunks = list(lm_scoring._count_rest(table, (none, none))(iter(batches)))
        total = {}
        for chunk in chunks:
            for row in chunk.to_pylist():
                key = (row["u"], row["v"], row["w"])
                total[key] = total.get(key, 0) + row["n"]
        return len(chunks), total

    few, whole = counts(10_000)
    many, parts = counts(50)
    assert (few, many) == (2, 2 * len(texts)) and parts == whole and sum(whole.values()) > 900
