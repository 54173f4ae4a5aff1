"""What the line dedup works out once, and that its short cuts change no verdict."""

import random

from linkbook.llm import line_dedup


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_short_cuts_agree_with_the_edit_distance(spark):
    rng = random.Random(3)
    pairs, texts = [], []
    for i in range(120):
        a = [rng.choice("ab é") for _ in range(rng.choice([0, 3, 40, 150, 500]))]
        b = list(a)
        for _ in range(int(len(a) * rng.choice([0, 0.04, 0.09, 0.1, 0.11, 0.2]))):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        a, b = "".join(a), "".join(b) + rng.choice(["", "", "tail"])
        pairs.append((2 * i, 2 * i + 1))
        texts += [(2 * i, a), (2 * i + 1, b)]
    got = line_dedup._alike(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(texts, "id long, norm string"))
    norm = dict(texts)
    alike = {(a, b) for a, b in pairs if edit_distance(norm[a], norm[b]) <= max(len(norm[a]), len(norm[b])) // 10}
    assert {tuple(r) for r in got.collect()} == alike and 0 < len(alike) < len(pairs)


def test_only_wanted_lines_are_normalised(spark):
    rows = spark.createDataFrame([(1, "A b\nc  D\nc  D")], "row long, text string")
    wanted = line_dedup._lines(rows.selectExpr("row", "row doc_id", "text")).where("at = 1").selectExpr("at id", "raw", "k1", "k2")
    found = line_dedup._wordings(rows, wanted.localCheckpoint())
    plan = found._jdf.queryExecution().executedPlan().toString()
    # As equalities the hashes of the normalised line would be keys of the join, worked out for every line.
    assert not [line for line in plan.splitlines() if "Join [" in line and "xxhash64" in line]
    assert [tuple(r) for r in found.collect()] == [(1, "c d")]
