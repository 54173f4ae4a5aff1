"""Structure repair, prefix trie and secret scans against plain Python."""

import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import random
import re
import zlib
from collections import defaultdict

import pytest
import zstandard

from linkbook.llm import prefix_trie, secret_scan, structure_repair

SCHEMA = "conv_id long, turn long, role string, text string, at string, conv string, node string, depth string"
LEGAL = re.compile(r"(s?(ua)+)?")


# -- structure repair -------------------------------------------------------------------------


def _order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))


def _graded(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = (text or "").strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role or "", text or "") in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role or "", text or ""))
        out.append((role or "", text or "", fault))
    return out


def _cheapest(rows):
    """(cost, audit, turns left) over all states, with whole audits as strings."""
    states = {"": (0, "", ())}  # by what stands: nothing, s, u or a

    def inserts(state, best):
        cost, audit, made = best
        for _ in range(4):
            yield state, (cost, audit, made)
            state = "a" if state == "u" else "u"
            cost, audit, made = cost + 3, audit + "I", (*made, ("user" if state == "u" else "assistant", ""))

    for role, text, fault in rows:
        new = {}
        for state, best in states.items():
            for s, (cost, audit, made) in inserts(state, best):
                ways = [(s, cost + 4, audit + "D", made)]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    if (s, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                        ways.append((role[:1], cost + more, audit + "K", (*made, (role, text))))
                    to = "a" if s == "u" else "u"
                    ways.append((to, cost + more + 3, audit + "R", (*made, ("user" if to == "u" else "assistant", text))))
                for to, *value in ways:
                    new[to] = min(new.get(to, (1 << 60,)), tuple(value))
        states = new
    return min(way for state, best in states.items() for s, way in inserts(state, best) if s in ("", "a"))


def _conversations(seed, n):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["Yes.", "No!", "why", "", " \n", "Maybe?", f"Text {rng.randint(0, 9)}.", f"cut {turn}"])
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["system", "user", "assistant", "tool", "user", "assistant"]), text))
    return rows


@pytest.mark.parametrize(("block", "fan"), [(2048, 64), (3, 2)])
def test_repair_is_cheapest(spark, monkeypatch, block, fan):
    monkeypatch.setattr(structure_repair, "BLOCK_ROWS", block)
    monkeypatch.setattr(structure_repair, "FAN", fan)
    rows = _conversations(3, 60)
    rng = random.Random(4)
    # A conversation over many blocks and levels, and awkward ones.
    rows += [(1000, i, rng.choice(["user", "assistant", "user", "tool"]), rng.choice(["Ok.", "cut", "", f"Turn {i}."])) for i in range(150)]
    rows += [(None, None, None, None), (None, 1, "user", "Null id."), (1001, 5, None, "No role."), (1002, 1, "user", None)]
    rows += [(1003, 2, "user", "x" * 200_000 + "."), (1003, 2, "user", "x" * 200_000 + ".")]
    table = spark.createDataFrame([(*r, "x", "y", "z", "d") for r in rows], SCHEMA)
    ids = table.select("conv_id").union(spark.createDataFrame([(7777,)], "conv_id long"))
    got = {r["conv_id"]: r for r in structure_repair.report(ids, table).collect()}
    assert set(got) == {r[0] for r in rows} | {7777}
    empty = hashlib.sha256().hexdigest()
    assert tuple(got[7777])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    for conv in set(got) - {7777}:
        own = _order([r for r in rows if r[0] == conv])
        graded = _graded(own)
        cost, audit, left = _cheapest(graded)
        turns = [r[1] for r in own if r[1] is not None]
        roles = [g[0][:1] for g in graded]
        row = got[conv]
        assert (row["cost"], row["audit"]) == (cost, audit)
        assert LEGAL.fullmatch("".join(role[:1] for role, _ in left))
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in left).encode()).hexdigest()
        assert row["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert row["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
        for fault in ("blank", "duplicate", "truncated"):
            assert row[fault] == sum(g[2] == fault for g in graded)


def test_repaired_turns(spark):
    table = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "cut")], "conv_id long, turn long, role string, text string")
    rows = sorted(structure_repair.repair(table).collect(), key=lambda r: r["at"])
    assert [r["edits"] for r in rows] == ["K", "IK", "D"]
    assert [(t["role"], t["text"]) for r in rows for t in r["turns"]] == [("system", "Be kind."), ("user", ""), ("assistant", "Hello.")]
    assert structure_repair.repair(table.limit(0)).count() == 0
    assert structure_repair.report(table.limit(0), table.limit(0)).count() == 0


def test_crossings_of_long_stretches():
    rng = random.Random(8)
    for n in (1, 2, 17, 400):
        codes = "".join(rng.choice(structure_repair.CODES) for _ in range(n))
        table = structure_repair.block_table(codes)
        cost, end = structure_repair.ending(table)
        audit = "".join(e for _, e in structure_repair.block_edits(codes, 0, end)) + structure_repair.TAIL[end]
        faults = {"x": "blank"}
        names = {"s": "system", "u": "user", "a": "assistant"}
        rows = [(names.get(c.lower(), "other"), "", faults.get(c, "truncated" if c.isupper() else None)) for c in codes]
        assert (cost, audit) == _cheapest(rows)[:2]


# -- prefix trie ------------------------------------------------------------------------------


def _trie(rows):
    convs = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            convs[r[0]].append(r)
    turns = {c: [(r[2] or "", r[3] or "") for r in _order(own)] for c, own in convs.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    nodes = defaultdict(list)
    for c, sequence in rebuilt.items():
        for d in range(len(sequence) + 1):
            nodes[tuple(sequence[:d])].append(c)
    out = set()
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes)]
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(node))
        out.add((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(n) == len(node) + 1 for n in below),
            len(childless), sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def _trie_rows(n):
    rng, rows = random.Random(12), []
    for conv in [*range(n), 305, 409]:
        common = conv % 3 == 0
        for turn in range(3 if common else rng.randint(1, 8)):
            rows.append((conv, rng.choice([turn, None]) if conv == 305 else turn, "user" if turn % 2 == 0 else None, f"shared {turn}" if common else rng.choice(["a", "bé", None, "ccc"])))
    return rows + [(None, 1, "user", "no conversation"), (410, 0, "user", "y" * 100_000), (411, 0, "user", "")]


@pytest.mark.parametrize("piece", [4096, 3])
def test_trie(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", piece)
    rows = _trie_rows(230)
    table = spark.createDataFrame([(*r, "x", "y", "z", "d") for r in rows], SCHEMA).repartition(5)
    out = prefix_trie.trie(*prefix_trie.rebuilt(*prefix_trie.turns(table)))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    assert set(got) == _trie(rows)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(*prefix_trie.rebuilt(*prefix_trie.turns(table))).count() == 0


# -- secret scans -----------------------------------------------------------------------------


def _base(text):
    """The contract's base spans by a scan of its own, position by position."""
    found = []
    for kind, pattern, group, least in (
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ):
        at, compiled = 0, re.compile(pattern)
        while at < len(text):
            m = compiled.match(text, at)
            if m:
                if len(m[group]) >= least:
                    found.append((m.start(), ("assign", "access", "hex").index(kind), m.end()))
                at = m.end()
            else:
                at += 1
    return [("assign", "access", "hex")[k] + f":{a}:{b}" for a, k, b in sorted(found)]


WAYS = {
    "url": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(),
    "zstd": lambda s: base64.b64encode(zstandard.compress(s.encode())).decode(),
    "bz2": lambda s: base64.b64encode(bz2.compress(s.encode())).decode(),
    "xz": lambda s: base64.b64encode(lzma.compress(s.encode())).decode(),
    "utf16": lambda s: base64.b64encode(s.encode("utf-16-le")).decode(),
    "escaped bytes": lambda s: "".join(f"\\x{b:02x}" for b in gzip.compress(s.encode())),
}
SECRET = "AKIA" + "QWERTY0123456789ZZ"


@pytest.mark.parametrize("outer", WAYS)
@pytest.mark.parametrize("inner", [None, *WAYS])
def test_nested_encodings(outer, inner):
    hidden = f"it is {SECRET} you know"
    coded = WAYS[outer](WAYS[inner](hidden) if inner else hidden)
    text = f"Ünïcode 文字 before {coded} after"
    findings, layers, left = secret_scan.scan_text(text)
    start = text.index(coded)
    access = [f for f in findings if f[0] == "access"]
    assert access and not left and layers >= 1
    assert all(start <= a < b <= start + len(coded) and path for _, a, b, path in access)
    if inner is None and outer in ("url", "unicode", "base64", "utf16"):
        ((_, a, b, _),) = access
        piece = text[a:b]
        if outer in ("url", "unicode"):
            assert piece == WAYS[outer](SECRET)
        else:  # the digits of a stretch, up to those that it shares with its neighbours
            assert len(piece) <= len(SECRET) * (2 if outer == "utf16" else 1) * 4 / 3 + 3


def test_many_levels_and_cycles():
    text = f"token: {SECRET}"
    for _ in range(9):
        text = WAYS["base64"](text)
    findings, layers, _ = secret_scan.scan_text(text)
    assert layers >= 9 and {f[0] for f in findings if f[3].count("base64") >= 9} == {"assign", "access"}
    root = secret_scan.Layer("a")
    child = secret_scan.Layer("b", ">url", root, lambda a, b: (a, b))
    assert secret_scan.Layer("a", ">url>url", child, lambda a, b: (a, b)).is_cycle()
    assert not child.is_cycle()
    both = secret_scan.scan_text("%41%42 \\u0043 \\u0025%32%35 done")  # escapes of two kinds, in either order
    assert both[1] < 10


def test_wrapped_base64_and_large_layers(monkeypatch):
    wrapped = base64.encodebytes(f"{'word ' * 40}{SECRET} end".encode()).decode()
    ((kind, a, b, path),) = secret_scan.scan_text("begin\n" + wrapped)[0]
    assert (kind, path) == ("access", "base64") and 0 < b - a < 40
    monkeypatch.setattr(secret_scan, "LAYER_BYTES", 1000)
    findings, _, left = secret_scan.scan_text(WAYS["gzip"]("word " * 1000 + SECRET))
    assert left == 1 and not findings


def test_spans_of_documents(spark):
    rng = random.Random(2)
    pieces = ["token = \"", "Password:'", "api_key=", "apikey :  ", "passwd", "secret=", "abcdef0123456789" * 2, "AKIA", "ABCD1234" * 2, "AKIA" + "X" * 17, " ", "\n", "x^y", "ſecret=abcdefg", "toKen=longenough", "100%ab", "é文"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    texts += [None, "", "a" * 300_000, "x^" * 20_000, "token=" + "b" * 100_000]
    rows = [(None if i % 50 == 7 else i, t, "p", "q") for i, t in enumerate(texts)] + [(3, texts[3], "p", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, findings string, `a.b` string")
    got = {r["doc_id"]: r for r in secret_scan.scan(docs).collect() if r["doc_id"] is not None}
    assert secret_scan.scan(docs).count() == len(rows)
    for i, text, *_ in rows:
        if i is not None:
            base = [f"{f['kind']}:{f['start']}:{f['end']}" for f in got[i]["findings"] if not f["path"]]
            assert base == _base(text or "")
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_query_on_documents(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    rows = secret_scan.query(spark, folder).collect()
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(texts) == sorted(r["doc_id"] for r in rows)
    for r in rows:
        base = _base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r["spans"].split(",")) or not base
