"""Conversation structure repair: the cheapest edits that make a conversation's turns alternate.

Hirschberg's divide and conquer over four states (nothing yet, after a system turn, after a user
turn, after an assistant turn): a vector of costs runs forward to the middle of a stretch of rows
and one runs backward to it, the audit-least optimal crossing is chosen, and both halves are
solved on their own, in linear space. The same step works on whole blocks of rows: each block is
first summed up in a table of costs from state to state, the tables of a long conversation are
combined level by level, and crossings are handed down the levels to all blocks at once. No
conversation is gathered in one task; the digest streams over its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkbook.llm.common import running_totals
from linkbook.plans.staging import stage

INSERT_COST = REROLE_COST = TRUNCATED_COST = 3
DELETE_COST = 4
# Rows of a block, and nodes of a level that the next level combines.
BLOCK_ROWS, FAN = 2048, 64

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
UNREACHED = 1 << 60
# A row's code: x must go (blank or duplicate), else its role's initial, o for other roles; upper case if truncated.
MUST_GO, OTHER = "x", "o"
# Results that are remembered, of blocks of few rows: most conversations share few patterns.
MEMO, MEMO_ROWS = 1 << 15, 32


@dataclass(frozen=True)
class Table:
    """Costs from state to state over some rows, and the order of the least audits to the states.

    Audits up to a row are never prefixes of each other, so the order of two longer ones is that
    of the parts in which they differ first; ``rank`` is all that has to be remembered of them.
    """

    cost: tuple[tuple[int, ...], ...]
    rank: tuple[tuple[int, ...], ...]


def _inserted(state: int) -> int:
    """The state after inserting the only turn that may follow: a user turn, or its answer."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _ways(code: str, state: int) -> dict[int, tuple[int, str]]:
    """State -> cheapest (cost, edits) of a row, inserts before it included; three inserts never pay."""
    best: dict[int, tuple[int, str]] = {}
    cost, before = 0, ""
    for _ in range(3):
        ways = [(DELETE_COST, "D", state)]
        if code != MUST_GO:
            extra = TRUNCATED_COST * code.isupper()
            ways += [(extra, "K", _kept(state, code.lower())), (extra + REROLE_COST, "R", _inserted(state))]
        for more, letter, to in ways:
            if to is not None:
                best[to] = min(best.get(to, (UNREACHED, "")), (cost + more, before + letter))
        cost, before, state = cost + INSERT_COST, before + "I", _inserted(state)
    return best


CODES = MUST_GO + "suao" + "SUAO"
WAYS = {code: [_ways(code, state) for state in STATES] for code in CODES}
# Inserts that complete the pair after the last row; a lone system turn needs a whole pair.
TAIL = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
TAIL_COST = [INSERT_COST * len(TAIL[state]) for state in STATES]


def _row_table(code: str) -> Table:
    cost, rank = [], []
    for ways in WAYS[code]:
        order = sorted(STATES, key=lambda to: ways[to][1] if to in ways else "~")
        cost.append(tuple(ways[to][0] if to in ways else UNREACHED for to in STATES))
        rank.append(tuple(order.index(to) for to in STATES))
    return Table(tuple(cost), tuple(rank))


ROW_TABLES = {code: _row_table(code) for code in CODES}


def _forward(tables: Sequence[Table], start: int) -> tuple[list[int], list[int]]:
    """Costs of the states after the tables, and the order of their least audits."""
    cost, rank = [UNREACHED] * 4, [0, 1, 2, 3]
    cost[start] = 0
    for table in tables:
        ways = []
        for to in STATES:
            ways.append(min((min(cost[s] + table.cost[s][to], UNREACHED), rank[s], table.rank[s][to]) for s in STATES))
        order = sorted(STATES, key=lambda to: (ways[to][0] >= UNREACHED, ways[to][1:]))
        cost, rank = [w[0] for w in ways], [order.index(to) for to in STATES]
    return cost, rank


def _backward(tables: Sequence[Table], end: int) -> list[int]:
    """Costs from each state before the tables to ``end``."""
    cost = [UNREACHED] * 4
    cost[end] = 0
    for table in reversed(tables):
        cost = [min(UNREACHED, *(table.cost[s][to] + cost[to] for to in STATES)) for s in STATES]
    return cost


def combined(tables: Sequence[Table]) -> Table:
    """The table of some rows or blocks after each other."""
    each = [_forward(tables, start) for start in STATES]
    return Table(tuple(tuple(c) for c, _ in each), tuple(tuple(r) for _, r in each))


def crossings(tables: Sequence[Table], start: int, end: int) -> list[int]:
    """States before, between and after the tables on the audit-least cheapest way from ``start`` to ``end``."""
    states = [start] * len(tables) + [end]
    open_ = [(0, len(tables))]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        ahead, rank = _forward(tables[low:middle], states[low])
        behind = _backward(tables[middle:high], states[high])
        states[middle] = min(STATES, key=lambda s: (min(ahead[s] + behind[s], UNREACHED), rank[s]))
        open_ += [(low, middle), (middle, high)]
    return states


def ending(table: Table) -> tuple[int, int]:
    """(cost, last state) of the cheapest complete way from the start; ties by audit."""
    ways = [(table.cost[NOTHING][s] + TAIL_COST[s], table.rank[NOTHING][s], s) for s in STATES]
    cost, _, state = min(ways)
    return cost, state


def block_table(codes: str) -> Table:
    return combined([ROW_TABLES[c] for c in codes])


def block_edits(codes: str, start: int, end: int) -> tuple[tuple[int, str], ...]:
    """(state before, edits) of each row."""
    states = crossings([ROW_TABLES[c] for c in codes], start, end)
    return tuple((s, WAYS[c][s][to][1]) for c, s, to in zip(codes, states, states[1:], strict=False))


def _remembered(function):
    """``function`` with a memory for short codes; one is made for each task."""
    short = lru_cache(MEMO)(function)
    return lambda codes, *states: (short if len(codes) <= MEMO_ROWS else function)(codes, *states)


def _packed(table: Table) -> list[int]:
    return [x for part in (table.cost, table.rank) for row in part for x in row]


def _unpacked(values: list[int]) -> Table:
    rows = [tuple(values[i : i + 4]) for i in range(0, 32, 4)]
    return Table(tuple(rows[:4]), tuple(rows[4:]))


def _roles(state: int, n: int) -> tuple[list[str], int]:
    """Roles of ``n`` inserted turns, and the state after them."""
    roles = []
    for _ in range(n):
        state = _inserted(state)
        roles.append("assistant" if state == ASSISTANT else "user")
    return roles, state


def _batch(batch: pa.RecordBatch, keep: list[str], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns.values()], [*keep, *columns])


_INTS = pa.list_(pa.int64())


def _leaf_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table_of = _remembered(block_table)
    for batch in batches:
        tables = [_packed(table_of(c)) for c in batch.column("codes").to_pylist()]
        yield _batch(batch, ["conv", "block"], {"table": pa.array(tables, _INTS)})


def _node_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = [_packed(combined([_unpacked(t["table"]) for t in nodes])) for nodes in batch.column("nodes").to_pylist()]
        yield _batch(batch, ["conv", "block"], {"table": pa.array(tables, _INTS)})


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [ending(_unpacked(t)) for t in batch.column("table").to_pylist()]
        zero = pa.array([NOTHING] * len(ends), pa.int32())
        yield _batch(batch, ["conv", "block"], {
            "start": zero, "end": pa.array([s for _, s in ends], pa.int32()), "cost": pa.array([c for c, _ in ends], pa.int64()),
        })


def _child_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("block", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        out = []
        for row in batch.select(["nodes", "start", "end"]).to_pylist():
            states = crossings([_unpacked(t["table"]) for t in row["nodes"]], row["start"], row["end"])
            blocks = [t["block"] for t in row["nodes"]]
            out.append([{"block": b, "start": s, "end": e} for b, s, e in zip(blocks, states, states[1:], strict=False)])
        yield _batch(batch, ["conv"], {"children": pa.array(out, kind)})


def _row_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row: its edits, the roles inserted before it, its new role, and those inserted after the last row."""
    names, edits_of = ["conv", "at", "edits", "before", "new_role", "after"], _remembered(block_edits)
    for batch in batches:
        ids, out = [], []
        for i, row in enumerate(batch.select(["first_at", "codes", "start", "end", "last"]).to_pylist()):
            edits = edits_of(row["codes"], row["start"], row["end"])
            for k, (state, letters) in enumerate(edits):
                before, state = _roles(state, len(letters) - 1)
                new_role = _roles(state, 1)[0][0] if letters[-1] == "R" else None
                after = _roles(row["end"], len(TAIL[row["end"]]))[0] if row["last"] and k == len(edits) - 1 else []
                ids.append(i)
                out.append((row["first_at"] + k, letters + "I" * len(after), before, new_role, after))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
        arrays = [batch.column("conv").take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def placed(conversations: DataFrame) -> DataFrame:
    """Rows in order: conv_id, conv (numbers the conversations), at (in the table), place (in the conversation), turn, role, text, n (rows of the conversation).

    The place comes from sums over range-sorted rows, so a long conversation spreads over many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", F.col("turn").isNotNull().alias("has_turn"), "turn", role.alias("role"), text.alias("text"),
        F.md5(text.cast("binary")).alias("tie"), F.lit(1).cast("long").alias("one"),
    )
    numbered = stage(running_totals(rows, ["conv_id", "has_turn", "turn", "role", "tie"], {"at": "one"}, "repair-turns"), "repair-placed")
    convs = numbered.groupBy(F.col("conv_id").alias("of")).agg(F.min("at").alias("conv"), F.count("*").alias("n"))
    joined = numbered.join(convs, F.col("conv_id").eqNullSafe(F.col("of")))
    return joined.select("conv_id", "conv", "at", (F.col("at") - F.col("conv")).alias("place"), "turn", "role", "text", "n", "tie")


def faults(rows: DataFrame) -> DataFrame:
    """:func:`placed` rows with their first fault (blank, duplicate, truncated or null)."""
    # Copies are found by their digests; each is joined to the first of them by its place, so no key is hot.
    firsts = rows.groupBy("conv", "role", "tie").agg(F.min("at").alias("first_at")).select("first_at", F.lit(True).alias("is_first"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(F.col("is_first").isNull(), "duplicate").when(~whole, "truncated")
    return rows.join(firsts, F.col("at") == F.col("first_at"), "left").withColumn("fault", fault).drop("first_at", "is_first", "tie")


def _nodes(level: DataFrame) -> DataFrame:
    """The nodes of a level, ``FAN`` of a conversation in a row, in order."""
    return level.groupBy("conv", F.expr(f"block div {FAN}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("block", "table"))).alias("nodes")
    )


def edits(graded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, at, edits, before, new_role, after) of all rows of :func:`faults`, and (conv, cost)."""
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(MUST_GO)).otherwise(
        F.when(_initial(F.col("role")).isin("s", "u", "a"), _initial(F.col("role"))).otherwise(F.lit(OTHER))
    )
    code = F.when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    rows = graded.select("conv", "at", "place", "n", F.expr(f"place div {BLOCK_ROWS}").alias("block"), code.alias("code"))
    leaves = stage(
        rows.groupBy("conv", "block").agg(
            F.min("at").alias("first_at"),
            (F.max("place") + 1 == F.max("n")).alias("last"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes"),
        ),
        "repair-blocks",
    )
    levels = [stage(leaves.mapInArrow(_leaf_tables, "conv bigint, block bigint, table array<bigint>"), "repair-tables")]
    while levels[-1].where("block > 0").limit(1).count():
        levels.append(stage(_nodes(levels[-1]).mapInArrow(_node_tables, "conv bigint, block bigint, table array<bigint>"), "repair-tables"))
    top = levels.pop().mapInArrow(_endings, "conv bigint, block bigint, start int, end int, cost bigint")
    top = stage(top, "repair-ends")
    states = top.select("conv", "block", "start", "end")
    for level in reversed(levels):
        children = _nodes(level).join(states, ["conv", "block"]).select("conv", "nodes", "start", "end").mapInArrow(
            _child_states, "conv bigint, children array<struct<block: bigint, start: int, end: int>>"
        )
        states = stage(children.select("conv", F.inline("children")), "repair-states")
    solved = leaves.join(states, ["conv", "block"]).mapInArrow(
        _row_edits, "conv bigint, at bigint, edits string, before array<string>, new_role string, after array<string>"
    )
    return solved, top.select("conv", "cost")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per input row, in order of ``at``: conv_id, conv, at, turn, role, text, fault, edits, turns.

    ``edits`` holds the initials of the cheapest edits (Keep, Rerole, Delete, Insert) up to this
    row, for a conversation's last row also those after it; ``turns`` the (role, text) that they
    leave. Turns go by ``turn``, null first; equal ones by role, then by a digest of the text. A
    null role or text is an empty one, a null conv_id a conversation of its own. Rows that repeat
    are duplicates. Empty tables give no rows; further columns are not read.
    """
    return _repaired(stage(faults(placed(conversations)), "repair-faults"))[0]


def _repaired(graded: DataFrame) -> tuple[DataFrame, DataFrame]:
    solved, costs = edits(graded)
    made = lambda roles: F.transform(F.col(roles), lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(
        ~F.col("edits").contains("D"), F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))
    ).otherwise(F.array().cast("array<struct<role: string, text: string>>"))
    turns = F.concat(made("before"), own, made("after"))
    rows = graded.join(solved.drop("conv"), "at")
    return rows.select("conv_id", "conv", "at", "turn", "role", "text", "fault", "edits", turns.alias("turns")), costs


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of sorted rows, one conversation after the other; texts are not held."""
    now, audit, state, empty = None, [], None, True

    def done() -> pa.RecordBatch:
        columns = [pa.array([now], pa.int64()), pa.array(["".join(audit)]), pa.array([state.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, ["conv", "audit", "repaired_sha256"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv"] != now:
                if state is not None:
                    yield done()
                now, audit, state, empty = row["conv"], [], hashlib.sha256(), True
            audit.append(row["edits"])
            for turn in row["turns"]:
                state.update((b"" if empty else b"\n") + f"{turn['role']}:{turn['text']}".encode("utf-8", "surrogatepass"))
                empty = False
    if state is not None:
        yield done()


def report(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``ids``: the faults of ``rows``, the cheapest audit, and the digest of what it leaves.

    Conversations without rows have zeros, an empty audit and the digest of nothing. Cases as in :func:`repair`.
    """
    graded = stage(faults(placed(rows)), "repair-faults")
    repaired, costs = _repaired(graded)
    digests = repaired.select("conv", "at", "edits", "turns").repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(
        _digests, "conv bigint, audit string, repaired_sha256 string"
    )
    # Neighbours meet by their place in the table, which is unique.
    initials = graded.select("conv", "at", _initial(F.col("role")).alias("initial"))
    following = initials.select((F.col("at") - 1).alias("at"), F.col("conv").alias("conv_"), F.col("initial").alias("initial_"))
    pairs = initials.join(following, "at").where("conv = conv_")
    illegal = pairs.where(~F.concat("initial", "initial_").isin("su", "ua", "au")).groupBy("conv").agg(F.count("*").alias("illegal"))
    flags = {f: F.sum(F.when(F.col("fault") == f, 1).otherwise(0)) for f in ("blank", "duplicate", "truncated")}
    # Turns are folded first, so distinct ones are counted without gathering them.
    by_turn = graded.groupBy("conv", "turn").agg(F.first("conv_id").alias("conv_id"), *[s.alias(f) for f, s in flags.items()])
    stats = by_turn.groupBy("conv").agg(
        F.first("conv_id").alias("of"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(f).alias(f) for f in flags],
    )
    found = stats.join(costs, "conv").join(digests, "conv").join(illegal, "conv", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with seeded faults, by a checksum of ``conv_id:turn``; nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(case == 3, 2).otherwise(1)))
    return conversations.where(case != 0).select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), copies.alias("copy")
    ).drop("copy")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op11: repair of all conversations, damaged."""
    table = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return report(table, damaged(table))


SQL = r"""
WITH RECURSIVE
bits(t) AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1
  THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n::BIGINT))),
shown AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
cased AS (SELECT s.*, xor(list_reduce(list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) % 20 AS c FROM shown s, bits),
hurt AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
  CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM cased, (VALUES (1), (2)) v(copy) WHERE c <> 0 AND (copy = 1 OR c = 3)),
numbered AS (SELECT *, row_number() OVER w AS i, lead(left(role, 1)) OVER w AS next_initial, count(*) OVER (PARTITION BY conv_id) AS n
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM numbered),
kind AS (SELECT conv_id, i, n, role, text, fault IN ('blank', 'duplicate') AS must, left(role, 1) AS ini, 3 * (fault = 'truncated')::INT AS extra FROM r),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 'n' AS q, 0::BIGINT AS cost, '' AS audit, '' AS made FROM (SELECT DISTINCT conv_id FROM hurt)
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.audit, best.made FROM (
    SELECT w.conv_id, k.i, CASE e.edit WHEN 'D' THEN p.q WHEN 'K' THEN k.ini ELSE nxt END AS q, min({'cost': (w.cost + 3 * p.ins +
        CASE e.edit WHEN 'D' THEN 4 WHEN 'K' THEN k.extra ELSE 3 + k.extra END)::BIGINT, 'audit': w.audit || repeat('I', p.ins) || e.edit,
        'made': w.made || p.made || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || k.role || ':' || k.text
        ELSE chr(10) || CASE nxt WHEN 'u' THEN 'user:' ELSE 'assistant:' END || k.text END}) AS best
    FROM walk w JOIN kind k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.i = w.i + 1
    JOIN (VALUES ('n', 'n', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''),
      ('n', 'u', 1, chr(10) || 'user:'), ('s', 'u', 1, chr(10) || 'user:'), ('a', 'u', 1, chr(10) || 'user:'), ('u', 'a', 1, chr(10) || 'assistant:'),
      ('n', 'a', 2, chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
      ('a', 'a', 2, chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 'u', 2, chr(10) || 'assistant:' || chr(10) || 'user:')) p(old, q, ins, made) ON p.old = w.q,
    (VALUES ('D'), ('K'), ('R')) e(edit), LATERAL (SELECT CASE p.q WHEN 'u' THEN 'a' ELSE 'u' END AS nxt)
    WHERE e.edit = 'D' OR NOT k.must AND (e.edit = 'R' OR k.ini = 's' AND p.q = 'n' OR k.ini = 'u' AND p.q <> 'u' OR k.ini = 'a' AND p.q = 'u')
    GROUP BY ALL)),
ends AS (SELECT w.conv_id, min({'cost': w.cost + t.c, 'audit': w.audit || t.a, 'made': w.made || t.m}) AS best
  FROM walk w JOIN (VALUES ('n', 0, '', ''), ('a', 0, '', ''), ('u', 3, 'I', chr(10) || 'assistant:'), ('s', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) t(q, c, a, m) ON t.q = w.q
  JOIN (SELECT conv_id, max(n) AS n FROM kind GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = m.n
  GROUP BY w.conv_id),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (i < n AND left(role, 1) || next_initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
