"""Chat formatting: conversations as budgeted training windows with a loss mask.

Prefix sums of the turns' tokens, distributed over the whole table, put each turn into a window:
the one in whose stretch of the conversation it begins. No turn is cut and no conversation is
gathered; a long one spreads over many tasks. Each window repeats the leading system turn and a
limited history; repeated turns are never targets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkbook.llm.common import n_words, running_totals
from linkbook.plans.staging import stage

# Tokens of new turns in a window, and tokens before it that are repeated. A window's last turn may run over.
STRIDE, HISTORY = 768, 192
TURN_TOKENS = 4  # what the template adds to a turn's words
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"

_ESCAPED = {"\\": "\\\\", "<": "\\l", "#": "\\h", ":": "\\c", "\n": "\\n"}
_PLAIN = {v: k for k, v in _ESCAPED.items()}
_IN_TEXT = re.compile(r"\\|<(?=/turn>)|#(?=##)")
_IN_ROLE = re.compile(r"[\\<#:\n]")
_ESCAPE = re.compile(r"\\[\\lhcn]")
_TURN = re.compile(r"### ([^\n]*):\n(.*?)\n</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """The text with no ``</turn>`` and no ``###`` left in it; :func:`unescape` gives it back."""
    return _IN_TEXT.sub(lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _PLAIN[m[0]], text)


def format_window(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, [start, end) of the targets' texts in it) of turns with role, text, target."""
    parts, spans, at = [], [], 0
    for turn in turns:
        head, body = f"### {_IN_ROLE.sub(lambda m: _ESCAPED[m[0]], turn['role'])}:\n", escape(turn["text"])
        if turn["target"]:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}\n</turn>\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse_window(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, losses, repeated = [], [], []
        for turns in batch.column("turns").to_pylist():
            text, spans = format_window(turns)
            texts.append(text)
            losses.append([{"start": a, "end": b} for a, b in spans])
            repeated.append(sum(t["kind"] < 2 for t in turns))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("window"), pa.array(texts, pa.string()), pa.array(losses, kind), pa.array(repeated, pa.int64())],
            ["conv_id", "window", "formatted", "loss", "n_repeated"],
        )


def windows(conversations: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss (spans of characters), n_repeated (turns).

    Turns go by ``turn``, null last; equal ones by role, then by hash. Null roles and texts
    count as empty. A null conv_id is a conversation of its own. A conversation's first turn is
    retained in all its windows if its role is system. Turns begin a window every ``stride``
    tokens (words and ``TURN_TOKENS`` a turn); those that begin within the ``history`` tokens
    before are repeated. Empty tables give no rows; further columns are not read.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (n_words(text) + TURN_TOKENS).alias("tokens"),
        F.lit(1).cast("long").alias("one"), F.xxhash64(text).alias("tie"),
    )
    placed = stage(
        running_totals(turns, ["conv_id", "turn", "role", "tie"], {"tokens_before": "tokens", "turns_before": "one"}, "chat-turns"),
        "chat-placed",
    )
    starts = placed.groupBy(F.col("conv_id").alias("of")).agg(F.min("tokens_before").alias("t0"), F.min("turns_before").alias("n0"))
    own = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of").withColumns(
        {"before": F.col("tokens_before") - F.col("t0"), "place": F.col("turns_before") - F.col("n0")}
    )
    own = own.withColumn("window", F.expr(f"before div {stride}"))
    fields = ["conv_id", "window", "kind", "place", "role", "text"]
    # Kinds in the order they stand in a window: 0 the retained system turn, 1 history, 2 new.
    new = own.withColumn("kind", F.lit(2)).select(*fields)
    system = own.where((F.col("place") == 0) & (F.col("role") == SYSTEM_ROLE)).select(F.col("conv_id").alias("of"), "role", "text")
    later = own.where("window > 0").select("conv_id", "window").distinct()
    retained = later.join(system, F.col("conv_id").eqNullSafe(F.col("of"))).withColumns({"kind": F.lit(0), "place": F.lit(0).cast("long")}).select(*fields)
    is_system = (F.col("place") == 0) & (F.col("role") == SYSTEM_ROLE)
    recent = own.where(~is_system & (F.col("before") >= (F.col("window") + 1) * stride - history))
    repeated = recent.withColumns({"window": F.col("window") + 1, "kind": F.lit(1)}).select(*fields)
    target = (F.col("kind") == 2) & (F.col("role") == TARGET_ROLE)
    turn = F.struct("kind", "place", "role", "text", target.alias("target"))
    grouped = new.union(retained).union(repeated).groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.max("kind").alias("newest")
    )
    id_type = grouped.schema["conv_id"].dataType.simpleString()
    return grouped.where("newest = 2").select("conv_id", "window", "turns").mapInArrow(
        _formatted, f"conv_id {id_type}, window bigint, formatted string, loss array<struct<start: bigint, end: bigint>>, n_repeated bigint"
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of sorted windows, one conversation after the other; only running hashes are held."""
    now, state = None, None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def row(conv_id) -> list:
        return [conv_id, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]]

    for batch in batches:
        out = []
        for w in batch.to_pylist():
            if state is None or w["conv_id"] != now:
                if state is not None:
                    out.append(row(now))
                now = w["conv_id"]
                state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
            for role, text in parse_window(w["formatted"])[w["n_repeated"] :]:
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in w["loss"]:
                text = unescape(w["formatted"][span["start"] : span["end"]])
                state["chars"] += len(text)
                state["loss"].update(text.encode("utf-8", "surrogatepass"))
            state["formatted"] += len(w["formatted"])
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("conv_id").type), *map(pa.array, columns[1:])], names)
    if state is not None:
        columns = [[x] for x in row(now)]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("conv_id").type), *map(pa.array, columns[1:])], names)


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows hold, read back from their text: one row per conversation."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(
        _digests, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op2: digests of all conversations and of conversation -7, whose texts hold control strings."""
    table = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(windows(table.unionByName(extra)))


SQL = rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
placed AS (SELECT *, coalesce(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {TURN_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, role = '{SYSTEM_ROLE}' AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS sys,
  length('### :' || role || chr(10) || text || chr(10) || '</turn>' || chr(10)) + length(role) - length(regexp_replace(role, '[\\<#:\n]', '', 'g'))
    + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{{3,}}'), lambda r: length(r) - 2)), 0) AS n FROM c),
w AS (SELECT *, before // {STRIDE} AS w FROM placed),
later AS (SELECT DISTINCT conv_id, w FROM w WHERE w > 0),
shown AS (SELECT conv_id, n FROM w
  UNION ALL SELECT w.conv_id, n FROM w JOIN later l ON l.conv_id = w.conv_id AND w.sys
  UNION ALL SELECT w.conv_id, n FROM w JOIN later l ON l.conv_id = w.conv_id AND l.w = w.w + 1 AND NOT w.sys AND w.before >= l.w * {STRIDE} - {HISTORY})
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{TARGET_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = '{TARGET_ROLE}'), '')) AS loss_sha256,
  any_value(f)::BIGINT AS formatted_chars
FROM c JOIN (SELECT conv_id, sum(n) AS f FROM shown GROUP BY conv_id) USING (conv_id) GROUP BY conv_id
"""
