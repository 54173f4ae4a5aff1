"""Conversation prefix trie: which beginnings conversations share, and what storing them once saves.

Whole-sequence collapse: conversations with the same turns become one weighted sequence with the
list of those that end there; sequences that are proper prefixes of others go by an anti-join,
which leaves the leaves; the prefixes of the weighted sequences are then added up to nodes. No
tree is built: a prefix is named by a digest that grows with its turns, by sums over range-sorted
rows, so a long conversation and a popular beginning spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkbook.llm.common import running_totals
from linkbook.plans.staging import stage

# Conversations of one number range share the beginning of its first one.
FAMILY, HEADS = 100, 6
# Ids that one row of an end list holds on the way to its digest.
PIECE_IDS = 4096


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, digest, chars) of every turn, and (conv_id, n_turns).

    Turns go by ``turn``, null first; equal ones by role, then by a digest of the text. A null
    role or text is an empty one; rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("has_turn"), "turn", role.alias("role"),
        F.md5(text.cast("binary")).alias("tie"), F.char_length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"),
    )
    numbered = stage(running_totals(rows, ["conv_id", "has_turn", "turn", "role", "tie"], {"at": "one"}, "trie-turns"), "trie-numbered")
    convs = numbered.groupBy("conv_id").agg(F.min("at").alias("start"), F.count("*").alias("n_turns"))
    placed = numbered.join(convs.drop("n_turns"), "conv_id").select(
        "conv_id", (F.col("at") - F.col("start") + 1).alias("depth"), F.md5(F.concat(F.md5(F.col("role").cast("binary")), "tie")).alias("digest"), "chars"
    )
    return placed, convs.drop("start")


def rebuilt(placed: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for conversations that begin with up to five turns of the first one of their family."""
    own = convs.withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS, "base": F.expr(f"conv_id - conv_id % {FAMILY}"),
    })
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    own = own.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("n_base", F.lit(0))))
    own = stage(own.withColumn("n_rebuilt", F.col("shared") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))), "trie-families")
    heads = placed.where(f"conv_id % {FAMILY} = 0 AND depth < {HEADS}").withColumnRenamed("conv_id", "base")
    first = own.where("shared > 0").select("conv_id", "base", "h").join(heads, "base").where("depth <= h")
    rest = placed.join(own.select("conv_id", "h", "shared"), "conv_id").where("depth > h")
    columns = ["conv_id", "digest", "chars"]
    both = first.select(F.col("depth").cast("long").alias("depth"), *columns).union(
        rest.select((F.col("depth") - F.col("h") + F.col("shared")).cast("long").alias("depth"), *columns)
    )
    return both, own.select("conv_id", F.col("n_rebuilt").cast("long").alias("n_turns"))


def _name(depth: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, a, b).cast("binary")))


ROOT = hashlib.md5(b"0,0,0").digest()  # as the parent of a first turn is named


def prefixes(placed: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, depth, chars, node (names the turns up to it), parent (those before it).

    A name is made of two sums of 64-bit hashes of (turn, depth), so equal names mean equal turns.
    """
    number = lambda seed: F.xxhash64("digest", "depth", F.lit(seed)).cast("decimal(20,0)")
    rows = placed.select("conv_id", "depth", "chars", number("a").alias("a"), number("b").alias("b"))
    summed = stage(running_totals(rows, ["conv_id", "depth"], {"a0": "a", "b0": "b"}, "trie-hashes"), "trie-prefixes")
    starts = summed.where("depth = 1").select("conv_id", F.col("a0").alias("a1"), F.col("b0").alias("b1"))
    own = summed.join(starts, "conv_id").withColumns({"a0": F.col("a0") - F.col("a1"), "b0": F.col("b0") - F.col("b1")})
    whole = lambda c: c.cast("decimal(38,0)").cast("string")
    return own.select(
        "conv_id", "depth", "chars",
        _name(F.col("depth"), whole(F.col("a0") + F.col("a")), whole(F.col("b0") + F.col("b"))).alias("node"),
        _name(F.col("depth") - 1, whole(F.col("a0")), whole(F.col("b0"))).alias("parent"),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) -> (node, first, ids): up to ``PIECE_IDS`` ids of a node, joined by commas."""
    node, ids = None, []

    def row() -> tuple:
        return node, ids[0], ",".join(map(str, ids))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["node", "first", "ids"])

    for batch in batches:
        rows = []
        for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (key != node or len(ids) == PIECE_IDS):
                rows.append(row())
                ids = []
            node = key
            ids.append(conv)
        if rows:
            yield table(rows)
    if ids:
        yield table([row()])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of sorted pieces, one node after the other; the list is not held."""
    node, state = None, None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        a, b = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.string())], ["node", "ends_sha256"])

    for batch in batches:
        rows = []
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key == node:
                state.update(b",")
            else:
                if state is not None:
                    rows.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        if rows:
            yield table(rows)
    if state is not None:
        yield table([(node, state.hexdigest())])


def end_digests(members: DataFrame) -> DataFrame:
    """(node, conv_id) -> (node, ends_sha256): digests of the ids in order, joined by commas.

    Ids are range-sorted and joined to pieces where they lie, so the task that runs over a large
    node's list reads one row for thousands of ids.
    """
    ranged = members.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "node binary, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def sequences(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, conv_id, length) of each conversation, and the distinct sequences: node, rep (smallest id), length, weight, is_leaf.

    A sequence is a leaf unless it is a proper prefix of another one.
    """
    ends = rows.join(convs, "conv_id").where("depth = n_turns").select("node", "conv_id", F.col("depth").alias("length"))
    members = stage(ends.union(convs.where("n_turns = 0").select(F.lit(ROOT), "conv_id", "n_turns")), "trie-members")
    distinct = stage(members.groupBy("node").agg(F.min("conv_id").alias("rep"), F.first("length").alias("length"), F.count("*").alias("weight")), "trie-distinct")
    # The nodes above all last turns; only turns of the sequences' smallest conversations are read.
    inner = rows.join(distinct.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").select(F.col("parent").alias("node")).distinct()
    leaves = distinct.join(inner, "node", "left_anti").select("node", F.lit(1).alias("leaf"))
    return members, stage(distinct.join(leaves, "node", "left").withColumn("is_leaf", F.coalesce("leaf", F.lit(0))).drop("leaf"), "trie-sequences")


def trie(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``placed`` and ``convs`` as of :func:`turns`. A node is a distinct beginning of ``depth`` turns;
    the root, of depth 0, belongs to every conversation, also to those without turns. Without
    conversations there are no rows. Repeated conversations count in ``n_convs``.
    """
    rows = stage(prefixes(placed), "trie-rows")
    members, distinct = sequences(rows, convs)
    weighted = distinct.select(F.col("rep").alias("conv_id"), "weight", "is_leaf")
    # The prefixes of each distinct sequence, the root among them.
    below = rows.join(weighted, "conv_id").select("node", "parent", "depth", "chars", "conv_id", "weight", "is_leaf")
    roots = weighted.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "conv_id", "weight", "is_leaf")
    of_sequences = stage(below.union(roots), "trie-weighted")
    nodes = of_sequences.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("chars").alias("chars"),
        F.sum("weight").alias("n_convs"), F.sum("is_leaf").alias("n_leaves"),
    )
    nodes = stage(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "trie-nodes")
    # A sequence owns the nodes of which it is the smallest member: the lower end of its path. The sum
    # below a node is what all sequences through it own, without what its own owner has above it.
    above = stage(running_totals(nodes.select("conv_id", "depth", "node", "saved"), ["conv_id", "depth"], {"before": "saved"}, "trie-owned"), "trie-sums")
    owned = above.groupBy("conv_id").agg(F.sum("saved").alias("owned"), F.min("before").alias("start"))
    through = of_sequences.select("node", "conv_id").join(owned.select("conv_id", "owned"), "conv_id").groupBy("node").agg(F.sum("owned").alias("through"))
    upper = above.join(owned.select("conv_id", "start"), "conv_id").select("node", (F.col("before") - F.col("start")).alias("upper"))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(through, "node").join(upper, "node").join(children, "node", "left").join(end_digests(members), "node", "left").join(parents, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
            (F.col("through") - F.col("upper")).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op12: the prefix trie of all conversations, rebuilt with shared beginnings."""
    return trie(*rebuilt(*turns(spark.read.parquet(f"{folder}/conversations.parquet"))))


SQL = r"""
WITH bits(t) AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1
  THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n::BIGINT))),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
  PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), bits),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d FROM (
  SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.base AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h)),
p AS (SELECT conv_id, d, length(text) AS len, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT k, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, any_value(len) AS len FROM p GROUP BY k),
kids AS (SELECT left(k, 64 * (d - 1)) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT DISTINCT a.k, b.k AS v FROM p a JOIN p b ON b.conv_id = a.conv_id AND b.d >= a.d),
sums AS (SELECT b.k, sum((v.n - 1) * v.len) AS saved_tokens, count(*) FILTER (kids.k IS NULL) AS n_leaves
  FROM below b JOIN nodes v ON v.k = b.v LEFT JOIN kids ON kids.k = b.v GROUP BY b.k),
ends AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e
  FROM (SELECT conv_id, arg_max(k, d) AS k FROM p GROUP BY conv_id) GROUP BY k)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes n JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k)
LEFT JOIN nodes up ON n.d > 0 AND up.k = left(n.k, 64 * (n.d - 1))
"""
