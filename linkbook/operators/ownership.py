"""Ownership groups: ultimate parents, closure, members, cycles.

Each entity gets its ancestor path (itself first). Paths grow by doubling: one
round appends to every unfinished path the path of its last open ancestor, so a
chain of depth ``d`` needs about log2(d) joins. A path that meets itself again
stops there, and the first revisited entity is the ultimate parent.

Paths of more than :data:`LONGEST_PATH` entities are not held: such a book is described by
interval labels (:mod:`linkbook.operators.labels`), which take a few numbers an entity.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkbook.operators import labels as intervals
from linkbook.plans.staging import stage

if TYPE_CHECKING:
    from linkbook.book import Book


# A power of two. Longer chains are a matter of labels, not of paths.
LONGEST_PATH = 64


def ownership(entities: DataFrame) -> DataFrame | None:
    """``entity_id, path, ubo, cyclic`` for every entity; None if a path has over ``LONGEST_PATH`` entities."""
    id_type = entities.schema["entity_id"].dataType
    walk = entities.select(
        "entity_id",
        F.array("entity_id").alias("path"),
        F.col("parent_entity_id").alias("next"),
        F.lit(None).cast(id_type).alias("revisited"),
    )
    longest = 1
    while True:
        walk = stage(_double(walk), "ownership")
        if walk.filter(F.col("next").isNotNull()).isEmpty():
            break
        longest *= 2
        if longest >= LONGEST_PATH:
            return None
    return walk.select(
        "entity_id",
        "path",
        F.coalesce("revisited", F.element_at("path", -1)).alias("ubo"),
        F.col("revisited").isNotNull().alias("cyclic"),
    )


def _double(walk: DataFrame) -> DataFrame:
    hop = walk.select(
        F.col("entity_id").alias("next"),
        F.col("path").alias("hop_path"),
        F.col("next").alias("hop_next"),
        F.col("revisited").alias("hop_revisited"),
    )
    # A parent missing from the table still ends the path as its head.
    joined = F.concat("path", F.coalesce("hop_path", F.array("next")))
    stepped = (
        walk.filter(F.col("next").isNotNull())
        .join(hop, "next", "left")
        .select(
            "entity_id",
            joined.alias("walked"),
            F.array_distinct(joined).alias("path"),
            "hop_next",
            "hop_revisited",
        )
    )
    looped = F.size("path") < F.size("walked")
    stepped = stepped.select(
        "entity_id",
        "path",
        F.when(~looped, F.col("hop_next")).alias("next"),
        F.when(looped, F.get("walked", F.size("path")))
        .otherwise(F.col("hop_revisited"))
        .alias("revisited"),
    )
    return walk.filter(F.col("next").isNull()).unionByName(stepped)


def closure(book: Book) -> DataFrame:
    """Reflexive-transitive ``member, head, depth``."""
    if book.deep:
        return book.owner_pairs
    return book.ownership.select(
        F.col("entity_id").alias("member"), F.posexplode("path").alias("depth", "head")
    ).select("member", "head", "depth")


def ultimate_parents(book: Book) -> DataFrame:
    """``entity_id, ubo`` for every entity."""
    return book.ownership.select("entity_id", "ubo")


def top_level_names(book: Book) -> DataFrame:
    """Group heads: no parent and not a lender; ``head, head_name``."""
    return (
        book.entities.filter(F.col("parent_entity_id").isNull())
        .join(book.lenders, "entity_id", "left_anti")
        .select(
            F.col("entity_id").alias("head"),
            F.coalesce("entity_name", F.col("entity_id").cast("string")).alias("head_name"),
        )
    )


def group_members(book: Book, group: str = "closure") -> DataFrame:
    """``head, member``; ``group="ubo"`` gives each entity only to its ultimate parent and itself."""
    if group == "closure":
        return closure(book).select("head", "member")
    own = book.ownership
    return own.select(F.col("ubo").alias("head"), F.col("entity_id").alias("member")).unionByName(
        own.filter(F.col("ubo") != F.col("entity_id")).select(
            F.col("entity_id").alias("head"), F.col("entity_id").alias("member")
        )
    )


def group_sizes(book: Book) -> DataFrame:
    """``head, members`` including the head itself; of a parent missing from the table, those below it."""
    nodes = book.labels.nodes
    own = nodes.filter("not on_cycle").select(F.col("node").alias("head"), "members")
    # Entities of a cycle head the same group, which is what its cut end holds.
    cut = nodes.filter("on_cycle and node = cycle").select("cycle", "members")
    on_cycle = nodes.filter("on_cycle").select(F.col("node").alias("head"), "cycle").join(cut, "cycle").select("head", "members")
    return own.unionByName(on_cycle).filter("members > 0")


def cycles(book: Book) -> DataFrame:
    """``entity_id, cycle_id, length, distance, entry`` of entities on or below an ownership cycle."""
    return intervals.cycle_objects(book.labels)


def cycle_report(book: Book) -> DataFrame:
    """Entities on or below an ownership cycle, with the entity first met twice."""
    return book.ownership.filter("cyclic").select(
        "entity_id",
        F.col("ubo").alias("revisited_entity_id"),
        (F.col("ubo") == F.col("entity_id")).alias("on_cycle"),
    )
