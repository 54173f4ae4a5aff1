"""Interval labels of the ownership forest.

Entities are numbered so that everything below one is a range of numbers: a group is a range, a
group's sum the difference of two prefix sums, and a common owner a comparison of ranges. Nothing
holds a path, so a chain of any depth takes a few numbers an entity.

Sizes come from doubling: what lies within twice a distance below an entity is what lies within the
distance below it and below the entities that far down. Numbers follow from the sizes of elder
siblings, added up along the pointers of the same doubling. A cycle is cut at its smallest entity;
all of its entities head the same group, the whole component.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkbook.plans.prefix import totals_before
from linkbook.plans.staging import stage


@dataclass(frozen=True)
class Labels:
    """``nodes``: see :func:`labelled`. ``levels``: ``node, jump``, 1, 2, 4 ... owners up, for entities with so many."""

    nodes: DataFrame
    levels: list[DataFrame]


def _pointers(entities: DataFrame) -> DataFrame:
    """``node, parent, real``: all entities, and parents that are missing from the table."""
    own = entities.select(F.col("entity_id").alias("node"), F.col("parent_entity_id").alias("parent"))
    missing = own.select(F.col("parent").alias("node")).filter("node is not null").distinct()
    missing = missing.join(own.select("node"), "node", "left_anti")
    nothing = F.lit(None).cast(own.schema["parent"].dataType)
    return own.withColumn("real", F.lit(1)).unionByName(missing.select("node", nothing.alias("parent"), F.lit(0).alias("real")))


def _cycles(pointers: DataFrame) -> DataFrame | None:
    """``node, cycle`` of entities on or below a cycle, named by its smallest entity; None without cycles.

    Pointers double together with the smallest entity that they pass. Without cycles some end in
    every round: an entity with that many owners has one with half as many. So rounds in which none
    ends leave only entities that lead into cycles, and an entity that is the smallest of those
    it passes lies on one.
    """
    walk = pointers.filter("parent is not null").select("node", F.col("parent").alias("jump"), F.col("parent").alias("least"))
    live = None
    while True:
        walk = stage(walk, "cycle-walk")
        now = walk.count()
        if now == 0:
            return None
        if now == live:
            turned = walk.filter("least = node").select(F.col("node").alias("cycle"))
            beyond = walk.select(F.col("node").alias("jump"), F.col("least").alias("cycle"))
            named = stage(walk.join(beyond, "jump").join(turned, "cycle", "left_semi").select("node", "cycle"), "cycle-names")
            if named.count() == now:
                return named
        live = now
        hop = walk.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("least").alias("further"))
        walk = walk.join(hop, "jump").select("node", F.col("next").alias("jump"), F.least("least", "further").alias("least"))


def labelled(entities: DataFrame) -> Labels:
    """Labels of all entities and of parents missing from the table.

    ``nodes``: ``node, real`` (0 for a missing parent)``, parent, depth`` (owners above it)``, top, enter,
    size, members`` (real entities among them)``, low, high, cycle, on_cycle``. A node and all below it
    have ``enter`` from ``enter`` to before ``enter + size`` in the forest with cycles cut; its group
    from ``low`` to before ``high``.
    """
    pointers = stage(_pointers(entities), "pointers")
    cycles = _cycles(pointers)
    forest = pointers
    if cycles is not None:
        cut = F.col("cycle").isNotNull() & (F.col("cycle") == F.col("node"))
        forest = pointers.join(cycles, "node", "left").withColumn(
            "parent", F.when(~cut, F.col("parent")).otherwise(F.lit(None))
        ).drop("cycle")
    up = stage(
        forest.select(
            "node", "real", "parent", F.col("parent").alias("jump"), F.coalesce("parent", "node").alias("top"),
            F.col("parent").isNotNull().cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("size"), F.col("real").cast("bigint").alias("members"),
        ),
        "labels-up",
    )
    levels = []
    while True:
        level = up.filter("jump is not null").select("node", "jump")
        if level.isEmpty():
            break
        levels.append(level)
        hop = up.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("top").alias("next_top"), F.col("depth").alias("further"))
        below = up.filter("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("size").alias("more"), F.sum("members").alias("more_members"))
        zero = F.lit(0).cast("bigint")
        up = stage(
            up.join(hop, "jump", "left").join(below, "node", "left").select(
                "node", "real", "parent", F.col("next").alias("jump"), F.coalesce("next_top", "top").alias("top"),
                (F.col("depth") + F.coalesce("further", zero)).alias("depth"),
                (F.col("size") + F.coalesce("more", zero)).alias("size"), (F.col("members") + F.coalesce("more_members", zero)).alias("members"),
            ),
            "labels-up",
        )
    enter = _entered(up, levels)
    nodes = up.drop("jump").join(enter, "node")
    if cycles is None:
        nothing = F.lit(None).cast(nodes.schema["node"].dataType)
        nodes = nodes.withColumns({
            "low": F.col("enter"), "high": F.col("enter") + F.col("size"), "cycle": nothing, "on_cycle": F.lit(False),
        })
        return Labels(stage(nodes, "labels"), levels)
    # The end of a cut cycle is what its smallest entity was owned by; what holds it is on the cycle.
    nodes = stage(nodes, "labels")
    ends = (
        cycles.filter("node = cycle").join(pointers.select("node", F.col("parent").alias("end")), "node")
        .join(nodes.select(F.col("node").alias("end"), F.col("enter").alias("end_enter")), "end")
        .join(nodes.select("node", F.col("enter").alias("c_enter"), F.col("size").alias("c_size")), "node")
        .select("cycle", "end_enter", "c_enter", "c_size")
    )
    on_cycle = F.coalesce((F.col("enter") <= F.col("end_enter")) & (F.col("end_enter") < F.col("enter") + F.col("size")), F.lit(False))
    marked = nodes.join(cycles, "node", "left").join(ends, "cycle", "left").withColumn("on_cycle", on_cycle).withColumns({
        "low": F.when(F.col("on_cycle"), F.col("c_enter")).otherwise(F.col("enter")),
        "high": F.when(F.col("on_cycle"), F.col("c_enter") + F.col("c_size")).otherwise(F.col("enter") + F.col("size")),
    })
    return Labels(stage(marked.drop("end_enter", "c_enter", "c_size"), "labels"), levels)


def _entered(up: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``node, enter``: places among siblings, added up along the owners."""
    placed = stage(totals_before(up.select("node", "parent", "size"), ["parent", "node"], {"before": "size"}, "labels-siblings"), "labels-places")
    # Families are one stretch of the order, so the first one's total is the least; roots stand after all.
    firsts = placed.groupBy("parent").agg(F.min("before").alias("start"))
    step = F.col("before") - F.col("start") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    enter = stage(
        placed.join(firsts.withColumnRenamed("parent", "of"), F.col("parent").eqNullSafe(F.col("of"))).select("node", step.alias("enter")),
        "labels-enter",
    )
    for level in levels:
        above = level.join(enter.select(F.col("node").alias("jump"), F.col("enter").alias("more")), "jump").select("node", "more")
        enter = stage(
            enter.join(above, "node", "left").select("node", (F.col("enter") + F.coalesce("more", F.lit(0))).alias("enter")),
            "labels-enter",
        )
    return enter


def common_owners(labels: Labels, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` of two entities of one component with ``owner``, the deepest that has both in its part of the forest.

    Pairs of entities under different tops are left out. The first entity climbs by the widest
    step that does not yet reach the second, then by half of it, and so on.
    """
    where = labels.nodes.select("node", "top", "enter", "size", "parent")
    side = lambda name, *keep: where.select(F.col("node").alias(name), *[F.col(c).alias(f"_{name}_{c}") for c in keep])
    key = "_at"
    climbing = (
        pairs.join(side(a, "top", "enter", "size"), a)
        .join(side(b, "top", "enter"), b)
        .filter(F.col(f"_{a}_top") == F.col(f"_{b}_top"))
        .select(
            *pairs.columns, F.col(f"_{b}_enter").alias("_enter"), F.col(a).alias(key),
            _holds(F.col(f"_{a}_enter"), F.col(f"_{a}_size"), F.col(f"_{b}_enter")).alias("_met"),
        )
    )
    for level in reversed(labels.levels):
        wide = level.join(where.select(F.col("node").alias("jump"), "enter", "size"), "jump").select(
            F.col("node").alias(key), F.col("jump").alias("_jump"), F.col("enter").alias("_e"), F.col("size").alias("_s")
        )
        stepped = climbing.join(wide, key, "left")
        free = F.col("_jump").isNotNull() & ~F.col("_met") & ~_holds(F.col("_e"), F.col("_s"), F.col("_enter"))
        climbing = stage(
            stepped.select(*pairs.columns, "_enter", "_met", F.when(free, F.col("_jump")).otherwise(F.col(key)).alias(key)), "climb"
        )
    parents = where.select(F.col("node").alias(key), F.col("parent").alias("_parent"))
    return climbing.join(parents, key).select(*pairs.columns, F.when(F.col("_met"), F.col(key)).otherwise(F.col("_parent")).alias("owner"))


def _holds(enter: Column, size: Column, other: Column) -> Column:
    return (enter <= other) & (other < enter + size)


def group_sums(labels: Labels, values: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``node`` and, per measure, its sum over the node's group; ``values`` has a row per node at most."""
    zero = F.lit(0)
    rows = labels.nodes.select("node", "enter").join(values, "node", "left").select(
        "node", "enter", *[F.coalesce(m, zero).cast(values.schema[m].dataType).alias(m) for m in measures]
    )
    totals = stage(totals_before(rows, ["enter"], {f"before_{m}": m for m in measures}, "group-values"), "group-totals")
    end = totals.agg(F.max("enter").alias("enter"), *[F.sum(m).alias(m) for m in measures]).select(
        (F.col("enter") + 1).alias("enter"), *[F.col(m).alias(f"before_{m}") for m in measures]
    )
    ends = totals.select("enter", *[f"before_{m}" for m in measures]).unionByName(end)
    at = lambda name, tag: ends.select(F.col("enter").alias(name), *[F.col(f"before_{m}").alias(f"{tag}_{m}") for m in measures])
    return (
        labels.nodes.select("node", "low", "high")
        .join(at("low", "lower"), "low")
        .join(at("high", "upper"), "high")
        .select("node", *[(F.col(f"upper_{m}") - F.col(f"lower_{m}")).alias(m) for m in measures])
    )


def cycle_objects(labels: Labels) -> DataFrame:
    """Every entity on or below an ownership cycle: ``entity_id, cycle_id`` (its smallest entity)``, length, distance`` (owners before it is on the cycle)``, entry`` (where it gets there)."""
    nodes = labels.nodes.filter("cycle is not null and real = 1")
    lengths = nodes.filter("on_cycle").groupBy("cycle").agg(F.count("*").alias("length"))
    walk = nodes.select("node", "cycle", F.when(F.col("on_cycle"), F.col("node")).otherwise(F.col("parent")).alias("at"), (~F.col("on_cycle")).cast("bigint").alias("distance"))
    while True:
        walk = stage(walk, "tails")
        hop = walk.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("distance").alias("more"))
        moved = walk.join(hop, "at")
        if moved.filter("more > 0").isEmpty():
            return walk.join(lengths, "cycle").select(
                F.col("node").alias("entity_id"), F.col("cycle").alias("cycle_id"), "length", "distance", F.col("at").alias("entry")
            )
        walk = moved.select("node", "cycle", F.col("next").alias("at"), (F.col("distance") + F.col("more")).alias("distance"))


def owners(labels: Labels) -> DataFrame:
    """``entity_id, ubo, cyclic``: the top of its part of the forest, or the first entity of a cycle that it meets."""
    nodes = labels.nodes.filter("real = 1")
    entries = cycle_objects(labels).select(F.col("entity_id").alias("node"), "entry")
    return nodes.join(entries, "node", "left").select(
        F.col("node").alias("entity_id"), F.coalesce("entry", "top").alias("ubo"), F.col("cycle").isNotNull().alias("cyclic")
    )


def listing(labels: Labels) -> DataFrame:
    """``member, head, depth``: every entity with all its owners, itself first; its rows are the result itself."""
    pairs = labels.nodes.select(F.col("node").alias("member"), F.col("node").alias("head"), F.lit(0).cast("bigint").alias("depth"))
    for k, level in enumerate(labels.levels):
        further = level.select(F.col("node").alias("low"), F.col("jump").alias("member")).join(pairs, "member").select(
            F.col("low").alias("member"), "head", (F.col("depth") + (1 << k)).alias("depth")
        )
        pairs = stage(pairs.unionByName(further), "owner-pairs")
    real = labels.nodes.filter("real = 1")
    pairs = pairs.join(real.select(F.col("node").alias("member")), "member", "left_semi").select("member", "head", "depth")
    objects = cycle_objects(labels)
    if objects.isEmpty():
        return pairs
    # Owners up to the cycle come from the forest; from the entry on, all of the cycle, in its order.
    cyclic = labels.nodes.filter("on_cycle").select(F.col("node").alias("head"), F.col("cycle").alias("cycle_id"), F.col("depth").alias("at"))
    places = cyclic.select(F.col("head").alias("entry"), F.col("at").alias("from"))
    round_ = objects.join(places, "entry").join(cyclic, "cycle_id").select(
        F.col("entity_id").alias("member"), "head", (F.col("distance") + F.pmod(F.col("from") - F.col("at"), F.col("length"))).alias("depth")
    )
    return pairs.join(cyclic, "head", "left_anti").select("member", "head", "depth").unionByName(round_)
