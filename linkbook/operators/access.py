"""Who may see which groups, and rows scoped to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkbook.book import Book
from linkbook.operators.ownership import top_level_names

# Role names.
GROUP_RISK = "group_risk"
RELATIONSHIP_MANAGER = "relationship_manager"
LIMIT_EDITORS = (GROUP_RISK,)


def visible_groups(role: str, portfolios: list, candidates: DataFrame) -> DataFrame:
    """``head``: the candidate groups one reader may see.

    Group risk sees every candidate, a manager those in the portfolio, others none.
    """
    heads = candidates.select("head").distinct()
    if role == GROUP_RISK:
        return heads
    if role == RELATIONSHIP_MANAGER:
        return heads.filter(F.col("head").isin(portfolios))
    return heads.filter(F.lit(False))


def grants(principals: DataFrame, candidates: DataFrame) -> DataFrame:
    """``principal, head, sees_all`` for a table of principals (``principal, role, portfolios``).

    Managers get one row per candidate group in their portfolio; group risk gets a
    single ``sees_all`` row instead of a copy of every candidate.
    """
    kind = candidates.schema["head"].dataType
    managed = (
        principals.filter(F.col("role") == RELATIONSHIP_MANAGER)
        .select("principal", F.explode("portfolios").alias("head"))
        .select("principal", F.col("head").cast(kind).alias("head"))
        .distinct()
        .join(candidates.select("head").distinct(), "head", "left_semi")
        .select("principal", "head", F.lit(False).alias("sees_all"))
    )
    full = principals.filter(F.col("role") == GROUP_RISK).select(
        "principal", F.lit(None).cast(kind).alias("head"), F.lit(True).alias("sees_all")
    )
    return managed.unionByName(full)


def allow(role: Column, portfolios: Column, group: Column) -> Column:
    """Single decision, refused by default."""
    return F.coalesce(
        (role == GROUP_RISK)
        | ((role == RELATIONSHIP_MANAGER) & F.array_contains(portfolios, group)),
        F.lit(False),
    )


def scope_rows(
    rows: DataFrame, book: Book, visible: DataFrame | None, columns: tuple[str, ...] = ("owner", "entity_id", "head")
) -> DataFrame:
    """Rows whose owner, entity or head rolls up to a visible group.

    ``visible`` has ``head`` (None: no restriction). Rows without any id stay.
    """
    present = [c for c in columns if c in rows.columns]
    if visible is None or not present:
        return rows
    heads = visible.select("head").distinct()
    members = (
        book.ownership.select("entity_id", F.col("ubo").alias("head"))
        .join(heads, "head", "left_semi")
        .select("entity_id", F.lit(True).alias("seen"))
        .unionByName(heads.select(F.col("head").alias("entity_id"), F.lit(True).alias("seen")))
        .distinct()
    )
    keep = F.lit(False)
    blank = F.lit(True)
    for i, c in enumerate(present):
        flag = f"_seen_{i}"
        rows = rows.join(
            members.select(F.col("entity_id").alias(c), F.col("seen").alias(flag)), c, "left"
        )
        keep = keep | F.coalesce(flag, F.lit(False))
        blank = blank & F.col(c).isNull()
    return rows.filter(keep | blank).drop(*[f"_seen_{i}" for i in range(len(present))])


def candidate_groups(book: Book) -> DataFrame:
    return top_level_names(book).select("head")


def gate_limit_edits(changes: DataFrame) -> DataFrame:
    """Adds ``allowed, refusal``: only group risk may create or change limits.

    ``changes`` carries ``role`` and either ``kind`` or ``field``.
    """
    touches = F.lit(False)
    if "kind" in changes.columns:
        touches = touches | F.coalesce(F.col("kind") == "limit", F.lit(False))
    if "field" in changes.columns:
        touches = touches | F.coalesce(F.col("field") == "limitAmount", F.lit(False))
    refused = touches & ~F.coalesce(F.col("role").isin(*LIMIT_EDITORS), F.lit(False))
    return changes.withColumn("allowed", ~refused).withColumn(
        "refusal",
        F.when(
            refused,
            F.format_string("role '%s' may not edit limits", F.coalesce("role", F.lit(""))),
        ),
    )
