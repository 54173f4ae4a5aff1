"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_name(iri: str | Column) -> Column:
    """Text after the last ``/``; null becomes the empty string."""
    column = F.col(iri) if isinstance(iri, str) else iri
    return F.coalesce(F.substring_index(column, "/", -1), F.lit(""))
