"""Columns whose names an operator needs for its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of these names (in any case) renamed, and what gives back the columns of ``docs``."""
    taken = {n.lower() for n in names}
    renamed = [f"_kept_{i}_{c}" if c.lower() in taken else c for i, c in enumerate(docs.columns)]

    def restore(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{new}`").alias(old) for new, old in zip(renamed, docs.columns)])

    return docs.toDF(*renamed), restore
