"""Row order. Spark puts NULL first on an ascending sort; every ordering here says where NULL goes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascending(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def descending(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def by(fields: Iterable[tuple[str, bool]]) -> list[Column]:
    """``(column, descending)`` pairs."""
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in fields]
