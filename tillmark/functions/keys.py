"""Surrogate keys. ``concat`` is NULL when any part is NULL; ``concat_ws`` would silently skip the part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_key(*parts: Column, separator: str = "-") -> Column:
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit(separator))
        pieces.append(part.cast("string"))
    return F.concat(*pieces)


def line_key(document: Column, line: Column) -> Column:
    return joined_key(document, line)


def item_key(document: Column, padded_item: Column) -> Column:
    """``000010`` becomes ``10``."""
    return joined_key(document, padded_item.cast("int"))


def spend_key(day: Column, channel: Column, region: Column, campaign: Column) -> Column:
    return joined_key(day, channel, region, F.coalesce(campaign, F.lit("-")), separator="|")
