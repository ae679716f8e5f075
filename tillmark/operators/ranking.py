"""Row numbers, ranks and running values.

``first_per_key`` and ``top_by_rank`` keep only low ranks, so Spark limits every group before the shuffle and a hot
group never travels whole. ``number_rows`` gives every row its position, which no limit can shorten; it numbers
pieces of a measured size, so one hot group spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.ordering import ascending, by
from tillmark.sources.shared import FACTS, discard, written

#: Rows of a piece that one task sorts.
PIECE_ROWS = 250_000
#: Rows of a table of pieces that is small beside the rows of one piece, so that it goes to all rows instead of them to it.
FEW = 100_000


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_copy", position).filter("_copy = 1").drop("_copy")


def top_by_rank(
    df: DataFrame, group: Sequence[str], field: str, n: int, rank: str, dense: bool = False
) -> DataFrame:
    """Rows whose rank in the group, highest ``field`` first, is at most ``n``; ties share a rank and all stay."""
    spec = Window.partitionBy(*group).orderBy(F.col(field).desc_nulls_last())
    position = F.dense_rank() if dense else F.rank()
    return df.withColumn(rank, position.over(spec)).filter(F.col(rank) <= n)


def with_share(df: DataFrame, group: Sequence[str], field: str, total: str, totals: DataFrame | None = None) -> DataFrame:
    """Adds the group total of ``field``. Totals are summed before the shuffle and joined back by key.

    The rows are needed twice, for the totals and for themselves; where an aggregate made them, Spark reuses its shuffle if it reads the
    same columns. ``totals`` (the group and ``total``) may give the totals instead.
    """
    keys = list(group)
    totals = df.groupBy(*keys).agg(F.sum(field).alias(total)) if totals is None else totals
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return df.alias("r").join(totals.alias("t"), same).select("r.*", F.col(f"t.{total}"))


def running(order: Sequence[str], group: Sequence[str]) -> Window:
    spec = Window.partitionBy(*group).orderBy(*ascending(*order))
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sequence_of(order: Sequence[str], group: Sequence[str]) -> Window:
    return Window.partitionBy(*group).orderBy(*ascending(*order))


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]], name: str, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """``row_number()`` of every row in its group, for groups of any size.

    The rows are written once and counted; as many pieces as ``piece_rows`` rows each need are cut by group and order, at the
    quantiles of a sample of the rows that Spark draws. How many pieces there are follows from the rows alone, not from the
    session. Each piece is written with the position that a row has in it, and a group lying in several pieces adds up the row
    counts of the earlier ones; that table has one row per (piece, group). ``order`` must be total within a group:
    ``(column, descending)`` pairs.
    """
    keys = list(group)
    full_order = [*ascending(*keys), *by(order)]
    slot = F.monotonically_increasing_id()
    rows = written(df, "to-number", codec=FACTS)
    pieces_wanted = max(1, -(-rows.count() // piece_rows))
    placed = written(
        rows.repartitionByRange(pieces_wanted, *full_order)
        .sortWithinPartitions(*full_order)
        .withColumn("_part", F.shiftright(slot, 33))
        .withColumn("_slot", slot),
        "numbered",
        codec=FACTS,
    )
    discard(rows)
    pieces = placed.groupBy("_part", *keys).agg(F.min("_slot").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Counted, so that its size is known before the join and not all rows travel again for it.
    few = pieces.count() <= FEW
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    pieces = F.broadcast(pieces) if few else pieces
    same = [F.col("r._part") == F.col("p._part"), *(F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys)]
    position = (F.col("r._slot") - F.col("p._first") + F.col("p._before") + 1).cast("int").alias(name)
    return placed.alias("r").join(pieces.alias("p"), same).select(*(F.col(f"r.{c}") for c in df.columns), position)
