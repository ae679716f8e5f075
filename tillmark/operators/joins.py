"""Join shapes used by the models.

No side is broadcast by hint: Spark broadcasts a side when its size, known from the plan (the seed tables), from the
files or measured at run time, is under ``spark.sql.autoBroadcastJoinThreshold``, and otherwise shuffles, where
adaptive execution splits the partition of a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(facts: DataFrame, seed: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    """Optional attributes, for example from one of the constant seed tables."""
    return facts.join(seed, on, "left")


def full_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with one coalesced copy of each key. NULL keys match nothing, so they stay apart."""
    return left.join(right, list(keys), "full")


#: An aggregate function and what it is applied to, row by row.
Aggregate = tuple[Callable[[Column], Column], Column]

_FACT, _APART = "_fact", "_apart"


def facts_together(facts: Sequence[tuple[DataFrame, Mapping[str, Aggregate]]], keys: Sequence[str]) -> DataFrame:
    """Aggregates of several facts side by side: (rows, {name: (function, expression)}) each, like a full outer join of the facts'
    own aggregates, but with one shuffle for any number of facts.

    The rows of all facts are one tagged union, and one aggregation combines them before they travel, so a hot key is one
    row from each task. A fact that has no row for a key has NULL there. Rows with a NULL in a key meet no other fact.
    Without keys the result is a single row.
    """
    parts, values = [], []
    for i, (rows, aggregates) in enumerate(facts):
        own = [expression.alias(name) for name, (_, expression) in aggregates.items()]
        parts.append(rows.select(*keys, *own, F.lit(i).alias(_FACT)))
        here = F.count(F.when(F.col(_FACT) == i, F.lit(1))) > 0
        for name, (function, _) in aggregates.items():
            value = function(F.col(f"`{name}`"))
            values.append((F.when(here, value) if keys else value).alias(name))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not keys:
        return union.agg(*values)
    some_null = reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys])
    apart = F.when(some_null, F.col(_FACT)).alias(_APART)
    return union.groupBy(*(F.col(f"`{k}`") for k in keys), apart).agg(*values).drop(_APART)


def without_match(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the others do not have; a NULL key has no match.

    The other side is reduced to distinct keys before it is shuffled: Spark can split a hot key of the rows, but not
    one of the others.
    """
    return rows.join(others.select(*keys).distinct(), list(keys), "left_anti")


def beside_scalars(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row next to the values of a one-row aggregate, which is computed once as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_one")).scalar()
    return rows.withColumn("_one", packed).select(*rows.columns, "_one.*")


def outer_with_side(left: DataFrame, right: DataFrame, keys: Sequence[str], side: str = "side") -> DataFrame:
    """Full outer join that says where each key was found: ``left_only``, ``both`` or ``right_only``."""
    marked_left = left.withColumn("_in_left", F.lit(True))
    marked_right = right.withColumn("_in_right", F.lit(True))
    where = (
        F.when(F.col("_in_left").isNull(), "right_only").when(F.col("_in_right").isNull(), "left_only").otherwise("both")
    )
    return full_on(marked_left, marked_right, keys).withColumn(side, where).drop("_in_left", "_in_right")
