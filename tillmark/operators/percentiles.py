"""Exact percentiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable sketch of each group, built where the rows
are, bounds the values that the wanted ranks can have. A second pass counts what lies below the bounds and tallies the few
values between them before anything is shuffled, so the values that travel are a small share of a group, ties are one row,
and nothing is sorted whole or written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch is off by 1 / ACCURACY of a group's ranks at most; the bounds keep MARGIN times that distance. Groups of up to
#: ACCURACY rows have their least and largest value as bounds.
ACCURACY, MARGIN = 10_000, 5


def group_percentiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    interpolated: Mapping[str, float] | None = None,
    nearest: Mapping[str, float] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group: ``interpolated`` percentiles lie between two rows if need be, ``nearest`` are rows' values. NULLs are left
    out; values are finite numbers."""
    keys = list(group)
    wanted = [(name, float(p), True) for name, p in (interpolated or {}).items()]
    wanted += [(name, float(p), False) for name, p in (nearest or {}).items()]
    rows = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    bounds = _bounds(rows, keys, [p for _, p, _ in wanted], accuracy)

    # a row for each percentile that the value counts for: below its bounds (no value) or between them
    counts = [
        F.when(F.col("_v") <= F.col(f"_high{i}"), F.struct(F.lit(i).alias("i"), F.when(F.col("_v") >= F.col(f"_low{i}"), F.col("_v")).alias("v")))
        for i in range(len(wanted))
    ]
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] or [F.lit(True)]
    met = rows.alias("r").join(bounds.alias("b"), same).select(*(F.col(f"r.{k}") for k in keys), "_rows", F.explode(F.array_compact(F.array(*counts))).alias("c"))
    tallied = met.groupBy(*keys, "_rows", F.col("c.i").alias("_i"), F.col("c.v").alias("_v")).agg(F.count("*").alias("_n"))
    in_order = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tallied.withColumn("_last", F.sum("_n").over(in_order)).withColumn("_first", F.col("_last") - F.col("_n") + 1)

    def at(i: int, position: Column) -> Column:
        here = (F.col("_i") == i) & position.between(F.col("_first"), F.col("_last"))
        found = F.max(F.when(here, F.col("_v")))
        return F.when(found.isNull(), F.raise_error(F.lit("A rank is outside the bounds of its sketch"))).otherwise(found)

    out: list[Column] = []
    for i, (name, p, between) in enumerate(wanted):
        if between:
            place = F.lit(p) * (F.col("_rows") - 1)
            low, high = at(i, F.floor(place) + 1), at(i, F.ceil(place) + 1)
            out.append((low + (high - low) * (F.max(place) - F.floor(F.max(place)))).alias(name))
        else:
            out.append(at(i, F.greatest(F.ceil(F.lit(p) * F.col("_rows")), F.lit(1))).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def _bounds(rows: DataFrame, keys: Sequence[str], percentiles: Sequence[float], accuracy: int) -> DataFrame:
    """Of each group the number of rows and, for each percentile, two values that its ranks lie between."""
    margin = MARGIN / accuracy
    near = [min(1.0, max(0.0, p + d)) for p in percentiles for d in (-margin, margin)]
    sketched = rows.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        F.min("_v").alias("_least"),
        F.max("_v").alias("_most"),
        F.percentile_approx("_v", near, accuracy).alias("_near"),
    )
    small = F.col("_rows") <= accuracy
    limits = []
    for i, (low, high) in enumerate(zip(near[::2], near[1::2], strict=True)):
        limits.append(F.when(small | F.lit(low <= 0), F.col("_least")).otherwise(F.col("_near")[2 * i]).alias(f"_low{i}"))
        limits.append(F.when(small | F.lit(high >= 1), F.col("_most")).otherwise(F.col("_near")[2 * i + 1]).alias(f"_high{i}"))
    return sketched.select(*keys, "_rows", *limits)
