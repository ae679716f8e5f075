"""Aggregates with a condition, and the set of aggregations a measure may use."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_if(condition: Column, value: Column) -> Column:
    """NULL conditions count as false; 0 when nothing qualifies."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def distinct_if(condition: Column, value: Column) -> Column:
    """Exact number of distinct values among the rows that qualify."""
    return F.countDistinct(F.when(condition, value))


def avg_if(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def average(expression: Column) -> Column:
    """The exact sum over the count, as a double; the mean of decimals would be cut to a few digits."""
    return F.sum(expression).cast("double") / F.nullif(F.count(expression).cast("double"), F.lit(0.0))


MEASURE_AGGREGATIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "count": F.count,
    "count_distinct": F.countDistinct,
    "average": average,
    "min": F.min,
    "max": F.max,
}


def measure(agg: str, expression: Column) -> Column:
    """Every measure comes out as a double."""
    if agg not in MEASURE_AGGREGATIONS:
        raise ValueError(f"Aggregation '{agg}' is not supported. Valid: {', '.join(MEASURE_AGGREGATIONS)}")
    return MEASURE_AGGREGATIONS[agg](expression).cast("double")


def label_of_extreme(df: DataFrame, label: str, value: str, highest: bool, group: Sequence[str] = ()) -> DataFrame:
    """The label with the highest or lowest value. NULL labels and values are left out; ties go to the first label."""
    known = df.filter(F.col(label).isNotNull() & F.col(value).isNotNull())
    signed = -F.col(value) if highest else F.col(value)
    best = F.min(F.struct(signed.alias("rank"), F.col(label).alias("label"), F.col(value).alias("value")))
    return (
        known.groupBy(*group)
        .agg(best.alias("best"))
        .select(*group, F.col("best.label").alias(label), F.col("best.value").alias(value))
    )
