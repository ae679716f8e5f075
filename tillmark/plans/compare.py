"""Row-by-row comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions.ordering import ascending
from tillmark.operators.aggregates import count_if

TOLERANCE = 0.011

# The reports that are compared, with their keys and values.
REPORTS = {
    "monthly_sales": (
        ["month", "sales_channel", "region_code"],
        ["orders", "units", "revenue_nzd", "cogs_nzd", "gross_profit_nzd"],
    ),
    "monthly_category_margin": (["month", "product_category"], ["revenue_nzd", "gross_profit_nzd", "gross_margin"]),
    "monthly_marketing": (["month", "marketing_channel"], ["ad_spend_nzd", "attributed_revenue_nzd", "roas"]),
    "monthly_delivery": (["month", "sales_channel"], ["shipments", "on_time_shipments", "on_time_rate"]),
}


def diff_rows(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = TOLERANCE
) -> DataFrame:
    """Both versions side by side: where the key was found, and whether any value differs (NULL counts as 0).

    The versions are one tagged union, added up by key before it is shuffled, so neither a hot key nor a NULL key is ever a group
    of rows to be joined. A NULL key is a key like any other here, so it meets the NULL key of the other side. Rows of one
    version that repeat a key are added up, and the key differs if the versions do not have as many rows of it.
    """
    is_left = F.col("_left")
    tagged = [
        df.select(*keys, *(F.col(v).cast("double").alias(v) for v in values), F.lit(here).alias("_left"))
        for df, here in ((left, True), (right, False))
    ]
    sums = [
        F.sum(F.when(own, F.col(v))).alias(f"{v}_{name}") for v in values for own, name in ((is_left, "left"), (~is_left, "right"))
    ]
    rows = [count_if(is_left).alias("_rows_left"), count_if(~is_left).alias("_rows_right")]
    added = tagged[0].unionByName(tagged[1]).groupBy(*keys).agg(*sums, *rows)
    side = F.when(F.col("_rows_left") == 0, "right_only").when(F.col("_rows_right") == 0, "left_only").otherwise("both")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    differs = F.col("_rows_left") != F.col("_rows_right")
    for v in values:
        differs = differs | (F.abs(number(f"{v}_left") - number(f"{v}_right")) > tolerance)
    both = added.withColumn("side", side).withColumn("differs", (F.col("side") == "both") & differs)
    return both.drop("_rows_left", "_rows_right")


def diff_summary(diff: DataFrame) -> DataFrame:
    side, differs = F.col("side"), F.col("differs")
    return diff.agg(
        count_if(side != "right_only").alias("rows_left"),
        count_if(side != "left_only").alias("rows_right"),
        count_if((side == "both") & ~differs).alias("matched_rows"),
        count_if(differs).alias("differing_rows"),
        count_if(side == "left_only").alias("only_left"),
        count_if(side == "right_only").alias("only_right"),
    )


def diff_examples(diff: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` differing rows by key."""
    return diff.filter("differs").orderBy(*ascending(*keys)).limit(n).drop("side", "differs")


def as_fields(rows: DataFrame, keys: Sequence[str], values: Sequence[str], more: Sequence[str] = ("side", "differs")) -> DataFrame:
    """A comparison as rows of (key, field, left_value, right_value), so that those of several tables can stand in one."""
    pairs = [
        F.struct(F.lit(v).alias("field"), F.col(f"{v}_left").alias("left_value"), F.col(f"{v}_right").alias("right_value")) for v in values
    ]
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key")
    return rows.select(key, F.explode(F.array(*pairs)).alias("f"), *more).select("key", "f.*", *more)
