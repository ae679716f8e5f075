"""Weekly marketing facts: every ISO week against the week before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.dates import date_series, iso_week_label
from tillmark.functions.money import round_double
from tillmark.plans.metrics import Filter, MetricLayer
from tillmark.sources import seeds

MARKETING = ("ad_spend", "attributed_revenue", "roas")
ONLINE = ("revenue", "orders", "average_order_value")

# Decimals shown for each metric in the weekly facts, and the smallest smoothed daily amount.
DIGITS = {"roas": 4}
ONLINE_DIGITS: dict[str, int] = {}
USUAL_DIGITS = 2
SMOOTH_FLOOR = 5.0


def change_pct(this: Column, previous: Column) -> Column:
    """NULL when either is NULL or the previous is 0."""
    return round_double((this - previous) / F.nullif(previous, F.lit(0.0)) * 100, 1)


def with_previous_week(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each week's values with those of seven days earlier; a week that is absent stays NULL.

    Every row is also counted as the previous week of its successor, so the frame is computed once.
    """
    as_this = F.struct(
        F.col("date").alias("week"),
        *(F.col(v).alias(f"this_{v}") for v in values),
        *(F.lit(None).cast("double").alias(f"prev_{v}") for v in values),
    )
    as_previous = F.struct(
        F.date_add("date", 7).alias("week"),
        *(F.lit(None).cast("double").alias(f"this_{v}") for v in values),
        *(F.col(v).alias(f"prev_{v}") for v in values),
    )
    both = df.select(*keys, F.explode(F.array(as_this, as_previous)).alias("w")).select(*keys, "w.*")
    return both.groupBy("week", *keys).agg(
        *(F.max(f"{side}_{v}").alias(f"{side}_{v}") for side in ("this", "prev") for v in values)
    )


def _facts(df: DataFrame, section: str, values: Sequence[str], digits: dict[str, int]) -> DataFrame:
    channel = F.col("marketing_channel") if "marketing_channel" in df.columns else F.lit(None).cast("string")
    pairs = F.array(
        *(
            F.struct(
                F.lit(v).alias("metric"),
                round_double(F.col(f"this_{v}"), digits.get(v, USUAL_DIGITS)).alias("this_week"),
                round_double(F.col(f"prev_{v}"), digits.get(v, USUAL_DIGITS)).alias("previous_week"),
                change_pct(F.col(f"this_{v}"), F.col(f"prev_{v}")).alias("change_pct"),
            )
            for v in values
        )
    )
    return df.select(
        "week", F.lit(section).alias("section"), channel.alias("marketing_channel"), F.explode(pairs).alias("f")
    ).select("week", "section", "marketing_channel", "f.*")


def paid_channels(layer: MetricLayer) -> DataFrame:
    paid = [Filter("marketing_channel", "in", list(seeds.PAID_CHANNELS))]
    return layer.frame(MARKETING, ["date", "marketing_channel"], "week", filters=paid)


def pair_facts(layer: MetricLayer) -> DataFrame:
    """This week, the previous week and the change for the totals, the web shop and every paid channel."""
    totals = with_previous_week(layer.frame(MARKETING, ["date"], "week"), [], MARKETING)
    web = layer.frame(ONLINE, ["date"], "week", filters=[Filter("sales_channel", "=", "online")])
    online = with_previous_week(web, [], ONLINE)
    channels = with_previous_week(paid_channels(layer), ["marketing_channel"], MARKETING)

    # only weeks that have data of their own; their successors are known from the shift alone
    def present(df: DataFrame, values: Sequence[str]) -> DataFrame:
        return df.filter(F.coalesce(*(F.col(f"this_{v}") for v in values)).isNotNull()).select("week")

    weeks = present(totals, MARKETING).unionByName(present(online, ONLINE)).distinct()
    each_channel = F.explode(F.array(*(F.lit(c) for c in seeds.PAID_CHANNELS))).alias("marketing_channel")
    facts = [
        _facts(weeks.join(totals, ["week"], "left"), "totals", MARKETING, DIGITS),
        _facts(weeks.join(online, ["week"], "left"), "online", ONLINE, ONLINE_DIGITS),
        _facts(
            weeks.select("week", each_channel).join(channels, ["week", "marketing_channel"], "left"),
            "channel",
            MARKETING,
            DIGITS,
        ),
    ]
    every = facts[0].unionByName(facts[1]).unionByName(facts[2])
    return every.select(iso_week_label("week").alias("iso_week"), *every.columns)


def best_and_weakest_channel(layer: MetricLayer) -> DataFrame:
    """Per week the paid channels with the highest and the lowest return on ad spend."""
    order = F.array_position(F.array(*(F.lit(c) for c in seeds.PAID_CHANNELS)), F.col("marketing_channel"))
    known = paid_channels(layer).filter(F.col("roas").isNotNull())
    rank = F.struct(round_double(F.col("roas"), 4), order)
    return known.groupBy(F.col("date").alias("week")).agg(
        F.max_by("marketing_channel", rank).alias("best_channel_by_roas"),
        F.min_by("marketing_channel", rank).alias("weakest_channel_by_roas"),
    )


def top_region(layer: MetricLayer) -> DataFrame:
    """Per week the region with the most attributed revenue; ties go to the first name."""
    earned = layer.frame(["attributed_revenue", "roas"], ["date", "region"], "week")
    earned = earned.filter(F.col("attributed_revenue") != 0)
    best = F.min(
        F.struct((-F.col("attributed_revenue")).alias("rank"), F.coalesce("region", F.lit("~")).alias("name"), "region", "roas")
    )
    return earned.groupBy(F.col("date").alias("week")).agg(best.alias("b")).select(
        "week",
        F.col("b.region").alias("region"),
        round_double(-F.col("b.rank"), 2).alias("attributed_revenue"),
        round_double(F.col("b.roas"), 4).alias("roas"),
    )


def smoothed_daily_revenue(orders: DataFrame) -> DataFrame:
    """Seven-day centred mean of attributed revenue per paid channel and region, days without orders as 0."""
    credited = orders.filter(F.col("is_paid_attribution") & (F.col("order_type") == "sale"))
    daily = credited.groupBy(F.col("order_date").alias("date_day"), "marketing_channel", "region_code").agg(
        F.sum("revenue_nzd").cast("double").alias("revenue")
    )
    span = orders.agg(F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    spine = date_series(orders.sparkSession, F.col("first"), F.col("last"), span)
    for column, values in (
        ("marketing_channel", seeds.PAID_CHANNELS),
        ("region_code", [code for code, _, _ in seeds.REGIONS]),
    ):
        spine = spine.withColumn(column, F.explode(F.array(*(F.lit(v) for v in values))))
    places = ["marketing_channel", "region_code"]
    week = Window.partitionBy(*places).orderBy("date_day").rowsBetween(-3, 3)
    filled = spine.join(daily, ["date_day", *places], "left").fillna(0.0, ["revenue"])
    return filled.select(
        "date_day", *places, F.greatest(F.avg("revenue").over(week), F.lit(SMOOTH_FLOOR)).alias("smoothed")
    )
