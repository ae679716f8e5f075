"""The monthly reports computed straight from the files as delivered.

Nothing is cleaned: copies count twice, the file's currency label is believed, invalid lines stay, and lines of
products missing from the master vanish with the inner join. On clean files the reports equal the marts.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.functions.dates import month_of, parse_date, parse_timestamp
from tillmark.functions.money import (
    QUANTITY,
    exact_sum,
    ledger_money,
    money,
    round_double,
    rounded,
    safe_ratio,
    to_nzd,
)
from tillmark.operators.aggregates import count_if, distinct_if
from tillmark.plans import staging
from tillmark.sources import seeds
from tillmark.sources.shared import FACTS, written

REPORTS = ("monthly_sales", "monthly_category_margin", "monthly_marketing", "monthly_delivery")
VALUES = ["day", "channel", "region_code", "order_id", "quantity", "amount", "currency", "is_sale", "marketing_channel"]


def _store(feeds: Mapping[str, DataFrame]) -> DataFrame:
    stores = feeds["erp_stores"].select(F.col("STORE_ID").alias("store_id"), F.col("REGION_CODE").alias("region_code"))
    return feeds["pos_transactions"].join(stores, ["store_id"], "left").select(
        parse_timestamp("txn_ts").cast("date").alias("day"),
        F.lit("store").alias("channel"),
        "region_code",
        F.col("transaction_id").alias("order_id"),
        F.col("quantity").cast(QUANTITY).alias("quantity"),
        money("line_total").alias("amount"),
        "currency",
        (F.col("txn_type") == "SALE").alias("is_sale"),
        F.lit(None).cast("string").alias("marketing_channel"),
        F.col("sku").alias("product"),
    )


def _web(feeds: Mapping[str, DataFrame]) -> DataFrame:
    headers = feeds["ecom_orders"].filter(F.col("order_status") == "completed")
    headers = headers.select("order_id", "order_ts", "ship_region", "currency", "marketing_channel")
    return feeds["ecom_order_lines"].join(headers, ["order_id"]).select(
        parse_timestamp("order_ts").cast("date").alias("day"),
        F.lit("online").alias("channel"),
        F.col("ship_region").alias("region_code"),
        "order_id",
        F.col("quantity").cast(QUANTITY).alias("quantity"),
        money("line_total").alias("amount"),
        "currency",
        F.lit(True).alias("is_sale"),
        "marketing_channel",
        F.col("sku").alias("product"),
    )


def _wholesale(feeds: Mapping[str, DataFrame]) -> DataFrame:
    headers = feeds["erp_sales_order_headers"].select("VBELN", "AUDAT", "KUNNR")
    customers = feeds["erp_customers"].select(
        F.col("CUSTOMER").alias("KUNNR"), F.col("REGION_CODE").alias("region_code")
    )
    return feeds["erp_sales_order_items"].join(headers, ["VBELN"]).join(customers, ["KUNNR"], "left").select(
        parse_date("AUDAT", "yyyymmdd").alias("day"),
        F.lit("wholesale").alias("channel"),
        "region_code",
        F.col("VBELN").alias("order_id"),
        F.col("KWMENG").cast(QUANTITY).alias("quantity"),
        ledger_money("NETWR").alias("amount"),
        F.col("WAERK").alias("currency"),
        F.lit(True).alias("is_sale"),
        F.lit(None).cast("string").alias("marketing_channel"),
        F.col("MATNR").alias("product"),
    )


def _priced(lines: DataFrame, materials: DataFrame, key: str, fx: DataFrame) -> DataFrame:
    known = materials.select(F.col(key).alias("product"), "standard_cost_nzd", "product_category")
    rates = fx.select(F.col("rate_date").alias("day"), "aud_nzd_rate")
    revenue = to_nzd(F.col("amount"), F.col("currency"), F.col("aud_nzd_rate"))
    cost = F.col("standard_cost_nzd") * F.col("quantity")
    return (
        lines.join(known, ["product"])
        .join(rates, ["day"], "left")
        .select(
            *VALUES,
            "product_category",
            month_of("day").alias("month"),
            revenue.alias("revenue"),
            cost.alias("cost"),
            (revenue - cost).alias("profit"),
        )
    )


def sales(feeds: Mapping[str, DataFrame], materials: DataFrame, fx: DataFrame) -> DataFrame:
    parts = [
        _priced(_store(feeds), materials, "sku", fx),
        _priced(_web(feeds), materials, "sku", fx),
        _priced(_wholesale(feeds), materials, "material_id", fx),
    ]
    return reduce(DataFrame.unionByName, parts)


def monthly_sales(sales_: DataFrame) -> DataFrame:
    """Units are cut to a whole number; lines without a region are in no group."""
    return (
        sales_.filter(F.col("region_code").isNotNull())
        .groupBy("month", F.col("channel").alias("sales_channel"), "region_code")
        .agg(
            distinct_if(F.col("is_sale"), F.col("order_id")).alias("orders"),
            F.coalesce(F.sum("quantity").cast("long"), F.lit(0)).alias("units"),
            *(
                rounded(F.coalesce(F.sum(c), F.lit(0)), 2).alias(name)
                for c, name in (("revenue", "revenue_nzd"), ("cost", "cogs_nzd"), ("profit", "gross_profit_nzd"))
            ),
        )
    )


def monthly_category_margin(sales_: DataFrame) -> DataFrame:
    return (
        sales_.filter(F.col("product_category").isNotNull())
        .groupBy("month", "product_category")
        .agg(F.sum("revenue").alias("r"), F.sum("profit").alias("p"))
        .select(
            "month",
            "product_category",
            rounded(F.coalesce("r", F.lit(0)), 2).alias("revenue_nzd"),
            rounded(F.coalesce("p", F.lit(0)), 2).alias("gross_profit_nzd"),
            round_double(safe_ratio(F.col("p"), F.col("r")), 4).alias("gross_margin"),
        )
    )


def monthly_marketing(web_sales_: DataFrame, spend: DataFrame, fx: DataFrame) -> DataFrame:
    """Months and channels come from the spend alone, so revenue without spend is not reported."""
    keys = ["month", "marketing_channel"]
    rates = fx.withColumnRenamed("rate_date", "spend_date")
    nzd = to_nzd(F.col("spend_local"), F.col("currency"), F.col("aud_nzd_rate").cast("double"))
    spent = (
        spend.join(rates, ["spend_date"], "left")
        .groupBy(month_of("spend_date").alias("month"), "marketing_channel")
        .agg(exact_sum(nzd).alias("spent"))
    )
    paid = web_sales_.filter(F.col("marketing_channel").isin(*seeds.PAID_CHANNELS))
    earned = paid.groupBy(*keys).agg(F.sum("revenue").alias("earned"))
    credit = F.coalesce("earned", F.lit(0))
    return spent.join(earned, keys, "left").select(
        *keys,
        rounded(F.coalesce("spent", F.lit(0)), 2).alias("ad_spend_nzd"),
        rounded(credit, 2).alias("attributed_revenue_nzd"),
        round_double(safe_ratio(credit, F.col("spent")), 4).alias("roas"),
    )


def monthly_delivery(shipments: DataFrame) -> DataFrame:
    """On time when the delivery's date text is not after the promised date text."""
    on_time = F.substring("delivered_at", 1, 10) <= F.col("promised_date")
    return (
        shipments.groupBy(
            F.to_date(F.concat(F.substring("promised_date", 1, 7), F.lit("-01"))).alias("month"),
            F.col("channel").alias("sales_channel"),
        )
        .agg(F.count("*").alias("shipments"), count_if(on_time).alias("on_time_shipments"))
        .withColumn("on_time_rate", round_double(safe_ratio(F.col("on_time_shipments"), F.col("shipments")), 4))
    )


class AsDelivered:
    """The four reports of one landing zone. The lines are priced once; with ``stored`` they are written, for several reports to read."""

    def __init__(self, feeds: Mapping[str, DataFrame], groups: DataFrame, regions: DataFrame, stored: bool = False) -> None:
        self.feeds, self.regions, self.stored = feeds, regions, stored
        self.materials = staging.materials(feeds["erp_materials"], groups)
        self.fx = staging.fx_rates(feeds["erp_fx_rates"])

    @cached_property
    def sales(self) -> DataFrame:
        priced = sales(self.feeds, self.materials, self.fx)
        return written(priced, "sales_as_delivered", codec=FACTS) if self.stored else priced

    def report(self, name: str) -> DataFrame:
        """One report; the lines are priced only for those that read them."""
        feeds = self.feeds
        if name == "monthly_sales":
            return monthly_sales(self.sales)
        if name == "monthly_category_margin":
            return monthly_category_margin(self.sales)
        if name == "monthly_marketing":
            spend = staging.ad_spend(
                feeds["mkt_search_ads"], feeds["mkt_social_ads"], feeds["mkt_other_channels"], self.regions
            )
            return monthly_marketing(self.sales.filter("channel = 'online'"), spend, self.fx)
        if name == "monthly_delivery":
            return monthly_delivery(feeds["logistics_shipments"])
        raise KeyError(name)

    def reports(self) -> dict[str, DataFrame]:
        return {name: self.report(name) for name in REPORTS}
