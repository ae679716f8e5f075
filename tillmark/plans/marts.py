"""Intermediate relations and marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions import keys
from tillmark.functions.dates import calendar_columns
from tillmark.functions.money import to_nzd
from tillmark.operators.joins import lookup, without_match
from tillmark.operators.ranking import number_rows

# Texts that the marts carry.
QUARANTINE_REASON = "SALE line with a non-positive quantity"
UNKNOWN_CATEGORY = "Unknown"
INFERRED_DESCRIPTION = "Not yet in the material master"

LINE_COLUMNS = [
    "sales_line_id",
    "order_id",
    "sales_channel",
    "store_id",
    "order_date",
    "region_code",
    "product_id",
    "quantity",
    "amount_local",
    "currency",
    "order_type",
    "marketing_channel",
]


def quarantined_pos_lines(pos: DataFrame) -> DataFrame:
    """Till lines held back by the validity rule, with the reason."""
    return pos.filter(~F.col("is_valid")).select(
        "pos_line_id",
        "store_id",
        "transaction_id",
        "line_no",
        "txn_date",
        "txn_type",
        "sku",
        "quantity",
        "line_total",
        "currency",
        F.lit(QUARANTINE_REASON).alias("reason"),
        "_source_file",
    )


def order_type_of(txn_type: Column) -> Column:
    return F.when(txn_type == "RETURN", "return").otherwise("sale")


def completed(web_orders: DataFrame) -> DataFrame:
    return web_orders.filter(F.col("order_status") == "completed")


def _absent(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def store_lines(pos: DataFrame, stores: DataFrame) -> DataFrame:
    return pos.filter("is_valid").join(stores.select("store_id", "region_code"), ["store_id"]).select(
        F.col("pos_line_id").alias("sales_line_id"),
        F.col("transaction_id").alias("order_id"),
        F.lit("store").alias("sales_channel"),
        "store_id",
        F.col("txn_date").alias("order_date"),
        "region_code",
        "sku",
        "quantity",
        F.col("line_total").alias("amount_local"),
        "currency",
        order_type_of(F.col("txn_type")).alias("order_type"),
        _absent("marketing_channel"),
    )


def online_lines(web_lines: DataFrame, web_orders: DataFrame) -> DataFrame:
    """Lines of completed web orders; a cancelled order is not revenue."""
    headers = completed(web_orders).select("order_id", "order_date", "region_code", "currency", "marketing_channel")
    return web_lines.join(headers, ["order_id"]).select(
        F.col("order_line_id").alias("sales_line_id"),
        "order_id",
        F.lit("online").alias("sales_channel"),
        _absent("store_id"),
        "order_date",
        "region_code",
        "sku",
        "quantity",
        F.col("line_total").alias("amount_local"),
        "currency",
        F.lit("sale").alias("order_type"),
        "marketing_channel",
    )


def wholesale_sales(wholesale: DataFrame, customers: DataFrame) -> DataFrame:
    return located_sales(wholesale.join(customers.select("customer_id", "region_code"), ["customer_id"]))


def located_headers(headers: DataFrame, customers: DataFrame) -> DataFrame:
    """The wholesale headers of known customers with their region. A document has many lines, so the region travels with its header."""
    known = customers.select(F.col("customer_id").alias("KUNNR"), "region_code")
    return headers.select("VBELN", "AUDAT", "VDATU", "KUNNR").join(known, ["KUNNR"])


def located_sales(wholesale: DataFrame) -> DataFrame:
    """Wholesale lines with a region as sales; without a customer they are none."""
    return wholesale.filter(F.col("customer_id").isNotNull()).select(
        F.col("sales_order_line_id").alias("sales_line_id"),
        F.col("sales_order_id").alias("order_id"),
        F.lit("wholesale").alias("sales_channel"),
        _absent("store_id"),
        "order_date",
        "region_code",
        F.col("material_id").alias("product_id"),
        "quantity",
        F.col("net_value").alias("amount_local"),
        "currency",
        F.lit("sale").alias("order_type"),
        _absent("marketing_channel"),
    )


def priced_lines(
    store: DataFrame, online: DataFrame, wholesale: DataFrame, materials: DataFrame, fx: DataFrame
) -> DataFrame:
    """Lines of the three channels in one shape, in NZD, with the material's cost and category.

    The material is looked up once per line: by SKU for tills and web shop, by material number for wholesale. That
    one match gives the product number, the cost and the category, so nothing has to be joined to the products again.
    """
    known = [F.col("standard_cost_nzd"), F.col("product_category"), F.lit(True).alias("has_cost")]
    by_sku = materials.filter(F.col("material_id").isNotNull()).select("sku", F.col("material_id").alias("product_id"), *known)
    by_number = materials.select(F.col("material_id").alias("product_id"), *known)
    retail = store.unionByName(online).join(by_sku, ["sku"], "left").drop("sku")
    lines = retail.unionByName(wholesale.join(by_number, ["product_id"], "left"))

    rates = fx.select(F.col("rate_date").alias("order_date"), "aud_nzd_rate")
    rate = F.col("aud_nzd_rate")
    category = F.when(F.col("product_id").isNotNull(), F.coalesce("product_category", F.lit(UNKNOWN_CATEGORY)))
    return lines.join(rates, ["order_date"], "left").select(
        *LINE_COLUMNS,
        F.coalesce(rate, F.lit("1.0").cast("decimal(10,4)")).alias("fx_rate"),
        to_nzd(F.col("amount_local"), F.col("currency"), rate).alias("revenue_nzd"),
        (F.col("standard_cost_nzd") * F.col("quantity")).alias("cogs_nzd"),
        F.coalesce("has_cost", F.lit(False)).alias("has_cost"),
        category.alias("product_category"),
    )


def sales_lines(priced: DataFrame) -> DataFrame:
    return priced.drop("product_category")


def sales_orders(priced: DataFrame) -> DataFrame:
    """One row per order and channel. One return line makes the whole order a return."""
    firsts = ("store_id", "order_date", "region_code", "order_type", "marketing_channel")
    return priced.groupBy("order_id", "sales_channel").agg(
        *(F.min(c).alias(c) for c in firsts),
        F.count("*").alias("line_count"),
        F.sum("quantity").alias("units"),
        F.sum("revenue_nzd").alias("revenue_nzd"),
    )


def spend_nzd(spend: DataFrame, fx: DataFrame) -> DataFrame:
    """Ad spend at the rate of the same day."""
    rates = fx.withColumnRenamed("rate_date", "spend_date")
    converted = to_nzd(F.col("spend_local"), F.col("currency"), F.col("aud_nzd_rate").cast("double"))
    return spend.join(rates, ["spend_date"], "left").withColumn("spend_nzd", converted).drop("aud_nzd_rate")


def fct_sales_lines(priced: DataFrame, *more: str) -> DataFrame:
    return priced.select(
        "sales_line_id",
        "order_id",
        "order_date",
        "sales_channel",
        "store_id",
        "region_code",
        "product_id",
        "product_category",
        "order_type",
        (F.col("order_type") == "return").alias("is_return"),
        "quantity",
        F.col("currency").alias("source_currency"),
        "amount_local",
        "fx_rate",
        "revenue_nzd",
        "cogs_nzd",
        F.when(F.col("has_cost"), F.col("revenue_nzd") - F.col("cogs_nzd")).alias("gross_profit_nzd"),
        "has_cost",
        *more,
    )


def attributed_orders(orders: DataFrame, channels: DataFrame, *more: str) -> DataFrame:
    """Orders with the flag whether a paid channel gets the credit; no channel counts as unpaid."""
    paid = channels.select("marketing_channel", "is_paid")
    return lookup(orders, paid, ["marketing_channel"]).select(
        "order_id",
        "order_date",
        "sales_channel",
        "store_id",
        "region_code",
        "order_type",
        "marketing_channel",
        F.coalesce("is_paid", F.lit(False)).alias("is_paid_attribution"),
        "line_count",
        "units",
        "revenue_nzd",
        *more,
    )


def fct_orders(orders: DataFrame, channels: DataFrame) -> DataFrame:
    """Orders with their place in the channel's day, largest revenue first.

    Reports and metrics read ``attributed_orders``: only the stored mart needs the place, which costs a sort.
    """
    return number_rows(
        attributed_orders(orders, channels),
        ["sales_channel", "order_date"],
        [("revenue_nzd", True), ("order_id", False)],
        "revenue_rank_in_day",
    )


def fct_ad_spend(spend: DataFrame) -> DataFrame:
    key = keys.spend_key(
        F.col("spend_date"), F.col("marketing_channel"), F.col("region_code"), F.col("campaign_name")
    )
    return spend.select(
        key.alias("spend_id"),
        "spend_date",
        "marketing_channel",
        "region_code",
        "campaign_name",
        "source_platform",
        F.col("currency").alias("billing_currency"),
        "spend_local",
        "spend_nzd",
        "impressions",
        "clicks",
    )


def fct_shipments(shipments: DataFrame) -> DataFrame:
    return shipments.select(
        "shipment_id",
        F.col("order_ref").alias("order_id"),
        "sales_channel",
        "carrier",
        "origin_dc",
        "region_code",
        "shipped_date",
        "promised_date",
        "delivered_date",
        "is_on_time",
        "days_late",
    )


def missing_products(priced: DataFrame, materials: DataFrame) -> DataFrame:
    """Sold product numbers that the material master does not have; reduced to one row each before the join."""
    sold = priced.filter(F.col("product_id").isNotNull() & ~F.col("has_cost")).select("product_id").distinct()
    return without_match(sold, materials.select(F.col("material_id").alias("product_id")), ["product_id"])


def dim_products(materials: DataFrame, missing: DataFrame) -> DataFrame:
    """The material master, plus an inferred row for every product sold without being in it."""
    price = "decimal(12,2)"
    master = materials.select(
        F.col("material_id").alias("product_id"),
        "sku",
        "description",
        F.coalesce("product_category", F.lit(UNKNOWN_CATEGORY)).alias("product_category"),
        "standard_cost_nzd",
        "list_price_nzd",
        "list_price_aud",
        "created_on",
        F.lit(False).alias("is_inferred"),
    )
    inferred = missing.select(
        "product_id",
        _absent("sku"),
        F.lit(INFERRED_DESCRIPTION).alias("description"),
        F.lit(UNKNOWN_CATEGORY).alias("product_category"),
        *(F.lit(None).cast(price).alias(c) for c in ("standard_cost_nzd", "list_price_nzd", "list_price_aud")),
        F.lit(None).cast("date").alias("created_on"),
        F.lit(True).alias("is_inferred"),
    )
    return master.unionByName(inferred)


def dim_date(days: DataFrame) -> DataFrame:
    return days.select("date_day", *calendar_columns("date_day"))
