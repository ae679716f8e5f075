"""Staging: raw text feeds to typed rows. Columns are picked by name, so a new column cannot shift the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions import keys
from tillmark.functions.dates import parse_date, parse_timestamp
from tillmark.functions.money import (
    FOREIGN_CURRENCY,
    RATE,
    ledger_money,
    micros_to_currency,
    money,
    quantity_to_int,
    unit_price_per,
)
from tillmark.functions.ordering import ascending
from tillmark.operators.joins import lookup
from tillmark.operators.ranking import first_per_key

REPORTING_CURRENCY = "NZD"


def materials(raw: DataFrame, groups: DataFrame) -> DataFrame:
    named = lookup(raw.withColumnRenamed("MATL_GROUP", "material_group"), groups, ["material_group"])
    return named.select(
        F.col("MATERIAL").alias("material_id"),
        F.col("SKU").alias("sku"),
        F.col("DESCRIPTION").alias("description"),
        "material_group",
        "product_category",
        money("STD_COST_NZD").alias("standard_cost_nzd"),
        money("LIST_PRICE_NZD").alias("list_price_nzd"),
        money("LIST_PRICE_AUD").alias("list_price_aud"),
        parse_date("CREATED_ON", "yyyymmdd").alias("created_on"),
    )


def customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("CUSTOMER").alias("customer_id"),
        F.col("NAME").alias("customer_name"),
        F.col("COUNTRY").alias("country"),
        F.col("REGION_CODE").alias("region_code"),
    )


def stores(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("STORE_ID").alias("store_id"),
        F.col("STORE_NAME").alias("store_name"),
        F.col("REGION_CODE").alias("region_code"),
        F.col("COUNTRY").alias("country"),
        F.col("CURRENCY").alias("currency"),
    )


def fx_rates(raw: DataFrame) -> DataFrame:
    """The day's AUD to NZD rate; other currency pairs are not used."""
    pair = raw.filter((F.col("FROM_CURR") == FOREIGN_CURRENCY) & (F.col("TO_CURR") == REPORTING_CURRENCY))
    return pair.select(
        parse_date("RATE_DATE", "yyyymmdd").alias("rate_date"),
        F.col("RATE").cast(RATE).alias("aud_nzd_rate"),
    )


def ledger_takings(raw: DataFrame) -> DataFrame:
    return raw.select(
        parse_date("POSTING_DATE", "yyyymmdd").alias("posting_date"),
        F.col("STORE_ID").alias("store_id"),
        F.col("GL_ACCOUNT").alias("gl_account"),
        F.col("CURRENCY").alias("currency"),
        ledger_money("AMOUNT_LOCAL").alias("amount_local"),
        ledger_money("AMOUNT_NZD").alias("amount_nzd"),
    )


def first_copies(pos: DataFrame) -> DataFrame:
    """One copy of each till line: the first by file, then extract time.

    Copies inside one file with one extract time are told apart by their remaining columns, so the choice does not
    depend on how the rows are partitioned.
    """
    keys_ = ["transaction_id", "line_no"]
    rest = [c for c in sorted(pos.columns) if c not in (*keys_, "_source_file", "_extracted_at")]
    extracted = parse_timestamp("_extracted_at").asc_nulls_last()
    return first_per_key(pos, keys_, [*ascending("_source_file"), extracted, *ascending(*rest)])


def sale_line_is_valid(txn_type: Column, quantity: Column) -> Column:
    """A SALE needs a positive quantity. A SALE without a quantity is NULL: neither valid nor quarantined."""
    return ~((txn_type == "SALE") & (quantity <= 0))


def pos_lines(raw: DataFrame, stores_: DataFrame) -> DataFrame:
    """Till lines: one copy each, the store's currency instead of the file's label, and the validity flag."""
    kept = first_copies(raw).withColumnRenamed("currency", "reported_currency")
    masters = stores_.select("store_id", "currency")
    quantity = F.col("quantity").cast("int")
    return kept.join(masters, ["store_id"], "left").select(
        keys.line_key(F.col("transaction_id"), F.col("line_no")).alias("pos_line_id"),
        "store_id",
        "transaction_id",
        F.col("line_no").cast("int").alias("line_no"),
        parse_timestamp("txn_ts").alias("txn_ts"),
        parse_timestamp("txn_ts").cast("date").alias("txn_date"),
        "txn_type",
        "sku",
        quantity.alias("quantity"),
        money("unit_price").alias("unit_price"),
        money("discount_amount").alias("discount_amount"),
        money("line_total").alias("line_total"),
        "currency",
        "reported_currency",
        "payment_method",
        sale_line_is_valid(F.col("txn_type"), quantity).alias("is_valid"),
        "_source_file",
    )


def web_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        parse_timestamp("order_ts").alias("order_ts"),
        parse_timestamp("order_ts").cast("date").alias("order_date"),
        "customer_id",
        "site",
        F.col("ship_region").alias("region_code"),
        "marketing_channel",
        "currency",
        "order_status",
        *(money(c).alias(c) for c in ("items_subtotal", "discount_total", "shipping_fee", "order_total")),
    )


def web_order_lines(raw: DataFrame) -> DataFrame:
    return raw.select(
        keys.line_key(F.col("order_id"), F.col("line_no")).alias("order_line_id"),
        "order_id",
        F.col("line_no").cast("int").alias("line_no"),
        "sku",
        F.col("quantity").cast("int").alias("quantity"),
        *(money(c).alias(c) for c in ("unit_price", "discount_amount", "line_total")),
    )


def wholesale_lines(items: DataFrame, headers: DataFrame, *more: str) -> DataFrame:
    """Items with their document header; an item without a header keeps its values and has no date or customer. ``more`` names further
    columns of the header."""
    wanted = headers.select("VBELN", "AUDAT", "VDATU", "KUNNR", *more)
    return items.join(wanted, ["VBELN"], "left").select(
        keys.item_key(F.col("VBELN"), F.col("POSNR")).alias("sales_order_line_id"),
        F.col("VBELN").alias("sales_order_id"),
        F.col("POSNR").cast("int").alias("item"),
        parse_date("AUDAT", "yyyymmdd").alias("order_date"),
        F.col("KUNNR").alias("customer_id"),
        F.col("MATNR").alias("material_id"),
        quantity_to_int("KWMENG").alias("quantity"),
        F.col("VRKME").alias("unit_of_measure"),
        unit_price_per("NETPR", "KPEIN").alias("unit_price"),
        ledger_money("NETWR").alias("net_value"),
        F.col("WAERK").alias("currency"),
        parse_date("VDATU", "yyyymmdd").alias("requested_delivery_date"),
        "_source_file",
        *more,
    )


def shipments(raw: DataFrame) -> DataFrame:
    """Without a delivery ``is_on_time`` is NULL and ``days_late`` is 0."""
    promised = F.col("promised_date").cast("date")
    delivered = parse_timestamp("delivered_at").cast("date")
    return raw.select(
        "shipment_id",
        "order_ref",
        F.col("channel").alias("sales_channel"),
        "carrier",
        "origin_dc",
        F.col("dest_region").alias("region_code"),
        promised.alias("promised_date"),
        parse_timestamp("shipped_at").alias("shipped_at"),
        parse_timestamp("delivered_at").alias("delivered_at"),
        "status",
        "_source_file",
        parse_timestamp("shipped_at").cast("date").alias("shipped_date"),
        delivered.alias("delivered_date"),
        (delivered <= promised).alias("is_on_time"),
        F.greatest(F.datediff(delivered, promised), F.lit(0)).alias("days_late"),
    )


def ad_spend(search: DataFrame, social: DataFrame, other: DataFrame, regions: DataFrame) -> DataFrame:
    """Three ad exports, each with its own dates, amounts and region notation, in one shape."""
    searched = search.select(
        parse_date("date", "yyyy-mm-dd").alias("spend_date"),
        F.lit("paid_search").alias("marketing_channel"),
        F.split_part("geo_target", F.lit("-"), F.lit(2)).alias("region_code"),
        "campaign_name",
        "currency",
        micros_to_currency("cost_micros").alias("spend_local"),
        F.col("impressions").cast("long").alias("impressions"),
        F.col("clicks").cast("long").alias("clicks"),
        F.lit("search_ads").alias("source_platform"),
    )
    by_name = regions.select(F.col("region_name").alias("region"), "region_code")
    shared = lookup(social, by_name, ["region"]).select(
        parse_date("day", "dd/mm/yyyy").alias("spend_date"),
        F.lit("paid_social").alias("marketing_channel"),
        "region_code",
        "campaign_name",
        "currency",
        F.col("amount_spent").cast("double").alias("spend_local"),
        F.col("reach").cast("long").alias("impressions"),
        F.col("link_clicks").cast("long").alias("clicks"),
        F.lit("social_ads").alias("source_platform"),
    )
    remaining = other.select(
        parse_date("date", "yyyy-mm-dd").alias("spend_date"),
        F.col("channel").alias("marketing_channel"),
        "region_code",
        F.lit(None).cast("string").alias("campaign_name"),
        "currency",
        F.col("spend").cast("double").alias("spend_local"),
        F.lit(None).cast("long").alias("impressions"),
        F.lit(None).cast("long").alias("clicks"),
        F.lit("other_channels").alias("source_platform"),
    )
    return searched.unionByName(shared).unionByName(remaining)
