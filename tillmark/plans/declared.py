"""The checks declared on feeds, staging and marts, and which of them are meant to catch which kind of incident."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions.dates import parse_date, parse_timestamp
from tillmark.functions.money import ledger_money, money, rounded, to_nzd
from tillmark.operators.joins import full_on, without_match
from tillmark.plans import checks
from tillmark.plans.checks import (
    DETECT,
    Check,
    Freshness,
    accepted_values,
    expression,
    not_null,
    relationships,
    unique,
)
from tillmark.plans.marts import completed
from tillmark.plans.models import Models
from tillmark.sources import seeds

SHIPMENT_LAG_DAYS = 12
TOLERANCE_NZD = 0.05

CURRENCIES = ("NZD", "AUD")
PAID = tuple(seeds.PAID_CHANNELS)
ALL_MARKETING = tuple(row[0] for row in seeds.MARKETING_CHANNELS)
GROUPS = tuple(row[0] for row in seeds.MATERIAL_GROUPS)
CATEGORIES = (*(row[1] for row in seeds.MATERIAL_GROUPS), "Unknown")

WARN = {"severity": "warn", "tags": (DETECT,)}


def _key(relation: str, column: str) -> list[Check]:
    return [unique(relation, column), not_null(relation, column)]


RAW_CHECKS = [
    *_key("erp_materials", "MATERIAL"),
    *_key("erp_materials", "SKU"),
    accepted_values("erp_materials", "MATL_GROUP", *GROUPS),
    *_key("erp_customers", "CUSTOMER"),
    *_key("erp_stores", "STORE_ID"),
    accepted_values("erp_stores", "CURRENCY", *CURRENCIES),
    *_key("erp_fx_rates", "RATE_DATE"),
    not_null("erp_sales_order_items", "MATNR"),
    relationships(
        "erp_sales_order_items", "MATNR", "erp_materials", "MATERIAL", "erp_sales_order_material_exists", **WARN
    ),
    accepted_values("erp_sales_order_items", "WAERK", *CURRENCIES),
    unique("pos_transactions", "transaction_id || '-' || line_no", "pos_transaction_line_is_unique", **WARN),
    expression(
        "pos_transactions",
        "cast(quantity as integer) > 0",
        "pos_sale_quantity_is_positive",
        where="txn_type = 'SALE'",
        **WARN,
    ),
    accepted_values("pos_transactions", "txn_type", "SALE", "RETURN"),
    accepted_values("pos_transactions", "currency", *CURRENCIES),
    relationships("pos_transactions", "store_id", "erp_stores", "STORE_ID"),
    *_key("ecom_orders", "order_id"),
    accepted_values("ecom_orders", "order_status", "completed", "cancelled"),
    accepted_values("ecom_orders", "marketing_channel", *ALL_MARKETING),
    relationships("ecom_order_lines", "order_id", "ecom_orders", "order_id"),
    *_key("logistics_shipments", "shipment_id"),
    accepted_values("logistics_shipments", "channel", "online", "wholesale"),
]

STAGING_CHECKS = [
    *_key("stg_materials", "material_id"),
    *_key("stg_customers", "customer_id"),
    *_key("stg_stores", "store_id"),
    *_key("stg_fx_rates", "rate_date"),
    *_key("stg_wholesale_lines", "sales_order_line_id"),
    *_key("stg_pos_lines", "pos_line_id"),
    accepted_values("stg_pos_lines", "currency", *CURRENCIES),
    *_key("stg_web_orders", "order_id"),
    *_key("stg_web_order_lines", "order_line_id"),
    *_key("stg_shipments", "shipment_id"),
    accepted_values("stg_ad_spend", "marketing_channel", *PAID),
    not_null("stg_ad_spend", "region_code"),
    relationships("stg_ad_spend", "region_code", "dim_regions", "region_code"),
    *_key("int_sales_lines", "sales_line_id"),
]

MART_CHECKS = [
    *_key("dim_date", "date_day"),
    *_key("dim_regions", "region_code"),
    *_key("dim_sales_channels", "sales_channel"),
    *_key("dim_marketing_channels", "marketing_channel"),
    *_key("dim_stores", "store_id"),
    *_key("dim_products", "product_id"),
    accepted_values("dim_products", "product_category", *CATEGORIES),
    expression(
        "fct_sales_lines", "quantity > 0", "fct_sales_lines_sale_quantity_is_positive", where="order_type = 'sale'"
    ),
    *_key("fct_sales_lines", "sales_line_id"),
    not_null("fct_sales_lines", "revenue_nzd"),
    relationships("fct_sales_lines", "sales_channel", "dim_sales_channels", "sales_channel"),
    not_null("fct_sales_lines", "region_code"),
    relationships("fct_sales_lines", "region_code", "dim_regions", "region_code"),
    not_null("fct_sales_lines", "product_id"),
    relationships("fct_sales_lines", "product_id", "dim_products", "product_id"),
    accepted_values("fct_sales_lines", "order_type", "sale", "return"),
    *_key("attributed_orders", "order_id"),
    relationships("attributed_orders", "marketing_channel", "dim_marketing_channels", "marketing_channel"),
    *_key("fct_ad_spend", "spend_id"),
    not_null("fct_ad_spend", "spend_nzd"),
    *_key("fct_shipments", "shipment_id"),
    relationships("fct_shipments", "region_code", "dim_regions", "region_code"),
]

DECLARED = [*RAW_CHECKS, *STAGING_CHECKS, *MART_CHECKS]

# Checks that compare several relations; they count as one failing row per row returned.
NAMED = {
    "recon_pos_raw_vs_finance": Check("recon_pos_raw_vs_finance", "query", "", "", **WARN),
    "recon_pos_mart_vs_finance": Check("recon_pos_mart_vs_finance", "query", "", ""),
    "recon_online_orders_vs_shipments": Check("recon_online_orders_vs_shipments", "query", "", "", **WARN),
    "assert_pos_currency_matches_store": Check("assert_pos_currency_matches_store", "query", "", "", **WARN),
}

CONTRACT_CHECK = Check("ecom_orders_columns_match_contract", "query", "", "", **WARN)

# The columns agreed for the web order export.
WEB_ORDER_CONTRACT = [
    "order_id",
    "order_ts",
    "customer_id",
    "site",
    "ship_region",
    "marketing_channel",
    "currency",
    "order_status",
    "items_subtotal",
    "discount_total",
    "shipping_fee",
    "order_total",
    "_extracted_at",
    "_source_file",
]

MASTER_DATA = Freshness(1, 2)
FRESHNESS = {
    "erp_materials": MASTER_DATA,
    "erp_customers": MASTER_DATA,
    "erp_stores": MASTER_DATA,
    "erp_fx_rates": MASTER_DATA,
    "logistics_shipments": Freshness(7, 8),
}

# The checks meant for each kind of incident, and whether their rows must point at the incident.
MEANT_FOR = {
    "late_file": (["freshness:raw.logistics_shipments", "recon_online_orders_vs_shipments"], False),
    "duplicate_rows": (["pos_transaction_line_is_unique", "recon_pos_raw_vs_finance"], True),
    "schema_drift": (["ecom_orders_columns_match_contract"], True),
    "currency_mixup": (["assert_pos_currency_matches_store", "recon_pos_raw_vs_finance"], True),
    "missing_foreign_key": (["erp_sales_order_material_exists"], True),
    "negative_quantity": (["pos_sale_quantity_is_positive", "recon_pos_raw_vs_finance"], True),
}


def relation_of(models: Models) -> Callable[[str], DataFrame]:
    """Feeds and relations under one set of names."""
    return lambda name: models.feeds[name] if name in models.feeds else getattr(models, name)


def currency_label(pos: DataFrame, stores: DataFrame) -> DataFrame:
    """Till files whose currency label is not the store's, per file, store and label."""
    label = pos.withColumnRenamed("currency", "reported_currency")
    masters = stores.select("store_id", F.col("currency").alias("store_currency"))
    keys = ["_source_file", "store_id", "store_currency", "reported_currency"]
    tallied = label.groupBy("_source_file", "store_id", "reported_currency").agg(F.count("*").alias("n"))
    wrong = tallied.join(masters, ["store_id"]).filter(F.col("reported_currency") != F.col("store_currency"))
    return wrong.groupBy(*keys).agg(F.sum("n").alias("lines"))


def raw_vs_ledger(pos: DataFrame, fx: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tills as delivered, by their own label, against the ledger per store-day; differences above the tolerance."""
    keys = ["store_id", "business_date"]
    day = parse_timestamp("txn_ts").cast("date").alias("business_date")
    lines = pos.select("store_id", day, "currency", money("line_total").alias("amount"))
    rates = fx.withColumnRenamed("rate_date", "business_date")
    # one row per store, day and label is left to be converted
    sums = lines.groupBy(*keys, "currency").agg(F.sum("amount").alias("amount")).join(rates, ["business_date"], "left")
    tills = sums.groupBy(*keys).agg(F.sum(to_nzd(F.col("amount"), F.col("currency"), F.col("aud_nzd_rate"))).alias("till"))
    booked = ledger.select(
        F.col("STORE_ID").alias("store_id"),
        parse_date("POSTING_DATE", "yyyymmdd").alias("business_date"),
        ledger_money("AMOUNT_NZD").alias("amount"),
    )
    booked = booked.groupBy(*keys).agg(F.sum("amount").alias("booked"))
    gap = F.coalesce("till", F.lit(0)) - F.coalesce("booked", F.lit(0))
    return (
        full_on(tills, booked, keys)
        .filter(F.abs(gap) > F.lit(str(TOLERANCE_NZD)).cast("decimal(4,2)"))
        .select(
            *keys,
            rounded(F.col("till"), 2).alias("pos_nzd"),
            F.col("booked").cast("double").alias("ledger_nzd"),
            rounded(gap, 2).alias("difference_nzd"),
        )
    )


def mart_vs_ledger(reconciliation: DataFrame) -> DataFrame:
    """Store-days that still differ after cleaning although nothing was held back."""
    return reconciliation.filter((F.abs("difference_nzd") > TOLERANCE_NZD) & (F.col("quarantined_lines") == 0))


def unshipped(web_orders: DataFrame, cutoff: Column) -> DataFrame:
    return completed(web_orders).filter(F.col("order_date") <= cutoff).select("order_id", "order_date")


def orders_vs_shipments(web_orders: DataFrame, shipments: DataFrame, cutoff: Column) -> DataFrame:
    """Completed web orders past the carrier's lag without any shipment, per order date."""
    shipped = shipments.select(F.col("order_ref").alias("order_id"))
    return (
        without_match(unshipped(web_orders, cutoff), shipped, ["order_id"])
        .groupBy("order_date")
        .agg(F.count("*").alias("orders_without_shipment"))
    )


def named_failures(models: Models) -> dict[str, DataFrame]:
    cutoff = F.date_sub(F.lit(models.as_of.date()), SHIPMENT_LAG_DAYS)
    feeds = models.feeds
    return {
        "recon_pos_raw_vs_finance": raw_vs_ledger(
            feeds["pos_transactions"], models.stg_fx_rates, feeds["erp_gl_store_takings"]
        ),
        "recon_pos_mart_vs_finance": mart_vs_ledger(models.rpt_ledger_reconciliation),
        "recon_online_orders_vs_shipments": orders_vs_shipments(models.stg_web_orders, models.stg_shipments, cutoff),
        "assert_pos_currency_matches_store": currency_label(feeds["pos_transactions"], models.stg_stores),
    }


def findings(models: Models, contract_failures: DataFrame | None = None) -> DataFrame:
    """The failing rows of every declared and named check, see ``checks.findings``."""
    named = named_failures(models)
    if contract_failures is not None:
        named[CONTRACT_CHECK.name] = contract_failures
    parts = [checks.findings(DECLARED, relation_of(models)), *(checks.as_findings(n, rows) for n, rows in named.items())]
    return reduce(DataFrame.unionByName, parts)


def all_checks(with_contract: bool) -> list[Check]:
    return [*DECLARED, *NAMED.values(), *([CONTRACT_CHECK] if with_contract else [])]


def results(models: Models, found: DataFrame, with_contract: bool = True) -> DataFrame:
    """``dq_results`` of every declared and named check, from the findings (stored ones where they are stored)."""
    fresh = checks.freshness(models.feeds, models.as_of, FRESHNESS)
    return checks.results(models.spark, all_checks(with_contract), checks.failing_rows(found), fresh)


def incident_mapping(models: Models) -> DataFrame:
    rows = [(kind, name, needs) for kind, (names, needs) in MEANT_FOR.items() for name in names]
    return seeds.local_table(models.spark, ["kind", "name", "needs_evidence"], rows)


def evidence(found: DataFrame) -> DataFrame:
    """(kind, place, rows) of the findings that can prove an incident."""
    field = lambda name: F.get_json_object("row_json", f"$.{name}")
    month = F.regexp_extract(field("_source_file"), r"(\d{4}-\d{2})\.csv$", 1)
    places = {
        "duplicate_rows": ("recon_pos_raw_vs_finance", F.concat_ws("|", field("store_id"), field("business_date"))),
        "currency_mixup": ("assert_pos_currency_matches_store", F.concat_ws("|", field("store_id"), month)),
        "missing_foreign_key": ("erp_sales_order_material_exists", field("from_field")),
        "negative_quantity": ("pos_sale_quantity_is_positive", field("transaction_id")),
        "schema_drift": (CONTRACT_CHECK.name, field("column_name")),
    }
    shown = [F.when(F.col("name") == name, F.struct(F.lit(kind).alias("kind"), place.alias("place"))) for kind, (name, place) in places.items()]
    proof = found.filter(F.col("name").isin(*(name for name, _ in places.values())))
    return proof.select(F.coalesce(*shown).alias("p"), F.col("copies").alias("rows")).select("p.kind", "p.place", "rows")
