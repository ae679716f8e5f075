"""A tiny landing zone written by hand, clean or with one of six known faults."""

from __future__ import annotations

import csv
from copy import deepcopy
from datetime import datetime
from pathlib import Path

from tillmark.plans.models import Models
from tillmark.sources.feeds import FEEDS, load_feeds

AS_OF = datetime(2026, 4, 1, 6, 0, 0)
FRESH = "2026-04-01 02:00:00"
RATE = "1.1000"

POS = ["store_id", "transaction_id", "line_no", "txn_ts", "txn_type", "sku", "quantity", "unit_price"]
POS += ["discount_amount", "line_total", "currency", "payment_method", "_extracted_at"]
WEB = ["order_id", "order_ts", "customer_id", "site", "ship_region", "marketing_channel", "currency"]
WEB += ["order_status", "items_subtotal", "discount_total", "shipping_fee", "order_total", "_extracted_at"]

Table = tuple[list[str], list[list[str]]]


def clean() -> dict[str, Table]:
    def pos(store, ticket, line, day, kind, sku, qty, total, currency):
        return [store, ticket, line, f"{day} 10:00:00", kind, sku, qty, "10.00", "0.00", total, currency, "card", FRESH]

    def web(order, day, customer, region, channel, currency, status, total):
        site = "AU" if currency == "AUD" else "NZ"
        return [order, f"{day} 09:00:00", customer, site, region, channel, currency, status, total, "0.00", "5.00", total, FRESH]

    return {
        "erp/materials.csv": (
            ["MATERIAL", "SKU", "DESCRIPTION", "MATL_GROUP", "STD_COST_NZD", "LIST_PRICE_NZD", "LIST_PRICE_AUD", "CREATED_ON", "_extracted_at"],
            [
                ["MAT-1", "SKU-1", "Pan", "CW", "10.00", "30.00", "27.00", "20250101", FRESH],
                ["MAT-2", "SKU-2", "Tin, large", "BW", "4.50", "12.00", "11.00", "20250102", FRESH],
            ],
        ),
        "erp/customers.csv": (
            ["CUSTOMER", "NAME", "COUNTRY", "REGION_CODE", "_extracted_at"],
            [["C-1", "Corner Shop", "NZ", "WLG", FRESH], ["C-2", "Harbour Goods", "AU", "MEL", FRESH]],
        ),
        "erp/stores.csv": (
            ["STORE_ID", "STORE_NAME", "REGION_CODE", "COUNTRY", "CURRENCY", "_extracted_at"],
            [["S01", "Queen St", "AKL", "NZ", "NZD", FRESH], ["S04", "George St", "SYD", "AU", "AUD", FRESH]],
        ),
        "erp/fx_rates.csv": (
            ["RATE_DATE", "FROM_CURR", "TO_CURR", "RATE", "_extracted_at"],
            [[d, "AUD", "NZD", RATE, FRESH] for d in ("20260303", "20260304", "20260305", "20260310")],
        ),
        "erp/gl_store_takings_2026-03.csv": (
            ["POSTING_DATE", "STORE_ID", "GL_ACCOUNT", "CURRENCY", "AMOUNT_LOCAL", "AMOUNT_NZD", "_extracted_at"],
            [
                ["20260303", "S01", "400000", "NZD", "72.00", "72.00", FRESH],
                ["20260304", "S01", "400000", "NZD", "-30.00", "-30.00", FRESH],
                ["20260303", "S04", "400000", "AUD", "54.00", "59.40", FRESH],
            ],
        ),
        "erp/vbak_2026-03.csv": (
            ["VBELN", "AUART", "VKORG", "VTWEG", "SPART", "AUDAT", "VDATU", "KUNNR", "WAERK", "NETWR", "_extracted_at"],
            [
                ["0000000001", "OR", "1000", "10", "00", "20260305", "20260312", "C-1", "NZD", "240.00", FRESH],
                ["0000000002", "OR", "1000", "10", "00", "20260305", "20260312", "C-2", "AUD", "100.00", FRESH],
            ],
        ),
        "erp/vbap_2026-03.csv": (
            ["VBELN", "POSNR", "MATNR", "KWMENG", "VRKME", "NETPR", "KPEIN", "NETWR", "WAERK", "_extracted_at"],
            [
                ["0000000001", "000010", "MAT-1", "12.000", "EA", "20.00", "1", "240.00", "NZD", FRESH],
                ["0000000002", "000010", "MAT-2", "10.000", "EA", "100.00", "10", "100.00", "AUD", FRESH],
            ],
        ),
        "pos/S01/pos_S01_2026-03.csv": (
            POS,
            [
                pos("S01", "T-1", "1", "2026-03-03", "SALE", "SKU-1", "2", "60.00", "NZD"),
                pos("S01", "T-1", "2", "2026-03-03", "SALE", "SKU-2", "1", "12.00", "NZD"),
                pos("S01", "T-2", "1", "2026-03-04", "RETURN", "SKU-1", "-1", "-30.00", "NZD"),
            ],
        ),
        "pos/S04/pos_S04_2026-03.csv": (
            POS,
            [pos("S04", "T-9", "1", "2026-03-03", "SALE", "SKU-1", "2", "54.00", "AUD")],
        ),
        "ecommerce/orders_2026-03.csv": (
            WEB,
            [
                web("W-1", "2026-03-03", "U-1", "AKL", "email", "NZD", "completed", "30.00"),
                web("W-2", "2026-03-04", "U-1", "SYD", "organic", "AUD", "completed", "27.00"),
                web("W-3", "2026-03-05", "U-2", "AKL", "display", "NZD", "cancelled", "12.00"),
            ],
        ),
        "ecommerce/order_lines_2026-03.csv": (
            ["order_id", "line_no", "sku", "quantity", "unit_price", "discount_amount", "line_total", "_extracted_at"],
            [
                ["W-1", "1", "SKU-1", "1", "30.00", "0.00", "30.00", FRESH],
                ["W-2", "1", "SKU-1", "1", "27.00", "0.00", "27.00", FRESH],
                ["W-3", "1", "SKU-2", "1", "12.00", "0.00", "12.00", FRESH],
            ],
        ),
        "logistics/shipments_2026-W10.csv": (
            ["shipment_id", "order_ref", "channel", "carrier", "origin_dc", "dest_region", "promised_date", "shipped_at", "delivered_at", "status", "_extracted_at"],
            [
                ["SH-1", "W-1", "online", "Swift", "DC1", "AKL", "2026-03-06", "2026-03-04 08:00:00", "2026-03-06 18:00:00", "delivered", FRESH],
                ["SH-2", "W-2", "online", "Swift", "DC1", "SYD", "2026-03-08", "2026-03-05 08:00:00", "2026-03-10 09:00:00", "delivered", FRESH],
                ["SH-3", "0000000001", "wholesale", "Haul", "DC1", "WLG", "2026-03-12", "2026-03-06 08:00:00", "2026-03-11 09:00:00", "delivered", FRESH],
            ],
        ),
        "marketing/search_ads_2026-03.csv": (
            ["date", "campaign_id", "campaign_name", "geo_target", "currency", "cost_micros", "impressions", "clicks", "_extracted_at"],
            [["2026-03-03", "1", "Autumn", "NZ-AKL", "NZD", "12500000", "1000", "20", FRESH]],
        ),
        "marketing/social_ads_2026-03.csv": (
            ["day", "campaign_name", "region", "amount_spent", "currency", "reach", "link_clicks", "_extracted_at"],
            [["04/03/2026", "Autumn", "Sydney", "10.00", "AUD", "500", "5", FRESH]],
        ),
        "marketing/other_channels_2026-03.csv": (
            ["date", "channel", "region_code", "spend", "currency", "_extracted_at"],
            [["2026-03-03", "email", "AKL", "15.00", "NZD", FRESH]],
        ),
    }


def duplicate_rows(files):
    columns, rows = files["pos/S01/pos_S01_2026-03.csv"]
    rows.extend(deepcopy(rows[:2]))


def negative_quantity(files):
    columns, rows = files["pos/S01/pos_S01_2026-03.csv"]
    rows[1][6], rows[1][9] = "-1", "-12.00"


def currency_mixup(files):
    for row in files["pos/S04/pos_S04_2026-03.csv"][1]:
        row[10] = "NZD"


def missing_foreign_key(files):
    files["erp/vbap_2026-03.csv"][1].append(
        ["0000000001", "000020", "MAT-9", "1.000", "EA", "80.00", "1", "80.00", "NZD", FRESH]
    )


def schema_drift(files):
    columns, rows = files["ecommerce/orders_2026-03.csv"]
    late = WEB[:6] + ["promo_code"] + WEB[6:]
    order = ["W-4", "2026-03-05 09:00:00", "U-3", "NZ", "AKL", "organic", "SUMMER15", "NZD", "cancelled", "1.00", "0.00", "5.00", "1.00", FRESH]
    files["ecommerce/orders_2026-04.csv"] = (late, [order])


def late_file(files):
    columns, rows = files["logistics/shipments_2026-W10.csv"]
    del rows[1]
    for row in rows:
        row[-1] = "2026-03-24 01:00:00"


FAULTS = [late_file, duplicate_rows, schema_drift, currency_mixup, missing_foreign_key, negative_quantity]


def deliver(root: Path, *faults) -> Path:
    files = clean()
    for fault in faults:
        fault(files)
    for name, (columns, rows) in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("w", newline="") as f:
            csv.writer(f).writerows([columns, *rows])
    return root


def models(spark, root: Path, *faults) -> Models:
    deliver(root, *faults)
    return Models(spark, load_feeds(spark, str(root), FEEDS), AS_OF)
