from __future__ import annotations

from datetime import date
from decimal import Decimal

import shop
from pyspark.sql import functions as F

from tillmark.functions import dates, keys, money
from tillmark.plans import reports, staging


def row(df, **where):
    for column, value in where.items():
        df = df.filter(F.col(column) == value)
    found = df.collect()
    assert len(found) == 1, found
    return found[0]


def test_clean_shop(spark, tmp_path):
    m = shop.models(spark, tmp_path)
    lines = m.fct_sales_lines
    assert lines.count() == 8  # the cancelled web order is not revenue
    au = row(lines, sales_line_id="T-9-1")
    assert (au.revenue_nzd, au.cogs_nzd, au.gross_profit_nzd) == (Decimal("59.4"), Decimal("20"), Decimal("39.4"))
    assert au.fx_rate == Decimal("1.1") and au.product_category == "Cookware"
    bulk = row(m.stg_wholesale_lines, sales_order_id="0000000002")
    assert (bulk.sales_order_line_id, bulk.unit_price, bulk.quantity) == ("0000000002-10", Decimal("10.00"), 10)
    returned = row(m.fct_orders, order_id="T-2")
    assert (returned.order_type, returned.revenue_nzd, returned.revenue_rank_in_day) == ("return", Decimal("-30"), 1)
    assert row(m.attributed_orders, order_id="W-1").is_paid_attribution is True
    assert row(m.attributed_orders, order_id="W-2").is_paid_attribution is False
    spend = row(m.fct_ad_spend, marketing_channel="paid_social")
    assert (spend.spend_id, round(spend.spend_nzd, 6)) == ("2026-03-04|paid_social|SYD|Autumn", 11.0)
    assert row(m.fct_ad_spend, marketing_channel="email").spend_id == "2026-03-03|email|AKL|-"
    late = row(m.fct_shipments, shipment_id="SH-2")
    assert (late.is_on_time, late.days_late) == (False, 2)
    assert m.dim_date.count() == 365 and m.time_spine.count() == 1461
    assert row(m.dim_date, date_day=date(2026, 3, 31)).fiscal_year == 2026
    assert row(m.dim_date, date_day=date(2025, 4, 6)).iso_day_of_week == 7


def test_reports_of_the_clean_shop(spark, tmp_path):
    m = shop.models(spark, tmp_path)
    auckland = row(m.rpt_monthly_sales, sales_channel="store", region_code="AKL")
    assert (auckland.orders, auckland.units, auckland.revenue_nzd) == (1, 2, 42.0)
    email = row(m.rpt_monthly_marketing, marketing_channel="email")
    assert (email.ad_spend_nzd, email.attributed_revenue_nzd, email.roas) == (15.0, 30.0, 2.0)
    display = m.rpt_monthly_marketing.filter("marketing_channel = 'paid_search'").first()
    assert display.roas is None and display.attributed_revenue_nzd == 0.0
    online = row(m.rpt_monthly_delivery, sales_channel="online")
    assert (online.on_time_rate, online.avg_days_late_when_late) == (0.5, 2.0)
    assert {r.difference_nzd for r in m.rpt_ledger_reconciliation.collect()} == {0.0}


def test_duplicates_keep_the_first_copy(spark, tmp_path):
    m = shop.models(spark, tmp_path, shop.duplicate_rows)
    assert m.stg_pos_lines.count() == 4
    audit = row(reports.duplicate_audit(m.feeds["pos_transactions"]), store_id="S01")
    assert (audit.lines_delivered, audit.lines_kept, audit.duplicate_lines_removed, audit.duplicated_takings) == (4, 2, 2, 72.0)


def test_store_currency_wins_over_the_label(spark, tmp_path):
    m = shop.models(spark, tmp_path, shop.currency_mixup)
    line = row(m.stg_pos_lines, store_id="S04")
    assert (line.currency, line.reported_currency) == ("AUD", "NZD")
    assert row(m.fct_sales_lines, sales_line_id="T-9-1").revenue_nzd == Decimal("59.4")


def test_unknown_product_keeps_its_revenue(spark, tmp_path):
    m = shop.models(spark, tmp_path, shop.missing_foreign_key)
    line = row(m.fct_sales_lines, product_id="MAT-9")
    assert line.revenue_nzd == Decimal("80") and line.gross_profit_nzd is None and line.has_cost is False
    assert line.product_category == "Unknown"
    inferred = row(m.dim_products, product_id="MAT-9")
    assert inferred.is_inferred and inferred.description == "Not yet in the material master"
    best = reports.best_products_per_category(m.fct_sales_lines, m.stg_materials)
    assert row(best, product_category="Unknown").description == "Not yet in the material master"


def test_invalid_line_is_quarantined(spark, tmp_path):
    m = shop.models(spark, tmp_path, shop.negative_quantity)
    held = m.quarantined_pos_lines.collect()
    assert [(r.pos_line_id, r.reason) for r in held] == [("T-1-2", "SALE line with a non-positive quantity")]
    day = row(m.rpt_ledger_reconciliation, store_id="S01", business_date=date(2026, 3, 3))
    assert (day.difference_nzd, day.quarantined_lines) == (-12.0, 1)


def test_sale_without_quantity_is_neither_kept_nor_quarantined(spark, tmp_path):
    def forgotten(files):
        files["pos/S01/pos_S01_2026-03.csv"][1][0][6] = ""

    m = shop.models(spark, tmp_path, forgotten)
    assert row(m.stg_pos_lines, pos_line_id="T-1-1").is_valid is None
    assert m.fct_sales_lines.filter("sales_line_id = 'T-1-1'").count() == 0
    assert m.quarantined_pos_lines.count() == 0


def test_day_without_a_rate(spark, tmp_path):
    def no_rates(files):
        files["erp/fx_rates.csv"][1][:] = [["20260304", "NZD", "AUD", "0.9000", shop.FRESH]]

    m = shop.models(spark, tmp_path, no_rates)
    au = row(m.fct_sales_lines, sales_line_id="T-9-1")
    assert au.revenue_nzd is None and au.fx_rate == Decimal("1.0")
    assert row(m.fct_sales_lines, sales_line_id="T-1-1").revenue_nzd == Decimal("60")


def test_undelivered_shipment(spark, tmp_path):
    def on_the_road(files):
        files["logistics/shipments_2026-W10.csv"][1][0][8] = ""

    shipment = row(shop.models(spark, tmp_path, on_the_road).fct_shipments, shipment_id="SH-1")
    assert shipment.is_on_time is None and shipment.days_late == 0


def test_item_without_header(spark, tmp_path):
    def orphan(files):
        files["erp/vbap_2026-03.csv"][1][0][0] = "0000000077"

    m = shop.models(spark, tmp_path, orphan)
    item = row(m.stg_wholesale_lines, sales_order_id="0000000077")
    assert item.order_date is None and item.customer_id is None and item.net_value == Decimal("240")
    assert m.fct_sales_lines.filter("order_id = '0000000077'").count() == 0


def test_one_return_line_makes_the_order_a_return(spark, tmp_path):
    def exchange(files):
        files["pos/S01/pos_S01_2026-03.csv"][1][2][1:3] = ["T-1", "3"]

    m = shop.models(spark, tmp_path, exchange)
    assert row(m.attributed_orders, order_id="T-1").order_type == "return"


def test_expressions(spark):
    one = spark.createDataFrame([("2.600", "594305", "1000", "000010", None)], "q string, p string, u string, i string, n string")
    got = one.select(
        money.quantity_to_int("q").alias("quantity"),
        money.unit_price_per("p", "u").alias("price"),
        money.micros_to_currency(F.lit("1234567")).alias("spend"),
        money.safe_ratio(F.lit(1), F.lit(0)).alias("ratio"),
        money.round_double(F.lit(0.285), 2).alias("low"),
        keys.item_key(F.lit("0001"), F.col("i")).alias("key"),
        keys.line_key(F.lit("a"), F.col("n")).alias("no_key"),
        keys.spend_key(F.lit("d"), F.lit("c"), F.lit("r"), F.col("n")).alias("spend_key"),
        staging.sale_line_is_valid(F.lit("RETURN"), F.lit(-1)).alias("valid"),
        dates.fiscal_year(F.lit(date(2026, 4, 1))).alias("fy"),
        dates.month_diff(F.lit(date(2025, 12, 31)), F.lit(date(2026, 1, 1))).alias("months"),
        dates.iso_week_label(F.lit(date(2027, 1, 1))).alias("week"),
    ).first()
    # the quotient is the double 594.305, which is 59430.49.. cents
    assert got.quantity == 3 and got.price == Decimal("594.30") and got.spend == 1.234567 and got.ratio is None
    assert got.low == 0.28  # 0.285 is stored as a little less
    assert (got.key, got.no_key, got.spend_key) == ("0001-10", None, "d|c|r|-")
    assert got.valid and got.fy == 2027 and got.months == 1 and got.week == "2026-W53"


def test_iso_weeks_match_python(spark):
    days = dates.date_series(spark, date(2019, 12, 20), date(2027, 1, 20))
    monday, sunday = dates.iso_week_bounds("label")
    rows = days.withColumn("label", dates.iso_week_label("date_day")).select("date_day", "label", monday.alias("m"), sunday.alias("s"))
    for r in rows.collect():
        year, week, weekday = r.date_day.isocalendar()
        assert r.label == f"{year}-W{week:02d}"
        assert (r.date_day - r.m).days == weekday - 1 and (r.s - r.m).days == 6


def test_bad_dates_raise(spark):
    import pytest

    with pytest.raises(Exception, match="CANNOT_PARSE|CAST_INVALID|parse"):
        spark.range(1).select(dates.parse_date(F.lit("31/02/2026x"), "dd/mm/yyyy")).collect()
    with pytest.raises(ValueError, match="grain"):
        dates.trunc_to("decade", "x")
