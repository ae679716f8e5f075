"""Every relation by name, built lazily from the raw feeds.

A relation is a DataFrame; asking for one builds only what it needs. ``replace`` swaps a relation for a stored copy,
so that reports read a written mart instead of recomputing it.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tillmark.functions.dates import MONTH, date_series, month_of
from tillmark.plans import marts, reports, staging
from tillmark.sources import seeds
from tillmark.sources.shared import FACTS, written

FISCAL_YEAR = (date(2025, 4, 1), date(2026, 3, 31))
TIME_SPINE = (date(2024, 1, 1), date(2027, 12, 31))


class Models:
    def __init__(
        self,
        spark: SparkSession,
        feeds: Mapping[str, DataFrame],
        as_of: datetime,
        calendar: tuple[date, date] = FISCAL_YEAR,
    ) -> None:
        self.spark, self.feeds, self.as_of, self.calendar = spark, feeds, as_of, calendar

    def replace(self, name: str, df: DataFrame) -> None:
        self.__dict__[name] = df

    # reference tables

    @cached_property
    def dim_regions(self) -> DataFrame:
        return seeds.regions(self.spark)

    @cached_property
    def dim_sales_channels(self) -> DataFrame:
        return seeds.sales_channels(self.spark)

    @cached_property
    def dim_marketing_channels(self) -> DataFrame:
        return seeds.marketing_channels(self.spark)

    @cached_property
    def material_groups(self) -> DataFrame:
        return seeds.material_groups(self.spark)

    # staging

    @cached_property
    def stg_materials(self) -> DataFrame:
        return staging.materials(self.feeds["erp_materials"], self.material_groups)

    @cached_property
    def stg_customers(self) -> DataFrame:
        return staging.customers(self.feeds["erp_customers"])

    @cached_property
    def stg_stores(self) -> DataFrame:
        return staging.stores(self.feeds["erp_stores"])

    @cached_property
    def stg_fx_rates(self) -> DataFrame:
        return staging.fx_rates(self.feeds["erp_fx_rates"])

    @cached_property
    def stg_ledger(self) -> DataFrame:
        return staging.ledger_takings(self.feeds["erp_gl_store_takings"])

    @cached_property
    def stg_pos_lines(self) -> DataFrame:
        return staging.pos_lines(self.feeds["pos_transactions"], self.stg_stores)

    @cached_property
    def stg_web_orders(self) -> DataFrame:
        return staging.web_orders(self.feeds["ecom_orders"])

    @cached_property
    def stg_web_order_lines(self) -> DataFrame:
        return staging.web_order_lines(self.feeds["ecom_order_lines"])

    @cached_property
    def stg_wholesale_lines(self) -> DataFrame:
        return staging.wholesale_lines(self.feeds["erp_sales_order_items"], self.feeds["erp_sales_order_headers"])

    @cached_property
    def stg_shipments(self) -> DataFrame:
        return staging.shipments(self.feeds["logistics_shipments"])

    @cached_property
    def stg_ad_spend(self) -> DataFrame:
        feeds = self.feeds
        return staging.ad_spend(
            feeds["mkt_search_ads"], feeds["mkt_social_ads"], feeds["mkt_other_channels"], self.dim_regions
        )

    # intermediate

    @cached_property
    def quarantined_pos_lines(self) -> DataFrame:
        return marts.quarantined_pos_lines(self.stg_pos_lines)

    @cached_property
    def priced_lines(self) -> DataFrame:
        headers = marts.located_headers(self.feeds["erp_sales_order_headers"], self.stg_customers)
        return marts.priced_lines(
            marts.store_lines(self.stg_pos_lines, self.stg_stores),
            marts.online_lines(self.stg_web_order_lines, self.stg_web_orders),
            marts.located_sales(staging.wholesale_lines(self.feeds["erp_sales_order_items"], headers, "region_code")),
            self.stg_materials,
            self.stg_fx_rates,
        )

    @cached_property
    def int_sales_lines(self) -> DataFrame:
        return marts.sales_lines(self.priced_lines)

    @cached_property
    def int_sales_orders(self) -> DataFrame:
        return marts.sales_orders(self.priced_lines)

    @cached_property
    def int_spend_nzd(self) -> DataFrame:
        return marts.spend_nzd(self.stg_ad_spend, self.stg_fx_rates)

    # marts

    @cached_property
    def fct_sales_lines(self) -> DataFrame:
        return marts.fct_sales_lines(self.priced_lines)

    @cached_property
    def attributed_orders(self) -> DataFrame:
        return marts.attributed_orders(self.int_sales_orders, self.dim_marketing_channels)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return marts.fct_orders(self.int_sales_orders, self.dim_marketing_channels)

    @cached_property
    def fct_ad_spend(self) -> DataFrame:
        return marts.fct_ad_spend(self.int_spend_nzd)

    @cached_property
    def fct_shipments(self) -> DataFrame:
        return marts.fct_shipments(self.stg_shipments)

    @cached_property
    def dim_products(self) -> DataFrame:
        return marts.dim_products(self.stg_materials, marts.missing_products(self.priced_lines, self.stg_materials))

    @cached_property
    def dim_stores(self) -> DataFrame:
        return self.stg_stores

    @cached_property
    def dim_date(self) -> DataFrame:
        return marts.dim_date(date_series(self.spark, *self.calendar))

    @cached_property
    def time_spine(self) -> DataFrame:
        return date_series(self.spark, *TIME_SPINE)

    # reports (they read the facts above, stored or not)

    @cached_property
    def rpt_monthly_sales(self) -> DataFrame:
        return reports.monthly_sales(self.fct_sales_lines)

    @cached_property
    def rpt_monthly_category_margin(self) -> DataFrame:
        return reports.monthly_category_margin(self.fct_sales_lines)

    @cached_property
    def rpt_monthly_marketing(self) -> DataFrame:
        return reports.monthly_marketing(self.fct_ad_spend, self.attributed_orders)

    @cached_property
    def rpt_monthly_delivery(self) -> DataFrame:
        return reports.monthly_delivery(self.fct_shipments)

    @cached_property
    def rpt_top_products(self) -> DataFrame:
        return reports.top_products(self.fct_sales_lines, self.stg_materials)

    @cached_property
    def rpt_ledger_reconciliation(self) -> DataFrame:
        return reports.ledger_reconciliation(self.fct_sales_lines, self.stg_ledger, self.quarantined_pos_lines)


class StoredModels(Models):
    """Models whose line, order and other facts are written on first use, as marts are, and read by everything after. Facts are split
    by month and keep the month, so a dated question opens the months it asks for. Each task writes its own rows of a month: a shuffle
    of whole facts by month would cost more than all other steps that make them."""

    def _by_month(self, name: str, day: str) -> DataFrame:
        rows = getattr(Models, name).func(self).withColumn(MONTH, month_of(day))
        return written(rows, name, MONTH, codec=FACTS)

    @cached_property
    def stg_pos_lines(self) -> DataFrame:
        return written(Models.stg_pos_lines.func(self), "stg_pos_lines", codec=FACTS)

    @cached_property
    def stored_lines(self) -> DataFrame:
        return self._by_month("priced_lines", "order_date")

    @cached_property
    def stored_orders(self) -> DataFrame:
        return self._by_month("int_sales_orders", "order_date")

    @cached_property
    def priced_lines(self) -> DataFrame:
        return self.stored_lines.drop(MONTH)

    @cached_property
    def int_sales_orders(self) -> DataFrame:
        return self.stored_orders.drop(MONTH)

    @cached_property
    def fct_sales_lines(self) -> DataFrame:
        return marts.fct_sales_lines(self.stored_lines, MONTH)

    @cached_property
    def attributed_orders(self) -> DataFrame:
        return marts.attributed_orders(self.stored_orders, self.dim_marketing_channels, MONTH)

    @cached_property
    def fct_ad_spend(self) -> DataFrame:
        return self._by_month("fct_ad_spend", "spend_date")

    @cached_property
    def fct_shipments(self) -> DataFrame:
        return self._by_month("fct_shipments", "promised_date")
