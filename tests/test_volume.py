"""What a query writes and shuffles besides its result, on tables of a few rows."""

from __future__ import annotations

from datetime import datetime

import pytest
import shop

from catalogue import landing
from catalogue.queries import QUERIES, models
from tillmark.operators.ranking import number_rows
from tillmark.plans import as_delivered, marts, reports, staging
from tillmark.plans import models as plans
from tillmark.sources import shared, sinks, star_schema
from tillmark.sources.star_schema import StarSchemaFeeds

DAY = datetime(1995, 3, 4)
TABLES = {
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "A", 0), (1, "B", 2)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int", [(1, "c", 0), (2, "d", 1)]),
    "part": ("p_partkey long, p_name string, p_type string, p_retailprice double", [(1, "p", "ECONOMY", 9.5), (2, "q", "PROMO", 8.0)]),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        [(k, k % 2 + 1, "F", 20.0, DAY, "1-URGENT") for k in range(1, 10)],
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        [(k, k % 2 + 1, 3, 1, 2.0, 10.0, 0.1, "N", "F", DAY) for k in range(1, 10)],
    ),
    "events": ("event_id long, ts timestamp, user_id long, event_type string, value double", [(1, datetime(2024, 1, 2), 3, "click", 1.5)]),
}
ONCE = "dim_sales_channels win_vs_partition_avg metric_simple join_left_on_coalesced join_full_using_multi win_running_total q_cohort_retention"
NAIVE = "naive_monthly_sales naive_marketing naive_delivery"


@pytest.fixture
def folder(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_lines_are_read_in_place(spark, folder):
    lines = models(spark, folder).feeds.lines(1)
    assert all(folder in f for f in lines.inputFiles()) and lines.count() == 3


def test_a_fact_that_is_read_once_is_not_written(spark, folder, monkeypatch):
    def refused(*_):
        raise AssertionError("a whole table is written")

    monkeypatch.setattr(plans, "written", refused)
    monkeypatch.setattr(as_delivered, "written", refused)
    for name in (*ONCE.split(), *NAIVE.split()):
        assert QUERIES[name](spark, folder).count() > 0, name


def test_a_report_prices_only_what_it_reads(spark, tmp_path, monkeypatch):
    m = shop.models(spark, tmp_path)
    made = as_delivered.AsDelivered(m.feeds, m.material_groups, m.dim_regions, stored=True)
    monkeypatch.setattr(as_delivered, "sales", None)
    assert made.report("monthly_delivery").count() > 0


def test_the_landing_zone_is_compressed(spark, folder):
    root = landing.landing(spark, folder, "ecom_orders")
    assert {f.rsplit(".", 2)[1] for f in spark.read.option("recursiveFileLookup", True).text(f"{root}/ecom_orders").inputFiles()} == {"csv"}
    assert all(f.endswith(".csv.gz") for f in spark.read.option("recursiveFileLookup", True).text(f"{root}/ecom_orders").inputFiles())
    back = landing.read(spark, folder, "ecom_orders")
    sent = star_schema.StarSchemaFeeds(spark, folder)["ecom_orders"]
    assert sorted(r.order_id for r in back.collect()) == sorted(r.order_id for r in sent.collect())
    assert shared.names_in(spark, root) == ["ecom_orders"]


@pytest.fixture
def stores(monkeypatch):
    """What the models write: name -> rows."""
    seen, real = {}, plans.written

    def noted(df, name, *folders, **more):
        seen[name] = df
        return real(df, name, *folders, **more)

    monkeypatch.setattr(plans, "written", noted)
    return seen


@pytest.mark.parametrize("name", ["dq_results"])  # the others read the same audit
def test_an_audit_stores_only_the_lines_that_many_relations_are_made_of(spark, folder, stores, name):
    assert QUERIES[name](spark, folder).count() > 0
    assert set(stores) == {"stg_pos_lines", "priced_lines"}


def test_no_row_travels_for_the_layout_by_month(spark, folder, stores, monkeypatch):
    QUERIES["table_diff_examples"](spark, folder).count()
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert {"priced_lines", "int_sales_orders", "fct_shipments"} <= set(stores)
    assert not [n for n, df in stores.items() if "Rebalance" in optimized(df)]


def test_tills_are_cleaned_once_for_the_lines_the_ledger_and_the_marts(spark, folder, monkeypatch):
    made, real = [], staging.pos_lines
    monkeypatch.setattr(staging, "pos_lines", lambda *x: made.append(1) or real(*x))
    QUERIES["mart_sink"](spark, folder).count()
    assert len(made) == 1


def test_copies_of_till_lines_are_looked_for_where_the_lines_meet_their_order(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = staging.first_copies(StarSchemaFeeds(spark, folder)["pos_transactions"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # lines and orders


def test_regions_of_customers_travel_with_the_headers(spark):
    items = [(v, "000010", "M1", "1.000", "EA", "1.00", "1", "5.00", "NZD", "f") for v in ("1", "1", "2", "3", "4", None)]
    items = spark.createDataFrame(items, "VBELN string, POSNR string, MATNR string, KWMENG string, VRKME string, NETPR string, KPEIN string, NETWR string, WAERK string, _source_file string")
    headers = [("1", "20260101", "20260102", "C-1"), ("1", "20260101", "20260102", "C-1"), ("2", "20260101", None, "C-9"), ("3", None, None, None), (None, None, None, "C-1"), ("4", None, None, "C-2")]
    headers = spark.createDataFrame(headers, "VBELN string, AUDAT string, VDATU string, KUNNR string")
    customers = spark.createDataFrame([("C-1", "AKL"), ("C-1", "WLG"), ("C-2", None), (None, "SYD")], "customer_id string, region_code string")
    want = marts.wholesale_sales(staging.wholesale_lines(items, headers), customers)
    got = marts.located_sales(staging.wholesale_lines(items, marts.located_headers(headers, customers), "region_code"))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 9


def test_stored_marts_are_laid_out_without_a_shuffle(spark, tmp_path):
    wide = spark.range(0, 4000, 1, 4).selectExpr("id", "date_add(date'2026-01-01', cast(id % 90 as int)) as d")
    sinks.write_mart(wide, str(tmp_path / "m"), "d")
    stored = spark.read.parquet(str(tmp_path / "m"))
    # rows of four tasks in three months: each task wrote its own
    assert stored.count() == 4000 and len(stored.inputFiles()) == 12


def test_rows_are_numbered_without_another_shuffle(spark):
    rows = spark.range(200_000).selectExpr("id % 3 as g", "xxhash64(id) as id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        plan = number_rows(rows, ["g"], [("id", True)], "n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_products_of_a_month_do_not_travel_for_its_total(spark, tmp_path):
    m = shop.models(spark, tmp_path)
    best = reports.top_products(m.fct_sales_lines, m.stg_materials)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == reports.product_months(m.fct_sales_lines)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
