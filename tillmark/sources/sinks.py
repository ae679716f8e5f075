"""Where results are stored: marts by layer, failing rows of checks, and report files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.functions.dates import MONTH, month_of
from tillmark.plans.models import Models
from tillmark.sources import shared

#: Published versions that stay: the current one and the one before.
KEPT = 2

# Each mart with its layer and, for facts, the date whose month the files are split by.
MARTS = {
    "dim_date": ("marts", None),
    "dim_regions": ("marts", None),
    "dim_stores": ("marts", None),
    "dim_sales_channels": ("marts", None),
    "dim_marketing_channels": ("marts", None),
    "dim_products": ("marts", None),
    "fct_sales_lines": ("marts", "order_date"),
    "fct_orders": ("marts", "order_date"),
    "fct_ad_spend": ("marts", "spend_date"),
    "fct_shipments": ("marts", "promised_date"),
    "rpt_monthly_sales": ("reporting", None),
    "rpt_monthly_category_margin": ("reporting", None),
    "rpt_monthly_marketing": ("reporting", None),
    "rpt_monthly_delivery": ("reporting", None),
    "rpt_top_products": ("reporting", None),
    "rpt_ledger_reconciliation": ("reporting", None),
}

def split_by(relation: str) -> str | None:
    """The date whose month a stored relation is split by; attributed orders are the orders with one more column."""
    return MARTS.get("fct_orders" if relation == "attributed_orders" else relation, ("", None))[1]


def write_mart(df: DataFrame, path: str, date_column: str | None = None) -> DataFrame:
    """Replaces the stored mart and returns it as read back. Facts are split by month, so date ranges prune files.

    Every task writes the rows that it has of each month, so no row travels for the sake of the layout, and a month with a third
    of all rows is written by many tasks.
    """
    spark = df.sparkSession
    if date_column is None:
        with shared.swept(spark):
            df.write.mode("overwrite").parquet(path, compression=shared.FACTS)
        return spark.read.schema(df.schema).parquet(path)
    by_month = df.withColumn(MONTH, month_of(date_column))
    with shared.swept(spark):
        by_month.write.mode("overwrite").partitionBy(MONTH).parquet(path, compression=shared.FACTS)
    return spark.read.parquet(path).select(*df.columns, MONTH)


def month_range(mart: DataFrame, date_column: str, start: str, end: str) -> DataFrame:
    """Rows of a stored fact between two dates; the month bounds let Spark skip whole folders."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    in_months = F.col(MONTH).between(F.trunc(first, "month"), F.trunc(last, "month"))
    return mart.filter(in_months & F.col(date_column).between(first, last))


def build_marts(models: Models, root: str, marts: Mapping[str, tuple[str, str | None]] = MARTS) -> Models:
    """Full refresh of the marts, from the feeds, as a new version below ``root/versions``.

    Nothing that is published is touched: the version is written aside, and only when its last mart is there a marker in
    ``root/published`` makes it the current one. A refresh that fails leaves the marts as they were. The version before stays for
    those who still read it; older ones, published or not, are removed.

    Returns models that read what is stored so far: a report is computed from the stored facts, not from the feeds. Cleaned till
    lines are taken from ``models``, which may have stored them, and priced lines and the reconciliation read one copy of them.
    """
    spark = models.spark
    version = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/versions/{version}"
    built = Models(spark, models.feeds, models.as_of, models.calendar)
    built.replace("stg_pos_lines", models.stg_pos_lines)
    for name in ("stg_pos_lines", "priced_lines", "int_sales_orders"):
        built.replace(name, write_mart(getattr(built, name), f"{folder}/intermediate/{name}"))
    for name, (layer, date_column) in marts.items():
        _replace(built, name, write_mart(getattr(built, name), f"{folder}/{layer}/{name}", date_column))
    shared.mark(spark, f"{root}/published/{version}")
    published = shared.names_in(spark, f"{root}/published")
    kept = published[-KEPT:]
    for old in shared.names_in(spark, f"{root}/versions"):
        if old < kept[0]:
            shared.remove(spark, f"{root}/versions/{old}")
    for old in published[:-KEPT]:
        shared.remove(spark, f"{root}/published/{old}")
    return built


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the marts that were published last."""
    published = shared.names_in(spark, f"{root}/published")
    return f"{root}/versions/{published[-1]}" if published else None


def stored_marts(models: Models, root: str, marts: Mapping[str, tuple[str, str | None]] = MARTS) -> Models:
    """Models that read the published marts; everything else comes from the feeds."""
    folder = current_version(models.spark, root)
    if folder is None:
        raise FileNotFoundError(f"No marts are published under {root}")
    stored = Models(models.spark, models.feeds, models.as_of, models.calendar)
    for name, (layer, _) in marts.items():
        _replace(stored, name, models.spark.read.parquet(f"{folder}/{layer}/{name}"))
    return stored


def _replace(models: Models, name: str, mart: DataFrame) -> None:
    models.replace(name, mart)
    if name == "fct_orders":  # metrics read the stored orders, without their place in the day
        models.replace("attributed_orders", mart.drop("revenue_rank_in_day"))


def store_failures(found: DataFrame, root: str) -> DataFrame:
    """Writes the findings of all checks below ``root/dq_audit``, a folder for each check, in one pass over each relation; returns
    them as read back."""
    place = f"{root}/dq_audit"
    with shared.swept(found.sparkSession):
        found.hint("rebalance", "name").write.mode("overwrite").partitionBy("name").parquet(place)
    return found.sparkSession.read.schema(found.schema).parquet(place).select(*found.columns)


def write_report_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def read_report_csv(like: DataFrame, path: str) -> DataFrame:
    return like.sparkSession.read.option("header", True).schema(like.schema).csv(path)
