"""The four reference tables. They are constants of a handful of rows, so broadcasting them is always safe."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sales regions (code, name, country).
REGIONS = [
    ("AKL", "Auckland", "NZ"),
    ("WLG", "Wellington", "NZ"),
    ("CHC", "Christchurch", "NZ"),
    ("SYD", "Sydney", "AU"),
    ("MEL", "Melbourne", "AU"),
]

# Where a sale happens (channel, name, description).
SALES_CHANNELS = [
    ("store", "store", "Sales at the seven stores (POS)"),
    ("online", "online", "Orders placed on the NZ and AU web shops"),
    ("wholesale", "wholesale", "Orders from independent homeware retailers (ERP sales orders)"),
]

# Attribution channels (channel, name, is paid, platform).
MARKETING_CHANNELS = [
    ("paid_search", "paid_search", "true", "search ads platform"),
    ("paid_social", "paid_social", "true", "social ads platform"),
    ("display", "display", "true", "display network"),
    ("email", "email", "true", "email service and agency fees"),
    ("affiliate", "affiliate", "true", "affiliate commissions"),
    ("organic", "organic", "false", "unpaid (direct and organic search)"),
]

# Material group to product category.
MATERIAL_GROUPS = [
    ("CW", "Cookware"),
    ("BW", "Bakeware"),
    ("KT", "Kitchen Tools"),
    ("TW", "Tableware"),
    ("FS", "Food Storage"),
]

PAID_CHANNELS = [channel for channel, _, is_paid, _ in MARKETING_CHANNELS if is_paid == "true"]


def local_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A handful of constant rows inside the plan itself, so their size is known when a join is planned."""
    arrays = [pa.array(list(values)) for values in zip(*rows, strict=True)]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def regions(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["region_code", "region_name", "country"], REGIONS)


def sales_channels(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["sales_channel", "channel_name", "description"], SALES_CHANNELS)


def marketing_channels(spark: SparkSession) -> DataFrame:
    rows = local_table(spark, ["marketing_channel", "channel_name", "is_paid", "platform"], MARKETING_CHANNELS)
    return rows.withColumn("is_paid", F.col("is_paid").cast("boolean"))


def material_groups(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["material_group", "product_category"], MATERIAL_GROUPS)
