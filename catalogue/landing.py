"""A landing zone of compressed CSV files, written by Spark from the test tables, for the queries that read CSV feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.sources.feeds import FEEDS, load_feed, load_manifest
from tillmark.sources.shared import new_folder
from tillmark.sources.star_schema import StarSchemaFeeds

_WRITTEN: dict[tuple[str, str, str], str] = {}

PATTERNS = {feed: f"{feed}/*/*/*.csv.gz" for feed in FEEDS}


def landing(spark: SparkSession, sf_dir: str, feed: str) -> str:
    """The root below which the files of a feed lie, one a year (and store); written when first asked for.

    Web orders come under three headers: ``promo_code`` is new in 2000, and until 1996 the currency stood first.
    """
    key = (spark.sparkContext.applicationId, sf_dir, feed)
    if key not in _WRITTEN:
        root = new_folder(spark, "landing")
        rows = StarSchemaFeeds(spark, sf_dir)[feed]
        delivered = rows.withColumn("file", F.regexp_replace("_source_file", r"-\d\d\.csv$", ".csv")).drop("_source_file")
        versions = [("all", delivered)]
        if feed == "ecom_orders":
            year = F.substring("order_ts", 1, 4)
            plain = delivered.drop("promo_code")
            versions = [
                ("a", plain.select("currency", *(c for c in plain.columns if c != "currency")).filter(year < "1996")),
                ("b", plain.filter(year.between("1996", "1999"))),
                ("c", delivered.filter(year >= "2000")),
            ]
        for name, df in versions:
            df.hint("rebalance", "file").write.partitionBy("file").options(header=True, compression="gzip").csv(f"{root}/{feed}/{name}")
        _WRITTEN[key] = root
    return _WRITTEN[key]


def read(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    df = load_feed(spark, landing(spark, sf_dir, feed), PATTERNS[feed])
    return df.withColumn("_source_file", delivered_as(F.col("_source_file")))


def manifest(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    found = load_manifest(spark, landing(spark, sf_dir, feed), {feed: PATTERNS[feed]})
    return found.withColumn("source_file", delivered_as(F.col("source_file")))


def delivered_as(path: Column) -> Column:
    """Spark names the files inside a folder itself; the folder is named after the file that was delivered."""
    return F.url_decode(F.regexp_extract(path, "file=([^/]*)/", 1))
