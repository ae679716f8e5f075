"""CSV feeds: many headered files read as one all-text table whose columns are matched by name.

Files of one feed may have different headers, and one ``spark.read.csv`` over all of them would match columns by
position. Here the header is data: one pass over the first blocks finds the hash of each file's header line, which Spark adds up
to a row for each file (``FeedFiles``). Only the distinct headers reach the driver, with one example file each. The feed is
then a single scan by position, as wide as the widest header; rows of files whose header is not the usual one meet that
header by file path, and every column is picked by name from the position it has in the row's own file. A column that some
files lack is NULL there. A row with more or fewer fields than its header fails the scan.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.functions.dates import parse_timestamp
from tillmark.operators.joins import without_match
from tillmark.sources.seeds import local_table
from tillmark.sources.shared import written

# The feeds and where their files lie below the landing root.
FEEDS = {
    "erp_materials": "erp/materials.csv",
    "erp_customers": "erp/customers.csv",
    "erp_stores": "erp/stores.csv",
    "erp_fx_rates": "erp/fx_rates.csv",
    "erp_gl_store_takings": "erp/gl_store_takings_*.csv",
    "erp_sales_order_headers": "erp/vbak_*.csv",
    "erp_sales_order_items": "erp/vbap_*.csv",
    "pos_transactions": "pos/*/pos_*.csv",
    "ecom_orders": "ecommerce/orders_*.csv",
    "ecom_order_lines": "ecommerce/order_lines_*.csv",
    "logistics_shipments": "logistics/shipments_*.csv",
    "mkt_search_ads": "marketing/search_ads_*.csv",
    "mkt_social_ads": "marketing/social_ads_*.csv",
    "mkt_other_channels": "marketing/other_channels_*.csv",
}

READ = {"header": True, "inferSchema": False, "escape": '"'}
FIELD = ',("(?:[^"]|"")*"|[^,]*)'
BROKEN = "_broken_record"


@dataclass(frozen=True)
class FeedFiles:
    """The files of a feed that have a header line: (path, size, modified, header), a written table, and the columns of
    each header by its hash, the most usual one first."""

    spark: SparkSession
    place: str
    multi_line: bool
    table: DataFrame

    @cached_property
    def headers(self) -> dict[int, tuple[str, ...]]:
        """One example file for each distinct header is opened, by the reader that will read the feed."""
        kinds = self.table.groupBy("header").agg(F.count("*").alias("files"), _unescaped(F.min("path")).alias("example"))
        examples = sorted(kinds.collect(), key=lambda r: (-r["files"], r["example"]))
        return {r["header"]: self._columns(r["example"]) for r in examples}

    def _columns(self, path: str) -> tuple[str, ...]:
        names = self.spark.read.options(**READ, multiLine=self.multi_line).csv(path).columns
        return tuple(name.removeprefix("\ufeff") for name in names)

    def columns(self) -> DataFrame:
        """path, columns of every file."""
        known = local_table(self.spark, ["header", "columns"], [(h, list(c)) for h, c in self.headers.items()])
        return self.table.join(known, "header").select("path", "columns")


def feed_files(spark: SparkSession, place: str, multi_line: bool = False) -> FeedFiles:
    """Reads the first line of every file that the pattern ``place`` names; empty files have none."""
    lines = spark.read.option("recursiveFileLookup", True).text(place)
    first_blocks = lines.filter((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
    # a number and a hash for each line, so files are added up without holding their text
    numbered = first_blocks.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.xxhash64("value").alias("line"),
        F.monotonically_increasing_id().alias("at"),
    )
    table = numbered.groupBy("path").agg(
        F.min("size").alias("size"), F.min("modified").alias("modified"), F.min_by("line", "at").alias("header")
    )
    return FeedFiles(spark, place, multi_line, written(table, "feed-files"))


def file_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per file: its path as a URL and its column names."""
    return feed_files(spark, pattern).columns()


def load_feed(
    spark: SparkSession, root: str, pattern: str, multi_line: bool = False, loaded: DataFrame | None = None
) -> DataFrame:
    """All files of a feed as text, matched by column name, with ``_source_file`` relative to the landing root.

    ``multi_line`` lets quoted fields hold line breaks; such a file is read by one task. Files that stand in ``loaded``, rows of an
    earlier ``load_manifest``, with the same size and time are left out.
    """
    files = feed_files(spark, f"{root.rstrip('/')}/{pattern}", multi_line)
    if not files.headers:
        raise FileNotFoundError(f"No files match {pattern} under {root}")
    rows = _by_name(files)
    if loaded is not None:
        known = loaded.select(F.col("source_file"), "size", "modified")
        mine = files.table.withColumn("source_file", relative_path(F.col("path"), root))
        rows = rows.join(mine.join(known, ["source_file", "size", "modified"], "left_semi").select("path"), "path", "left_anti")
    return rows.withColumn("_source_file", relative_path(F.col("path"), root)).drop("path")


def _by_name(files: FeedFiles) -> DataFrame:
    headers = files.headers
    reader = files.spark.read.options(**READ, multiLine=files.multi_line, recursiveFileLookup=True)
    (usual, names), *others = headers.items()
    path = F.col("_metadata.file_path").alias("path")
    if not others:
        return reader.option("mode", "FAILFAST").schema(", ".join(f"{_quoted(c)} string" for c in names)).csv(files.place).select("*", path)
    width = max(map(len, headers.values()))
    places = [f"_{i}" for i in range(width)]
    schema = ", ".join(f"{c} string" for c in (*places, BROKEN))
    reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN, enforceSchema=True, columnPruning=False)
    rows = reader.schema(schema).csv(files.place).select("*", path)
    rest = files.table.filter(F.col("header") != usual).select("path", "header")
    rows = rows.join(rest, "path", "left").withColumn("header", F.coalesce("header", F.lit(usual)))
    rows = rows.filter(_fits({h: len(c) for h, c in headers.items()}, width))
    return rows.select(*_picked(headers), "path")


def _fits(widths: dict[int, int], width: int) -> Column:
    """True, or an error for a row that has not as many fields as its header. Spark keeps the text of a row that is not as wide as the
    scan; that is every row under a narrower header, whose fields are counted here."""
    own = F.lit(width)
    for header, columns in widths.items():
        own = F.when(F.col("header") == header, columns).otherwise(own)
    fields = F.when(F.col(BROKEN).isNull(), width).otherwise(F.size(F.regexp_extract_all(F.concat(F.lit(","), BROKEN), F.lit(FIELD), F.lit(0))))
    said = F.concat_ws(" ", F.lit("A row does not fit the header of"), "path", F.lit("- it begins with"), "_0")
    return F.when(fields == own, True).otherwise(F.raise_error(said).cast("boolean"))


def _picked(headers: Mapping[int, tuple[str, ...]]) -> list[Column]:
    """Every column of any header, from where it stands in the row's own file. Names meet without regard to case."""
    found: dict[str, tuple[str, dict[int, list[int]]]] = {}
    for header, names in headers.items():
        for place, name in enumerate(names):
            found.setdefault(name.lower(), (name, {}))[1].setdefault(place, []).append(header)
    out = []
    for name, at in found.values():
        if len(at) == 1 and len(next(iter(at.values()))) == len(headers):
            value = F.col(f"_{next(iter(at))}")
        else:
            value = F.coalesce(*(F.when(F.col("header").isin(*own), F.col(f"_{place}")) for place, own in at.items()))
        out.append(value.alias(name))
    return out


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _unescaped(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def relative_path(path: Column, root: str) -> Column:
    """The part below the landing root, with forward slashes and without URL escapes."""
    plain = F.replace(_unescaped(path), F.lit("\\"), F.lit("/"))
    base = root.rstrip("/").replace("\\", "/").split(":", 1)[-1].lstrip("/") + "/"
    return F.substring_index(plain, base, -1)


def load_feeds(
    spark: SparkSession,
    root: str,
    feeds: Mapping[str, str] = FEEDS,
    multi_line: Collection[str] = (),
    loaded: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every feed by name; those in ``multi_line`` may have line breaks in quoted fields."""
    return {feed: load_feed(spark, root, pattern, feed in multi_line, _of(loaded, feed)) for feed, pattern in feeds.items()}


def _of(manifest: DataFrame | None, feed: str) -> DataFrame | None:
    return None if manifest is None else manifest.filter(F.col("feed") == feed)


def load_manifest(spark: SparkSession, root: str, feeds: Mapping[str, str] = FEEDS) -> DataFrame:
    """(feed, source_file, size, modified) of every file that a load would read now. Store it with the load: files that are the same
    are not read again, ``changed_files`` are."""
    parts = [
        feed_files(spark, f"{root.rstrip('/')}/{pattern}").table.select(
            F.lit(feed).alias("feed"), relative_path(F.col("path"), root).alias("source_file"), "size", "modified"
        )
        for feed, pattern in feeds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def changed_files(now: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files of the manifest ``now`` that are new or not as they were when ``loaded`` was made."""
    return without_match(now, loaded, ["feed", "source_file", "size", "modified"])


def ingest_log(feeds: dict[str, DataFrame], loaded_at: datetime) -> DataFrame:
    """Rows and newest extract time of every file of every feed."""
    logs = [
        df.groupBy(F.lit(feed).alias("feed"), F.col("_source_file").alias("source_file")).agg(
            F.count("*").alias("rows"), F.max(parse_timestamp("_extracted_at")).alias("extracted_at")
        )
        for feed, df in feeds.items()
    ]
    return reduce(DataFrame.unionByName, logs).withColumn("loaded_at", F.lit(str(loaded_at)).cast("timestamp_ntz"))


def load_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("feed").agg(F.countDistinct("source_file").alias("files"), F.sum("rows").alias("rows"))
