"""One query per operator, each over the whole test tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogue import landing
from catalogue.questions import QUESTIONS
from tillmark.functions import dates, keys, money, text
from tillmark.functions.money import round_double, safe_ratio
from tillmark.functions.ordering import descending
from tillmark.operators import aggregates, joins, ranking
from tillmark.operators.percentiles import group_percentiles
from tillmark.plans import as_delivered, checks, compare, declared, grounding, marts, reports, scoring, staging, truth, weekly
from tillmark.plans.metrics import Filter, Measure, MetricLayer, SemanticModel, Metric, MODELS, METRICS, Reference
from tillmark.plans.models import Models, StoredModels
from tillmark.sources import feeds as feed_files
from tillmark.sources import seeds, shared, sinks, star_schema
from tillmark.sources.star_schema import AS_OF, CALENDAR, StarSchemaFeeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOADED_AT = datetime(2001, 8, 3, 6, 0, 0)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the way results are compared."""
    return df.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


def _registered(make: Callable[[Models], DataFrame], source: Callable[[SparkSession, str], Models]) -> Callable[[Models], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(make(source(spark, sf_dir)))

    QUERIES[make.__name__] = run
    return make


def query(make: Callable[[Models], DataFrame]) -> Callable[[Models], DataFrame]:
    return _registered(make, models)


def single_pass(make: Callable[[Models], DataFrame]) -> Callable[[Models], DataFrame]:
    """A query that reads each fact once. It computes its relations from the feeds: only the columns and channels that it asks for are
    shuffled, and no whole table is written for it."""
    return _registered(make, from_feeds)


@lru_cache(maxsize=4)
def models(spark: SparkSession, sf_dir: str) -> Models:
    """Relations over one folder. Like the marts of a warehouse, the line and order tables are written on first use."""
    feeds = StarSchemaFeeds(spark, sf_dir, lambda: made.stg_pos_lines)
    made = StoredModels(spark, feeds, AS_OF, CALENDAR)
    return made


@lru_cache(maxsize=4)
def from_feeds(spark: SparkSession, sf_dir: str) -> Models:
    """The same relations, each computed from the feeds."""
    return Models(spark, feeds_of(spark, sf_dir), AS_OF, CALENDAR)


@lru_cache(maxsize=4)
def feeds_of(spark: SparkSession, sf_dir: str) -> StarSchemaFeeds:
    return StarSchemaFeeds(spark, sf_dir)


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Writes what the queries share, so that it can be timed on its own."""
    m = models(spark, sf_dir)
    for name in ("stg_pos_lines", "stored_lines", "stored_orders", "fct_ad_spend", "fct_shipments"):
        getattr(m, name)
    _as_delivered(m).sales  # noqa: B018
    landing.landing(spark, sf_dir, "ecom_orders")


def lines_once(m: Models) -> Models:
    """Relations for a job that reads most facts once: cleaned and priced lines, which many of them are made of, are the stored ones; the
    others are computed and no table is written for them."""
    made = Models(m.spark, m.feeds, m.as_of, m.calendar)
    for name in ("stg_pos_lines", "priced_lines"):
        made.replace(name, getattr(m, name))
    return made


def layer(m: Models) -> MetricLayer:
    return MetricLayer(lambda name: getattr(m, name))


def relations(source: Callable[[SparkSession, str], Models], *names: str) -> None:
    for name in names:

        def run(spark: SparkSession, sf_dir: str, name: str = name) -> DataFrame:
            return plain(getattr(source(spark, sf_dir), name))

        QUERIES[name] = run


# staging, intermediate relations, marts and reports

relations(
    from_feeds,
    "stg_materials",
    "stg_customers",
    "stg_stores",
    "stg_fx_rates",
    "stg_ledger",
    "stg_pos_lines",
    "stg_web_orders",
    "stg_web_order_lines",
    "stg_wholesale_lines",
    "stg_ad_spend",
    "stg_shipments",
    "quarantined_pos_lines",
    "int_sales_lines",
    "int_sales_orders",
    "int_spend_nzd",
    "fct_sales_lines",
    "fct_ad_spend",
    "fct_shipments",
    "dim_products",
    "dim_stores",
    "rpt_ledger_reconciliation",
)
relations(
    models,
    "fct_orders",
    "rpt_monthly_sales",
    "rpt_monthly_category_margin",
    "rpt_monthly_marketing",
    "rpt_monthly_delivery",
    "rpt_top_products",
)


@query
def dim_date(m: Models) -> DataFrame:
    """The calendar over the days the web orders span, with the orders of each day."""
    orders = m.stg_web_orders
    span = orders.agg(F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    days = marts.dim_date(dates.date_series(m.spark, F.col("first"), F.col("last"), span))
    counts = orders.groupBy(F.col("order_date").alias("date_day")).agg(F.count("*").alias("orders"))
    return days.join(counts, ["date_day"], "left")


def _with_rows(seed: DataFrame, key: str, facts: DataFrame, name: str) -> DataFrame:
    """A seeded dimension with the rows of a fact that refer to each of its members."""
    counts = facts.groupBy(key).agg(F.count("*").alias(name))
    return seed.join(counts, [key], "left").withColumn(name, F.coalesce(name, F.lit(0)))


@single_pass
def dim_regions(m: Models) -> DataFrame:
    return _with_rows(m.dim_regions, "region_code", m.fct_sales_lines, "sales_lines")


@single_pass
def dim_sales_channels(m: Models) -> DataFrame:
    return _with_rows(m.dim_sales_channels, "sales_channel", m.fct_sales_lines, "sales_lines")


@single_pass
def dim_marketing_channels(m: Models) -> DataFrame:
    return _with_rows(m.dim_marketing_channels, "marketing_channel", m.attributed_orders, "orders")


@single_pass
def time_spine(m: Models) -> DataFrame:
    """Every day of the years in which orders were placed, with the ISO week that it is counted in."""
    years = m.attributed_orders.agg(F.trunc(F.min("order_date"), "year").alias("first"), F.last_day(F.add_months(F.trunc(F.max("order_date"), "year"), 11)).alias("last"))
    days = dates.date_series(m.spark, F.col("first"), F.col("last"), years)
    return days.select("date_day", dates.trunc_to("week", "date_day").alias("week"))


# scans, sources, sinks


def _landing_query(name: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Query]:
    def register(make: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(make(spark, sf_dir))
        return make

    return register


@_landing_query("scan_union_by_name")
def _scan_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.read(spark, sf_dir, "ecom_orders")


@_landing_query("scan_source_file")
def _scan_source_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the rows of each feed come from."""
    found = [
        landing.read(spark, sf_dir, feed).groupBy(F.lit(feed).alias("feed"), "_source_file").agg(F.count("*").alias("rows"))
        for feed in landing.PATTERNS
    ]
    return reduce(DataFrame.unionByName, found)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = {name: landing.read(spark, sf_dir, name) for name in landing.PATTERNS}
    return feed_files.ingest_log(feeds, LOADED_AT)


@_landing_query("ingest_log")
def _ingest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)


@_landing_query("feed_load_summary")
def _feed_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_files.load_summary(_log(spark, sf_dir))


def _contract_failures(m: Models) -> DataFrame:
    root = landing.landing(m.spark, m.feeds.folder, "ecom_orders")
    headers = feed_files.file_headers(m.spark, f"{root}/{landing.PATTERNS['ecom_orders']}")
    relative = landing.delivered_as(feed_files.relative_path(F.col("path"), root))
    # the loader adds _source_file, so a delivered file cannot lack it
    delivered = headers.select(relative.alias("path"), F.array_append("columns", F.lit("_source_file")).alias("columns"))
    return checks.contract_issues(delivered, declared.WEB_ORDER_CONTRACT).distinct()


@query
def seed_dims(m: Models) -> DataFrame:
    """The rows of the four seeds with how many orders or materials use them."""
    web = m.stg_web_orders

    def used(name: str, seed: DataFrame, key: str, label: str, facts: DataFrame, paid: Column) -> DataFrame:
        counts = facts.groupBy(key).agg(F.count("*").alias("rows"))
        joined = seed.join(counts, [key], "left")
        return joined.select(
            F.lit(name).alias("seed"),
            F.col(key).alias("key"),
            F.col(label).alias("label"),
            paid.alias("is_paid"),
            F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        )

    nobody = F.lit(None).cast("boolean")
    parts = [
        used("regions", m.dim_regions, "region_code", "region_name", web, nobody),
        used("sales_channels", m.dim_sales_channels, "sales_channel", "channel_name", m.stg_shipments, nobody),
        used("marketing_channels", m.dim_marketing_channels, "marketing_channel", "platform", web, F.col("is_paid")),
        used("material_groups", m.material_groups, "material_group", "product_category", m.stg_materials.drop("product_category"), nobody),
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def mart_sink(m: Models) -> DataFrame:
    """A full refresh of every mart; the rows each stored mart has."""
    root = shared.new_folder(m.spark, "marts")
    sinks.build_marts(m, root)
    built = sinks.stored_marts(m, root)
    counts = [
        getattr(built, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("mart"), "rows")
        for name in sinks.MARTS
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def failures_sink(m: Models) -> DataFrame:
    """The stored failing rows of every check."""
    stored = _audit(m)
    known = seeds.local_table(m.spark, ["check"], [(c.name,) for c in declared.all_checks(True)])
    counts = checks.failing_rows(stored).withColumnRenamed("name", "check")
    return known.join(counts, "check", "left").select("check", F.coalesce("failing_rows", F.lit(0)).alias("rows"))


@lru_cache(maxsize=4)
def _as_delivered(m: Models) -> as_delivered.AsDelivered:
    return as_delivered.AsDelivered(m.feeds, m.material_groups, m.dim_regions, stored=True)


@query
def report_csv_sink(m: Models) -> DataFrame:
    """The four as-delivered reports, written as CSV and read back: every figure by month and key."""
    made = _as_delivered(m).reports()
    root = shared.new_folder(m.spark, "reports")
    parts = []
    for name, (keys_, values) in compare.REPORTS.items():
        sinks.write_report_csv(made[name], f"{root}/{name}.csv")
        read = sinks.read_report_csv(made[name], f"{root}/{name}.csv")
        figures = F.explode(F.array(*(F.struct(F.lit(v).alias("field"), F.col(v).cast("double").alias("value")) for v in values)))
        parts.append(read.select(F.lit(name).alias("report"), "month", F.concat_ws("/", *keys_[1:]).alias("key"), figures.alias("f")).select("report", "month", "key", "f.*"))
    return reduce(DataFrame.unionByName, parts)


# projections, filters, predicates


@query
def project_rename_cast(m: Models) -> DataFrame:
    return m.stg_web_orders.select("order_id", "order_ts", "order_date", "region_code", "order_status", "order_total")


@query
def decimal_qty_to_int(m: Models) -> DataFrame:
    return m.feeds["erp_sales_order_items"].select(
        "VBELN", "POSNR", "MATNR", money.quantity_to_int("KWMENG").alias("quantity")
    )


@query
def unit_price_per(m: Models) -> DataFrame:
    return m.feeds["erp_sales_order_items"].select(
        "VBELN", "POSNR", "MATNR", money.unit_price_per("NETPR", "KPEIN").alias("unit_price")
    )


@query
def micros_to_currency(m: Models) -> DataFrame:
    return m.feeds["mkt_search_ads"].select(
        "date", "geo_target", "campaign_name", money.micros_to_currency("cost_micros").alias("spend")
    )


@query
def surrogate_keys(m: Models) -> DataFrame:
    feeds = m.feeds
    web = feeds["ecom_order_lines"].select(
        F.lit("web").alias("kind"), keys.line_key(F.col("order_id"), F.col("line_no")).alias("key")
    )
    wholesale = feeds["erp_sales_order_items"].select(
        F.lit("wholesale").alias("kind"), keys.item_key(F.col("VBELN"), F.col("POSNR")).alias("key")
    )
    spend = m.stg_ad_spend.select(
        F.lit("spend").alias("kind"),
        keys.spend_key(F.col("spend_date"), F.col("marketing_channel"), F.col("region_code"), F.col("campaign_name")).alias("key"),
    )
    return web.unionByName(wholesale).unionByName(spend)


@query
def currency_convert(m: Models) -> DataFrame:
    """Order totals at the day's rate."""
    rates = m.stg_fx_rates.withColumnRenamed("rate_date", "posting_date")
    nzd = money.to_nzd(F.col("order_total"), F.col("currency"), F.col("aud_nzd_rate"))
    return m.feeds.every_order().join(rates.withColumnRenamed("posting_date", "order_date"), ["order_date"], "left").select(
        "order_id", "currency", "order_total", nzd.alias("order_total_nzd")
    )


@single_pass
def null_typed_padding(m: Models) -> DataFrame:
    shape = ["sales_line_id", "sales_channel", "store_id", "marketing_channel", "order_type"]
    store = marts.store_lines(m.stg_pos_lines, m.stg_stores).select(*shape)
    wholesale = marts.wholesale_sales(m.stg_wholesale_lines, m.stg_customers).select(*shape)
    return store.unionByName(wholesale)


@query
def validity_flag(m: Models) -> DataFrame:
    valid = staging.sale_line_is_valid(F.col("txn_type"), F.col("quantity").cast("int"))
    return m.feeds["pos_transactions"].select("transaction_id", "line_no", "txn_type", "quantity", valid.alias("is_valid"))


@single_pass
def quarantine_split(m: Models) -> DataFrame:
    """Where every till line goes: kept, quarantined with the reason, or neither when its quantity is unknown."""
    route = F.when(F.col("is_valid"), "kept").when(~F.col("is_valid"), "quarantined").otherwise("neither")
    reason = F.when(~F.col("is_valid"), marts.QUARANTINE_REASON)
    return m.stg_pos_lines.select("pos_line_id", route.alias("route"), reason.alias("reason"))


@query
def status_filter(m: Models) -> DataFrame:
    completed = marts.completed(m.stg_web_orders).select(F.lit("order").alias("kind"), F.col("order_id").alias("key"))
    rates = m.stg_fx_rates.select(F.lit("rate").alias("kind"), F.col("rate_date").cast("string").alias("key"))
    return completed.unionByName(rates)


@query
def lag_cutoff_filter(m: Models) -> DataFrame:
    return declared.unshipped(m.stg_web_orders, dates.days_before(m.as_of, declared.SHIPMENT_LAG_DAYS))


@query
def order_type_map(m: Models) -> DataFrame:
    kind = marts.order_type_of(F.col("txn_type"))
    return m.feeds["pos_transactions"].select(
        "transaction_id", "line_no", kind.alias("order_type"), (kind == "return").alias("is_return")
    )


@single_pass
def cost_and_profit(m: Models) -> DataFrame:
    return m.fct_sales_lines.select("sales_line_id", "product_id", "cogs_nzd", "has_cost", "gross_profit_nzd")


@query
def delivery_flags(m: Models) -> DataFrame:
    return m.stg_shipments.select("shipment_id", "promised_date", "delivered_date", "is_on_time", "days_late")


@single_pass
def paid_attribution_flag(m: Models) -> DataFrame:
    return m.attributed_orders.select("order_id", "sales_channel", "marketing_channel", "is_paid_attribution")


@single_pass
def currency_from_master(m: Models) -> DataFrame:
    return m.stg_pos_lines.select("pos_line_id", "store_id", "currency", "reported_currency")


# joins


@query
def join_inner_dim(m: Models) -> DataFrame:
    stores = m.stg_stores.select("store_id", "store_name", "region_code")
    return m.feeds.till_lines().join(stores, ["store_id"]).select(
        "transaction_id", "line_no", "sku", "store_name", "region_code"
    )


@query
def join_left_lookup(m: Models) -> DataFrame:
    known = m.stg_materials.select("sku", "material_id", "product_category")
    return m.feeds.till_lines().join(known, ["sku"], "left").select(
        "transaction_id", "line_no", "sku", "material_id", "product_category"
    )


@query
def join_header_item(m: Models) -> DataFrame:
    return m.stg_wholesale_lines.select("sales_order_line_id", "material_id", "order_date", "customer_id")


@query
def join_fx_by_day(m: Models) -> DataFrame:
    rates = m.stg_fx_rates.withColumnRenamed("rate_date", "order_date")
    return m.feeds.every_order().join(rates, ["order_date"], "left").select("order_id", "order_date", "aud_nzd_rate")


@query
def join_name_lookup(m: Models) -> DataFrame:
    codes = m.dim_regions.select(F.col("region_name").alias("region"), "region_code")
    return joins.lookup(m.feeds["mkt_social_ads"], codes, ["region"]).select("day", "campaign_name", "region", "region_code")


@query
def join_full_outer_coalesce(m: Models) -> DataFrame:
    """Days and regions with web orders, with shipments, or both."""
    keys_ = ["day", "region_code"]
    ordered = m.stg_web_orders.groupBy(F.col("order_date").alias("day"), "region_code").agg(F.count("*").alias("orders"))
    shipped = m.stg_shipments.groupBy(F.col("shipped_date").alias("day"), "region_code").agg(F.count("*").alias("shipments"))
    return joins.full_on(ordered, shipped, keys_)


@single_pass
def join_left_on_coalesced(m: Models) -> DataFrame:
    columns = ["store_id", "business_date", "difference_nzd", "quarantined_lines"]
    return m.rpt_ledger_reconciliation.select(*columns)


@single_pass
def join_full_using_multi(m: Models) -> DataFrame:
    """Three facts side by side by month and region; a NULL region of one fact meets no other."""
    wanted = ["revenue", "orders", "ad_spend", "shipments_due"]
    return layer(m).frame(wanted, ["date", "region"])


@single_pass
def join_cross_scalar(m: Models) -> DataFrame:
    """Facts without a grouping are one row each, placed together."""
    return layer(m).frame(["attributed_revenue", "ad_spend", "roas"])


@single_pass
def anti_join_missing(m: Models) -> DataFrame:
    return marts.missing_products(m.priced_lines, m.stg_materials)


@query
def join_self_first(m: Models) -> DataFrame:
    orders = marts.completed(m.stg_web_orders).select("customer_id", dates.month_of("order_date").alias("order_month"))
    return reports.customer_activity(orders)


@query
def join_equi_residual(m: Models) -> DataFrame:
    """Till lines whose currency label is not the store's."""
    stores = m.stg_stores.select("store_id", F.col("currency").alias("store_currency"))
    wrong = F.col("currency") != F.col("store_currency")
    return m.feeds.till_lines().join(stores, ["store_id"]).filter(wrong).select(
        "transaction_id", "line_no", "sku", "currency", "store_currency"
    )


@query
def join_outer_indicator(m: Models) -> DataFrame:
    """Orders against the lines that were shipped for them."""
    orders = m.feeds.every_order().select("order_id", "order_status")
    sent = m.feeds.lines().filter("l_returnflag <> 'R'")
    shipped = sent.groupBy(F.concat(F.lit("O-"), "l_orderkey").alias("order_id")).agg(F.count("*").alias("shipments"))
    return joins.outer_with_side(orders, shipped, ["order_id"])


# aggregations


@single_pass
def agg_order_rollup(m: Models) -> DataFrame:
    return m.int_sales_orders.select("order_id", "sales_channel", "order_type", "line_count", "units", "revenue_nzd")


@single_pass
def agg_conditional_sum(m: Models) -> DataFrame:
    costed = aggregates.sum_if(F.col("has_cost"), F.col("revenue_nzd"))
    return m.fct_sales_lines.groupBy("sales_channel", "product_category").agg(costed.alias("costed_revenue_nzd"))


@single_pass
def agg_conditional_distinct(m: Models) -> DataFrame:
    orders = aggregates.distinct_if(F.col("order_type") == "sale", F.col("order_id"))
    return m.fct_sales_lines.groupBy("sales_channel", "region_code").agg(orders.alias("orders"))


@single_pass
def agg_conditional_avg(m: Models) -> DataFrame:
    late = aggregates.avg_if(~F.col("is_on_time"), F.col("days_late"))
    return m.fct_shipments.groupBy("carrier", "region_code").agg(late.alias("avg_days_late"))


@query
def agg_safe_ratio(m: Models) -> DataFrame:
    """Discount share of the list price per payment method and day; NULL where nothing was listed."""
    listed, off = F.sum(money.money("unit_price")), F.sum(money.money("discount_amount"))
    day = dates.parse_timestamp("txn_ts").cast("date").alias("day")
    return m.feeds.till_lines().groupBy("store_id", day).agg(
        round_double(safe_ratio(off, listed), 8).alias("discount_share")
    )


@query
def agg_filter_having(m: Models) -> DataFrame:
    """Store-days with lines that were not keyed, and how many of each kind."""
    pos = m.feeds.till_lines()
    day = dates.parse_timestamp("txn_ts").cast("date").alias("business_date")
    return (
        pos.groupBy("store_id", day)
        .agg(
            F.count("*").alias("lines"),
            aggregates.count_if(F.col("txn_type") == "RETURN").alias("returned"),
            aggregates.count_if(F.col("quantity").isNull()).alias("without_quantity"),
        )
        .filter(F.col("returned") > 0)
    )


@query
def agg_filter_distinct(m: Models) -> DataFrame:
    """Distinct web customers per month, of all and of cancelled orders."""
    customer = F.col("customer_id")
    return m.feeds.every_order().groupBy(dates.month_of("order_date").alias("month")).agg(
        aggregates.distinct_if(F.col("order_status") == "completed", customer).alias("buyers"),
        aggregates.distinct_if(F.col("order_status") == "cancelled", customer).alias("cancellers"),
    )


@query
def agg_distinct(m: Models) -> DataFrame:
    return m.feeds.till_lines().select("store_id", "sku").distinct()


@single_pass
def agg_global(m: Models) -> DataFrame:
    return m.fct_sales_lines.agg(
        F.count("*").alias("lines"),
        F.sum("quantity").alias("units"),
        money.rounded(F.sum("revenue_nzd"), 2).alias("revenue_nzd"),
        F.max("order_date").alias("last_order"),
    )


@query
def agg_measure_set(m: Models) -> DataFrame:
    """Every aggregation a measure may use, through a semantic model of our own."""
    amount = lambda: F.col("order_total")
    web = SemanticModel(
        name="web_orders",
        relation="stg_web_orders",
        entity="web_order",
        key="order_id",
        time="order_date",
        dimensions=("site",),
        references=(Reference("region", "region_code"),),
        measures=tuple(
            Measure(f"total_{agg}", agg, (lambda: F.col("customer_id")) if agg == "count_distinct" else amount)
            for agg in aggregates.MEASURE_AGGREGATIONS
        ),
    )
    metrics = [Metric(x.name, x.name, "", measure=x.name) for x in web.measures]
    own = MetricLayer(lambda name: getattr(m, name), (*MODELS, web), [*METRICS, *metrics])
    out = own.frame([x.name for x in metrics], ["region", "web_order__site"])
    return out.select("region", F.col("web_order__site").alias("site"), *(x.name for x in metrics))


@query
def agg_argmax_argmin(m: Models) -> DataFrame:
    """The best and the weakest region of each month by revenue."""
    monthly = layer(m).frame(["revenue"], ["date", "region"])
    best = aggregates.label_of_extreme(monthly, "region", "revenue", True, ["date"])
    worst = aggregates.label_of_extreme(monthly, "region", "revenue", False, ["date"])
    return best.select("date", F.col("region").alias("best"), F.col("revenue").alias("best_revenue")).join(
        worst.select("date", F.col("region").alias("weakest"), F.col("revenue").alias("weakest_revenue")), ["date"]
    )


@query
def agg_latency_stats(m: Models) -> DataFrame:
    events = m.feeds.table("events").select("event_type", F.col("value").alias("latency"))
    exact = events.groupBy("event_type").agg(
        round_double(F.avg("latency"), 6).alias("mean"),
        F.sum(F.col("latency").cast("decimal(18,2)")).alias("total"),
    )
    spread = group_percentiles(events, ["event_type"], "latency", {"median": 0.5}, {"p90": 0.9})
    return exact.join(spread, ["event_type"])


# windows


@query
def win_dedup_first(m: Models) -> DataFrame:
    return staging.first_copies(m.feeds["pos_transactions"])


@query
def win_rank_in_day(m: Models) -> DataFrame:
    """Web orders by their place in the region's day."""
    orders = m.feeds.every_order().select("order_id", "region_code", "order_date", "order_total")
    return ranking.number_rows(
        orders, ["region_code", "order_date"], [("order_total", True), ("order_id", False)], "place"
    )


def _monthly_channel(m: Models) -> DataFrame:
    return m.fct_sales_lines.groupBy(dates.month_of("order_date").alias("month"), "sales_channel").agg(
        F.sum("revenue_nzd").alias("revenue")
    )


@single_pass
def win_lag_delta(m: Models) -> DataFrame:
    change = F.col("revenue") - F.lag("revenue").over(ranking.sequence_of(["month"], ["sales_channel"]))
    return _monthly_channel(m).select("month", "sales_channel", money.rounded(change, 2).alias("change"))


@single_pass
def win_lag_pct(m: Models) -> DataFrame:
    prior = F.lag("revenue").over(ranking.sequence_of(["month"], ["sales_channel"]))
    pct = F.lit(100.0) * (safe_ratio(F.col("revenue"), prior) - 1)
    return _monthly_channel(m).select("month", "sales_channel", round_double(pct, 4).alias("change_pct"))


@single_pass
def win_running_total(m: Models) -> DataFrame:
    so_far = F.sum("revenue").over(ranking.running(["month"], ["sales_channel"]))
    return _monthly_channel(m).select("month", "sales_channel", money.rounded(so_far, 2).alias("to_date"))


def _category_months(m: Models) -> DataFrame:
    return m.fct_sales_lines.groupBy(dates.month_of("order_date").alias("month"), "product_category").agg(
        F.sum("gross_profit_nzd").alias("profit"), F.sum("revenue_nzd").alias("revenue")
    )


@single_pass
def win_rank(m: Models) -> DataFrame:
    place = F.rank().over(Window.partitionBy("month").orderBy(*descending("profit")))
    return _category_months(m).select("month", "product_category", place.alias("place"))


@single_pass
def win_dense_rank(m: Models) -> DataFrame:
    place = F.dense_rank().over(Window.partitionBy("month").orderBy(*descending("revenue")))
    return _category_months(m).select("month", "product_category", place.alias("place"))


@query
def win_share_of_total(m: Models) -> DataFrame:
    shared_ = ranking.with_share(_category_months(m), ["month"], "revenue", "total")
    return shared_.select(
        "month", "product_category", round_double(safe_ratio(F.col("revenue"), F.col("total")), 6).alias("share")
    )


@single_pass
def win_vs_partition_avg(m: Models) -> DataFrame:
    months = reports.store_months(m.fct_sales_lines, m.stg_stores)
    usual = F.avg(F.col("revenue").cast("double")).over(Window.partitionBy("store_name"))
    versus = F.lit(100.0) * (safe_ratio(F.col("revenue"), usual) - 1)
    return months.select("store_name", F.col("m").alias("month"), round_double(versus, 4).alias("vs_average_pct"))


@single_pass
def win_centred_smooth(m: Models) -> DataFrame:
    return weekly.smoothed_daily_revenue(m.attributed_orders)


# sorts, limits, top-k


@query
def sort_nulls_last(m: Models) -> DataFrame:
    """Ad spend by region with the unknown region last."""
    return layer(m).query(["ad_spend"], ["region", "marketing_channel"], order_by=[("region", False), ("ad_spend", True)])


@single_pass
def limit_clamp(m: Models) -> DataFrame:
    """A reader gets exactly as many rows as asked for."""
    return layer(m).query(["revenue"], ["date", "region", "product_category"], grain="day", limit=2500)


@single_pass
def topn_per_group_dense(m: Models) -> DataFrame:
    monthly = reports.product_months(m.fct_sales_lines)
    best = ranking.top_by_rank(monthly, ["month"], "revenue_nzd", 10, "place", dense=True)
    return best.select("month", "product_id", "place", money.rounded(F.col("revenue_nzd"), 2).alias("revenue"))


@query
def topn_per_group_rank(m: Models) -> DataFrame:
    """Per day the three largest web orders, ties kept."""
    orders = m.feeds.every_order().select("order_id", "order_date", "order_total")
    return ranking.top_by_rank(orders, ["order_date"], "order_total", 3, "place")


# set operations


@single_pass
def union_channels(m: Models) -> DataFrame:
    return m.priced_lines.select(*marts.LINE_COLUMNS)


@query
def union_platforms(m: Models) -> DataFrame:
    return m.stg_ad_spend


@single_pass
def union_inferred_members(m: Models) -> DataFrame:
    return m.dim_products.select("product_id", "description", "product_category", "is_inferred")


# scalar functions and generators


@query
def fn_parse_date(m: Models) -> DataFrame:
    """The day of every order, written in the three notations of the feeds and parsed again."""
    patterns = {"yyyymmdd": "yyyyMMdd", "dd/mm/yyyy": "dd/MM/yyyy", "yyyy-mm-dd": "yyyy-MM-dd"}
    orders = m.feeds.every_order()
    written = [
        orders.select(F.lit(notation).alias("notation"), F.date_format("order_date", pattern).alias("written"))
        .withColumn("day", dates.parse_date("written", notation))
        for notation, pattern in patterns.items()
    ]
    return reduce(DataFrame.unionByName, written)


@query
def fn_date_series(m: Models) -> DataFrame:
    """Every day between the first and the last shipment, days without any as 0."""
    daily = m.stg_shipments.groupBy(F.col("shipped_date").alias("date_day")).agg(F.count("*").alias("shipments"))
    span = m.stg_shipments.agg(F.min("shipped_date").alias("first"), F.max("shipped_date").alias("last"))
    days = dates.date_series(m.spark, F.col("first"), F.col("last"), span)
    return days.join(daily, ["date_day"], "left").fillna(0, ["shipments"])


@query
def fn_calendar_attrs(m: Models) -> DataFrame:
    return m.feeds.every_order().select("order_id", *dates.calendar_columns("order_date"))


@query
def fn_date_trunc_grain(m: Models) -> DataFrame:
    by_grain = [
        m.feeds.every_order().groupBy(F.lit(grain).alias("grain"), dates.trunc_to(grain, "order_date").alias("period")).agg(
            F.count("*").alias("orders")
        )
        for grain in dates.GRAINS
    ]
    return reduce(DataFrame.unionByName, by_grain)


@query
def fn_month_diff(m: Models) -> DataFrame:
    return m.stg_shipments.select(
        "shipment_id", dates.month_diff(F.col("promised_date"), F.col("delivered_date")).alias("months")
    )


@query
def fn_month_add(m: Models) -> DataFrame:
    return m.feeds.every_order().select(
        "order_id", *(dates.add_months(F.col("order_date"), k).alias(f"plus_{k}") for k in (1, 2, 3))
    )


@query
def fn_month_label(m: Models) -> DataFrame:
    return m.feeds.every_order().select("order_id", dates.month_label("order_date").alias("month"))


@query
def fn_iso_week_bounds(m: Models) -> DataFrame:
    weeks = m.feeds.every_order().groupBy(dates.iso_week_label("order_date").alias("iso_week")).agg(F.count("*").alias("orders"))
    monday, sunday = dates.iso_week_bounds("iso_week")
    return weeks.select("iso_week", monday.alias("monday"), sunday.alias("sunday"), "orders")


@query
def fn_split_part(m: Models) -> DataFrame:
    return m.feeds["mkt_search_ads"].select(
        "date", "geo_target", "campaign_id", F.split_part("geo_target", F.lit("-"), F.lit(2)).alias("region_code")
    )


@query
def fn_rounding(m: Models) -> DataFrame:
    """Money to cents, ratios to four digits, percentages to one."""
    sums = m.feeds.every_order().groupBy("customer_id").agg(
        F.sum("order_total").alias("total"), F.sum("shipping_fee").alias("fees"), F.count("*").alias("n")
    )
    share = safe_ratio(F.col("fees"), F.col("total"))
    return sums.select(
        "customer_id",
        round_double(safe_ratio(F.col("total"), F.col("n")), 2).alias("mean_total"),
        round_double(share, 4).alias("fee_ratio"),
        round_double(F.lit(100.0) * share, 1).alias("fee_pct"),
    )


@query
def fn_normalise_label(m: Models) -> DataFrame:
    """Region codes and names, countries, priorities and segments brought to one spelling."""
    web = m.stg_web_orders.select(F.explode(F.array("region_code", "site", "marketing_channel")).alias("label"))
    names = m.feeds["mkt_social_ads"].select(F.col("region").alias("label"))
    segments = m.feeds.table("customer").select(F.col("c_mktsegment").alias("label"))
    priorities = m.feeds["pos_transactions"].select(F.col("payment_method").alias("label"))
    labels = web.unionByName(names).unionByName(segments).unionByName(priorities)
    counted = labels.groupBy("label").agg(F.count("*").alias("rows"))
    return counted.select("label", "rows", text.normalise_label(F.col("label")).alias("normalised"))


@query
def fn_parse_number(m: Models) -> DataFrame:
    rows = star_schema.answers(m.feeds)
    return rows.select("id", "answer", text.parse_number(F.col("answer")).alias("number"))


@query
def fn_number_tokens(m: Models) -> DataFrame:
    return text.number_tokens(m.feeds.table("documents"), "doc_id").drop("position")


# analyst queries


@single_pass
def q_running_total(m: Models) -> DataFrame:
    return reports.channel_running_total(m.fct_sales_lines)


@single_pass
def q_rank_within_group(m: Models) -> DataFrame:
    return reports.best_products_per_category(m.fct_sales_lines, m.stg_materials)


@single_pass
def q_cohort_retention(m: Models) -> DataFrame:
    return reports.cohort_retention(m.attributed_orders, m.stg_web_orders)


@single_pass
def q_period_over_period(m: Models) -> DataFrame:
    return reports.period_over_period(m.fct_sales_lines, m.stg_stores)


@single_pass
def q_dedup_audit(m: Models) -> DataFrame:
    return reports.duplicate_audit(m.feeds["pos_transactions"])


# metric layer


@single_pass
def metric_simple(m: Models) -> DataFrame:
    return layer(m).frame(["revenue", "gross_profit", "costed_revenue", "units_sold"], ["sales_channel"])


@single_pass
def metric_ratio(m: Models) -> DataFrame:
    return layer(m).frame(["gross_margin"], ["product_category"])


@single_pass
def metric_multi_fact(m: Models) -> DataFrame:
    return layer(m).frame(["attributed_revenue", "ad_spend", "roas"], ["date", "marketing_channel"])


@query
def metric_by_grain(m: Models) -> DataFrame:
    """Orders and order value at all five grains."""
    parts = [
        layer(m).frame(["orders", "order_revenue", "average_order_value"], ["date"], grain).withColumn("grain", F.lit(grain))
        for grain in dates.GRAINS
    ]
    return reduce(DataFrame.unionByName, parts)


@single_pass
def metric_by_dimension(m: Models) -> DataFrame:
    """Delivery by the shipment's own carrier and by the region's country, one join away."""
    return layer(m).frame(["shipments_due", "on_time_shipments", "on_time_delivery_rate"], ["carrier", "country"])


@single_pass
def metric_filters(m: Models) -> DataFrame:
    filters = [
        Filter("region", "in", ["Auckland", "Sydney", "Melbourne"]),
        Filter("product_category", "!=", "Unknown"),
        Filter("sales_channel", "not in", ["wholesale"]),
        Filter("country", ">=", "AU"),
    ]
    return layer(m).frame(["revenue", "gross_margin"], ["region", "sales_channel"], filters=filters)


@query
def metric_date_range(m: Models) -> DataFrame:
    return layer(m).frame(["revenue", "roas"], ["date", "region"], "quarter", start="1998-10-01", end="1999-03-31")


# data quality


def _check(name: str) -> Callable[[Models], DataFrame]:
    by_name = {c.name: c for c in declared.DECLARED}
    return lambda m: checks.failures(by_name[name], declared.relation_of(m))


@query
def dq_unique(m: Models) -> DataFrame:
    return _check("pos_transaction_line_is_unique")(m)


@query
def dq_not_null(m: Models) -> DataFrame:
    return _check("not_null:fct_sales_lines.revenue_nzd")(m).select("sales_line_id", "order_id", "product_id", "order_date")


@query
def dq_accepted_values(m: Models) -> DataFrame:
    return _check("accepted_values:erp_materials.MATL_GROUP")(m)


@query
def dq_relationships(m: Models) -> DataFrame:
    return _check("erp_sales_order_material_exists")(m)


@query
def dq_expression(m: Models) -> DataFrame:
    return _check("pos_sale_quantity_is_positive")(m).select("store_id", "transaction_id", "line_no", "sku", "quantity")


@query
def dq_column_contract(m: Models) -> DataFrame:
    return _contract_failures(m)


@query
def dq_freshness(m: Models) -> DataFrame:
    return checks.freshness(m.feeds, m.as_of, declared.FRESHNESS)


@query
def dq_currency_label(m: Models) -> DataFrame:
    return declared.currency_label(m.feeds["pos_transactions"], m.stg_stores)


@query
def recon_raw_vs_ledger(m: Models) -> DataFrame:
    return declared.raw_vs_ledger(m.feeds["pos_transactions"], m.stg_fx_rates, m.feeds["erp_gl_store_takings"])


@query
def recon_mart_vs_ledger(m: Models) -> DataFrame:
    return declared.mart_vs_ledger(m.rpt_ledger_reconciliation)


@query
def recon_orders_vs_shipments(m: Models) -> DataFrame:
    cutoff = dates.days_before(m.as_of, declared.SHIPMENT_LAG_DAYS)
    return declared.orders_vs_shipments(m.stg_web_orders, m.stg_shipments, cutoff)


def _audit(m: Models) -> DataFrame:
    """The findings of all checks, stored."""
    found = declared.findings(lines_once(m), _contract_failures(m))
    return sinks.store_failures(found, shared.new_folder(m.spark, "audit"))


@query
def dq_results(m: Models) -> DataFrame:
    return declared.results(m, _audit(m))


def _incidents(m: Models) -> DataFrame:
    return star_schema.incidents(m.feeds)


@query
def dq_expected_vs_fired(m: Models) -> DataFrame:
    found = _audit(m)
    return checks.expected_vs_fired(
        _incidents(m), declared.incident_mapping(m), declared.results(m, found), declared.evidence(found)
    )


@query
def dq_unexplained(m: Models) -> DataFrame:
    """Checks that fire without a known incident behind them."""
    results = declared.results(m, _audit(m))
    return checks.unexplained(_incidents(m), declared.incident_mapping(m), results).select("name", "status", "failing_rows")


@query
def dq_alert_summary(m: Models) -> DataFrame:
    results = declared.results(m, _audit(m))
    return checks.alert_summary(results, m.quarantined_pos_lines)


# comparison and as-delivered reports


def _report_diff(m: Models, report: str = "monthly_sales") -> DataFrame:
    keys_, values = compare.REPORTS[report]
    made = _as_delivered(m).report(report)
    return compare.diff_rows(made, getattr(m, f"rpt_{report}"), keys_, values)


def _named(report: str, rows: DataFrame, *more: str) -> DataFrame:
    return compare.as_fields(rows, *compare.REPORTS[report], more).withColumn("report", F.lit(report))


@query
def table_diff_rows(m: Models) -> DataFrame:
    """Every figure of the four reports in both versions."""
    return reduce(DataFrame.unionByName, [_named(r, _report_diff(m, r), "side", "differs") for r in compare.REPORTS])


@query
def table_diff_summary(m: Models) -> DataFrame:
    """The summary of all four reports."""
    parts = [
        compare.diff_summary(_report_diff(m, report)).withColumn("report", F.lit(report)) for report in compare.REPORTS
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def table_diff_examples(m: Models) -> DataFrame:
    """The first differing rows of each of the four reports."""
    found = [_named(r, compare.diff_examples(_report_diff(m, r), compare.REPORTS[r][0])) for r in compare.REPORTS]
    return reduce(DataFrame.unionByName, found)


for _report in compare.REPORTS:

    def _naive(spark: SparkSession, sf_dir: str, report: str = _report) -> DataFrame:
        m = from_feeds(spark, sf_dir)
        return plain(as_delivered.AsDelivered(m.feeds, m.material_groups, m.dim_regions).report(report))

    QUERIES[f"naive_{_report.removeprefix('monthly_') if _report != 'monthly_sales' else _report}"] = _naive


# weekly facts, grounding, scoring


@query
def weekly_pair_facts(m: Models) -> DataFrame:
    return weekly.pair_facts(layer(m))


@query
def weekly_best_worst_channel(m: Models) -> DataFrame:
    return weekly.best_and_weakest_channel(layer(m))


@query
def weekly_top_region(m: Models) -> DataFrame:
    return weekly.top_region(layer(m))


@query
def grounding_check(m: Models) -> DataFrame:
    return grounding.ungrounded(m.feeds.table("documents"), star_schema.report_facts(m.feeds), "doc_id").drop("position")


@query
def score_answers(m: Models) -> DataFrame:
    rows = star_schema.answers(m.feeds)
    return scoring.score(rows.select("id", "answer"), rows.select("id", "kind", "metric", "expected"))


@query
def score_oracle(m: Models) -> DataFrame:
    """Every question answered by the metric layer in shared passes, and scored against answers that do not use it."""
    answers = scoring.answer_all(layer(m), QUESTIONS)
    facts = truth.cells(m.fct_sales_lines, m.attributed_orders, m.fct_ad_spend, m.fct_shipments, m.dim_regions)
    true = truth.answers(facts, truth.predicates(m.spark, QUESTIONS))
    scored = scoring.score(scoring.as_text(answers), truth.references(true)).join(answers, ["id"], "left")
    expected = true.select("id", F.col("number").alias("expected_number"), F.col("label").alias("expected_label"))
    return scored.join(expected, "id").select("id", "kind", "metric", "number", "label", "expected_number", "expected_label", "correct")


@query
def score_summary(m: Models) -> DataFrame:
    return scoring.summary(star_schema.evaluation_rows(m.feeds))


@query
def score_misses(m: Models) -> DataFrame:
    return scoring.misses(star_schema.evaluation_rows(m.feeds)).select("id", "split", "system", "error")
