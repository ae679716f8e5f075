"""Monthly reports and analyst queries.

Windows run on monthly aggregates, never on lines. Amounts stay exact decimals until the last projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.dates import add_months, month_diff, month_label, month_of, parse_timestamp
from tillmark.functions.money import exact_sum, money, round_double, rounded, safe_ratio
from tillmark.functions.ordering import ascending, descending
from tillmark.operators.aggregates import avg_if, count_if, distinct_if, sum_if
from tillmark.operators.joins import beside_scalars, facts_together
from tillmark.operators.ranking import running, sequence_of, top_by_rank, with_share
from tillmark.plans.marts import INFERRED_DESCRIPTION
from tillmark.plans.staging import first_copies
from tillmark.sources.shared import written

def monthly_sales(lines: DataFrame) -> DataFrame:
    """Month x channel x region, with the change on the prior month present and the running total.

    The running total never restarts: a second financial year continues the first.
    """
    monthly = lines.groupBy(month_of("order_date").alias("month"), "sales_channel", "region_code").agg(
        distinct_if(F.col("order_type") == "sale", F.col("order_id")).alias("orders"),
        F.sum("quantity").alias("units"),
        *(F.sum(c).alias(c) for c in ("revenue_nzd", "cogs_nzd", "gross_profit_nzd")),
    )
    place = ["sales_channel", "region_code"]
    change = F.col("revenue_nzd") - F.lag("revenue_nzd").over(sequence_of(["month"], place))
    to_date = F.sum("revenue_nzd").over(running(["month"], place))
    return monthly.select(
        "month",
        *place,
        "orders",
        "units",
        *(rounded(F.col(c), 2).alias(c) for c in ("revenue_nzd", "cogs_nzd", "gross_profit_nzd")),
        rounded(change, 2).alias("revenue_change_vs_prior_month"),
        rounded(to_date, 2).alias("revenue_year_to_date"),
    )


def monthly_category_margin(lines: DataFrame) -> DataFrame:
    """Margin is profit over the revenue of the lines whose cost is known."""
    monthly = lines.groupBy(month_of("order_date").alias("month"), "product_category").agg(
        F.sum("revenue_nzd").alias("revenue_nzd"),
        F.sum("gross_profit_nzd").alias("gross_profit_nzd"),
        sum_if(F.col("has_cost"), F.col("revenue_nzd")).alias("costed_revenue_nzd"),
    )
    best_first = Window.partitionBy("month").orderBy(*descending("gross_profit_nzd"))
    return monthly.select(
        "month",
        "product_category",
        rounded(F.col("revenue_nzd"), 2).alias("revenue_nzd"),
        rounded(F.col("gross_profit_nzd"), 2).alias("gross_profit_nzd"),
        round_double(safe_ratio(F.col("gross_profit_nzd"), F.col("costed_revenue_nzd")), 4).alias("gross_margin"),
        F.rank().over(best_first).alias("gross_profit_rank"),
    )


def monthly_marketing(spend: DataFrame, orders: DataFrame) -> DataFrame:
    """Spend and attributed revenue per paid channel; both facts are added up in one aggregation."""
    keys = ["month", "marketing_channel"]
    spent = spend.withColumn("month", month_of("spend_date"))
    credited = orders.filter(F.col("is_paid_attribution") & (F.col("order_type") == "sale"))
    earned = credited.withColumn("month", month_of("order_date"))
    both = facts_together(
        [(spent, {"spent": (exact_sum, F.col("spend_nzd"))}), (earned, {"earned": (F.sum, F.col("revenue_nzd"))})], keys
    )
    return both.select(
        *keys,
        rounded(F.coalesce("spent", F.lit(0)), 2).alias("ad_spend_nzd"),
        rounded(F.coalesce("earned", F.lit(0)), 2).alias("attributed_revenue_nzd"),
        round_double(safe_ratio(F.col("earned"), F.col("spent")), 4).alias("roas"),
    )


def monthly_delivery(shipments: DataFrame) -> DataFrame:
    """By the month a delivery was promised for. A shipment not delivered yet counts as due and not on time."""
    on_time = F.col("is_on_time")
    return (
        shipments.groupBy(month_of("promised_date").alias("month"), "sales_channel")
        .agg(
            F.count("*").alias("shipments"),
            count_if(on_time).alias("on_time_shipments"),
            avg_if(~on_time, F.col("days_late")).alias("late"),
        )
        .select(
            "month",
            "sales_channel",
            "shipments",
            "on_time_shipments",
            round_double(safe_ratio(F.col("on_time_shipments"), F.col("shipments")), 4).alias("on_time_rate"),
            round_double(F.col("late"), 2).alias("avg_days_late_when_late"),
        )
    )


def described(products: DataFrame, materials: DataFrame) -> DataFrame:
    """Adds the product description; a product missing from the master gets the inferred one."""
    names = materials.select(F.col("material_id").alias("product_id"), "description", F.lit(True).alias("_known"))
    inferred = F.when(F.col("product_id").isNotNull() & F.col("_known").isNull(), F.lit(INFERRED_DESCRIPTION))
    return products.join(names, ["product_id"], "left").withColumn(
        "description", F.coalesce(inferred, F.col("description"))
    ).drop("_known")


def product_months(lines: DataFrame) -> DataFrame:
    return lines.groupBy(month_of("order_date").alias("month"), "product_id", "product_category").agg(
        F.sum("quantity").alias("units"), F.sum("revenue_nzd").alias("revenue_nzd")
    )


def top_products(lines: DataFrame, materials: DataFrame, n: int = 10) -> DataFrame:
    """The best sellers of each month. Only the winners are given their description.

    The totals of the months come from the lines and are written, a row a month, so the products of a month do not travel for them.
    """
    products = product_months(lines)
    revenue = F.sum(F.col("revenue_nzd").cast(products.schema["revenue_nzd"].dataType)).alias("month_revenue")
    totals = written(lines.groupBy(month_of("order_date").alias("month")).agg(revenue), "month-totals")
    monthly = with_share(products, ["month"], "revenue_nzd", "month_revenue", totals)
    winners = top_by_rank(monthly, ["month"], "revenue_nzd", n, "revenue_rank", dense=True)
    return described(winners, materials).select(
        "month",
        "revenue_rank",
        "product_id",
        "description",
        "product_category",
        "units",
        rounded(F.col("revenue_nzd"), 2).alias("revenue_nzd"),
        round_double(safe_ratio(F.col("revenue_nzd"), F.col("month_revenue")), 4).alias("share_of_month"),
    )


def ledger_reconciliation(lines: DataFrame, ledger: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Cleaned tills against the ledger per store-day, with the lines held back that day."""
    keys = ["store_id", "business_date"]
    tills = lines.filter(F.col("sales_channel") == "store").withColumnRenamed("order_date", "business_date")
    booked = ledger.withColumnRenamed("posting_date", "business_date")
    held = quarantined.withColumnRenamed("txn_date", "business_date")
    one = F.lit(1)
    days = facts_together(
        [
            (tills, {"till": (F.sum, F.col("revenue_nzd")), "till_rows": (F.count, one)}),
            (booked, {"booked": (F.sum, F.col("amount_nzd")), "booked_rows": (F.count, one)}),
            (held, {"held": (F.count, one)}),
        ],
        keys,
    ).filter("till_rows > 0 or booked_rows > 0")
    till, booked_ = F.coalesce("till", F.lit(0)), F.coalesce("booked", F.lit(0))
    return days.select(
        *keys,
        rounded(till, 2).alias("pos_revenue_nzd"),
        rounded(booked_, 2).alias("ledger_amount_nzd"),
        rounded(till - booked_, 2).alias("difference_nzd"),
        F.coalesce("held", F.lit(0)).cast("long").alias("quarantined_lines"),
    )


# analyst queries


def channel_running_total(lines: DataFrame) -> DataFrame:
    monthly = lines.groupBy(month_of("order_date").alias("m"), "sales_channel").agg(
        F.sum("revenue_nzd").alias("revenue")
    )
    return (
        monthly.withColumn("to_date", F.sum("revenue").over(running(["m"], ["sales_channel"])))
        .orderBy(*ascending("sales_channel", "m"))
        .select(
            month_label("m").alias("month"),
            "sales_channel",
            rounded(F.col("revenue"), 2).alias("revenue_nzd"),
            rounded(F.col("to_date"), 2).alias("fy_revenue_to_date_nzd"),
        )
    )


def best_products_per_category(lines: DataFrame, materials: DataFrame, n: int = 3) -> DataFrame:
    """Best sellers of each category by revenue, ties kept, with their share of the category.

    Products of one name count together, so revenue is summed per product first and per name after the lookup.
    """
    per_product = lines.filter(F.col("product_id").isNotNull()).groupBy("product_category", "product_id").agg(
        F.sum("revenue_nzd").alias("revenue"), F.sum("quantity").alias("units")
    )
    per_name = described(per_product, materials).groupBy("product_category", "description").agg(
        F.sum("revenue").alias("revenue"), F.sum("units").alias("units")
    )
    shared = with_share(per_name, ["product_category"], "revenue", "category_revenue")
    best = top_by_rank(shared, ["product_category"], "revenue", n, "rank_in_category")
    share = F.lit(100.0) * safe_ratio(F.col("revenue"), F.col("category_revenue"))
    return best.orderBy(*ascending("product_category", "rank_in_category")).select(
        "product_category",
        "rank_in_category",
        "description",
        "units",
        rounded(F.col("revenue"), 2).alias("revenue_nzd"),
        round_double(share, 1).alias("pct_of_category"),
    )


def customer_orders(orders: DataFrame, web_orders: DataFrame) -> DataFrame:
    """The month of every web order with its customer."""
    online = orders.filter(F.col("sales_channel") == "online").select(
        "order_id", month_of("order_date").alias("order_month")
    )
    return online.join(web_orders.select("order_id", "customer_id"), ["order_id"])


def customer_activity(customer_orders_: DataFrame) -> DataFrame:
    """One row per customer and month with an order, counted from the customer's first month.

    The orders are reduced to distinct months first, so a customer's window is no longer than the calendar.
    """
    months = customer_orders_.select("customer_id", "order_month").distinct()
    first = F.min("order_month").over(Window.partitionBy("customer_id"))
    return months.withColumn("cohort_month", first).withColumn(
        "months_since_first", month_diff(F.col("cohort_month"), F.col("order_month"))
    )


def cohort_retention(orders: DataFrame, web_orders: DataFrame) -> DataFrame:
    """Share of each cohort that ordered again 1, 2 and 3 months later; NULL for months after the data ends.

    Activity has one row per customer and month, so counting rows counts customers.
    """
    since = F.col("months_since_first")
    cohorts = (
        customer_activity(customer_orders(orders, web_orders))
        .groupBy("cohort_month")
        .agg(*(count_if(since == k).alias(f"m{k}") for k in range(4)), F.max("order_month").alias("last"))
    )
    ended = beside_scalars(cohorts, cohorts.agg(F.max("last").alias("last_month")))

    def retained(k: int) -> Column:
        seen = add_months(F.col("cohort_month"), k) <= F.col("last_month")
        share = F.lit(100.0) * safe_ratio(F.col(f"m{k}"), F.col("m0"))
        return F.when(seen, round_double(share, 1)).alias(f"retained_m{k}_pct")

    return ended.orderBy(*ascending("cohort_month")).select(
        month_label("cohort_month").alias("cohort"),
        F.col("m0").alias("customers"),
        *(retained(k) for k in (1, 2, 3)),
    )


def store_months(lines: DataFrame, stores: DataFrame) -> DataFrame:
    per_store = lines.filter(F.col("sales_channel") == "store").groupBy("store_id", month_of("order_date").alias("m")).agg(
        F.sum("revenue_nzd").alias("revenue")
    )
    named = per_store.join(stores.select("store_id", "store_name"), ["store_id"])
    return named.groupBy("store_name", "m").agg(F.sum("revenue").alias("revenue"))


def period_over_period(lines: DataFrame, stores: DataFrame) -> DataFrame:
    """Each store month against the store's month before and its own monthly average."""
    months = store_months(lines, stores)
    prior = F.lag("revenue").over(sequence_of(["m"], ["store_name"]))
    usual = F.avg(F.col("revenue").cast("double")).over(Window.partitionBy("store_name"))
    hundred = F.lit(100.0)
    return (
        months.withColumn("prior", prior)
        .withColumn("usual", usual)
        .orderBy(*ascending("store_name", "m"))
        .select(
            "store_name",
            month_label("m").alias("month"),
            rounded(F.col("revenue"), 2).alias("revenue_nzd"),
            rounded(F.col("prior"), 2).alias("prior_month_nzd"),
            round_double(hundred * (safe_ratio(F.col("revenue"), F.col("prior")) - 1), 1).alias("change_pct"),
            round_double(hundred * (safe_ratio(F.col("revenue"), F.col("usual")) - 1), 1).alias("vs_store_average_pct"),
        )
    )


def duplicate_audit(pos: DataFrame) -> DataFrame:
    """Store-days that were delivered more than once: lines delivered, kept, and the takings of the copies.

    Delivered lines and first copies are counted apart and added up per store-day, so no task holds all copies of
    one line.
    """
    columns = ["store_id", parse_timestamp("txn_ts").cast("date").alias("business_date")]
    total = money("line_total")
    delivered = pos.select(*columns, F.lit(1).alias("seen"), F.lit(0).alias("kept"), total.alias("amount"))
    kept = first_copies(pos).select(*columns, F.lit(0).alias("seen"), F.lit(1).alias("kept"), (-total).alias("amount"))
    copies_with_amount = F.sum(F.when(F.col("amount").isNotNull(), F.col("seen") - F.col("kept")))
    return (
        delivered.unionByName(kept)
        .groupBy("store_id", "business_date")
        .agg(
            F.sum("seen").alias("lines_delivered"),
            F.sum("kept").alias("lines_kept"),
            (F.sum("seen") - F.sum("kept")).alias("duplicate_lines_removed"),
            F.when(copies_with_amount > 0, rounded(F.sum("amount"), 2)).alias("duplicated_takings"),
        )
        .filter(F.col("duplicate_lines_removed") > 0)
        .orderBy(*descending("duplicate_lines_removed"), *ascending("store_id", "business_date"))
    )
