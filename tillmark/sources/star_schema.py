"""The raw retail feeds, derived from the star-schema test tables.

Every feed comes out as the text columns a landing zone would deliver, so the models run on it unchanged. What is
not in the tables (currencies, file names, extract times, planted faults) follows from keys and dates by fixed rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.functions.dates import date_series
from tillmark.functions.money import to_nzd
from tillmark.plans import staging
from tillmark.sources.shared import written

AS_OF = datetime(2001, 8, 3, 6, 0, 0)
CALENDAR = (date(1995, 1, 1), date(2001, 12, 31))
EVENT_SHIFT_DAYS = 9131

# How key remainders of the test tables map to the domain.
REGION_OF = ["AKL", "WLG", "SYD", "MEL", "CHC"]
REGION_NAME_OF = ["Auckland", "Wellington", "Sydney", "Melbourne", "Christchurch"]
MARKETING_OF = ["paid_search", "paid_social", "display", "email", "affiliate", "organic"]
MATERIAL_GROUP_OF = {"ECONOMY": "CW", "STANDARD": "BW", "MEDIUM": "KT", "PROMO": "TW", "LARGE": "FS"}
UNLISTED_GROUP = "ZZ"


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), index.cast("int") + 1)


def _is_australian(index: Column) -> Column:
    return index.isin(2, 3)


def _currency(index: Column) -> Column:
    return F.when(_is_australian(index), "AUD").otherwise("NZD")


def _country(index: Column) -> Column:
    return F.when(_is_australian(index), "AU").otherwise("NZ")


def _text(col: Column) -> Column:
    return col.cast("string")


def _stamp(day: Column, time: str = "00:00:00") -> Column:
    return F.concat(_text(day), F.lit(f" {time}"))


def _compact(day: Column) -> Column:
    return F.replace(_text(day), F.lit("-"), F.lit(""))


def _month(day: Column) -> Column:
    return F.substring(_text(day), 1, 7)


def _extracted(day: Column, extra: Column | int = 0) -> Column:
    return _stamp(F.date_add(day, (extra if isinstance(extra, Column) else F.lit(extra)) + 1), "02:00:00")


def _monthly_file(prefix: str, day: Column) -> Column:
    return F.concat(F.lit(prefix), _month(day), F.lit(".csv"))


class StarSchemaFeeds(Mapping[str, DataFrame]):
    """Feeds by name; a feed's tables are opened when it is asked for, and read in place: a feed of lines is a filter on its scan.

    Finance books cleaned till lines. ``cleaned`` may give a stored copy of them; without it they are made here.
    """

    def __init__(self, spark: SparkSession, folder: str, cleaned: Callable[[], DataFrame] | None = None) -> None:
        self.spark, self.folder, self.cleaned = spark, folder, cleaned or self._cleaned
        self._made: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}
        self._makers: dict[str, Callable[[], DataFrame]] = {
            "erp_materials": self._materials,
            "erp_customers": self._customers,
            "erp_stores": self._stores,
            "erp_fx_rates": self._fx_rates,
            "erp_gl_store_takings": self._ledger,
            "erp_sales_order_headers": self._headers,
            "erp_sales_order_items": self._items,
            "pos_transactions": self._pos,
            "ecom_orders": self._web_orders,
            "ecom_order_lines": self._web_lines,
            "logistics_shipments": self._shipments,
            "mkt_search_ads": self._search_ads,
            "mkt_social_ads": self._social_ads,
            "mkt_other_channels": self._other_ads,
        }

    def __getitem__(self, feed: str) -> DataFrame:
        if feed not in self._made:
            self._made[feed] = self._makers[feed]()
        return self._made[feed]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def orders(self, *channels: int) -> DataFrame:
        """Orders of some channels: 0 store, 1 online, 2 wholesale; of all without any."""
        rows = self.table("orders").withColumn("day", F.col("o_orderdate").cast("date"))
        return rows.filter((F.col("o_orderkey") % 3).isin(*channels)) if channels else rows

    def lines(self, *channels: int) -> DataFrame:
        listed = F.col("l_extendedprice").cast("decimal(12,2)")
        discount = F.col("l_discount").cast("decimal(4,2)")
        amount = F.round(listed * (F.lit(1).cast("decimal(4,2)") - discount), 2).cast("decimal(12,2)")
        rows = self.table("lineitem").withColumn("channel", (F.col("l_orderkey") % 3).cast("int"))
        chosen = rows.filter(F.col("channel").isin(*channels)) if channels else rows
        return chosen.withColumn("listed", listed).withColumn("amount", amount)

    # master data

    def _materials(self) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(12,2)")
        group = F.lit(UNLISTED_GROUP)
        for part_type, code in MATERIAL_GROUP_OF.items():
            group = F.when(F.col("p_type") == part_type, code).otherwise(group)
        created = F.date_add(F.lit(date(1994, 1, 1)), (F.col("p_partkey") % 365).cast("int"))
        return self.table("part").filter(F.col("p_partkey") % 97 != 0).select(
            F.concat(F.lit("MAT-"), "p_partkey").alias("MATERIAL"),
            F.concat(F.lit("SKU-"), "p_partkey").alias("SKU"),
            F.col("p_name").alias("DESCRIPTION"),
            group.alias("MATL_GROUP"),
            _text(F.round(price * F.lit("0.40").cast("decimal(3,2)"), 2).cast("decimal(12,2)")).alias("STD_COST_NZD"),
            _text(price).alias("LIST_PRICE_NZD"),
            _text(F.round(price * F.lit("0.92").cast("decimal(3,2)"), 2).cast("decimal(12,2)")).alias("LIST_PRICE_AUD"),
            _compact(created).alias("CREATED_ON"),
            F.lit("2001-08-02 02:00:00").alias("_extracted_at"),
            F.lit("erp/materials.csv").alias("_source_file"),
        )

    def _customers(self) -> DataFrame:
        nations = self.table("nation").select("n_nationkey", "n_regionkey")
        return self.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("C-"), "c_custkey").alias("CUSTOMER"),
            F.col("c_name").alias("NAME"),
            _country(F.col("n_regionkey")).alias("COUNTRY"),
            _pick(REGION_OF, F.col("n_regionkey")).alias("REGION_CODE"),
            F.lit("2001-08-01 02:00:00").alias("_extracted_at"),
            F.lit("erp/customers.csv").alias("_source_file"),
        )

    def _stores(self) -> DataFrame:
        region = F.col("n_regionkey")
        return self.table("nation").select(
            F.concat(F.lit("S0"), F.col("n_nationkey") + 1).alias("STORE_ID"),
            F.concat(F.lit("Store "), "n_name").alias("STORE_NAME"),
            _pick(REGION_OF, region).alias("REGION_CODE"),
            _country(region).alias("COUNTRY"),
            _currency(region).alias("CURRENCY"),
            F.lit("2001-08-02 02:00:00").alias("_extracted_at"),
            F.lit("erp/stores.csv").alias("_source_file"),
        )

    def _fx_rates(self) -> DataFrame:
        """A rate for every day the orders span but 25 December; the reverse pair on the first of each month."""
        span = self.table("orders").agg(
            F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last")
        )
        day = F.col("date_day")
        rate = F.lit("1.05").cast("decimal(10,4)") + F.lit("0.01").cast("decimal(10,4)") * (F.day(day) % 7)
        days = date_series(self.spark, F.col("first"), F.col("last"), span)
        pair = F.struct(F.lit("AUD").alias("f"), F.lit("NZD").alias("t"), rate.cast("decimal(10,4)").alias("r"))
        back = F.struct(
            F.lit("NZD").alias("f"), F.lit("AUD").alias("t"), F.lit("0.9000").cast("decimal(10,4)").alias("r")
        )
        quoted = F.when(F.day(day) == 1, F.array(pair, back)).otherwise(F.array(pair))
        return days.filter(F.date_format(day, "MM-dd") != "12-25").withColumn("q", F.explode(quoted)).select(
            _compact(day).alias("RATE_DATE"),
            F.col("q.f").alias("FROM_CURR"),
            F.col("q.t").alias("TO_CURR"),
            _text(F.col("q.r")).alias("RATE"),
            _extracted(day).alias("_extracted_at"),
            F.lit("erp/fx_rates.csv").alias("_source_file"),
        )

    # tills and ledger

    def every_order(self) -> DataFrame:
        """The orders of all channels in one shape."""
        place, total = F.col("o_custkey") % 5, F.col("o_totalprice").cast("decimal(12,2)")
        return self.orders().select(
            F.concat(F.lit("O-"), "o_orderkey").alias("order_id"),
            F.concat(F.lit("U-"), "o_custkey").alias("customer_id"),
            F.col("day").alias("order_date"),
            _pick(REGION_OF, place).alias("region_code"),
            _currency(place).alias("currency"),
            F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("completed").alias("order_status"),
            total.alias("order_total"),
            F.lit("9.90").cast("decimal(12,2)").alias("shipping_fee"),
        )

    def _pos(self) -> DataFrame:
        return self.till_lines(0)

    def till_lines(self, *channels: int) -> DataFrame:
        """Lines as tills write them. The test tables repeat (order, line) pairs; the repeats are the duplicate deliveries.

        Lines meet their order by the transaction's number, so that whoever looks for copies in a transaction finds its lines together.
        """
        number = lambda key: F.concat(F.lit("T-"), key).alias("transaction_id")
        orders = self.orders(*channels).select(number("o_orderkey"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "day")
        lines = self.lines(*channels).withColumn("transaction_id", number("l_orderkey")).join(orders, ["transaction_id"])
        store = F.col("o_custkey") % 25
        is_return = F.col("o_orderstatus") == "P"
        keyed_wrong = (F.col("l_linenumber") == 7) & (F.col("l_quantity") < 3)
        not_keyed = (F.col("l_linenumber") == 5) & (F.col("l_quantity") == 1) & (F.col("l_partkey") % 2 == 0)
        sign = F.when(is_return | keyed_wrong, -1).otherwise(1)
        store_id = F.concat(F.lit("S0"), (store + 1).cast("string"))
        return lines.select(
            store_id.alias("store_id"),
            "transaction_id",
            _text(F.col("l_linenumber")).alias("line_no"),
            _stamp(F.col("day")).alias("txn_ts"),
            F.when(is_return, "RETURN").otherwise("SALE").alias("txn_type"),
            F.concat(F.lit("SKU-"), "l_partkey").alias("sku"),
            F.when(~not_keyed, _text(F.col("l_quantity").cast("int") * sign)).alias("quantity"),
            _text(F.col("listed")).alias("unit_price"),
            _text(F.col("listed") - F.col("amount")).alias("discount_amount"),
            _text((F.col("amount") * sign).cast("decimal(12,2)")).alias("line_total"),
            F.when(F.col("o_orderkey") % 41 == 0, "NZD").otherwise(_currency(store % 5)).alias("currency"),
            F.col("o_orderpriority").alias("payment_method"),
            _extracted(F.col("day"), (F.col("l_suppkey") % 3).cast("int")).alias("_extracted_at"),
            F.concat(
                F.lit("pos/"), store_id, F.lit("/pos_"), store_id, F.lit("_"), _month(F.col("day")), F.lit(".csv")
            ).alias("_source_file"),
        )

    def _cleaned(self) -> DataFrame:
        return staging.pos_lines(self["pos_transactions"], staging.stores(self["erp_stores"]))

    def _ledger(self) -> DataFrame:
        """Finance books what the tills took once cleaned, and 1.00 too much on the 13th of each month."""
        valid = self.cleaned().filter("is_valid")
        rates = staging.fx_rates(self["erp_fx_rates"]).withColumnRenamed("rate_date", "txn_date")
        nzd = to_nzd(F.col("line_total"), F.col("currency"), F.col("aud_nzd_rate"))
        days = (
            valid.join(rates, ["txn_date"], "left")
            .groupBy("store_id", "txn_date", "currency")
            .agg(F.sum("line_total").alias("local"), F.sum(nzd).alias("nzd"))
        )
        surplus = F.when(F.day("txn_date") == 13, F.lit("1.00").cast("decimal(3,2)")).otherwise(F.lit(0))
        postings = days.select(
            _compact(F.col("txn_date")).alias("POSTING_DATE"),
            F.col("store_id").alias("STORE_ID"),
            F.lit("400000").alias("GL_ACCOUNT"),
            F.col("currency").alias("CURRENCY"),
            _text(F.col("local").cast("decimal(14,2)")).alias("AMOUNT_LOCAL"),
            _text((F.round("nzd", 2) + surplus).cast("decimal(14,2)")).alias("AMOUNT_NZD"),
            _extracted(F.col("txn_date")).alias("_extracted_at"),
            _monthly_file("erp/gl_store_takings_", F.col("txn_date")).alias("_source_file"),
        )
        # a feed is delivered, not recomputed by everyone who reads it
        return written(postings, "ledger_feed")

    # web shop

    def _web_orders(self) -> DataFrame:
        ship = F.col("o_custkey") % 5
        total = F.col("o_totalprice").cast("decimal(12,2)")
        drifted = F.col("day") >= F.lit(date(2000, 1, 1))
        return self.orders(1).select(
            F.concat(F.lit("W-"), "o_orderkey").alias("order_id"),
            _stamp(F.col("day")).alias("order_ts"),
            F.concat(F.lit("U-"), "o_custkey").alias("customer_id"),
            _country(ship).alias("site"),
            _pick(REGION_OF, ship).alias("ship_region"),
            _pick(MARKETING_OF, F.col("o_custkey") % 6).alias("marketing_channel"),
            F.when(drifted & (F.col("o_orderkey") % 4 == 1), "SUMMER15").alias("promo_code"),
            _currency(ship).alias("currency"),
            F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("completed").alias("order_status"),
            _text(total).alias("items_subtotal"),
            F.lit("0.00").alias("discount_total"),
            F.lit("9.90").alias("shipping_fee"),
            _text((total + F.lit("9.90").cast("decimal(4,2)")).cast("decimal(12,2)")).alias("order_total"),
            _extracted(F.col("day")).alias("_extracted_at"),
            _monthly_file("ecommerce/orders_", F.col("day")).alias("_source_file"),
        )

    def _web_lines(self) -> DataFrame:
        return self.lines(1).select(
            F.concat(F.lit("W-"), "l_orderkey").alias("order_id"),
            _text(F.col("l_linenumber")).alias("line_no"),
            F.concat(F.lit("SKU-"), "l_partkey").alias("sku"),
            _text(F.col("l_quantity").cast("int")).alias("quantity"),
            _text(F.col("listed")).alias("unit_price"),
            _text(F.col("listed") - F.col("amount")).alias("discount_amount"),
            _text(F.col("amount")).alias("line_total"),
            _extracted(F.col("l_shipdate").cast("date")).alias("_extracted_at"),
            _monthly_file("ecommerce/order_lines_", F.col("l_shipdate").cast("date")).alias("_source_file"),
        )

    # wholesale

    def _headers(self) -> DataFrame:
        return self.orders(2).select(
            F.lpad(_text(F.col("o_orderkey")), 10, "0").alias("VBELN"),
            F.lit("OR").alias("AUART"),
            F.lit("1000").alias("VKORG"),
            F.lit("10").alias("VTWEG"),
            F.lit("00").alias("SPART"),
            _compact(F.col("day")).alias("AUDAT"),
            _compact(F.date_add("day", 14)).alias("VDATU"),
            F.concat(F.lit("C-"), "o_custkey").alias("KUNNR"),
            _currency(F.col("o_orderkey") % 5).alias("WAERK"),
            _text(F.col("o_totalprice").cast("decimal(14,2)")).alias("NETWR"),
            _extracted(F.col("day")).alias("_extracted_at"),
            _monthly_file("erp/vbak_", F.col("day")).alias("_source_file"),
        )

    def _items(self) -> DataFrame:
        extra = F.when(F.col("l_linenumber") == 6, F.lit("0.600").cast("decimal(4,3)")).otherwise(F.lit(0))
        return self.lines(2).select(
            F.lpad(_text(F.col("l_orderkey")), 10, "0").alias("VBELN"),
            F.lpad(_text(F.col("l_linenumber") * 10), 6, "0").alias("POSNR"),
            F.concat(F.lit("MAT-"), "l_partkey").alias("MATNR"),
            _text((F.col("l_quantity").cast("decimal(15,3)") + extra).cast("decimal(15,3)")).alias("KWMENG"),
            F.lit("EA").alias("VRKME"),
            _text(F.col("listed")).alias("NETPR"),
            F.when(F.col("l_linenumber") == 3, "100").otherwise("1").alias("KPEIN"),
            _text(F.col("amount").cast("decimal(14,2)")).alias("NETWR"),
            _currency(F.col("l_orderkey") % 5).alias("WAERK"),
            _extracted(F.col("l_shipdate").cast("date")).alias("_extracted_at"),
            _monthly_file("erp/vbap_", F.col("l_shipdate").cast("date")).alias("_source_file"),
        )

    # logistics

    def _shipments(self) -> DataFrame:
        """Lines not sent back by the carrier are shipments; a few are still on the road."""
        shipped = F.col("l_shipdate").cast("date")
        delivered = F.date_add(shipped, (F.col("l_suppkey") % 9).cast("int"))
        in_transit = (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 47)
        online = F.col("l_orderkey") % 3 == 1
        order_ref = F.when(online, F.concat(F.lit("W-"), "l_orderkey")).otherwise(
            F.lpad(_text(F.col("l_orderkey")), 10, "0")
        )
        return self.lines(1, 2).filter(F.col("l_returnflag") != "R").select(
            F.concat_ws("-", F.lit("SH"), "l_orderkey", "l_linenumber", "l_suppkey").alias("shipment_id"),
            order_ref.alias("order_ref"),
            F.when(online, "online").otherwise("wholesale").alias("channel"),
            F.concat(F.lit("carrier_"), F.col("l_suppkey") % 4).alias("carrier"),
            F.concat(F.lit("DC"), F.col("l_suppkey") % 2).alias("origin_dc"),
            _pick(REGION_OF, F.col("l_orderkey") % 5).alias("dest_region"),
            _text(F.date_add(shipped, 5)).alias("promised_date"),
            _stamp(shipped).alias("shipped_at"),
            F.when(~in_transit, _stamp(delivered, "15:30:00")).alias("delivered_at"),
            F.when(in_transit, "in_transit").otherwise("delivered").alias("status"),
            _extracted(shipped).alias("_extracted_at"),
            _monthly_file("logistics/shipments_", shipped).alias("_source_file"),
        )

    # advertising

    def _clicks(self, *event_types: str) -> DataFrame:
        """Events as spend per day, type, region and campaign, moved back to the time of the orders."""
        day = F.date_sub(F.col("ts").cast("date"), EVENT_SHIFT_DAYS)
        return (
            self.table("events")
            .filter(F.col("event_type").isin(*event_types))
            .groupBy(
                day.alias("day"),
                "event_type",
                (F.col("user_id") % 5).alias("place"),
                (F.col("user_id") % 3).alias("campaign"),
            )
            .agg(F.sum(F.col("value").cast("decimal(12,2)")).alias("spend"), F.count("*").alias("hits"))
        )

    def _search_ads(self) -> DataFrame:
        place = F.col("place")
        return self._clicks("click").select(
            _text(F.col("day")).alias("date"),
            F.concat(F.lit("cmp"), "campaign").alias("campaign_id"),
            F.concat(F.lit("search "), "campaign").alias("campaign_name"),
            F.concat(_country(place), F.lit("-"), _pick(REGION_OF, place)).alias("geo_target"),
            _currency(place).alias("currency"),
            _text((F.col("spend") * 1_000_000).cast("long")).alias("cost_micros"),
            _text(F.col("hits") * 100).alias("impressions"),
            _text(F.col("hits")).alias("clicks"),
            _extracted(F.col("day")).alias("_extracted_at"),
            _monthly_file("marketing/search_ads_", F.col("day")).alias("_source_file"),
        )

    def _social_ads(self) -> DataFrame:
        place = F.col("place")
        unknown_place = (place == 4) & (F.col("campaign") == 2)
        return self._clicks("view").select(
            F.date_format("day", "dd/MM/yyyy").alias("day"),
            F.concat(F.lit("social "), "campaign").alias("campaign_name"),
            F.when(unknown_place, "Hobart").otherwise(_pick(REGION_NAME_OF, place)).alias("region"),
            _text(F.col("spend").cast("decimal(12,2)")).alias("amount_spent"),
            _currency(place).alias("currency"),
            _text(F.col("hits") * 50).alias("reach"),
            _text(F.col("hits")).alias("link_clicks"),
            _extracted(F.col("day")).alias("_extracted_at"),
            _monthly_file("marketing/social_ads_", F.col("day")).alias("_source_file"),
        )

    def _other_ads(self) -> DataFrame:
        place = F.col("place")
        kind = F.col("event_type")
        channel = F.when(kind == "purchase", "display").when(kind == "signup", "email").otherwise("affiliate")
        spend = self._clicks("purchase", "signup", "error").groupBy("day", "event_type", "place").agg(
            F.sum("spend").alias("spend")
        )
        return spend.select(
            _text(F.col("day")).alias("date"),
            channel.alias("channel"),
            _pick(REGION_OF, place).alias("region_code"),
            _text(F.col("spend").cast("decimal(12,2)")).alias("spend"),
            _currency(place).alias("currency"),
            _extracted(F.col("day")).alias("_extracted_at"),
            _monthly_file("marketing/other_channels_", F.col("day")).alias("_source_file"),
        )


# inputs of scoring, grounding and incident checks


def answers(feeds: StarSchemaFeeds) -> DataFrame:
    """Answers and references made from orders: (id, kind, metric, expected, answer), the answer in many notations."""
    key, total = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(14,2)")
    tenths = (key % 1000).cast("decimal(6,1)") / F.lit(10).cast("decimal(3,0)")
    share = _text(((F.col("o_custkey") % 1000) * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(5,3)"))
    percent = _text(((F.col("o_custkey") % 1000) * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(5,1)"))
    priority = F.split_part("o_orderpriority", F.lit("-"), F.lit(2))
    place = F.col("o_custkey") % 5
    metric = F.when(key % 3 == 0, "revenue").when(key % 3 == 1, "gross_margin").otherwise("average_order_value")
    is_label = key % 10 == 9
    region = _pick(REGION_OF, place)
    number = (
        F.when(key % 8 == 0, F.concat(F.lit("NZD "), F.format_number(total.cast("double"), 2)))
        .when(key % 8 == 1, _text(total))
        .when(key % 8 == 2, F.concat(_text(F.floor(total.cast("double") / 1000)), F.lit("k")))
        .when(key % 8 == 3, F.concat(_text(tenths.cast("decimal(6,1)")), F.lit("%")))
        .when(key % 8 == 4, F.lit("n/a"))
        .when(key % 8 == 5, F.concat(_text(F.floor(total.cast("double") / 1000)), F.lit(" thousand")))
        .when(key % 8 == 6, F.concat(F.lit("$"), _text(total + F.lit(1))))
        .otherwise(F.concat(F.lit("-"), _text(total)))
    )
    fraction = F.when(key % 4 == 0, F.concat(percent, F.lit("%"))).when(key % 4 == 1, percent).otherwise(share)
    answer = (
        F.when(is_label, F.when(key % 4 == 1, F.upper(_pick(REGION_NAME_OF, place))).otherwise(priority))
        .when(metric == "gross_margin", fraction)
        .otherwise(number)
    )
    expected = F.when(is_label, region).when(metric == "gross_margin", share).otherwise(_text(total))
    return feeds.table("orders").select(
        _text(key).alias("id"),
        F.when(is_label, "label").otherwise("number").alias("kind"),
        metric.alias("metric"),
        expected.alias("expected"),
        F.when(key % 17 != 0, answer).alias("answer"),
    )


def evaluation_rows(feeds: StarSchemaFeeds) -> DataFrame:
    """One evaluated answer per event."""
    event, user = F.col("event_id"), F.col("user_id")
    prompt, completion = (event % 4000).cast("long"), (user % 300).cast("long")
    usd = F.round(prompt / 1e6 * 0.10 + completion / 1e6 * 0.40, 6)
    return feeds.table("events").select(
        event.alias("id"),
        F.when(user % 4 == 0, "holdout").otherwise("dev").alias("split"),
        F.when(event % 2 == 0, "baseline").otherwise("semantic_agent").alias("system"),
        (F.col("event_type") != "error").alias("correct"),
        F.col("value").alias("latency_s"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (event % 3 + 1).alias("llm_calls"),
        (event % 2).alias("cached_calls"),
        usd.alias("cost_usd"),
        F.when((F.col("event_type") == "error") & (event % 5 == 0), "timeout").alias("error"),
        F.when(event % 97 == 0, "no model").alias("skipped"),
    )


def report_facts(feeds: StarSchemaFeeds) -> DataFrame:
    """Numbers that belong to a document: its length, and quantities and line numbers of the order of its number."""
    lines = feeds.table("lineitem")
    own = feeds.table("documents").select("doc_id", F.col("n_chars").cast("double").alias("value"))
    quantity = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("value"))
    discount = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_discount").alias("value"))
    return own.unionByName(quantity).unionByName(discount)


def incidents(feeds: StarSchemaFeeds) -> DataFrame:
    """What went wrong on purpose in the feeds, from the tables alone: (id, kind, place)."""
    lines, orders = feeds.table("lineitem"), feeds.orders(0)
    store = F.concat(F.lit("S0"), (F.col("o_custkey") % 25 + 1).cast("string"))
    sold = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def found(kind: str, df: DataFrame, *place: Column) -> DataFrame:
        named = df.select(F.lit(kind).alias("kind"), F.concat_ws("|", *place).alias("place")).distinct()
        return named.select(F.concat_ws(":", "kind", "place").alias("id"), "kind", "place")

    negative = sold.filter("o_orderstatus <> 'P' and l_linenumber = 7 and l_quantity < 3")
    mixed_up = sold.filter("o_orderkey % 41 = 0 and o_custkey % 25 % 5 in (2, 3)")
    missing = lines.filter("l_orderkey % 3 = 2 and l_partkey % 97 = 0")
    drifted = feeds.orders(1).filter(F.col("day") >= F.lit(date(2000, 1, 1)))
    parts = [
        found("negative_quantity", negative, F.concat(F.lit("T-"), "o_orderkey")),
        found("currency_mixup", mixed_up, store, _month(F.col("day"))),
        found("missing_foreign_key", missing, F.concat(F.lit("MAT-"), "l_partkey")),
        found("schema_drift", drifted, F.lit("promo_code")),
        found("late_file", feeds.orders(1).filter("o_orderstatus <> 'P'"), F.lit("logistics/shipments")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
