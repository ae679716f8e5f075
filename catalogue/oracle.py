"""DuckDB SQL for the queries, written by hand on top of ``catalogue.base``."""

from __future__ import annotations

from catalogue.base import AS_OF, build, country, currency, region
from catalogue.questions import QUESTIONS
from tillmark.sources.star_schema import CALENDAR

ORACLES: dict[str, str] = {}


def oracle(name: str, select: str, extra: str = "") -> None:
    ORACLES[name] = build(select, extra)


def cast(columns: str, to: str = "double") -> str:
    return ", ".join(f"cast({c.strip()} as {to}) as {c.strip()}" for c in columns.split(","))


def month(column: str) -> str:
    return f"cast(date_trunc('month', {column}) as date)"


D = cast

# staging, intermediate relations and marts

oracle(
    "stg_materials",
    "select material_id, sku, description, material_group, product_category, created_on, "
    + D("standard_cost_nzd, list_price_nzd, list_price_aud")
    + " from stg_materials",
)
oracle("stg_customers", "select * from stg_customers")
oracle("stg_stores", "select * from stg_stores")
oracle("stg_fx_rates", "select rate_date, " + D("aud_nzd_rate") + " from stg_fx")
oracle("stg_ledger", "select posting_date, store_id, gl_account, currency, " + D("amount_local, amount_nzd") + " from ledger")
oracle(
    "stg_pos_lines",
    "select pos_line_id, store_id, transaction_id, line_no, txn_ts, txn_date, txn_type, sku, quantity, "
    + D("unit_price, discount_amount, line_total")
    + ", currency, reported_currency, payment_method, is_valid, _source_file from stg_pos",
)
oracle(
    "stg_web_orders",
    "select order_id, order_ts, order_date, customer_id, site, region_code, marketing_channel, currency, order_status, "
    + D("items_subtotal, discount_total, shipping_fee, order_total")
    + " from stg_web_orders",
)
oracle(
    "stg_web_order_lines",
    "select order_line_id, order_id, line_no, sku, quantity, " + D("unit_price, discount_amount, line_total") + " from stg_web_lines",
)
oracle(
    "stg_wholesale_lines",
    "select sales_order_line_id, sales_order_id, item, order_date, customer_id, material_id, quantity, unit_of_measure, "
    + D("unit_price, net_value")
    + ", currency, requested_delivery_date, _source_file from stg_wholesale",
)
SPEND = "spend_date, marketing_channel, region_code, campaign_name, currency, spend_local, " + cast("impressions, clicks", "bigint") + ", source_platform"
oracle("stg_ad_spend", f"select {SPEND} from stg_spend")
oracle("stg_shipments", "select * from stg_shipments")
oracle(
    "quarantined_pos_lines",
    "select pos_line_id, store_id, transaction_id, line_no, txn_date, txn_type, sku, quantity, "
    + D("line_total")
    + ", currency, reason, _source_file from quarantined",
)
LINE = (
    "sales_line_id, order_id, sales_channel, store_id, order_date, region_code, product_id, quantity, "
    + D("amount_local")
    + ", currency, order_type, marketing_channel"
)
oracle("int_sales_lines", f"select {LINE}, " + D("fx_rate, revenue_nzd, cogs_nzd") + ", has_cost from int_lines")
ROLLUP = "cast(line_count as bigint) as line_count, cast(units as bigint) as units, cast(revenue_nzd as double) as revenue_nzd"
oracle(
    "int_sales_orders",
    "select order_id, sales_channel, store_id, order_date, region_code, order_type, marketing_channel, " + ROLLUP + " from int_orders",
)
oracle("int_spend_nzd", f"select {SPEND}, cast(spend_nzd as double) as spend_nzd from int_spend")
oracle(
    "fct_sales_lines",
    "select sales_line_id, order_id, order_date, sales_channel, store_id, region_code, product_id, product_category, order_type,"
    " is_return, quantity, source_currency, has_cost, "
    + D("amount_local, fx_rate, revenue_nzd, cogs_nzd, gross_profit_nzd")
    + " from fct_lines",
)
oracle(
    "fct_orders",
    "select order_id, order_date, sales_channel, store_id, region_code, order_type, marketing_channel, is_paid_attribution, "
    + ROLLUP
    + ", cast(revenue_rank_in_day as integer) as revenue_rank_in_day from fct_orders",
)
oracle(
    "fct_ad_spend",
    "select spend_id, spend_date, marketing_channel, region_code, campaign_name, source_platform, billing_currency, spend_local,"
    " cast(spend_nzd as double) as spend_nzd, " + cast("impressions, clicks", "bigint") + " from fct_spend",
)
oracle("fct_shipments", "select * from fct_shipments")
oracle(
    "dim_products",
    "select product_id, sku, description, product_category, created_on, is_inferred, "
    + D("standard_cost_nzd, list_price_nzd, list_price_aud")
    + " from dim_products",
)
oracle(
    "dim_date",
    "select date_day, cast(date_trunc('week', date_day) as date) as week_start, cast(date_trunc('month', date_day) as date) as"
    " month_start, cast(date_trunc('quarter', date_day) as date) as quarter_start, cast(extract(year from date_day) + case when"
    " extract(month from date_day) >= 4 then 1 else 0 end as integer) as fiscal_year, cast(extract(isodow from date_day) as integer)"
    " as iso_day_of_week, extract(isodow from date_day) >= 6 as is_weekend, orders from (select cast(unnest(generate_series(a, b,"
    " interval 1 day)) as date) as date_day from (select min(order_date) as a, max(order_date) as b from stg_web_orders)) days"
    " left join (select order_date, count(*) as orders from stg_web_orders group by 1) c on order_date = date_day",
)

# reports

MONTHLY = (
    "monthly as (select " + month("order_date") + " as month, sales_channel, region_code,"
    " count(distinct case when order_type = 'sale' then order_id end) as orders, sum(quantity) as units,"
    " sum(revenue_nzd) as r, sum(cogs_nzd) as c, sum(gross_profit_nzd) as g from fct_lines group by 1, 2, 3)"
)
oracle(
    "rpt_monthly_sales",
    "select month, sales_channel, region_code, orders, cast(units as bigint) as units, cast(round(r, 2) as double) as revenue_nzd,"
    " cast(round(c, 2) as double) as cogs_nzd, cast(round(g, 2) as double) as gross_profit_nzd, cast(round(r - lag(r) over w, 2) as"
    " double) as revenue_change_vs_prior_month, cast(round(sum(r) over (partition by sales_channel, region_code order by month rows"
    " between unbounded preceding and current row), 2) as double) as revenue_year_to_date from monthly"
    " window w as (partition by sales_channel, region_code order by month)",
    MONTHLY,
)
oracle(
    "rpt_monthly_category_margin",
    "select month, product_category, cast(round(r, 2) as double) as revenue_nzd, cast(round(g, 2) as double) as gross_profit_nzd,"
    " round(cast(g as double) / nullif(cast(k as double), 0), 4) as gross_margin,"
    " cast(rank() over (partition by month order by g desc) as integer) as gross_profit_rank from (select "
    + month("order_date")
    + " as month, product_category, sum(revenue_nzd) as r, sum(gross_profit_nzd) as g,"
    " sum(case when has_cost then revenue_nzd else 0 end) as k from fct_lines group by 1, 2)",
)
SPENT = (
    "spent as (select " + month("spend_date") + " as month, marketing_channel, sum(cast(spend_nzd as decimal(28,10))) as s"
    " from fct_spend group by 1, 2), earned as (select " + month("order_date") + " as month, marketing_channel, sum(revenue_nzd) as e"
    " from fct_orders where is_paid_attribution and order_type = 'sale' group by 1, 2)"
)
oracle(
    "rpt_monthly_marketing",
    "select coalesce(spent.month, earned.month) as month, coalesce(spent.marketing_channel, earned.marketing_channel) as"
    " marketing_channel, cast(round(coalesce(s, 0), 2) as double) as ad_spend_nzd, cast(round(coalesce(e, 0), 2) as double) as"
    " attributed_revenue_nzd, round(cast(e as double) / nullif(cast(s as double), 0), 4) as roas from spent full outer join earned on"
    " spent.month = earned.month and spent.marketing_channel = earned.marketing_channel",
    SPENT,
)
oracle(
    "rpt_monthly_delivery",
    "select " + month("promised_date") + " as month, sales_channel, count(*) as shipments, cast(sum(case when is_on_time then 1 else 0"
    " end) as bigint) as on_time_shipments, round(cast(sum(case when is_on_time then 1 else 0 end) as double) / count(*), 4) as"
    " on_time_rate, round(avg(case when not is_on_time then days_late end), 2) as avg_days_late_when_late from fct_shipments"
    " group by 1, 2",
)
PRODUCT_MONTH = (
    "product_month as (select " + month("order_date") + " as month, l.product_id, p.description, l.product_category,"
    " sum(l.quantity) as units, sum(revenue_nzd) as r from fct_lines l left join dim_products p on l.product_id = p.product_id"
    " group by 1, 2, 3, 4), ranked as (select *, dense_rank() over (partition by month order by r desc) as k,"
    " cast(r as double) / cast(sum(r) over (partition by month) as double) as share from product_month)"
)
oracle(
    "rpt_top_products",
    "select month, cast(k as integer) as revenue_rank, product_id, description, product_category, cast(units as bigint) as units,"
    " cast(round(r, 2) as double) as revenue_nzd, round(share, 4) as share_of_month from ranked where k <= 10",
    PRODUCT_MONTH,
)
RECON = (
    "till as (select store_id, order_date as business_date, sum(revenue_nzd) as t from fct_lines where sales_channel = 'store'"
    " group by 1, 2), booked as (select store_id, posting_date as business_date, sum(amount_nzd) as b from ledger group by 1, 2),"
    " held as (select store_id, txn_date as business_date, count(*) as h from quarantined group by 1, 2),"
    " recon as (select x.store_id, x.business_date, cast(round(t, 2) as double) as pos_revenue_nzd, cast(round(b, 2) as double) as"
    " ledger_amount_nzd, cast(round(t - b, 2) as double) as difference_nzd, coalesce(h, 0) as quarantined_lines from (select"
    " coalesce(till.store_id, booked.store_id) as store_id, coalesce(till.business_date, booked.business_date) as business_date,"
    " coalesce(t, 0) as t, coalesce(b, 0) as b from till full outer join booked on till.store_id = booked.store_id and"
    " till.business_date = booked.business_date) x left join held on held.store_id = x.store_id and"
    " held.business_date = x.business_date)"
)
oracle("rpt_ledger_reconciliation", "select * from recon", RECON)

oracle("dim_stores", "select * from stg_stores")
oracle("dim_regions", "select r.*, (select count(*) from fct_lines f where f.region_code = r.region_code) as sales_lines from regions r")
oracle(
    "dim_sales_channels",
    "select c.*, (select count(*) from fct_lines f where f.sales_channel = c.sales_channel) as sales_lines from (values"
    " ('store', 'store', 'Sales at the seven stores (POS)'), ('online', 'online', 'Orders placed on the NZ and AU web shops'),"
    " ('wholesale', 'wholesale', 'Orders from independent homeware retailers (ERP sales orders)')) c(sales_channel, channel_name, description)",
)
oracle(
    "dim_marketing_channels",
    "select c.*, (select count(*) from fct_orders f where f.marketing_channel = c.marketing_channel) as orders from marketing_channels c",
)
oracle(
    "time_spine",
    "select d as date_day, cast(date_trunc('week', d) as date) as week from (select cast(unnest(generate_series(date_trunc('year', a),"
    " date_trunc('year', b) + interval 1 year - interval 1 day, interval 1 day)) as date) as d from (select min(order_date) as a,"
    " max(order_date) as b from fct_orders))",
)

# scans, sources, sinks

RAW_WEB = (
    "raw_web as (select order_id, strftime(order_ts, '%Y-%m-%d %H:%M:%S') as order_ts, customer_id, site, region_code as ship_region,"
    " marketing_channel, case when order_date >= date '2000-01-01' and cast(substr(order_id, 3) as bigint) % 4 = 1 then 'SUMMER15' end"
    " as promo_code, currency, order_status, cast(items_subtotal as varchar) as items_subtotal, '0.00' as discount_total, '9.90' as"
    " shipping_fee, cast(order_total as varchar) as order_total, strftime(order_date + 1, '%Y-%m-%d') || ' 02:00:00' as _extracted_at,"
    " 'ecommerce/orders_' || strftime(order_date, '%Y') || '.csv' as _source_file from stg_web_orders)"
)
oracle("scan_union_by_name", "select * from raw_web", RAW_WEB)


def delivered(feed: str, file: str, day: str, source: str) -> str:
    """Rows and newest extract of each file of a feed: one a year of ``day`` where the name has a year."""
    named = f"'{file}'".replace("YYYY", f"' || strftime({day}, '%Y') || '")
    return f"select '{feed}' as feed, {named} as source_file, count(*) as rows, max(cast({day} as timestamp)) as newest from {source} group by 2"


def by_day(kinds: str, *keys: str) -> str:
    return f"(select day from ev where event_type in ({kinds}) group by day, {', '.join(keys)}) t"


# the day before which a file's rows were extracted; master data has one fixed day
DELIVERED = [
    ("erp_materials", "erp/materials.csv", "date '2001-08-01'", "mats_raw"),
    ("erp_customers", "erp/customers.csv", "date '2001-07-31'", "stg_customers"),
    ("erp_stores", "erp/stores.csv", "date '2001-08-01'", "stg_stores"),
    ("erp_fx_rates", "erp/fx_rates.csv", "d", "fx_raw"),
    ("erp_gl_store_takings", "erp/gl_store_takings_YYYY.csv", "posting_date", "ledger"),
    ("erp_sales_order_headers", "erp/vbak_YYYY.csv", "od", "o where ch = 2"),
    ("erp_sales_order_items", "erp/vbap_YYYY.csv", "sd", "li where ch = 2"),
    ("ecom_orders", "ecommerce/orders_YYYY.csv", "order_date", "stg_web_orders"),
    ("ecom_order_lines", "ecommerce/order_lines_YYYY.csv", "sd", "li where ch = 1"),
    ("logistics_shipments", "logistics/shipments_YYYY.csv", "shipped_date", "stg_shipments"),
    ("mkt_search_ads", "marketing/search_ads_YYYY.csv", "day", by_day("'click'", "place", "campaign")),
    ("mkt_social_ads", "marketing/social_ads_YYYY.csv", "day", by_day("'view'", "place", "campaign")),
    ("mkt_other_channels", "marketing/other_channels_YYYY.csv", "day", by_day("'purchase', 'signup', 'error'", "event_type", "place")),
]
TILLS = (
    "select 'pos_transactions', regexp_replace(_source_file, '-[0-9][0-9][.]csv$', '.csv'), count(*), max(cast(extracted - 1 as timestamp))"
    " from pos_raw group by 2"
)
LOG = (
    "log as (select feed, source_file, rows, newest + interval 26 hour as extracted_at, timestamp '2001-08-03 06:00:00' as loaded_at"
    f" from ({' union all '.join([*(delivered(*x) for x in DELIVERED), TILLS])}) x)"
)
oracle("scan_source_file", "select feed, source_file as _source_file, rows from log", LOG)
oracle("ingest_log", "select * from log", LOG)
oracle("feed_load_summary", "select feed, count(distinct source_file) as files, cast(sum(rows) as bigint) as rows from log group by 1", LOG)
oracle(
    "seed_dims",
    "select 'regions' as seed, region_code as key, region_name as label, cast(null as boolean) as is_paid, (select count(*) from"
    " stg_web_orders w where w.region_code = r.region_code) as rows from regions r union all select 'sales_channels', c, c, null,"
    " (select count(*) from stg_shipments s where s.sales_channel = c) from (values ('store'), ('online'), ('wholesale')) t(c)"
    " union all select 'marketing_channels', marketing_channel, platform, is_paid, (select count(*) from stg_web_orders w where"
    " w.marketing_channel = m.marketing_channel) from marketing_channels m union all select 'material_groups', material_group,"
    " product_category, null, (select count(*) from stg_materials s where s.material_group = g.material_group) from material_groups g",
)
MARTS = {
    "dim_date": f"generate_series(date '{CALENDAR[0]}', date '{CALENDAR[1]}', interval 1 day)",
    "dim_regions": "regions",
    "dim_stores": "stg_stores",
    "dim_sales_channels": "(values (1), (2), (3)) t(x)",
    "dim_marketing_channels": "marketing_channels",
    "dim_products": "dim_products",
    "fct_sales_lines": "fct_lines",
    "fct_orders": "fct_orders",
    "fct_ad_spend": "fct_spend",
    "fct_shipments": "fct_shipments",
    "rpt_monthly_sales": "monthly",
    "rpt_monthly_category_margin": "(select distinct " + month("order_date") + ", product_category from fct_lines)",
    "rpt_monthly_marketing": "(select month, marketing_channel from spent union select month, marketing_channel from earned)",
    "rpt_monthly_delivery": "(select distinct " + month("promised_date") + ", sales_channel from fct_shipments)",
    "rpt_top_products": "ranked where k <= 10",
    "rpt_ledger_reconciliation": "recon",
}
oracle(
    "mart_sink",
    " union all ".join(f"select '{name}' as mart, count(*) as rows from {source}" for name, source in MARTS.items()),
    ", ".join([MONTHLY, SPENT, PRODUCT_MONTH, RECON]),
)
FAILING = (
    "dup as (select transaction_id || '-' || line_no as unique_field, count(*) as n_records from pos_raw group by 1 having count(*) > 1),"
    " neg as (select * from pos_raw where txn_type = 'SALE' and not (cast(quantity as integer) > 0)),"
    " orphan as (select material_id as from_field from stg_wholesale w where not exists (select 1 from stg_materials m where"
    " m.material_id = w.material_id)), grp as (select material_group as value_field, count(*) as n_records from stg_materials"
    " where material_group not in ('CW','BW','KT','TW','FS') group by 1), label as (select p._source_file, p.store_id, s.currency as"
    " store_currency, p.currency as reported_currency, count(*) as lines from pos_raw p join stg_stores s on p.store_id = s.store_id"
    " where p.currency <> s.currency group by 1, 2, 3, 4)"
)
# projections, filters, predicates

oracle(
    "project_rename_cast",
    "select order_id, order_ts, order_date, region_code, order_status, " + D("order_total") + " from stg_web_orders",
)
ITEM = "lpad(cast(l_orderkey as varchar), 10, '0') as VBELN, lpad(cast(l_linenumber * 10 as varchar), 6, '0') as POSNR, 'MAT-' || l_partkey as MATNR"
oracle(
    "decimal_qty_to_int",
    f"select {ITEM}, cast(cast(l_quantity + case when l_linenumber = 6 then 0.6 else 0 end as decimal(15,3)) as integer) as quantity"
    " from li where ch = 2",
)
oracle(
    "unit_price_per",
    f"select {ITEM}, cast(cast(listed / (case when l_linenumber = 3 then 100 else 1 end) as decimal(12,2)) as double) as unit_price"
    " from li where ch = 2",
)
SEARCH = (
    "search as (select strftime(day, '%Y-%m-%d') as date, " + country("place") + " || '-' || " + region("place") + " as geo_target,"
    " 'cmp' || campaign as campaign_id, 'search ' || campaign as campaign_name, sum(value) as v from ev where event_type = 'click'"
    " group by day, place, campaign)"
)
oracle("micros_to_currency", "select date, geo_target, campaign_name, cast(v as double) as spend from search", SEARCH)
oracle(
    "surrogate_keys",
    "select 'web' as kind, order_line_id as key from stg_web_lines union all select 'wholesale', sales_order_line_id from"
    " stg_wholesale union all select 'spend', spend_id from fct_spend",
)
oracle(
    "currency_convert",
    "select order_id, currency, " + D("order_total") + ", cast(case when currency = 'AUD' then order_total * aud_nzd_rate else"
    " order_total end as double) as order_total_nzd from every_order left join stg_fx on order_date = rate_date",
)
oracle(
    "null_typed_padding",
    "select sales_line_id, sales_channel, store_id, marketing_channel, order_type from channel_lines where sales_channel <> 'online'",
)
oracle(
    "validity_flag",
    "select transaction_id, line_no, txn_type, quantity, not (txn_type = 'SALE' and cast(quantity as integer) <= 0) as is_valid"
    " from pos_raw",
)
oracle(
    "quarantine_split",
    "select pos_line_id, case when is_valid then 'kept' when not is_valid then 'quarantined' else 'neither' end as route,"
    " case when not is_valid then 'SALE line with a non-positive quantity' end as reason from stg_pos",
)
oracle(
    "status_filter",
    "select 'order' as kind, order_id as key from stg_web_orders where order_status = 'completed' union all"
    " select 'rate', cast(rate_date as varchar) from stg_fx",
)
PAST_LAG = f"order_status = 'completed' and order_date <= cast({AS_OF} as date) - 12"
oracle("lag_cutoff_filter", f"select order_id, order_date from stg_web_orders where {PAST_LAG}")
oracle(
    "order_type_map",
    "select transaction_id, line_no, case when txn_type = 'RETURN' then 'return' else 'sale' end as order_type,"
    " txn_type = 'RETURN' as is_return from pos_raw",
)
oracle("cost_and_profit", "select sales_line_id, product_id, has_cost, " + D("cogs_nzd, gross_profit_nzd") + " from fct_lines")
oracle("delivery_flags", "select shipment_id, promised_date, delivered_date, is_on_time, days_late from stg_shipments")
oracle("paid_attribution_flag", "select order_id, sales_channel, marketing_channel, is_paid_attribution from fct_orders")
oracle("currency_from_master", "select pos_line_id, store_id, currency, reported_currency from stg_pos")

# joins

oracle(
    "join_inner_dim",
    "select transaction_id, line_no, sku, store_name, region_code from till_raw p join stg_stores s on p.store_id = s.store_id",
)
oracle(
    "join_left_lookup",
    "select transaction_id, line_no, l.sku, material_id, product_category from till_raw l left join stg_materials m on l.sku = m.sku",
)
oracle("join_header_item", "select sales_order_line_id, material_id, order_date, customer_id from stg_wholesale")
oracle(
    "join_fx_by_day",
    "select order_id, order_date, " + D("aud_nzd_rate") + " from every_order left join stg_fx on order_date = rate_date",
)
oracle(
    "join_name_lookup",
    "select strftime(spend_date, '%d/%m/%Y') as day, campaign_name, coalesce(region_name, 'Hobart') as region, s.region_code from"
    " stg_spend s left join regions r on s.region_code = r.region_code where source_platform = 'social_ads'",
)
oracle(
    "join_full_outer_coalesce",
    "select coalesce(a.day, b.day) as day, coalesce(a.region_code, b.region_code) as region_code, orders, shipments from (select"
    " order_date as day, region_code, count(*) as orders from stg_web_orders group by 1, 2) a full outer join (select shipped_date as"
    " day, region_code, count(*) as shipments from stg_shipments group by 1, 2) b on a.day = b.day and a.region_code = b.region_code",
)
oracle("join_left_on_coalesced", "select store_id, business_date, difference_nzd, quarantined_lines from recon", RECON)
BY_MONTH_REGION = (
    "a as (select " + month("order_date") + " as date, region_name as region, cast(sum(revenue_nzd) as double) as revenue"
    " from fct_lines f left join regions r on f.region_code = r.region_code group by 1, 2),"
    " b as (select " + month("order_date") + " as date, region_name as region, cast(sum(case when order_type = 'sale' then 1 else 0"
    " end) as double) as orders from fct_orders f left join regions r on f.region_code = r.region_code group by 1, 2),"
    " c as (select " + month("spend_date") + " as date, region_name as region, cast(sum(cast(spend_nzd as decimal(28,10))) as double)"
    " as ad_spend from fct_spend f left join regions r on f.region_code = r.region_code group by 1, 2),"
    " d as (select " + month("promised_date") + " as date, region_name as region, cast(count(*) as double) as shipments_due"
    " from fct_shipments f left join regions r on f.region_code = r.region_code group by 1, 2)"
)
oracle(
    "join_full_using_multi",
    "select date, region, revenue, orders, ad_spend, shipments_due from a full outer join b using (date, region) full outer join c using (date, region)"
    " full outer join d using (date, region)",
    BY_MONTH_REGION,
)
oracle(
    "join_cross_scalar",
    "select e as attributed_revenue, s as ad_spend, e / nullif(s, 0) as roas from (select"
    " cast(sum(case when is_paid_attribution and order_type = 'sale' then revenue_nzd else 0 end) as double) as e from fct_orders)"
    " cross join (select cast(sum(cast(spend_nzd as decimal(28,10))) as double) as s from fct_spend)",
)
oracle("anti_join_missing", "select product_id from missing_products")
oracle(
    "join_self_first",
    "select cohort_month, o.customer_id, order_month, cast(date_diff('month', cohort_month, order_month) as integer) as"
    " months_since_first from (select distinct customer_id, " + month("order_date") + " as order_month from stg_web_orders where"
    " order_status = 'completed') o join (select customer_id, min(" + month("order_date") + ") as cohort_month from stg_web_orders"
    " where order_status = 'completed' group by 1) f on o.customer_id = f.customer_id",
)
oracle(
    "join_equi_residual",
    "select transaction_id, line_no, sku, p.currency, s.currency as store_currency from till_raw p join stg_stores s on"
    " p.store_id = s.store_id where p.currency <> s.currency",
)
oracle(
    "join_outer_indicator",
    "select coalesce(o.order_id, s.order_id) as order_id, order_status, shipments, case when o.order_id is null then 'right_only'"
    " when s.order_id is null then 'left_only' else 'both' end as side from every_order o full outer join (select 'O-' || l_orderkey as"
    " order_id, count(*) as shipments from li where l_returnflag <> 'R' group by 1) s on o.order_id = s.order_id",
)

# aggregations

oracle("agg_order_rollup", "select order_id, sales_channel, order_type, " + ROLLUP + " from int_orders")
oracle(
    "agg_conditional_sum",
    "select sales_channel, product_category, cast(sum(case when has_cost then revenue_nzd else 0 end) as double) as"
    " costed_revenue_nzd from fct_lines group by 1, 2",
)
oracle(
    "agg_conditional_distinct",
    "select sales_channel, region_code, count(distinct case when order_type = 'sale' then order_id end) as orders from fct_lines group by 1, 2",
)
oracle(
    "agg_conditional_avg",
    "select carrier, region_code, avg(case when not is_on_time then days_late end) as avg_days_late from fct_shipments"
    " group by 1, 2",
)
oracle(
    "agg_safe_ratio",
    "select store_id, od as day, round(cast(sum(cast(discount_amount as decimal(12,2))) as double) /"
    " nullif(cast(sum(cast(unit_price as decimal(12,2))) as double), 0), 8) as discount_share from till_raw group by 1, 2",
)
oracle(
    "agg_filter_having",
    "select store_id, od as business_date, count(*) as lines, count(*) filter (where txn_type = 'RETURN') as returned, count(*) filter"
    " (where quantity is null) as without_quantity from till_raw group by 1, 2 having count(*) filter (where txn_type = 'RETURN') > 0",
)
oracle(
    "agg_filter_distinct",
    "select " + month("order_date") + " as month, count(distinct customer_id) filter (where order_status = 'completed') as buyers,"
    " count(distinct customer_id) filter (where order_status = 'cancelled') as cancellers from every_order group by 1",
)
oracle("agg_distinct", "select distinct store_id, sku from till_raw")
oracle(
    "agg_global",
    "select count(*) as lines, cast(sum(quantity) as bigint) as units, cast(round(sum(revenue_nzd), 2) as double) as revenue_nzd,"
    " max(order_date) as last_order from fct_lines",
)
oracle(
    "agg_measure_set",
    "select region_name as region, site, cast(sum(order_total) as double) as total_sum, cast(count(order_total) as double)"
    " as total_count, cast(count(distinct customer_id) as double) as total_count_distinct,"
    " cast(sum(order_total) as double) / count(order_total) as total_average, cast(min(order_total) as double) as total_min,"
    " cast(max(order_total) as double) as total_max from stg_web_orders w left join regions r on w.region_code = r.region_code"
    " group by 1, 2",
)
oracle(
    "agg_argmax_argmin",
    "select date, first(region order by revenue desc, region) as best, max(revenue) as best_revenue, first(region order by revenue,"
    " region) as weakest, min(revenue) as weakest_revenue from (select date, region, revenue from a where region"
    " is not null and revenue is not null) group by date",
    BY_MONTH_REGION,
)
oracle(
    "agg_latency_stats",
    "select event_type, round(avg(value), 6) as mean,"
    " cast(sum(cast(value as decimal(18,2))) as double) as total, quantile_cont(value, 0.5) as median,"
    " min(case when k >= ceil(0.9 * n) then value end) as p90 from (select *, row_number() over (partition by event_type order by value)"
    " as k, count(*) over (partition by event_type) as n from events) group by event_type",
)

# windows

oracle(
    "win_dedup_first",
    "select store_id, transaction_id, line_no, strftime(od, '%Y-%m-%d %H:%M:%S') as txn_ts, txn_type, sku, quantity, unit_price,"
    " discount_amount, line_total, currency, payment_method, strftime(extracted, '%Y-%m-%d') || ' 02:00:00' as _extracted_at,"
    " _source_file from pos_copies where copy_number = 1",
)
oracle(
    "win_rank_in_day",
    "select order_id, region_code, order_date, " + D("order_total") + ", cast(row_number() over (partition by region_code, order_date"
    " order by order_total desc, order_id) as integer) as place from every_order",
)
CHANNEL_MONTH = (
    "cm as (select " + month("order_date") + " as month, sales_channel, sum(revenue_nzd) as r from fct_lines group by 1, 2)"
)
PER_CHANNEL = "(partition by sales_channel order by month)"
oracle("win_lag_delta", f"select month, sales_channel, cast(round(r - lag(r) over {PER_CHANNEL}, 2) as double) as change from cm", CHANNEL_MONTH)
oracle(
    "win_lag_pct",
    "select month, sales_channel, round(100.0 * (cast(r as double) / nullif(cast(lag(r) over"
    f" {PER_CHANNEL} as double), 0) - 1), 4) as change_pct from cm",
    CHANNEL_MONTH,
)
oracle(
    "win_running_total",
    "select month, sales_channel, cast(round(sum(r) over (partition by sales_channel order by month rows between unbounded preceding"
    " and current row), 2) as double) as to_date from cm",
    CHANNEL_MONTH,
)
CATEGORY_MONTH = (
    "km as (select " + month("order_date") + " as month, product_category, sum(gross_profit_nzd) as g, sum(revenue_nzd) as r"
    " from fct_lines group by 1, 2)"
)
oracle(
    "win_rank",
    "select month, product_category, cast(rank() over (partition by month order by g desc) as integer) as place from km",
    CATEGORY_MONTH,
)
oracle(
    "win_dense_rank",
    "select month, product_category, cast(dense_rank() over (partition by month order by r desc) as integer) as place from km",
    CATEGORY_MONTH,
)
oracle(
    "win_share_of_total",
    "select month, product_category, round(cast(r as double) / nullif(cast(sum(r) over (partition by month) as double), 0), 6) as share"
    " from km",
    CATEGORY_MONTH,
)
STORE_MONTH = (
    "sm as (select store_name, " + month("order_date") + " as month, sum(revenue_nzd) as r from fct_lines l join stg_stores s on"
    " l.store_id = s.store_id where sales_channel = 'store' group by 1, 2)"
)
oracle(
    "win_vs_partition_avg",
    "select store_name, month, round(100.0 * (cast(r as double) / nullif(avg(cast(r as double)) over (partition by store_name), 0) - 1),"
    " 4) as vs_average_pct from sm",
    STORE_MONTH,
)
oracle(
    "win_centred_smooth",
    "select date_day, marketing_channel, region_code, greatest(avg(revenue) over (partition by marketing_channel, region_code"
    " order by date_day rows between 3 preceding and 3 following), 5.0) as smoothed from (select days.date_day,"
    " c.marketing_channel, r.region_code, coalesce(revenue, 0.0) as revenue from (select cast(unnest(generate_series(a, b, interval 1"
    " day)) as date) as date_day from (select min(order_date) as a, max(order_date) as b from fct_orders)) days cross join (select"
    " marketing_channel from marketing_channels where is_paid) c cross join regions r left join (select order_date, marketing_channel,"
    " region_code, cast(sum(revenue_nzd) as double) as revenue from fct_orders where is_paid_attribution and order_type = 'sale'"
    " group by 1, 2, 3) d on d.order_date = days.date_day and d.marketing_channel = c.marketing_channel and d.region_code ="
    " r.region_code)",
)

# sorts, limits, top-k

oracle(
    "sort_nulls_last",
    "select region_name as region, marketing_channel, cast(sum(cast(spend_nzd as decimal(28,10))) as double) as ad_spend from"
    " fct_spend f left join regions r on f.region_code = r.region_code group by 1, 2",
)
oracle(
    "limit_clamp",
    "select order_date as date, region_name as region, product_category, cast(sum(revenue_nzd) as double) as revenue from"
    " fct_lines f left join regions r on f.region_code = r.region_code group by 1, 2, 3 order by 1 nulls last, 2 nulls last,"
    " 3 nulls last limit 2500",
)
oracle(
    "topn_per_group_dense",
    "select month, product_id, cast(k as integer) as place, cast(round(r, 2) as double) as revenue from ranked where k <= 10",
    PRODUCT_MONTH,
)
oracle(
    "topn_per_group_rank",
    "select order_id, order_date, " + D("order_total") + ", cast(rank() over (partition by order_date order by order_total desc) as"
    " integer) as place from every_order qualify place <= 3",
)

# set operations

oracle("union_channels", f"select {LINE} from channel_lines")
oracle("union_platforms", f"select {SPEND} from stg_spend")
oracle("union_inferred_members", "select product_id, description, product_category, is_inferred from dim_products")

# scalar functions and generators

oracle(
    "fn_parse_date",
    " union all ".join(
        f"select '{notation}' as notation, strftime(order_date, '{pattern}') as written, order_date as day from every_order"
        for notation, pattern in (("yyyymmdd", "%Y%m%d"), ("dd/mm/yyyy", "%d/%m/%Y"), ("yyyy-mm-dd", "%Y-%m-%d"))
    ),
)
oracle(
    "fn_date_series",
    "select date_day, coalesce(n, 0) as shipments from (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as date_day"
    " from (select min(shipped_date) as a, max(shipped_date) as b from stg_shipments)) days left join (select shipped_date, count(*) as"
    " n from stg_shipments group by 1) s on shipped_date = date_day",
)
oracle(
    "fn_calendar_attrs",
    "select order_id, cast(date_trunc('week', order_date) as date) as week_start, cast(date_trunc('month', order_date) as date) as"
    " month_start, cast(date_trunc('quarter', order_date) as date) as quarter_start, cast(extract(year from order_date) + case when"
    " extract(month from order_date) >= 4 then 1 else 0 end as integer) as fiscal_year, cast(extract(isodow from order_date) as"
    " integer) as iso_day_of_week, extract(isodow from order_date) >= 6 as is_weekend from every_order",
)
oracle(
    "fn_date_trunc_grain",
    " union all ".join(
        f"select '{g}' as grain, cast(date_trunc('{g}', order_date) as date) as period, count(*) as orders from every_order group by 2"
        for g in ("day", "week", "month", "quarter", "year")
    ),
)
oracle(
    "fn_month_diff",
    "select shipment_id, cast(date_diff('month', promised_date, delivered_date) as integer) as months from stg_shipments",
)
oracle(
    "fn_month_add",
    "select order_id, cast(order_date + interval 1 month as date) as plus_1, cast(order_date + interval 2 month as date) as plus_2,"
    " cast(order_date + interval 3 month as date) as plus_3 from every_order",
)
oracle("fn_month_label", "select order_id, strftime(order_date, '%Y-%m') as month from every_order")
oracle(
    "fn_iso_week_bounds",
    "select strftime(order_date, '%G-W%V') as iso_week, cast(date_trunc('week', min(order_date)) as date) as monday,"
    " cast(date_trunc('week', min(order_date)) as date) + 6 as sunday, count(*) as orders from every_order group by 1",
)
oracle("fn_split_part", "select date, geo_target, campaign_id, split_part(geo_target, '-', 2) as region_code from search", SEARCH)
oracle(
    "fn_rounding",
    "select customer_id, round(cast(sum(order_total) as double) / count(*), 2) as mean_total, round(cast(sum(shipping_fee) as double) /"
    " nullif(cast(sum(order_total) as double), 0), 4) as fee_ratio, round(100.0 * (cast(sum(shipping_fee) as double) /"
    " nullif(cast(sum(order_total) as double), 0)), 1) as fee_pct from every_order group by 1",
)
oracle(
    "fn_normalise_label",
    "select label, count(*) as rows, case s when 'akl' then 'auckland' when 'wlg' then 'wellington' when 'chc' then 'christchurch' when"
    " 'syd' then 'sydney' when 'mel' then 'melbourne' when 'newzealand' then 'nz' when 'australia' then 'au' else s end as normalised"
    " from (select label, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') as s from (select unnest([region_code, site,"
    " marketing_channel]) as label from stg_web_orders union all select coalesce(region_name, 'Hobart') from stg_spend sp left join"
    " regions r on sp.region_code = r.region_code where source_platform = 'social_ads' union all select c_mktsegment from customer"
    " union all select payment_method from pos_raw)) group by label, s",
)
ANSWERS = (
    "ans as (select cast(o_orderkey as varchar) as id, case when o_orderkey % 10 = 9 then 'label' else 'number' end as kind, case"
    " o_orderkey % 3 when 0 then 'revenue' when 1 then 'gross_margin' else 'average_order_value' end as metric, case when o_orderkey % 10 = 9"
    " then " + region("(o_custkey % 5)") + " when o_orderkey % 3 = 1 then share else cast(total as varchar) end as expected,"
    " case when o_orderkey % 17 <> 0 then case when o_orderkey % 10 = 9 then case when o_orderkey % 4 = 1 then upper(place) else"
    " split_part(o_orderpriority, '-', 2) end when o_orderkey % 3 = 1 then case o_orderkey % 4 when 0 then pct || '%' when 1 then pct"
    " else share end else case o_orderkey % 8 when 0 then 'NZD ' || format('{:,.2f}', cast(total as double)) when 1 then cast(total as"
    " varchar) when 2 then cast(cast(floor(total / 1000) as bigint) as varchar) || 'k' when 3 then cast(cast((o_orderkey % 1000) * 0.1"
    " as decimal(6,1)) as varchar) || '%' when 4 then 'n/a' when 5 then cast(cast(floor(total / 1000) as bigint) as varchar) || ' thousand'"
    " when 6 then '$' || cast(total + 1 as varchar) else '-' || cast(total as varchar) end end end as answer from (select *,"
    " cast(o_totalprice as decimal(14,2)) as total, cast(cast((o_custkey % 1000) * 0.001 as decimal(5,3)) as varchar) as share,"
    " cast(cast((o_custkey % 1000) * 0.1 as decimal(5,1)) as varchar) as pct, case o_custkey % 5 when 0 then 'Auckland' when 1 then"
    " 'Wellington' when 2 then 'Sydney' when 3 then 'Melbourne' else 'Christchurch' end as place from o)),"
    " parsed as (select *, regexp_extract(bare, '-?[0-9]+(?:\\.[0-9]+)?') as digits, regexp_extract(bare,"
    " '-?[0-9]+(?:\\.[0-9]+)?\\s*(.*)', 1) as tail from (select *, trim(replace(replace(replace(lower(trim(answer)), ',', ''), 'nzd',"
    " ''), '$', '')) as bare from ans)), numbered as (select *, case when digits = '' then null when tail like '\\%%' escape '\\' then"
    " cast(digits as double) / 100 when tail like 'k%' or tail like 'thousand%' then cast(digits as double) * 1000 when tail like 'm%'"
    " then cast(digits as double) * 1000000 else cast(digits as double) end as number from parsed)"
)
oracle("fn_parse_number", "select id, answer, number from numbered", ANSWERS)
# DuckDB's regular expressions have no lookbehind and know only ASCII letters: accents are stripped, and the
# character before a number is matched with it, after making room where two numbers touch.
TOKENS = (
    "cleaned as (select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(text), 'ß', 's'),"
    " '\\b\\d{4}-\\d{2}-\\d{2}\\b|\\b\\d{4}-[Ww]\\d{2}\\b|\\b[Ww]\\d{2}\\b|\\b\\d{1,2} (?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    "[a-zA-Z]* \\d{4}\\b|\\b(?:19|20)\\d{2}\\b', ' ', 'g'), ',([-+])', ', \\1', 'g'), '%', '% ', 'g') as t from documents),"
    " raw_tokens as (select doc_id, trim(unnest(regexp_extract_all(t, '(?:^|[^\\w.])([-+]?\\d[\\d,]*(?:\\.\\d+)?(?:\\s?(?:%|[kKmM]\\b))?)',"
    " 1)), chr(32) || chr(9) || chr(10) || chr(13)) as token from cleaned),"
    " tok as (select doc_id, token, lower(regexp_extract(token, '[%kKmM]$')) as unit,"
    " replace(regexp_replace(token, '[%kKmM\\s]+$', ''), ',', '') as plain from raw_tokens),"
    " toks as (select doc_id, token, abs(cast(plain as double)) as value, cast(length(regexp_extract(plain, '\\.(\\d+)', 1)) as integer)"
    " as decimals, unit from tok)"
)
oracle("fn_number_tokens", "select * from toks", TOKENS)

# analyst queries

oracle(
    "q_running_total",
    "select strftime(month, '%Y-%m') as month, sales_channel, cast(round(r, 2) as double) as revenue_nzd, cast(round(sum(r) over"
    " (partition by sales_channel order by cm.month rows between unbounded preceding and current row), 2) as double) as"
    " fy_revenue_to_date_nzd from cm",
    CHANNEL_MONTH,
)
oracle(
    "q_rank_within_group",
    "select product_category, cast(rank() over (partition by product_category order by r desc) as integer) as rank_in_category,"
    " description, cast(units as bigint) as units, cast(round(r, 2) as double) as revenue_nzd, round(100.0 * (cast(r as double) /"
    " cast(sum(r) over (partition by product_category) as double)), 1) as pct_of_category from (select l.product_category,"
    " p.description, sum(revenue_nzd) as r, sum(quantity) as units from fct_lines l join dim_products p on l.product_id = p.product_id"
    " group by 1, 2) qualify rank_in_category <= 3",
)
oracle(
    "q_cohort_retention",
    "select strftime(cohort_month, '%Y-%m') as cohort, customers, "
    + ", ".join(
        f"case when cohort_month + interval {k} month <= last_month then round(100.0 * (cast(m{k} as double) / customers), 1) end as"
        f" retained_m{k}_pct"
        for k in (1, 2, 3)
    )
    + " from (select cohort_month, count(distinct customer_id) filter (where k = 0) as customers, "
    + ", ".join(f"count(distinct customer_id) filter (where k = {k}) as m{k}" for k in (1, 2, 3))
    + " from (select cohort_month, w.customer_id, date_diff('month', cohort_month, order_month) as k from web w join (select"
    " customer_id, min(order_month) as cohort_month from web group by 1) f on w.customer_id = f.customer_id) group by 1) cross join"
    " (select max(order_month) as last_month from web)",
    "web as (select w.customer_id, " + month("f.order_date") + " as order_month from fct_orders f join stg_web_orders w on"
    " f.order_id = w.order_id where sales_channel = 'online')",
)
oracle(
    "q_period_over_period",
    "select store_name, strftime(month, '%Y-%m') as month, cast(round(r, 2) as double) as revenue_nzd, cast(round(lag(r) over w, 2) as"
    " double) as prior_month_nzd, round(100.0 * (cast(r as double) / nullif(cast(lag(r) over w as double), 0) - 1), 1) as change_pct,"
    " round(100.0 * (cast(r as double) / nullif(avg(cast(r as double)) over (partition by store_name), 0) - 1), 1) as"
    " vs_store_average_pct from sm window w as (partition by store_name order by sm.month)",
    STORE_MONTH,
)
oracle(
    "q_dedup_audit",
    "select store_id, od as business_date, count(*) as lines_delivered, count(*) filter (where copy_number = 1) as lines_kept,"
    " count(*) filter (where copy_number > 1) as duplicate_lines_removed, cast(round(sum(cast(line_total as decimal(12,2))) filter"
    " (where copy_number > 1), 2) as double) as duplicated_takings from pos_copies group by 1, 2 having count(*) filter (where"
    " copy_number > 1) > 0",
)

# metric layer

oracle(
    "metric_simple",
    "select sales_channel, cast(sum(revenue_nzd) as double) as revenue, cast(sum(gross_profit_nzd) as double) as"
    " gross_profit, cast(sum(case when has_cost then revenue_nzd else 0 end) as double) as costed_revenue,"
    " cast(sum(quantity) as double) as units_sold from fct_lines group by 1",
)
MARGIN = (
    "cast(sum(gross_profit_nzd) as double) / nullif(cast(sum(case when has_cost then revenue_nzd else 0 end) as double), 0)"
)
oracle("metric_ratio", f"select product_category, {MARGIN} as gross_margin from fct_lines group by 1")
ATTRIBUTED = "cast(sum(case when is_paid_attribution and order_type = 'sale' then revenue_nzd else 0 end) as double)"
SPENT_SUM = "cast(sum(cast(spend_nzd as decimal(28,10))) as double)"
oracle(
    "metric_multi_fact",
    "select date, marketing_channel, e as attributed_revenue, s as ad_spend, e / nullif(s, 0) as roas"
    " from (select " + month("order_date") + f" as date, marketing_channel, {ATTRIBUTED} as e from fct_orders group by 1, 2) x"
    " full outer join (select " + month("spend_date") + f" as date, marketing_channel, {SPENT_SUM} as s from fct_spend group by 1, 2) y"
    " using (date, marketing_channel)",
)
oracle(
    "metric_by_grain",
    "select date, grain, n as orders, r as order_revenue, r / nullif(n, 0) as average_order_value from ("
    + " union all ".join(
        f"select '{g}' as grain, cast(date_trunc('{g}', order_date) as date) as date, cast(sum(case when order_type = 'sale' then 1"
        " else 0 end) as double) as n, cast(sum(case when order_type = 'sale' then revenue_nzd else 0 end) as double) as r"
        " from fct_orders group by 2"
        for g in ("day", "week", "month", "quarter", "year")
    )
    + ")",
)
oracle(
    "metric_by_dimension",
    "select carrier, country, cast(count(*) as double) as shipments_due, cast(sum(case when is_on_time then 1 else 0 end) as double) as"
    " on_time_shipments, cast(sum(case when is_on_time then 1 else 0 end) as double) / count(*) as on_time_delivery_rate from"
    " fct_shipments s left join regions r on s.region_code = r.region_code group by 1, 2",
)
oracle(
    "metric_filters",
    f"select region_name as region, sales_channel, cast(sum(revenue_nzd) as double) as revenue, {MARGIN} as gross_margin from"
    " fct_lines f left join regions r on f.region_code = r.region_code where region_name in ('Auckland', 'Sydney', 'Melbourne') and"
    " product_category <> 'Unknown' and sales_channel not in ('wholesale') and country >= 'AU' group by 1, 2",
)
RANGE = "between date '1998-10-01' and date '1999-03-31'"
oracle(
    "metric_date_range",
    "select date, region, v as revenue, e / nullif(s, 0) as roas from (select cast(date_trunc('quarter', order_date)"
    " as date) as date, region_name as region, cast(sum(revenue_nzd) as double) as v from fct_lines f left join regions r on"
    f" f.region_code = r.region_code where order_date {RANGE} group by 1, 2) a full outer join (select cast(date_trunc('quarter',"
    f" order_date) as date) as date, region_name as region, {ATTRIBUTED} as e from fct_orders f left join regions r on f.region_code ="
    f" r.region_code where order_date {RANGE} group by 1, 2) b using (date, region) full outer join (select cast(date_trunc('quarter',"
    f" spend_date) as date) as date, region_name as region, {SPENT_SUM} as s from fct_spend f left join regions r on f.region_code ="
    f" r.region_code where spend_date {RANGE} group by 1, 2) c using (date, region)",
)

# data quality

oracle("dq_unique", "select unique_field, n_records from dup", FAILING)
oracle("dq_not_null", "select sales_line_id, order_id, product_id, order_date from fct_lines where revenue_nzd is null")
oracle("dq_accepted_values", "select value_field, n_records from grp", FAILING)
oracle("dq_relationships", "select from_field from orphan", FAILING)
oracle("dq_expression", "select store_id, transaction_id, line_no, sku, quantity from neg", FAILING)
oracle(
    "dq_column_contract",
    "select distinct _source_file as source_file, 'promo_code' as column_name, 'unexpected column (not in the contract)' as issue from"
    " raw_web where _source_file >= 'ecommerce/orders_2000'",
    RAW_WEB,
)
NEWEST = {
    "erp_materials": ("select timestamp '2001-08-02 02:00:00' as t", 1, 2),
    "erp_customers": ("select timestamp '2001-08-01 02:00:00' as t", 1, 2),
    "erp_stores": ("select timestamp '2001-08-02 02:00:00' as t", 1, 2),
    "erp_fx_rates": ("select max(d) + 1 as t from fx_raw", 1, 2),
    "erp_gl_store_takings": ("select max(posting_date) + 1 as t from ledger", 33, 35),
    "erp_sales_order_headers": ("select max(od) + 1 as t from o where ch = 2", 33, 35),
    "erp_sales_order_items": ("select max(sd) + 1 as t from li where ch = 2", 33, 35),
    "pos_transactions": ("select max(extracted) as t from pos_raw", 33, 35),
    "ecom_orders": ("select max(order_date) + 1 as t from stg_web_orders", 33, 35),
    "ecom_order_lines": ("select max(sd) + 1 as t from li where ch = 1", 33, 35),
    "logistics_shipments": ("select max(shipped_date) + 1 as t from stg_shipments", 7, 8),
    "mkt_search_ads": ("select max(spend_date) + 1 as t from stg_spend where source_platform = 'search_ads'", 33, 35),
    "mkt_social_ads": ("select max(spend_date) + 1 as t from stg_spend where source_platform = 'social_ads'", 33, 35),
    "mkt_other_channels": ("select max(spend_date) + 1 as t from stg_spend where source_platform = 'other_channels'", 33, 35),
}
FRESH = "fresh as (select *, case when age > err then 'error' when age > warn then 'warn' else 'pass' end as status from (" + " union all ".join(
    f"select '{feed}' as feed, t, date_diff('second', t, {AS_OF}) / 86400.0 as age, {warn} as warn, {err} as err from (select"
    f" case when cast(t as timestamp) = date_trunc('day', cast(t as timestamp)) then cast(t as timestamp) + interval 2 hour else"
    f" cast(t as timestamp) end as t from ({newest}))"
    for feed, (newest, warn, err) in NEWEST.items()
) + "))"
oracle("dq_freshness", "select feed, t as max_extracted_at, round(cast(age as double), 1) as age_days, status from fresh", FRESH)
oracle("dq_currency_label", "select * from label", FAILING)
RAW_RECON = (
    "rawrec as (select coalesce(p.store_id, l.store_id) as store_id, coalesce(p.d, l.d) as business_date, cast(round(t, 2) as double) as"
    " pos_nzd, cast(b as double) as ledger_nzd, cast(round(coalesce(t, 0) - coalesce(b, 0), 2) as double) as difference_nzd from (select"
    " store_id, od as d, sum(case when currency = 'AUD' then cast(line_total as decimal(12,2)) * aud_nzd_rate else cast(line_total as"
    " decimal(12,2)) end) as t from pos_raw left join stg_fx on od = rate_date group by 1, 2) p full outer join (select store_id,"
    " posting_date as d, sum(amount_nzd) as b from ledger group by 1, 2) l on p.store_id = l.store_id and p.d = l.d"
    " where abs(coalesce(t, 0) - coalesce(b, 0)) > 0.05)"
)
oracle("recon_raw_vs_ledger", "select * from rawrec", RAW_RECON)
oracle("recon_mart_vs_ledger", "select * from recon where abs(difference_nzd) > 0.05 and quarantined_lines = 0", RECON)
UNSHIPPED = (
    "unshipped as (select order_date, count(*) as orders_without_shipment from stg_web_orders w where " + PAST_LAG + " and not exists"
    " (select 1 from stg_shipments s where s.order_ref = w.order_id) group by 1)"
)
oracle("recon_orders_vs_shipments", "select * from unshipped", UNSHIPPED)


def _count_unique(relation: str, expr: str) -> str:
    return f"select count(*) from (select {expr} as v from {relation} where {expr} is not null group by 1 having count(*) > 1)"


def _count_null(relation: str, expr: str) -> str:
    return f"select count(*) from {relation} where {expr} is null"


def _count_other(relation: str, expr: str, accepted: str) -> str:
    values = ", ".join(f"'{v}'" for v in accepted.split(","))
    return f"select count(distinct {expr}) from {relation} where {expr} not in ({values})"


def _count_orphans(relation: str, expr: str, parent: str, field: str) -> str:
    return f"select count(*) from {relation} where {expr} is not null and {expr} not in (select {field} from {parent} where {field} is not null)"


def _key_checks(named: str, column: str, relation: str, expr: str) -> list[tuple[str, str]]:
    return [
        (f"unique:{named}.{column}", _count_unique(relation, expr)),
        (f"not_null:{named}.{column}", _count_null(relation, expr)),
    ]


SALES_CHANNELS = "(values ('store'), ('online'), ('wholesale')) t(sales_channel)"
PAID = "paid_search,paid_social,display,email,affiliate"
CATEGORIES = "Cookware,Bakeware,Kitchen Tools,Tableware,Food Storage,Unknown"
WARNS = {
    "erp_sales_order_material_exists",
    "pos_transaction_line_is_unique",
    "pos_sale_quantity_is_positive",
    "recon_pos_raw_vs_finance",
    "recon_online_orders_vs_shipments",
    "assert_pos_currency_matches_store",
    "ecom_orders_columns_match_contract",
}
COUNTS: list[tuple[str, str]] = [
    *_key_checks("erp_materials", "MATERIAL", "stg_materials", "material_id"),
    *_key_checks("erp_materials", "SKU", "stg_materials", "sku"),
    ("accepted_values:erp_materials.MATL_GROUP", _count_other("stg_materials", "material_group", "CW,BW,KT,TW,FS")),
    *_key_checks("erp_customers", "CUSTOMER", "stg_customers", "customer_id"),
    *_key_checks("erp_stores", "STORE_ID", "stg_stores", "store_id"),
    ("accepted_values:erp_stores.CURRENCY", _count_other("stg_stores", "currency", "NZD,AUD")),
    *_key_checks("erp_fx_rates", "RATE_DATE", "fx_raw", "d"),
    ("not_null:erp_sales_order_items.MATNR", _count_null("stg_wholesale", "material_id")),
    ("erp_sales_order_material_exists", _count_orphans("stg_wholesale", "material_id", "stg_materials", "material_id")),
    ("accepted_values:erp_sales_order_items.WAERK", _count_other("stg_wholesale", "currency", "NZD,AUD")),
    ("pos_transaction_line_is_unique", "select count(*) from dup"),
    ("pos_sale_quantity_is_positive", "select count(*) from neg"),
    ("accepted_values:pos_transactions.txn_type", _count_other("pos_raw", "txn_type", "SALE,RETURN")),
    ("accepted_values:pos_transactions.currency", _count_other("pos_raw", "currency", "NZD,AUD")),
    ("relationships:pos_transactions.store_id", _count_orphans("pos_raw", "store_id", "stg_stores", "store_id")),
    *_key_checks("ecom_orders", "order_id", "stg_web_orders", "order_id"),
    ("accepted_values:ecom_orders.order_status", _count_other("stg_web_orders", "order_status", "completed,cancelled")),
    ("accepted_values:ecom_orders.marketing_channel", _count_other("stg_web_orders", "marketing_channel", PAID + ",organic")),
    ("relationships:ecom_order_lines.order_id", _count_orphans("stg_web_lines", "order_id", "stg_web_orders", "order_id")),
    *_key_checks("logistics_shipments", "shipment_id", "stg_shipments", "shipment_id"),
    ("accepted_values:logistics_shipments.channel", _count_other("stg_shipments", "sales_channel", "online,wholesale")),
    *_key_checks("stg_materials", "material_id", "stg_materials", "material_id"),
    *_key_checks("stg_customers", "customer_id", "stg_customers", "customer_id"),
    *_key_checks("stg_stores", "store_id", "stg_stores", "store_id"),
    *_key_checks("stg_fx_rates", "rate_date", "stg_fx", "rate_date"),
    *_key_checks("stg_wholesale_lines", "sales_order_line_id", "stg_wholesale", "sales_order_line_id"),
    *_key_checks("stg_pos_lines", "pos_line_id", "stg_pos", "pos_line_id"),
    ("accepted_values:stg_pos_lines.currency", _count_other("stg_pos", "currency", "NZD,AUD")),
    *_key_checks("stg_web_orders", "order_id", "stg_web_orders", "order_id"),
    *_key_checks("stg_web_order_lines", "order_line_id", "stg_web_lines", "order_line_id"),
    *_key_checks("stg_shipments", "shipment_id", "stg_shipments", "shipment_id"),
    ("accepted_values:stg_ad_spend.marketing_channel", _count_other("stg_spend", "marketing_channel", PAID)),
    ("not_null:stg_ad_spend.region_code", _count_null("stg_spend", "region_code")),
    ("relationships:stg_ad_spend.region_code", _count_orphans("stg_spend", "region_code", "regions", "region_code")),
    *_key_checks("int_sales_lines", "sales_line_id", "int_lines", "sales_line_id"),
    ("unique:dim_date.date_day", "select 0"),
    ("not_null:dim_date.date_day", "select 0"),
    *_key_checks("dim_regions", "region_code", "regions", "region_code"),
    ("unique:dim_sales_channels.sales_channel", "select 0"),
    ("not_null:dim_sales_channels.sales_channel", "select 0"),
    *_key_checks("dim_marketing_channels", "marketing_channel", "marketing_channels", "marketing_channel"),
    *_key_checks("dim_stores", "store_id", "stg_stores", "store_id"),
    *_key_checks("dim_products", "product_id", "dim_products", "product_id"),
    ("accepted_values:dim_products.product_category", _count_other("dim_products", "product_category", CATEGORIES)),
    (
        "fct_sales_lines_sale_quantity_is_positive",
        "select count(*) from fct_lines where order_type = 'sale' and not (quantity > 0)",
    ),
    *_key_checks("fct_sales_lines", "sales_line_id", "fct_lines", "sales_line_id"),
    ("not_null:fct_sales_lines.revenue_nzd", _count_null("fct_lines", "revenue_nzd")),
    ("relationships:fct_sales_lines.sales_channel", _count_orphans("fct_lines", "sales_channel", SALES_CHANNELS, "sales_channel")),
    ("not_null:fct_sales_lines.region_code", _count_null("fct_lines", "region_code")),
    ("relationships:fct_sales_lines.region_code", _count_orphans("fct_lines", "region_code", "regions", "region_code")),
    ("not_null:fct_sales_lines.product_id", _count_null("fct_lines", "product_id")),
    ("relationships:fct_sales_lines.product_id", _count_orphans("fct_lines", "product_id", "dim_products", "product_id")),
    ("accepted_values:fct_sales_lines.order_type", _count_other("fct_lines", "order_type", "sale,return")),
    *_key_checks("attributed_orders", "order_id", "fct_orders", "order_id"),
    (
        "relationships:attributed_orders.marketing_channel",
        _count_orphans("fct_orders", "marketing_channel", "marketing_channels", "marketing_channel"),
    ),
    *_key_checks("fct_ad_spend", "spend_id", "fct_spend", "spend_id"),
    ("not_null:fct_ad_spend.spend_nzd", _count_null("fct_spend", "spend_nzd")),
    *_key_checks("fct_shipments", "shipment_id", "fct_shipments", "shipment_id"),
    ("relationships:fct_shipments.region_code", _count_orphans("fct_shipments", "region_code", "regions", "region_code")),
    ("recon_pos_raw_vs_finance", "select count(*) from rawrec"),
    ("recon_pos_mart_vs_finance", "select count(*) from recon where abs(difference_nzd) > 0.05 and quarantined_lines = 0"),
    ("recon_online_orders_vs_shipments", "select count(*) from unshipped"),
    ("assert_pos_currency_matches_store", "select count(*) from label"),
    ("ecom_orders_columns_match_contract", "select count(distinct strftime(order_date, '%Y')) from stg_web_orders where order_date >= date '2000-01-01'"),
]
RESULTS = (
    "counted as ("
    + " union all ".join(
        f"select '{name}' as name, '{'warn' if name in WARNS else 'error'}' as severity, '{'dq_detect' if name in WARNS else ''}' as tags,"
        f" ({sql}) as n"
        for name, sql in COUNTS
    )
    + "), results as (select name, 'test' as kind, severity, case when n = 0 then 'pass' when severity = 'warn' then 'warn' else 'fail'"
    " end as status, cast(n as bigint) as failing_rows, tags from counted union all select 'freshness:raw.' || feed, 'freshness',"
    " 'error', status, cast(case when status <> 'pass' then 1 else 0 end as bigint), 'age ' || cast(round(cast(age as double), 1) as"
    " varchar) || ' days' from fresh)"
)
DQ = ", ".join([FAILING, RECON, RAW_RECON, UNSHIPPED, FRESH, RESULTS])
oracle("dq_results", "select * from results", DQ)
oracle("failures_sink", "select name as check, cast(n as bigint) as rows from counted", DQ)
INCIDENTS = (
    "sold as (select *, 'S0' || (o_custkey % 25 + 1) as store from lineitem join o on l_orderkey = o_orderkey where ch = 0),"
    " places as (select distinct 'negative_quantity' as kind, 'T-' || o_orderkey as place from sold where o_orderstatus <> 'P' and"
    " l_linenumber = 7 and l_quantity < 3 union select distinct 'currency_mixup', store || '|' || strftime(od, '%Y-%m') from sold where"
    " o_orderkey % 41 = 0 and o_custkey % 25 % 5 in (2, 3) union select distinct 'missing_foreign_key', 'MAT-' || l_partkey from lineitem"
    " where l_orderkey % 3 = 2 and l_partkey % 97 = 0 union select distinct 'schema_drift', 'promo_code' from o where ch = 1 and od >="
    " date '2000-01-01' union select distinct 'late_file', 'logistics/shipments' from o where ch = 1 and o_orderstatus <> 'P'),"
    " meant as (select * from (values ('late_file','freshness:raw.logistics_shipments',false),"
    "('late_file','recon_online_orders_vs_shipments',false),('duplicate_rows','pos_transaction_line_is_unique',true),"
    "('duplicate_rows','recon_pos_raw_vs_finance',true),('schema_drift','ecom_orders_columns_match_contract',true),"
    "('currency_mixup','assert_pos_currency_matches_store',true),('currency_mixup','recon_pos_raw_vs_finance',true),"
    "('missing_foreign_key','erp_sales_order_material_exists',true),('negative_quantity','pos_sale_quantity_is_positive',true),"
    "('negative_quantity','recon_pos_raw_vs_finance',true)) t(kind, name, needs)),"
    " proof as (select 'currency_mixup' as kind, store_id || '|' || regexp_extract(_source_file, '(\\d{4}-\\d{2})\\.csv$', 1) as place"
    " from label union all select 'missing_foreign_key', from_field from orphan union all select 'negative_quantity', transaction_id"
    " from neg union all select 'schema_drift', 'promo_code' from (select distinct strftime(order_date, '%Y') from stg_web_orders"
    " where order_date >= date '2000-01-01'))"
)
oracle(
    "dq_expected_vs_fired",
    "select *, checks_fired > 0 and (evidence_rows is null or evidence_rows > 0) as caught from (select kind || ':' || place as id,"
    " kind, place, (select count(*) from meant m join results r on m.name = r.name where m.kind = p.kind and r.status <> 'pass') as"
    " checks_fired, case when kind <> 'late_file' then (select count(*) from proof f where f.kind = p.kind and f.place = p.place) end as"
    " evidence_rows from places p)",
    DQ + ", " + INCIDENTS,
)
oracle(
    "dq_unexplained",
    "select name, status, failing_rows from results where status <> 'pass' and name not in (select name from meant where kind in"
    " (select kind from places))",
    DQ + ", " + INCIDENTS,
)
oracle(
    "dq_alert_summary",
    "select case when count(*) filter (where status in ('error', 'fail')) > 0 then 'error' when count(*) filter (where status <>"
    " 'pass') > 0 then 'warn' else 'ok' end as severity, count(*) filter (where status <> 'pass') as checks_firing, (select count(*)"
    " from quarantined) as quarantined_lines from results where tags like '%dq_detect%' or kind = 'freshness'",
    DQ,
)

# as-delivered reports and comparison

NAIVE = (
    "naive_lines as (select " + month("od") + " as month, 'store' as channel, s.region_code, transaction_id as order_id,"
    " cast(quantity as decimal(15,3)) as quantity, od as day, cast(line_total as decimal(14,2)) as amount, p.currency, txn_type = 'SALE'"
    " as is_sale, null as marketing_channel, standard_cost_nzd, product_category from pos_raw p left join stg_stores s on p.store_id ="
    " s.store_id join stg_materials m on m.sku = p.sku union all select " + month("order_date") + ", 'online', region_code, l.order_id,"
    " quantity, order_date, line_total, currency, true, marketing_channel, standard_cost_nzd, product_category from stg_web_lines l join"
    " stg_web_orders w on l.order_id = w.order_id join stg_materials m on m.sku = l.sku where order_status = 'completed' union all"
    " select " + month("od") + ", 'wholesale', c.region_code, lpad(cast(l_orderkey as varchar), 10, '0'), cast(l_quantity + case when"
    " l_linenumber = 6 then 0.6 else 0 end as decimal(15,3)), od, amount, " + currency("(l_orderkey % 5)") + ", true, null,"
    " standard_cost_nzd, product_category from li join o on l_orderkey = o_orderkey left join stg_customers c on c.customer_id = 'C-' ||"
    " o_custkey join stg_materials m on m.material_id = 'MAT-' || l_partkey where li.ch = 2), naive as (select *, case when currency ="
    " 'AUD' then amount * aud_nzd_rate else amount end as r, standard_cost_nzd * quantity as c from naive_lines left join stg_fx on day"
    " = rate_date), naive_sales as (select month, channel as sales_channel, region_code, count(distinct case when is_sale then order_id"
    " end) as orders, cast(trunc(coalesce(sum(quantity), 0)) as bigint) as units, cast(round(coalesce(sum(r), 0), 2) as double) as"
    " revenue_nzd, cast(round(coalesce(sum(c), 0), 2) as double) as cogs_nzd, cast(round(coalesce(sum(r - c), 0), 2) as double) as"
    " gross_profit_nzd from naive where region_code is not null group by 1, 2, 3), naive_margin as (select month, product_category,"
    " cast(round(coalesce(sum(r), 0), 2) as double) as revenue_nzd, cast(round(coalesce(sum(r - c), 0), 2) as double) as"
    " gross_profit_nzd, round(cast(sum(r - c) as double) / nullif(cast(sum(r) as double), 0), 4) as gross_margin from naive where"
    " product_category is not null group by 1, 2), naive_mkt as (select x.month, x.marketing_channel, cast(round(coalesce(s, 0), 2) as"
    " double) as ad_spend_nzd, cast(round(coalesce(e, 0), 2) as double) as attributed_revenue_nzd, round(cast(coalesce(e, 0) as double)"
    " / nullif(cast(s as double), 0), 4) as roas from (select " + month("spend_date") + " as month, marketing_channel,"
    " sum(cast(spend_nzd as decimal(28,10))) as s from int_spend group by 1, 2) x left join (select month, marketing_channel, sum(r) as e"
    " from naive where marketing_channel in ('paid_search','paid_social','display','email','affiliate') group by 1, 2) y on x.month ="
    " y.month and x.marketing_channel = y.marketing_channel), naive_del as (select " + month("promised_date") + " as month,"
    " sales_channel, count(*) as shipments, count(*) filter (where is_on_time) as on_time_shipments, round(cast(count(*) filter (where"
    " is_on_time) as double) / count(*), 4) as on_time_rate from stg_shipments group by 1, 2)"
)
oracle("naive_monthly_sales", "select * from naive_sales", NAIVE)
oracle("naive_category_margin", "select * from naive_margin", NAIVE)
oracle("naive_marketing", "select * from naive_mkt", NAIVE)
oracle("naive_delivery", "select * from naive_del", NAIVE)
KEYS = {
    "monthly_sales": ("naive_sales", "rpt_monthly_sales", ["month", "sales_channel", "region_code"], ["orders", "units", "revenue_nzd", "cogs_nzd", "gross_profit_nzd"]),
    "monthly_category_margin": ("naive_margin", "rpt_monthly_category_margin", ["month", "product_category"], ["revenue_nzd", "gross_profit_nzd", "gross_margin"]),
    "monthly_marketing": ("naive_mkt", "rpt_monthly_marketing", ["month", "marketing_channel"], ["ad_spend_nzd", "attributed_revenue_nzd", "roas"]),
    "monthly_delivery": ("naive_del", "rpt_monthly_delivery", ["month", "sales_channel"], ["shipments", "on_time_shipments", "on_time_rate"]),
}


oracle(
    "report_csv_sink",
    " union all ".join(
        f"select '{report}' as report, month, concat_ws('/', {', '.join(keys[1:])}) as key, '{v}' as field, cast({v} as double) as value from {left}"
        for report, (left, _, keys, values) in KEYS.items()
        for v in values
    ),
    NAIVE,
)


def _final_select(name: str) -> str:
    return ORACLES[name].rsplit(")\n", 1)[1]


def _diff(report: str) -> str:
    left, right, keys, values = KEYS[report]
    same = " and ".join(f"l.{k} is not distinct from r.{k}" for k in keys)
    key_columns = ", ".join(f"coalesce(l.{k}, r.{k}) as {k}" for k in keys)
    pairs = ", ".join(f"cast(l.{v} as double) as {v}_left, cast(r.{v} as double) as {v}_right" for v in values)
    gaps = " or ".join(f"abs(coalesce(cast(l.{v} as double), 0) - coalesce(cast(r.{v} as double), 0)) > 0.011" for v in values)
    side = "case when l.here is null then 'right_only' when r.here is null then 'left_only' else 'both' end"
    return (
        f"select {key_columns}, {pairs}, {side} as side, l.here is not null and r.here is not null and ({gaps}) as differs from"
        f" (select *, 1 as here from {left}) l full outer join (select *, 1 as here from mart_{report}) r on {same}"
    )


MART_REPORTS = ", ".join(f"mart_{name} as ({_final_select(spec[1])})" for name, spec in KEYS.items())
DIFF = ", ".join([MONTHLY, SPENT, NAIVE, MART_REPORTS])


def _fields(report: str, rows: str, more: str = "") -> str:
    _, _, keys, values = KEYS[report]
    key = ", ".join(f"cast({k} as varchar)" for k in keys)
    return " union all ".join(
        f"select '{report}' as report, concat_ws('|', {key}) as key, '{v}' as field, {v}_left as left_value, {v}_right as right_value{more} from ({rows})"
        for v in values
    )


oracle("table_diff_rows", " union all ".join(_fields(report, _diff(report), ", side, differs") for report in KEYS), DIFF)
oracle(
    "table_diff_summary",
    " union all ".join(
        f"select '{report}' as report, count(*) filter (where side <> 'right_only') as rows_left, count(*) filter (where side <>"
        " 'left_only') as rows_right, count(*) filter (where side = 'both' and not differs) as matched_rows, count(*) filter (where"
        " differs) as differing_rows, count(*) filter (where side = 'left_only') as only_left, count(*) filter (where side ="
        f" 'right_only') as only_right from ({_diff(report)})"
        for report in KEYS
    ),
    DIFF,
)
oracle(
    "table_diff_examples",
    " union all ".join(
        _fields(report, f"select * from ({_diff(report)}) where differs order by {', '.join(f'{k} nulls last' for k in keys)} limit 5")
        for report, (_, _, keys, _) in KEYS.items()
    ),
    DIFF,
)

# weekly facts, grounding, scoring

WEEK = "cast(date_trunc('week', {c}) as date)"
WEEKLY = (
    "wk_orders as (select " + WEEK.format(c="order_date") + f" as week, {ATTRIBUTED} as e from fct_orders group by 1),"
    " wk_spend as (select " + WEEK.format(c="spend_date") + f" as week, {SPENT_SUM} as s from fct_spend group by 1),"
    " wk_total as (select week, e, s, e / nullif(s, 0) as q from wk_orders full outer join wk_spend using (week)),"
    " wk_ch as (select week, marketing_channel, e, s, e / nullif(s, 0) as q from (select " + WEEK.format(c="order_date")
    + f" as week, marketing_channel, {ATTRIBUTED} as e from fct_orders where marketing_channel in (select marketing_channel from"
    " marketing_channels where is_paid) group by 1, 2) full outer join (select " + WEEK.format(c="spend_date")
    + f" as week, marketing_channel, {SPENT_SUM} as s from fct_spend where marketing_channel in (select marketing_channel from"
    " marketing_channels where is_paid) group by 1, 2) using (week, marketing_channel)),"
    " wk_web as (select week, v, n, a / nullif(n, 0) as q from (select " + WEEK.format(c="order_date") + " as week,"
    " cast(sum(revenue_nzd) as double) as v from fct_lines where sales_channel = 'online' group by 1) full outer join (select "
    + WEEK.format(c="order_date") + " as week, cast(sum(case when order_type = 'sale' then 1 else 0 end) as double) as n,"
    " cast(sum(case when order_type = 'sale' then revenue_nzd else 0 end) as double) as a from fct_orders where sales_channel = 'online'"
    " group by 1) using (week)),"
    " weeks as (select week from wk_total where coalesce(s, e, q) is not null union select week from wk_web where coalesce(v, n, q) is"
    " not null), long as (select 'totals' as section, cast(null as varchar) as marketing_channel, week, unnest([{'m': 'ad_spend', 'v':"
    " s, 'd': 2}, {'m': 'attributed_revenue', 'v': e, 'd': 2}, {'m': 'roas', 'v': q, 'd': 4}]) as x from wk_total union all select"
    " 'online', null, week, unnest([{'m': 'revenue', 'v': v, 'd': 2}, {'m': 'orders', 'v': n, 'd': 2}, {'m': 'average_order_value', 'v':"
    " q, 'd': 2}]) from wk_web union all select 'channel', marketing_channel, week, unnest([{'m': 'ad_spend', 'v': s, 'd': 2}, {'m':"
    " 'attributed_revenue', 'v': e, 'd': 2}, {'m': 'roas', 'v': q, 'd': 4}]) from wk_ch),"
    " wanted as (select week, 'totals' as section, cast(null as varchar) as marketing_channel, unnest(['ad_spend', 'attributed_revenue',"
    " 'roas']) as metric from weeks union all select week, 'online', null, unnest(['revenue', 'orders', 'average_order_value']) from"
    " weeks union all select week, 'channel', marketing_channel, unnest(['ad_spend', 'attributed_revenue', 'roas']) from weeks cross"
    " join (select marketing_channel from marketing_channels where is_paid))"
)
oracle(
    "weekly_pair_facts",
    "select strftime(w.week, '%G-W%V') as iso_week, w.week, w.section, w.marketing_channel, w.metric, round(t.x.v, case when metric ="
    " 'roas' then 4 else 2 end) as this_week, round(p.x.v, case when metric = 'roas' then 4 else 2 end) as previous_week, round((t.x.v -"
    " p.x.v) / nullif(p.x.v, 0) * 100, 1) as change_pct from wanted w left join long t on t.week = w.week and t.section = w.section and"
    " t.marketing_channel is not distinct from w.marketing_channel and t.x.m = w.metric left join long p on p.week = w.week - 7 and"
    " p.section = w.section and p.marketing_channel is not distinct from w.marketing_channel and p.x.m = w.metric",
    WEEKLY,
)
ORDER = "case marketing_channel when 'paid_search' then 1 when 'paid_social' then 2 when 'display' then 3 when 'email' then 4 else 5 end"
oracle(
    "weekly_best_worst_channel",
    f"select week, first(marketing_channel order by round(q, 4) desc, {ORDER} desc) as best_channel_by_roas,"
    f" first(marketing_channel order by round(q, 4), {ORDER}) as weakest_channel_by_roas from wk_ch where q is not null group by week",
    WEEKLY,
)
oracle(
    "weekly_top_region",
    "select week, region, round(e, 2) as attributed_revenue, round(e / nullif(s, 0), 4) as roas from (select "
    + WEEK.format(c="order_date") + f" as week, region_name as region, {ATTRIBUTED} as e from fct_orders f left join regions r on"
    " f.region_code = r.region_code group by 1, 2) left join (select " + WEEK.format(c="spend_date") + " as week, region_name as region,"
    f" {SPENT_SUM} as s from fct_spend f left join regions r on f.region_code = r.region_code group by 1, 2) using (week, region)"
    " where e <> 0 qualify row_number() over (partition by week order by e desc, region) = 1",
)
oracle(
    "grounding_check",
    "select doc_id, token from toks t where not exists (select 1 from facts f where f.doc_id = t.doc_id and (abs(t.value * scale - f.v)"
    " <= tol or (unit = '%' and abs(t.value * scale - f.v * 100) <= tol)))",
    TOKENS.replace(" unit from tok)", " unit, case unit when 'k' then 1e3 when 'm' then 1e6 else 1.0 end as scale, 0.5 *"
    " pow(10, -length(regexp_extract(plain, '\\.(\\d+)', 1))) * (case unit when 'k' then 1e3 when 'm' then 1e6 else 1.0 end) + 1e-9 as tol"
    " from tok)")
    + ", facts as (select doc_id, cast(n_chars as double) as v from documents union all select l_orderkey, l_quantity from lineitem"
    " union all select l_orderkey, l_discount from lineitem)",
)
NORMAL = "case {s} when 'akl' then 'auckland' when 'wlg' then 'wellington' when 'chc' then 'christchurch' when 'syd' then 'sydney' when 'mel' then 'melbourne' when 'newzealand' then 'nz' when 'australia' then 'au' else {s} end"


def _normal(column: str) -> str:
    return NORMAL.format(s=f"regexp_replace(lower({column}), '[^a-z0-9]', '', 'g')")


oracle(
    "score_answers",
    "select id, kind, metric, expected, answer, coalesce(case when kind = 'label' then "
    + _normal("answer") + " = " + _normal("expected")
    + " else abs(x - target) <= 0.001 * greatest(abs(target), 1e-9) or (metric in ('gross_margin', 'on_time_delivery_rate') and"
    " abs(x - target) <= 0.001) end, false) as correct from (select *, case when metric in ('gross_margin', 'on_time_delivery_rate')"
    " and abs(number) > 1.5 and abs(target) <= 1.5 then number / 100 else number end as x from (select *, try_cast(expected as double)"
    " as target from numbered))",
    ANSWERS,
)

FACT_OF = {
    "revenue": ("fct_lines", "order_date", "cast(sum(revenue_nzd) as double)"),
    "gross_margin": (
        "fct_lines",
        "order_date",
        "cast(sum(gross_profit_nzd) as double) / nullif(cast(sum(case when has_cost then revenue_nzd else 0 end) as double), 0)",
    ),
    "average_order_value": (
        "fct_orders",
        "order_date",
        "cast(sum(case when order_type = 'sale' then revenue_nzd else 0 end) as double) / nullif(sum(case when order_type = 'sale' then"
        " 1 else 0 end), 0)",
    ),
    "orders": ("fct_orders", "order_date", "cast(sum(case when order_type = 'sale' then 1 else 0 end) as double)"),
    "on_time_delivery_rate": (
        "fct_shipments",
        "promised_date",
        "cast(sum(case when is_on_time then 1 else 0 end) as double) / count(*)",
    ),
    "ad_spend": ("fct_spend", "spend_date", SPENT_SUM),
}
DIMENSION = {"region": "region_name"}


def _question(q: object) -> str:
    def part(metric_sql: str, fact: str, time: str) -> str:
        where = [f"{time} between date '{q.start}' and date '{q.end}'"]
        where += [f"{DIMENSION.get(d, d)} = '{v}'" for d, v in q.filters.items()]
        label = DIMENSION.get(q.label, q.label) if q.label else "cast(null as varchar)"
        group = " group by 1" if q.label else ""
        return (
            f"select {label} as label, {metric_sql} as v from {fact} f left join regions r on f.region_code = r.region_code"
            f" where {' and '.join(where)}{group}"
        )

    if q.metric == "roas":
        top, bottom = part(ATTRIBUTED, "fct_orders", "order_date"), part(SPENT_SUM, "fct_spend", "spend_date")
        rows = f"select a.label, a.v / nullif(b.v, 0) as v from ({top}) a join ({bottom}) b on a.label is not distinct from b.label"
    else:
        fact, time, metric_sql = FACT_OF[q.metric]
        rows = part(metric_sql, fact, time)
    if q.label:
        direction = "desc" if q.argmax else "asc"
        rows = f"select * from ({rows}) where label is not null and v is not null order by v {direction}, label limit 1"
    kind = "label" if q.label else "number"
    return f"select '{q.id}' as id, '{kind}' as kind, '{q.metric}' as metric, v as number, label, v as expected_number, label as expected_label, v is not null as correct from ({rows})"


oracle("score_oracle", " union all ".join(f"({_question(q)})" for q in QUESTIONS))
EVALUATED = (
    "rows_ as (select event_id as id, case when user_id % 4 = 0 then 'holdout' else 'dev' end as split, case when event_id % 2 = 0 then"
    " 'baseline' else 'semantic_agent' end as system, event_type <> 'error' as correct, value as latency_s, event_id % 4000 as p,"
    " user_id % 300 as c, event_id % 3 + 1 as llm_calls, event_id % 2 as cached_calls, case when event_type = 'error' and event_id % 5 ="
    " 0 then 'timeout' end as error from events where event_id % 97 <> 0)"
)
oracle(
    "score_summary",
    "select system, split, count(*) as questions, count(*) filter (where correct) as correct, round(cast(count(*) filter (where correct)"
    " as double) / count(*), 3) as accuracy, round(avg(latency_s), 2) as latency_mean_s, round(quantile_cont(latency_s, 0.5), 2) as"
    " latency_median_s, round(min(case when k >= ceil(0.9 * n) then latency_s end), 2) as latency_p90_s, cast(round_even(avg(p + c), 0)"
    " as bigint) as tokens_per_question, cast(sum(llm_calls) as bigint) as llm_calls, cast(sum(cached_calls) as bigint) as cached_calls,"
    " round(cast(sum(cast(round(p / 1e6 * 0.10 + c / 1e6 * 0.40, 6) as decimal(18,6))) as double), 4) as cost_usd, count(error) as errors"
    " from (select *, row_number() over (partition by system, split order by latency_s) as k, count(*) over (partition by system, split)"
    " as n from (select * from rows_ union all select * replace ('all' as split) from rows_)) group by 1, 2",
    EVALUATED,
)
oracle("score_misses", "select id, split, system, error from rows_ where not correct", EVALUATED)
