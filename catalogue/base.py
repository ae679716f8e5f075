"""The test-table mapping, staging and marts as DuckDB CTEs, written independently of the engine.

``build(select)`` puts the CTEs that a select needs before it.
"""

from __future__ import annotations

import re

REGION = "case {k} when 0 then 'AKL' when 1 then 'WLG' when 2 then 'SYD' when 3 then 'MEL' else 'CHC' end"
REGION_NAME = (
    "case {k} when 0 then 'Auckland' when 1 then 'Wellington' when 2 then 'Sydney' when 3 then 'Melbourne'"
    " else 'Christchurch' end"
)
CURRENCY = "case when {k} in (2, 3) then 'AUD' else 'NZD' end"
COUNTRY = "case when {k} in (2, 3) then 'AU' else 'NZ' end"


def region(k: str) -> str:
    return REGION.format(k=k)


def currency(k: str) -> str:
    return CURRENCY.format(k=k)


def country(k: str) -> str:
    return COUNTRY.format(k=k)


AS_OF = "timestamp '2001-08-03 06:00:00'"

CTES: list[tuple[str, str]] = [
    (
        "regions",
        "select * from (values ('AKL','Auckland','NZ'),('WLG','Wellington','NZ'),('CHC','Christchurch','NZ'),"
        "('SYD','Sydney','AU'),('MEL','Melbourne','AU')) t(region_code, region_name, country)",
    ),
    (
        "marketing_channels",
        "select * from (values ('paid_search','paid_search',true,'search ads platform'),"
        "('paid_social','paid_social',true,'social ads platform'),('display','display',true,'display network'),"
        "('email','email',true,'email service and agency fees'),('affiliate','affiliate',true,'affiliate commissions'),"
        "('organic','organic',false,'unpaid (direct and organic search)'))"
        " t(marketing_channel, channel_name, is_paid, platform)",
    ),
    (
        "material_groups",
        "select * from (values ('CW','Cookware'),('BW','Bakeware'),('KT','Kitchen Tools'),('TW','Tableware'),"
        "('FS','Food Storage')) t(material_group, product_category)",
    ),
    ("o", "select *, cast(o_orderdate as date) as od, o_orderkey % 3 as ch from orders"),
    (
        "every_order",
        "select 'O-' || o_orderkey as order_id, 'U-' || o_custkey as customer_id, od as order_date, "
        + region("(o_custkey % 5)")
        + " as region_code, "
        + currency("(o_custkey % 5)")
        + " as currency, case when o_orderstatus = 'P' then 'cancelled' else 'completed' end as order_status,"
        " cast(o_totalprice as decimal(12,2)) as order_total, cast(9.90 as decimal(12,2)) as shipping_fee from o",
    ),
    (
        "li",
        "select *, cast(l_shipdate as date) as sd, l_orderkey % 3 as ch, cast(l_extendedprice as decimal(12,2)) as listed,"
        " cast(round(cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2))), 2)"
        " as decimal(12,2)) as amount from lineitem",
    ),
    (
        "fx_raw",
        "select d, f, t, r from (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as d from"
        " (select min(od) as a, max(od) as b from o)) days, lateral (select 'AUD' as f, 'NZD' as t,"
        " cast(1.05 + 0.01 * (extract(day from d) % 7) as decimal(10,4)) as r union all select 'NZD', 'AUD', 0.9000"
        " where extract(day from d) = 1) q where not (extract(month from d) = 12 and extract(day from d) = 25)",
    ),
    ("stg_fx", "select d as rate_date, cast(r as decimal(10,4)) as aud_nzd_rate from fx_raw where f = 'AUD' and t = 'NZD'"),
    (
        "stg_stores",
        "select 'S0' || (n_nationkey + 1) as store_id, 'Store ' || n_name as store_name, "
        + region("n_regionkey")
        + " as region_code, "
        + country("n_regionkey")
        + " as country, "
        + currency("n_regionkey")
        + " as currency from nation",
    ),
    (
        "stg_customers",
        "select 'C-' || c_custkey as customer_id, c_name as customer_name, "
        + country("n_regionkey")
        + " as country, "
        + region("n_regionkey")
        + " as region_code from customer join nation on c_nationkey = n_nationkey",
    ),
    (
        "mats_raw",
        "select *, case p_type when 'ECONOMY' then 'CW' when 'STANDARD' then 'BW' when 'MEDIUM' then 'KT'"
        " when 'PROMO' then 'TW' when 'LARGE' then 'FS' else 'ZZ' end as grp, cast(p_retailprice as decimal(12,2)) as price"
        " from part where p_partkey % 97 <> 0",
    ),
    (
        "stg_materials",
        "select 'MAT-' || p_partkey as material_id, 'SKU-' || p_partkey as sku, p_name as description, grp as material_group,"
        " product_category, cast(round(price * 0.40, 2) as decimal(12,2)) as standard_cost_nzd, price as list_price_nzd,"
        " cast(round(price * 0.92, 2) as decimal(12,2)) as list_price_aud,"
        " date '1994-01-01' + cast(p_partkey % 365 as integer) as created_on"
        " from mats_raw left join material_groups on grp = material_group",
    ),
    (
        "till_raw",
        "select 'S0' || (o_custkey % 25 + 1) as store_id, 'T-' || o_orderkey as transaction_id,"
        " cast(l_linenumber as varchar) as line_no, od, case when o_orderstatus = 'P' then 'RETURN' else 'SALE' end as txn_type,"
        " 'SKU-' || l_partkey as sku, case when l_linenumber = 5 and l_quantity = 1 and l_partkey % 2 = 0 then null"
        " else cast(cast(l_quantity as integer) * (case when o_orderstatus = 'P' or (l_linenumber = 7 and l_quantity < 3)"
        " then -1 else 1 end) as varchar) end as quantity, cast(listed as varchar) as unit_price,"
        " cast(listed - amount as varchar) as discount_amount,"
        " cast(cast(case when o_orderstatus = 'P' or (l_linenumber = 7 and l_quantity < 3) then -amount else amount end"
        " as decimal(12,2)) as varchar) as line_total, case when o_orderkey % 41 = 0 then 'NZD' else "
        + currency("(o_custkey % 25 % 5)")
        + " end as currency, o_orderpriority as payment_method,"
        " od + 1 + cast(l_suppkey % 3 as integer) as extracted,"
        " 'pos/S0' || (o_custkey % 25 + 1) || '/pos_S0' || (o_custkey % 25 + 1) || '_' || strftime(od, '%Y-%m') || '.csv' as _source_file"
        ", li.ch from li join o on l_orderkey = o_orderkey",
    ),
    ("pos_raw", "select * exclude (ch) from till_raw where ch = 0"),
    (
        "pos_copies",
        "select *, row_number() over (partition by transaction_id, line_no order by _source_file, extracted, currency,"
        " discount_amount, line_total, payment_method, quantity, sku, store_id, od, txn_type, unit_price) as copy_number"
        " from pos_raw",
    ),
    (
        "stg_pos",
        "select transaction_id || '-' || line_no as pos_line_id, p.store_id, transaction_id, cast(line_no as integer) as line_no,"
        " cast(od as timestamp) as txn_ts, od as txn_date, txn_type, sku, cast(quantity as integer) as quantity,"
        " cast(unit_price as decimal(12,2)) as unit_price, cast(discount_amount as decimal(12,2)) as discount_amount,"
        " cast(line_total as decimal(12,2)) as line_total, s.currency, p.currency as reported_currency, payment_method,"
        " not (txn_type = 'SALE' and cast(quantity as integer) <= 0) as is_valid, _source_file"
        " from pos_copies p left join stg_stores s on p.store_id = s.store_id where copy_number = 1",
    ),
    (
        "quarantined",
        "select pos_line_id, store_id, transaction_id, line_no, txn_date, txn_type, sku, quantity, line_total, currency,"
        " 'SALE line with a non-positive quantity' as reason, _source_file from stg_pos where not is_valid",
    ),
    (
        "stg_web_orders",
        "select 'W-' || o_orderkey as order_id, cast(od as timestamp) as order_ts, od as order_date,"
        " 'U-' || o_custkey as customer_id, "
        + country("(o_custkey % 5)")
        + " as site, "
        + region("(o_custkey % 5)")
        + " as region_code, case o_custkey % 6 when 0 then 'paid_search' when 1 then 'paid_social' when 2 then 'display'"
        " when 3 then 'email' when 4 then 'affiliate' else 'organic' end as marketing_channel, "
        + currency("(o_custkey % 5)")
        + " as currency, case when o_orderstatus = 'P' then 'cancelled' else 'completed' end as order_status,"
        " cast(o_totalprice as decimal(12,2)) as items_subtotal, cast(0 as decimal(12,2)) as discount_total,"
        " cast(9.90 as decimal(12,2)) as shipping_fee, cast(cast(o_totalprice as decimal(12,2)) + 9.90 as decimal(12,2)) as order_total"
        " from o where ch = 1",
    ),
    (
        "stg_web_lines",
        "select 'W-' || l_orderkey || '-' || l_linenumber as order_line_id, 'W-' || l_orderkey as order_id,"
        " l_linenumber as line_no, 'SKU-' || l_partkey as sku, cast(l_quantity as integer) as quantity, listed as unit_price,"
        " cast(listed - amount as decimal(12,2)) as discount_amount, amount as line_total from li where ch = 1",
    ),
    (
        "stg_wholesale",
        "select lpad(cast(l_orderkey as varchar), 10, '0') || '-' || (l_linenumber * 10) as sales_order_line_id,"
        " lpad(cast(l_orderkey as varchar), 10, '0') as sales_order_id, l_linenumber * 10 as item, od as order_date,"
        " 'C-' || o_custkey as customer_id, 'MAT-' || l_partkey as material_id,"
        " cast(cast(l_quantity + case when l_linenumber = 6 then 0.6 else 0 end as decimal(15,3)) as integer) as quantity,"
        " 'EA' as unit_of_measure,"
        " cast(listed / (case when l_linenumber = 3 then 100 else 1 end) as decimal(12,2)) as unit_price,"
        " cast(amount as decimal(14,2)) as net_value, "
        + currency("(l_orderkey % 5)")
        + " as currency, od + 14 as requested_delivery_date, 'erp/vbap_' || strftime(sd, '%Y-%m') || '.csv' as _source_file"
        " from li left join o on l_orderkey = o_orderkey where li.ch = 2",
    ),
    (
        "stg_shipments",
        "select 'SH-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey as shipment_id,"
        " case when ch = 1 then 'W-' || l_orderkey else lpad(cast(l_orderkey as varchar), 10, '0') end as order_ref,"
        " case when ch = 1 then 'online' else 'wholesale' end as sales_channel, 'carrier_' || (l_suppkey % 4) as carrier,"
        " 'DC' || (l_suppkey % 2) as origin_dc, "
        + region("(l_orderkey % 5)")
        + " as region_code, sd + 5 as promised_date, cast(sd as timestamp) as shipped_at,"
        " case when not (l_linestatus = 'O' and l_quantity > 47)"
        " then cast(sd + cast(l_suppkey % 9 as integer) as timestamp) + interval '15 hours 30 minutes' end as delivered_at,"
        " case when l_linestatus = 'O' and l_quantity > 47 then 'in_transit' else 'delivered' end as status,"
        " 'logistics/shipments_' || strftime(sd, '%Y-%m') || '.csv' as _source_file, sd as shipped_date,"
        " case when not (l_linestatus = 'O' and l_quantity > 47) then sd + cast(l_suppkey % 9 as integer) end as delivered_date,"
        " case when not (l_linestatus = 'O' and l_quantity > 47) then l_suppkey % 9 <= 5 end as is_on_time,"
        " case when not (l_linestatus = 'O' and l_quantity > 47) then greatest(cast(l_suppkey % 9 as integer) - 5, 0)"
        " else 0 end as days_late from li where ch in (1, 2) and l_returnflag <> 'R'",
    ),
    (
        "ev",
        "select cast(ts as date) - 9131 as day, event_type, user_id % 5 as place, user_id % 3 as campaign,"
        " cast(value as decimal(12,2)) as value from events",
    ),
    (
        "stg_spend",
        "select day as spend_date, 'paid_search' as marketing_channel, "
        + region("place")
        + " as region_code, 'search ' || campaign as campaign_name, "
        + currency("place")
        + " as currency, cast(sum(value) as double) as spend_local, count(*) * 100 as impressions, count(*) as clicks,"
        " 'search_ads' as source_platform from ev where event_type = 'click' group by day, place, campaign"
        " union all select day, 'paid_social', case when place = 4 and campaign = 2 then null else "
        + region("place")
        + " end, 'social ' || campaign, "
        + currency("place")
        + ", cast(sum(value) as double), count(*) * 50, count(*), 'social_ads' from ev where event_type = 'view'"
        " group by day, place, campaign union all select day, case event_type when 'purchase' then 'display'"
        " when 'signup' then 'email' else 'affiliate' end, "
        + region("place")
        + ", null, "
        + currency("place")
        + ", cast(sum(value) as double), null, null, 'other_channels' from ev"
        " where event_type in ('purchase', 'signup', 'error') group by day, event_type, place",
    ),
    (
        "int_spend",
        "select s.*, case when s.currency = 'AUD' then s.spend_local * aud_nzd_rate else s.spend_local end as spend_nzd"
        " from stg_spend s left join stg_fx on spend_date = rate_date",
    ),
    (
        "channel_lines",
        "select pos_line_id as sales_line_id, transaction_id as order_id, 'store' as sales_channel, p.store_id,"
        " txn_date as order_date, s.region_code, material_id as product_id, quantity, line_total as amount_local, p.currency,"
        " case when txn_type = 'RETURN' then 'return' else 'sale' end as order_type, cast(null as varchar) as marketing_channel"
        " from stg_pos p join stg_stores s on p.store_id = s.store_id left join stg_materials m on p.sku = m.sku where is_valid"
        " union all select order_line_id, l.order_id, 'online', null, order_date, region_code, material_id, quantity, line_total,"
        " currency, 'sale', marketing_channel from stg_web_lines l join stg_web_orders w on l.order_id = w.order_id"
        " left join stg_materials m on l.sku = m.sku where order_status = 'completed'"
        " union all select sales_order_line_id, sales_order_id, 'wholesale', null, order_date, c.region_code, material_id,"
        " quantity, net_value, currency, 'sale', null from stg_wholesale w join stg_customers c on w.customer_id = c.customer_id",
    ),
    (
        "int_lines",
        "select u.*, coalesce(aud_nzd_rate, 1.0) as fx_rate, case when currency = 'AUD' then amount_local * aud_nzd_rate"
        " else amount_local end as revenue_nzd, standard_cost_nzd * quantity as cogs_nzd, material_id is not null as has_cost"
        " from channel_lines u left join stg_fx on order_date = rate_date left join stg_materials on product_id = material_id",
    ),
    (
        "int_orders",
        "select order_id, sales_channel, min(store_id) as store_id, min(order_date) as order_date, min(region_code) as region_code,"
        " min(order_type) as order_type, min(marketing_channel) as marketing_channel, count(*) as line_count,"
        " sum(quantity) as units, sum(revenue_nzd) as revenue_nzd from int_lines group by order_id, sales_channel",
    ),
    (
        "missing_products",
        "select distinct product_id from int_lines left join stg_materials on product_id = material_id"
        " where material_id is null and product_id is not null",
    ),
    (
        "dim_products",
        "select material_id as product_id, sku, description, coalesce(product_category, 'Unknown') as product_category,"
        " standard_cost_nzd, list_price_nzd, list_price_aud, created_on, false as is_inferred from stg_materials"
        " union all select product_id, null, 'Not yet in the material master', 'Unknown', null, null, null, null, true"
        " from missing_products",
    ),
    (
        "fct_lines",
        "select sales_line_id, order_id, order_date, sales_channel, store_id, region_code, l.product_id,"
        " case when l.product_id is not null then coalesce(m.product_category, 'Unknown') end as product_category, order_type, order_type = 'return' as is_return, quantity, currency as source_currency, amount_local, fx_rate,"
        " revenue_nzd, cogs_nzd, case when has_cost then revenue_nzd - cogs_nzd end as gross_profit_nzd, has_cost"
        " from int_lines l left join stg_materials m on l.product_id = m.material_id",
    ),
    (
        "fct_orders",
        "select order_id, order_date, sales_channel, store_id, region_code, order_type, i.marketing_channel,"
        " coalesce(is_paid, false) as is_paid_attribution, line_count, units, revenue_nzd,"
        " row_number() over (partition by sales_channel, order_date order by revenue_nzd desc, order_id) as revenue_rank_in_day"
        " from int_orders i left join marketing_channels c on i.marketing_channel = c.marketing_channel",
    ),
    (
        "fct_spend",
        "select spend_date || '|' || marketing_channel || '|' || region_code || '|' || coalesce(campaign_name, '-') as spend_id,"
        " spend_date, marketing_channel, region_code, campaign_name, source_platform, currency as billing_currency, spend_local,"
        " spend_nzd, impressions, clicks from int_spend",
    ),
    (
        "fct_shipments",
        "select shipment_id, order_ref as order_id, sales_channel, carrier, origin_dc, region_code, shipped_date, promised_date,"
        " delivered_date, is_on_time, days_late from stg_shipments",
    ),
    (
        "ledger",
        "select txn_date as posting_date, store_id, '400000' as gl_account, p.currency,"
        " cast(sum(line_total) as decimal(14,2)) as amount_local, cast(round(sum(case when p.currency = 'AUD' then"
        " line_total * aud_nzd_rate else line_total end), 2) + case when extract(day from txn_date) = 13 then 1.00 else 0 end"
        " as decimal(14,2)) as amount_nzd from stg_pos p left join stg_fx on txn_date = rate_date where is_valid"
        " group by store_id, txn_date, p.currency",
    ),
]


def _named_in(sql: str) -> set[str]:
    return set(re.findall(r"\w+", sql))


def build(select: str, extra: str = "") -> str:
    """The select with the CTEs that it reads, directly or through others; those that are read more than once are materialised."""
    bodies = dict(CTES)
    texts = {"": f"{extra} {select}"}
    todo = [""]
    while todo:
        for name in _named_in(texts[todo.pop()]) & bodies.keys() - texts.keys():
            texts[name] = bodies[name]
            todo.append(name)
    used = [name for name, _ in CTES if name in texts]
    reads = {name: sum(len(re.findall(rf"\b{name}\b", text)) for text in texts.values()) for name in used}
    chain = [f"{name} as {'materialized ' if reads[name] > 1 else ''}({bodies[name]})" for name in used]
    chain += [extra] if extra else []
    return f"with {(',' + chr(10)).join(chain)}\n{select}" if chain else select
