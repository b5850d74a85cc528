"""The registered reports in DuckDB's SQL, written apart from the DataFrame code."""

from __future__ import annotations

import csv
from pathlib import Path

from tallyhouse.functions import ladders
from tallyhouse.plans.declared import DECLARED
from tallyhouse.sources import landing
from tallyhouse.sources.sales import LINES_SQL

_Q = lambda s: s.replace("'", "''")


def _case(rules, default):
    return "case " + " ".join(f"when {c} then '{_Q(v)}'" for c, v in rules) + f" else {default} end"


def _names(rules, default):
    return "case " + " ".join(f"when upper(store_name) like '{_Q(p)}' then '{_Q(v)}'" for p, v in rules) + f" else '{_Q(default)}' end"


_ITEM = "item_description, category, category_name, vendor_number, vendor_name, bottle_volume_ml, pack, state_bottle_cost, state_bottle_retail"
_STORE = "store_name, address, city, zip_code, store_location, county_number, county"
_MEASURES = ("bottles_sold", "sale_dollars", "volume_sold_liters", "volume_sold_gallons")
_any = lambda sign: " or ".join(f"{c} {sign} 0" for c in _MEASURES)
_changed = " or ".join(f"coalesce({c}, {d}) <> coalesce(p_{c}, {d})" for c, d in [(c, "''") for c in ("item_description", "category", "category_name", "vendor_number", "vendor_name")] + [(c, "-1") for c in ("bottle_volume_ml", "pack", "state_bottle_cost", "state_bottle_retail")])
_ECON = "', '".join(f"{k}-{n}" for k in ("ECONOMY", "STANDARD", "MEDIUM", "LARGE", "PROMO") for n in range(3))
_FAMILY = "case split_part(category, '-', 1) when 'ECONOMY' then 'Vodkas' when 'STANDARD' then 'Rum' when 'MEDIUM' then 'Tequilas' when 'LARGE' then 'Whiskies' when 'PROMO' then 'Gin' end"
_BUNDLE = "(" + " or ".join(f"upper(coalesce(item_description, '')) like '{p}'" for p in ladders.BUNDLE_PATTERNS) + f" or regexp_matches(upper(coalesce(item_description, '')), '{ladders.BUNDLE_COUNT}'))"


def _current(source, key, columns, name):
    return f"""{name} as (select {key}, {columns} from (select *, row_number() over (partition by {key} order by order_date desc nulls last,
    loaded_at desc nulls first, invoice_item_number desc nulls last, tie_supp desc nulls last) rn
  from {source}) where rn = 1)"""


BASE = f"""with lines as ({LINES_SQL.format(lineitem="lineitem", orders="orders", customer="customer", nation="nation", part="part")}),
sales as (select *, state_bottle_retail - state_bottle_cost as gross_profit_per_bottle, state_bottle_cost * bottles_sold as estimated_total_cost,
    sale_dollars - state_bottle_cost * bottles_sold as estimated_gross_profit, upper(invoice_item_number) like 'RINV-%' as is_return from lines),
ded as (select * exclude (rn) from (select *, row_number() over (partition by invoice_item_number order by loaded_at desc nulls first,
    order_date desc nulls first, store_number desc nulls first, item_number desc nulls first, tie_supp desc nulls first) rn from sales) where rn = 1),
daily as (select order_date, store_number, cast(sum(bottles_sold) as bigint) as total_bottles_sold, cast(sum(sale_dollars) as decimal(20,4)) as total_sales_dollars,
    cast(sum(volume_sold_liters) as decimal(20,4)) as total_volume_sold_liters, cast(sum(volume_sold_gallons) as decimal(20,4)) as total_volume_sold_gallons,
    cast(sum(estimated_total_cost) as decimal(20,4)) as total_estimated_cost, cast(sum(estimated_gross_profit) as decimal(20,4)) as total_estimated_gross_profit,
    count(*) as invoice_line_count from ded group by 1, 2),
{_current("sales", "item_number", _ITEM, "item0")},
items as (select *, coalesce({_FAMILY}, 'Other') as category_family from item0),
{_current("sales", "store_number", _STORE, "store0")},
stores as (select *, {_names(ladders.CHAIN_RULES, ladders.CHAIN_DEFAULT)} as chain, {_names(ladders.CHANNEL_RULES, ladders.CHANNEL_DEFAULT)} as store_channel from store0),
day_item as (select item_number, order_date, loaded_at, {_ITEM} from (select *, row_number() over (partition by item_number, order_date order by loaded_at desc nulls first,
    invoice_item_number desc nulls last, tie_supp desc nulls last) rn from ded) where rn = 1),
lagged as (select *, {", ".join(f"lag({c}) over w as p_{c}" for c in _ITEM.split(", "))} from day_item window w as (partition by item_number order by order_date)),
points as (select item_number, {_ITEM}, order_date as business_valid_from, loaded_at as source_loaded_at from lagged where p_item_description is null or {_changed}),
hist as (select *, business_valid_to is null as is_current from (select *, cast(lead(business_valid_from) over (partition by item_number order by business_valid_from) - interval 1 day as date) as business_valid_to from points)),
sized as (select *, coalesce({_FAMILY}, 'Other') as category_family, {_BUNDLE} as is_bundle_pack, cast(case when bottle_volume_ml <= 0 then null when bottle_volume_ml between 680 and 720 then 750 else bottle_volume_ml end as int) as effective_bottle_volume_ml,
    {_case(ladders.PACKAGE_SIZES, "'jumbo_value'")} as package_size_tier from hist),
tiered as (select *, case when not is_bundle_pack and effective_bottle_volume_ml > 0 then cast(floor((state_bottle_retail * 20000 + effective_bottle_volume_ml) / (2 * effective_bottle_volume_ml)) / 100 as decimal(12,2)) end as price_per_100ml,
    {_case(ladders.RETAIL_TIERS, "'1000_plus'")} as retail_price_tier, {_case(ladders.PRICE_TIERS, "'20_plus'")} as price_per_100ml_tier from sized),
priced as (select *, {_case(ladders.SEGMENTS, "'other'")} as price_position_segment from tiered),
labelled as (select f.item_number, f.store_number, f.order_date, f.sale_dollars, f.bottles_sold, d.category_name, d.category_family,
    coalesce(d.vendor_number, 'Unknown Vendor Number') as vendor_number, coalesce(d.vendor_name, 'Unknown Vendor') as vendor_name, coalesce(cast(d.bottle_volume_ml as varchar),
    'Unknown Bottle Volume') as bottle_volume_ml, coalesce(d.item_description, 'Unknown Item') as item_description from ded f join items d on f.item_number = d.item_number)
"""

_HIST = "item_number, item_description, category, category_name, category_family, vendor_number, vendor_name, bottle_volume_ml, pack, state_bottle_cost, state_bottle_retail, business_valid_from, business_valid_to, is_current, source_loaded_at, is_bundle_pack, effective_bottle_volume_ml, package_size_tier, price_per_100ml, retail_price_tier, price_per_100ml_tier, price_position_segment"

# periods around October 2001, written out
P = {"month": ("2001-10-01", "2001-11-01"), "month_prior": ("2000-10-01", "2000-11-01"), "t3m": ("2001-08-01", "2001-11-01"), "t3m_prior": ("2000-08-01", "2000-11-01"), "t12m": ("2000-11-01", "2001-11-01"), "t12m_prior": ("1999-11-01", "2000-11-01"), "cagr_start_year": ("1999-01-01", "2000-01-01"), "cagr_end_year": ("2001-01-01", "2002-01-01")}


def _sum(name, value="sale_dollars", prefix="sales"):
    a, b = P[name]
    return f"cast(sum(case when order_date >= date '{a}' and order_date < date '{b}' then {value} else 0 end) as double) as {prefix}_{name}"


def _sums(*names):
    return ", ".join(_sum(n) for n in names)


def _yoy(p):
    return f"case when sales_{p}_prior <> 0 then round((sales_{p} - sales_{p}_prior) * 100 / sales_{p}_prior, 2) end as {p}_yoy_pct"


def _half_up(money, count, digits):
    """Cents by a count, rounded half away from zero in whole numbers."""
    cents = f"cast(round({money} * 100) as hugeint)"
    return f"case when {count} <> 0 then sign({cents}) * sign({count}) * cast((2 * abs({cents}) * {10 ** (digits - 2)} + abs({count})) // (2 * abs({count})) as double) / {10 ** digits} end"


SIX = ("month", "month_prior", "t3m", "t3m_prior", "t12m", "t12m_prior")
_yoys = ", ".join(_yoy(p) for p in ("month", "t3m", "t12m"))
_money = lambda c: f"cast(sum(cast({c} as decimal(20,2))) as double) as {c}"


def _with_total(detail, label, columns, names, yoys):
    """detail rows and their total."""
    nulls = ", ".join(f"null as {c}" for c in columns)
    return f", detail as ({detail}), both_ as (select 'detail' as row_type, {label}, {', '.join([*columns, *names])} from detail union all select 'grand_total', 'Grand Total', {nulls + ', ' if nulls else ''}{', '.join(_money(n) for n in names)} from detail) select *, {yoys} from both_"


FAMILY, CATEGORY = "Whiskies", "LARGE CLASS 1"
_six = [f"sales_{n}" for n in SIX]
_twelve = ["sales_t12m", "sales_t12m_prior"]


def _mix(by, lines):
    return f"""{lines},
detail0 as (select {by}, vendor_number, {_sums("t12m", "t12m_prior")}, cast(sum(case when order_date >= date '2000-11-01' and order_date < date '2001-11-01' then bottles_sold else 0 end) as bigint) as units_t12m from hl group by 1,
    2),
names as (select vendor_number, vendor_name from (select vendor_number, vendor_name, row_number() over (partition by vendor_number order by count(*) desc,
    vendor_name) rn from hl group by 1, 2) where rn = 1),
ranks as (select vendor_number, vendor_name, cast(row_number() over (order by t desc, vendor_name, vendor_number) as int) as vendor_rank from (select vendor_number,
    sum(cast(sales_t12m as decimal(20,2))) as t from detail0 group by 1) join names using (vendor_number)),
detail as (select 'detail' as row_type, {by}, vendor_number, vendor_name, vendor_rank, sales_t12m, sales_t12m_prior, units_t12m from detail0 join ranks using (vendor_number)),
mixed as (select * from detail union all select 'grand_total', 'Grand Total', null, null, null, {_money("sales_t12m")}, {_money("sales_t12m_prior")}, cast(sum(units_t12m) as bigint) from detail),
mix as (select *, {_half_up("sales_t12m", "units_t12m", 2)} as avg_selling_price, {_yoy("t12m")} from mixed)"""


def _historic(grouped=False, package="", channel=False):
    merged = """when price_position_segment in ('premium_bulk', 'value_oversized', 'bundle_pack') then 'bulk_or_bundle'
        when price_position_segment in ('trial_value', 'trial_premium', 'trial_luxury') then 'trial_size'"""
    more = """when price_position_segment in ('budget', 'standard') then 'budget_standard'
        when price_position_segment in ('premium', 'super_premium', 'ultra_premium', 'luxury', 'icon_collectible') then 'premium_plus'"""
    segment = f"case {more if grouped else ''} {merged} else price_position_segment end"
    size = f" and package_size_tier = '{package}'" if package else ""
    hl = f""", hl as (select f.item_number, f.store_number, f.order_date, f.sale_dollars, f.bottles_sold, {segment} as price_position_segment,
    coalesce(h.vendor_number, 'Unknown Vendor Number') as vendor_number, coalesce(h.vendor_name, 'Unknown Vendor') as vendor_name
  from ded f join priced h on f.item_number = h.item_number and f.order_date >= h.business_valid_from and (h.business_valid_to is null or f.order_date <= h.business_valid_to)
  where h.category_family = '{FAMILY}'{size})"""
    if channel:
        hl = hl.replace(", hl as", ", hl0 as") + ", hl as (select hl0.*, coalesce(store_channel, 'Unknown') as store_channel from hl0 left join stores using (store_number))"
    return hl


def _compare(by, lines):
    return f"""{lines},
per as (select * from (values (0, 2001, date '2000-11-01', date '2001-11-01'), (2, 1999, date '1998-11-01', date '1999-11-01')) v(period_order, period_year, a, b)),
ins as (select hl.*, period_order, period_year from hl join per on order_date >= a and order_date < b),
names as (select vendor_number, vendor_name from (select vendor_number, vendor_name, row_number() over (partition by vendor_number order by count(*) desc,
    vendor_name) rn from ins group by 1, 2) where rn = 1),
top as (select vendor_number, vendor_name, cast(row_number() over (order by t desc, vendor_name, vendor_number) as int) as vendor_rank from (select vendor_number,
    sum(sale_dollars) as t from ins where period_order = 0 group by 1) join names using (vendor_number) qualify vendor_rank <= 3),
folded as (select period_order, period_year, coalesce(top.vendor_number, 'Other') as vendor_number, coalesce(top.vendor_name, 'Other Vendors') as vendor_name,
    coalesce(vendor_rank, 4) as vendor_rank, {by}, cast(sum(sale_dollars) as double) as sales_t12m, cast(sum(bottles_sold) as bigint) as units_t12m from ins left join top on ins.vendor_number = top.vendor_number group by all)
select *, {_half_up("sales_t12m", "units_t12m", 2)} as avg_selling_price from folded"""


def _velocity(where):
    return f""", base as (select item_number, cast(sum(bottles_sold) as bigint) as total_units_sold, cast(sum(sale_dollars) as decimal(20,2)) as total_revenue from ded where not is_return and {where} group by 1),
ranked as (select *, cast(sum(total_units_sold) over (order by total_units_sold desc, item_number rows unbounded preceding) as bigint) as cumulative_units,
    cast(sum(total_revenue) over (order by total_revenue desc, item_number rows unbounded preceding) as decimal(38,2)) as cumulative_revenue,
    cast(sum(total_units_sold) over () as bigint) as state_units, cast(sum(total_revenue) over () as decimal(20,2)) as state_revenue, count(*) over () as active_sku_count from base),
shares as (select *, case when state_units <> 0 then cast(cumulative_units as double) / state_units end as cumulative_units_pct, case when state_revenue <> 0 then cast(cumulative_revenue as double) / cast(state_revenue as double) end as cumulative_revenue_pct from ranked),
cls as (select *, {", ".join(f"case when cumulative_{m}_pct <= 0.8 then 'Tier 1: Core' when cumulative_{m}_pct <= 0.95 then 'Tier 2: Niche' else 'Tier 3: Zombie' end as {n}_tier" for m, n in (("units", "volume"), ("revenue", "revenue")))} from shares),
lab as (select cls.*, item_description, category_name, category_family, vendor_name, i.bottle_volume_ml from cls left join items i using (item_number)),
long_ as (select *, 'volume' as dimension, volume_tier as tier from lab union all select *, 'revenue', revenue_tier from lab)"""


MART = _velocity("order_date >= (select max(order_date) from ded) - interval 84 day")
TRAIL = _velocity("order_date >= date '2001-08-06' and order_date < date '2001-10-30'")
_agg = "count(*) as sku_count, cast(sum(total_units_sold) as bigint) as units, cast(sum(total_revenue) as double) as revenue"
_price_col = _half_up("total_revenue", "total_units_sold", 4) + " as avg_selling_price"

WEEKLY = """, wk as (select cast(date_trunc('week', max(order_date)) as date) as this_week from ded),
recent as (select ded.*, this_week from ded, wk where not is_return and order_date >= this_week - interval 56 day and order_date < this_week),
spine as (select item_number, cast(this_week - to_days(cast(7 * k as int)) as date) as week_start from (select distinct item_number, this_week from recent), range(1, 9) r(k)),
sold as (select item_number, cast(date_trunc('week', order_date) as date) as week_start, sum(bottles_sold) as u from recent group by 1, 2),
weekly as (select item_number, week_start, cast(coalesce(u, 0) as bigint) as weekly_units_sold from spine left join sold using (item_number, week_start)),
roll as (select item_number, cast(avg(case when week_start >= n - interval 28 day then weekly_units_sold end) as double) as trailing_4wk_avg_units, cast(avg(weekly_units_sold) as double) as trailing_8wk_avg_units, cast(sum(case when week_start >= n - interval 28 day then weekly_units_sold end) as bigint) as units_4wk, cast(sum(weekly_units_sold) as bigint) as units_8wk from weekly, (select max(week_start) + interval 7 day as n from weekly) group by 1),
fc as (select *, greatest(0.0, trailing_4wk_avg_units, trailing_8wk_avg_units) as selected_baseline_units, cast(floor((greatest(0, units_4wk * 30, units_8wk * 15) + 50) / 100.0) as int) as recommended_ship_qty from roll)"""


def _snapshot(of):
    key, columns = f"{of}_number", (_ITEM if of == "item" else _STORE)
    derived = f"coalesce({_FAMILY}, 'Other') as category_family" if of == "item" else f"{_names(ladders.CHAIN_RULES, ladders.CHAIN_DEFAULT)} as chain, {_names(ladders.CHANNEL_RULES, ladders.CHANNEL_DEFAULT)} as store_channel"
    every = [*columns.split(", "), *(("category_family",) if of == "item" else ("chain", "store_channel"))]
    cols = ", ".join(every)
    same = " and ".join(f"o.{c} is not distinct from n.{c}" for c in every)
    return f""", {_current("(select * from sales where loaded_at < timestamp '2000-01-01')", key, columns, f"{of}_old0")},
{of}_old as (select *, {derived} from {of}_old0), {of}_new as (select {key}, {cols} from {of}s),
{of}_differs as (select {key} from {of}_old o join {of}_new n using ({key}) where not ({same})),
{of}_snap as (
  select {key}, {cols}, timestamp '2000-01-01' as dbt_valid_from, case when {key} in (select {key} from {of}_differs) then timestamp '2002-01-01' end as dbt_valid_to from {of}_old
  union all select {key}, {cols}, timestamp '2002-01-01', null from {of}_new where {key} in (select {key} from {of}_differs) or {key} not in (select {key} from {of}_old))"""


SNAP_ITEM, SNAP_STORE = _snapshot("item"), _snapshot("store")
_LINES = "invoice_item_number, order_date, store_number, item_number, sale_dollars, loaded_at"
_OLD, _NEW = "(select * from ded where loaded_at < timestamp '2000-01-01')", "(select max(loaded_at) from ded where loaded_at < timestamp '2000-01-01')"
_FACT = "invoice_item_number, order_date, store_number, item_number, vendor_number, category, bottles_sold, sale_dollars, volume_sold_liters, volume_sold_gallons, estimated_total_cost, estimated_gross_profit, is_return, loaded_at"
RUNS = """with runs as (select cast(event_id as varchar) as run_id, event_type as source, ts as created_at, cast(value as decimal(12,4)) as duration_seconds, case event_type when 'error' then 'failed' when 'signup' then 'degraded' else 'success' end as final_dag_state, case when user_id % 10 = 0 then 'WARN' else 'PASS' end as freshness_status, 'PASS' as snapshot_status
  from events)"""
_RUN = "run_id, source, created_at, duration_seconds, final_dag_state, freshness_status, snapshot_status"

q = {}
# payload records as sources.sales.payload_lines words them, every 40th order with a fault of its own
_PAYLOAD = """, numbered as (select *, cast(split_part(invoice_item_number, '-', 2) as bigint) % 40 as k from sales),
records as (select *, case k when 3 then null else cast(order_date as varchar) || 'T00:00:00.000' end as date_text,
    case when k in (1, 4) then 'six' else cast(pack as varchar) end as pack_text, case k when 4 then '12345678901234' else cast(sale_dollars as varchar) end as dollars_text from numbered),
worded as (select *, cast(to_json({invoice_line_no: invoice_item_number, date: case k when 2 then strftime(order_date, '%Y') || '-02-30' else date_text end, store: store_number, itemno: item_number, pack: pack_text,
    bottle_volume_ml: cast(bottle_volume_ml as varchar), sale_bottles: cast(bottles_sold as varchar), sale_dollars: dollars_text}) as varchar) as whole from records),
payload as (select *, case k when 0 then substring(whole, 1, length(whole) // 2) when 5 then '[' || whole || ']' else whole end as record from worded)"""
q["s1_landed"] = BASE + _PAYLOAD + """ select invoice_item_number, case k when 3 then null else order_date end as date, store_number, item_number, pack, bottle_volume_ml, bottles_sold, sale_dollars
  from payload where k not in (0, 1, 2, 4, 5)"""
q["s1_rejected"] = BASE + _PAYLOAD + """ select case k when 0 then 'malformed' when 5 then 'malformed' when 1 then 'cast:pack' when 2 then 'cast:date' else 'cast:pack,sale_dollars' end as reason, record from payload where k in (0, 1, 2, 4, 5)"""
_SHOWN = "invoice_item_number, order_date as date, store_number, item_number, pack, bottle_volume_ml, bottles_sold, sale_dollars, cast(loaded_at as timestamp) as loaded_at"
q["s4_replaced_window"] = BASE + f"""select {_SHOWN} from sales where loaded_at < timestamp '2000-01-01' and not order_date between date '1999-06-01' and date '1999-06-28'
  union all select {_SHOWN} from sales where order_date between date '1999-06-01' and date '1999-06-28'"""
with (Path(landing.__file__).parent / "category_families.csv").open(newline="") as _file:
    _SEED = ", ".join(f"({n}, '{r[0]}', '{_Q(r[2])}')" for n, r in enumerate(sorted(list(csv.reader(_file))[1:])))
q["s6_seed_families"] = BASE + f""", seed as (select * from (values {_SEED}) v(place, category, category_family))
select coalesce(seed.category_family, 'Other') as category_family, count(*) as n_lines, cast(sum(sale_dollars) as double) as sales
  from ded left join seed on cast(item_number as int) % 60 = place group by 1"""
q["m2_enriched_sales"] = BASE + """select invoice_item_number, tie_supp, gross_profit_per_bottle, estimated_total_cost, estimated_gross_profit, case when bottles_sold <> 0 then cast(sale_dollars as double) / bottles_sold end as revenue_per_bottle
  from sales"""
q["m3_deduped_sales"] = BASE + "select * from ded"
q["m3a_duplicate_audit"] = BASE + """select invoice_item_number, count(*) as row_count, count(distinct order_date) as distinct_dates, count(distinct store_number) as distinct_stores, count(distinct item_number) as distinct_items, count(distinct sale_dollars) as distinct_sales, count(distinct bottles_sold) as distinct_bottles, min(loaded_at) as first_loaded_at, max(loaded_at) as last_loaded_at
  from sales group by 1 having count(*) > 1"""
q["m3b_anomalous_returns"] = BASE + f"select {_LINES}, 'positive_return' as anomaly from ded where is_return and ({_any('>')})"
q["m3c_unlabeled_negatives"] = BASE + f"select {_LINES}, 'unlabeled_negative' as anomaly from ded where not is_return and ({_any('<')})"
q["m4_item_history"] = BASE + "select * from hist"
q["m4_updated_history"] = BASE + "select * from hist"
q["m4b_dim_item_history"] = BASE + f"select {_HIST} from priced"
q["m4c_items_current"] = BASE + "select * from items"
q["m4d_stores_current"] = BASE + "select * from stores"
q["m5_item_snapshot"] = BASE + SNAP_ITEM + "select * from item_snap"
q["m5_store_snapshot"] = BASE + SNAP_STORE + "select * from store_snap"
q["m5a_dim_item"] = BASE + SNAP_ITEM + "select * exclude (dbt_valid_from, dbt_valid_to) from item_snap where dbt_valid_to is null"
q["m5a_dim_store"] = BASE + SNAP_STORE + "select * exclude (dbt_valid_from, dbt_valid_to) from store_snap where dbt_valid_to is null"
q["m5b_asof_snapshot"] = BASE + SNAP_ITEM + """select f.invoice_item_number, f.order_date, s.item_description, s.dbt_valid_from
  from ded f join item_snap s on f.item_number = s.item_number and f.order_date >= s.dbt_valid_from and (s.dbt_valid_to is null or f.order_date < s.dbt_valid_to)"""
q["m6_merge"] = BASE + f""", fresh as (select * from ded where loaded_at >= {_NEW} - interval 3 day) select {_FACT} from {_OLD} where invoice_item_number not in (select invoice_item_number from fresh)
  union all select {_FACT} from fresh"""
q["m7_replace_window"] = BASE + f"select {_FACT} from {_OLD} where not order_date between date '1999-06-01' and date '1999-06-28' union all select {_FACT} from ded where order_date between date '1999-06-01' and date '1999-06-28'"
q["m8_store_daily_sales"] = BASE + "select * from daily"
q["m9_velocity_base"] = BASE + MART + "select * from base"
q["m9a_velocity_ranked"] = BASE + MART + "select * from ranked"
q["m9b_velocity_classified"] = BASE + MART + "select * from cls"
q["m9c_sku_velocity"] = BASE + MART + "select * from lab"
q["m10_weekly_depletions"] = BASE + WEEKLY + "select * from weekly"
q["m10a_rolling_metrics"] = BASE + WEEKLY + "select * from roll"
q["m10b_baseline_forecast"] = BASE + WEEKLY + "select * from fc"
q["m10c_replenishment_forecast"] = BASE + WEEKLY + """select item_number, item_description, category_name, category_family, vendor_name, trailing_4wk_avg_units, trailing_8wk_avg_units, selected_baseline_units, recommended_ship_qty
  from fc left join items using (item_number)"""
q["m11_fact_sales"] = BASE + f"select {_FACT} from ded"
q["m12_category_family"] = BASE + f"select category, coalesce({_FAMILY}, 'Other') as category_family, count(*) as n from ded group by 1, 2"

_fam = ", ".join(f"('{f}')" for f in ladders.FAMILIES)
_eight = [f"sales_{n}" for n in P]
GROWTH1 = f""", fs as (select category_family, {_sums(*P)}, 1999 as cagr_start_year, 2001 as cagr_end_year from labelled group by 1),
  detail as (select fam.category_family, {', '.join(f'coalesce({c}, 0) as {c}' for c in _eight)}, cagr_start_year, cagr_end_year from (values {_fam}) fam(category_family) left join fs using (category_family)),
    both_ as (select 'detail' as row_type, category_family, {', '.join(_eight)}, cagr_start_year, cagr_end_year from detail union all select 'grand_total',
    'Grand Total', {', '.join(_money(c) for c in _eight)}, max(cagr_start_year), max(cagr_end_year) from detail)"""
q["q1_family_growth"] = BASE + GROWTH1 + f" select *, {_yoys} from both_"
q["q2_family_drilldown"] = BASE + f""", detail as (select category_name, {_sums('t12m', 't12m_prior')}
  from labelled where category_family = '{FAMILY}'
  group by 1)
  , both_ as (select 0 as row_type, * from detail
  union all select 1, 'Grand Total', {_money('sales_t12m')}, {_money('sales_t12m_prior')} from detail) select *, {_yoy('t12m')} from both_"""
q["q3_vendor_volume_growth"] = BASE + f""", s as (select category_name as c, vendor_number as n, vendor_name as v, bottle_volume_ml as b, grouping(category_name) as gc, grouping(vendor_number) as gn, grouping(bottle_volume_ml) as gb, {_sums(*SIX)}
  from labelled where category_name = '{CATEGORY}' and ltrim(vendor_number, '0') in ('1', '2', '3')
  group by grouping sets ((category_name, vendor_number, vendor_name, bottle_volume_ml), (category_name, vendor_number, vendor_name), (category_name, bottle_volume_ml), (category_name), ()))
  select case when gc = 1 then 'grand_total' when gn = 0 and gb = 0 then 'detail' when gn = 0 then 'subtotal_by_vendor' when gb = 0 then 'subtotal_by_bottle_volume' else 'subtotal_by_category' end as row_type, 
  case when gc = 1 then 'Grand Total' when gn = 0 and gb = 1 then 'Subtotal by Vendor: ' || c when gn = 1 and gb = 0 then 'Subtotal by Bottle Volume: ' || c when gn = 1 then 'Subtotal: ' || c else c end as category_name, n as vendor_number, v as vendor_name, b as bottle_volume_ml, 
  {', '.join(_six)}, {_yoys} from s"""
q["q4_family_vendor_growth"] = BASE + f""", s as (select category_family as c, vendor_number as n, vendor_name as v, grouping(category_family) as gc, grouping(vendor_number) as gn, {_sums(*SIX)}
  from labelled where category_family = '{FAMILY}'
  group by grouping sets ((category_family, vendor_number, vendor_name), (category_family), ()))
  select case when gc = 1 then 'grand_total' when gn = 0 then 'subtotal_by_vendor' else 'subtotal_by_category' end as row_type, 
  case when gc = 1 then 'Grand Total' when gn = 0 then 'Subtotal by Vendor: ' || c else 'Subtotal: ' || c end as category_name, n as vendor_number, v as vendor_name, cast(null as varchar) as bottle_volume_ml, 
  {', '.join(_six)}, {_yoys} from s"""
for _name, _scope in (("q5_category_item_growth", f"category_name = '{CATEGORY}' and vendor_number in ('001', '004')"), ("q6_family_item_growth", f"category_family = '{FAMILY}'")):
    q[_name] = BASE + _with_total(f"select item_number, item_description, vendor_number, vendor_name, bottle_volume_ml, {_sums(*SIX)} from labelled where {_scope} group by 1, 2, 3, 4, 5", "item_description", ["item_number", "vendor_number", "vendor_name", "bottle_volume_ml"], _six, _yoys)
CHAINS = f"select coalesce(chain, 'Unknown Chain') as chain, {_sums(*SIX)} from labelled join stores using (store_number) where category_name = '{CATEGORY}' group by 1"
q["q7_chain_growth"] = BASE + _with_total(CHAINS, "chain", [], _six, _yoys)
q["q8_vendor_category_mix"] = BASE + f""", d0 as (select category_name, vendor_number, vendor_name, {_sums('t12m', 't12m_prior')} from labelled where category_family = '{FAMILY}' group by 1,
    2, 3), rk as (select vendor_number, vendor_name, cast(row_number() over (order by sum(cast(sales_t12m as decimal(20,2))) desc, vendor_name, vendor_number) as int) as vendor_rank
  from d0 group by 1, 2)""" + _with_total("""select category_name, vendor_number, vendor_name, vendor_rank, sales_t12m, sales_t12m_prior
  from d0 join rk using (vendor_number, vendor_name)""", "category_name", ["vendor_number", "vendor_name", "vendor_rank"], _twelve, _yoy("t12m"))
q["q9_price_segment_mix"] = BASE + _mix("price_position_segment", _historic()) + "select * from mix"
q["q9_price_segment_mix_standard"] = BASE + _mix("price_position_segment", _historic(package="standard")) + "select * from mix"
q["q10_grouped_segment_mix"] = BASE + _mix("price_position_segment", _historic(grouped=True)) + "select * from mix"
q["q11_segment_mix_compare"] = BASE + _compare("price_position_segment", _historic(grouped=True))
q["q12_store_channel_mix"] = BASE + _mix("store_channel", _historic(channel=True)) + "select * from mix"
q["q13_channel_mix_compare"] = BASE + _compare("store_channel", _historic(channel=True))
SHARE = f""", share as (select * from (select period_order, period_year, period_label, vendor_number, vendor_name, cast(sum(sale_dollars) as double) as sales_t12m
  from labelled join (values (0, 2001, 'Oct 2001', date '2000-11-01', date '2001-11-01'), (1, 2000, 'Oct 2000', date '1999-11-01',
    date '2000-11-01'), (2, 1999, 'Oct 1999', date '1998-11-01', date '1999-11-01')) v(period_order, period_year, period_label, a, b) on order_date >= a and order_date < b
  where category_family = '{FAMILY}' group by all) where sales_t12m > 0)"""
q["q14_vendor_share"] = BASE + SHARE + " select * from share"


def _trend(scope, value, n):
    return f""", bs as (select cast(date_trunc('month', order_date) as date) as sales_month, {scope} as scope_name, vendor_number, vendor_name, sale_dollars from labelled
  where {scope} = '{value}' and order_date >= date '2000-01-01' and order_date < date '2001-11-01'),
  tv as (select vendor_number, vendor_name, cast(row_number() over (order by sum(sale_dollars) desc, vendor_name, vendor_number) as int) as vendor_rank
  from bs group by 1, 2 qualify vendor_rank <= {n}), trend as (select sales_month, scope_name, vendor_number, vendor_name, vendor_rank, cast(sum(sale_dollars) as double) as sales_dollars
  from bs join tv using (vendor_number, vendor_name) group by all)"""


q["q15_family_vendor_trend"] = BASE + _trend("category_family", FAMILY, 5) + " select * from trend"
q["q16_category_vendor_trend"] = BASE + _trend("category_name", CATEGORY, 3) + " select * from trend"
q["q17_sku_tier_summary"] = BASE + TRAIL + f"""select dimension, tier, {_agg}, round(cast(count(*) as double) / max(active_sku_count),
    6) as sku_share, round(cast(sum(total_units_sold) as double) / max(state_units), 6) as unit_share, round(cast(sum(total_revenue) as double) / cast(max(state_revenue) as double), 6) as revenue_share
  from long_ group by 1, 2"""
MATRIX = f", matrix as (select volume_tier, revenue_tier, {_agg} from lab group by 1, 2)"
q["q18_sku_tier_matrix"] = BASE + TRAIL + MATRIX + " select * from matrix"
BYFAM = f""", bf0 as (select dimension, coalesce(category_family, 'Other') as category_family, tier, {_agg} from long_ group by 1,
    2, 3), bf as (select *, round(cast(sku_count as double) / sum(sku_count) over w, 6) as sku_share, case when sum(cast(revenue as decimal(20,2))) over w <> 0 then round(revenue / cast(sum(cast(revenue as decimal(20,2))) over w as double),
    6) end as revenue_share
  from bf0 window w as (partition by dimension, category_family))"""
q["q19_tier_by_family"] = BASE + TRAIL + BYFAM + " select * from bf"
q["q20_divergent_skus"] = BASE + TRAIL + f"""select *, {_case(ladders.ARCHETYPES, repr(ladders.ARCHETYPE_DEFAULT))} as archetype
  from (select item_number, item_description, category_family, category_name, volume_tier, revenue_tier, total_units_sold, cast(total_revenue as double) as total_revenue, {_price_col}
  from lab where volume_tier = 'Tier 3: Zombie' and revenue_tier = 'Tier 2: Niche')"""
q["q21_full_scatter"] = BASE + TRAIL + f"""select item_number, item_description, coalesce(category_family, 'Other') as category_family,
    category_name, bottle_volume_ml, volume_tier, revenue_tier, total_units_sold, cast(total_revenue as double) as total_revenue, {_price_col},
    case when volume_tier = revenue_tier and volume_tier = 'Tier 1: Core' then 'Core / Core' when volume_tier = 'Tier 3: Zombie' and revenue_tier = 'Tier 1: Core' then 'Fragile Premium' when volume_tier = 'Tier 1: Core' and revenue_tier = 'Tier 3: Zombie' then 'High Volume / Low Revenue' when volume_tier = revenue_tier and volume_tier = 'Tier 3: Zombie' then 'Zombie / Zombie' else 'Other' end as scatter_group
  from lab where total_units_sold > 0 and total_revenue > 0"""
_win = "order_date >= date '2001-10-29' - interval 364 day and order_date < date '2001-10-30'"


def _prod(by, groups, market):
    return f"{groups} select {by}, cast(s as double) as total_sales, store_count, {_half_up("s", "store_count", 4)} as avg_sales_per_store, round(cast(s as double) / cast(({market}) as double), 6) as pct_of_market from g"


def _store_sums(col, missing):
    return f""", st as (select d.*, coalesce({col}, '{missing}') as grp from (select store_number, cast(sum(total_sales_dollars) as decimal(20,2)) as s
  from daily where {_win} group by 1) d left join stores using (store_number))"""


q["q22_chain_performance"] = BASE + _store_sums("chain", "UNKNOWN") + """, ch as (select grp, sum(s) as s, count(distinct store_number) as n from st
  group by 1), rk as (select *, row_number() over (order by s desc, grp) as r
  from ch)""" + _prod("chain_group", """, g as (select case when r <= 10 then grp else 'Other' end as chain_group, sum(s) as s, cast(sum(n) as bigint) as store_count
  from rk group by 1)""", "select sum(s) from st")
q["q23_channel_performance"] = BASE + _store_sums("store_channel", "Unknown") + _prod("store_channel", ", g as (select grp as store_channel, sum(s) as s, count(distinct store_number) as store_count from st group by 1)", "select sum(s) from st")

q["c1_top_n_plus_other"] = BASE + f""", d as (select category_name, {_sums('t12m', 't12m_prior')} from labelled group by 1), r as (select *,
    row_number() over (order by sales_t12m desc, category_name) as k
  from d), f as (select case when k <= 5 then category_name else 'Other' end as category_name, k > 5 as is_other, {_money('sales_t12m')},
    {_money('sales_t12m_prior')} from r group by 1, 2) select *, {_yoy('t12m')} from f"""


def _fold(by, units=True):
    """Vendors beyond rank 3 as one."""
    summed = ", cast(sum(units_t12m) as bigint) as units_t12m" if units else ""
    return f""", fold0 as (
  select case when vendor_rank <= 3 then vendor_rank else 4 end as vendor_rank,
    case when vendor_rank <= 3 then vendor_number else 'Other' end as vendor_number,
    case when vendor_rank <= 3 then vendor_name else 'Other Vendors' end as vendor_name,
    {by}, {_money('sales_t12m')}, {_money('sales_t12m_prior')}{summed}
  from mix where row_type = 'detail' group by 1, 2, 3, 4),
fold as (select *, {_yoy('t12m')} from fold0)"""


def _pivot(by, values):
    cents = lambda v: f"sum(case when {by} = '{v}' then cast(sales_t12m as decimal(20,2)) end)"
    columns = ", ".join(f'cast(coalesce({cents(v)}, 0) as double) as "{v}"' for v in values)
    return f" select vendor_rank, vendor_number, vendor_name, {columns} from fold group by 1, 2, 3"


_FOLD = _fold("price_position_segment")
_CATEGORY_MIX = f", mix as (with {q['q8_vendor_category_mix'].removeprefix(BASE + ', ')})"
_M10 = _mix("price_position_segment", _historic(grouped=True))
q["c2_top_vendors_plus_other"] = BASE + _M10 + _FOLD + " select * from fold"
_SEG = ["budget_standard", "premium_plus", "bulk_or_bundle", "trial_size", "other"]
q["c3_segment_pivot"] = BASE + _M10 + _FOLD + _pivot("price_position_segment", _SEG)
q["c2_category_vendors_plus_other"] = BASE + _CATEGORY_MIX + _fold("category_name", units=False) + " select * from fold"
q["c3_category_pivot"] = BASE + _CATEGORY_MIX + _fold("category_name", units=False) + _pivot("category_name", [f"LARGE CLASS {n}" for n in range(3)])
q["c4_vendor_totals"] = BASE + _M10 + _FOLD + f", v as (select vendor_rank, vendor_number, vendor_name, {_money('sales_t12m')}, cast(sum(units_t12m) as bigint) as units_t12m from fold group by 1, 2, 3) select *, {_half_up('sales_t12m', 'units_t12m', 2)} as avg_selling_price from v"
q["c5_chain_tail"] = BASE + f""", c as ({CHAINS}), r as (select *, upper(chain) = 'SMALL/IND CHAIN' as forced, row_number() over (partition by upper(chain) = 'SMALL/IND CHAIN'
  order by sales_t12m desc, chain) as k from c), f as (select case when not forced and k <= 4 then chain else 'Independent + Other' end as chain,
    {_money('sales_t12m')}, {_money('sales_t12m_prior')} from r group by 1) select *, {_yoy('t12m')} from f"""
q["c6_rolling_mean"] = BASE + _trend("category_family", FAMILY, 5) + """, lab as (select case when regexp_matches(vendor_name, 'LLC') then regexp_replace(vendor_name, 'VENDOR (\\d+) LLC', 'Vendor \\1 Llc') else regexp_replace(vendor_name, 'VENDOR', 'Vendor') end as vendor, sales_month, sales_dollars
  from trend), m as (select vendor, sales_month, cast(sum(cast(sales_dollars as decimal(20,2))) as double) as sales
  from lab group by 1, 2) select *, round(cast(sum(cast(sales as decimal(20,2))) over w as double) / count(*) over w, 4) as rolling_sales
  from m window w as (partition by vendor order by sales_month rows between 2 preceding and current row)"""
_ENDS = ", ends as (select * from share where period_order in ((select min(period_order) from share), (select max(period_order) from share)))"
q["c7_period_shares"] = BASE + SHARE + _ENDS + f""", r as (select *, row_number() over (partition by period_order order by sales_t12m desc, vendor_name, vendor_number) as k
  from ends), f as (select period_order, period_year, case when k <= 3 then vendor_name else 'Other' end as vendor_name, cast(case when k <= 3 then k else 4 end as int) as rank,
    {_money('sales_t12m')} from r group by 1, 2, 3, 4) select *, round(sales_t12m * 100 / cast(sum(cast(sales_t12m as decimal(20,2))) over (partition by period_order) as double), 4) as share_pct
  from f"""
q["c8_brand_cagr"] = BASE + SHARE + _ENDS + """, brands as (select * from (values ('First', 'VENDOR 1'), ('Limited', 'LLC'), ('Nobody', 'NO SUCH VENDOR')) v(brand, wanted)),
annual as (select brand, period_year, cast(sum(cast(sales_t12m as decimal(20,2))) as double) as s from ends join brands on contains(upper(vendor_name), wanted) group by 1, 2),
spans as (select brand, min(period_year) as first_year, max(period_year) as last_year, arg_min(s, period_year) as sales_first, arg_max(s, period_year) as sales_last from annual group by 1)
select brand, first_year, last_year, sales_first, sales_last,
  case when last_year > first_year and sales_first > 0 and sales_last > 0 then round((pow(sales_last / sales_first, 1.0 / (last_year - first_year)) - 1) * 100, 4) end as cagr_pct
from brands left join spans using (brand)"""
_T3 = ["Tier 1: Core", "Tier 2: Niche", "Tier 3: Zombie"]
q["c9_tier_grid"] = BASE + TRAIL + MATRIX + " select t.tier as volume_tier, " + ", ".join(f"cast(coalesce(sum(case when revenue_tier = '{t}' then cast(revenue as decimal(20,2)) end), 0) as double) as \"{t}\"" for t in _T3) + " from (values " + ", ".join(f"('{t}')" for t in _T3) + ") t(tier) left join matrix on matrix.volume_tier = t.tier group by 1"
for _name, _dimension in (("c10_family_tiers", "volume"), ("c10_family_tiers_revenue", "revenue")):
    q[_name] = BASE + TRAIL + BYFAM + f""", v as (select * from bf where dimension = '{_dimension}'), top as (select category_family, cast(sum(sku_count) as bigint) as skus
  from v group by 1 qualify row_number() over (order by sum(sku_count) desc, category_family) <= 4) select category_family, skus, """ + ", ".join(f"coalesce(max(case when tier = '{t}' then sku_share end), 0) as \"{t}\"" for t in _T3) + " from top join v using (category_family) group by 1, 2"
q["c11_family_cagr"] = BASE + GROWTH1 + f""" select *, {_yoys}, case when sales_cagr_start_year > 0 and sales_cagr_end_year > 0 then round((pow(sales_cagr_end_year / sales_cagr_start_year,
    0.5) - 1) * 100, 4) end as cagr_pct
  from both_"""

q["o1_chain_growth_ordered"] = q["q7_chain_growth"] + " order by case row_type when 'detail' then 0 else 1 end, sales_t12m desc nulls last, chain"
q["p26_vendor_labels"] = BASE + "select replace(replace(vendor_name, 'VENDOR', 'Vendor'), 'LLC', 'Llc') as vendor, count(*) as n_items from items group by 1"
q["p27_bottle_labels"] = BASE + TRAIL + f""", scatter as ({q['q21_full_scatter'].removeprefix(BASE + TRAIL)})
select scatter_group, case when bottle_volume_ml is null then 'Other' when bottle_volume_ml = 1000 then '1L' when bottle_volume_ml = 1750 then '1.75L' else cast(bottle_volume_ml as varchar) || 'ml' end as size_label,
  count(*) as sku_count from scatter group by 1, 2"""

_fail = lambda name, rows, ctes="": BASE + ctes + f"select '{name}' as name, count(*) as n_fail from ({rows}) x"
for _name, _rows, *_ctes in (
    ("t1_not_null", "select 1 from items where item_description is null"),
    ("t2_unique", "select invoice_item_number from sales group by 1 having count(*) > 1"),
    ("t3_accepted_values", "select category_family from items group by 1 having category_family not in ('Whiskies', 'Rum', 'Gin')"),
    ("t4_relationships", "select 1 from ded where category not in ('" + _ECON + "')"),
    ("t6_history_coverage", "select distinct f.item_number from ded f where not exists (select 1 from hist h where h.item_number = f.item_number)"),
    ("t6b_uncovered_lines", "select 1 from ded f where not exists (select 1 from hist h where h.item_number = f.item_number and f.order_date >= h.business_valid_from and (h.business_valid_to is null or f.order_date <= h.business_valid_to))"),
    ("t7_reconciliation", """select 1 from (
  select order_date, store_number, sum(bottles_sold) as b, sum(sale_dollars) as s, sum(volume_sold_liters) as l, sum(volume_sold_gallons) as g,
    sum(estimated_total_cost) as c, sum(estimated_gross_profit) as p, count(*) as n from sales group by 1, 2) a
full join daily d using (order_date, store_number)
where coalesce(b, 0) <> coalesce(total_bottles_sold, 0) or coalesce(s, 0) <> coalesce(total_sales_dollars, 0) or coalesce(l, 0) <> coalesce(total_volume_sold_liters, 0)
  or coalesce(g, 0) <> coalesce(total_volume_sold_gallons, 0) or coalesce(c, 0) <> coalesce(total_estimated_cost, 0)
  or coalesce(p, 0) <> coalesce(total_estimated_gross_profit, 0) or coalesce(n, 0) <> coalesce(invoice_line_count, 0)"""),
    ("t7b_reconciled_days", """select 1 from (
  select order_date, store_number, sum(bottles_sold) as b, sum(sale_dollars) as s, sum(volume_sold_liters) as l, sum(volume_sold_gallons) as g,
    sum(estimated_total_cost) as c, sum(estimated_gross_profit) as p, count(*) as n from ded where loaded_at < timestamp '2000-01-01' group by 1, 2) a
full join daily d using (order_date, store_number)
where coalesce(b, 0) <> coalesce(total_bottles_sold, 0) or coalesce(s, 0) <> coalesce(total_sales_dollars, 0) or coalesce(l, 0) <> coalesce(total_volume_sold_liters, 0)
  or coalesce(g, 0) <> coalesce(total_volume_sold_gallons, 0) or coalesce(c, 0) <> coalesce(total_estimated_cost, 0)
  or coalesce(p, 0) <> coalesce(total_estimated_gross_profit, 0) or coalesce(n, 0) <> coalesce(invoice_line_count, 0)"""),
    ("t8_composite_key", "select item_number, order_date from ded group by 1, 2 having count(*) > 1"),
    ("t9_overlaps", "select 1 from hist a where exists (select 1 from hist b where a.item_number = b.item_number and b.business_valid_from < a.business_valid_from and coalesce(b.business_valid_to, date '9999-12-31') >= a.business_valid_from)"),
    ("t10_one_current", "select item_number from hist group by 1 having sum(case when is_current then 1 else 0 end) <> 1"),
    ("t11_negative_sales", "select 1 from ded where (sale_dollars < 0 or bottles_sold < 0 or volume_sold_liters < 0 or volume_sold_gallons < 0) and upper(invoice_item_number) not like 'RINV-%'"),
    ("t12_days_lost", "select distinct order_date from sales where order_date not in (select order_date from ded where not is_return)"),
    ("t13_retail_below_cost", "select 1 from sales where state_bottle_retail is not null and state_bottle_cost is not null and state_bottle_retail < state_bottle_cost"),
    ("t14_negative_velocity", "select 1 from cls where total_units_sold < 0 or total_revenue < 0", MART),
    ("t15_share_bounds", "select 1 from cls where cumulative_units_pct < 0 or cumulative_units_pct > 1 or cumulative_revenue_pct < 0 or cumulative_revenue_pct > 1", MART),
    ("t16_negative_shipment", "select 1 from fc where recommended_ship_qty < 0", WEEKLY),
):
    q[_name] = _fail(_name, _rows, *_ctes)
q["t5_freshness"] = BASE + """select max(loaded_at) as newest, cast(date_diff('day', cast(max(loaded_at) as date), date '2002-01-01') as int) as lag_days, case when date_diff('day', cast(max(loaded_at) as date), date '2002-01-01') > 14 then 'ERROR' when date_diff('day', cast(max(loaded_at) as date), date '2002-01-01') > 7 then 'WARN' else 'PASS' end as status
  from sales"""
q["t17_critical_suite"] = BASE + """select name, severity, tag, n_fail, case when n_fail = 0 then 'pass' else severity end as status
  from (select 'unique_invoice' as name, 'error' as severity, 'critical' as tag, (select count(*)
  from (select invoice_item_number from ded group by 1 having count(*) > 1)) as n_fail
  union all select 'unique_raw_invoice', 'warn', 'critical,raw', (select count(*)
  from (select invoice_item_number from sales group by 1 having count(*) > 1)))"""

_d = lambda c: f"cast(date_diff('day', cast({c} as date), date '2002-01-01') as int)"
_st = lambda e: f"case when {e} > 14 then 'ERROR' when {e} > 7 then 'WARN' else 'PASS' end"
q["h1_pipeline_health"] = BASE + SNAP_ITEM + SNAP_STORE + MART + WEEKLY + f""", h as (select timestamp '2002-01-01' as observed_at, (select max(loaded_at) from sales) as raw_max_loaded_at, (select count(*) from sales) as raw_row_count,
(select count(*) from item_snap where dbt_valid_to is null) as snap_item_current_row_count, (select max(dbt_valid_from) from item_snap) as snap_item_max_valid_from,
    (select count(*) from store_snap where dbt_valid_to is null) as snap_store_current_row_count, (select max(dbt_valid_from) from store_snap) as snap_store_max_valid_from,
(select count(*) from ded) as fact_row_count, (select min(order_date) from ded) as fact_min_order_date, (select max(order_date) from ded) as fact_max_order_date,
    (select count(*) from daily) as daily_store_day_count, (select min(order_date) from daily) as daily_min_order_date, (select max(order_date) from daily) as daily_max_order_date,
(select count(*) from base) as sku_velocity_row_count, (select count(*) from fc) as replenishment_forecast_row_count)
select *, {_d("raw_max_loaded_at")} as raw_lag_days, greatest({_d("snap_item_max_valid_from")}, {_d("snap_store_max_valid_from")}) as snapshot_lag_days,
    {_st(_d("raw_max_loaded_at"))} as freshness_status, {_st(f"greatest({_d('snap_item_max_valid_from')}, {_d('snap_store_max_valid_from')})")} as snapshot_status from h"""
q["h2_landed_window"] = BASE + """select *, case when row_count = 0 then 'empty' when max_loaded_at is null then 'no_load_time' when lag_hours > 24 then 'stale' else 'ok' end as contract
  from (select count(*) as row_count, min(order_date) as min_order_date, max(order_date) as max_order_date, max(loaded_at) as max_loaded_at, date_diff('hour', max(loaded_at), timestamp '2002-01-01') as lag_hours
  from sales where order_date between date '1999-06-01' and date '1999-06-28')"""
q["h3_run_status"] = RUNS + f"""select {_RUN}, final_dag_state = 'failed' as is_failed, final_dag_state = 'degraded' as is_degraded, freshness_status = 'WARN' or snapshot_status = 'WARN' as has_warn
  from runs"""
q["h4_final_states"] = """
with tasks as (select strftime(ts, '%Y-%m-%d') || '/' || cast(user_id as varchar) as run_id, event_type = 'error' as failed, event_type = 'signup' as warned from events)
select run_id, case when bool_or(failed) then 'failed' when bool_or(warned) then 'degraded' else 'success' end as final_dag_state from tasks group by 1"""
q["h5a_recent_failed"] = RUNS + f"select {_RUN} from runs where final_dag_state = 'failed' order by created_at desc, run_id limit 20"
q["h5b_duration_by_source"] = RUNS + "select source, count(*) as runs, round(cast(sum(duration_seconds) as double) / count(*), 4) as avg_duration_seconds from runs where final_dag_state = 'success' group by 1"
q["h5c_success_rate"] = RUNS + """select source, count(*) as runs, cast(sum(case when final_dag_state = 'success' then 1 else 0 end) as bigint) as successes, round(100.0 * sum(case when final_dag_state = 'success' then 1 else 0 end) / count(*), 2) as success_rate_pct
  from runs where created_at >= date '2024-01-30' - 10 group by 1"""
q["h5d_troubled_runs"] = f"select * from ({q['h3_run_status']}) where is_degraded or has_warn order by created_at desc, run_id limit 20"

# declared checks, one plain count each
_SEED = ", ".join(f"('{k}-{n}', '{k} CLASS {n}', '{f}')" for k, f in (("ECONOMY", "Vodkas"), ("STANDARD", "Rum"), ("MEDIUM", "Tequilas"), ("LARGE", "Whiskies"), ("PROMO", "Gin")) for n in range(3))
_CHECKED = {
    "category_family_map": f"(from (values {_SEED}) v(category, category_name, category_family))", "staged_sales": "sales", "deduped_sales": "ded", "stores_current": "stores", "item_history": "hist",
    "anomalous_returns": f"(select invoice_item_number, 'positive_return' as anomaly from ded where is_return and ({_any('>')}))", "unlabeled_negatives": f"(select invoice_item_number, 'unlabeled_negative' as anomaly from ded where not is_return and ({_any('<')}))",
    "priced_history": "priced", "weekly_depletions": "weekly", "rolling_metrics": "roll", "baseline_forecast": "fc", "velocity_base": "base", "velocity_ranked": "ranked", "velocity_classified": "cls", "pipeline_health": "health",
    "dim_store": "(from store_snap where dbt_valid_to is null)", "dim_item": "(from item_snap where dbt_valid_to is null)", "dim_item_history": "priced", "fact_sales": "ded", "store_daily_sales": "daily", "sku_velocity": "lab", "replenishment_forecast": "fc",
}


def _declared_sql(checks):
    health = ", health as (" + q["h1_pipeline_health"].split(WEEKLY)[1].replace(", h as (", "with h as (", 1) + ")"
    parts = []
    for c in checks:
        table, column = _CHECKED[c.table], c.column
        if c.rule == "not_null":
            count = f"select count(*) from {table} where {column} is null"
        elif c.rule == "unique":
            count = f"select count(*) from (select {column} from {table} where {column} is not null group by 1 having count(*) > 1)"
        elif c.rule == "accepted_values":
            values = ", ".join(f"'{_Q(v)}'" for v in c.values)
            count = f"select count(distinct {column}) from {table} where {column} not in ({values})"
        else:
            count = f"select count(*) from {table} where {column} is not null and {column} not in (select {c.parent[1]} from {_CHECKED[c.parent[0]]})"
        parts.append(f"select '{c.table}' as table_name, '{column}' as column_name, '{c.rule}' as rule, '{c.severity}' as severity, '{','.join(c.tags)}' as tag, ({count}) as n_fail")
    return BASE + SNAP_ITEM + SNAP_STORE + MART + WEEKLY + health + " select *, case when n_fail = 0 then 'pass' else severity end as status from (" + "\nunion all ".join(parts) + ")"


q["t18_declared_checks"] = _declared_sql(DECLARED)
q["t18_critical_checks"] = _declared_sql([c for c in DECLARED if "critical" in c.tags])

ORACLE_SQL = q
