"""Every query of the engine and its SQL, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import measures
from tallyhouse.functions.lasting import shared_folder
from tallyhouse.operators import checks, growth, history, mix, monitoring, quality, replenishment, shape, staging, stores, velocity
from tallyhouse.plans.declared import DECLARED
from tallyhouse.plans.model import AS_OF, BATCH, CATEGORY, DAY, FAMILY, MONTH, WINDOW, Model, staged_sales
from tallyhouse.plans.oracle import ORACLE_SQL
from tallyhouse.sources import landing, months, rejects

QUERIES: dict[str, Callable] = {}
_LINES = ["invoice_item_number", "order_date", "store_number", "item_number", "sale_dollars", "loaded_at", "anomaly"]
_TIERS = [velocity.CORE, velocity.NICHE, velocity.ZOMBIE]
_SEGMENTS = ["budget_standard", "premium_plus", "bulk_or_bundle", "trial_size", "other"]
_CATEGORIES = ["LARGE CLASS 0", "LARGE CLASS 1", "LARGE CLASS 2"]
_BRANDS = [("First", "vendor 1"), ("Limited", "llc"), ("Nobody", "no such vendor")]
_TREND = (date(2000, 1, 1), MONTH)


# The columns that each report is printed by, after its kinds of rows; -column is descending.
ORDERS = {
    "q1_family_growth": ("-sales_t12m", "category_family"),
    "q2_family_drilldown": ("-sales_t12m",),
    "q3_vendor_volume_growth": ("-sales_t12m", "vendor_number", "bottle_volume_ml"),
    "q4_family_vendor_growth": ("-sales_t12m", "vendor_number"),
    "q5_category_item_growth": ("-sales_t12m", "vendor_name", "item_description"),
    "q6_family_item_growth": ("-sales_t12m", "vendor_name", "item_description"),
    "q7_chain_growth": ("-sales_t12m", "chain"),
    "q8_vendor_category_mix": ("vendor_rank", "-sales_t12m", "category_name"),
    "q9_price_segment_mix": ("vendor_rank", "-sales_t12m", "price_position_segment"),
    "q10_grouped_segment_mix": ("vendor_rank", "-sales_t12m", "price_position_segment"),
    "q11_segment_mix_compare": ("-period_order", "vendor_rank", "-sales_t12m", "price_position_segment"),
    "q12_store_channel_mix": ("vendor_rank", "-sales_t12m", "store_channel"),
    "q13_channel_mix_compare": ("-period_order", "vendor_rank", "-sales_t12m", "store_channel"),
    "q14_vendor_share": ("period_order", "-sales_t12m", "vendor_name", "vendor_number"),
    "q15_family_vendor_trend": ("sales_month", "vendor_rank", "-sales_dollars"),
    "q16_category_vendor_trend": ("sales_month", "vendor_rank", "-sales_dollars"),
    "q17_sku_tier_summary": ("dimension", "tier"),
    "q18_sku_tier_matrix": ("volume_tier", "revenue_tier"),
    "q19_tier_by_family": ("dimension", "category_family", "tier"),
    "q20_divergent_skus": ("-total_revenue",),
    "q21_full_scatter": ("scatter_group", "-total_revenue"),
    "q22_chain_performance": ("-total_sales",),
    "q23_channel_performance": ("-total_sales",),
}


def printed(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in the order in which it is printed."""
    return shape.ordered(QUERIES[name](spark, sf_dir), *ORDERS[name])


def _add(name: str, build: Callable[[Model], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Model(spark, sf_dir))


def _early(m: Model) -> DataFrame:
    return m.fact.filter(F.col("loaded_at") < F.lit(BATCH).cast("timestamp_ntz"))


def _replaced_window(m: Model) -> DataFrame:
    """The landed table after an append of the loads before BATCH and a load of WINDOW anew from all loads, both run at once;
    its files stay until the application ends. Lines are dealt out by day before their texts are made, while they are narrow."""
    raw = lambda lines: staged_sales(lines).select(*(F.col("order_date" if c == "date" else c).alias(c) for c in landing.FIELDS), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"))
    path = f"{shared_folder(m.spark)}/landed-{uuid.uuid4().hex}"
    early = m.raw_lines.filter(F.col("o_orderdate") < F.lit(BATCH).cast("timestamp_ntz"))
    landing.append_raw(raw(early.hint("rebalance", "l_shipdate")), path, dealt=True)
    landing.replace_landed_window(raw(m.raw_lines.filter(F.col("l_shipdate").between(*map(F.lit, WINDOW)))), path, *WINDOW)
    return landing.read_raw(m.spark, path).select(*rejects.SHOWN, "loaded_at")


def _seed_families(m: Model) -> DataFrame:
    """Sales by the seed's families: an item stands for the seed's category of its number modulo 60, which has no category for the last three."""
    seed = landing.category_families(m.spark)
    codes = F.array(*(F.lit(r.category) for r in seed.select("category").orderBy("category").collect()))  # the seed's 57
    lines = m.fact.select(F.get(codes, F.col("item_number").cast("int") % 60).alias("category"), "sale_dollars")
    return history.category_family(lines, seed).groupBy("category_family").agg(F.count("*").alias("n_lines"), F.sum("sale_dollars").cast("double").alias("sales"))


def _updated_history(m: Model) -> DataFrame:
    """The history of the loads before BATCH, brought up to date with the later ones."""
    later = F.coalesce(F.col("loaded_at") >= F.lit(BATCH).cast("timestamp_ntz"), F.lit(True))
    touched = history.touched_items(m.staged(m.early_kept), m.sales.filter(later))
    return history.update_history(m.early_history, m.by_item, touched)


def _grouped(m: Model) -> DataFrame:
    return mix.vendor_mix(mix.historic_lines(m.fact, m.priced, FAMILY, grouped=True), "price_position_segment", MONTH)


def _categories(m: Model) -> DataFrame:
    return growth.vendor_category_mix(m.monthly, m.items, MONTH, FAMILY)


def _channels(m: Model, windows=None) -> DataFrame:
    return mix.with_channel(mix.historic_lines(m.fact, m.priced, FAMILY, windows=windows), m.stores)


def _labelled(m: Model) -> DataFrame:
    return velocity.with_item_labels(m.window_classified, m.items)


def _chains(m: Model) -> DataFrame:
    return growth.chain_growth(m.monthly, m.items, m.stores, MONTH, CATEGORY)


_add("s1_landed", lambda m: rejects.landed(m.payload))
_add("s1_rejected", lambda m: rejects.rejected(m.payload))
_add("s4_replaced_window", _replaced_window)
_add("s6_seed_families", _seed_families)
_add("m2_enriched_sales", lambda m: m.sales.select("invoice_item_number", "tie_supp", "gross_profit_per_bottle", "estimated_total_cost", "estimated_gross_profit", "revenue_per_bottle"))
_add("m3_deduped_sales", lambda m: m.whole_deduped.drop("revenue_per_bottle", "revenue_per_liter"))
_add("m3a_duplicate_audit", lambda m: staging.audited(m.repeated))
_add("m3b_anomalous_returns", lambda m: staging.anomalous_returns(m.deduped).select(_LINES))
_add("m3c_unlabeled_negatives", lambda m: staging.unlabeled_negative_returns(m.deduped).select(_LINES))
_add("m4_item_history", lambda m: m.history)
_add("m4_updated_history", _updated_history)
_add("m4b_dim_item_history", lambda m: m.priced)
_add("m4c_items_current", lambda m: m.items)
_add("m4d_stores_current", lambda m: m.stores)
_add("m5_item_snapshot", lambda m: m.snapshots("item"))
_add("m5_store_snapshot", lambda m: m.snapshots("store"))
_add("m5a_dim_item", lambda m: history.current_rows(m.snapshots("item")))
_add("m5a_dim_store", lambda m: history.current_rows(m.snapshots("store")))
_add("m5b_asof_snapshot", lambda m: history.asof(m.fact.select("invoice_item_number", "item_number", "order_date"), m.snapshots("item").select("item_number", "item_description", "dbt_valid_from", "dbt_valid_to"), "item_number", "order_date", "dbt_valid_from", "dbt_valid_to", closed=False).select("invoice_item_number", "order_date", "item_description", "dbt_valid_from"))
_add("m6_merge", lambda m: history.merge_incremental(_early(m), m.fact).drop(months.MONTH))
_add("m7_replace_window", lambda m: history.replace_window(_early(m), m.fact.filter(F.col("order_date").between(*map(F.lit, WINDOW))), *WINDOW).drop(months.MONTH))
_add("m8_store_daily_sales", lambda m: m.daily.drop(months.MONTH))
_add("m9_velocity_base", lambda m: m.velocity)
_add("m9a_velocity_ranked", lambda m: velocity.velocity_ranked(m.velocity))
_add("m9b_velocity_classified", lambda m: m.classified)
_add("m9c_sku_velocity", lambda m: m.sku_velocity)
_add("m10_weekly_depletions", lambda m: m.weekly)
_add("m10a_rolling_metrics", lambda m: replenishment.rolling_metrics(m.weekly))
_add("m10b_baseline_forecast", lambda m: m.forecast)
_add("m10c_replenishment_forecast", lambda m: replenishment.replenishment_forecast(m.forecast, m.items))
_add("m11_fact_sales", lambda m: m.fact.drop(months.MONTH))
_add("m12_category_family", lambda m: history.category_family(m.fact.select("category"), m.families).groupBy("category", "category_family").agg(F.count("*").alias("n")))

_add("q1_family_growth", lambda m: growth.family_growth(m.monthly, m.items, MONTH))
_add("q2_family_drilldown", lambda m: growth.family_drilldown(m.monthly, m.items, MONTH, FAMILY))
_add("q3_vendor_volume_growth", lambda m: growth.vendor_volume_growth(m.monthly, m.items, MONTH, CATEGORY, " 1, 002,3 ", "all"))
_add("q4_family_vendor_growth", lambda m: growth.family_vendor_growth(m.monthly, m.items, MONTH, FAMILY))
_add("q5_category_item_growth", lambda m: growth.item_growth(m.monthly, m.items, MONTH, "category_name", CATEGORY, ["001", "4"]))
_add("q6_family_item_growth", lambda m: growth.item_growth(m.monthly, m.items, MONTH, "category_family", FAMILY))
_add("q7_chain_growth", _chains)
_add("q8_vendor_category_mix", _categories)
_add("q9_price_segment_mix", lambda m: mix.vendor_mix(mix.historic_lines(m.fact, m.priced, FAMILY), "price_position_segment", MONTH))
_add("q9_price_segment_mix_standard", lambda m: mix.vendor_mix(mix.historic_lines(m.fact, m.priced, FAMILY, "standard"), "price_position_segment", MONTH))
_add("q10_grouped_segment_mix", _grouped)
_add("q11_segment_mix_compare", lambda m: mix.vendor_mix_compare(mix.historic_lines(m.fact, m.priced, FAMILY, grouped=True, windows=mix.compared(MONTH)), "price_position_segment", MONTH))
_add("q12_store_channel_mix", lambda m: mix.vendor_mix(_channels(m), "store_channel", MONTH))
_add("q13_channel_mix_compare", lambda m: mix.vendor_mix_compare(_channels(m, mix.compared(MONTH)), "store_channel", MONTH))
_add("q14_vendor_share", lambda m: growth.vendor_share_by_year(m.monthly, m.items, MONTH, FAMILY))
_add("q15_family_vendor_trend", lambda m: growth.vendor_monthly_trend(m.monthly, m.items, *_TREND, "category_family", FAMILY))
_add("q16_category_vendor_trend", lambda m: growth.vendor_monthly_trend(m.monthly, m.items, *_TREND, "category_name", CATEGORY, 3))
_add("q17_sku_tier_summary", lambda m: velocity.tier_summary(m.window_classified))
_add("q18_sku_tier_matrix", lambda m: velocity.tier_matrix(m.window_classified))
_add("q19_tier_by_family", lambda m: velocity.tier_by_family(_labelled(m)))
_add("q20_divergent_skus", lambda m: velocity.divergent_skus(_labelled(m), velocity.ZOMBIE, velocity.NICHE))
_add("q21_full_scatter", lambda m: velocity.full_scatter(_labelled(m)))
_add("q22_chain_performance", lambda m: stores.chain_performance(m.daily, m.stores, DAY))
_add("q23_channel_performance", lambda m: stores.channel_performance(m.daily, m.stores, DAY))

_add("c1_top_n_plus_other", lambda m: shape.top_n_plus_other(growth.labelled_lines(m.monthly, m.items).groupBy("category_name").agg(*growth.period_sums({n: w for n, w in growth.period_bounds(MONTH).items() if n.startswith("t12m")})), "category_name", 5))
_add("c2_top_vendors_plus_other", lambda m: shape.top_vendors_plus_other(_grouped(m), "price_position_segment", 3))
_add("c3_segment_pivot", lambda m: shape.pivot_mix(shape.top_vendors_plus_other(_grouped(m), "price_position_segment", 3), shape.VENDOR, "price_position_segment", _SEGMENTS))
_add("c2_category_vendors_plus_other", lambda m: shape.top_vendors_plus_other(_categories(m), "category_name", 3))
_add("c3_category_pivot", lambda m: shape.pivot_mix(shape.top_vendors_plus_other(_categories(m), "category_name", 3), shape.VENDOR, "category_name", _CATEGORIES))
_add("c4_vendor_totals", lambda m: shape.vendor_totals(shape.top_vendors_plus_other(_grouped(m), "price_position_segment", 3)))
_add("c5_chain_tail", lambda m: shape.chains_with_tail(_chains(m).filter("row_type = 'detail'"), 4, "Small/Ind Chain"))
_add("c6_rolling_mean", lambda m: shape.rolling_mean(growth.vendor_monthly_trend(m.monthly, m.items, *_TREND, "category_family", FAMILY)))
_add("c7_period_shares", lambda m: shape.period_shares(growth.vendor_share_by_year(m.monthly, m.items, MONTH, FAMILY), 3))
_add("c8_brand_cagr", lambda m: shape.brand_cagr(growth.vendor_share_by_year(m.monthly, m.items, MONTH, FAMILY), _BRANDS))
_add("c9_tier_grid", lambda m: shape.tier_grid(velocity.tier_matrix(m.window_classified), _TIERS, "revenue"))
_add("c10_family_tiers", lambda m: shape.family_tiers(velocity.tier_by_family(_labelled(m)), _TIERS, 4))
_add("c10_family_tiers_revenue", lambda m: shape.family_tiers(velocity.tier_by_family(_labelled(m)), _TIERS, 4, "revenue"))
_add("c11_family_cagr", lambda m: growth.with_cagr(growth.family_growth(m.monthly, m.items, MONTH), 2))
_add("p26_vendor_labels", lambda m: m.items.groupBy(measures.vendor_label(F.col("vendor_name")).alias("vendor")).agg(F.count("*").alias("n_items")))
_add("p27_bottle_labels", lambda m: velocity.full_scatter(_labelled(m)).groupBy("scatter_group", measures.bottle_label(F.col("bottle_volume_ml")).alias("size_label")).agg(F.count("*").alias("sku_count")))
_add("o1_chain_growth_ordered", lambda m: shape.ordered(_chains(m), *ORDERS["q7_chain_growth"]))


def _check(name: str, rows: Callable[[Model], DataFrame]) -> None:
    _add(name, lambda m: rows(m).agg(F.count("*").alias("n_fail")).select(F.lit(name).alias("name"), "n_fail"))


_check("t1_not_null", lambda m: quality.not_null(m.items, "item_description"))
_check("t2_unique", lambda m: quality.unique(m.sales, "invoice_item_number"))
_check("t3_accepted_values", lambda m: quality.accepted_values(m.items, "category_family", ["Whiskies", "Rum", "Gin"]))
_check("t4_relationships", lambda m: quality.relationships(m.fact, "category", m.families, "category"))
_check("t6_history_coverage", lambda m: quality.history_coverage(m.fact, m.history))
_check("t6b_uncovered_lines", lambda m: quality.uncovered_lines(m.fact, m.history))
_check("t7_reconciliation", lambda m: quality.reconcile(m.daily_of_all, m.daily, ["order_date", "store_number"], staging.DAILY))
_check("t7b_reconciled_days", lambda m: quality.reconcile_days(staging.store_daily_sales(_early(m)), m.daily, "order_date", ["store_number"], staging.DAILY))
_check("t8_composite_key", lambda m: quality.unique(m.fact, "item_number", "order_date"))
_check("t9_overlaps", lambda m: quality.overlapping_windows(m.history))
_check("t10_one_current", lambda m: quality.one_current_row(m.history))
_check("t11_negative_sales", lambda m: quality.negative_only_on_returns(m.deduped))
_check("t12_days_lost", lambda m: quality.days_lost(m.sales, m.deduped.filter("not is_return")))
_check("t13_retail_below_cost", lambda m: quality.retail_below_cost(m.sales))
_check("t14_negative_velocity", lambda m: quality.negative_velocity(m.classified))
_check("t15_share_bounds", lambda m: quality.share_out_of_bounds(m.classified))
_check("t16_negative_shipment", lambda m: quality.negative_shipment(m.forecast))
_add("t5_freshness", lambda m: quality.freshness(m.sales, "loaded_at", AS_OF))
_add("t17_critical_suite", lambda m: quality.run_suite([quality.Check("unique_invoice", quality.unique(m.fact, "invoice_item_number"), "error", ["critical"]), quality.Check("unique_raw_invoice", quality.unique(m.sales, "invoice_item_number"), "warn", ["critical", "raw"]), quality.Check("retail", quality.retail_below_cost(m.sales), "warn", [])], ["critical"]))

_add("t18_declared_checks", lambda m: checks.run_declared(m.tables(), DECLARED))
_add("t18_critical_checks", lambda m: checks.run_declared(m.tables(*checks.named(DECLARED, ["critical"])), DECLARED, ["critical"]))
_add("h1_pipeline_health", lambda m: m.health)
_add("h2_landed_window", lambda m: monitoring.landed_window_contract(m.sales, *WINDOW, AS_OF))
_add("h3_run_status", lambda m: monitoring.run_status(m.runs))
_add("h4_final_states", lambda m: monitoring.final_states(m.tasks))
_add("h5a_recent_failed", lambda m: monitoring.recent_runs(m.runs, 20, "failed"))
_add("h5b_duration_by_source", lambda m: monitoring.duration_by_source(m.runs))
_add("h5d_troubled_runs", lambda m: monitoring.troubled_runs(m.runs))
_add("h5c_success_rate", lambda m: monitoring.success_rate(m.runs, datetime(2024, 1, 30), 10))

__all__ = ["ORACLE_SQL", "ORDERS", "QUERIES", "printed"]
