"""The column checks that are declared on the models."""

from __future__ import annotations

from tallyhouse.operators.checks import Declared
from tallyhouse.operators.velocity import CORE, NICHE, ZOMBIE

# The values that columns may hold.
FAMILIES = ("Whiskies", "Tequilas", "Vodkas", "Brandies", "Rum", "Gin", "Liqueurs", "RTD/Cocktails", "Specialty/Other Spirits", "Other")
SIZES = ("unknown", "micro_trial", "mini_trial", "large_trial", "half_size", "standard", "jumbo_value")
PRICES = ("unknown", "bundle_unknown", "0_to_2", "2_to_4", "4_to_6", "6_to_8", "8_to_12", "12_to_20", "20_plus")
SEGMENTS = ("unknown", "bundle_pack", "trial_value", "trial_premium", "trial_luxury", "high_volume", "budget", "standard", "other", "premium", "premium_bulk", "super_premium", "ultra_premium", "luxury", "icon_collectible", "value_oversized")
TIERS = (CORE, NICHE, ZOMBIE)
STATES = ("PASS", "WARN", "ERROR")

#: By table: columns that are never null, columns that are unique as well, accepted values, parents, columns whose checks are critical.
_TABLES: dict[str, tuple] = {
    "category_family_map": (["category_name", "category_family"], ["category"], {"category_family": FAMILIES}, {}, []),
    "staged_sales": (["invoice_item_number", "order_date", "store_number", "item_number", "sale_dollars", "bottles_sold"], [], {}, {}, []),
    "deduped_sales": (["loaded_at"], ["invoice_item_number"], {}, {}, []),
    "anomalous_returns": (["anomaly"], ["invoice_item_number"], {"anomaly": ("positive_return",)}, {}, []),
    "unlabeled_negatives": (["anomaly"], ["invoice_item_number"], {"anomaly": ("unlabeled_negative",)}, {}, []),
    "stores_current": (["chain", "store_channel"], ["store_number"], {}, {}, []),
    "item_history": (["item_number", "business_valid_from"], [], {}, {}, []),
    "priced_history": (["item_number", "business_valid_from"], [], {}, {}, []),
    "weekly_depletions": (["item_number", "week_start", "weekly_units_sold"], [], {}, {}, []),
    "rolling_metrics": (["trailing_4wk_avg_units", "trailing_8wk_avg_units"], ["item_number"], {}, {}, []),
    "baseline_forecast": (["selected_baseline_units", "recommended_ship_qty"], ["item_number"], {}, {}, []),
    "velocity_base": (["total_units_sold", "total_revenue"], ["item_number"], {}, {}, []),
    "velocity_ranked": (["cumulative_units", "cumulative_revenue", "state_units", "state_revenue"], ["item_number"], {}, {}, []),
    "velocity_classified": (["cumulative_units_pct", "cumulative_revenue_pct", "volume_tier", "revenue_tier"], ["item_number"], {"volume_tier": TIERS, "revenue_tier": TIERS}, {}, []),
    "pipeline_health": (["observed_at", "freshness_status", "snapshot_status"], [], {"freshness_status": STATES, "snapshot_status": STATES}, {}, []),
    "dim_store": ([], ["store_number"], {}, {}, ["store_number"]),
    "dim_item": (["category_family"], ["item_number"], {"category_family": FAMILIES}, {}, ["item_number"]),
    "dim_item_history": (
        ["item_number", "category_family", "business_valid_from", "is_bundle_pack", "package_size_tier", "retail_price_tier", "price_per_100ml_tier", "price_position_segment"], [],
        {"category_family": FAMILIES, "package_size_tier": SIZES, "price_per_100ml_tier": PRICES, "price_position_segment": SEGMENTS}, {}, [],
    ),
    "fact_sales": (["store_number", "item_number"], ["invoice_item_number"], {}, {"store_number": "dim_store", "item_number": "dim_item"}, ["invoice_item_number"]),
    "store_daily_sales": (["order_date", "store_number"], [], {}, {"store_number": "dim_store"}, ["order_date", "store_number"]),
    "sku_velocity": (["volume_tier", "revenue_tier", "cumulative_units_pct", "cumulative_revenue_pct"], ["item_number"], {"volume_tier": TIERS, "revenue_tier": TIERS}, {}, []),
    "replenishment_forecast": (["trailing_4wk_avg_units", "trailing_8wk_avg_units", "selected_baseline_units", "recommended_ship_qty"], ["item_number"], {}, {"item_number": "dim_item"}, []),
}


def _declared() -> list[Declared]:
    out = []
    for table, (filled, unique, accepted, parents, critical) in _TABLES.items():
        tags = lambda column: ("critical",) if column in critical else ()  # noqa: B023, E731
        out += [Declared(table, c, "not_null", tags=tags(c)) for c in [*unique, *filled]]
        out += [Declared(table, c, "unique", tags=tags(c)) for c in unique]
        out += [Declared(table, c, "accepted_values", values) for c, values in accepted.items()]
        out += [Declared(table, c, "relationships", parent=(parent, c)) for c, parent in parents.items()]
    return out


DECLARED = _declared()
