"""Ordered rule ladders: the first rule that holds names the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of upper-cased store names, in the order in which they apply.
CHAIN_RULES = [
    ("%HY-VEE%", "HY-VEE"),
    ("%FAREWAY%", "FAREWAY"),
    ("%PRICE CHOPPER%", "PRICE CHOPPER"),
    ("%CASH SAVER%", "CASH SAVER"),
    ("%SAM'S CLUB%", "SAM'S CLUB"),
    ("%COSTCO%", "COSTCO"),
    ("%WALMART%", "WALMART"),
    ("%WAL-MART%", "WALMART"),
    ("%TARGET%", "TARGET"),
    ("%WALGREENS%", "WALGREENS"),
    ("%CVS%", "CVS"),
    ("%HARTIG DRUG%", "HARTIG DRUG"),
    ("%CASEY%", "CASEY'S"),
    ("%KWIK STAR%", "KWIK STAR"),
    ("%KUM & GO%", "KUM & GO"),
    ("%QUIK TRIP%", "QUIK TRIP"),
    ("%CIRCLE K%", "CIRCLE K"),
    ("%YESWAY%", "YESWAY"),
    ("%KWIK SHOP%", "KWIK SHOP"),
    ("%MAVERIK%", "MAVERIK"),
    ("%SMOKIN' JOE%", "SMOKIN' JOE'S"),
    ("%TOBACCO OUTLET PLUS%", "TOBACCO OUTLET PLUS"),
    ("%TOBACCO HUT%", "TOBACCO HUT"),
    ("%HAWKEYE%", "HAWKEYE"),
]
CHAIN_DEFAULT = "Small/Ind Chain"

CHANNEL_RULES = [
    ("%(ET)%", "Winery/Distillery"),
    ("%DISTILL%", "Winery/Distillery"),
    ("%WINERY%", "Winery/Distillery"),
    ("%VINEYARD%", "Winery/Distillery"),
    ("%BREWING CO%", "Winery/Distillery"),
    ("%CASINO%", "On-Premise"),
    ("%HOTEL%", "On-Premise"),
    ("%RESORT%", "On-Premise"),
    ("%ADVENTURELAND%", "On-Premise"),
    ("%HY-VEE%", "Grocery"),
    ("%FAREWAY%", "Grocery"),
    ("%PRICE CHOPPER%", "Grocery"),
    ("%CASH SAVER%", "Grocery"),
    ("%SAM'S CLUB%", "Warehouse/Club"),
    ("%COSTCO%", "Warehouse/Club"),
    ("%WALMART%", "Mass Merchandise"),
    ("%WAL-MART%", "Mass Merchandise"),
    ("%TARGET%", "Mass Merchandise"),
    ("%WALGREENS%", "Drug"),
    ("%CVS%", "Drug"),
    ("%HARTIG DRUG%", "Drug"),
    ("%HAWKEYE%", "Specialty/Tobacco"),
    ("%SMOKIN' JOE%", "Specialty/Tobacco"),
    ("%KWIK SPIRITS%", "Liquor Store"),
    ("%KIMMES%", "Liquor Store"),
    ("%PRIME MART%", "Convenience/Gas"),
    ("%MEGA SAVER%", "Convenience/Gas"),
    ("%MAVERIK%", "Convenience/Gas"),
    ("%KINGS MART%", "Convenience/Gas"),
    ("%JET STOP%", "Convenience/Gas"),
    ("%INDY 66%", "Convenience/Gas"),
    ("%FAST AND FRESH%", "Convenience/Gas"),
    ("%BANI'S%", "Convenience/Gas"),
    ("%KWIK STAR%", "Convenience/Gas"),
    ("%CASEY%", "Convenience/Gas"),
    ("%KUM & GO%", "Convenience/Gas"),
    ("%QUIK TRIP%", "Convenience/Gas"),
    ("%CIRCLE K%", "Convenience/Gas"),
    ("%YESWAY%", "Convenience/Gas"),
    ("%KWIK SHOP%", "Convenience/Gas"),
    ("%JIFFY EXPRESS%", "Convenience/Gas"),
    ("%JIFFY MART%", "Convenience/Gas"),
    ("%BUCKY'S EXPRESS%", "Convenience/Gas"),
    ("%BREW OIL%", "Convenience/Gas"),
    ("%BREW #%", "Convenience/Gas"),
    ("%BIG 10 MART%", "Convenience/Gas"),
    ("%MOES MART%", "Convenience/Gas"),
    ("%BP %", "Convenience/Gas"),
    ("%ALL STOP%", "Convenience/Gas"),
    ("%CONVENIENCE%", "Convenience/Gas"),
    ("%MINI MART%", "Convenience/Gas"),
    ("%QUICK STOP%", "Convenience/Gas"),
    ("%FAS MART%", "Convenience/Gas"),
    ("%KWIK STOP%", "Convenience/Gas"),
    ("%SUPER QUICK%", "Convenience/Gas"),
    ("%SUPER STOP%", "Convenience/Gas"),
    ("%FAST BREAK%", "Convenience/Gas"),
    ("%TRUCK STOP%", "Convenience/Gas"),
    ("%TRAVEL CENTER%", "Convenience/Gas"),
    ("%TRAVEL PLAZA%", "Convenience/Gas"),
    ("%SHELL%", "Convenience/Gas"),
    ("%SINCLAIR%", "Convenience/Gas"),
    ("%CONOCO%", "Convenience/Gas"),
    ("%PHILLIPS 66%", "Convenience/Gas"),
    ("%AMPRIDE%", "Convenience/Gas"),
    ("%CENEX%", "Convenience/Gas"),
    ("%GASLAND%", "Convenience/Gas"),
    ("%DYNO'S%", "Convenience/Gas"),
    ("%NEW STAR%", "Convenience/Gas"),
    ("%THE SPOT%", "Convenience/Gas"),
    ("%THE DEPOT%", "Convenience/Gas"),
    ("%CUBBY'S%", "Convenience/Gas"),
    ("%GOPUFF%", "Convenience/Gas"),
    ("%GOODSTOP%", "Convenience/Gas"),
    ("%MCDERMOTT OIL%", "Convenience/Gas"),
    ("%WASPY'S%", "Convenience/Gas"),
    ("%SPARKY'S%", "Convenience/Gas"),
    ("%RUSH STOP%", "Convenience/Gas"),
    ("%ESSENTIALS%", "Convenience/Gas"),
    ("%EZ STOP%", "Convenience/Gas"),
    ("%ONE STOP%", "Convenience/Gas"),
    ("%PIT STOP%", "Convenience/Gas"),
    ("%STOP N SHOP%", "Convenience/Gas"),
    ("%PANTRY%", "Convenience/Gas"),
    ("%BEVERAGE%", "Liquor Store"),
    ("%BOOZE%", "Liquor Store"),
    ("%CORK%", "Liquor Store"),
    ("%CELLAR%", "Liquor Store"),
    ("%BOTTLE%", "Liquor Store"),
    ("%BEER THIRTY%", "Liquor Store"),
    ("%BEER ON FLOYD%", "Liquor Store"),
    ("%BEER CITY%", "Liquor Store"),
    ("%WINE%", "Liquor Store"),
    ("%WHISKEY%", "Liquor Store"),
    ("%BOOTLEG%", "Liquor Store"),
    ("%BREWSKI%", "Liquor Store"),
    ("%LAST CALL%", "Liquor Store"),
    ("%IGA%", "Grocery"),
    ("%SUPER VALU%", "Grocery"),
    ("%FOODLAND%", "Grocery"),
    ("%THRIFTWAY%", "Grocery"),
    ("%SHOP N SAVE%", "Grocery"),
    ("%FAMILY FARE%", "Grocery"),
    ("%OSCO%", "Drug"),
    ("%APOTHECARY%", "Drug"),
    ("%GROCERY%", "Grocery"),
    ("%GROCER%", "Grocery"),
    ("%MARKET%", "Grocery"),
    ("%FOOD %", "Grocery"),
    ("%FOODS%", "Grocery"),
    ("%MART%", "Grocery"),
    ("%LIQUOR%", "Liquor Store"),
    ("%SPIRITS%", "Liquor Store"),
    ("%SMOK%", "Specialty/Tobacco"),
    ("%TOBACCO%", "Specialty/Tobacco"),
    ("%QUIK %", "Convenience/Gas"),
    ("%FUEL%", "Convenience/Gas"),
    ("%PETRO%", "Convenience/Gas"),
    ("% GAS%", "Convenience/Gas"),
    ("%GAS %", "Convenience/Gas"),
    ("%STATION%", "Convenience/Gas"),
    ("%PRAIRIE MEADOWS%", "On-Premise"),
    ("%WATERING HOLE%", "On-Premise"),
    ("%SPORTS BAR%", "On-Premise"),
    ("%INN & %", "On-Premise"),
    ("%INN /%", "On-Premise"),
    ("%CENTRAL CITY%", "Liquor Store"),
    ("%ANOTHER ROUND%", "Liquor Store"),
    ("%OFFSALE%", "Liquor Store"),
    ("%OFF SALE%", "Liquor Store"),
    ("%DISTRIBUT%", "Liquor Store"),
    ("%SIP &%", "Liquor Store"),
    ("%BODEGA%", "Liquor Store"),
    ("%THE COOLER%", "Liquor Store"),
    ("%BOONEDOCK%", "Liquor Store"),
    ("BREW %", "Convenience/Gas"),
    ("%OASIS%", "Convenience/Gas"),
    ("%EXPRESS%", "Convenience/Gas"),
    ("%XPRESS%", "Convenience/Gas"),
    ("%QUICK SHOP%", "Convenience/Gas"),
    ("%CORNER STOP%", "Convenience/Gas"),
    ("%CORNER STORE%", "Convenience/Gas"),
    ("%COUNTRY STORE%", "Convenience/Gas"),
    ("%GENERAL STORE%", "Convenience/Gas"),
    ("%CROSSROADS%", "Convenience/Gas"),
    ("% FOOD", "Grocery"),
    ("%SUPER SAVER%", "Grocery"),
    ("%SAVE MORE%", "Grocery"),
]
CHANNEL_DEFAULT = "Unknown"

# Upper bounds and their labels.
PACKAGE_SIZES = [("bottle_volume_ml is null or bottle_volume_ml <= 0", "unknown"), ("bottle_volume_ml <= 50", "micro_trial"), ("bottle_volume_ml <= 100", "mini_trial"), ("bottle_volume_ml <= 200", "large_trial"), ("bottle_volume_ml <= 500", "half_size"), ("bottle_volume_ml <= 800", "standard")]
RETAIL_TIERS = [("state_bottle_retail is null", "unknown"), ("state_bottle_retail < 15", "0_to_15"), ("state_bottle_retail < 30", "15_to_30"), ("state_bottle_retail < 45", "30_to_45"), ("state_bottle_retail < 60", "45_to_60"), ("state_bottle_retail < 100", "60_to_100"), ("state_bottle_retail < 250", "100_to_250"), ("state_bottle_retail < 1000", "250_to_1000")]
_PER_100ML = "state_bottle_retail * 100"
PRICE_TIERS = [("is_bundle_pack", "bundle_unknown"), ("effective_bottle_volume_ml is null or effective_bottle_volume_ml <= 0 or state_bottle_retail is null", "unknown")] + [(f"{_PER_100ML} < {top} * effective_bottle_volume_ml", label) for top, label in ((2, "0_to_2"), (4, "2_to_4"), (6, "4_to_6"), (8, "6_to_8"), (12, "8_to_12"), (20, "12_to_20"))]
_TRIAL = "package_size_tier in ('micro_trial', 'mini_trial', 'large_trial')"
_BOTTLE = "package_size_tier in ('standard', 'half_size')"
SEGMENTS = [
    ("retail_price_tier = 'unknown' or price_per_100ml_tier = 'unknown' or package_size_tier = 'unknown'", "unknown"),
    ("is_bundle_pack", "bundle_pack"),
    (f"{_TRIAL} and (state_bottle_retail >= 100 or price_per_100ml >= 20)", "trial_luxury"),
    (f"{_TRIAL} and (state_bottle_retail >= 30 or price_per_100ml >= 8)", "trial_premium"),
    (_TRIAL, "trial_value"),
    (f"{_BOTTLE} and state_bottle_retail >= 1000 and price_per_100ml >= 20", "icon_collectible"),
    (f"{_BOTTLE} and state_bottle_retail >= 250 and price_per_100ml >= 12", "luxury"),
    (f"{_BOTTLE} and state_bottle_retail >= 100 and price_per_100ml >= 8", "ultra_premium"),
    (f"{_BOTTLE} and state_bottle_retail >= 60 and price_per_100ml >= 6", "super_premium"),
    ("package_size_tier = 'jumbo_value' and price_per_100ml < 4", "value_oversized"),
    ("package_size_tier = 'standard' and state_bottle_retail >= 30 and price_per_100ml >= 4", "premium"),
    ("package_size_tier = 'half_size' and state_bottle_retail >= 30 and price_per_100ml >= 2", "premium"),
    ("package_size_tier = 'standard' and state_bottle_retail >= 15 and price_per_100ml >= 1.5", "standard"),
    ("package_size_tier = 'half_size' and state_bottle_retail >= 15 and price_per_100ml >= 1", "standard"),
    ("package_size_tier = 'standard' and state_bottle_retail <= 15", "budget"),
    ("package_size_tier = 'half_size' and state_bottle_retail <= 15", "budget"),
    ("package_size_tier = 'jumbo_value' and state_bottle_retail < 15 and price_per_100ml < 2", "high_volume"),
    ("package_size_tier = 'jumbo_value' and state_bottle_retail >= 15 and price_per_100ml >= 2", "premium_bulk"),
]
# Segments as reports show them; a segment in no rule keeps its name. The plain report merges two kinds, the grouped one four.
MERGED_SEGMENTS = [
    ("price_position_segment in ('premium_bulk', 'value_oversized', 'bundle_pack')", "bulk_or_bundle"),
    ("price_position_segment in ('trial_value', 'trial_premium', 'trial_luxury')", "trial_size"),
]
GROUPED_SEGMENTS = [
    ("price_position_segment in ('budget', 'standard')", "budget_standard"),
    ("price_position_segment in ('premium', 'super_premium', 'ultra_premium', 'luxury', 'icon_collectible')", "premium_plus"),
    *MERGED_SEGMENTS,
]
ARCHETYPES = [
    ("upper(item_description) like '%MINI%' or (category_name in ('AMERICAN SCHNAPPS', 'AMERICAN CORDIALS & LIQUEURS', 'WHISKEY LIQUEUR') and avg_selling_price between 70 and 90)", "Mini Variety Pack"),
    ("category_name = 'TEMPORARY & SPECIALTY PACKAGES' or upper(item_description) like '%FIELD OF DREAMS%' or upper(item_description) like '%SINATRA%' or upper(item_description) like '%MIDWINTER%' or upper(item_description) like '%CANDY CANE%' or upper(item_description) like '%WINDOW BOX%'", "Seasonal / Limited Release"),
]
ARCHETYPE_DEFAULT = "Collector / Ultra-Premium"
BUNDLE_PATTERNS = ["%TRI PACK%", "%TRIPACK%", "%TRAY PACK%", "%GIFT PACK%", "%GIFT SET%", "%SAMPLER%", "%VARIETY PACK%", "%COMBO PACK%"]
BUNDLE_COUNT = "[0-9]+[ -]?PACK|[0-9]+PK"
FAMILIES = ["Whiskies", "Tequilas", "Vodkas", "Brandies", "Rum", "Gin", "Liqueurs", "RTD/Cocktails", "Specialty/Other Spirits", "Other"]


def ladder(rules: list[tuple[str, str]], default: str | Column | None) -> Column:
    """The label of the first SQL condition that holds, else default."""
    found = None
    for condition, label in rules:
        found = (F if found is None else found).when(F.expr(condition), F.lit(label))
    return found.otherwise(default if isinstance(default, Column) else F.lit(default))


def name_ladder(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first LIKE pattern that the upper-cased name matches."""
    found, upper = None, F.upper(name)
    for pattern, label in rules:
        found = (F if found is None else found).when(upper.like(pattern), F.lit(label))
    return found.otherwise(F.lit(default))


def is_bundle(description: Column) -> Column:
    """Whether an item description names a pack of several bottles."""
    upper = F.upper(F.coalesce(description, F.lit("")))
    named = F.lit(False)
    for pattern in BUNDLE_PATTERNS:
        named = named | upper.like(pattern)
    return named | upper.rlike(BUNDLE_COUNT)
