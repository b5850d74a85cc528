"""Pareto velocity tiers of SKUs by units and revenue."""

from __future__ import annotations

from datetime import date, timedelta
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import ladders
from tallyhouse.functions.calendar import trailing_weeks
from tallyhouse.functions.lasting import lasting
from tallyhouse.functions.measures import ratio, selling_price
from tallyhouse.operators import pareto
from tallyhouse.sources.months import in_days, newest_day

CORE, NICHE, ZOMBIE = "Tier 1: Core", "Tier 2: Niche", "Tier 3: Zombie"


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the running sum of an exact value (integer or decimal) in an order without ties.

    Two levels: rows are range-partitioned, each partition's total is added up by
    the driver (a number per partition), and partitions run on from there in parallel.
    Both levels read one written copy that holds each row's partition: range bounds
    are sampled, so a second run could cut elsewhere.
    """
    parted = lasting(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = sorted(parted.groupBy("__part").agg(F.sum(value)).collect())
    starts = dict(zip((p for p, _ in totals), accumulate((t or 0 for _, t in totals), initial=0), strict=False))
    kind = df.schema[value].dataType.simpleString()
    wide = "decimal(38,2)" if kind.startswith("decimal") else "bigint"
    offset = F.coalesce(F.create_map(*[x for p, t in starts.items() for x in (F.lit(p), F.lit(t).cast(wide))])[F.col("__part")], F.lit(0).cast(wide)) if starts else F.lit(0).cast(wide)
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parted.withColumn(name, (F.sum(value).over(within) + offset).cast(wide)).drop("__part")


def velocity_base(sales: DataFrame, weeks: int = 12) -> DataFrame:
    """Units and revenue of each item since the newest day less weeks, without returns. The newest day is looked up at once."""
    newest = newest_day(sales)
    recent = in_days(sales, (newest - timedelta(weeks=weeks), None)) if newest else sales.limit(0)
    return item_totals(recent.filter(~F.col("is_return")))


def velocity_window(fact: DataFrame, day: date, weeks: int) -> DataFrame:
    """The same for the weeks up to a given day."""
    return item_totals(in_days(fact, trailing_weeks(day, weeks)).filter(~F.col("is_return")))


def item_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("item_number").agg(F.sum("bottles_sold").cast("long").alias("total_units_sold"), F.sum("sale_dollars").cast("decimal(20,2)").alias("total_revenue"))


def velocity_ranked(base: DataFrame) -> DataFrame:
    """Adds running totals by either measure, the totals of all items and their number."""
    base = lasting(base)  # four readers
    all_items = base.agg(F.sum("total_units_sold").cast("long").alias("state_units"), F.sum("total_revenue").cast("decimal(20,2)").alias("state_revenue"), F.count("*").alias("active_sku_count"))
    ranked = running_total(base, [F.col("total_units_sold").desc(), F.col("item_number").asc()], "total_units_sold", "cumulative_units")
    ranked = running_total(ranked, [F.col("total_revenue").desc(), F.col("item_number").asc()], "total_revenue", "cumulative_revenue")
    return ranked.join(F.broadcast(all_items))  # one row


def pareto_tier(cumulative: str, total: str, cuts: tuple[float, float] = (0.80, 0.95)) -> Column:
    """The tier of an item by its running share; the item that crosses a cut is in the lower tier."""
    share = ratio(F.col(cumulative), F.col(total))
    return F.when(share <= cuts[0], CORE).when(share <= cuts[1], NICHE).otherwise(ZOMBIE)


def classify(ranked: DataFrame) -> DataFrame:
    return ranked.withColumns({"cumulative_units_pct": ratio(F.col("cumulative_units"), F.col("state_units")), "cumulative_revenue_pct": ratio(F.col("cumulative_revenue"), F.col("state_revenue")), "volume_tier": pareto_tier("cumulative_units", "state_units"), "revenue_tier": pareto_tier("cumulative_revenue", "state_revenue")})


def tiered(base: DataFrame, shares: tuple[float, float] = (0.80, 0.95)) -> DataFrame:
    """base with the tiers of classify, the totals of all items and their number, by selection instead of running totals.

    Same tiers, in a few small aggregates: for reports that don't show running shares. base is read several times
    when this is called, so it should be a written table. Sums that aren't above zero have no crossing to look for and are
    left to classify.
    """
    units, cents = F.col("total_units_sold").cast("long"), (F.col("total_revenue") * 100).cast("long")
    n, all_units, all_cents, most_units, most_cents = base.agg(F.count("*"), F.sum(units), F.sum(cents), F.max(units), F.max(cents)).first()
    totals = {"state_units": F.lit(all_units).cast("long"), "state_revenue": (F.lit(all_cents).cast("decimal(22,0)") / 100).cast("decimal(20,2)"), "active_sku_count": F.lit(n).cast("long")}
    if not (all_units and all_cents) or all_units < 0 or all_cents < 0:
        return classify(velocity_ranked(base)).select(*base.columns, *totals, "volume_tier", "revenue_tier")
    measures = {"volume_tier": pareto.Measure(units, all_units, most_units), "revenue_tier": pareto.Measure(cents, all_cents, most_cents)}
    found, names = pareto.cuts(base, "item_number", measures, shares), (CORE, NICHE, ZOMBIE)
    return base.withColumns(totals | {name: pareto.tier([found[name, s] for s in shares], names, m.value, F.col("item_number")) for name, m in measures.items()})


def with_item_labels(df: DataFrame, items: DataFrame) -> DataFrame:
    return df.join(items.select("item_number", "item_description", "category_name", "category_family", "vendor_name", "bottle_volume_ml"), "item_number", "left")


def _long(classified: DataFrame) -> DataFrame:
    """A row per item and dimension: dimension, tier."""
    each = F.array(F.struct(F.lit("volume").alias("dimension"), F.col("volume_tier").alias("tier")), F.struct(F.lit("revenue").alias("dimension"), F.col("revenue_tier").alias("tier")))
    return classified.withColumn("__d", F.explode(each)).select("*", "__d.dimension", "__d.tier").drop("__d")


def tier_summary(classified: DataFrame) -> DataFrame:
    """By dimension and tier: SKUs, units, revenue and their shares of all."""
    grouped = _long(classified).groupBy("dimension", "tier").agg(F.count("*").alias("sku_count"), F.sum("total_units_sold").cast("long").alias("units"), F.sum("total_revenue").cast("double").alias("revenue"), F.max("active_sku_count").alias("n"), F.max("state_units").alias("u"), F.max("state_revenue").alias("r"))
    return grouped.select("dimension", "tier", "sku_count", "units", "revenue", F.round(ratio(F.col("sku_count"), F.col("n")), 6).alias("sku_share"), F.round(ratio(F.col("units"), F.col("u")), 6).alias("unit_share"), F.round(ratio(F.col("revenue"), F.col("r")), 6).alias("revenue_share"))


def tier_matrix(classified: DataFrame) -> DataFrame:
    """SKUs, units and revenue by volume tier and revenue tier."""
    return classified.groupBy("volume_tier", "revenue_tier").agg(F.count("*").alias("sku_count"), F.sum("total_units_sold").cast("long").alias("units"), F.sum("total_revenue").cast("double").alias("revenue"))


def tier_by_family(labelled: DataFrame) -> DataFrame:
    """Tiers of all items, counted within families, with shares of the family."""
    family = F.coalesce("category_family", F.lit("Other"))
    grouped = _long(labelled.withColumn("category_family", family)).groupBy("dimension", "category_family", "tier").agg(F.count("*").alias("sku_count"), F.sum("total_units_sold").cast("long").alias("units"), F.sum("total_revenue").cast("double").alias("revenue"))
    own = Window.partitionBy("dimension", "category_family")
    return grouped.withColumns({"sku_share": F.round(ratio(F.col("sku_count"), F.sum("sku_count").over(own)), 6), "revenue_share": F.round(ratio(F.col("revenue"), F.sum(F.col("revenue").cast("decimal(20,2)")).over(own)), 6)})


def _priced(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("avg_selling_price", selling_price(F.col("total_revenue"), F.col("total_units_sold"), 4)).withColumn("total_revenue", F.col("total_revenue").cast("double"))


def divergent_skus(labelled: DataFrame, volume_tier: str = ZOMBIE, revenue_tier: str = CORE) -> DataFrame:
    """SKUs of one pair of tiers, with their archetype."""
    found = _priced(labelled.filter((F.col("volume_tier") == volume_tier) & (F.col("revenue_tier") == revenue_tier)))
    return found.withColumn("archetype", ladders.ladder(ladders.ARCHETYPES, ladders.ARCHETYPE_DEFAULT)).select("item_number", "item_description", "category_family", "category_name", "volume_tier", "revenue_tier", "total_units_sold", "total_revenue", "avg_selling_price", "archetype")


def full_scatter(labelled: DataFrame) -> DataFrame:
    """All SKUs with positive units and revenue and the group they are drawn in."""
    v, r = F.col("volume_tier"), F.col("revenue_tier")
    group = F.when((v == CORE) & (r == CORE), "Core / Core").when((v == ZOMBIE) & (r == CORE), "Fragile Premium").when((v == CORE) & (r == ZOMBIE), "High Volume / Low Revenue").when((v == ZOMBIE) & (r == ZOMBIE), "Zombie / Zombie").otherwise("Other")
    found = _priced(labelled.filter("total_units_sold > 0 and total_revenue > 0"))
    return found.select("item_number", "item_description", F.coalesce("category_family", F.lit("Other")).alias("category_family"), "category_name", "bottle_volume_ml", "volume_tier", "revenue_tier", "total_units_sold", "total_revenue", "avg_selling_price", group.alias("scatter_group"))
