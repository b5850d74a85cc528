"""Zero-filled weekly demand and the replenishment forecast."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.months import in_days, newest_day


def weekly_depletions(sales: DataFrame, weeks: int = 8) -> DataFrame:
    """Units of each active item in each of the full weeks before the newest, zero where none were sold.

    Items are active if they sold within those weeks. Weeks start on Monday. The newest day is looked up at once.
    """
    newest = newest_day(sales)
    this_week = (newest or date(1970, 1, 5)) - timedelta(days=newest.weekday() if newest else 0)
    recent = in_days(sales, (this_week - timedelta(weeks=weeks), this_week)).filter(~F.col("is_return"))
    sums = recent.groupBy("item_number", F.trunc("order_date", "week").alias("week_start")).agg(F.sum("bottles_sold").cast("long").alias("weekly_units_sold"))
    by_item = sums.groupBy("item_number").agg(F.map_from_entries(F.collect_list(F.struct("week_start", "weekly_units_sold"))).alias("__sold"))  # as many entries as weeks
    spine = by_item.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(weeks)))).withColumn("week_start", F.date_sub(F.lit(this_week), F.col("__k") * 7))
    return spine.select("item_number", "week_start", F.coalesce(F.try_element_at("__sold", F.col("week_start")), F.lit(0)).cast("long").alias("weekly_units_sold"))


def rolling_metrics(weekly: DataFrame) -> DataFrame:
    """Mean units of the last four and eight weeks of each item."""
    newest = weekly.agg(F.date_add(F.max("week_start"), 7).alias("__next"))
    told = weekly.join(F.broadcast(newest))  # one row
    last = lambda n: F.avg(F.when(F.col("week_start") >= F.date_sub("__next", 7 * n), F.col("weekly_units_sold")))
    total = lambda n: F.sum(F.when(F.col("week_start") >= F.date_sub("__next", 7 * n), F.col("weekly_units_sold"))).cast("long")
    return told.groupBy("item_number").agg(last(4).alias("trailing_4wk_avg_units"), last(8).alias("trailing_8wk_avg_units"), total(4).alias("units_4wk"), total(8).alias("units_8wk"))


def baseline_forecast(rolling: DataFrame) -> DataFrame:
    """The greater mean, at least zero, and a shipment of 1.2 times it, rounded from exact sums."""
    tenths = F.greatest(F.lit(0), F.col("units_4wk") * 30, F.col("units_8wk") * 15)  # hundredths of the shipment
    return rolling.withColumns({"selected_baseline_units": F.greatest(F.lit(0.0), "trailing_4wk_avg_units", "trailing_8wk_avg_units"), "recommended_ship_qty": F.floor((tenths + 50) / 100).cast("int")})


def replenishment_forecast(forecast: DataFrame, items: DataFrame) -> DataFrame:
    """The forecast with item labels, the largest shipment first."""
    labels = items.select("item_number", "item_description", "category_name", "category_family", "vendor_name")
    return forecast.join(labels, "item_number", "left").select("item_number", "item_description", "category_name", "category_family", "vendor_name", "trailing_4wk_avg_units", "trailing_8wk_avg_units", "selected_baseline_units", "recommended_ship_qty").orderBy(F.col("recommended_ship_qty").desc_nulls_last(), "item_number")
