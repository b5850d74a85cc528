"""Vendor mixes by price segment or store channel, on attributes valid on the day of sale."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import ladders
from tallyhouse.functions.calendar import annual_periods, ends_of, period_bounds
from tallyhouse.functions.lasting import lasting
from tallyhouse.functions.measures import selling_price, total, units, yoy_pct
from tallyhouse.operators.growth import UNKNOWN, few, period_sums, top_n_rows, within
from tallyhouse.operators.history import asof
from tallyhouse.sources.months import in_days


def historic_lines(fact: DataFrame, history: DataFrame, family: str, package_size: str = "", grouped: bool = False, windows: list[tuple[date, date]] | None = None) -> DataFrame:
    """Lines of a family with the vendor and segment that were valid on their day; grouped merges more segments.

    With windows (ends exclusive) other days aren't read.
    """
    valid = history.filter(F.col("category_family") == family)
    if package_size:
        valid = valid.filter(F.col("package_size_tier") == package_size)
    segment = ladders.ladder(ladders.GROUPED_SEGMENTS if grouped else ladders.MERGED_SEGMENTS, F.col("price_position_segment"))
    valid = valid.select("item_number", "business_valid_from", "business_valid_to", segment.alias("price_position_segment"), *(F.coalesce(c, F.lit(UNKNOWN[c])).alias(c) for c in ("vendor_number", "vendor_name")))
    lines = in_days(fact, *windows) if windows else fact
    return asof(lines.select("item_number", "store_number", "order_date", "sale_dollars", "bottles_sold"), valid, "item_number", "order_date", "business_valid_from", "business_valid_to")


def with_channel(lines: DataFrame, stores: DataFrame) -> DataFrame:
    """Lines with their store's channel; unknown stores stay."""
    return lines.join(stores.select("store_number", "store_channel"), "store_number", "left").withColumn("store_channel", F.coalesce("store_channel", F.lit("Unknown")))


def modal_label(counts: DataFrame, key: str, label: str, count: str) -> DataFrame:
    """The most frequent label of each key, of rows that stand for count each; the first by name of several."""
    summed = counts.groupBy(key, label).agg(F.sum(count).alias("__n"))
    return top_n_rows(summed, [F.col("__n").desc(), F.col(label).asc()], 1, "__rank", [key]).select(key, label)


def _price(sales: str, units_: str) -> Column:
    return selling_price(F.col(sales), F.col(units_))


def vendor_mix(lines: DataFrame, by: str, month_start: date) -> DataFrame:
    """Trailing-year sales, units and price by vendor and segment or channel, with the total.

    The lines are read once: their sums by vendor, vendor name and by are written when this is called, and all else is
    taken from those.
    """
    bounds = period_bounds(month_start)
    windows = {n: bounds[n] for n in ("t12m", "t12m_prior")}
    bottles = F.when(within(bounds["t12m"]), F.col("bottles_sold")).otherwise(0)
    kept = lasting(lines.groupBy(by, "vendor_number", "vendor_name").agg(*period_sums(windows), units(bottles).alias("units_t12m"), F.count("*").alias("n_lines")))
    money = lambda c: F.sum(F.col(c).cast("decimal(20,2)")).cast("double").alias(c)
    detail = kept.groupBy(by, "vendor_number").agg(*(money(f"sales_{w}") for w in windows), units("units_t12m").alias("units_t12m"))
    names = modal_label(kept, "vendor_number", "vendor_name", "n_lines")
    totals = kept.groupBy("vendor_number").agg(F.sum(F.col("sales_t12m").cast("decimal(20,2)")).alias("t")).join(names, "vendor_number")
    ranks = totals.select("vendor_number", "vendor_name", F.row_number().over(Window.orderBy(F.col("t").desc(), "vendor_name", "vendor_number")).alias("vendor_rank"))
    detail = detail.join(ranks, "vendor_number").withColumn("row_type", F.lit("detail"))
    grand = detail.agg(money("sales_t12m"), money("sales_t12m_prior"), units("units_t12m").alias("units_t12m")).withColumns({"row_type": F.lit("grand_total"), by: F.lit("Grand Total")})
    return detail.unionByName(grand, allowMissingColumns=True).withColumns({"avg_selling_price": _price("sales_t12m", "units_t12m"), "t12m_yoy_pct": yoy_pct(F.col("sales_t12m"), F.col("sales_t12m_prior"))})


def compared(month_start: date, trend_years: int = 3) -> list[tuple[date, date]]:
    """The trailing years that vendor_mix_compare looks at."""
    return ends_of(annual_periods(month_start, trend_years))


def vendor_mix_compare(lines: DataFrame, by: str, month_start: date, trend_years: int = 3, top_n: int = 3) -> DataFrame:
    """The first and last trailing year by segment or channel: the last year's top vendors, the rest as Other.

    As in vendor_mix the lines are read once; the sums are written when this is called.
    """
    periods = annual_periods(month_start, trend_years)
    wanted = [(periods.index(w), month_start.year - periods.index(w), *w) for w in compared(month_start, trend_years)]
    table = lines.sparkSession.createDataFrame(wanted, "period_order int, period_year int, period_start date, period_end date")
    inside = lines.join(F.broadcast(table), (F.col("order_date") >= F.col("period_start")) & (F.col("order_date") < F.col("period_end")))  # two rows
    sums = [F.sum("sale_dollars").alias("sale_dollars"), F.sum("bottles_sold").alias("bottles_sold"), F.count("*").alias("n_lines")]
    inside = lasting(inside.groupBy("period_order", "period_year", by, "vendor_number", "vendor_name").agg(*sums))
    names = modal_label(inside, "vendor_number", "vendor_name", "n_lines")
    latest = inside.filter("period_order = 0").groupBy("vendor_number").agg(F.sum("sale_dollars").alias("t")).join(names, "vendor_number")
    top = top_n_rows(latest, [F.col("t").desc(), F.col("vendor_name").asc(), F.col("vendor_number").asc()], top_n, "vendor_rank").select("vendor_number", "vendor_name", "vendor_rank")
    folded = inside.drop("vendor_name").join(few(top, top_n), "vendor_number", "left")
    keys = [F.when(F.col("vendor_rank").isNull(), "Other").otherwise(F.col("vendor_number")).alias("vendor_number"), F.coalesce("vendor_name", F.lit("Other Vendors")).alias("vendor_name"), F.coalesce("vendor_rank", F.lit(top_n + 1)).alias("vendor_rank")]
    return folded.groupBy("period_order", "period_year", *keys, by).agg(total("sale_dollars").alias("sales_t12m"), units("bottles_sold").alias("units_t12m")).withColumn("avg_selling_price", _price("sales_t12m", "units_t12m"))
