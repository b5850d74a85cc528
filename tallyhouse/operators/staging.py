"""From raw invoice lines to the typed, enriched and deduplicated fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.measures import ratio, units

_TEXT = ("store_number", "store_name", "category", "category_name", "vendor_number", "vendor_name", "item_number", "item_description")
_CASTS = {"order_date": "date", "pack": "int", "bottle_volume_ml": "int", "bottles_sold": "int", "state_bottle_cost": "decimal(12,2)", "state_bottle_retail": "decimal(12,2)", "sale_dollars": "decimal(12,2)", "volume_sold_liters": "decimal(12,4)", "volume_sold_gallons": "decimal(12,4)"}
#: Newest load first; later columns break ties of lines loaded by one run.
LATEST = ("loaded_at", "order_date", "store_number", "item_number", "tie_supp")


def stage_sales(raw: DataFrame) -> DataFrame:
    """Typed columns and trimmed texts, row for row; a raw date becomes order_date. Texts that raw lacks aren't made up."""
    if "date" in raw.columns:
        raw = raw.withColumnRenamed("date", "order_date")
    return raw.withColumns({c: F.trim(c) for c in _TEXT if c in raw.columns} | {c: F.col(c).cast(t) for c, t in _CASTS.items()})


def per(value: str, amount: str) -> Column:
    """value / amount, null where amount is zero."""
    return ratio(F.col(value), F.col(amount))


def enrich_sales(staged: DataFrame) -> DataFrame:
    """Adds gross profit and safe ratios of revenue."""
    return staged.withColumns({
        "gross_profit_per_bottle": (F.col("state_bottle_retail") - F.col("state_bottle_cost")).cast("decimal(13,2)"),
        "estimated_total_cost": (F.col("state_bottle_cost") * F.col("bottles_sold")).cast("decimal(18,2)"),
        "estimated_gross_profit": (F.col("sale_dollars") - F.col("state_bottle_cost") * F.col("bottles_sold")).cast("decimal(18,2)"),
        "revenue_per_bottle": per("sale_dollars", "bottles_sold"),
        "revenue_per_liter": per("sale_dollars", "volume_sold_liters"),
    })


def is_return(invoice: Column) -> Column:
    return F.upper(invoice).like("RINV-%")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per keys, the first in order. Spark keeps one row per keys in each task before the shuffle
    (WindowGroupLimit), so a hot key isn't gathered."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def latest_first(columns: list[str]) -> list[Column]:
    """The order in which dedupe_latest takes rows with these columns."""
    return [F.col(c).desc_nulls_first() for c in LATEST if c in columns]


def with_is_return(sales: DataFrame) -> DataFrame:
    return sales.withColumn("is_return", is_return(F.col("invoice_item_number")))


def dedupe_latest(sales: DataFrame) -> DataFrame:
    """The latest row of each invoice line, with is_return."""
    return with_is_return(latest_per_key(sales, ["invoice_item_number"], latest_first(sales.columns)))


def duplicate_audit(sales: DataFrame) -> DataFrame:
    """Invoice lines with several rows: how many, and how many values of five columns.

    Only repeated keys reach the distinct counts.
    """
    repeated = sales.groupBy("invoice_item_number").count().filter("count > 1").select("invoice_item_number")
    return audited(sales.join(repeated, "invoice_item_number", "left_semi"))


def audited(repeated: DataFrame) -> DataFrame:
    """duplicate_audit of the rows of repeated keys."""
    counted = {"order_date": "distinct_dates", "store_number": "distinct_stores", "item_number": "distinct_items", "sale_dollars": "distinct_sales", "bottles_sold": "distinct_bottles"}
    return repeated.groupBy("invoice_item_number").agg(F.count("*").alias("row_count"), *(F.count_distinct(c).alias(n) for c, n in counted.items()), F.min("loaded_at").alias("first_loaded_at"), F.max("loaded_at").alias("last_loaded_at"))


_MEASURES = ("bottles_sold", "sale_dollars", "volume_sold_liters", "volume_sold_gallons")


def _any(sign: str) -> Column:
    return F.expr(" or ".join(f"{c} {sign} 0" for c in _MEASURES))


def anomalous_returns(sales: DataFrame) -> DataFrame:
    """Returns with a positive measure."""
    return sales.filter(F.col("is_return") & _any(">")).withColumn("anomaly", F.lit("positive_return"))


def unlabeled_negative_returns(sales: DataFrame) -> DataFrame:
    """Rows that aren't returns but have a negative measure."""
    return sales.filter(~F.col("is_return") & _any("<")).withColumn("anomaly", F.lit("unlabeled_negative"))


FACT = ["invoice_item_number", "order_date", "store_number", "item_number", "vendor_number", "category", "bottles_sold", "sale_dollars", "volume_sold_liters", "volume_sold_gallons", "estimated_total_cost", "estimated_gross_profit", "is_return", "loaded_at"]


def fact_sales(deduped: DataFrame) -> DataFrame:
    return deduped.select(FACT)


#: The measures of a store's day.
DAILY = ["total_bottles_sold", "total_sales_dollars", "total_volume_sold_liters", "total_volume_sold_gallons", "total_estimated_cost", "total_estimated_gross_profit", "invoice_line_count"]


def store_daily_sales(fact: DataFrame, *more: str) -> DataFrame:
    """Sums and line count by store and day; more are columns that follow from these two."""
    money = lambda c, n: F.sum(c).cast("decimal(20,4)").alias(n)
    return fact.groupBy(*more, "order_date", "store_number").agg(units("bottles_sold").alias("total_bottles_sold"), money("sale_dollars", "total_sales_dollars"), money("volume_sold_liters", "total_volume_sold_liters"), money("volume_sold_gallons", "total_volume_sold_gallons"), money("estimated_total_cost", "total_estimated_cost"), money("estimated_gross_profit", "total_estimated_gross_profit"), F.count("*").alias("invoice_line_count"))
