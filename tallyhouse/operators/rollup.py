"""Monthly sums that growth reports read in place of the fact.

The reports' periods are whole months, and they list groups without recent sales too,
so they'd read all of the fact's history. They read the rollup instead: a row for each
item, store and month, whose order_date is the month's first day.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.sources import months

KEYS = ["item_number", "store_number"]


def monthly_sales(fact: DataFrame) -> DataFrame:
    """order_date (a month's first day, null for lines without a day), item_number, store_number, sale_dollars, bottles_sold, n_lines."""
    month = F.trunc("order_date", "month")
    return fact.groupBy(*KEYS, month.alias("order_date")).agg(F.sum("sale_dollars").cast("decimal(20,2)").alias("sale_dollars"), F.sum("bottles_sold").cast("long").alias("bottles_sold"), F.count("*").alias("n_lines"))


def touched_months(days: DataFrame, day: str = "order_date") -> list[date]:
    """The months of the days that a load has changed; null days don't count."""
    return sorted(r[0] for r in days.select(F.trunc(day, "month")).distinct().collect() if r[0])  # a number of months


def refresh(fact: DataFrame, path: str, touched: list[date]) -> None:
    """Makes the rollup's touched months anew from the fact; without touched months nothing is read.

    Months of the fact that aren't touched aren't opened, and the rollup's other folders keep their files. The
    fact needs to be in month folders for that. A month that has lost all its lines loses its folder.
    """
    if touched:
        wanted = fact.filter(F.col(months.MONTH).isin(touched) if months.MONTH in fact.columns else F.trunc("order_date", "month").isin(touched))
        months.replace_months(monthly_sales(wanted), path, KEYS, touched)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    kinds = "item_number string, store_number string, order_date date, sale_dollars decimal(20,2), bottles_sold long, n_lines long"
    return spark.read.schema(f"{kinds}, {months.MONTH} date").parquet(path)
