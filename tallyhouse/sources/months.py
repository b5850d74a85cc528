"""Tables in a folder per month, sorted by item within files, and the literal bounds that prune them.

A table of this kind has a column order_month, the first day of the month of its day
column; null days have a folder of their own. Filters that are made here name both the days and
the months, so that Spark opens only the folders that can hold such days; on
tables without order_month they are plain filters.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.lasting import delete, file_system

MONTH = "order_month"


def by_month(rows: DataFrame, sort: list[str], day: str = "order_date") -> DataFrame:
    """rows with order_month, dealt out by month and sorted within a task. Rebalancing splits a month that is larger than
    a task should be, and puts small ones together."""
    return rows.withColumn(MONTH, F.trunc(day, "month")).hint("rebalance", MONTH).sortWithinPartitions(MONTH, *sort)


def write_by_month(rows: DataFrame, path: str, sort: list[str], day: str = "order_date") -> None:
    """A full rebuild of a table in month folders. Rows that have order_month already are written where they are."""
    placed = rows.sortWithinPartitions(MONTH, *sort) if MONTH in rows.columns else by_month(rows, sort, day)
    placed.write.mode("overwrite").partitionBy(MONTH).parquet(path)


#: Parts of a month that groups of a store or item go to.
PARTS = 16


def dealt(rows: DataFrame, key: Column) -> DataFrame:
    """rows of a table in month folders with __part, dealt out by month and part of key: sums by day and key that are grouped
    by order_month and __part as well need no other shuffle, and may be written as they are, a file or so for a part of a month."""
    return rows.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(PARTS))).repartition(MONTH, "__part")


def replace_months(rows: DataFrame, path: str, sort: list[str], months: list[date | None], day: str = "order_date") -> None:
    """Puts rows in place of the table's given months, to which all rows belong; other folders keep their files.

    Months without rows lose their folder. Spark swaps the folders that rows fill, then the others are deleted; a
    load that broke off can be repeated.
    """
    spark = rows.sparkSession
    by_month(rows, sort, day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    filled = {r[0] for r in rows.select(F.trunc(day, "month")).distinct().collect()}  # a number of months
    for month in months:
        if month not in filled:
            delete(spark, f"{path}/{MONTH}={month.isoformat() if month else '__HIVE_DEFAULT_PARTITION__'}")


def months_of(spark, path: str) -> list[date]:
    """The months that a table has folders for; nothing but their names is read."""
    files, at = file_system(spark, path)
    names = [f.getPath().getName().partition("=")[2] for f in files.listStatus(at) if f.isDirectory()] if files.exists(at) else []
    return sorted(date.fromisoformat(n) for n in names if n[:1].isdigit())


def _first(day: date) -> date:
    return day.replace(day=1)


def _days(df: DataFrame, start: date | None, end: date | None, day: str) -> Column:
    wanted = F.lit(True)
    for bound, column, before in ((start, day, False), (end, day, True)):
        if bound is not None:
            wanted = wanted & (F.col(column) < F.lit(bound) if before else F.col(column) >= F.lit(bound))
    if MONTH in df.columns:
        if start is not None:
            wanted = wanted & (F.col(MONTH) >= F.lit(_first(start)))
        if end is not None:
            wanted = wanted & (F.col(MONTH) <= F.lit(_first(end - timedelta(days=1))))
    return wanted


def in_days(df: DataFrame, *windows: tuple[date | None, date | None], day: str = "order_date") -> DataFrame:
    """Rows whose day is in one of the windows; ends are exclusive, and either bound may be None."""
    wanted = F.lit(False)
    for start, end in windows:
        wanted = wanted | _days(df, start, end, day)
    return df.filter(wanted)


def newest_day(df: DataFrame, day: str = "order_date") -> date | None:
    """The latest day, taken at once as a literal for filters. Of a table in month folders only the last month's days are read;
    the months themselves need no more than the files' row counts."""
    if MONTH in df.columns:
        month = df.agg(F.max(MONTH)).first()[0]
        if month is None:
            return None
        df = df.filter(F.col(MONTH) == F.lit(month))
    return df.agg(F.max(day)).first()[0]
