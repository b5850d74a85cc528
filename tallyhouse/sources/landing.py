"""Landing invoice payloads and replacing date windows of the landed table."""

from __future__ import annotations

import csv
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.lasting import delete, file_system, lasting

#: Payload field of each raw column, in the order of the raw table.
FIELDS = {
    "invoice_item_number": "invoice_line_no", "date": "date", "store_number": "store", "store_name": "name", "address": "address", "city": "city", "zip_code": "zipcode", "store_location": "store_location",
    "county_number": "county_number", "county": "county", "category": "category", "category_name": "category_name", "vendor_number": "vendor_no", "vendor_name": "vendor_name", "item_number": "itemno",
    "item_description": "im_desc", "pack": "pack", "bottle_volume_ml": "bottle_volume_ml", "state_bottle_cost": "state_bottle_cost", "state_bottle_retail": "state_bottle_retail", "bottles_sold": "sale_bottles",
    "sale_dollars": "sale_dollars", "volume_sold_liters": "sale_liters", "volume_sold_gallons": "sale_gallons",
}
_TYPES = {"date": "date", "pack": "int", "bottle_volume_ml": "int", "bottles_sold": "int", "state_bottle_cost": "decimal(12,2)", "state_bottle_retail": "decimal(12,2)", "sale_dollars": "decimal(12,2)", "volume_sold_liters": "decimal(12,4)", "volume_sold_gallons": "decimal(12,4)"}
#: The raw table; every reader gets it, nothing is inferred.
RAW_SCHEMA = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in FIELDS) + ", loaded_at timestamp_ntz"
PAYLOAD_SCHEMA = ", ".join(f"{f} string" for f in FIELDS.values())


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as the API sends them; nested values stay JSON text."""
    return spark.read.schema(PAYLOAD_SCHEMA).json(path)


def land_raw(payload: DataFrame, loaded_at: datetime) -> DataFrame:
    """Payload rows in the raw table's shape, stamped with their run's loaded_at."""
    value = lambda c: F.substring(FIELDS[c], 1, 10) if c == "date" else F.col(FIELDS[c])
    return payload.select(*(value(c).cast(_TYPES.get(c, "string")).alias(c) for c in FIELDS), F.lit(loaded_at).cast("timestamp_ntz").alias("loaded_at"))


def in_window(column: str, start: date | None, end: date | None):
    """Days from start to end, both included and both optional."""
    found = F.lit(True)
    if start is not None:
        found = found & (F.col(column) >= F.lit(start))
    if end is not None:
        found = found & (F.col(column) <= F.lit(end))
    return found


def _by_day(rows: DataFrame) -> DataFrame:
    """rows with their folder's day, dealt out by it, so that a load writes a file or so a day and not one a day and task;
    rebalancing splits a day that is larger than a task should be."""
    return rows.withColumn("landed_on", F.col("date")).hint("rebalance", "landed_on")


def append_raw(rows: DataFrame, path: str, dealt: bool = False) -> None:
    """Adds rows to the landed table, in a folder per day. Rows that are dealt out by day already are written where they are."""
    (rows.withColumn("landed_on", F.col("date")) if dealt else _by_day(rows)).write.mode("append").partitionBy("landed_on").parquet(path)


def overwrite_days(rows: DataFrame, path: str) -> None:
    """Replaces exactly the days that rows hold; other days stay."""
    _by_day(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("landed_on").parquet(path)


def landed_days(spark: SparkSession, path: str) -> list[date]:
    """The days that the landed table has a folder for; a day's name is all that is read."""
    files, at = file_system(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    found = (n.removeprefix("landed_on=") for n in names if n.startswith("landed_on="))
    return sorted(date.fromisoformat(n) for n in found if n[:1].isdigit())


def replace_landed_window(rows: DataFrame, path: str, start: date | None = None, end: date | None = None) -> None:
    """Loads a window anew: all landed days from start to end (both included, either optional) go, also
    those that rows no longer hold, and rows come in. Rows outside the window, or without a day,
    are added to what is there; without bounds all are.

    Days that rows hold are swapped by Spark, then the folders of the others are deleted, so
    a load that broke off can be repeated.
    """
    spark = rows.sparkSession
    if start is None and end is None:
        return append_raw(rows, path)
    inside = F.coalesce(in_window("date", start, end), F.lit(False))
    rows = lasting(rows)
    kept = {r[0] for r in rows.filter(inside).select("date").distinct().collect()}  # a window's days
    stale = [d for d in landed_days(spark, path) if d not in kept and (start is None or d >= start) and (end is None or d <= end)]
    if kept:
        overwrite_days(rows.filter(inside), path)
    for day in stale:
        delete(spark, f"{path}/landed_on={day.isoformat()}")
    outside = rows.filter(~inside)
    if outside.limit(1).count():
        append_raw(outside, path)
    return None


def read_raw(spark: SparkSession, path: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """The landed table between two days; other days' folders aren't opened."""
    return spark.read.schema(f"{RAW_SCHEMA}, landed_on date").parquet(path).filter(in_window("landed_on", start, end)).drop("landed_on")


def write_table(rows: DataFrame, path: str) -> None:
    """A full rebuild of a table."""
    rows.write.mode("overwrite").parquet(path)


def category_families(spark: SparkSession) -> DataFrame:
    """The seed of category, category_name and category_family."""
    with (Path(__file__).parent / "category_families.csv").open(newline="") as file:
        rows = list(csv.reader(file))[1:]
    return spark.createDataFrame(rows, "category string, category_name string, category_family string")
