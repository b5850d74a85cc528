"""Late invoice lines as a stream: each micro-batch is put in by key or by day.

The table is kept in a folder per day, and a batch rewrites only the days that it
touches. Their new contents are written aside first; only then are the day folders
swapped. A batch that broke off is repeated from what was written aside, if that
was complete, else from the untouched table, so every repeat ends the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.lasting import delete, exists
from tallyhouse.operators.history import merge_incremental
from tallyhouse.operators.history import replace_days as put_days

DAY = "on_day"
#: How a folder of rows without a day is named.
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as it is now; None before its first batch."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path).drop(DAY)
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _days(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.to_date(column).alias(DAY)).distinct()


def put_batch(batch: DataFrame, path: str, number: int, replace_days: bool = False, key: str = "invoice_item_number", column: str = "order_date") -> None:
    """Puts a batch into the table at path; number tells a repeated batch from a new one.

    With replace_days the batch replaces exactly the days that it holds, and rows
    without a day are added. Else its rows replace those of their keys, also where
    they stood on another day. A column that the table lacks is added.
    """
    spark, aside = batch.sparkSession, f"{path}/_batch-{number}"
    if not exists(spark, f"{aside}/_SUCCESS"):
        target = read_table(spark, path)
        if target is None:
            merged, touched = batch.withColumn(DAY, F.to_date(column)), None
        else:
            touched = _days(batch, column)
            if not replace_days:  # the days of the same keys too: of the table only keys and days are read
                touched = touched.union(_days(target.select(key, column).join(batch.select(key), key, "left_semi"), column)).distinct()
            old = target.join(touched, F.to_date(column).eqNullSafe(F.col(DAY)), "left_semi")
            merged = (put_days(old, batch, column) if replace_days else merge_incremental(old, batch, key, lookback_days=None)).withColumn(DAY, F.to_date(column))
            touched.write.mode("overwrite").parquet(f"{path}/_days-{number}")
        merged.write.mode("overwrite").parquet(aside)
    rows = spark.read.parquet(aside)
    days = spark.read.parquet(f"{path}/_days-{number}") if exists(spark, f"{path}/_days-{number}") else None
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    if days is not None:  # days that lost all their rows
        for (day,) in days.join(rows.select(DAY).distinct(), days[DAY].eqNullSafe(rows[DAY]), "left_anti").collect():
            delete(spark, f"{path}/{DAY}={_NO_DAY if day is None else day.isoformat()}")
    delete(spark, f"{path}/_days-{number}")
    delete(spark, aside)


def upsert_stream(lines: DataFrame, path: str, checkpoint: str, replace_days: bool = False):
    """Starts a query that puts each batch of lines into the table at path, as put_batch does."""
    return lines.writeStream.foreachBatch(lambda batch, number: put_batch(batch, path, number, replace_days)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
