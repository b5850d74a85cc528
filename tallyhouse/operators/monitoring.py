"""Health of the pipeline and of its runs."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.measures import greatest_or_null, ratio
from tallyhouse.operators.quality import lag_days
from tallyhouse.sources.landing import in_window


def _status(days):
    return F.when(days > 14, "ERROR").when(days > 7, "WARN").otherwise("PASS")


def pipeline_health(raw: DataFrame, fact: DataFrame, daily: DataFrame, snap_item: DataFrame, snap_store: DataFrame, velocity: DataFrame, forecast: DataFrame, as_of: datetime) -> DataFrame:
    """One row of counts, bounds, lags and states as observed at as_of; a snapshot without rows passes."""
    live = lambda df, n: df.agg(F.count_if(F.col("dbt_valid_to").isNull()).alias(f"snap_{n}_current_row_count"), F.max("dbt_valid_from").alias(f"snap_{n}_max_valid_from"))
    parts = [
        raw.agg(F.max("loaded_at").alias("raw_max_loaded_at"), F.count("*").alias("raw_row_count")),
        live(snap_item, "item"), live(snap_store, "store"),
        fact.agg(F.count("*").alias("fact_row_count"), F.min("order_date").alias("fact_min_order_date"), F.max("order_date").alias("fact_max_order_date")),
        daily.agg(F.count("*").alias("daily_store_day_count"), F.min("order_date").alias("daily_min_order_date"), F.max("order_date").alias("daily_max_order_date")),
        velocity.agg(F.count("*").alias("sku_velocity_row_count")), forecast.agg(F.count("*").alias("replenishment_forecast_row_count")),
    ]
    one = reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # each is one row
    one = one.withColumns({"raw_lag_days": lag_days(F.col("raw_max_loaded_at"), as_of), "snapshot_lag_days": greatest_or_null(lag_days(F.col("snap_item_max_valid_from"), as_of), lag_days(F.col("snap_store_max_valid_from"), as_of))})
    return one.withColumns({"observed_at": F.lit(as_of).cast("timestamp_ntz"), "freshness_status": _status(F.col("raw_lag_days")), "snapshot_status": _status(F.col("snapshot_lag_days"))})


def landed_window_contract(raw: DataFrame, start: date, end: date, as_of: datetime, max_lag_hours: int = 24) -> DataFrame:
    """One row on the landed days from start to end: counts, bounds, lag in hours and whether it passes."""
    one = raw.filter(in_window("order_date", start, end)).agg(F.count("*").alias("row_count"), F.min("order_date").alias("min_order_date"), F.max("order_date").alias("max_order_date"), F.max("loaded_at").alias("max_loaded_at"))
    hours = (F.unix_timestamp(F.date_trunc("hour", F.lit(as_of).cast("timestamp"))) - F.unix_timestamp(F.date_trunc("hour", F.col("max_loaded_at").cast("timestamp")))) / 3600
    told = one.withColumn("lag_hours", hours.cast("long"))
    fault = F.when(F.col("row_count") == 0, "empty").when(F.col("max_loaded_at").isNull(), "no_load_time").when(F.col("lag_hours") > max_lag_hours, "stale").otherwise("ok")
    return told.withColumn("contract", fault)


def run_status(runs: DataFrame) -> DataFrame:
    """Runs with is_failed, is_degraded and has_warn, the newest first."""
    return runs.withColumns({"is_failed": F.col("final_dag_state") == "failed", "is_degraded": F.col("final_dag_state") == "degraded", "has_warn": (F.col("freshness_status") == "WARN") | (F.col("snapshot_status") == "WARN")}).orderBy(F.col("created_at").desc(), "run_id")


def final_states(tasks: DataFrame) -> DataFrame:
    """The state of each run from its tasks: a failed one fails it, a WARN degrades it."""
    sums = tasks.groupBy("run_id").agg(F.max((F.col("state") == "failed").cast("int")).alias("f"), F.max((F.col("status") == "WARN").cast("int")).alias("w"))
    return sums.select("run_id", F.when(F.col("f") == 1, "failed").when(F.col("w") == 1, "degraded").otherwise("success").alias("final_dag_state"))


def recent_runs(runs: DataFrame, n: int = 20, state: str | None = None) -> DataFrame:
    """The newest runs, of one state if given."""
    return (runs.filter(F.col("final_dag_state") == state) if state else runs).orderBy(F.col("created_at").desc(), "run_id").limit(n)


def troubled_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The newest runs that are degraded or have a warning."""
    return run_status(runs).filter("is_degraded or has_warn").orderBy(F.col("created_at").desc(), "run_id").limit(n)


def duration_by_source(runs: DataFrame) -> DataFrame:
    """Successful runs and their mean duration by source."""
    return runs.filter("final_dag_state = 'success'").groupBy("source").agg(F.count("*").alias("runs"), F.round(F.avg("duration_seconds"), 4).alias("avg_duration_seconds"))


def success_rate(runs: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """By source: runs since so many days before as_of's day, successes and their share in percent."""
    recent = runs.filter(F.col("created_at") >= F.lit(as_of.date() - timedelta(days=days)).cast("timestamp_ntz"))
    counted = recent.groupBy("source").agg(F.count("*").alias("runs"), F.count_if(F.col("final_dag_state") == "success").alias("successes"))
    return counted.withColumn("success_rate_pct", F.round(ratio(F.col("successes") * 100, F.col("runs")), 2))
