"""Store productivity by chain and channel, from the store-day mart."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import trailing_weeks
from tallyhouse.functions.measures import ratio, selling_price
from tallyhouse.operators.growth import few, top_n_rows
from tallyhouse.sources.months import in_days


def _stores(daily: DataFrame, stores: DataFrame, day: date, weeks: int, column: str, missing: str) -> DataFrame:
    sums = in_days(daily, trailing_weeks(day, weeks)).groupBy("store_number").agg(F.sum("total_sales_dollars").cast("decimal(20,2)").alias("sales"))
    return sums.join(stores.select("store_number", column), "store_number", "left").withColumn(column, F.coalesce(column, F.lit(missing)))


def _productivity(groups: DataFrame, by: str, market: DataFrame) -> DataFrame:
    money = F.col("sales").cast("double")
    return groups.join(F.broadcast(market)).select(by, money.alias("total_sales"), "store_count", selling_price(F.col("sales"), F.col("store_count"), 4).alias("avg_sales_per_store"), F.round(ratio(money, F.col("market")), 6).alias("pct_of_market"))  # market is one row


def chain_performance(daily: DataFrame, stores: DataFrame, day: date, weeks: int = 52, top_n: int = 10, other: str = "Other") -> DataFrame:
    """Sales, stores, sales a store and share of the top chains and all others together."""
    lines = _stores(daily, stores, day, weeks, "chain", "UNKNOWN")
    chains = lines.groupBy("chain").agg(F.sum("sales").cast("decimal(20,2)").alias("sales"), F.count_distinct("store_number").alias("store_count"))
    top = top_n_rows(chains, [F.col("sales").desc(), F.col("chain").asc()], top_n, "__rank").select(F.col("chain").alias("__top"))
    ranked = chains.join(few(top, top_n), F.col("chain") == F.col("__top"), "left")
    groups = ranked.groupBy(F.coalesce("__top", F.lit(other)).alias("chain_group")).agg(F.sum("sales").alias("sales"), F.sum("store_count").alias("store_count"))
    return _productivity(groups, "chain_group", chains.agg(F.sum("sales").alias("market")))


def channel_performance(daily: DataFrame, stores: DataFrame, day: date, weeks: int = 52) -> DataFrame:
    """Sales, stores, sales a store and share of each channel."""
    lines = _stores(daily, stores, day, weeks, "store_channel", "Unknown")
    groups = lines.groupBy("store_channel").agg(F.sum("sales").cast("decimal(20,2)").alias("sales"), F.count_distinct("store_number").alias("store_count"))
    return _productivity(groups, "store_channel", lines.agg(F.sum("sales").alias("market")))
