"""Data-quality operators; each returns the rows that break its rule."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.staging import unlabeled_negative_returns


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Values that several rows hold; nulls don't count."""
    filled = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return df.filter(filled).groupBy(*columns).count().filter("count > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).count().filter(~F.col(column).isin(values))


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key no parent has; null keys don't count."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def lag_days(newest, as_of: datetime):
    """Calendar days between two times."""
    return F.datediff(F.lit(as_of).cast("date"), F.to_date(newest))


def freshness(df: DataFrame, column: str, as_of: datetime, warn: int = 7, error: int = 14) -> DataFrame:
    """One row: newest value, days since, and PASS, WARN or ERROR; a table without values is an ERROR."""
    one = df.agg(F.max(column).alias("newest")).withColumn("lag_days", lag_days(F.col("newest"), as_of))
    return one.withColumn("status", F.when(F.col("lag_days").isNull() | (F.col("lag_days") > error), "ERROR").when(F.col("lag_days") > warn, "WARN").otherwise("PASS"))


def history_coverage(fact: DataFrame, history: DataFrame) -> DataFrame:
    """Items of the fact without any version; null counts as one. Days don't matter, see uncovered_lines."""
    return fact.select("item_number").distinct().join(history.select("item_number"), "item_number", "left_anti")


def uncovered_lines(fact: DataFrame, history: DataFrame) -> DataFrame:
    """Lines without a version that was valid on their day."""
    on = (F.col("f.item_number") == F.col("h.item_number")) & (F.col("f.order_date") >= F.col("h.business_valid_from")) & (F.col("h.business_valid_to").isNull() | (F.col("f.order_date") <= F.col("h.business_valid_to")))
    return fact.alias("f").join(history.alias("h"), on, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Keys on which two tables differ in a measure; a missing row or value counts as zero."""
    a, b = left.select(*keys, *(F.col(m).alias(f"l_{m}") for m in measures)), right.select(*keys, *(F.col(m).alias(f"r_{m}") for m in measures))
    return a.join(b, keys, "full_outer").filter(reduce(lambda x, y: x | y, (F.coalesce(f"l_{m}", F.lit(0)) != F.coalesce(f"r_{m}", F.lit(0)) for m in measures)))


def day_checksums(df: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """day, the number of its rows and two sums of 64-bit hashes over columns, which don't depend on the order of rows. Null and
    zero measures are the same if they are made so before."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)"))
    return df.groupBy(day).agg(F.count("*").alias("n"), total(1).alias("s1"), total(2).alias("s2"))


def differing_days(left: DataFrame, right: DataFrame, day: str, columns: list[str]) -> list:
    """The days whose rows aren't the same on both sides, by checksums; null is a day. Looked up at once, a row a day."""
    a, b = day_checksums(left, day, columns).alias("a"), day_checksums(right, day, columns).alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "s1", "s2")))
    found = a.join(b, F.col(f"a.{day}").eqNullSafe(F.col(f"b.{day}")), "full_outer").filter(~same)
    return [r[0] for r in found.select(F.coalesce(f"a.{day}", f"b.{day}")).collect()]


def reconcile_days(left: DataFrame, right: DataFrame, day: str, keys: list[str], measures: list[str]) -> DataFrame:
    """reconcile over day and keys, made for the days alone whose checksums differ; equal days are never joined.

    Each side is read for its checksums first (two hashes of 64 bits a row, summed), then again
    for the differing days, which are literals, so that a table sorted or foldered by day is opened there only. A null day or key
    matches nothing, as in reconcile, so a row with one differs, unless both sides hold the same rows on its day.
    """
    kind = {m: _common(left.schema[m].dataType, right.schema[m].dataType) for m in measures}
    plain = lambda df: df.select(day, *keys, *(F.coalesce(F.col(m).cast(kind[m]), F.lit(0).cast(kind[m])).alias(m) for m in measures))
    left, right = plain(left), plain(right)
    days = differing_days(left, right, day, [*keys, *measures])
    dated = [d for d in days if d is not None]
    inside = F.col(day).isin(dated) if dated else F.lit(False)
    inside = inside | F.col(day).isNull() if None in days else inside
    return reconcile(left.filter(inside), right.filter(inside), [day, *keys], measures)


def _common(*types) -> str:
    """A type that holds the values of numeric columns alike."""
    if any(t.typeName() in ("float", "double") for t in types):
        return "double"
    return f"decimal(38,{max(getattr(t, 'scale', 0) for t in types)})"


def overlapping_windows(history: DataFrame, key: str = "item_number") -> DataFrame:
    """Versions that reach past the start of a later one of their key; by a running maximum, not a self join."""
    order = Window.partitionBy(key).orderBy("business_valid_from", F.col("business_valid_to").asc_nulls_last())
    open_end = F.coalesce("business_valid_to", F.lit("9999-12-31").cast("date"))
    reached = F.max(open_end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("__reached", reached).filter(F.col("__reached") >= F.col("business_valid_from")).drop("__reached")


def one_current_row(history: DataFrame, key: str = "item_number") -> DataFrame:
    """Keys with another number of current rows than one, none included."""
    return history.groupBy(key).agg(F.sum(F.col("is_current").cast("int")).alias("n_current")).filter("n_current <> 1")


def negative_only_on_returns(sales: DataFrame) -> DataFrame:
    """Lines that aren't returns with a negative amount, units, litres or gallons."""
    return unlabeled_negative_returns(sales).drop("anomaly")


def days_lost(raw: DataFrame, staged: DataFrame, raw_column: str = "order_date") -> DataFrame:
    return raw.select(F.col(raw_column).alias("order_date")).distinct().join(staged.select("order_date").distinct(), "order_date", "left_anti")


def retail_below_cost(df: DataFrame) -> DataFrame:
    """Staged lines whose retail price is below their cost; a missing price breaks no rule."""
    return df.filter("state_bottle_retail < state_bottle_cost")


def negative_velocity(df: DataFrame) -> DataFrame:
    return df.filter("total_units_sold < 0 or total_revenue < 0")


def share_out_of_bounds(df: DataFrame) -> DataFrame:
    return df.filter("cumulative_units_pct < 0 or cumulative_units_pct > 1 or cumulative_revenue_pct < 0 or cumulative_revenue_pct > 1")


def negative_shipment(df: DataFrame) -> DataFrame:
    return df.filter("recommended_ship_qty < 0")


@dataclass
class Check:
    """A named rule with its breaking rows; severity is error or warn."""

    name: str
    rows: DataFrame
    severity: str = "error"
    tags: list[str] = field(default_factory=list)


def run_suite(checks: list[Check], tags: list[str] | None = None) -> DataFrame:
    """One row per check (with one of the tags, if any are given): name, severity, tag, n_fail, status."""
    wanted = [c for c in checks if not tags or set(tags) & set(c.tags)]
    counted = [c.rows.agg(F.count("*").alias("n_fail")).select(F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"), F.lit(",".join(c.tags)).alias("tag"), "n_fail") for c in wanted]
    return reduce(DataFrame.unionByName, counted).withColumn("status", F.when(F.col("n_fail") == 0, "pass").otherwise(F.col("severity")))
