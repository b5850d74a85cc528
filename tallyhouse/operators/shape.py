"""Reshaping of report rows for charts: top-n and the rest, pivots, rolling means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.measures import ratio, selling_price, vendor_label, yoy_pct
from tallyhouse.operators.growth import few, top_n_rows

_D = "decimal(20,2)"


def money_sum(column: str) -> Column:
    return F.sum(F.col(column).cast(_D)).cast("double")


#: What names a vendor in a folded mix.
VENDOR = ["vendor_rank", "vendor_number", "vendor_name"]
#: Kinds of report rows from details to the grand total.
ROW_TYPES = ["detail", "subtotal_by_vendor", "subtotal_by_bottle_volume", "subtotal_by_category", "grand_total"]


def ordered(report: DataFrame, *by: str) -> DataFrame:
    """A report's rows as they are printed: by row_type, where there is one, totals last, then by columns, nulls
    last; -column is descending."""
    kind = []
    if "row_type" in report.columns:
        text = report.schema["row_type"].dataType.typeName() == "string"
        kind = [F.array_position(F.array(*map(F.lit, ROW_TYPES)), F.col("row_type")) if text else F.col("row_type")]
    return report.orderBy(*kind, *(F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in by))


def top_n_plus_other(df: DataFrame, label: str, n: int, other: str = "Other") -> DataFrame:
    """The n largest rows by sales_t12m and one for all others; growth is taken from the sums."""
    top = top_n_rows(df, [F.col("sales_t12m").desc_nulls_last(), F.col(label).asc()], n, "__rank").select(F.col(label).alias("__label"), F.lit(True).alias("__top"))
    ranked = df.join(few(top, n), F.col(label).eqNullSafe(F.col("__label")), "left").withColumn("is_other", F.col("__top").isNull())
    folded = ranked.groupBy(F.when(F.col("is_other"), other).otherwise(F.col(label)).alias(label), "is_other").agg(money_sum("sales_t12m").alias("sales_t12m"), money_sum("sales_t12m_prior").alias("sales_t12m_prior"))
    return folded.withColumn("t12m_yoy_pct", yoy_pct(F.col("sales_t12m"), F.col("sales_t12m_prior")))


def top_vendors_plus_other(mix: DataFrame, by: str, n: int) -> DataFrame:
    """A mix by category, segment or channel with vendors beyond rank n folded into rank n + 1; growth is
    taken from the sums. Units are summed where the mix has them."""
    top = F.col("vendor_rank") <= n
    other = {"vendor_rank": F.lit(n + 1), "vendor_number": F.lit("Other"), "vendor_name": F.lit("Other Vendors")}
    sums = [money_sum(c).alias(c) for c in ("sales_t12m", "sales_t12m_prior")] + [F.sum(c).cast("long").alias(c) for c in ("units_t12m",) if c in mix.columns]
    folded = mix.filter("row_type = 'detail'").groupBy(*(F.when(top, F.col(c)).otherwise(other[c]).alias(c) for c in VENDOR), by).agg(*sums)
    return folded.withColumn("t12m_yoy_pct", yoy_pct(F.col("sales_t12m"), F.col("sales_t12m_prior")))


def pivot_mix(mix: DataFrame, rows: str | list[str], by: str, values: list[str], measure: str = "sales_t12m") -> DataFrame:
    """A column for each listed value of by, in that order; zero where there is nothing."""
    return mix.groupBy(*([rows] if isinstance(rows, str) else rows)).pivot(by, values).agg(money_sum(measure)).fillna(0.0, values)


def vendor_totals(folded: DataFrame) -> DataFrame:
    """Sales, units and price of each vendor of a folded mix."""
    sums = folded.groupBy(*VENDOR).agg(money_sum("sales_t12m").alias("sales_t12m"), F.sum("units_t12m").cast("long").alias("units_t12m"))
    return sums.withColumn("avg_selling_price", selling_price(F.col("sales_t12m"), F.col("units_t12m")))


def chains_with_tail(chains: DataFrame, n: int, forced: str = "INDEPENDENT", tail: str = "Independent + Other") -> DataFrame:
    """The n largest chains and a tail that always holds the forced label."""
    is_forced = F.upper("chain") == forced.upper()
    ranked = chains.withColumn("__rank", F.row_number().over(Window.partitionBy(is_forced).orderBy(F.col("sales_t12m").desc(), "chain")))
    folded = ranked.groupBy(F.when(~is_forced & (F.col("__rank") <= n), F.col("chain")).otherwise(tail).alias("chain")).agg(money_sum("sales_t12m").alias("sales_t12m"), money_sum("sales_t12m_prior").alias("sales_t12m_prior"))
    return folded.withColumn("t12m_yoy_pct", yoy_pct(F.col("sales_t12m"), F.col("sales_t12m_prior")))


def rolling_mean(trend: DataFrame, months: int = 3) -> DataFrame:
    """Monthly sales by vendor label and their mean over up to so many months."""
    monthly = trend.groupBy(vendor_label(F.col("vendor_name")).alias("vendor"), "sales_month").agg(money_sum("sales_dollars").alias("sales"))
    back = Window.partitionBy("vendor").orderBy("sales_month").rowsBetween(1 - months, 0)
    return monthly.withColumn("rolling_sales", F.round(F.sum(F.col("sales").cast(_D)).over(back).cast("double") / F.count("*").over(back), 4))


def first_and_last(share: DataFrame) -> DataFrame:
    """The rows of the first and the last period; one, if they are the same."""
    ends = share.agg(F.min("period_order").alias("__last"), F.max("period_order").alias("__first"))
    return share.join(F.broadcast(ends), F.col("period_order").isin(F.col("__first"), F.col("__last"))).drop("__first", "__last")  # one row


def period_shares(share: DataFrame, n: int) -> DataFrame:
    """The first and the last period's n largest vendors with rank and share, the others of the period as one row."""
    ranked = first_and_last(share).withColumn("rank", F.row_number().over(Window.partitionBy("period_order").orderBy(F.col("sales_t12m").desc(), "vendor_name", "vendor_number")))
    top = F.col("rank") <= n
    folded = ranked.groupBy("period_order", "period_year", F.when(top, F.col("vendor_name")).otherwise("Other").alias("vendor_name"), F.when(top, F.col("rank")).otherwise(n + 1).alias("rank")).agg(money_sum("sales_t12m").alias("sales_t12m"))
    own = F.sum(F.col("sales_t12m").cast(_D)).over(Window.partitionBy("period_order"))
    return folded.withColumn("share_pct", F.round(ratio(F.col("sales_t12m") * 100, own), 4))


def brand_cagr(share: DataFrame, brands: list[tuple[str, str]]) -> DataFrame:
    """A row for each (brand, text): trailing-year sales of the vendors whose name holds the text, in any case, in the first
    and the last period, and their compound growth a year; null with fewer than two years, or without sales in both."""
    listed = share.sparkSession.createDataFrame([(b, t.upper()) for b, t in brands], "brand string, __text string")
    sums = first_and_last(share).join(F.broadcast(listed), F.upper("vendor_name").contains(F.col("__text"))).groupBy("brand", "period_year").agg(money_sum("sales_t12m").alias("s"))  # the brands listed
    by_brand = sums.groupBy("brand").agg(F.min("period_year").alias("first_year"), F.max("period_year").alias("last_year"), F.min_by("s", "period_year").alias("sales_first"), F.max_by("s", "period_year").alias("sales_last"))
    grown = (F.col("sales_first") > 0) & (F.col("sales_last") > 0) & (F.col("last_year") > F.col("first_year"))
    rate = F.pow(F.col("sales_last") / F.col("sales_first"), F.lit(1.0) / (F.col("last_year") - F.col("first_year")))
    return F.broadcast(listed.select("brand")).join(by_brand, "brand", "left").withColumn("cagr_pct", F.when(grown, F.round((rate - 1) * 100, 4)))


def tier_grid(matrix: DataFrame, tiers: list[str], measure: str) -> DataFrame:
    """The tier matrix with every tier on both axes, zero where no SKU is."""
    axis = matrix.sparkSession.createDataFrame([(t,) for t in tiers], "volume_tier string")
    return F.broadcast(axis).join(pivot_mix(matrix, "volume_tier", "revenue_tier", tiers, measure), "volume_tier", "left").fillna(0.0)


def family_tiers(by_family: DataFrame, tiers: list[str], n: int, dimension: str = "volume") -> DataFrame:
    """The n families of most SKUs with their share of SKUs in each tier of a dimension, volume or revenue."""
    own = by_family.filter(F.col("dimension") == dimension)
    sizes = own.groupBy("category_family").agg(F.sum("sku_count").cast("long").alias("skus"))
    top = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("skus").desc(), "category_family"))).filter(F.col("__rank") <= n).drop("__rank")
    shares = own.groupBy("category_family").pivot("tier", tiers).agg(F.max("sku_share")).fillna(0.0)
    return F.broadcast(top).join(shares, "category_family").orderBy(F.col(tiers[-1]).desc(), "category_family")
