"""Growth reports: sums over periods, year-on-year change and subtotals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import ladders
from tallyhouse.functions.calendar import add_months, annual_periods, cagr_years, period_bounds
from tallyhouse.functions.measures import cagr_pct, in_list, total, yoy_pct
from tallyhouse.sources.months import in_days

UNKNOWN = {"vendor_number": "Unknown Vendor Number", "vendor_name": "Unknown Vendor", "item_description": "Unknown Item", "bottle_volume_ml": "Unknown Bottle Volume", "chain": "Unknown Chain"}
T12M = ("t12m",)
ALL_PERIODS = ("month", "t3m", "t12m")


def within(window: tuple[date, date], column: str = "order_date") -> Column:
    return (F.col(column) >= F.lit(window[0])) & (F.col(column) < F.lit(window[1]))


def period_sums(windows: dict[str, tuple[date, date]], value: str = "sale_dollars", prefix: str = "sales") -> list[Column]:
    """A conditional sum per window, all in one pass; rows outside count as zero."""
    return [total(F.when(within(w), F.col(value)).otherwise(0)).alias(f"{prefix}_{name}") for name, w in windows.items()]


def _bounds(month_start: date, periods: tuple[str, ...]) -> dict[str, tuple[date, date]]:
    every = period_bounds(month_start)
    return {n: every[n] for p in periods for n in (p, f"{p}_prior")}


def with_yoy(df: DataFrame, periods: tuple[str, ...]) -> DataFrame:
    return df.withColumns({f"{p}_yoy_pct": yoy_pct(F.col(f"sales_{p}"), F.col(f"sales_{p}_prior")) for p in periods})


def labelled_lines(fact: DataFrame, items: DataFrame, *more: str) -> DataFrame:
    """Fact lines with their item's labels; missing labels get their Unknown name."""
    labels = ["category_name", "category_family", "vendor_number", "vendor_name", "bottle_volume_ml", "item_description"]
    named = items.select("item_number", *(F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN[c])).alias(c) if c in UNKNOWN else c for c in labels))
    return fact.select("item_number", "store_number", "order_date", "sale_dollars", "bottles_sold", *more).join(named, "item_number")


def grouped_sets(df: DataFrame, columns: list[str], sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """Several groupings in one aggregation, with a grouping flag g_<column> for each."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)).agg(*aggregates, *(F.grouping(c).alias(f"g_{c}") for c in columns))


def with_grand_total(detail: DataFrame, label: str, sums: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """detail with row_type, and one row that sums it up; other columns are null there."""
    summed = detail.agg(*(F.sum(F.col(c).cast("decimal(20,2)")).cast(detail.schema[c].dataType).alias(c) for c in sums))
    return detail.withColumn("row_type", F.lit("detail")).unionByName(summed.withColumns({"row_type": F.lit("grand_total"), label: F.lit("Grand Total")} | (extra or {})), allowMissingColumns=True)


def family_growth(fact: DataFrame, items: DataFrame, month_start: date, trend_years: int = 3) -> DataFrame:
    """Growth of each listed family, with sales of the first and last trend year; families without sales are zero."""
    first, last = cagr_years(month_start, trend_years)
    windows = _bounds(month_start, ALL_PERIODS) | {"cagr_start_year": first, "cagr_end_year": last}
    sums = labelled_lines(fact, items).groupBy("category_family").agg(*period_sums(windows), F.lit(first[0].year).alias("cagr_start_year"), F.lit(last[0].year).alias("cagr_end_year"))
    names = [f"sales_{n}" for n in windows]
    listed = fact.sparkSession.createDataFrame([(f,) for f in ladders.FAMILIES], "category_family string")
    detail = F.broadcast(listed).join(sums, "category_family", "left").fillna(0.0, names)
    years = detail.agg(F.max("cagr_start_year").alias("cagr_start_year"), F.max("cagr_end_year").alias("cagr_end_year"), *(F.sum(F.col(c).cast("decimal(20,2)")).cast("double").alias(c) for c in names))
    grand = years.withColumns({"category_family": F.lit("Grand Total"), "row_type": F.lit("grand_total")})
    return with_yoy(detail.withColumn("row_type", F.lit("detail")).unionByName(grand), ALL_PERIODS)


def family_drilldown(fact: DataFrame, items: DataFrame, month_start: date, family: str) -> DataFrame:
    """Trailing-year growth of a family's categories; row_type 0, total 1."""
    lines = labelled_lines(fact, items).filter(F.col("category_family") == family)
    detail = lines.groupBy("category_name").agg(*period_sums(_bounds(month_start, T12M)))
    out = with_yoy(with_grand_total(detail, "category_name", ["sales_t12m", "sales_t12m_prior"]), T12M)
    return out.withColumn("row_type", (F.col("row_type") == "grand_total").cast("int"))


def vendor_volume_growth(fact: DataFrame, items: DataFrame, month_start: date, category_name: str, vendors=None, volumes=None) -> DataFrame:
    """Growth of a category by vendor and bottle size, with subtotals of either."""
    lines = labelled_lines(fact, items).filter((F.col("category_name") == category_name) & in_list(F.col("vendor_number"), vendors, True) & in_list(F.col("bottle_volume_ml"), volumes))
    c = ["category_name", "vendor_number", "vendor_name", "bottle_volume_ml"]
    sets = grouped_sets(lines, c, [c, c[:3], [c[0], c[3]], c[:1], []], period_sums(_bounds(month_start, ALL_PERIODS)))
    g = lambda n: F.col(f"g_{n}") == 1
    kind = F.when(g("category_name"), "grand_total").when(~g("vendor_number") & ~g("bottle_volume_ml"), "detail").when(~g("vendor_number"), "subtotal_by_vendor").when(~g("bottle_volume_ml"), "subtotal_by_bottle_volume").otherwise("subtotal_by_category")
    name = F.col("category_name")
    label = F.when(g("category_name"), "Grand Total").when(~g("vendor_number") & g("bottle_volume_ml"), F.concat(F.lit("Subtotal by Vendor: "), name)).when(g("vendor_number") & ~g("bottle_volume_ml"), F.concat(F.lit("Subtotal by Bottle Volume: "), name)).when(g("vendor_number"), F.concat(F.lit("Subtotal: "), name)).otherwise(name)
    return with_yoy(sets.withColumns({"row_type": kind, "category_name": label}), ALL_PERIODS).drop(*(f"g_{x}" for x in c))


def family_vendor_growth(fact: DataFrame, items: DataFrame, month_start: date, family: str) -> DataFrame:
    """Growth of a family by vendor, with its total."""
    lines = labelled_lines(fact, items).filter(F.col("category_family") == family)
    c = ["category_family", "vendor_number", "vendor_name"]
    sets = grouped_sets(lines, c, [c, c[:1], []], period_sums(_bounds(month_start, ALL_PERIODS)))
    grand, vendor = F.col("g_category_family") == 1, F.col("g_vendor_number") == 0
    kind = F.when(grand, "grand_total").when(vendor, "subtotal_by_vendor").otherwise("subtotal_by_category")
    label = F.when(grand, "Grand Total").when(vendor, F.concat(F.lit("Subtotal by Vendor: "), "category_family")).otherwise(F.concat(F.lit("Subtotal: "), "category_family"))
    return with_yoy(sets.withColumns({"row_type": kind, "category_name": label, "bottle_volume_ml": F.lit(None).cast("string")}), ALL_PERIODS).drop(*(f"g_{x}" for x in c), "category_family")


def item_growth(fact: DataFrame, items: DataFrame, month_start: date, scope: str, value: str, vendors=None, volumes=None) -> DataFrame:
    """Growth by item and vendor in a category_name or category_family, with the total."""
    lines = labelled_lines(fact, items).filter((F.col(scope) == value) & in_list(F.col("vendor_number"), vendors, True) & in_list(F.col("bottle_volume_ml"), volumes))
    bounds = _bounds(month_start, ALL_PERIODS)
    detail = lines.groupBy("item_number", "item_description", "vendor_number", "vendor_name", "bottle_volume_ml").agg(*period_sums(bounds))
    return with_yoy(with_grand_total(detail, "item_description", [f"sales_{n}" for n in bounds]), ALL_PERIODS)


def chain_growth(fact: DataFrame, items: DataFrame, stores: DataFrame, month_start: date, category_name: str, vendors=None, volumes=None) -> DataFrame:
    """Growth of a category by store chain, with the total; lines of unknown stores don't count."""
    lines = labelled_lines(fact, items).filter((F.col("category_name") == category_name) & in_list(F.col("vendor_number"), vendors, True) & in_list(F.col("bottle_volume_ml"), volumes))
    chains = stores.select("store_number", F.coalesce("chain", F.lit(UNKNOWN["chain"])).alias("chain"))
    bounds = _bounds(month_start, ALL_PERIODS)
    detail = lines.join(chains, "store_number").groupBy("chain").agg(*period_sums(bounds))
    return with_yoy(with_grand_total(detail, "chain", [f"sales_{n}" for n in bounds]), ALL_PERIODS)


def vendor_category_mix(fact: DataFrame, items: DataFrame, month_start: date, family: str) -> DataFrame:
    """A family's categories by vendor; vendors are ranked by number and name together."""
    lines = labelled_lines(fact, items).filter(F.col("category_family") == family)
    detail = lines.groupBy("category_name", "vendor_number", "vendor_name").agg(*period_sums(_bounds(month_start, T12M)))
    totals = detail.groupBy("vendor_number", "vendor_name").agg(F.sum(F.col("sales_t12m").cast("decimal(20,2)")).alias("t"))
    ranks = totals.select("vendor_number", "vendor_name", F.row_number().over(Window.orderBy(F.col("t").desc(), "vendor_name", "vendor_number")).alias("vendor_rank"))
    return with_yoy(with_grand_total(detail.join(ranks, ["vendor_number", "vendor_name"]), "category_name", ["sales_t12m", "sales_t12m_prior"]), T12M)


def vendor_share_by_year(fact: DataFrame, items: DataFrame, month_start: date, family: str, trend_years: int = 3) -> DataFrame:
    """Trailing-year sales of a family's vendors at each anchor year; one pass, unpivoted; zeros are left out."""
    periods = annual_periods(month_start, trend_years)
    lines = labelled_lines(in_days(fact, (periods[-1][0], periods[0][1])), items).filter(F.col("category_family") == family)
    sums = lines.groupBy("vendor_number", "vendor_name").agg(*period_sums({str(k): w for k, w in enumerate(periods)}))
    anchor = [add_months(month_start, -12 * k) for k in range(trend_years)]
    rows = F.array(*(F.struct(F.lit(k).alias("period_order"), F.lit(d.year).alias("period_year"), F.date_format(F.lit(d), "MMM yyyy").alias("period_label"), F.col(f"sales_{k}").alias("sales_t12m")) for k, d in enumerate(anchor)))
    return sums.select("vendor_number", "vendor_name", F.inline(rows)).filter("sales_t12m > 0")


def vendor_monthly_trend(fact: DataFrame, items: DataFrame, start: date, end: date, scope: str, value: str, top_n: int = 5) -> DataFrame:
    """Monthly sales of the top vendors of a family or category; end is the last month's first day."""
    lines = labelled_lines(in_days(fact, (start, add_months(end, 1))), items).filter(F.col(scope) == value)
    by_vendor = lines.groupBy("vendor_number", "vendor_name").agg(F.sum("sale_dollars").alias("t"))
    top = top_n_rows(by_vendor, [F.col("t").desc(), F.col("vendor_name").asc(), F.col("vendor_number").asc()], top_n, "vendor_rank").drop("t")
    return lines.join(few(top, top_n), ["vendor_number", "vendor_name"]).groupBy(F.trunc("order_date", "month").alias("sales_month"), F.col(scope).alias("scope_name"), "vendor_number", "vendor_name", "vendor_rank").agg(total("sale_dollars").alias("sales_dollars"))


#: So many rows of a known count are broadcast at most; for more Spark decides by size.
FEW = 10_000


def few(df: DataFrame, n: int) -> DataFrame:
    """df, which has n rows at most, with a broadcast hint if they are few."""
    return F.broadcast(df) if n <= FEW else df


def top_n_rows(df: DataFrame, order: list[Column], n: int, rank: str, by: list[str] | None = None) -> DataFrame:
    """The first n rows in an order, with their rank; by groups if by is given. Each task passes on n rows
    (of a group) at most, so one task numbers n rows for each of them."""
    if by:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def with_cagr(growth: DataFrame, span: int) -> DataFrame:
    """family_growth with compound growth over its trend years."""
    return growth.withColumn("cagr_pct", cagr_pct(F.col("sales_cagr_start_year"), F.col("sales_cagr_end_year"), span))


