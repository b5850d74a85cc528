"""Current attributes, change-point history, snapshots and joins as of a day."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import ladders
from tallyhouse.functions.lasting import lasting
from tallyhouse.operators.staging import latest_per_key
from tallyhouse.sources.months import MONTH, in_days, replace_months

ITEM = ["item_description", "category", "category_name", "vendor_number", "vendor_name", "bottle_volume_ml", "pack", "state_bottle_cost", "state_bottle_retail"]
STORE = ["store_name", "address", "city", "zip_code", "store_location", "county_number", "county"]


def newest_first(df: DataFrame) -> list[Column]:
    ties = [F.col(c).desc_nulls_last() for c in ("invoice_item_number", "tie_supp") if c in df.columns]
    return [F.col("order_date").desc_nulls_last(), F.col("loaded_at").desc_nulls_first(), *ties]


def category_family(df: DataFrame, families: DataFrame, default: str | None = "Other") -> DataFrame:
    """Adds category_family; categories in no family get the default. Spark broadcasts the map, a seed of a few dozen rows, by its size."""
    return df.join(families.select("category", "category_family"), "category", "left").withColumn("category_family", F.coalesce("category_family", F.lit(default)))


def item_attributes_current(sales: DataFrame, families: DataFrame) -> DataFrame:
    """The newest attributes of each item, with its family."""
    return item_columns(latest_per_key(sales.filter("item_number is not null"), ["item_number"], newest_first(sales)), families)


def item_columns(newest: DataFrame, families: DataFrame) -> DataFrame:
    """item_attributes_current of the newest row of each item."""
    return category_family(newest.select("item_number", *ITEM), families)


def store_attributes_current(sales: DataFrame) -> DataFrame:
    """The newest attributes of each store; chain and channel are derived once per store."""
    return store_columns(latest_per_key(sales.filter("store_number is not null"), ["store_number"], newest_first(sales)))


def store_columns(newest: DataFrame) -> DataFrame:
    """store_attributes_current of the newest row of each store."""
    name = F.col("store_name")
    return newest.select("store_number", *STORE).withColumns({"chain": ladders.name_ladder(name, ladders.CHAIN_RULES, ladders.CHAIN_DEFAULT), "store_channel": ladders.name_ladder(name, ladders.CHANNEL_RULES, ladders.CHANNEL_DEFAULT)})


def scd2_from_changes(sales: DataFrame, key: str = "item_number", day: str = "order_date", attributes: list[str] = ITEM) -> DataFrame:
    """Versions of a key by the days on which an attribute changed.

    The last row of a day counts. Null, '' and -1 are the same value, and a row
    after a null first attribute always starts a version. Versions end the day
    before the next; the last has no end and is_current. One shuffle serves all windows.
    """
    points = _change_points(_last_of_days(sales, key, day, attributes), key, day, attributes)
    return _with_ends(points.select(key, *attributes, F.col(day).alias("business_valid_from"), F.col("loaded_at").alias("source_loaded_at")), key)


def _last_of_days(sales: DataFrame, key: str, day: str, attributes: list[str]) -> DataFrame:
    ties = [F.col(c).desc_nulls_last() for c in ("invoice_item_number", "tie_supp") if c in sales.columns]
    return latest_per_key(sales.filter(F.col(key).isNotNull()), [key, day], [F.col("loaded_at").desc_nulls_first(), *ties]).select(key, day, "loaded_at", *attributes)


def _change_points(daily: DataFrame, key: str, day: str, attributes: list[str]) -> DataFrame:
    """The days on which a key's attributes are others than on its day before."""
    before = F.lag(F.struct(*attributes)).over(Window.partitionBy(key).orderBy(day))
    kind = {f.name: f.dataType.typeName() for f in daily.schema.fields}
    blank = lambda c, name: F.coalesce(c, F.lit("") if kind[name] == "string" else F.lit(-1))
    seen = daily.withColumn("__before", before)
    changed = reduce(lambda a, b: a | b, (blank(F.col(a), a) != blank(F.col(f"__before.{a}"), a) for a in attributes), F.col(f"__before.{attributes[0]}").isNull())
    return seen.filter(changed).drop("__before")


def _with_ends(points: DataFrame, key: str) -> DataFrame:
    """Versions end the day before the next of their key; the last is current."""
    ends = F.date_sub(F.lead("business_valid_from").over(Window.partitionBy(key).orderBy("business_valid_from")), 1)
    return points.withColumn("business_valid_to", ends).withColumn("is_current", F.col("business_valid_to").isNull())


def touched_items(before: DataFrame, load: DataFrame, key: str = "item_number", day: str = "order_date", line: str = "invoice_item_number") -> DataFrame:
    """key and first_day of the items that a load touches: the earliest day of its lines and of the lines in before that they
    replace, or null if one of them has no day."""
    replaced = before.select(line, key, day).join(load.select(line), line, "left_semi")
    days = load.select(line, key, day).unionByName(replaced).filter(F.col(key).isNotNull())
    first = F.when(F.count_if(F.col(day).isNull()) == 0, F.min(day))
    return days.groupBy(key).agg(first.alias("first_day"))


def update_history(history: DataFrame, sales: DataFrame, touched: DataFrame, key: str = "item_number", day: str = "order_date", attributes: list[str] = ITEM) -> DataFrame:
    """scd2_from_changes of sales, made from the history before a load and the lines of touched items alone.

    touched has key and first_day (null: the whole item). A touched item keeps its versions from before that day; the last
    of them is the state that the item's lines of that day and later are compared with. A state whose first
    attribute is '' doesn't tell whether a null followed it, so such items are made anew from all their lines. Other
    items' versions are passed on as they are, and their lines aren't shuffled; with sales in month folders only
    months from the earliest touched day on are opened, unless an item is made anew. That day is looked up at once.
    """
    touched = lasting(touched)  # four readers
    old = history.join(touched.withColumn("__touched", F.lit(True)), key, "left")
    untouched = old.filter(F.col("__touched").isNull()).select(history.columns)
    earlier = old.filter(F.col("__touched") & (F.col("business_valid_from") < F.col("first_day")))
    state = F.max_by(attributes[0], "business_valid_from")
    unclear = earlier.groupBy(key).agg(state.alias("__state")).filter(F.col("__state") == "").select(key, F.lit(True).alias("__anew"))
    since = lasting(touched.join(unclear, key, "left").select(key, F.when(F.col("__anew").isNull(), F.col("first_day")).alias("first_day")))
    first, anew = since.agg(F.min("first_day"), F.count_if(F.col("first_day").isNull())).first()
    lines = sales if anew or first is None else in_days(sales, (first, None), day=day)
    later = lines.join(since, key).filter(F.col("first_day").isNull() | (F.col(day) >= F.col("first_day")))
    kept = earlier.drop("first_day", "__touched").join(since, key).filter(F.col("first_day").isNotNull()).select(history.columns)
    newest = Window.partitionBy(key).orderBy(F.col("business_valid_from").desc())
    states = kept.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").select(key, F.col("business_valid_from").alias(day), F.col("source_loaded_at").alias("loaded_at"), *attributes, F.lit(True).alias("__state"))
    daily = _last_of_days(later, key, day, attributes).withColumn("__state", F.lit(False)).unionByName(states)
    points = _change_points(daily, key, day, attributes).filter(~F.col("__state"))
    fresh = points.select(key, *attributes, F.col(day).alias("business_valid_from"), F.col("loaded_at").alias("source_loaded_at"))
    return untouched.unionByName(_with_ends(kept.select(fresh.columns).unionByName(fresh), key).select(history.columns))


def price_position(history: DataFrame, families: DataFrame) -> DataFrame:
    """Adds family, bundle flag, effective size, size and price tiers and the price segment."""
    volume = F.col("bottle_volume_ml")
    sized = category_family(history, families).withColumns({
        "is_bundle_pack": ladders.is_bundle(F.col("item_description")),
        "effective_bottle_volume_ml": F.when(volume <= 0, None).when(volume.between(680, 720), 750).otherwise(volume),
        "package_size_tier": ladders.ladder(ladders.PACKAGE_SIZES, "jumbo_value"),
    })
    priced = sized.withColumns({
        "price_per_100ml": F.when(~F.col("is_bundle_pack") & (F.col("effective_bottle_volume_ml") > 0), F.round(F.col("state_bottle_retail").cast("decimal(12,2)") * 100 / F.col("effective_bottle_volume_ml"), 2).cast("decimal(12,2)")),
        "retail_price_tier": ladders.ladder(ladders.RETAIL_TIERS, "1000_plus"),
        "price_per_100ml_tier": ladders.ladder(ladders.PRICE_TIERS, "20_plus"),
    })
    return priced.withColumn("price_position_segment", ladders.ladder(ladders.SEGMENTS, "other"))


DIM_HISTORY = ["item_number", *ITEM[:3], "category_family", *ITEM[3:], "business_valid_from", "business_valid_to", "is_current", "source_loaded_at", "is_bundle_pack", "effective_bottle_volume_ml", "package_size_tier", "price_per_100ml", "retail_price_tier", "price_per_100ml_tier", "price_position_segment"]


def dim_item_business_history(priced: DataFrame) -> DataFrame:
    return priced.select(DIM_HISTORY)


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, from_col: str, to_col: str, closed: bool = True, how: str = "inner") -> DataFrame:
    """left with the row of right that is valid at left's time; an open end is null.

    An equi-join on the key with the range as condition, so Spark may broadcast or
    merge and split hot keys. right's key isn't repeated in the result.
    """
    valid = right.withColumnRenamed(key, f"__{key}")
    upper = F.col(at) <= F.col(to_col) if closed else F.col(at) < F.col(to_col)
    return left.join(valid, (F.col(key) == F.col(f"__{key}")) & (F.col(at) >= F.col(from_col)) & (F.col(to_col).isNull() | upper), how).drop(f"__{key}")


def asof_merge(left: DataFrame, right: DataFrame, key: str, at: str, from_col: str, to_col: str, closed: bool = True, how: str = "inner") -> DataFrame:
    """asof_join for history whose versions of a key don't overlap, in time and rows linear in both sides.

    Lines and version starts are put together, sorted by key and time, and each line takes the version
    last seen. Keys are cut by months, so that one with very many lines is sorted by several tasks: a version
    comes again at the start of each later month in which it is valid and lines can be. Of overlapping versions a line gets
    the one that started last, if that is valid. With how="left" lines without a version, a key or a time
    stay. The months in question are looked up at once.
    """
    month = F.col(MONTH) if MONTH in left.columns else F.trunc(at, "month")
    low, high = left.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).agg(F.min(month), F.max(month)).first()
    named = [c for c in right.columns if c != key]
    version = F.struct(*named)
    empty = F.lit(None).cast(right.select(version.alias("v")).schema["v"].dataType)
    if low is None:
        lines = left.withColumn("__r", empty) if how == "left" else left.limit(0).withColumn("__r", empty)
        return lines.select(*left.columns, *(F.col(f"__r.{c}").alias(c) for c in named))
    placed = left.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    lines = placed.select(F.col(key).alias("__k"), F.trunc(at, "month").alias("__month"), F.col(at).cast("timestamp_ntz").alias("__t"), F.lit(1).alias("__line"), F.struct(*left.columns).alias("__l"), empty.alias("__r"))
    first, last = F.trunc(from_col, "month"), F.coalesce(F.trunc(to_col, "month"), F.lit(high))
    spans = right.filter(F.col(key).isNotNull() & (first <= F.lit(high)) & (last >= F.lit(low)) & (last >= first))
    each = F.explode(F.sequence(F.greatest(first, F.lit(low)), F.least(last, F.lit(high)), F.expr("interval 1 month")))
    starts = spans.select(F.col(key).alias("__k"), each.alias("__month"), F.col(from_col).cast("timestamp_ntz").alias("__t"), F.lit(0).alias("__line"), F.lit(None).cast(lines.schema["__l"].dataType).alias("__l"), version.alias("__r"))
    along = Window.partitionBy("__k", "__month").orderBy("__t", "__line").rowsBetween(Window.unboundedPreceding, 0)
    seen = lines.unionByName(starts).withColumn("__r", F.last("__r", ignorenulls=True).over(along)).filter("__line = 1")
    end = F.col(f"__r.{to_col}").cast("timestamp_ntz")
    valid = F.col("__r").isNotNull() & (end.isNull() | (F.col("__t") <= end if closed else F.col("__t") < end))
    found = (seen.withColumn("__r", F.when(valid, F.col("__r"))) if how == "left" else seen.filter(valid)).select("__l", "__r")
    if how == "left":
        found = found.unionByName(left.filter(F.col(key).isNull() | F.col(at).isNull()).select(F.struct(*left.columns).alias("__l"), empty.alias("__r")))
    return found.select("__l.*", *(F.col(f"__r.{c}").alias(c) for c in named))


#: An as-of join fans out to this many versions of a key at most.
FAN_OUT = 64


def asof(left: DataFrame, right: DataFrame, key: str, at: str, from_col: str, to_col: str, closed: bool = True, how: str = "inner") -> DataFrame:
    """asof_join while no key has more than FAN_OUT versions (counted at once, on right alone), else asof_merge. The same rows
    come of both if versions of a key don't overlap."""
    most = right.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    return (asof_join if most <= FAN_OUT else asof_merge)(left, right, key, at, from_col, to_col, closed, how)


def snapshot_check(existing: DataFrame | None, current: DataFrame, key: str, columns: list[str], as_of: datetime) -> DataFrame:
    """The snapshot after a run at as_of.

    A changed row closes its version and opens one, a new key opens one, a key
    that is gone stays as it is. Without an existing snapshot all rows open. Each key is
    once in current and has one open version at most; rows with a null key match nothing. Open versions and current rows
    meet in one full outer join, so each side is shuffled once; closed versions are passed on unshuffled.
    """
    at, never = F.lit(as_of).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
    if existing is None:
        return current.select(key, *columns).withColumns({"dbt_valid_from": at, "dbt_valid_to": never})
    names = existing.columns + [c for c in columns if c not in existing.columns]
    types = {f.name: f.dataType for f in [*current.schema.fields, *existing.schema.fields]}
    held = lambda c: F.col(f"__l.{c}") if c in existing.columns else F.lit(None).cast(types[c])
    live = existing.filter("dbt_valid_to is null").select(F.col(key).alias("__key"), F.struct(*existing.columns).alias("__l"))
    now = current.select(F.col(key).alias("__key"), F.struct(key, *columns).alias("__c"))
    met = live.join(now, "__key", "full_outer")
    was, come = F.col("__l").isNotNull(), F.col("__c").isNotNull()
    changed = was & come & ~reduce(lambda a, b: a & b, (held(c).eqNullSafe(F.col(f"__c.{c}")) for c in columns), F.lit(True))
    end = {"dbt_valid_to": F.when(changed, at)}
    start = {"dbt_valid_from": at, "dbt_valid_to": never}
    kept = F.struct(*(end.get(c, held(c)).cast(types[c]).alias(c) for c in names))
    fresh = F.struct(*((start[c] if c in start else F.col(f"__c.{c}") if c in (key, *columns) else F.lit(None)).cast(types[c]).alias(c) for c in names))
    rows = F.filter(F.array(F.when(was, kept), F.when(come & (~was | changed), fresh)), lambda r: r.isNotNull())
    closed = existing.filter("dbt_valid_to is not null")
    return closed.unionByName(met.select(F.inline(rows)), allowMissingColumns=True)


def current_rows(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter("dbt_valid_to is null").drop("dbt_valid_from", "dbt_valid_to")


def _fresh(source: DataFrame, newest: datetime | None, key: str, lookback_days: int | None) -> DataFrame:
    """One row of each key that was loaded since newest less lookback: the one loaded last."""
    rows = source if newest is None else source.filter(F.col("loaded_at") >= F.lit(newest).cast("timestamp_ntz") - F.expr(f"interval {lookback_days} days"))
    return latest_per_key(rows, [key], [F.col("loaded_at").desc_nulls_last(), F.xxhash64(*rows.columns).asc()])


def merge_incremental(target: DataFrame, source: DataFrame, key: str = "invoice_item_number", lookback_days: int | None = 3, delete_missing: tuple | None = None) -> DataFrame:
    """target with source rows loaded since its newest load less lookback, put in by key; with lookback None all of them.

    Of several source rows of a key the one loaded last counts. Nothing is deleted, unless delete_missing names a (column, start, end) window
    in which target rows without a source row go. New source columns are added.
    """
    fresh = _fresh(source, None if lookback_days is None else target.agg(F.max("loaded_at")).first()[0], key, lookback_days)
    kept = target.join(fresh.select(key), key, "left_anti")
    if delete_missing:
        column, start, end = delete_missing
        inside = F.col(column).between(F.lit(start), F.lit(end))
        kept = kept.filter(~F.coalesce(inside, F.lit(False))).unionByName(kept.filter(inside).join(source.select(key), key, "left_semi"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def located_months(target: DataFrame, keys: DataFrame, key: str = "invoice_item_number") -> list[date | None]:
    """The months of a table in month folders that hold one of the keys; of the target only the key column is read."""
    found = target.select(key, MONTH).join(keys.select(key), key, "left_semi").select(MONTH).distinct()
    return [r[0] for r in found.collect()]  # a number of months


def merge_months(path: str, source: DataFrame, schema: str, sort: list[str], key: str = "invoice_item_number", day: str = "order_date", lookback_days: int | None = 3) -> list[date | None]:
    """merge_incremental into the table in month folders at path; returns the months written.

    Only the months that source rows go to, and those that hold an older row of their keys, are read whole and
    written anew; all other folders keep their files. A key may move between months. Rows
    without a day are a month of their own. A load that broke off can be repeated: the merge takes rows by key.
    """
    spark = source.sparkSession
    target = spark.read.schema(f"{schema}, {MONTH} date").parquet(path)
    newest = None if lookback_days is None else target.agg(F.max("loaded_at")).first()[0]
    fresh = lasting(_fresh(source, newest, key, lookback_days))
    touched = set(located_months(target, fresh, key)) | {r[0] for r in fresh.select(F.trunc(day, "month")).distinct().collect()}
    dated = [m for m in touched if m is not None]
    inside = F.col(MONTH).isin(dated) if dated else F.lit(False)
    if None in touched:
        inside = F.coalesce(inside, F.lit(False)) | F.col(MONTH).isNull()
    merged = lasting(target.filter(inside).drop(MONTH).join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*(c for c in target.columns if c != MONTH))))
    replace_months(merged, path, sort, list(touched), day)
    return sorted(touched, key=lambda m: (m is None, m))


def replace_days(target: DataFrame, batch: DataFrame, column: str = "order_date") -> DataFrame:
    """target without its rows of the days that batch holds, and batch added; rows without a day stay."""
    return target.join(batch.select(column).distinct(), column, "left_anti").unionByName(batch, allowMissingColumns=True)


def replace_window(target: DataFrame, batch: DataFrame, start=None, end=None, column: str = "order_date") -> DataFrame:
    """target without its rows from start to end (both included), and batch added; without bounds nothing goes."""
    from tallyhouse.sources.landing import in_window

    if start is None and end is None:
        return target.unionByName(batch, allowMissingColumns=True)
    inside = in_window(column, start, end)
    return target.filter(~F.coalesce(inside, F.lit(False))).unionByName(batch, allowMissingColumns=True)
