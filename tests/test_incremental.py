"""Incremental history and merges against whole rebuilds."""

import datetime as D
import decimal
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import history
from tallyhouse.sources import months

FACT = "invoice_item_number string, order_date date, loaded_at timestamp_ntz, item_number string, item_description string, category string, category_name string, vendor_number string, vendor_name string, bottle_volume_ml int, pack int, state_bottle_cost decimal(12,2), state_bottle_retail decimal(12,2)"


def show(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def line(rng, k, load, days=40):
    day = None if rng.random() < 0.01 else D.date(2024, 1, 1) + D.timedelta(rng.randrange(days))
    price = decimal.Decimal(rng.choice(["1.00", "2.00"]))
    return (f"i{k}", day, D.datetime(2024, 3, load), rng.choice(["a", "b", "c", "d", "e", "f", None]), rng.choice(["x", "x", "x", "y", "", None]), "c", rng.choice(["n", "n", None, ""]), "1", "v", rng.choice([750, 750, -1, None]), 6, price, price * 2)


@pytest.mark.parametrize("seed", range(2))
def test_history_after_late_loads(spark, seed):
    """Loads bring new lines, replace lines (also with another item or day) and take lines away; each update equals a rebuild."""
    rng = random.Random(seed)
    frame = lambda found: spark.createDataFrame(found, FACT)
    held = {k: line(rng, k, 1) for k in range(70)}
    kept = history.scd2_from_changes(frame(list(held.values())))
    for load in (2, 3):
        before = frame(list(held.values()))
        batch = [line(rng, rng.choice([*range(8), 1000 + load * 10 + j]), load) for j in range(rng.randrange(1, 6))]
        batch = list({r[0]: r for r in batch}.values())
        held |= {int(r[0][1:]): r for r in batch}
        after, touched = frame(list(held.values())), history.touched_items(before, frame(batch))
        names = {r[0] for r in touched.collect()}
        # lines of other items are never looked at: without them the result is the same
        own = after.filter(F.col("item_number").isin(list(names))) if names else after.limit(0)
        kept = history.update_history(kept, own, touched)
        assert show(kept) == show(history.scd2_from_changes(after))


def test_history_opens_later_months_only(spark, tmp_path):
    path = str(tmp_path / "fact")
    rng = random.Random(9)
    rows = [line(rng, k, 1, 300) for k in range(300)]
    rows = [r[:4] + ("x" if not r[4] else r[4],) + r[5:] for r in rows if r[1]]
    before = spark.createDataFrame(rows, FACT)
    load = spark.createDataFrame([("new", D.date(2024, 9, 20), D.datetime(2024, 3, 2), "a", "z", *rows[0][5:])], FACT)
    months.write_by_month(before.unionByName(load), path, ["item_number"])
    fact = spark.read.schema(f"{FACT}, {months.MONTH} date").parquet(path)
    out = history.update_history(history.scd2_from_changes(before), fact, history.touched_items(before, load))
    assert "order_month" in out._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [isnotnull(")[1][:40]
    assert show(out) == show(history.scd2_from_changes(before.unionByName(load)))


@pytest.mark.parametrize("lookback", [3, None])
def test_merge_rewrites_touched_months(spark, tmp_path, lookback):
    path, schema = str(tmp_path / "fact"), "invoice_item_number string, order_date date, loaded_at timestamp_ntz, item_number string, v int"
    day = lambda month: D.date(2024, month, 3)
    rows = [(f"{m}-{k}", day(m), D.datetime(2024, 6, 1), f"it{k}", 1) for m in range(1, 7) for k in range(3)] + [("none", None, D.datetime(2024, 6, 1), "it", 1)]
    target = spark.createDataFrame(rows, schema)
    months.write_by_month(target, path, ["item_number"])
    files = lambda: {m: {f.name for f in p.iterdir()} for p in (tmp_path / "fact").iterdir() if p.is_dir() for m in [p.name.partition("=")[2]]}
    before, late = files(), D.datetime(2024, 6, 2)
    # one replaced in its month, one moved to another, one new, one of two loads, one too old to count
    source = spark.createDataFrame([("1-0", day(1), late, "x", 2), ("2-1", day(4), late, "y", 3), ("new", day(8), late, "z", 4), ("new", day(8), late - D.timedelta(1), "z", 9), ("6-0", day(6), D.datetime(2024, 1, 1), "x", 5)], schema)
    want = show(history.merge_incremental(target, source, lookback_days=lookback))
    for _ in range(2):  # a repeated load changes nothing more
        wrote = history.merge_months(path, source, schema, ["item_number"], lookback_days=lookback)
        assert show(spark.read.schema(f"{schema}, {months.MONTH} date").parquet(path).drop(months.MONTH)) == want
    touched = {1, 2, 4, 8} | ({6} if lookback is None else set())
    assert set(wrote) <= {D.date(2024, m, 1) for m in touched}
    after = files()
    assert all((after[m] == files_) == (m == "__HIVE_DEFAULT_PARTITION__" or int(m[5:7]) not in touched) for m, files_ in before.items())


def test_merge_of_rows_without_days(spark, tmp_path):
    path, schema = str(tmp_path / "fact"), "invoice_item_number string, order_date date, loaded_at timestamp_ntz, item_number string, v int"
    at = D.datetime(2024, 6, 1)
    months.write_by_month(spark.createDataFrame([("a", None, at, "i", 1), ("b", None, at, "i", 1), ("c", D.date(2024, 1, 1), at, "i", 1)], schema), path, ["item_number"])
    history.merge_months(path, spark.createDataFrame([("a", D.date(2024, 1, 2), at, "i", 2), ("b", D.date(2024, 2, 2), at, "i", 2)], schema), schema, ["item_number"])
    assert {(r.invoice_item_number, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 2), ("c", 1)}
    assert not (tmp_path / "fact" / "order_month=__HIVE_DEFAULT_PARTITION__").exists()
