"""Month folders and their pruning, the monthly rollup, and as-of joins by merging."""

import datetime as D
import decimal
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import add_months
from tallyhouse.functions.lasting import lasting
from tallyhouse.operators import history, replenishment, rollup, velocity
from tallyhouse.plans import registry
from tallyhouse.plans.model import DAY, MONTH, Model
from tallyhouse.sources import months

LINES = "invoice_item_number string, order_date date, item_number string, store_number string, sale_dollars decimal(12,2), bottles_sold int, is_return boolean"


def lines(spark, seed, n=400, first=D.date(2020, 1, 1), days=700):
    rng = random.Random(seed)
    rows = [(f"{seed}-{i}", None if i % 50 == 0 else first + D.timedelta(rng.randrange(days)), rng.choice(["a", "b", "c", None]), f"s{rng.randrange(3)}", decimal.Decimal(rng.randrange(10_000)) / 100, rng.randrange(9), i % 20 == 1) for i in range(n)]
    return spark.createDataFrame(rows, LINES)


def show(df, *columns):
    return sorted(map(str, (tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect())))


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "fact")
    months.write_by_month(lines(spark, 1), path, ["item_number"])
    return path


def read(spark, path):
    return spark.read.schema(f"{LINES}, {months.MONTH} date").parquet(path)


def opened(df):
    """How many files a plan's scans open when it runs."""
    df.collect()
    scans = df._jdf.queryExecution().executedPlan().collectLeaves()
    seen = []
    for k in range(scans.size()):
        node = scans.apply(k)
        node = node.plan() if "QueryStage" in node.getClass().getSimpleName() else node
        leaves = node.collectLeaves() if hasattr(node, "collectLeaves") else None
        for j in range(leaves.size()) if leaves is not None else ():
            metrics = leaves.apply(j).metrics()
            if metrics.contains("numFiles"):
                seen.append(metrics.apply("numFiles").value())
    return sum(seen)


def test_rows_and_order_stay(spark, table):
    back = read(spark, table)
    assert show(back.drop(months.MONTH)) == show(lines(spark, 1))
    assert back.filter(~F.col(months.MONTH).eqNullSafe(F.trunc("order_date", "month"))).count() == 0
    items = back.filter("order_month = date '2020-05-01'").select("item_number").collect()  # one file of a small month
    assert [r[0] for r in items] == sorted((r[0] for r in items), key=lambda v: (v is not None, v))
    assert len(months.months_of(spark, table)) == 23


@pytest.mark.parametrize("windows", [[(D.date(2020, 3, 15), D.date(2020, 4, 1))], [(None, D.date(2020, 2, 2))], [(D.date(2021, 11, 5), None)], [(None, None)], [(D.date(2020, 1, 31), D.date(2020, 2, 1)), (D.date(2021, 1, 1), D.date(2021, 1, 2))]])
def test_windows_open_their_months_only(spark, table, windows):
    plain = lines(spark, 1)
    found = months.in_days(read(spark, table), *windows)
    assert show(found.drop(months.MONTH)) == show(months.in_days(plain, *windows))
    inside = {m for m in months.months_of(spark, table) if any((a is None or m >= a.replace(day=1)) and (b is None or m < b) for a, b in windows)}
    if windows != [(None, None)]:
        assert opened(found.select("invoice_item_number")) == len(inside) < 23


def test_newest_day(spark, table):
    newest = max(r[0] for r in lines(spark, 1).select("order_date").collect() if r[0])
    assert months.newest_day(read(spark, table)) == months.newest_day(lines(spark, 1)) == newest
    assert months.newest_day(read(spark, table).limit(0)) is None and months.newest_day(lines(spark, 1).limit(0)) is None


def test_windows_of_an_empty_table(spark):
    none = lines(spark, 1).limit(0)
    assert velocity.velocity_base(none).collect() == [] and replenishment.weekly_depletions(none).collect() == []


def test_velocity_and_weeks_agree_with_plain_tables(spark, table):
    for build in (velocity.velocity_base, replenishment.weekly_depletions, lambda f: velocity.velocity_window(f, D.date(2021, 6, 9), 12)):
        assert show(build(read(spark, table))) == show(build(lines(spark, 1)))


@pytest.mark.parametrize("name", ["m9_velocity_base", "m10_weekly_depletions", "q11_segment_mix_compare", "q13_channel_mix_compare", "q17_sku_tier_summary", "q14_vendor_share", "q15_family_vendor_trend", "q22_chain_performance"])
def test_reports_prune_months(spark, sf_small, name, monkeypatch):
    """Every scan of a table in month folders is bounded by months: seven years are there, no report opens all."""
    seen, build = [], months.in_days
    watched = lambda df, *w, **k: seen.append(build(df, *w, **k)) or seen[-1]
    for module in ("growth", "mix", "replenishment", "stores", "velocity"):
        owner = getattr(__import__(f"tallyhouse.operators.{module}").operators, module)
        if hasattr(owner, "in_days"):
            monkeypatch.setattr(owner, "in_days", watched)
    model = Model(spark, sf_small)
    if name.startswith("m9"):
        velocity.velocity_base(model.deduped)
    elif name.startswith("m10"):
        replenishment.weekly_depletions(model.deduped)
    elif name.startswith("q17"):
        velocity.velocity_window(model.fact, DAY, 12)
    else:
        registry.QUERIES[name](spark, sf_small)
    assert seen
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*order_month", plan)
        every = len({f.rsplit("/", 2)[1] for f in df.sparkSession.read.parquet(df.inputFiles()[0].rsplit("/", 2)[0]).inputFiles()})
        held = df.select(months.MONTH).distinct().count()
        assert held < every and opened(df.select("store_number" if "store_number" in df.columns else "item_number")) < 8 * every


def test_months_are_replaced(spark, table):
    before = {r[0] for r in read(spark, table).select(F.input_file_name()).distinct().collect()}
    more = lines(spark, 7, 30, D.date(2020, 3, 1), 20).filter("order_date is not null")
    months.replace_months(more, table, ["item_number"], [D.date(2020, 3, 1), D.date(2020, 5, 1)])
    gone = (D.date(2020, 3, 1), D.date(2020, 5, 1))
    kept = lines(spark, 1).filter(F.trunc("order_date", "month").isNull() | ~F.trunc("order_date", "month").isin(*gone))
    assert show(read(spark, table).drop(months.MONTH)) == show(kept.unionByName(more))
    after = {r[0] for r in read(spark, table).select(F.input_file_name()).distinct().collect()}
    assert D.date(2020, 5, 1) not in months.months_of(spark, table) and len(before & after) == len(before) - 2


def test_rollup_refresh_reads_touched_months(spark, table, tmp_path):
    path = str(tmp_path / "rollup")
    months.write_by_month(rollup.monthly_sales(read(spark, table)), path, rollup.KEYS)
    kept = {r[0] for r in rollup.read_rollup(spark, path).select(F.input_file_name()).distinct().collect()}
    load = lines(spark, 3, 20, D.date(2020, 6, 29), 4).filter("order_date is not null")
    touched = rollup.touched_months(load)
    assert touched == [D.date(2020, 6, 1), D.date(2020, 7, 1)]
    inside = months.in_days(read(spark, table), (touched[0], add_months(touched[-1], 1))).drop(months.MONTH)
    months.replace_months(lasting(inside.unionByName(load)), table, ["item_number"], touched)
    fact = read(spark, table)
    assert opened(fact.filter(F.col(months.MONTH).isin(touched)).select("item_number")) == 2
    rollup.refresh(fact, path, touched)
    rolled = rollup.read_rollup(spark, path)
    assert show(rolled.drop(months.MONTH)) == show(rollup.monthly_sales(fact))
    assert len(kept & {r[0] for r in rolled.select(F.input_file_name()).distinct().collect()}) == len(kept) - 2
    rollup.refresh(fact, path, [])
    months.replace_months(fact.limit(0).drop(months.MONTH), table, ["item_number"], [touched[0]])
    rollup.refresh(read(spark, table), path, [touched[0]])
    assert touched[0] not in months.months_of(spark, path)


def test_reports_agree_on_fact_and_rollup(spark, sf_small):
    from tallyhouse.operators import growth

    m = Model(spark, sf_small)
    for build in (lambda f: growth.family_growth(f, m.items, MONTH), lambda f: growth.item_growth(f, m.items, MONTH, "category_family", "Whiskies"), lambda f: growth.vendor_share_by_year(f, m.items, MONTH, "Whiskies")):
        assert show(build(m.fact)) == show(build(m.monthly))


VERSIONS = "k string, v int, since date, until date"


def versions(rng, key, n, first=D.date(2019, 6, 1)):
    """n versions of a key, some with a gap after them; the last may be open."""
    out, day = [], first
    for v in range(n):
        end = day + D.timedelta(rng.randrange(0, 90))
        out.append((key, v, day, None if v == n - 1 and rng.random() < 0.5 else end))
        day = end + D.timedelta(1 + (rng.randrange(40) if rng.random() < 0.3 else 0))
    return out


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_asof_merge_equals_the_join(spark, closed, how):
    rng = random.Random(4)
    right = spark.createDataFrame([r for k in "abcd" for r in versions(rng, k, rng.randrange(1, 25))] + [(None, 1, D.date(2020, 1, 1), None)], VERSIONS)
    left = spark.createDataFrame([(rng.choice(["a", "b", "c", "d", "e", None]), None if i % 40 == 0 else D.date(2019, 5, 1) + D.timedelta(rng.randrange(1200)), i) for i in range(600)] + [("a", D.date(2019, 6, 1), 5)] * 2, "k string, day date, i int")
    want = history.asof_join(left, right, "k", "day", "since", "until", closed, how)
    got = history.asof_merge(left, right, "k", "day", "since", "until", closed, how)
    assert got.columns == want.columns and show(got) == show(want)
    assert show(history.asof_merge(left.limit(0), right, "k", "day", "since", "until", closed, how)) == []
    assert show(history.asof_merge(left, right.limit(0), "k", "day", "since", "until", closed, how)) == show(history.asof_join(left, right.limit(0), "k", "day", "since", "until", closed, how))


def test_asof_of_ten_thousand_versions(spark):
    """Daily versions of one item that has most lines: a join would make half a billion rows of them; the merge shuffles one for each line and version."""
    day = F.date_add(F.lit(D.date(1995, 1, 1)), F.col("id").cast("int"))
    right = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").alias("v"), day.alias("since"), day.alias("until"))
    left = spark.range(100_000).select(F.lit("hot").alias("k"), F.date_add(F.lit(D.date(1995, 1, 1)), (F.col("id") % 11_000).cast("int")).alias("day"), F.col("id").alias("i"))
    out = history.asof(left, right, "k", "day", "since", "until")
    assert out.filter(F.col("v") != F.col("i") % 11_000).count() == 0 and out.count() == 91_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and re.search(r"hashpartitioning\(__k#\d+, __month#\d+", plan)  # cut by months
