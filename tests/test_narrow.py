"""Models that keep lines narrow: the same rows as from whole lines, and one shuffle of narrow rows where there were several of wide ones."""

import datetime as D

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import history, staging
from tallyhouse.plans.model import Model
from tallyhouse.sources import sales


@pytest.fixture(scope="module")
def model(spark, sf_small):
    return Model(spark, sf_small)


@pytest.fixture(scope="module")
def whole(spark, sf_small):
    """Sales from the whole lines, as LINES_SQL has them."""
    return staging.enrich_sales(staging.stage_sales(sales.sales_lines(spark, sf_small))).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_lines_are_narrow_and_sales_whole(model, whole):
    assert set(model.lines.columns) == {"order_no", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "o_custkey", "o_orderdate", "latest", "repeated"}
    assert rows(model.whole_sales) == rows(whole)
    assert rows(model.sales) == rows(whole.drop("store_name", "county"))
    assert "p_name" in plan(model.sales) and "p_name" not in plan(model.sales.select("item_number", "volume_sold_liters"))


def test_chosen_lines_are_the_latest(model, whole):
    assert rows(model.whole_deduped) == rows(staging.dedupe_latest(whole))
    early = whole.filter("loaded_at < timestamp_ntz'2000-01-01'")
    assert rows(model.staged(model.early_kept)) == rows(staging.dedupe_latest(early).drop("store_name", "county", "is_return"))
    assert rows(model.history) == rows(history.scd2_from_changes(staging.dedupe_latest(whole)))
    assert rows(staging.audited(model.repeated)) == rows(staging.duplicate_audit(whole))


def test_lines_without_number_are_one(spark):
    columns = "order_no long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, o_custkey long, o_orderdate timestamp_ntz, latest boolean, repeated boolean"
    line = lambda order, number, part: (order, number, part, 1, D.date(2000, 1, 1), 1.0, 1.0, "N", "O", 1, D.datetime(2000, 1, 1), True, False)
    frame = spark.createDataFrame([line(1, None, 1), line(2, None, 2), line(3, 1, 3)], columns)
    assert sorted(r.l_partkey for r in sales.kept_lines(frame).collect()) == [2, 3]
    assert sorted(r.l_partkey for r in sales.chosen_lines(frame).collect()) == [2, 3]


def test_one_shuffle(spark, model):
    """History, the sums of days and the choice of lines take one shuffle each, of columns as they are in the raw tables."""
    for df in (history.scd2_from_changes(model.by_item), model.daily_of_all):
        assert plan(df).count("Exchange hashpartitioning") == 1
    assert plan(sales.order_lines(spark, model.sf_dir)).count("Exchange hashpartitioning") == 1
    assert plan(model.deduped.filter(F.col("order_month") == D.date(2000, 1, 1))).count("Exchange") <= 0


def test_landed_lines_are_dealt_out_narrow(spark, sf_small, monkeypatch, whole):
    """Texts of the landed table are made after the shuffle by day, and stores are joined to orders."""
    from tallyhouse.plans import registry

    plans, append = [], registry.landing.append_raw
    monkeypatch.setattr(registry.landing, "append_raw", lambda rows, *a, **k: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or append(rows, *a, **k))
    registry.QUERIES["s4_replaced_window"](spark, sf_small)
    above, below = plans[0].split("RebalancePartitions")
    assert "AS store_name" in above and "AS store_name" not in below and "Invoice" not in below
    model = Model(spark, sf_small)
    assert rows(staging.enrich_sales(staging.stage_sales(sales.invoice_lines(model.raw_lines)))) == rows(whole)


def test_newest_lines_and_items_carry_no_texts(model):
    """What is shuffled for history and for the newest lines is made of raw columns; parts aren't among them."""
    before_shuffle = lambda df: plan(df).split("Exchange hashpartitioning")[1].split("BroadcastExchange")[0]
    assert "p_name" not in before_shuffle(model.by_item)
    newest = sales.newest_lines(model.lines, "item_number", history.newest_first)
    chosen = before_shuffle(newest)
    assert "order_date" in chosen and " item_number#" not in chosen and "store_number#" not in chosen and newest.columns == model.lines.columns
