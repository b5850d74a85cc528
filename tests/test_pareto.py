"""Tiers by selection against running totals."""

import decimal
import random

import pytest

from tallyhouse.operators import pareto, velocity

BASE = "item_number string, total_units_sold long, total_revenue decimal(20,2)"
CASES = {
    "heavy tail": lambda rng, i: (int(1.0 / (rng.random() + 1e-6)), int(10 ** (rng.random() * 9))),
    "ties": lambda rng, i: (rng.randrange(3), 5),
    "all the same": lambda rng, i: (7, 100),
    "returns": lambda rng, i: (rng.randrange(-20, 60), rng.randrange(-2000, 9000)),
    "one for all": lambda rng, i: (10**9 if i == 3 else 1, 10**12 if i == 5 else 1),
}


def brute(rows, k):
    total, so_far, out = sum(r[k] for r in rows), 0, {}
    for r in sorted(rows, key=lambda r: (-r[k], r[0])):
        so_far += r[k]
        share = float(so_far) / float(total)
        out[r[0]] = velocity.CORE if share <= 0.80 else velocity.NICHE if share <= 0.95 else velocity.ZOMBIE
    return out


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("bins, one_by_one", [(pareto.BINS, pareto.ONE_BY_ONE), (4, 3)])
def test_tiers_equal_running_totals(spark, monkeypatch, name, bins, one_by_one):
    monkeypatch.setattr(pareto, "BINS", bins)
    monkeypatch.setattr(pareto, "ONE_BY_ONE", one_by_one)
    rng = random.Random(name)
    rows = [(f"i{i:03}", u, decimal.Decimal(c) / 100) for i, (u, c) in enumerate(CASES[name](rng, i) for i in range(300))]
    got = velocity.tiered(spark.createDataFrame(rows, BASE)).collect()
    assert {r.item_number: r.volume_tier for r in got} == brute(rows, 1) and {r.item_number: r.revenue_tier for r in got} == brute(rows, 2)
    assert {(r.state_units, r.state_revenue, r.active_sku_count) for r in got} == {(sum(r[1] for r in rows), sum(r[2] for r in rows), 300)}


def test_tiers_need_no_sort(spark):
    base = spark.range(5000).selectExpr("cast(id as string) as item_number", "id as total_units_sold", "cast(id * 3 as decimal(20,2)) as total_revenue")
    plan = velocity.tiered(base)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Sort", "Window", "Join", "Exchange"))


@pytest.mark.parametrize("rows", [[], [("a", 0, decimal.Decimal(0))], [("a", -5, decimal.Decimal(1)), ("b", 2, decimal.Decimal(-3))], [("a", 1, decimal.Decimal(1))]])
def test_tiers_of_odd_tables(spark, rows):
    base = spark.createDataFrame(rows, BASE)
    want = velocity.classify(velocity.velocity_ranked(base)).select("item_number", "volume_tier", "revenue_tier").collect()
    assert sorted(map(tuple, velocity.tiered(base).select("item_number", "volume_tier", "revenue_tier").collect())) == sorted(map(tuple, want))


def test_nth_of_many_ties(spark, monkeypatch):
    monkeypatch.setattr(pareto, "ONE_BY_ONE", 2)
    items = [f"{'ab'[i % 2]}{i}" for i in range(40)] + ["a", "ab"]
    ties = spark.createDataFrame([(i,) for i in items], "item string")
    assert [pareto._nth(ties, n) for n in (1, 2, 5, 22, 42)] == [sorted(items)[n - 1] for n in (1, 2, 5, 22, 42)]
