"""Declared checks: counts by hand, one read of each table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import checks
from tallyhouse.operators.checks import Declared
from tallyhouse.plans.declared import DECLARED
from tallyhouse.plans.model import Model


@pytest.fixture
def tables(spark):
    child = [(1, "a", "x", 5), (1, "b", "y", None), (None, "a", "z", 5), (2, None, "x", 5), (3, "d", None, 5), (3, "d", "w", 5)]
    return {"child": spark.createDataFrame(child, "id long, fk string, kind string, `part` int"), "parent": spark.createDataFrame([("a",), ("b",), (None,)], "name string"), "none": spark.createDataFrame([], "id long, fk string")}


RULES = [
    Declared("child", "id", "not_null", tags=("critical",)), Declared("child", "id", "unique", severity="warn"), Declared("child", "kind", "accepted_values", ("x", "y")), Declared("child", "fk", "relationships", parent=("parent", "name"), tags=("slow", "critical")),
    Declared("child", "part", "not_null"), Declared("parent", "name", "unique"), Declared("none", "id", "not_null"), Declared("none", "id", "unique"), Declared("none", "fk", "relationships", parent=("parent", "name")),
]


def test_counts_by_hand(tables):
    got = {(r.table_name, r.column_name, r.rule): (r.n_fail, r.status, r.tag) for r in checks.run_declared(tables, RULES).collect()}
    assert got == {
        ("child", "id", "not_null"): (1, "error", "critical"), ("child", "id", "unique"): (2, "warn", ""), ("child", "kind", "accepted_values"): (2, "error", ""), ("child", "fk", "relationships"): (2, "error", "slow,critical"), ("child", "part", "not_null"): (1, "error", ""),
        ("parent", "name", "unique"): (0, "pass", ""), ("none", "id", "not_null"): (0, "pass", ""), ("none", "id", "unique"): (0, "pass", ""), ("none", "fk", "relationships"): (0, "pass", ""),
    }


def test_tags_choose_checks(tables):
    got = checks.run_declared(tables, RULES, ["critical"]).collect()
    assert {(r.column_name, r.rule) for r in got} == {("id", "not_null"), ("fk", "relationships")}
    with pytest.raises(ValueError):
        checks.run_declared(tables, RULES, ["nothing"])
    for wrong in (("t", "c", "positive"), ("t", "c", "relationships")):
        with pytest.raises(ValueError):
            Declared(*wrong)


def test_each_table_is_read_once(spark, tables, tmp_path, monkeypatch):
    """As many scans as tables, of the columns named alone."""
    plans, distinct = [], checks.distinct_values
    for name, df in tables.items():
        df.withColumn("unused", F.lit(1)).write.parquet(str(tmp_path / name))
    monkeypatch.setattr(checks, "distinct_values", lambda *a: plans.append(distinct(*a)) or plans[-1])
    checks.run_declared({n: spark.read.parquet(str(tmp_path / n)) for n in tables}, RULES)
    told = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(told) == len(tables) and all(t.count("FileScan") == 1 and "unused" not in t for t in told)


def test_all_checks_have_tables(spark, sf_small):
    count = Counter(c.rule for c in DECLARED)
    assert (count["not_null"], count["unique"], count["accepted_values"], count["relationships"]) == (73, 15, 14, 4)
    tables = Model(spark, sf_small).tables()
    assert all(c.column in tables[c.table].columns for c in DECLARED) and {c.table for c in DECLARED} == set(tables)


def test_only_what_is_counted_is_written(spark, sf_small, tables, monkeypatch):
    """Values that break no rule and that no relationship joins aren't kept; critical checks build their own tables alone."""
    kept, build = [], checks._telling
    monkeypatch.setattr(checks, "_telling", lambda *a: kept.append((a[1], build(*a))) or kept[-1][1])
    checks.run_declared(tables, RULES)
    values = checks.distinct_values(tables["child"], ["id", "kind", "fk"], ["id", "part"]).filter(dict(kept)["child"]).collect()
    assert sorted((r.part, r.value or "", r.n) for r in values) == [(-1, "", 6), (0, "1", 2), (0, "3", 2), (1, "w", 1), (1, "z", 1), (2, "", 1), (2, "a", 2), (2, "b", 1), (2, "d", 2)]
    assert checks.named(DECLARED, ["critical"]) == ["dim_store", "dim_item", "fact_sales", "store_daily_sales"]
    assert set(Model(spark, sf_small).tables("fact_sales", "dim_item")) == {"fact_sales", "dim_item"}
