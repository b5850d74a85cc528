"""Landing with a second sink for records that can't be landed, snapshots in one join and reconciliation by days."""

import datetime as D
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import history, quality
from tallyhouse.sources import landing, rejects

AT = D.datetime(2024, 2, 1)
GOOD = {f: "1" for f in landing.FIELDS.values()} | {"date": "2024-01-05T00:00:00.000", "invoice_line_no": "INV-1"}


def records(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "record string")


def test_reasons_by_hand(spark):
    texts = {
        json.dumps(GOOD): None, json.dumps({"unknown": 1}): None, json.dumps(GOOD | {"pack": None, "date": None, "store_location": {"type": "Point"}}): None, json.dumps(GOOD | {"pack": 12}): None,
        json.dumps(GOOD)[:40]: "malformed", "": "malformed", "  ": "malformed", "[]": "malformed", "7": "malformed", "null": "malformed", json.dumps([GOOD]): "malformed", "{'": "malformed",
        json.dumps(GOOD | {"pack": "1.5"}): "cast:pack", json.dumps(GOOD | {"date": "2024-02-30"}): "cast:date", json.dumps(GOOD | {"pack": "9" * 30, "sale_dollars": "12345678901"}): "cast:pack,sale_dollars", json.dumps(GOOD | {"state_bottle_cost": ""}): "cast:state_bottle_cost",
    }
    got = rejects.judged(records(spark, [*texts, None, None]), AT).collect()
    assert [r.reason for r in got] == [*texts.values(), "malformed", "malformed"]
    for text, row in zip([*texts, None, None], got, strict=True):
        assert row.record == (None if row.reason is None else text) and row.loaded_at == AT
        if row.reason:
            assert all(row[c] is None for c in landing.FIELDS)
    assert got[2].store_location == '{"type":"Point"}' and got[2].date is None and got[3].pack == 12 and got[0].date == D.date(2024, 1, 5)


def test_rejects_exactly_what_would_end_a_load(spark):
    rng = random.Random(4)
    values = ["1", "-2.50", "1e3", " 7 ", "", "x", "99999999999999", None, "2024-01-31", "true"]
    rows = [GOOD | {rng.choice(["pack", "sale_dollars", "date", "sale_liters", "name"]): rng.choice(values) for _ in range(2)} for _ in range(60)]
    got = rejects.judged(records(spark, [json.dumps(r) for r in rows]), AT)
    for row, judged in zip(rows, got.collect(), strict=True):
        frame = spark.createDataFrame([tuple(row[f] for f in landing.FIELDS.values())], landing.PAYLOAD_SCHEMA)
        try:
            whole = landing.land_raw(frame, AT).collect()[0]
        except Exception:  # noqa: BLE001 a cast that ends the load
            whole = None
        assert (whole is None) == (judged.reason is not None)
        assert whole is None or tuple(whole) == tuple(judged[c] for c in whole.asDict())


def test_both_sinks_in_one_write(spark, tmp_path):
    path = str(tmp_path / "raw")
    days = [GOOD | {"date": f"2024-01-{d:02}"} for d in (5, 5, 6, 9)] + [GOOD | {"date": None}]
    bad = ["{", json.dumps(GOOD | {"pack": "six"}), json.dumps(GOOD | {"pack": "six"})]
    (tmp_path / "in.json").write_text("\n".join([*map(json.dumps, days), *bad]))
    counts = rejects.land_checked(rejects.read_records(spark, str(tmp_path / "in.json")), path, AT)
    assert counts == {"landed": 5, "rejected": 3}
    assert rejects.land_checked(records(spark, []), path, AT) == {"landed": 0, "rejected": 0}
    assert rejects.land_checked(records(spark, ["[]"]), path, AT) == {"landed": 0, "rejected": 1}
    assert rejects.read_landed(spark, path).count() == 5 and rejects.read_landed(spark, path).columns == [c.split()[0] for c in landing.RAW_SCHEMA.split(", ")]
    window = rejects.read_landed(spark, path, D.date(2024, 1, 5), D.date(2024, 1, 6))
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert window.count() == 3 and "outcome" in plan.split("PartitionFilters:")[1].split("]")[0] and "landed_on" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert sorted(r.reason for r in rejects.read_rejected(spark, path).collect()) == ["cast:pack", "cast:pack", "malformed", "malformed"]
    assert landing.read_raw(spark, f"{path}/outcome=landed").count() == 5  # the landed sink is a landed table


def brute_snapshot(held, now, columns, at):
    """Versions (key, values, start, end) after a run."""
    out, live = [], {r[0]: r for r in held if r[3] is None and r[0] is not None}
    for key, values, start, end in held:
        changed = end is None and key is not None and key in now and now[key] != values
        out.append((key, values, start, at if changed else end))
    out += [(k, v, at, None) for k, v in now.items() if k is None or k not in live or live[k][1] != v]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_snapshots_against_brute_force(spark, seed):
    rng, held, kept = random.Random(seed), [], None
    for run in range(4):
        at = D.datetime(2024, 1, 1 + run)
        now = {k: (rng.choice(["a", "b", None]), rng.choice([1, None])) for k in [None, *"klmnop"] if rng.random() < 0.8}
        frame = spark.createDataFrame([(k, *v) for k, v in now.items()], "k string, v string, n int")
        kept = history.snapshot_check(kept, frame, "k", ["v", "n"], at)
        held = brute_snapshot(held, now, ["v", "n"], at)
        assert sorted(map(str, ((r.k, (r.v, r.n), r.dbt_valid_from, r.dbt_valid_to) for r in kept.collect()))) == sorted(map(str, held))


def test_a_snapshot_shuffles_each_side_once(spark):
    old = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("v"), F.lit(AT).cast("timestamp_ntz").alias("dbt_valid_from"), F.lit(None).cast("timestamp_ntz").alias("dbt_valid_to"))
    now = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 7 == 0, "b").otherwise("a").alias("v"))
    after = history.snapshot_check(old, now, "k", ["v"], D.datetime(2024, 3, 1))
    assert after._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert after.count() == 5000 + 715 and after.filter("dbt_valid_to is not null").count() == 715
    grown = history.snapshot_check(old.withColumn("gone", F.lit(1)), now.withColumn("new", F.lit("z")), "k", ["v", "new"], AT)
    assert grown.columns == ["k", "v", "dbt_valid_from", "dbt_valid_to", "gone", "new"] and grown.filter("new = 'z' and gone is null and dbt_valid_to is null").count() == 5000


@pytest.mark.parametrize("seed", range(2))
def test_reconciled_days(spark, seed):
    rng = random.Random(seed)
    day = lambda: rng.choice([D.date(2024, 1, 1) + D.timedelta(d) for d in range(30)])
    left = {(day(), f"s{rng.randrange(5)}"): (rng.randrange(-1, 3), None if rng.random() < 0.2 else 5) for _ in range(90)}
    right = dict(left)
    for key in rng.sample(sorted(left), 4):
        right.pop(key)
    for key in rng.sample(sorted(right), 3):
        right[key] = (right[key][0] + 1, None)
    frame = lambda rows, kind: spark.createDataFrame([(*k, *v) for k, v in rows.items()], "d date, s string, a int, b int").withColumn("b", F.col("b").cast(kind))
    a, b = frame(left, "decimal(12,2)"), frame(right, "bigint")
    show = lambda df: sorted((r.d, r.s, *(None if r[c] is None else float(r[c]) for c in ("l_a", "r_a"))) for r in df.collect())
    whole = quality.reconcile(a, b, ["d", "s"], ["a", "b"])
    assert [r[:2] for r in show(quality.reconcile_days(a, b, "d", ["s"], ["a", "b"]))] == [r[:2] for r in show(whole)]
    zeros = lambda df: df.select("d", "s", F.coalesce(F.col("a").cast("decimal(38,2)"), F.lit(0)).alias("a"))
    days = quality.differing_days(zeros(a), zeros(b), "d", ["s", "a"])
    assert set(days) <= {k[0] for k in left if right.get(k) != left[k]} and len(days) < 8
    assert quality.reconcile_days(a, a, "d", ["s"], ["a", "b"]).count() == 0 and quality.differing_days(a, a.limit(0), "d", ["s"]) != []
    empty = a.limit(0)
    assert quality.reconcile_days(empty, empty, "d", ["s"], ["a", "b"]).count() == 0
    undated = spark.createDataFrame([(None, "s", 3, None)], a.schema)
    assert quality.reconcile_days(a.unionByName(undated), a, "d", ["s"], ["a", "b"]).count() == 1


def test_records_are_parsed_once(spark, sf_small):
    """A filter on the outcome stays above the parse, which it would repeat for each field and cast."""
    from tallyhouse.plans.registry import QUERIES

    for name in ("s1_landed", "s1_rejected"):
        plan = QUERIES[name](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and plan.count("StructsToJsonEvaluator") <= 4
