"""The engine's reports against DuckDB, and hand-made cases of the rules they rest on."""

import datetime as D
import decimal
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import calendar, ladders, measures
from tallyhouse.operators import growth, history, monitoring, quality, shape, staging, velocity
from tallyhouse.plans import registry
from tallyhouse.plans.registry import ORACLE_SQL, QUERIES
from tallyhouse.sources import landing
from tallyhouse.streaming import late_data


def show(value):
    if value is None or value != value:
        return ""
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 9) + 0.0)
    return value.isoformat() if isinstance(value, D.datetime) else str(value)


@pytest.fixture(scope="module")
def con(sf_small):
    con = duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql_agrees(spark, sf_small, con, name):
    df = QUERIES[name](spark, sf_small)
    assert "l_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()  # raw tables are read once, for the saved models
    columns = sorted(df.columns)
    ours = sorted(tuple(show(r[c]) for c in columns) for r in df.collect())
    found = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert ours == sorted(tuple(show(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_periods():
    b = calendar.period_bounds(D.date(2001, 10, 1))
    assert b["t12m"] == (D.date(2000, 11, 1), D.date(2001, 11, 1)) and b["t3m_prior"] == (D.date(2000, 8, 1), D.date(2000, 11, 1))
    assert calendar.add_months(D.date(2024, 3, 31), -1) == D.date(2024, 2, 29)
    assert calendar.ends_of(calendar.annual_periods(D.date(2001, 10, 1), 3))[0] == (D.date(1998, 11, 1), D.date(1999, 11, 1))
    assert calendar.trailing_weeks(D.date(2001, 10, 29), 1) == (D.date(2001, 10, 22), D.date(2001, 10, 30))
    assert calendar.calendar_years(D.date(2001, 5, 1), 2) == (D.date(2000, 1, 1), D.date(2002, 1, 1))


def test_ladders_by_hand(spark):
    cases = {"Brew Oil #3": ("Small/Ind Chain", "Convenience/Gas"), "BREW 12": ("Small/Ind Chain", "Convenience/Gas"), "Corner Food": ("Small/Ind Chain", "Grocery"), "Hy-Vee Wine & Spirits": ("HY-VEE", "Grocery"), "Sam's Club 1": ("SAM'S CLUB", "Warehouse/Club"), "Casey's Casino": ("CASEY'S", "On-Premise"), "plain": ("Small/Ind Chain", "Unknown")}
    frame = spark.createDataFrame([(k,) for k in cases], "store_name string")
    name = F.col("store_name")
    got = frame.select(name, ladders.name_ladder(name, ladders.CHAIN_RULES, ladders.CHAIN_DEFAULT), ladders.name_ladder(name, ladders.CHANNEL_RULES, ladders.CHANNEL_DEFAULT)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == cases
    items = [("1", "tri pack", 750, "20"), ("2", "x 6-PACK", 750, "20"), ("3", "x", 700, "20"), ("4", "x", 1750, "20"), ("5", "x", 1750, "80"), ("6", "x", 50, "5"), ("7", "x", None, "5"), ("8", "x", 750, None), ("9", "x", 750, "1500"), ("10", "x", 1750, "14")]
    frame = spark.createDataFrame([(i, d, v, p and decimal.Decimal(p), "c") for i, d, v, p in items], "item_number string, item_description string, bottle_volume_ml int, state_bottle_retail decimal(12,2), category string")
    priced = history.price_position(frame, spark.createDataFrame([("c", "f")], "category string, category_family string"))
    got = {r.item_number: (r.is_bundle_pack, r.effective_bottle_volume_ml, r.price_position_segment) for r in priced.collect()}
    assert got == {"1": (True, 750, "bundle_pack"), "2": (True, 750, "bundle_pack"), "3": (False, 750, "standard"), "4": (False, 1750, "value_oversized"), "5": (False, 1750, "premium_bulk"), "6": (False, 50, "trial_premium"), "7": (False, None, "unknown"), "8": (False, 750, "unknown"), "9": (False, 750, "icon_collectible"), "10": (False, 1750, "value_oversized")}


def test_measures(spark):
    frame = spark.createDataFrame([("00123", 0.0, 5.0, "12 - ACME SPIRITS", 1750), ("4", 10.0, 15.0, "O'Brien", 50), (None, None, 1.0, "7UP", None), ("1", 1.0, 1.0, " 33: A-B O'NEIL\u00a0", 1000), ("1", 1.0, 1.0, "x", 1500), ("1", 1.0, 1.0, "12", 750)], "v string, a double, b double, n string, ml int")
    rows = frame.select(measures.yoy_pct(F.col("b"), F.col("a")), measures.in_list(F.col("v"), " 123 ,, 9", True), measures.in_list(F.col("v"), "all"), measures.vendor_label(F.col("n")), measures.bottle_label(F.col("ml")), measures.cagr_pct(F.col("a"), F.col("b"), 2), measures.greatest_or_null(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows[:3]] == [None, 50.0, None] and [r[1] for r in rows[:3]] == [True, False, None] and all(r[2] for r in rows)
    assert [r[3] for r in rows] == ["Acme Spirits", "O'Brien", "7Up", "A-B O'Neil", "x", "12"] and [r[4] for r in rows] == ["1.75L", "50ml", "Other", "1L", "1500ml", "750ml"]
    assert rows[0][5] is None and rows[1][5] == pytest.approx(22.4745) and [r[6] for r in rows[:3]] == [5.0, 15.0, None]


def test_change_points_and_ties(spark):
    day = lambda n: D.date(2024, 1, n)
    base = ("c", "cn", "v", "vn", 750, 6, decimal.Decimal("1.00"), decimal.Decimal("2.00"))
    rows = [("i", day(1), D.datetime(2024, 1, 9), "a", "A", *base), ("i", day(1), D.datetime(2024, 1, 9), "b", "B", *base), ("i", day(3), D.datetime(2024, 1, 9), "c", None, *base), ("i", day(5), D.datetime(2024, 1, 9), "d", None, *base), ("i", day(7), D.datetime(2024, 1, 9), "e", "B", *base)]
    frame = spark.createDataFrame(rows, "item_number string, order_date date, loaded_at timestamp_ntz, invoice_item_number string, item_description string, category string, category_name string, vendor_number string, vendor_name string, bottle_volume_ml int, pack int, state_bottle_cost decimal(12,2), state_bottle_retail decimal(12,2)")
    versions = history.scd2_from_changes(frame).orderBy("business_valid_from").collect()
    assert [(r.item_description, r.business_valid_from, r.business_valid_to, r.is_current) for r in versions] == [("B", day(1), day(2), False), (None, day(3), day(4), False), (None, day(5), day(6), False), ("B", day(7), None, True)]
    assert quality.overlapping_windows(history.scd2_from_changes(frame)).count() == 0


def test_snapshot_reopens_and_keeps(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, v string")
    t = [D.datetime(2024, 1, n) for n in (1, 2, 3)]
    one = history.snapshot_check(None, frame([("a", "1"), ("b", None), ("c", "3")]), "k", ["v"], t[0])
    two = history.snapshot_check(one, frame([("a", "2"), ("b", None), ("d", "4")]), "k", ["v"], t[1])
    three = history.snapshot_check(two, frame([("a", "1")]), "k", ["v"], t[2])
    assert sorted((r.k, r.v or "", r.dbt_valid_from, r.dbt_valid_to or "") for r in three.collect()) == sorted([("a", "1", t[0], t[1]), ("a", "2", t[1], t[2]), ("a", "1", t[2], ""), ("b", "", t[0], ""), ("c", "3", t[0], ""), ("d", "4", t[1], "")])


def test_running_total_and_tier_cut(spark):
    rows = spark.createDataFrame([(f"i{k:03}", k % 17 - 2) for k in range(500)], "item_number string, u long")
    got = velocity.running_total(rows, [F.col("u").desc(), F.col("item_number").asc()], "u", "c").collect()
    at = 0
    for r in sorted(got, key=lambda r: (-r.u, r.item_number)):
        at += r.u
        assert r.c == at
    cut = spark.createDataFrame([(80, 100), (81, 100), (95, 100), (96, 100), (1, None)], "c long, t long").select(velocity.pareto_tier("c", "t")).collect()
    assert [r[0] for r in cut] == [velocity.CORE, velocity.NICHE, velocity.NICHE, velocity.ZOMBIE, velocity.ZOMBIE]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_running_total_over_sampled_bounds(spark, adaptive):
    settings = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    wide = F.repeat(F.col("id").cast("string"), 30).alias("label")
    rows = spark.range(0, 400_000, 1, 8).select(F.format_string("i%06d", "id").alias("item_number"), F.pmod(F.xxhash64("id"), F.lit(5_000)).alias("u"), wide)
    rows = velocity.running_total(rows, [F.col("u").desc(), F.col("item_number").asc()], "u", "c").select("item_number", "u", "c").toPandas()
    for k, v in before.items():
        spark.conf.set(k, v)
    rows = rows.sort_values(["u", "item_number"], ascending=[False, True])
    assert len(rows) == 400_000 and (rows.c == rows.u.cumsum()).all()


def test_growth_keeps_groups_without_sales(spark):
    fact = spark.createDataFrame([("x", "s", D.date(1990, 1, 1), decimal.Decimal("5.00"), 1)], "item_number string, store_number string, order_date date, sale_dollars decimal(12,2), bottles_sold int")
    items = spark.createDataFrame([("x", "C", "Rum", None, None, None, None)], "item_number string, category_name string, category_family string, vendor_number string, vendor_name string, bottle_volume_ml int, item_description string")
    rows = growth.family_drilldown(fact, items, D.date(2001, 10, 1), "Rum").collect()
    assert {(r.row_type, r.category_name, r.sales_t12m, r.t12m_yoy_pct) for r in rows} == {(0, "C", 0.0, None), (1, "Grand Total", 0.0, None)}
    tail = shape.chains_with_tail(spark.createDataFrame([("A", 5.0, 1.0), ("B", 4.0, 1.0), ("Independent", 9.0, 0.0)], "chain string, sales_t12m double, sales_t12m_prior double"), 1)
    assert {r.chain: r.sales_t12m for r in tail.collect()} == {"A": 5.0, "Independent + Other": 13.0}


def test_landing_round_trip(spark, tmp_path):
    fields = {f: "1" for f in landing.FIELDS.values()} | {"date": "2024-01-05T00:00:00.000", "store_location": {"type": "Point"}, "invoice_line_no": "INV-1"}
    import json

    (tmp_path / "in.json").write_text(json.dumps(fields) + "\n" + json.dumps(fields | {"date": "2024-01-09T00:00:00.000", "invoice_line_no": "RINV-2"}))
    raw = landing.land_raw(landing.read_payload(spark, str(tmp_path / "in.json")), D.datetime(2024, 2, 1))
    table = str(tmp_path / "raw")
    landing.append_raw(raw, table)
    landing.overwrite_days(raw.filter("date = date '2024-01-05'").withColumn("sale_dollars", F.lit(9).cast("decimal(12,2)")), table)
    back = landing.read_raw(spark, table, D.date(2024, 1, 5), D.date(2024, 1, 5)).collect()
    assert len(back) == 1 and back[0].sale_dollars == 9 and json.loads(back[0].store_location) == {"type": "Point"}
    assert landing.read_raw(spark, table).count() == 2
    staged = staging.enrich_sales(staging.stage_sales(landing.read_raw(spark, table)))
    assert staging.dedupe_latest(staged).filter("is_return").count() == 1
    seed = landing.category_families(spark)
    assert seed.count() == 57 and seed.filter("category = '1081600'").first().category_family == "Whiskies"


def test_merge_and_window(spark):
    frame = lambda rows: spark.createDataFrame(rows, "invoice_item_number string, order_date date, loaded_at timestamp_ntz, v int")
    t = lambda n: D.datetime(2024, 1, n)
    target = frame([("a", D.date(2024, 1, 1), t(10), 1), ("b", D.date(2024, 1, 2), t(10), 1), ("n", None, t(1), 1)])
    source = frame([("a", D.date(2024, 1, 1), t(6), 2), ("b", D.date(2024, 1, 2), t(8), 2), ("c", D.date(2024, 1, 2), t(12), 2)]).withColumn("new", F.lit("x"))
    merged = history.merge_incremental(target, source)
    assert sorted((r.invoice_item_number, r.v, r.new) for r in merged.collect()) == [("a", 1, None), ("b", 2, "x"), ("c", 2, "x"), ("n", 1, None)]
    replaced = history.replace_window(target, frame([("z", D.date(2024, 1, 2), t(11), 3)]), D.date(2024, 1, 2), None)
    assert sorted(r.invoice_item_number for r in replaced.collect()) == ["a", "n", "z"]


def test_late_data_stream(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "invoice_item_number string, order_date date, loaded_at timestamp_ntz, v int"
    for n, rows in enumerate(([("a", 1), ("b", 1)], [("b", 2), ("c", 2)])):
        spark.createDataFrame([(k, D.date(2024, 1, 1), D.datetime(2024, 1, n + 1), v) for k, v in rows], schema).write.mode("append").parquet(source)
        late_data.upsert_stream(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "check")).awaitTermination(120)
    assert sorted((r.invoice_item_number, r.v) for r in late_data.read_table(spark, table).collect()) == [("a", 1), ("b", 2), ("c", 2)]


@pytest.mark.parametrize("days", [False, True])
def test_late_data_gaps_and_nulls(spark, tmp_path, days):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "invoice_item_number string, order_date date, loaded_at timestamp_ntz, v int"
    day, at = lambda n: n and D.date(2024, 1, n), D.datetime(2024, 2, 1)
    for rows in ([("a", 1, at, 1), ("b", 15, at, 1), ("c", 30, at, 1), ("n", None, at, 1)], [("a", 1, None, 2), ("d", 30, None, 2), ("m", None, at, 2)]):
        spark.createDataFrame([(k, day(n), t, v) for k, n, t, v in rows], schema).write.mode("append").parquet(source)
        late_data.upsert_stream(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "check"), days).awaitTermination(120)
    got = {(r.invoice_item_number, r.v) for r in late_data.read_table(spark, table).collect()}
    assert got == {("a", 2), ("b", 1), ("d", 2), ("n", 1), ("m", 2)} | (set() if days else {("c", 1)})


def test_late_lines_move_between_days(spark, tmp_path):
    table, schema = str(tmp_path / "table"), "invoice_item_number string, order_date date, loaded_at timestamp_ntz, v int"
    frame = lambda *rows: spark.createDataFrame([(k, n and D.date(2024, 1, n), D.datetime(2024, 2, 1), v) for k, n, v in rows], schema)
    folders = lambda: {f.name: {x.name for x in f.iterdir()} for f in (tmp_path / "table").iterdir() if f.name[0] not in "._"}
    late_data.put_batch(frame(("a", 1, 1), ("b", 2, 1), ("c", 3, 1), ("n", None, 1)), table, 0)
    before = folders()
    second = frame(("a", 2, 2), ("d", 4, 2), ("d", 4, 2)).withColumn("w", F.lit("new"))
    for _ in range(2):  # a repeated batch changes nothing more
        late_data.put_batch(second, table, 1)
        assert sorted((r.invoice_item_number, r.order_date and r.order_date.day, r.v, r.w) for r in late_data.read_table(spark, table).collect()) == [("a", 2, 2, "new"), ("b", 2, 1, None), ("c", 3, 1, None), ("d", 4, 2, "new"), ("n", None, 1, None)]
    after = folders()
    assert "on_day=2024-01-01" not in after and all(after[d] == before[d] for d in ("on_day=2024-01-03", "on_day=__HIVE_DEFAULT_PARTITION__"))


def test_landed_window_goes_whole(spark, tmp_path):
    path, columns = str(tmp_path / "raw"), [f"cast(null as {t}) as {c}" for c, t in (x.split(" ", 1) for x in landing.RAW_SCHEMA.split(", ") if "decimal" not in x) if c not in ("invoice_item_number", "date")]
    money = [f"cast(null as {landing._TYPES[c]}) as {c}" for c in landing.FIELDS if landing._TYPES.get(c, "").startswith("decimal")]
    rows = lambda *found: spark.createDataFrame([(k, n and D.date(2024, 1, n)) for k, n in found], "invoice_item_number string, date date").selectExpr("*", *columns, *money)
    landing.append_raw(rows(("a", 1), ("b", 2), ("c", 3), ("d", 4)), path)
    landing.replace_landed_window(rows(("e", 2), ("f", 4)), path, D.date(2024, 1, 2), D.date(2024, 1, 3))
    assert sorted(r.invoice_item_number for r in landing.read_raw(spark, path).collect()) == ["a", "d", "e", "f"]
    landing.replace_landed_window(rows().limit(0), path, None, D.date(2024, 1, 2))
    assert landing.landed_days(spark, path) == [D.date(2024, 1, 4)]
    landing.replace_landed_window(rows(("g", 4)), path)
    assert sorted(r.invoice_item_number for r in landing.read_raw(spark, path).collect()) == ["d", "f", "g"]


def test_tables_are_rebuilt_whole(spark, tmp_path):
    path = str(tmp_path / "mart")
    for n in (5, 3):
        landing.write_table(spark.range(n), path)
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(n))


#: Digests of the rule values, which were compared with their source.
FIXED = {
    "CHAIN_RULES": "bbe2c9547af3bcc0",
    "CHANNEL_RULES": "cfbbe1f7d572b4e9",
    "PACKAGE_SIZES": "6bc18af50dcfdd49",
    "RETAIL_TIERS": "8ebdad397696853c",
    "PRICE_TIERS": "ac2abaa73dffd26c",
    "SEGMENTS": "e9d4c933f40e10f1",
    "MERGED_SEGMENTS": "9accd410e849d69f",
    "GROUPED_SEGMENTS": "ef2877585566a7e8",
    "ARCHETYPES": "8f35e4c1f592f8fe",
    "BUNDLE_PATTERNS": "859dd768093df12b",
    "FAMILIES": "cb8b12e8bb5e345b",
}


def test_rules_are_the_fixed_values():
    short = lambda rules: hashlib.sha256(repr(rules).encode()).hexdigest()[:16]
    assert {n: short(getattr(ladders, n)) for n in FIXED} == FIXED


def test_segment_regroupings(spark):
    frame = spark.createDataFrame([(s,) for s in ("budget", "luxury", "bundle_pack", "trial_value", "other", "high_volume")], "price_position_segment string")
    show = lambda rules: [r[0] for r in frame.select(ladders.ladder(rules, F.col("price_position_segment"))).collect()]
    assert show(ladders.MERGED_SEGMENTS) == ["budget", "luxury", "bulk_or_bundle", "trial_size", "other", "high_volume"]
    assert show(ladders.GROUPED_SEGMENTS) == ["budget_standard", "premium_plus", "bulk_or_bundle", "trial_size", "other", "high_volume"]


def test_reports_are_ordered_totals_last(spark, sf_small, con):
    ours = [r.chain for r in QUERIES["o1_chain_growth_ordered"](spark, sf_small).collect()]
    found = con.execute(ORACLE_SQL["o1_chain_growth_ordered"])
    at = [x[0] for x in found.description].index("chain")
    assert ours == [r[at] for r in found.fetchall()] and ours[-1] == "Grand Total"
    rows = spark.createDataFrame([("grand_total", 9, "x"), ("detail", None, "a"), ("subtotal_by_category", 5, "x"), ("detail", 1, "b"), ("detail", 1, "a"), ("subtotal_by_vendor", 7, "x")], "row_type string, v int, n string")
    assert [(r.row_type, r.v, r.n) for r in shape.ordered(rows, "-v", "n").collect()] == [("detail", 1, "a"), ("detail", 1, "b"), ("detail", None, "a"), ("subtotal_by_vendor", 7, "x"), ("subtotal_by_category", 5, "x"), ("grand_total", 9, "x")]


@pytest.mark.parametrize("name", ["q1_family_growth", "q3_vendor_volume_growth", "q13_channel_mix_compare", "q15_family_vendor_trend", "q21_full_scatter"])
def test_reports_are_printed_in_order(spark, sf_small, name):
    rows = registry.printed(name, spark, sf_small).collect()
    assert len(rows) > 5

    def before(x, y):
        for c in (*(["row_type"] if "row_type" in x else []), *registry.ORDERS[name]):
            a, b = x[c.lstrip("-")], y[c.lstrip("-")]
            if c == "row_type":
                a, b = shape.ROW_TYPES.index(a), shape.ROW_TYPES.index(b)
            if a != b:
                return b is None or (a is not None and (a > b if c[0] == "-" else a < b))
        return True

    assert all(before(x, y) for x, y in zip(rows, rows[1:]))


def test_every_report_has_an_order():
    assert set(registry.ORDERS) == {q for q in QUERIES if q[0] == "q" and q != "q9_price_segment_mix_standard"}


def test_merge_takes_the_newest_of_repeated_keys(spark):
    frame = lambda *rows: spark.createDataFrame([(k, D.datetime(2024, 1, n), v) for k, n, v in rows], "invoice_item_number string, loaded_at timestamp_ntz, v int")
    merged = history.merge_incremental(frame(("a", 1, 1)), frame(("a", 2, 2), ("a", 3, 3), ("b", 2, 4), ("b", 2, 4)))
    assert sorted((r.invoice_item_number, r.v) for r in merged.collect()) == [("a", 3), ("b", 4)]


def test_states(spark):
    tasks = spark.createDataFrame([("1", "failed", "PASS"), ("1", "success", "WARN"), ("2", "success", "WARN"), ("3", "success", "PASS")], "run_id string, state string, status string")
    assert {r.run_id: r.final_dag_state for r in monitoring.final_states(tasks).collect()} == {"1": "failed", "2": "degraded", "3": "success"}
    loads = spark.createDataFrame([(D.datetime(2024, 1, 1, 23, 59),)], "loaded_at timestamp_ntz")
    status = lambda as_of: quality.freshness(loads, "loaded_at", as_of).first()
    assert (status(D.datetime(2024, 1, 2)).lag_days, status(D.datetime(2024, 1, 9)).status, status(D.datetime(2024, 1, 16)).status) == (1, "WARN", "ERROR")
    assert quality.freshness(loads.limit(0), "loaded_at", D.datetime(2024, 1, 1)).first().status == "ERROR"
