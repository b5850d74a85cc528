"""Column checks as data, compiled to one pass over each table.

A declared check names a table, a column and a rule. All rules of a table are answered
by one aggregation with a grouping set for each column whose values matter (unique,
accepted_values, relationships) and one for the whole table (not_null). Of its rows, one
for each distinct value at most, those that break a rule or that a relationship joins are written once; every check is then a count over
them, and a relationship an anti-join of two tables' distinct values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.lasting import Scratch, lasting, shuffles_end

RULES = ("not_null", "unique", "accepted_values", "relationships")


@dataclass(frozen=True)
class Declared:
    """A rule on a column. accepted_values has values; relationships has the parent's table and column."""

    table: str
    column: str
    rule: str
    values: tuple[str, ...] = ()
    parent: tuple[str, str] | None = None
    severity: str = "error"
    tags: tuple[str, ...] = ()

    def __post_init__(self):
        if self.rule not in RULES:
            raise ValueError(f"no such rule: {self.rule}")
        if (self.rule == "relationships") != (self.parent is not None):
            raise ValueError("relationships, and no other rule, needs a parent")


def _keyed(checks: list[Declared], table: str) -> list[str]:
    """Columns of a table whose distinct values some check needs, a parent's key among them."""
    own = [c.column for c in checks if c.table == table and c.rule != "not_null"] + [c.parent[1] for c in checks if c.parent and c.parent[0] == table]
    return list(dict.fromkeys(own))


def distinct_values(df: DataFrame, keyed: list[str], filled: list[str]) -> DataFrame:
    """part, value, n and nulls. Part k has a row for each value (as text) of keyed column k with its rows; part -1 is
    one row, with the number of nulls of each column of filled."""
    names = {c: f"k{i}" for i, c in enumerate(keyed)}
    nulls = F.array(*(F.count_if(F.col(f"n{i}").isNull()) for i in range(len(filled)))) if filled else F.array().cast("array<bigint>")
    slim = df.select(*(F.col(c).cast("string").alias(n) for c, n in names.items()), *(F.col(c).alias(f"n{i}") for i, c in enumerate(filled)))
    if not keyed:
        return slim.agg(F.count("*").alias("n"), nulls.alias("nulls")).select(F.lit(-1).alias("part"), F.lit(None).cast("string").alias("value"), "n", "nulls")
    keys = [F.col(n) for n in names.values()]
    grouped = slim.groupingSets([[], *([k] for k in keys)], *keys).agg(F.count("*").alias("n"), nulls.alias("nulls"), *(F.grouping(n).alias(f"g_{n}") for n in names.values()))
    part = reduce(lambda otherwise, i: F.when(F.col(f"g_k{i}") == 0, i).otherwise(otherwise), range(len(keyed)), F.lit(-1))
    whole = part == -1
    return grouped.select(part.alias("part"), F.coalesce(*keys).alias("value"), "n", F.when(whole, F.col("nulls")).alias("nulls"))


def named(checks: list[Declared], tags: list[str] | None = None) -> list[str]:
    """The tables that the checks (with one of the tags, if any are given) name, parents included."""
    wanted = [c for c in checks if not tags or set(tags) & set(c.tags)]
    return list(dict.fromkeys([c.table for c in wanted] + [c.parent[0] for c in wanted if c.parent]))


def _telling(checks: list[Declared], table: str, keyed: list[str]) -> Column:
    """Which rows of distinct_values some check counts: all values of columns that relationships join, else those that break a rule."""
    telling = F.col("part") == -1
    for i, column in enumerate(keyed):
        own = [c for c in checks if c.table == table and c.column == column and c.rule != "not_null"]
        joined = any(c.rule == "relationships" for c in own) or any(c.parent == (table, column) for c in checks)
        breaks = [F.col("n") > 1 if c.rule == "unique" else ~F.col("value").isin(*c.values) for c in own if c.rule != "relationships"]
        telling = telling | ((F.col("part") == i) & (F.lit(True) if joined else reduce(lambda a, b: a | b, breaks)))
    return telling


def run_declared(tables: dict[str, DataFrame], checks: list[Declared], tags: list[str] | None = None) -> DataFrame:
    """One row per check (with one of the tags, if any are given): table_name, column_name, rule, severity, tag, n_fail, status.

    n_fail counts null rows, values that several rows hold, values that aren't accepted,
    and rows whose value the parent lacks; nulls count for not_null alone. Each table
    that a check names is read once, when this is called, and only the columns named. An empty table passes.
    status is pass, or the severity of a check that fails.
    """
    wanted = [c for c in checks if not tags or set(tags) & set(c.tags)]
    if not wanted:
        raise ValueError("no check is left")
    used = named(wanted)
    spark = tables[used[0]].sparkSession
    with Scratch(spark) as scratch:
        keyed = {t: _keyed(wanted, t) for t in used}
        filled = {t: list(dict.fromkeys(c.column for c in wanted if c.table == t and c.rule == "not_null")) for t in used}
        every = [distinct_values(tables[t], keyed[t], filled[t]).filter(_telling(wanted, t, keyed[t])).withColumn("t", F.lit(i)) for i, t in enumerate(used)]
        with shuffles_end(spark):  # one job; a folder for each table
            reduce(DataFrame.unionByName, every).write.partitionBy("t").parquet(f"{scratch.path}/values")
        values = spark.read.schema("part int, value string, n long, nulls array<long>, t int").parquet(f"{scratch.path}/values")
        found = {t: values.filter(F.col("t") == i) for i, t in enumerate(used)}
        parts = []
        for t in used:
            own = [(i, c) for i, c in enumerate(wanted) if c.table == t and c.rule != "relationships"]
            if own:
                counts = []
                for i, c in own:
                    if c.rule == "not_null":
                        fails = F.coalesce(F.max(F.when(F.col("part") == -1, F.col("nulls")[filled[t].index(c.column)])), F.lit(0))
                    else:
                        here = (F.col("part") == keyed[t].index(c.column)) & F.col("value").isNotNull()
                        fails = F.count_if(here & (F.col("n") > 1 if c.rule == "unique" else ~F.col("value").isin(*c.values)))
                    counts.append(F.struct(F.lit(i).alias("i"), fails.alias("n_fail")))
                parts.append(found[t].agg(F.array(*counts).alias("x")).select(F.inline("x")))
        for i, c in enumerate(wanted):
            if c.rule == "relationships":
                child = found[c.table].filter((F.col("part") == keyed[c.table].index(c.column)) & F.col("value").isNotNull())
                parent = found[c.parent[0]].filter(F.col("part") == keyed[c.parent[0]].index(c.parent[1]))
                parts.append(child.join(parent.select("value"), "value", "left_anti").agg(F.lit(i).alias("i"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_fail")))
        told = spark.createDataFrame([(i, c.table, c.column, c.rule, c.severity, ",".join(c.tags)) for i, c in enumerate(wanted)], "i int, table_name string, column_name string, rule string, severity string, tag string")
        status = F.when(F.col("n_fail") == 0, "pass").otherwise(F.col("severity"))
        return lasting(told.join(reduce(DataFrame.unionByName, parts), "i").withColumn("status", status).drop("i"))
