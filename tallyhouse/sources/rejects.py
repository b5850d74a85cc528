"""Landing JSON records with a second sink for those that can't be landed."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyhouse.sources.landing import _TYPES, FIELDS, PAYLOAD_SCHEMA, RAW_SCHEMA, in_window

_BROKEN = "__broken"
#: The folder of each sink, by the value of its partition column.
LANDED, REJECTED = "landed", "rejected"
REJECT_SCHEMA = "reason string, record string, loaded_at timestamp_ntz"
#: What a query of landed payloads shows of them.
SHOWN = ["invoice_item_number", "date", "store_number", "item_number", "pack", "bottle_volume_ml", "bottles_sold", "sale_dollars"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files, one record each."""
    return spark.read.text(path).withColumnRenamed("value", "record")


def judged(records: DataFrame, loaded_at: datetime) -> DataFrame:
    """Records (column record) in the raw table's shape, with reason: null if the record can be landed.

    'malformed' is a record that is null, empty or no JSON object (a list or a broken text, for one); 'cast:' and the columns,
    comma-joined in the table's order, one whose values don't fit their columns, which land_raw would end the whole load for.
    A field that is missing or null is a null value, and fields that nobody asked for are left out, as in land_raw. A
    rejected record keeps its text, and its values are null. Nothing is dropped, so repeated records come out repeatedly.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    sent = records.select("record", F.from_json("record", f"{PAYLOAD_SCHEMA}, {_BROKEN} string", options).alias("__sent"))
    text: dict[str, Column] = {c: F.col(f"__sent.{f}") for c, f in FIELDS.items()} | {"date": F.substring(F.col(f"__sent.{FIELDS['date']}"), 1, 10)}
    cast = {c: text[c].try_cast(_TYPES.get(c, "string")) for c in FIELDS}
    malformed = F.col("__sent").isNull() | F.col(f"__sent.{_BROKEN}").isNotNull() | (F.trim("record") == "")
    failing = F.concat_ws(",", *(F.when(text[c].isNotNull() & cast[c].isNull(), c) for c in FIELDS if c in _TYPES))
    reason = F.when(F.coalesce(malformed, F.lit(True)), "malformed").when(failing != "", F.concat(F.lit("cast:"), failing))
    found = sent.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return found.select(*(F.when(good, cast[c]).alias(c) for c in FIELDS), F.lit(loaded_at).cast("timestamp_ntz").alias("loaded_at"), "reason", F.when(~good, F.col("record")).alias("record"))


def _counted(records: DataFrame) -> DataFrame:
    """judged records, counted by outcome as they pass. A filter on what was judged isn't pushed below the count, where Spark would
    write its condition out: a parse of the record for each field and cast that the reason looks at."""
    return records.observe(f"judged-{uuid.uuid4().hex}", F.count_if(F.col("reason").isNull()).alias(LANDED), F.count_if(F.col("reason").isNotNull()).alias(REJECTED))


def landed(records: DataFrame) -> DataFrame:
    """The judged records that can be landed."""
    return _counted(records).filter("reason is null").select(SHOWN)


def rejected(records: DataFrame) -> DataFrame:
    """The judged records that can't, with their reason."""
    return _counted(records).filter("reason is not null").select("reason", "record")


def land_checked(records: DataFrame, path: str, loaded_at: datetime) -> dict[str, int]:
    """Lands records and keeps those that can't be landed apart, in one pass and one write; returns how many of each.

    Both sinks are folders of path, a column of the write: outcome=landed, which holds day folders as append_raw makes
    them, and outcome=rejected. Every record is parsed once, dealt out by day, and counted as it is written, so
    landed and rejected add up to the records. Rows are added; a load that broke off is
    repeated after taking its rows away by loaded_at.
    """
    outcome = F.when(F.col("reason").isNull(), LANDED).otherwise(REJECTED)
    placed = judged(records, loaded_at).withColumns({"outcome": outcome, "landed_on": F.col("date")}).hint("rebalance", "outcome", "landed_on")
    seen = Observation(f"landing-{uuid.uuid4().hex}")
    # counted by the tasks that write, so that a repeated task before the shuffle counts nothing twice
    counted = placed.observe(seen, *(F.count_if(F.col("outcome") == kind).alias(kind) for kind in (LANDED, REJECTED)))
    counted.write.mode("append").partitionBy("outcome", "landed_on").parquet(path)
    if records.isEmpty():  # then Spark drops the count
        return {LANDED: 0, REJECTED: 0}
    return {k: int(v) for k, v in seen.get.items()}


def read_landed(spark: SparkSession, path: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """The landed sink in the raw table's shape, between two days; no other folder is opened. Without bounds rows without a day come along."""
    rows = spark.read.schema(f"{RAW_SCHEMA}, outcome string, landed_on date").parquet(path).filter(F.col("outcome") == LANDED)
    return rows.filter(in_window("landed_on", start, end)).drop("outcome", "landed_on")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """The rejected sink: reason, record, loaded_at."""
    return spark.read.schema(f"{REJECT_SCHEMA}, outcome string, landed_on date").parquet(path).filter(F.col("outcome") == REJECTED).drop("outcome", "landed_on")
