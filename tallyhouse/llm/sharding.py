"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned in id order. Each partition reports its bytes, the
driver adds those totals up (one number per partition), and each partition then
continues its own running sum from its offset and cuts it at equal targets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.shared import lasting_in_order


def byte_size(text: str, overhead: int = 8):
    """UTF-8 bytes of a text column plus a fixed overhead; null counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def shard_by_bytes(rows: DataFrame, n_shards: int, order: str, size: str, partitions: int | None = None) -> DataFrame:
    """rows with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Shards are contiguous in the order of column order; a row belongs to the
    shard in which the middle of its bytes falls, so a shard misses its equal
    share by less than one row at either end. Equal and null orders are told apart by their place in the
    input, so a hot value is split like any other. A null size counts as 0. If
    all sizes are 0 every row goes to shard 0; an empty input gives no rows. A
    shard is empty if one row is larger than its share. Columns named shard or
    slot are replaced; all others stay.
    """
    rows = rows.drop("shard", "slot")
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = "__row"
    while row in rows.columns:
        row += "_"
    placed = rows.withColumn(row, F.monotonically_increasing_id())
    placed = placed.repartitionByRange(partitions, order, row).sortWithinPartitions(order, row).drop(row)
    placed = lasting_in_order(placed)
    totals = {r[0]: r[1] for r in placed.groupBy(F.spark_partition_id()).agg(F.sum(F.coalesce(size, F.lit(0)))).collect()}
    starts, total = {}, 0
    for part in sorted(totals):
        starts[part], total = total, total + totals[part]

    # Shard k begins at the first middle, in half bytes, of at least k / n_shards of the whole.
    cuts = np.array([-(-2 * total * k // n_shards) for k in range(1, n_shards)] if total else [], np.int64)

    def assign(batches):
        at = starts.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            sizes = np.asarray(batch.column(batch.schema.get_field_index(size)).cast(pa.int64()).fill_null(0))
            ends = at + np.cumsum(sizes)
            shards = np.searchsorted(cuts, 2 * ends - sizes, "right")
            at = int(ends[-1]) if len(ends) else at
            yield batch.append_column("shard", pa.array(shards.astype(np.int32)))

    cut = placed.mapInArrow(assign, T.StructType([*placed.schema.fields, T.StructField("shard", T.IntegerType())]))
    counts: dict[int, list] = {}
    for part, shard, n in cut.groupBy(F.spark_partition_id(), "shard").count().collect():
        counts.setdefault(shard, []).append((part, n))
    firsts = {}
    for shard, parts in counts.items():
        before = 0
        for part, n in sorted(parts):
            firsts[part, shard], before = before, before + n

    def number(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            shards = np.asarray(batch.column(batch.schema.get_field_index("shard")))
            slots = np.empty(len(shards), np.int64)
            for shard in np.unique(shards).tolist():
                own = np.flatnonzero(shards == shard)
                begin = seen.get(shard, firsts.get((part, shard), 0))
                slots[own] = begin + np.arange(len(own))
                seen[shard] = begin + len(own)
            yield batch.append_column("slot", pa.array(slots))

    return cut.mapInArrow(number, T.StructType([*cut.schema.fields, T.StructField("slot", T.LongType())]))
