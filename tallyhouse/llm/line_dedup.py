"""Line dedup: lines that many documents share, found with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z as a-z; it is held as 128
bits. Documents come in batches. The keys of a batch, each with the number of the
batch's documents that hold it, are sorted and written as a run of level 0, less the
keys that earlier runs know to be common already (a merge anti-join). Two runs of a
level are merged into one of the next. Runs are bucketed and sorted by key alike, so
neither the anti-join nor a merge moves a run between executors; a key is shuffled
once, with its batch. After the last batch the runs that are left are merged, and
the lines of common keys are cut from the texts.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import arrow_text as T
from tallyhouse.llm.shared import Scratch, lasting

AT_LEAST = 10
BATCHES = 4
#: Common keys that are broadcast at most (about 100 bytes each in a task); beyond it they are joined.
BROADCAST_KEYS = 500_000
KEY = ["k1", "k2"]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def keys_of(text: bytes) -> list[bytes]:
    """The key of each line of a text."""
    return [line.strip() for line in text.translate(_LOWER).split(b"\n")]


def hashed(keys) -> np.ndarray:
    """128 bits of each key, as two signed columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def batch_keys(docs: DataFrame, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """batch, k1, k2, n: in how many documents a key of a batch was found, counted for each piece of input.

    Each row of docs is a document; equal texts share a batch. Empty keys aren't told.
    """
    whole = F.col(text).cast("string")
    slim = docs.select(whole.alias("text"), F.pmod(F.xxhash64(whole), F.lit(batches)).cast("int").alias("batch"))

    def run(pieces):
        for piece in pieces:
            found = [Counter() for _ in range(batches)]
            for own, batch in zip(_texts(piece.column(0)), piece.column(1).to_pylist(), strict=True):
                found[batch].update(set(keys_of(own)))
            for batch, counts in enumerate(found):
                counts.pop(b"", None)
                if counts:
                    codes = hashed(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(codes), batch, np.int32)), *(pa.array(np.ascontiguousarray(codes[:, i])) for i in (0, 1)), pa.array(counts.values(), pa.int64())], names=["batch", *KEY, "n"]
                    )

    return slim.mapInArrow(run, "batch int, k1 long, k2 long, n long")


class LineRuns:
    """Levelled sorted runs of line keys, each with its documents and whether these make it common.

    A run is a table in folder, bucketed and sorted by key, with the common keys in
    a partition of their own. close() forgets the tables; the files go with the folder.
    """

    def __init__(self, spark: SparkSession, folder: str, at_least: int = AT_LEAST):
        self.spark, self.folder, self.at_least = spark, folder, at_least
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        marked = rows.withColumn("common", F.col("n") >= self.at_least)
        marked.write.partitionBy("common").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")

    def _merged(self, a: str, b: str) -> str:
        """One run of two, by a merge join of their buckets."""
        one, other = (self.spark.table(t).select(*KEY, F.col("n").alias(n)) for t, n in ((a, "n_one"), (b, "n_other")))
        both = one.hint("merge").join(other, KEY, "full").select(*KEY, (F.coalesce("n_one", F.lit(0)) + F.coalesce("n_other", F.lit(0))).alias("n"))
        name = self._write(both)
        self._forget(a)
        self._forget(b)
        return name

    def unknown(self, keys: DataFrame) -> DataFrame:
        """The rows of keys whose key no run holds as common, by a merge anti-join with each run."""
        runs = (self.spark.table(t).filter("common").select(*KEY).hint("merge") for t in self.levels if t)
        return reduce(lambda left, run: left.join(run, KEY, "left_anti"), runs, keys)

    def add(self, keys: DataFrame) -> None:
        """Takes a batch's k1, k2, n (a key may come in several rows) as a run of level 0 and merges equal levels."""
        name = self._write(self.unknown(keys.groupBy(*KEY).agg(F.sum("n").alias("n"))))
        for level, there in enumerate(self.levels):
            if there is None:
                self.levels[level] = name
                return
            self.levels[level] = None
            name = self._merged(there, name)
        self.levels.append(name)

    def common(self) -> DataFrame:
        """k1, k2 of the keys that at_least documents of all batches hold, after merging all levels."""
        runs = [t for t in self.levels if t]
        if not runs:
            return self.spark.createDataFrame([], "k1 long, k2 long")
        self.levels = [None] * len(self.levels) + [reduce(self._merged, runs)]
        return self.spark.table(self.levels[-1]).filter("common").select(*KEY)

    def close(self) -> None:
        for name in self.levels:
            if name:
                self._forget(name)
        self.levels = []


def _cut(text: bytes, known) -> tuple[int, int, bytes]:
    """Lines, lines dropped and the text that stays; known tells of each distinct key whether it is common."""
    keys = keys_of(text)
    distinct = list(dict.fromkeys(k for k in keys if k))
    gone = {k for k, c in zip(distinct, known(distinct), strict=True) if c} if distinct else set()
    if not gone:
        return len(keys), 0, text
    kept = [line for line, k in zip(text.split(b"\n"), keys, strict=True) if k not in gone]
    return len(keys), len(keys) - len(kept), b"\n".join(kept)


def _cut_column(rows) -> list[pa.Array]:
    lines, dropped, kept = zip(*rows, strict=True) if rows else ((), (), ())
    return [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]


def _without(docs: DataFrame, common: DataFrame, few: bool) -> DataFrame:
    """The columns of docs (text is the last), n_lines, n_dropped, and text without the lines of common keys; few: they may be broadcast."""
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    out = f"{kinds}{', ' if kinds else ''}n_lines long, n_dropped long, kept string"

    def told(batch, cuts):
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], *_cut_column(cuts)], names=[*names[:-1], "n_lines", "n_dropped", "kept"])

    if few:
        codes = docs.sparkSession.sparkContext.broadcast({xxhash_bytes(*r) for r in common.collect()})

        def run(batches):
            held = codes.value
            known = lambda keys: [xxhash.xxh3_128_digest(k) in held for k in keys]
            for batch in batches:
                yield told(batch, [_cut(t, known) for t in _texts(batch.column(len(names) - 1))])

        return docs.mapInArrow(run, out)

    text = F.col(f"`{names[-1]}`")
    place = {"__t1": F.xxhash64(F.lit(1), text), "__t2": F.xxhash64(F.lit(2), text)}

    def tell(batches):
        for batch in batches:
            seen = set()
            for t, t1, t2 in zip(_texts(batch.column(0)), *(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                keys = list({k for k in keys_of(t) if k}) if (t1, t2) not in seen else []
                seen.add((t1, t2))
                if keys:
                    codes = hashed(keys)
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(keys), v, np.int64)) for v in (t1, t2)), *(pa.array(np.ascontiguousarray(codes[:, i])) for i in (0, 1))], names=["__t1", "__t2", *KEY])

    held = docs.select(text.alias("text"), *(c.alias(n) for n, c in place.items())).mapInArrow(tell, "__t1 long, __t2 long, k1 long, k2 long").join(common, KEY, "left_semi")
    # a text's common keys, once for each distinct text
    gone = held.distinct().groupBy("__t1", "__t2").agg(F.collect_list(F.struct(*KEY)).alias("__gone"))
    joined = docs.withColumns(place).join(gone, ["__t1", "__t2"], "left").select(*(f"`{n}`" for n in names), F.transform("__gone", lambda g: g.k1).alias("__g1"), F.transform("__gone", lambda g: g.k2).alias("__g2"))

    def cut(batches):
        for batch in batches:
            found = []
            for t, k1, k2 in zip(_texts(batch.column(len(names) - 1)), *(batch.column(len(names) + i).to_pylist() for i in (0, 1)), strict=True):
                codes = {xxhash_bytes(*k) for k in zip(k1 or (), k2 or (), strict=True)}
                found.append(_cut(t, lambda keys, codes=codes: [xxhash.xxh3_128_digest(k) in codes for k in keys]))
            yield told(batch, found)

    return joined.mapInArrow(cut, out)


def xxhash_bytes(k1: int, k2: int) -> bytes:
    """The digest whose two columns are k1 and k2."""
    return k1.to_bytes(8, "little", signed=True) + k2.to_bytes(8, "little", signed=True)


def _cut_docs(slim: DataFrame, text: str, at_least: int, batches: int, broadcast_keys: int) -> DataFrame:
    spark = slim.sparkSession
    with Scratch(spark) as scratch:
        runs = LineRuns(spark, scratch.path, at_least)
        try:
            told = batch_keys(slim, text, batches)
            told.write.partitionBy("batch").parquet(f"{scratch.path}/keys")
            keys = spark.read.schema("k1 long, k2 long, n long, batch int").parquet(f"{scratch.path}/keys")
            for k in range(batches):
                runs.add(keys.filter(F.col("batch") == k))
            common = runs.common()
            few = common.count() <= broadcast_keys
            out = _without(slim, common, few)
            return out if few else lasting(out)
        finally:
            runs.close()


def line_cuts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", at_least: int = AT_LEAST, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept (the text without its common lines).

    Every row is a document, repeated ones and those without an id too. A null or
    empty text is one empty line, which stays; so do lines of white space. A text all
    of whose lines are common is kept as an empty one. Lines are split at \\n alone and
    stay as they were. Neither a text's length nor the number of its lines is
    limited. Columns other than the two named are ignored; an empty table gives an
    empty one. The keys are counted when this is called; the texts are cut when the rows are read.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _cut_docs(slim, "text", at_least, batches, broadcast_keys)


def drop_common_lines(docs: DataFrame, text: str = "text", at_least: int = AT_LEAST, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with the common lines cut from the column text; all other columns stay, whatever their names.

    Edge cases are those of line_cuts; a null text becomes an empty one.
    """
    held = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    order = [i for i in range(len(held)) if i != at] + [at]
    slim = docs.toDF(*held).select(*(held[i] for i in order[:-1]), F.col(held[at]).cast("string").alias("__text"))
    cut = _cut_docs(slim, "__text", at_least, batches, broadcast_keys)
    return cut.select(*(F.col("kept" if i == at else held[i]).alias(n) for i, n in enumerate(docs.columns)))
