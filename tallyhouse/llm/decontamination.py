"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A word is a run of ASCII letters and digits or of anything beyond ASCII, with
A-Z as a-z. A benchmark item gives windows of ten words, one shorter window if
it has fewer. Windows of the corpus are looked up by a 64-bit hash and every
hit is verified on its words. A benchmark of more (window, item) pairs than a
block holds is worked through block by block over one saved copy of the corpus: a
block of windows, without their items, is collected, broadcast, scanned for and
released before the next, and the hits of all blocks are put together before
anything is counted or cut. The items of the windows found are joined to the hits.
So driver and tasks hold one block at most, however many items share a window, and
results don't depend on the block size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from tallyhouse.llm import arrow_text as T
from tallyhouse.llm.shared import Scratch, lasting

WINDOW = 10
#: Distinct item windows, and (window, item) pairs, that one broadcast holds at most (about 100 bytes each).
BLOCK_WINDOWS = 500_000
_FILTER_BITS = 20


def _item_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(hash, size, words, item) of the windows of all items."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, chunk in T.chunks(batch.column(1)):
                w = T.words(chunk, T.ALNUM, lower=True)
                for row in range(chunk.rows):
                    low, high = int(w.bounds[row]), int(w.bounds[row + 1])
                    size = min(window, high - low)
                    if not size:
                        continue
                    own = T.Words(w.starts[low:high], w.ends[low:high], np.array([0, high - low]), w.hashes[low:high])
                    firsts, hashes = T.windows(own, size)
                    spelled = [b" ".join(chunk.text(own.starts[i], own.ends[i]).lower() for i in range(k, k + size)) for k in firsts]
                    n = len(firsts)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array([size] * n, pa.int32()), pa.array(spelled, pa.binary()), pa.array([ids[at + row].as_py()] * n, pa.string())], names=["hash", "size", "words", "item"])

    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(run, "hash long, size int, words binary, item string")


class _Scanner:
    """Looks up windows of a chunk in one block of (hash, size, words, items); items are ids or, if these are joined later, the words."""

    def __init__(self, block: list[tuple[int, int, bytes, list[str]]]):
        self.by_size: dict[int, dict[int, list[tuple[bytes, list[str]]]]] = {}
        for code, size, spelled, items in block:
            self.by_size.setdefault(size, {}).setdefault(code, []).append((spelled, items))
        self.filters = {}
        for size, known in self.by_size.items():
            table = np.zeros(1 << _FILTER_BITS, bool)
            table[np.fromiter(known, np.int64, len(known)).view(np.uint64) >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[size] = table

    def scan(self, chunk: T.Chunk) -> tuple[T.Words, list[tuple[int, int, list[str]]]]:
        """The chunk's words, and (first word, size, items) of each verified hit."""
        w = T.words(chunk, T.ALNUM, lower=True)
        hits = []
        for size, known in self.by_size.items():
            at, hashes = T.windows(w, size)
            maybe = np.flatnonzero(self.filters[size][hashes >> np.uint64(64 - _FILTER_BITS)])
            for k, code in zip(at[maybe].tolist(), hashes[maybe].view(np.int64).tolist(), strict=True):
                for spelled, items in known.get(code, ()):
                    if spelled == b" ".join(chunk.text(w.starts[i], w.ends[i]).lower() for i in range(k, k + size)):
                        hits.append((k, size, items))
        return w, hits


_SPANS = "array<struct<first:int,end:int>>"
_TOLD = f"n_hit long, n_items long, items_sha256 string, contaminated boolean, spans {_SPANS}"


class _Blocks:
    """The item windows of a benchmark: whole, with their items, or in blocks of at most about block_windows without them.

    pairs holds (words, item) where the windows come without items.
    """

    def __init__(self, benchmark: DataFrame, item: str, text: str, window: int, block_windows: int, scratch: Scratch):
        self.context = benchmark.sparkSession.sparkContext
        self.pairs, self.whole, self.count = _item_windows(benchmark, item, text, window), True, 1
        most = benchmark.select(F.coalesce(F.sum(F.length(F.col(text).cast("string"))), F.lit(0))).first()[0] // 2 + 1  # no more words than that
        if most > block_windows:
            self.pairs = scratch.keep(self.pairs.distinct())
            self.whole = self.pairs.count() <= block_windows
        if self.whole:
            self.found = self.pairs.groupBy("hash", "size", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
        else:
            self.found = scratch.keep(self.pairs.select("hash", "size", "words").distinct())
            self.count = max(1, -(-self.found.count() // block_windows))

    def broadcast(self, k: int):
        part = self.found if self.count == 1 else self.found.filter(F.pmod(F.col("hash"), F.lit(self.count)) == k)
        rows = part.collect()
        return self.context.broadcast([(r.hash, r.size, bytes(r.words), r["items"] if self.whole else [bytes(r.words)]) for r in rows])

    def each(self) -> Iterator:
        """One broadcast after another; each goes when the next is asked for."""
        for k in range(self.count):
            block = self.broadcast(k)
            yield block
            block.destroy()


def _scanner(block, cache: dict = {}) -> _Scanner:  # noqa: B006  one per Python worker
    if cache.get("of") is not block.value:
        cache["of"], cache["scanner"] = block.value, _Scanner(block.value)
    return cache["scanner"]


def _by_row(w: T.Words, hits: list[tuple[int, int, list[str]]], n: int) -> tuple[list[set], list[list]]:
    """For each of n texts the items of its hits, and its hit words as (first, end) ranges."""
    items: list[set] = [set() for _ in range(n)]
    spans: list[list] = [[] for _ in range(n)]
    if hits:
        first = np.array([h[0] for h in hits])
        flags = T.covered(first, np.array([h[1] for h in hits]), len(w.starts))
        for row, (_, _, names) in zip(np.searchsorted(w.bounds, first, "right") - 1, hits, strict=True):
            items[row].update(names)
        for row in np.flatnonzero(T.sums(flags, w.bounds)):
            own = np.concatenate(([0], flags[w.bounds[row] : w.bounds[row + 1]].view(np.int8), [0]))
            turns = np.flatnonzero(np.diff(own))
            spans[row] = list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
    return items, spans


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that may touch or overlap, as the fewest that don't."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def _span_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))


def _told(items: list[set], spans: list[list[tuple[int, int]]]) -> dict[str, pa.Array]:
    """The columns of _TOLD, of items and ranges by text."""
    n_hit = [sum(b - a for a, b in x) for x in spans]
    digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return {"n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array(digests, pa.string()), "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()), "spans": _span_array(spans)}


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with a number for each row, saved once so that every scan sees the same numbers, and that column's name."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    return scratch.keep(docs.withColumn(name, F.monotonically_increasing_id())), name


def _hits_of_blocks(numbered: DataFrame, row: str, text: str, blocks: _Blocks, scratch: Scratch) -> DataFrame:
    """(__row, windows, spans) of the texts with hits, a row for each block that has some; windows by their words."""
    slim = numbered.select(F.col(row).alias("__row"), F.col(text).cast("string").alias("__text"))
    names = ["__row", "windows", "spans"]

    def scan_with(block):
        def run(batches):
            for batch in batches:
                for at, chunk in T.chunks(batch.column(1)):
                    items, spans = _by_row(*_scanner(block).scan(chunk), chunk.rows)
                    own = [k for k in range(chunk.rows) if items[k]]
                    if own:
                        columns = [batch.column(0).slice(at, chunk.rows).take(pa.array(own)), pa.array([sorted(items[k]) for k in own], pa.list_(pa.binary())), _span_array([spans[k] for k in own])]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    return reduce(DataFrame.unionByName, [scratch.keep(slim.mapInArrow(scan_with(block), f"__row long, windows array<binary>, spans {_SPANS}")) for block in blocks.each()])


def _hit_spans(hits: DataFrame) -> DataFrame:
    """(__row, n_hit, spans), one row per text, of _hits_of_blocks."""

    def merge(batches):
        for batch in batches:
            spans = [_union([(s["first"], s["end"]) for s in x]) for x in batch.column(1).to_pylist()]
            n_hit = pa.array([sum(b - a for a, b in x) for x in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_hit, _span_array(spans)], names=["__row", "n_hit", "spans"])

    gathered = hits.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return gathered.mapInArrow(merge, f"__row long, n_hit long, spans {_SPANS}")


def _hit_items(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(__row, n_items, items_sha256) of _hits_of_blocks, one row per text whose windows have an item id.

    A row of a text and an item is made once for each of the windows that they share,
    and merged in the task before it is shuffled.
    """
    found = hits.select("__row", F.explode("windows").alias("words"))
    items = found.join(pairs.filter("item is not null").select("words", "item"), "words").select("__row", "item").distinct()
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256)
    return items.groupBy("__row").agg(F.count("item").alias("n_items"), digest.alias("items_sha256"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans lists the hit words as half-open (first, end) word ranges that neither
    touch nor overlap. A null or empty text has no words and no hits; repeated rows
    give repeated results; an empty benchmark contaminates nothing, an empty table
    gives an empty result. Items with equal ids count once. Other columns are
    ignored, whatever their names. The rows are the same for every block_windows.
    """
    slim = docs.select(F.col(doc), F.col(text).cast("string").alias("__text"))
    with Scratch(docs.sparkSession) as scratch:
        blocks = _Blocks(benchmark, item, item_text, window, block_windows, scratch)
        if blocks.whole:
            block = blocks.broadcast(0)

            def step(batch, chunk, at):
                w, hits = _scanner(block).scan(chunk)
                return {"n_words": w.counts.astype(np.int64)} | _told(*_by_row(w, hits, chunk.rows))

            return T.map_text(slim, "__text", f"n_words long, {_TOLD}", step, [doc])

        numbered, row = _numbered(slim, scratch)
        hits = _hits_of_blocks(numbered, row, "__text", blocks, scratch)
        counted = T.map_text(numbered, "__text", "n_words long", lambda batch, chunk, at: {"n_words": T.words(chunk, T.ALNUM, lower=True).counts.astype(np.int64)}, [row, doc])
        told = _hit_spans(hits).join(_hit_items(hits, blocks.pairs), "__row", "left").withColumn("contaminated", F.lit(True))
        joined = counted.join(told.withColumnRenamed("__row", row), row, "left")
        none = {"n_hit": F.lit(0), "n_items": F.lit(0), "items_sha256": F.sha2(F.lit(""), 256), "contaminated": F.lit(False), "spans": F.array().cast(_SPANS)}
        return lasting(joined.select(doc, "n_words", *(F.coalesce(c, v.cast(told.schema[c].dataType)).alias(c) for c, v in none.items())))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents without any hit word, with all their columns.

    Documents without words (null texts too) stay, and so do repeated rows; an
    empty table gives an empty one. The rows are the same for every block_windows.
    """
    with Scratch(docs.sparkSession) as scratch:
        blocks = _Blocks(benchmark, item, item_text, window, block_windows, scratch)
        if blocks.whole:
            block = blocks.broadcast(0)

            def clean(chunk):
                w, hits = _scanner(block).scan(chunk)
                keep = np.ones(chunk.rows, bool)
                if hits:
                    keep[np.searchsorted(w.bounds, np.array([h[0] for h in hits]), "right") - 1] = False
                return keep

            return T.filter_text(docs, text, clean)

        numbered, row = _numbered(docs, scratch)
        hits = _hits_of_blocks(numbered, row, text, blocks, scratch)
        return lasting(numbered.join(hits.select(F.col("__row").alias(row)), row, "left_anti").select(docs.columns))


def _cut(column: pa.Array, spans: list[list[tuple[int, int]] | None]) -> list[str | None]:
    """The texts of a column without their words in spans; texts without spans as they are."""
    new = column.to_pylist()
    for at, chunk in T.chunks(column):
        if not any(spans[at : at + chunk.rows]):
            continue
        w = T.words(chunk, T.ALNUM, lower=True)
        for row in range(chunk.rows):
            if spans[at + row]:
                left, out = int(chunk.offsets[row]), []
                for first, end in spans[at + row]:
                    for i in range(int(w.bounds[row]) + first, int(w.bounds[row]) + end):
                        out.append(chunk.text(left, w.starts[i]))
                        left = int(w.ends[i])
                new[at + row] = (b"".join(out) + chunk.text(left, chunk.offsets[row + 1])).decode()
    return new


def strip_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """All documents, each hit word cut out of the text; a null text stays null.

    Hits are those of the text as it came, so what cutting brings together is no
    new hit. Repeated rows give repeated results, an empty table an empty one;
    other columns stay. The rows are the same for every block_windows.
    """
    at_text = docs.columns.index(text)
    with Scratch(docs.sparkSession) as scratch:
        blocks = _Blocks(benchmark, item, item_text, window, block_windows, scratch)
        if blocks.whole:
            block = blocks.broadcast(0)

            def scan(batches):
                for batch in batches:
                    for at, chunk in T.chunks(batch.column(at_text)):
                        part = batch.slice(at, chunk.rows)
                        spans = _by_row(*_scanner(block).scan(chunk), chunk.rows)[1]
                        yield part.set_column(at_text, part.schema.field(at_text), pa.array(_cut(part.column(at_text), spans), part.schema.field(at_text).type))

            return docs.mapInArrow(scan, docs.schema)

        numbered, row = _numbered(docs, scratch)
        hits = _hit_spans(_hits_of_blocks(numbered, row, text, blocks, scratch)).select(F.col("__row").alias(row), F.col("spans").alias(f"{row}spans"))
        schema = K.StructType(docs.schema.fields)

        def cut(batches):
            for batch in batches:
                spans = [None if x is None else [(s["first"], s["end"]) for s in x] for x in batch.column(batch.num_columns - 1).to_pylist()]
                part = batch.select(list(range(batch.num_columns - 1)))
                yield part.set_column(at_text, part.schema.field(at_text), pa.array(_cut(part.column(at_text), spans), part.schema.field(at_text).type))

        return lasting(numbered.join(hits, row, "left").select(*docs.columns, f"{row}spans").mapInArrow(cut, schema))
