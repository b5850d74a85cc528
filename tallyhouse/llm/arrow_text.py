"""Vectorised text kernels over the Arrow buffers that Spark hands to Python tasks.

A chunk is a run of rows whose UTF-8 bytes stay below a bound (a single longer
text forms a chunk of its own), so memory per task doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2_000_000
U64 = np.uint64


@dataclass
class Chunk:
    """Rows of one column as bytes: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, for each row."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def text(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, Chunk]]:
    """Yields (first row, chunk). Null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offset_buffer, data_buffer = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offset_buffer, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        own = offsets[at : to + 1]
        yield at, Chunk(data[own[0] : own[-1]], own - own[0])
        at = to


def byte_set(ranges: list[tuple[int, int]], invert: bool = False) -> np.ndarray:
    """Lookup table over bytes."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return ~table if invert else table


#: Words of letters, digits and everything beyond ASCII.
ALNUM = byte_set([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], invert=True) | byte_set([(0x41, 0x5A)])
#: Words between ASCII white space.
SPACED = byte_set([(0x20, 0x20), (0x09, 0x0D)], invert=True)
LEAD = byte_set([(0x80, 0xBF)], invert=True)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 65_536)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each byte span (ends exclusive); with lower, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    power, inverse = _power_tables(len(data) + 1)
    table = _BYTE[_LOWER] if lower else _BYTE
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * power[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U64))


@dataclass
class Words:
    """Words of a chunk in order; those of row i are bounds[i]:bounds[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(chunk: Chunk, kind: np.ndarray, lower: bool) -> Words:
    """Maximal runs of bytes in kind, never across texts."""
    inside = kind[chunk.data]
    n = len(inside)
    if not n:
        return Words(*(np.zeros(0, np.int64),) * 2, np.zeros(chunk.rows + 1, np.int64), np.zeros(0, U64))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = chunk.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.offsets), span_hashes(chunk.data, starts, ends, lower))


def windows(w: Words, size: int, factor: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every run of size words inside one row."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    total = w.hashes[:n].copy()
    for k in range(1, size):
        total *= U64(factor)
        total += w.hashes[k : k + n]
    rows = w.rows()
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return at, mix(total[at] + U64(size))


def covered(at: np.ndarray, sizes: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n words lie in a run of sizes words that starts at one of at."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + sizes, -1)
    return np.cumsum(change[:-1]) > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def map_text(df: DataFrame, text: str, schema: str, step: Callable[[pa.RecordBatch, Chunk, int], dict], keep: list[str] = ()) -> DataFrame:
    """One output row per input row: the columns keep, then those that step makes.

    step gets the batch, a chunk of its column text and the chunk's first row,
    and returns a column of values, one per row of the chunk, by output name.
    """
    slim = df.select(*keep, F.col(text).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    names = list(keep)

    def run(batches):
        for batch in batches:
            for at, chunk in chunks(batch.column(len(names))):
                made = step(batch, chunk, at)
                kept_columns = [batch.column(i).slice(at, chunk.rows) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept_columns, *(v if isinstance(v, pa.Array) else pa.array(v) for v in made.values())], names=[*names, *made])

    return slim.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def filter_text(df: DataFrame, text: str, keep: Callable[[Chunk], np.ndarray]) -> DataFrame:
    """Rows whose text keep marks; every column stays as it is."""
    at_text = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for at, chunk in chunks(batch.column(at_text)):
                yield batch.slice(at, chunk.rows).filter(pa.array(keep(chunk)))

    return df.mapInArrow(run, df.schema)
