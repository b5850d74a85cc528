"""Periodic run detection by online dyadic square catching.

Words are appended to a stream. Once 2**k words more have come in, a block of that
size, at a multiple of it, is complete and keeps a catcher: its hash is compared with
those of the windows that begin p words after it, for the periods p from 2**(k+1) - 1
to 2**(k+2) - 2. Any stretch of p words holds such a block, so each period has one
level, and each word two comparisons a level. A match goes on while the blocks that
follow match at the same p; one that lasts three periods is a run of four, whose
ends are then found word by word, less than a block beyond the match. Hashes choose
the matches; every run is verified on its words.

The documents of a task share streams, with a word of its own after each of them, so
nothing matches across documents.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run holds its period so often at least, and so many words at least.
TIMES, LEAST = 4, 6
#: About so many words are worked on together; a text of more is so alone.
STREAM_WORDS = 1 << 18
#: Longer texts are split and appended in pieces of about so many bytes.
PIECE_BYTES = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)
_BLANK = re.compile(rb"[ \t-\r]")

Run = tuple[int, int, int]


def _codes(numbers: np.ndarray) -> np.ndarray:
    """A hash of each word number; never 0."""
    x = numbers.astype(np.uint64) * np.uint64(_FACTOR)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) | _ONE


class _Level:
    """The catchers of blocks of 2**k words, with the hashes of the windows of that size from word start on."""

    def __init__(self, k: int):
        self.size, self.least, self.need = 1 << k, (2 << k) - 1, 4 if k else 3
        self.factor = np.uint64(pow(_FACTOR, self.size, 2**64))
        self.hashes, self.start = np.zeros(0, np.uint64), 0
        #: For each period the block with which its match began, or -1; blocks before done are compared.
        self.since, self.done = np.full(2 * self.size, -1, np.int64), 0

    @property
    def end(self) -> int:
        return self.start + len(self.hashes)

    def take(self, hashes: np.ndarray) -> None:
        self.hashes = np.concatenate([self.hashes, hashes]) if len(self.hashes) else hashes

    def doubled(self, position: int) -> np.ndarray:
        """Hashes of the windows of twice the size that are complete, from position on."""
        left = self.hashes[position - self.start : max(0, len(self.hashes) - self.size)]
        return left * self.factor + self.hashes[position - self.start + self.size :][: len(left)] | _ONE

    def forget(self, needed: int) -> None:
        """Lets go of windows before word needed that no block will be compared with."""
        drop = max(0, min(needed, self.done * self.size) - self.start)
        self.hashes, self.start = self.hashes[drop:].copy(), self.start + drop

    def compare(self, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Compares each block whose windows are all complete, with last every block. Returns first word, end and
        period of the matches that are over and long enough: words first to end equal those a period later."""
        size, periods = self.size, 2 * self.size
        beyond = self.end - self.least - (0 if last else periods - 1)
        rows = max(0, -(-beyond // size) - self.done)
        same = np.zeros((rows + 1 + last, periods), bool)
        same[0] = self.since >= 0
        if rows:
            at = self.done * size - self.start
            own = self.hashes[at:]
            own = np.concatenate([own, np.zeros(max(0, self.least + rows * size + periods - len(own)), np.uint64)])
            np.equal(sliding_window_view(own[self.least :], periods)[: rows * size : size], own[: rows * size : size, None], out=same[1 : rows + 1])
        found = self._over(same) if same.any() else (np.zeros(0, np.int64),) * 3
        self.done += rows
        return found

    def _over(self, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs the blocks at which matches begin and end, period by period; a match without an end goes on."""
        row, column = np.nonzero(same[1:] & ~same[:-1])
        goes_on = np.flatnonzero(self.since >= 0)
        column, row = np.concatenate([goes_on, column]), np.concatenate([self.since[goes_on], row + self.done])
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        end, of = np.nonzero(same[:-1] & ~same[1:])
        order = np.argsort(of, kind="stable")
        end, of = end[order] + self.done, of[order]
        over = np.arange(len(column)) - np.searchsorted(column, column) < np.searchsorted(of, column, "right") - np.searchsorted(of, column)
        self.since[goes_on] = -1
        self.since[column[~over]] = row[~over]
        row, column = row[over], column[over]
        long = end - row >= self.need
        return row[long] * self.size, end[long] * self.size, column[long] + self.least


class SquareCatchers:
    """The runs of a stream of word numbers, of periods up to longest // TIMES. append takes words, finish ends the stream.

    Numbers below 0 stand for words that equal no other and occur once. Levels keep
    the hashes of the last blocks alone; word numbers are kept, eight bytes each, to verify runs.
    """

    def __init__(self, longest: int):
        self.levels = [_Level(k) for k in range(max(0, (longest // TIMES + 1).bit_length() - 1))]
        self.numbers, self.n = np.zeros(0, np.int64), 0
        self.found: dict[tuple[int, int], int] = {}

    def append(self, numbers: np.ndarray) -> None:
        if self.n + len(numbers) > len(self.numbers):
            grown = np.zeros(max(self.n + len(numbers), 2 * self.n), np.int64)
            grown[: self.n] = self.numbers[: self.n]
            self.numbers = grown
        self.numbers[self.n : self.n + len(numbers)] = numbers
        self.n += len(numbers)
        self._advance(_codes(numbers), False)

    def finish(self) -> list[Run]:
        """All runs as (start, length, period), by start, then period."""
        self._advance(np.zeros(0, np.uint64), True)
        return sorted((a, b - a, p) for (a, b), p in self.found.items())

    def _advance(self, fresh: np.ndarray, last: bool) -> None:
        for k, level in enumerate(self.levels):
            level.take(self.levels[k - 1].doubled(level.end) if k else fresh)
            if k:
                self.levels[k - 1].forget(level.end)
            self._merge(*level.compare(last))
        if self.levels:
            self.levels[-1].forget(self.levels[-1].end)

    def _merge(self, first: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Makes runs of matches. A match within a known run whose period divides its own adds nothing."""
        if len(first) and self.found:
            runs = np.array(sorted((a, b, p) for (a, b), p in self.found.items()))
            furthest = np.maximum.accumulate(np.where(runs[:, 1] >= np.maximum.accumulate(runs[:, 1]), np.arange(len(runs)), 0))
            at = np.searchsorted(runs[:, 0], first, "right") - 1
            _, to, own = runs[furthest[np.maximum(at, 0)]].T
            fresh = (at < 0) | (to < end + period) | (period % own > 0)
            first, end, period = first[fresh], end[fresh], period[fresh]
        for f, e, p in zip(first.tolist(), end.tolist(), period.tolist(), strict=True):
            block = 1 << (p + 1).bit_length() - 2
            low, high = max(0, f - block), min(self.n - p, e + block)
            same = np.concatenate([[False], self.numbers[low:high] == self.numbers[low + p : high + p], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1]) + low
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= (TIMES - 1) * p and b - a + p >= LEAST:
                    # the same words with a multiple of the period are the same run
                    self.found[a, b + p] = min(p, self.found.get((a, b + p), p))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        cut = _BLANK.search(text, at + PIECE_BYTES)
        if cut is None:
            break
        yield text[at : cut.start()].split()
        at = cut.start()
    yield (text[at:] if at else text).split()


class _Text:
    """The words of a text as numbers into a table."""

    def __init__(self, text: bytes, table: defaultdict[bytes, int]):
        self.numbers = np.concatenate([np.fromiter(map(table.__getitem__, words), np.int64, len(words)) for words in _pieces(text)])
        self.runs: list[Run] = []

    def collapsed(self, words: list[bytes]) -> bytes:
        """The words that are left, joined by one space: a run keeps its first period."""
        edges = np.zeros(len(self.numbers) + 1, np.int64)
        for start, length, period in self.runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        kept = self.numbers[np.cumsum(edges[:-1]) == 0] if self.runs else self.numbers
        return b" ".join(map(words.__getitem__, kept.tolist()))


def _find(texts: list[_Text]) -> None:
    """Sets the runs of each text. Texts of about the same length share a stream."""
    classes = defaultdict(list)
    for text in texts:
        if len(text.numbers) >= LEAST:
            classes[(len(text.numbers) // TIMES).bit_length() // 2].append(text)
    for own in classes.values():
        catchers = SquareCatchers(max(len(t.numbers) for t in own))
        if len(own) == 1:
            for at in range(0, len(own[0].numbers), STREAM_WORDS):
                catchers.append(own[0].numbers[at : at + STREAM_WORDS])
        else:
            catchers.append(np.concatenate(list(chain.from_iterable((t.numbers, np.array([-1 - i])) for i, t in enumerate(own)))))
        starts = np.cumsum([0] + [len(t.numbers) + 1 for t in own])
        for start, length, period in catchers.finish():
            i = int(np.searchsorted(starts, start, "right")) - 1
            own[i].runs.append((start - int(starts[i]), length, period))


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs, collapsed.

    Words lie between ASCII white space. runs is array<struct<start, length, period>> by
    start, then period: each stretch of at least LEAST words and TIMES times its smallest
    period that no neighbouring word extends. collapsed is the words, joined by one
    space, less those that any run holds after its first period. A null, empty or
    blank text has no words, no runs and an empty collapsed text; repeated rows, and rows
    without an id, have rows of their own. Texts are whole whatever their length: a task
    holds eight bytes a word, and the distinct words, of one long text, or of some shorter
    ones. Other columns are ignored; an empty table gives an empty one.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    told = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(ids):
                table, first, n = defaultdict(count().__next__), at, 0
                own: list[_Text] = []
                while at < len(ids) and n < STREAM_WORDS:
                    own.append(_Text(texts[at].as_py() or b"", table))
                    n += len(own[-1].numbers)
                    at += 1
                _find(own)
                words = list(table)
                runs = pa.array([[{"start": a, "length": b, "period": c} for a, b, c in t.runs] for t in own], told)
                yield pa.RecordBatch.from_arrays([ids.slice(first, at - first), pa.array([len(t.numbers) for t in own], pa.int64()), runs, pa.array([t.collapsed(words) for t in own], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: int | None, text: bytes) -> bytes:
    """The text, or for a tenth of the ids (by crc32 of the id in decimals) its words with a tail that repeats.

    With h that sum, g = h // 10 and n words, words from a = g % n on repeat the first
    1 + (n - a) // (3 + g % 8) of them, if h % 10 is 0. A null id is in no such tenth.
    """
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    words = text.split() if h % 10 == 0 else []
    if not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a])


def with_planted_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text of each document, as planted makes it; a null text stays null."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            new = [t.as_py() and planted(i.as_py(), t.as_py()) for i, t in zip(batch.column(0), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return slim.mapInArrow(run, "doc_id long, text string")
