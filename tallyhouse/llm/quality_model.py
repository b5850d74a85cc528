"""Quality classifier: a factorisation machine over hashed words and structure.

Features of a text: the share of each hashed word, a few statistics of its
structure (kinds of characters, lines, repetition, word lengths), and metadata
derived from its size. The score adds a linear part and all pairwise
interactions in low-rank form, by the identity
    sum over i<j of <v_i, v_j> x_i x_j = 1/2 sum over f of ((sum v_if x_i)^2 - sum v_if^2 x_i^2),
so it takes time linear in the features a text has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import arrow_text as T

BUCKET_BITS, RANK = 15, 8
#: Labelled documents that the model is fitted on at most, taken by the hash of their id.
SAMPLE = 4_000
THRESHOLD = 0.3

_UPPER = T.byte_set([(0x41, 0x5A)])
_DIGIT = T.byte_set([(0x30, 0x39)])
_LETTER = T.byte_set([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"#*$%&|<>!=+_~^\\/{}[]@")] = True
_LINE = np.arange(256) == 0x0A
STATISTICS = ("bias", "upper", "digit", "mark", "stop", "line", "mean_word", "same_as_before", "repeat_3", "distinct", "marked_words", "lone_marks", "log_words", "log_bytes", "short")


def features(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics by text, feature values, buckets, bounds of each text's features)."""
    w = T.words(chunk, T.SPACED, lower=True)
    n = w.counts.astype(np.int64)
    some = np.maximum(n, 1)
    inside = np.maximum(chunk.per_row(T.SPACED[chunk.data]), 1)
    letters = np.maximum(chunk.per_row(_LETTER[chunk.data]), 1)
    share = lambda table, of: chunk.per_row(table[chunk.data]) / of
    rows = w.rows()
    again = np.zeros(len(rows), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (rows[1:] == rows[:-1])
    at, keys = T.windows(w, 3)
    own = np.searchsorted(w.bounds, at, "right") - 1
    keys = np.unique(T.mix(keys ^ T.mix(own.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    n_three = np.bincount(own, minlength=chunk.rows)
    distinct_three = np.bincount(own[keys], minlength=chunk.rows)
    marks = np.concatenate(([0], np.cumsum(_MARK[chunk.data])))
    in_word = marks[w.ends] - marks[w.starts]
    bucket = (w.hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    sorted_keys, counts = np.unique((rows << BUCKET_BITS) | bucket, return_counts=True)
    feature_rows, buckets = sorted_keys >> BUCKET_BITS, sorted_keys & ((1 << BUCKET_BITS) - 1)
    bounds = np.searchsorted(feature_rows, np.arange(chunk.rows + 1))
    stats = np.stack([
        np.ones(chunk.rows), share(_UPPER, letters), share(_DIGIT, inside), share(_MARK, inside), share(_STOP, inside),
        chunk.per_row(_LINE[chunk.data]) / some, T.sums(w.ends - w.starts, w.bounds) / some / 10, T.sums(again, w.bounds) / some,
        1 - distinct_three / np.maximum(n_three, 1) - (n_three == 0), np.diff(bounds) / some, T.sums(in_word > 0, w.bounds) / some,
        T.sums((in_word > 0) & (in_word == w.ends - w.starts), w.bounds) / some, np.log1p(n) / 10, np.log1p(np.diff(chunk.offsets)) / 12, n < 10,
    ], axis=1).astype(np.float32)
    return stats, (counts / some[feature_rows]).astype(np.float32), buckets, bounds


@dataclass(frozen=True)
class FactorisationMachine:
    """Weights of the statistics first, then of the buckets."""

    linear: np.ndarray
    factors: np.ndarray

    def scores(self, stats, values, buckets, bounds) -> np.ndarray:
        k = stats.shape[1]
        rows = np.repeat(np.arange(len(stats)), np.diff(bounds))
        add = lambda x: np.stack([np.bincount(rows, weights=c, minlength=len(stats)) for c in x.T], axis=1)
        at = buckets + k
        weighted = self.factors[at] * values[:, None]
        total = stats @ self.factors[:k] + add(weighted)
        squares = (stats**2) @ (self.factors[:k] ** 2) + add(weighted**2)
        linear = stats @ self.linear[:k] + np.bincount(rows, weights=self.linear[at] * values, minlength=len(stats))
        return 1 / (1 + np.exp(-np.clip(linear + 0.5 * (total**2 - squares).sum(axis=1), -30, 30)))


def fit_machine(stats, values, buckets, bounds, labels, epochs: int = 8, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """Logistic loss, AdaGrad over mini-batches; the same data give the same machine."""
    k, rng = stats.shape[1], np.random.default_rng(seed)
    size = k + (1 << BUCKET_BITS)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, RANK))
    w[0] = np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)) if len(labels) else 0.0
    gw, gv = np.full(size, 1e-3), np.full((size, RANK), 1e-3)
    for _ in range(epochs if len(labels) else 0):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), 64):
            own = order[start : start + 64]
            n = bounds[own + 1] - bounds[own]
            flat = np.arange(n.sum()) + np.repeat(bounds[own] - np.cumsum(n) + n, n)
            index = np.concatenate([np.tile(np.arange(k), len(own)), buckets[flat] + k])
            x = np.concatenate([stats[own].ravel(), values[flat]]).astype(float)
            row = np.concatenate([np.repeat(np.arange(len(own)), k), np.repeat(np.arange(len(own)), n)])
            factor = v[index] * x[:, None]
            total = np.zeros((len(own), RANK))
            np.add.at(total, row, factor)
            squares = np.zeros(len(own))
            np.add.at(squares, row, (factor**2).sum(axis=1))
            z = np.bincount(row, weights=w[index] * x, minlength=len(own)) + 0.5 * ((total**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
            touched, place = np.unique(index, return_inverse=True)
            dw = np.bincount(place, weights=error[row] * x, minlength=len(touched)) + decay * w[touched]
            dv = np.zeros((len(touched), RANK))
            np.add.at(dv, place, (error[row] * x)[:, None] * (total[row] - factor))
            dv += decay * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= rate * dv / np.sqrt(gv[touched])
    return FactorisationMachine(w.astype(np.float32), v.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> FactorisationMachine:
    """Fits on at most sample labelled documents, those with the least hash of their id.

    Only ids whose crc32 (of the id as text) isn't divisible by five are used, so
    the others stay held out. Rows with a null label or id are left out, and of
    several labels of an id the greatest counts, of several rows of an id the least text, null only
    if there is no other. So an id is one row, however often it is repeated. Tasks turn the texts into
    features; the driver gets the features of the sample alone. Without labelled rows the machine scores all alike.
    """
    ids = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull() & (F.crc32(F.col(doc).cast("string").cast("binary")) % 5 != 0))
    ids = ids.groupBy(F.col(doc).alias("__doc")).agg(F.max(F.col(label).cast("int")).alias("__label")).orderBy(F.xxhash64("__doc"), "__doc").limit(sample)
    rows = docs.select(F.col(doc).alias("__doc"), F.col(text).cast("string").alias("__text")).join(F.broadcast(ids), "__doc").groupBy("__doc", "__label").agg(F.min("__text").alias("__text"))  # at most sample rows

    def step(batch, chunk, at):
        stats, values, buckets, bounds = features(chunk)
        return {"stats": pa.array(list(stats), pa.list_(pa.float32())), "values": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values)), "buckets": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(buckets, pa.int32()))}

    made = T.map_text(rows, "__text", "stats array<float>, values array<float>, buckets array<int>", step, ["__doc", "__label"])
    table = made.toArrow().sort_by("__doc")
    if not len(table):
        return fit_machine(np.zeros((0, len(STATISTICS)), np.float32), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0))
    lists = {n: table.column(n).combine_chunks() for n in ("stats", "values", "buckets")}
    bounds = np.asarray(lists["values"].offsets, np.int64)
    flat = {n: np.asarray(x.flatten()) for n, x in lists.items()}
    return fit_machine(flat["stats"].reshape(len(table), -1), flat["values"], flat["buckets"].astype(np.int64), bounds - bounds[0], np.asarray(table.column("__label")).astype(float))


def score(docs: DataFrame, machine: FactorisationMachine, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc, held_out, score (0 to 1), predicted.

    A null or empty text is scored by its statistics, a text of any length whole. held_out is null for a
    null id. Repeated rows give repeated results, an empty table an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 2**BUCKET_BITS * (RANK + 1) floats

    def step(batch, chunk, at):
        scores = shared.value.scores(*features(chunk))
        return {"score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    scored = T.map_text(docs.select(F.col(doc), F.col(text)), text, "score double, predicted int", step, [doc])
    held_out = F.crc32(F.col(doc).cast("string").cast("binary")) % 5 == 0
    return scored.select(doc, held_out.alias("held_out"), "score", "predicted")


def keep_predicted(docs: DataFrame, machine: FactorisationMachine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of threshold or more, with all their columns.

    Null and empty texts are scored by their statistics. Repeated rows are judged
    alike, an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return T.filter_text(docs, text, lambda chunk: shared.value.scores(*features(chunk)) >= threshold)
