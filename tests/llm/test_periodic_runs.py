"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyhouse.llm import periodic_runs, queries
from tests.llm.test_llm import DOC_SCHEMA, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Each stretch of words that equal those p later, for every p; of stretches with equal words the least p."""
    numbers = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int)
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        same = np.concatenate([[False], numbers[:-p] == numbers[p:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a + p >= max(6, 4 * p):
                found.setdefault((a, b + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def brute_collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def brute_planted(doc_id, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    if h % 10 or not words or doc_id is None:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def odd_words(rng, n):
    """Words with many repeats: single ones, blocks, blocks cut short."""
    out = []
    while len(out) < n:
        block = [rng.randrange(rng.choice([2, 4, 100])) for _ in range(rng.randrange(1, 12))]
        out += (block * rng.randrange(1, 8))[: rng.randrange(1, 60)] if rng.random() < 0.6 else [rng.randrange(3)] * rng.randrange(1, 12)
    return out[:n]


def test_catchers_word_by_word():
    """Runs are those of brute force however the words come in, one by one or all at once."""
    rng = random.Random(3)
    for _ in range(400):
        words = odd_words(rng, rng.randrange(0, 220))
        want = brute(list(map(str, words)))
        for steps in ([1], [1, 2, 3, 10, 40], [1000]):
            catchers, at = periodic_runs.SquareCatchers(len(words) + rng.randrange(9)), 0
            while at < len(words):
                step = rng.choice(steps)
                catchers.append(np.array(words[at : at + step], np.int64))
                at += step
            assert catchers.finish() == want


def test_catchers_keep_a_few_blocks():
    """A level keeps hashes of a few of its blocks, however long the stream is."""
    catchers, words = periodic_runs.SquareCatchers(400), np.random.default_rng(1).integers(0, 50, 20_000)
    for at in range(0, len(words), 100):
        catchers.append(words[at : at + 100])
        assert all(len(level.hashes) <= 8 * level.size + 100 for level in catchers.levels)
    block = np.arange(3_000)
    catchers = periodic_runs.SquareCatchers(30_000)
    catchers.append(np.tile(block, 10))
    assert catchers.finish() == [(0, 30_000, 3_000)]
    catchers = periodic_runs.SquareCatchers(200_000)
    catchers.append(np.zeros(200_000, np.int64))
    assert catchers.finish() == [(0, 200_000, 1)]


@pytest.mark.parametrize("stream_words, piece_bytes", [(periodic_runs.STREAM_WORDS, periodic_runs.PIECE_BYTES), (50, 40)])
def test_runs_of_documents(spark, monkeypatch, stream_words, piece_bytes):
    rng = random.Random(8)
    texts = ["  ".join(map(str, odd_words(rng, rng.randrange(0, 150)))) for _ in range(60)] + list(ODD) + ["\x0bno\x0cno\rno\tno no\nno no no"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, texts[5])]
    monkeypatch.setattr(periodic_runs, "STREAM_WORDS", stream_words)
    monkeypatch.setattr(periodic_runs, "PIECE_BYTES", piece_bytes)
    made = []
    for _, t in rows:
        blob = (t or "").encode()
        assert [w for piece in periodic_runs._pieces(blob) for w in piece] == blob.split()
        made.append(blob)
    for group in ([i] for i in range(0, len(made), 7)):  # alone in a stream, piece by piece
        table = periodic_runs.defaultdict(periodic_runs.count().__next__)
        own = [periodic_runs._Text(made[i], table) for i in group]
        periodic_runs._find(own)
        assert [t.runs for t in own] == [brute(WORD.findall(made[i].decode())) for i in group]
    out = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        runs = brute(words)
        want.append((i, len(words), tuple(runs), brute_collapsed(words, runs)))
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in out), key=order) == sorted(want, key=order)
    assert sum(len(r.runs) for r in out) > 50


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert periodic_runs.periodic_runs(empty).collect() == [] and periodic_runs.with_planted_tails(empty).collect() == []


def test_clashing_columns_and_ids(spark):
    """Other columns, those with the operator's names too, are ignored; ids may be of any type."""
    docs = spark.createDataFrame([("a", "x " * 9, 1, "r"), (None, None, None, None)], "doc_id string, text string, runs int, collapsed string")
    assert sorted(map(tuple, periodic_runs.periodic_runs(docs).collect()), key=str) == sorted([("a", 9, [(0, 9, 1)], "x"), (None, 0, [], "")], key=str)


def test_query(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in docs:
        words = brute_planted(r.doc_id, r.text)
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        told = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.add((r.doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()))
    got = queries.op12_periodic_runs(spark, sf_small)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {tuple(r) for r in got.collect()} == want and sum(w[1] > 0 for w in want) > 10
