"""Common lines against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.lasting import Scratch
from tallyhouse.llm import line_dedup, queries
from tests.llm.test_llm import DOC_SCHEMA, LOWER, ODD


def key(line):
    return line.strip(" \t\n\v\f\r").translate(LOWER)


def brute(texts, at_least=line_dedup.AT_LEAST):
    """(lines, lines dropped, text kept) of each text."""
    lines = [(t or "").split("\n") for t in texts]
    found = Counter(k for own in lines for k in {key(x) for x in own} if k)
    kept = [[x for x in own if found[key(x)] < at_least] for own in lines]
    return [(len(a), len(a) - len(b), "\n".join(b)) for a, b in zip(lines, kept, strict=True)]


@pytest.fixture(scope="module")
def shared_lines():
    """Texts that share lines in several spellings; one text in forty copies, one line in nine and one in ten documents."""
    rng = random.Random(5)
    pool = [f"  Line number {i} of the pool\t" for i in range(30)] + ["", "   ", "ÄÖÜ Straße", "\x0bVT and FF\x0c", "x\r"]
    texts = ["\n".join(rng.choice([str.upper, str.lower, str])(rng.choice(pool)) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts += ["Same text\nin many copies\nwith three lines"] * 40 + ["just nine\nown " + str(i) for i in range(9)] + ["just TEN \nown " + str(i) for i in range(10)]
    return texts + list(ODD)


@pytest.mark.parametrize("broadcast_keys", [0, line_dedup.BROADCAST_KEYS])
def test_line_cuts_brute_force(spark, shared_lines, broadcast_keys):
    rows = [(i, t) for i, t in enumerate(shared_lines)] + [(None, "just ten"), (3, shared_lines[3])]
    expected = brute([t for _, t in rows])
    cuts = line_dedup.line_cuts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), broadcast_keys=broadcast_keys)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, cuts.collect()), key=order) == sorted(((i, *e) for (i, _), e in zip(rows, expected, strict=True)), key=order)
    assert any(e[1] and e[2] == "" for e in expected) and any("just nine" in e[2] for e in expected)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


@pytest.mark.parametrize("broadcast_keys", [0, line_dedup.BROADCAST_KEYS])
def test_clashing_columns_stay(spark, broadcast_keys):
    """Columns with the operator's own names come back as they were."""
    rows = [(f"k{i}", i, "banner\nown " + str(i), [1.5], i) for i in range(10)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "k1 string, n_lines int, text string, kept array<double>, `a b` int")
    out = line_dedup.drop_common_lines(docs, broadcast_keys=broadcast_keys)
    assert out.columns == docs.columns
    want = {(f"k{i}", i, f"own {i}", (1.5,), i) for i in range(10)} | {(None, None, "", None, None)}
    assert {(r[0], r[1], r[2], r[3] and tuple(r[3]), r[4]) for r in out.collect()} == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], DOC_SCHEMA)
    assert line_dedup.line_cuts(docs).collect() == [] and line_dedup.drop_common_lines(docs).columns == docs.columns


def test_runs_in_any_batches(spark):
    """Batches of any sizes and number give the common keys of all; keys known as common aren't counted again, and no run is shuffled."""
    rng = random.Random(1)
    batches = [[(rng.randrange(40), 0, rng.randrange(1, 4)) for _ in range(rng.randrange(0, 40))] for _ in range(6)]
    total = Counter()
    with Scratch(spark) as scratch:
        runs = line_dedup.LineRuns(spark, scratch.path)
        try:
            for k, batch in enumerate(batches):
                keys = spark.createDataFrame(batch, "k1 long, k2 long, n long")
                if k == 4:
                    known = {r.k1 for t in runs.levels if t for r in spark.table(t).filter("common").collect()}
                    assert known and not known & {r.k1 for r in runs.unknown(keys).collect()}
                    plan = runs.unknown(keys.groupBy("k1", "k2").agg(F.sum("n").alias("n")))._jdf.queryExecution().executedPlan().toString()
                    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
                runs.add(keys)
                for k1, _, n in batch:
                    total[k1] += n
                assert [bool(t) for t in runs.levels] == [bool(k + 1 >> i & 1) for i in range((k + 1).bit_length())]
            assert {r.k1 for r in runs.common().collect()} == {k for k, n in total.items() if n >= line_dedup.AT_LEAST}
        finally:
            runs.close()


def test_query(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, n, dropped, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, dropped, kept) in zip(docs, brute([r.text for r in docs]), strict=True)}
    assert {tuple(r) for r in queries.op11_line_dedup(spark, sf_small).collect()} == want
