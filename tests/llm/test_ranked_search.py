"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import queries, ranked_search
from tests.llm.test_llm import DOC_SCHEMA, LOWER, ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item id, rank, doc id, score) from (id, text) rows."""
    bags = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, bags)), sum(b.total() for b in bags)
    df = Counter(t for b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, ((doc, _), bag) in enumerate(zip(docs, bags, strict=True)):
            m = 75 + 25 * bag.total() * n_docs // max(1, n_terms)
            score = sum(weight[t] * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, i))
        out += [(item, rank, docs[i][0], -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(300)]
    docs += [(1000 - i, "W1 w7, w7; w30 copies") for i in range(60)] + [(i + 2000, t) for i, t in enumerate(ODD)] + [(None, "w7 w30"), (5, docs[5][1]), (5, docs[5][1])]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 12)))) for i in range(25)] + [(50, None), (51, "unheard of"), (52, "w7 W7 w30"), (None, "w5 é"), (52, "w9"), (53, ODD[6])]
    return docs, items


@pytest.mark.parametrize("owners, block_terms, slice_postings", [(4, 500_000, 250_000), (3, 40, 300), (1, 500_000, 40)])
def test_search_brute_force(spark, corpus, owners, block_terms, slice_postings):
    docs, items = corpus
    own = [spark.createDataFrame(rows, f"{name} long, text string, extra int, term string") for name, rows in (("doc_id", [(*d, 1, "x") for d in docs]), ("item_id", [(*i, 2, "y") for i in items]))]
    got = ranked_search.ranked_search(own[0].repartition(7), own[1], k=5, owners=owners, block_terms=block_terms, slice_postings=slice_postings)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 5)


def test_empty_tables(spark, corpus):
    docs, items = (spark.createDataFrame(rows, f"{name} long, text string") for name, rows in zip(("doc_id", "item_id"), corpus, strict=True))
    none = spark.createDataFrame([], DOC_SCHEMA)
    assert ranked_search.ranked_search(none, items).collect() == []
    assert ranked_search.ranked_search(docs, none.withColumnRenamed("doc_id", "item_id")).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "  ")], "doc_id long, text string")
    assert ranked_search.ranked_search(blank, items).collect() == []


def test_bundles_drop_what_cannot_win(spark, monkeypatch):
    """A common term's postings don't enter the bundles of items that rarer terms have decided."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.sample([f"c{j}" for j in range(8)], 4)) + (" rare" * 3 if i < 30 else "")) for i in range(2000)]
    items = [(0, "rare c7"), (1, " ".join(f"c{j}" for j in range(8)))]
    held, advance = [], ranked_search._advance

    def watched(*a):
        out = advance(*a)
        held.append({r.item: r.n for r in out.groupBy("item").agg(F.sum(F.size("docs")).alias("n")).collect()})
        return out

    monkeypatch.setattr(ranked_search, "_advance", watched)
    got = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 20)
    assert len(held) == 4 and all(h[0] <= 30 for h in held) and held[0][1] > 500


def test_query(spark, sf_small):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_small}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, queries.op13_ranked_search(spark, sf_small).collect()), key=str) == brute(docs, items, 20)
