"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to owners, the rarest terms first. An item's bundle
carries the scores so far of the documents that matter to it, and goes through one
stage an owner: the stage cogroups bundles with the postings of the owner's terms
and adds their integer contributions. Bundles and postings are cut alike into slices of
documents, so that a stage's groups are bounded however common a term is. A
document leaves a bundle only if even the most that the terms of later owners can add
leaves it behind k documents; so nothing that belongs to the result is lost. At the
end the k best of each item are selected over all slices.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.shared import Scratch, lasting

#: (item, term) rows that are worked on together at most, and broadcast; more items are searched for in blocks, each over all documents.
BLOCK_TERMS = 500_000
#: About so many postings make a slice.
SLICE_POSTINGS = 250_000
OWNERS = 4
#: Separators become spaces, A-Z become a-z; bytes beyond ASCII stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BUNDLE = "slice int, item int, docs array<long>, scores array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """item (a number for each row), item_id, and a row for each distinct term with its occurrences q."""
    slim = items.select(F.monotonically_increasing_id().alias("item"), F.col(item).alias("item_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = slim.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [Counter(terms_of(t)) for t in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]))
            terms, q = ([x for c in found for x in f(c)] for f in (Counter.keys, Counter.values))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(terms, pa.binary()), pa.array(q, pa.int64())], names=["item", "item_id", "term", "q"])

    return slim.mapInArrow(run, f"item long, item_id {kind}, term binary, q long")


def _matches(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc (a number), doc_id, n (terms, with repeats), and its terms of the vocabulary with their occurrences."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = held.value
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(2):
                words = terms_of(text.as_py() or b"")
                counts = Counter(words)
                own = counts.keys() & known.keys()
                sizes.append(len(words))
                terms += map(known.__getitem__, own)
                tfs += map(counts.__getitem__, own)
                ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *lists], names=["doc", "doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc long, doc_id {kind}, n long, terms array<int>, tfs array<int>")


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and the row of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # of no chunks at all
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))


@dataclass
class _Corpus:
    """How many documents have a term, and how many terms they have together."""

    documents: int
    terms: int

    def share(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What a term of weight 1 adds to a document of n terms that holds it tf times; below 10**6."""
        m = 75 + 25 * n * self.documents // self.terms
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _term_totals(matches: DataFrame, corpus: _Corpus, n_terms: int) -> DataFrame:
    """term, df, top (the most that it adds to a document at weight 1)."""

    def run(batches):
        df, top = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        for batch in batches:
            terms, row = _flat(batch.column(1))
            df += np.bincount(terms, minlength=n_terms)
            np.maximum.at(top, terms, corpus.share(batch.column(0).to_numpy()[row], _flat(batch.column(2))[0].astype(np.int64)))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (there, df[there], top[there])], names=["term", "df", "top"])

    return matches.select("n", "terms", "tfs").mapInArrow(run, "term long, df long, top long").groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top"))


def _postings(matches: DataFrame, corpus: _Corpus, owner: np.ndarray, slices: int) -> DataFrame:
    """owner, slice, doc, and the owner's terms of the document with what each adds at weight 1. Terms of owner -1 have none."""
    held = matches.sparkSession.sparkContext.broadcast(owner)

    def run(batches):
        owners = held.value
        for batch in batches:
            terms, row = _flat(batch.column(3))
            share = corpus.share(batch.column(2).to_numpy()[row], _flat(batch.column(4))[0].astype(np.int64)).astype(np.int32)
            for k in range(owners.max() + 1):
                at = np.flatnonzero(owners[terms] == k)
                docs, starts = np.unique(row[at], return_index=True)
                ends = pa.array(np.append(starts, len(at)), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x[at], pa.int32())) for x in (terms, share))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), k, np.int32)), *(batch.column(i).take(pa.array(docs)) for i in (0, 1)), *lists], names=["owner", "slice", "doc", "terms", "shares"])

    rows = matches.select(F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int").alias("slice"), "doc", "n", "terms", "tfs")
    return rows.mapInArrow(run, "owner int, slice int, doc long, terms array<int>, shares array<int>")


@dataclass
class _Stage:
    """An owner's part of every item: the item's terms there with their weights (q times w), and the most that later owners add."""

    ends: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    later: np.ndarray


def _stages(pairs: np.ndarray, n_items: int, owner: np.ndarray, weight: np.ndarray, top: np.ndarray) -> list[_Stage]:
    """pairs: item, term, q of each row."""
    out, later = [], np.zeros(n_items, np.int64)
    for k in range(int(owner.max()), -1, -1):
        own = pairs[owner[pairs[:, 1]] == k]
        own = own[np.argsort(own[:, 0], kind="stable")]
        weights = own[:, 2] * weight[own[:, 1]]
        out.append(_Stage(np.searchsorted(own[:, 0], np.arange(n_items + 1)), own[:, 1], weights, later.copy()))
        np.add.at(later, own[:, 0], weights * top[own[:, 1]])
    return out[::-1]


def _advance(bundles: DataFrame, postings: DataFrame, stage: _Stage, k: int) -> DataFrame:
    """The bundles with the contributions of one owner's terms added."""
    held = bundles.sparkSession.sparkContext.broadcast(stage)
    schema = pa.schema([("slice", pa.int32()), ("item", pa.int32()), ("docs", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])

    def add(carried: pa.Table, posted: pa.Table) -> pa.Table:
        stage = held.value
        part = (carried if len(carried) else posted)["slice"][0].as_py()
        terms, row = _flat(posted["terms"])
        shares = _flat(posted["shares"])[0].astype(np.int64)
        held_docs, bundle = _flat(carried["docs"])
        held_scores = _flat(carried["scores"])[0]
        posted_docs = posted["doc"].to_numpy()
        docs = np.unique(np.concatenate([held_docs, posted_docs]).astype(np.int64))
        order = np.argsort(terms, kind="stable")
        terms, shares, at = terms[order], shares[order], np.searchsorted(docs, posted_docs)[row[order]]
        bounds = np.searchsorted(terms, stage.terms), np.searchsorted(terms, stage.terms, "right")
        where = np.searchsorted(docs, held_docs)
        of_item = {item: i for i, item in enumerate(carried["item"].to_pylist())}
        first = np.searchsorted(bundle, np.arange(len(carried) + 1))
        found, ends, kept_docs, kept_scores = [], [0], [], []
        scores = np.zeros(len(docs), np.int64)
        for item in range(len(stage.later)):
            low, high = stage.ends[item], stage.ends[item + 1]
            if item in of_item:
                own = slice(first[of_item[item]], first[of_item[item] + 1])
                scores[where[own]] = held_scores[own]
            for t in range(low, high):
                own = slice(bounds[0][t], bounds[1][t])
                scores[at[own]] += stage.weights[t] * shares[own]
            there = np.flatnonzero(scores)
            if not len(there):
                continue
            got = scores[there]
            scores[there] = 0
            if len(got) > k:
                may = got + stage.later[item] >= np.partition(got, -k)[-k]
                there, got = there[may], got[may]
            found.append(item)
            kept_docs.append(docs[there])
            kept_scores.append(got)
            ends.append(ends[-1] + len(there))
        lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (kept_docs, kept_scores))
        return pa.Table.from_arrays([pa.array(np.full(len(found), part, np.int32)), pa.array(found, pa.int32()), *lists], schema=schema)

    return bundles.groupBy("slice").cogroup(postings.groupBy("slice")).applyInArrow(add, _BUNDLE)


def _best(scored: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id, score from slice-wise bundles: first all that are among the k best scores, then k by id."""
    each = scored.select("item", F.explode(F.arrays_zip("docs", "scores")).alias("x")).select("item", F.col("x.docs").alias("doc"), F.col("x.scores").alias("score"))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    near = each.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= k).drop("place")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc")
    return near.join(matches.select("doc", "doc_id"), "doc").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, pairs: DataFrame, k: int, owners: int, slice_postings: int, scratch: Scratch) -> DataFrame:
    """item (as in pairs), rank, doc_id, score for a block of items that may be broadcast."""
    spark = docs.sparkSession
    rows = pairs.select("item", "term", "q").collect()
    items = {v: i for i, v in enumerate(sorted({r.item for r in rows}))}
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
    matches = scratch.keep(_matches(docs, vocabulary))
    n, total = matches.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    corpus = _Corpus(n, max(1, total))
    df, top, weight = (np.zeros(len(vocabulary), np.int64) for _ in range(3))
    weighed = _term_totals(matches, corpus, len(vocabulary)).withColumn("w", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))))
    for r in weighed.collect():
        df[r.term], top[r.term], weight[r.term] = r.df, r.top, r.w
    # the heaviest terms first, about as many postings for each owner
    rarest = np.argsort(-weight, kind="stable")
    rarest = rarest[(df[rarest] > 0) & (weight[rarest] > 0)]
    owner = np.full(len(vocabulary), -1, np.int32)
    so_far = np.cumsum(df[rarest])
    owner[rarest] = np.minimum(owners - 1, (so_far - df[rarest]) * owners // max(1, int(df.sum())))
    bundles = spark.createDataFrame([], _BUNDLE)
    if len(rarest):
        slices = max(1, -(-int(df.sum()) // slice_postings))
        path = f"{scratch.path}/postings"
        _postings(matches, corpus, owner, slices).write.mode("overwrite").partitionBy("owner").parquet(path)
        postings = spark.read.schema("slice int, doc long, terms array<int>, shares array<int>, owner int").parquet(path)
        told = np.array([(items[r.item], vocabulary[bytes(r.term)], r.q) for r in rows], np.int64)
        for j, stage in enumerate(_stages(told, len(items), owner, weight, top)):
            bundles = scratch.keep(_advance(bundles, postings.filter(F.col("owner") == j).drop("owner"), stage, k))
    numbers = spark.createDataFrame([(i, v) for v, i in items.items()], "number int, item long")
    return _best(bundles, matches, k).withColumnRenamed("item", "number").join(numbers, "number").drop("number")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", owners: int = OWNERS, block_terms: int = BLOCK_TERMS, slice_postings: int = SLICE_POSTINGS) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank (from 1), doc_id, score.

    A term is a run of ASCII letters and digits or of anything beyond ASCII, A-Z as a-z.
    N documents have a term, L terms in all; df of them hold a term, whose weight is
    floor(1000 * ln((2N + 2) / (2df + 1))). A document of n terms that holds it tf times
    scores weight * (10**9 * tf div (1000 * tf + 12 * m)), m = 75 + 25nN div L, for each
    occurrence of the term in the item. Equal scores are ranked by ascending id, null
    last. Documents without a score aren't told, so items may have fewer than k rows, or
    none, as those without terms have. Every row of docs is a document and every row of
    items an item, repeated ones and those without an id too; null texts have no terms,
    other columns are ignored. Empty tables give an empty result. Jobs run when this is
    called; the result is a table in the shared folder.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        pairs = scratch.keep(_item_terms(items, item_id, text))
        blocks = max(1, -(-pairs.count() // block_terms))
        found = []
        for b in range(blocks):
            own = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
            found.append(lasting(_search_block(slim, own, k, owners, slice_postings, scratch).join(own.select("item", "item_id").distinct(), "item")))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.select("item_id", "rank", "doc_id", "score")
