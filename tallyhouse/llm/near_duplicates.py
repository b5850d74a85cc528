"""Near-duplicate documents by ProbMinHash, banding and verification.

Shingles of five words, weighted by 1 + ln(count), are elements of a Poisson
process: element d with weight w arrives at times with gaps of mean 1/w, each
time at one of m registers, and a register keeps the element that came first. Two
texts agree in a register with their probability Jaccard similarity. A text
stops drawing arrivals once they come later than all its registers were taken.
Links are decided by plain sets, so a text that repeats shingles is sketched a
second time with all weights 1, where registers agree with the set similarity.
Without repeats both sketches are the same, so unit bands compare with any text's.

Texts of equal words are one node. Nodes that agree in a whole band share a
group. Within a group no node is paired with all others: each is verified
against one hub, a node of the fewest shingles. If a and b have no shingle in
common outside such a hub h, then |a & b| <= |a & h| and |b| >= |h|, so
J(a, b) <= J(a, h), and likewise J(a, b) <= J(b, h): a link between them means
that both are linked to h. Every other link shares a shingle outside the hub,
and as many as the hub's similarity to a falls short of. Where a group still
holds several classes, its nodes are therefore dealt out by their rarest
shingles outside the hub, no more than such a link needs. Nodes that meet there
share rare text, so most that belong together are joined by verifying those
outside the largest class that meets against one of its nodes, a few times over;
then all nodes of classes that still differ are paired where they meet. No link
between classes is missed, and a large group of copies costs about one pair per
member.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm import arrow_text as T
from tallyhouse.llm.shared import Scratch, lasting

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Where nodes meet they are first verified against so many nodes of the largest class, one turn after another.
MEETING_HUBS = 1, 6
#: Shingles of a node that a meeting's row lists at most.
LISTED = 64


def shingles(chunk: T.Chunk, size: int = SHINGLE) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, text, hash, count) of the distinct shingles; a text of fewer words is one shingle."""
    w = T.words(chunk, T.ALNUM, lower=True)
    at, hashes = T.windows(w, size)
    rows = np.searchsorted(w.bounds, at, "right") - 1
    n = w.counts
    brief = np.flatnonzero((n > 0) & (n < size))
    if len(brief):
        rows, hashes = np.concatenate([rows, brief]), np.concatenate([hashes, _sequence(w, 3)[brief]])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))) if len(rows) else np.zeros(0, np.int64)
    return w, rows[first], hashes[first], np.diff(np.append(first, len(rows)))


def _sequence(w: T.Words, seed: int) -> np.ndarray:
    """A 64-bit hash of each text's sequence of words."""
    place = np.arange(len(w.hashes), dtype=np.uint64) - np.repeat(w.bounds[:-1], w.counts).astype(np.uint64)
    terms = T.mix(w.hashes ^ T.mix(place + np.uint64(seed << 40)))
    total = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    return T.mix(total[w.bounds[1:]] - total[w.bounds[:-1]] + w.counts.astype(np.uint64))


def prob_min_hash(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """The element in each register of each row, as an (n_rows, registers) array of hashes."""
    taken = np.full(n_rows * registers, np.inf)
    element = np.zeros(n_rows * registers, np.uint64)
    latest = np.full(n_rows, np.inf)
    row, code, weight, time = rows, hashes, weights, np.zeros(len(rows))
    step = 0
    while len(row):
        step += 1
        draw = T.mix(code + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(12)).astype(float) + 0.5) / 2**52) / weight
        place = row * registers + (T.mix(draw ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(taken, place, time)
        won = taken[place] == time
        element[place[won]] = code[won]
        here = np.unique(row) if step > 1 else np.arange(n_rows)
        latest[here] = taken.reshape(n_rows, registers)[here].max(axis=1)
        go = time < latest[row]
        row, code, weight, time = row[go], code[go], weight[go], time[go]
    return element.reshape(n_rows, registers)


def sketches(docs: DataFrame, doc: str, text: str, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc, k1, k2 (its words; null without words), size (distinct shingles), b0, b1, … (a key per
    band) and u0, u1, … (the same of unit weights; null where no shingle repeats, as they equal the former)."""

    def band_keys(found, n):
        found = found.reshape(n, bands, rows)
        keys = np.zeros((n, bands), np.uint64)
        for k in range(rows):
            keys = T.mix(keys + found[:, :, k])
        return T.mix(keys ^ T.mix(np.arange(1, bands + 1, dtype=np.uint64)))

    def step(batch, chunk, at):
        w, row, code, count = shingles(chunk, size)
        empty = w.counts == 0
        keys = band_keys(prob_min_hash(row, code, 1 + np.log(count), chunk.rows, bands * rows), chunk.rows)
        repeats = np.bincount(row[count > 1], minlength=chunk.rows) > 0
        again, n = repeats[row], int(repeats.sum())
        unit = np.zeros((chunk.rows, bands), np.uint64)
        unit[repeats] = band_keys(prob_min_hash((np.cumsum(repeats) - 1)[row[again]], code[again], np.ones(int(again.sum())), n, bands * rows), n)
        long_ = lambda x, mask=empty: pa.array(np.ascontiguousarray(x).view(np.int64), mask=mask)
        made = {"k1": long_(_sequence(w, 1)), "k2": long_(_sequence(w, 2)), "size": np.bincount(row, minlength=chunk.rows)}
        return made | {f"b{k}": long_(keys[:, k]) for k in range(bands)} | {f"u{k}": long_(unit[:, k], ~repeats) for k in range(bands)}

    return T.map_text(docs.select(doc, text), text, ", ".join(f"{n} long" for n in ("k1", "k2", "size", *_band_names(bands))), step, [doc])


def _band_names(bands: int) -> list[str]:
    return [f"{kind}{k}" for kind in "bu" for k in range(bands)]


def compare(left: T.Chunk, right: T.Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """For each pair of texts: shared shingles, shingles of either, and those of the right that the left lacks."""
    _, row_a, code_a, _ = shingles(left, size)
    _, row_b, code_b, _ = shingles(right, size)
    key = lambda row, code: T.mix(code ^ T.mix(row.astype(np.uint64) + np.uint64(1)))
    _, in_a, in_b = np.intersect1d(key(row_a, code_a), key(row_b, code_b), assume_unique=True, return_indices=True)
    n = left.rows
    shared = np.bincount(row_a[in_a], minlength=n)
    own = np.ones(len(row_b), bool)
    own[in_b] = False
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row_b[own], minlength=n))))
    beyond = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(code_b[own].view(np.int64)))
    return shared, np.bincount(row_a, minlength=n), np.bincount(row_b, minlength=n), beyond


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (a, b) with linked, whether they are similar enough; short, how many more shared
    shingles that takes; size, b's shingles; and beyond, those outside a."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows = min(next(T.chunks(batch.column(k).slice(at), T.CHUNK_BYTES // 4))[1].rows for k in (2, 3))
                part = batch.slice(at, rows)
                a, b = (next(T.chunks(part.column(k), 1 << 62))[1] for k in (2, 3))
                shared, size_a, size_b, beyond = compare(a, b, size)
                short = np.ceil(similarity / (1 + similarity) * (size_a + size_b) - 1e-9).astype(np.int64) - shared
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(short <= 0), pa.array(short), pa.array(size_b), beyond], names=["a", "b", "linked", "short", "size", "beyond"])
                at += rows

    found = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return found.mapInArrow(run, "a long, b long, linked boolean, short long, size long, beyond array<long>")


def components(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = lasting) -> DataFrame:
    """(node, comp), kept, for every node of the links (a, b); comp is the least node that it is connected to.

    Each round lets every node follow its first neighbour, in an order drawn anew
    by hash, twice over; links whose ends then coincide are settled and leave. A
    fixed share of the nodes goes each round, whatever the shape of the graph (a
    long chain too), so later rounds work on ever fewer links. What the rounds write
    is deleted at the end.
    """
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.keep(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("comp", F.col("node"))
        k = 0
        while not edges.isEmpty():
            place = lambda node: F.struct(F.xxhash64(node, F.lit(k)).alias("at"), F.col(node).alias("node"))  # noqa: B023, E731
            both = edges.union(edges.select("b", "a"))
            first = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("first")).select("node", F.least("first", place("node")).getField("node").alias("next"))
            step = scratch.keep(first.join(first.select(F.col("node").alias("next"), F.col("next").alias("to")), "next").select("node", "to"))
            ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
            edges = scratch.keep(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
            labels = labels.join(step.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
            k += 1
        labels = scratch.keep(labels)
        least = labels.groupBy("comp").agg(F.min("node").alias("least"))
        return keep(labels.join(least, "comp").select("node", F.col("least").alias("comp")))


def _joined(labels: DataFrame, links: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """labels (node, comp) after links (a, b) between its nodes; one link for each two classes is passed on."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
    merged = components(ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), keep)
    merged = merged.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return keep(labels.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))


def near_duplicate_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc, class_id (the least id of its class).

    A class holds the documents connected by links of that Jaccard similarity, or
    more, of their sets of shingles. Texts without words (null ones too) have no
    shingles; each keeps its own id as class. Repeated rows and texts that differ
    in case, punctuation or white space alone share a class. A row without an id
    counts as any other; a class of such rows alone has no id. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(doc).alias("__doc"), F.col(text).cast("string").alias("__text"))
    with Scratch(docs.sparkSession) as scratch:
        keep = scratch.keep
        sketched = keep(sketches(base, "__doc", "__text", bands, rows, size))
        keys = _band_names(bands)
        nodes = sketched.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("__doc").alias("least"), F.first("size").alias("size"), *(F.first(k).alias(k) for k in keys))
        nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()))
        banded = nodes.select("node", "size", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))
        groups = keep(banded.join(banded.groupBy("key").count().filter("count > 1").select("key"), "key"))
        degrees = keep(groups.groupBy("node").agg(F.count("*").alias("degree")))
        wanted = nodes.join(degrees, "node").select("node", "k1", "k2", F.col("least").alias("__doc"))
        texts = keep(_texts(base, wanted))

        hubs = groups.join(degrees, "node").groupBy("key").agg(F.min(F.struct("size", -F.col("degree"), "node")).getField("node").alias("hub"))
        pairs = groups.join(hubs, "key").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        tested = keep(_verified(pairs, texts, similarity, size))
        labels = keep(degrees.select("node").join(components(tested.filter("linked").select("a", "b"), keep), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))
        met = _meetings(tested, labels, scratch)
        done = tested.select("a", "b")
        for choose in (*(partial(_hub_pairs, hubs=k, similarity=similarity) for k in MEETING_HUBS), partial(_class_pairs, scratch=scratch, similarity=similarity)):
            pairs = keep(choose(_named(met, labels)).join(done, ["a", "b"], "left_anti").join(done.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))
            if pairs.limit(1).count():
                found = keep(_verified(pairs, texts, similarity, size).filter("linked").select("a", "b"))
                labels = _joined(labels, found, keep)
                done = done.unionByName(pairs)
        scratch.drop(texts, tested, groups)

        classes = nodes.select("k1", "k2", "node", "least").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = classes.filter("comp <> node").groupBy("comp").agg(F.min("least").alias("other"))
        least = least.join(nodes.select(F.col("node").alias("comp"), "least"), "comp").select("comp", F.least("other", "least").alias("class_id"))
        classes = keep(classes.join(least, "comp", "left").select("k1", "k2", F.coalesce("class_id", "least").alias("class_id")))
        return lasting(sketched.select("__doc", "k1", "k2").join(classes, ["k1", "k2"], "left").select(F.col("__doc").alias(doc), F.coalesce("class_id", "__doc").alias("class_id")))


def _meetings(tested: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Where nodes of different classes that were verified against one hub meet: (a, the hub; shingle; b, a
    node; need; size; outside). Nodes that may be linked meet.

    A node can only be linked past its hub by short shared shingles outside it (one
    at least), so all but short - 1 of them, the rarest in the hub's group, must
    hold one that is shared.
    """
    own = labels.select(F.col("node").alias("b"), "comp")
    named = tested.join(own, "b").select("a", "b", "comp", F.greatest("short", F.lit(1)).alias("need"), "size", "beyond")
    divided = named.groupBy("a").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("a")
    spread = named.filter(F.size("beyond") >= F.col("need")).join(divided, "a").select("a", "b", "comp", "need", "size", F.size("beyond").alias("outside"), F.explode("beyond").alias("shingle"))
    spread = scratch.keep(spread)
    common = spread.groupBy("a", "shingle").agg(F.count("*").alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("held > 1")
    met = spread.join(common, ["a", "shingle"])
    order = Window.partitionBy("a", "b").orderBy("held", "shingle")  # a text's shingles
    met = met.withColumn("place", F.row_number().over(order) + F.col("outside") - F.count("*").over(Window.partitionBy("a", "b")))
    met = scratch.keep(met.filter("low < high and place <= outside - need + 1").select("a", "shingle", "b", "need", "size", "outside"))
    scratch.drop(spread)
    return met


def _named(met: DataFrame, labels: DataFrame) -> DataFrame:
    """met with comp, the class of b now, and members, the size of that class."""
    sizes = labels.groupBy("comp").agg(F.count("*").alias("members"))
    return met.join(labels.withColumnRenamed("node", "b").join(sizes, "comp"), "b")


def _may_link(x: str, y: str, similarity: float) -> str:
    """Whether two nodes at a meeting can be linked, by how many shingles they need in common and by their sizes."""
    return f"greatest({x}need, {y}need) <= least({x}outside, {y}outside) and least({x}size, {y}size) >= {similarity - 1e-9} * greatest({x}size, {y}size)"


def _hub_pairs(met: DataFrame, hubs: int, similarity: float) -> DataFrame:
    """At each meeting the nodes outside its largest class, each with that many nodes of that class, drawn by hash."""
    draw = lambda k: F.max(F.struct("members", "comp", F.xxhash64("b", "shingle", F.lit(k)).alias("at"), "b", "need", "size", "outside"))
    found = met.join(met.groupBy("a", "shingle").agg(F.array(*map(draw, range(hubs))).alias("hubs")), ["a", "shingle"])
    found = found.filter(F.col("comp") != F.col("hubs")[0]["comp"]).withColumn("hub", F.explode("hubs")).filter(_may_link("", "hub.", similarity))
    return found.select(F.least("b", "hub.b").alias("a"), F.greatest("b", "hub.b").alias("b")).distinct()


def _class_pairs(met: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """All pairs of nodes of different classes that meet.

    A pair that meets at many shingles is brought out at the least of those among the
    LISTED least shingles of either node; if these have none in common, wherever it
    meets, and distinct merges the rest.
    """
    divided = met.groupBy("a", "shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("a", "shingle")
    met = met.join(divided, ["a", "shingle"]).select("a", "shingle", "b", "comp", "need", "size", "outside")
    met = met.withColumn("__place", F.row_number().over(Window.partitionBy("a", "b").orderBy("shingle")))
    listed = F.collect_list(F.when(F.col("__place") <= LISTED, F.col("shingle"))).over(Window.partitionBy("a", "b"))
    met = scratch.keep(met.withColumn("listed", listed).drop("__place"))
    x, y = met.alias("x"), met.alias("y")
    once = F.coalesce(F.array_min(F.array_intersect("x.listed", "y.listed")) == F.col("shingle"), F.lit(True))
    # few bytes, much work: shuffled, so that it spreads, however small the table
    pairs = x.join(y.hint("merge"), ["a", "shingle"]).filter(f"x.comp < y.comp and {_may_link('x.', 'y.', similarity)}").filter(once)
    return pairs.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def _texts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text): for each wanted node a text of its words. It is found by the node's least id, or among
    the rows without an id by its words."""
    columns = "node long, __text string"

    def run(batches):
        for batch in batches:
            for at, chunk in T.chunks(batch.column(3)):
                part = batch.slice(at, chunk.rows)
                w = T.words(chunk, T.ALNUM, lower=True)
                same = [_sequence(w, k).view(np.int64) == np.asarray(part.column(k)) for k in (1, 2)]
                yield part.select(["node", "__text"]).filter(pa.array(same[0] & same[1]))

    def words_of(batch, chunk, at):
        w = T.words(chunk, T.ALNUM, lower=True)
        return {"k1": pa.array(_sequence(w, 1).view(np.int64)), "k2": pa.array(_sequence(w, 2).view(np.int64))}

    found = base.join(wanted, "__doc").select("node", "k1", "k2", "__text").mapInArrow(run, columns)
    nameless = T.map_text(base.filter("__doc is null").withColumn("__text_", F.col("__text")), "__text", "k1 long, k2 long", words_of, ["__text_"])
    nameless = nameless.join(wanted.filter("__doc is null"), ["k1", "k2"]).select("node", F.col("__text_").alias("__text"))
    return found.unionByName(nameless).withColumnRenamed("__text", "text").dropDuplicates(["node"])


def drop_near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One document of each class, the one with the least id, with all its columns.

    Of rows that repeat an id one stays. Documents without words and rows with a
    null id all stay. An empty table gives an empty one.
    """
    classes = near_duplicate_classes(docs, doc, text, **limits)
    gone = classes.filter(F.col(doc) != F.col("class_id")).select(doc).distinct()
    kept = docs.join(gone, doc, "left_anti")
    repeated = classes.filter(F.col(doc).isNotNull()).groupBy(doc).count().filter("count > 1").select(doc)
    if repeated.limit(1).count():
        once = kept.join(repeated, doc, "left_semi").dropDuplicates([doc])
        kept = kept.join(repeated, doc, "left_anti").unionByName(once)
    return kept.select(docs.columns)
