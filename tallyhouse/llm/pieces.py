"""SentencePiece encoding and decoding by suffix-array matching.

The segments of a batch that weren't seen before are concatenated and indexed
by a suffix array. Every piece of the vocabulary is binary-searched for its
range of occurrences; those are the edges of the batch's token lattice. Sorted
by position they are relaxed into ids: for a unigram model by the best score
of a path to each position, for a BPE model by merging neighbours along edges,
best piece first, as its training did. A segment is a stretch of text that no
piece reaches across, so segments can be encoded on their own and kept.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import arrow_text as T

SPACE = "▁"
#: Segments kept from batch to batch, and characters indexed at a time.
MEMO_SEGMENTS, INDEX_CHARS = 400_000, 400_000
#: Longer segments are merged one by one with a heap.
LOCKSTEP_CHARS = 48
LONG_BYTES, MOST_CROSSING = 64, 32
_LONG_SEED = 0xA0761D6478BD642F
_NONE = np.int32(2**30)
#: Kinds of bytes: spaces, letters with all beyond ASCII, and the rest.
_KIND = np.full(256, 2, np.uint8)
_KIND[0x20] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs of a SentencePiece model; small, so it can be broadcast."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    unknown_id: int
    algorithm: str = "bpe"
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str, algorithm: str = "bpe", dummy_prefix: bool = True) -> PieceModel:
        """Reads a model file without normalisation rules; algorithm is bpe or unigram."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = tuple(model.id_to_piece(i) for i in ids)
        at = {p: i for i, p in enumerate(pieces)}
        normal = tuple(not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in ids)
        byte_ids = tuple(at.get(f"<0x{b:02X}>", -1) if model.is_byte(at.get(f"<0x{b:02X}>", 0)) else -1 for b in range(256))
        return cls(pieces, tuple(model.get_score(i) for i in ids), normal, byte_ids, model.unk_id(), algorithm, dummy_prefix)


class PieceEncoder:
    """Encodes and decodes texts; keeps the ids of a bounded number of segments."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.ids = np.array([i for i, ok in enumerate(model.normal) if ok], np.int32)
        pieces = [model.pieces[i] for i in self.ids]
        self.longest = max(map(len, pieces), default=1)
        chars = sorted({c for p in pieces for c in p})
        self.codes = np.full(0x110000, 1, np.uint16)  # 0: beyond the end, 1: in no piece
        self.codes[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        self.codes[ord(" ")] = self.codes[ord(SPACE)]  # segments keep the plain space
        self.words = -(-self.longest // 4)
        self.patterns = np.zeros((len(pieces), self.words * 4), np.uint64)
        for k, p in enumerate(pieces):
            self.patterns[k, : len(p)] = self.codes[[ord(c) for c in p]]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        scores = np.array([model.scores[i] for i in self.ids])
        self.scores = np.full(len(model.pieces), -np.inf)
        self.scores[self.ids] = scores
        self.rank = np.full(len(model.pieces) + 1, _NONE, np.int32)  # dense rank, best score first
        self.rank[self.ids] = np.unique(-scores, return_inverse=True)[1]
        self.unknown_score = (scores.min() if len(scores) else 0.0) - 10.0
        has_bytes = min(model.byte_ids) >= 0
        self.byte_ids = np.array(model.byte_ids, np.int32) if has_bytes else None
        shown = [p.replace(SPACE, " ") if ok else "" for p, ok in zip(model.pieces, model.normal, strict=True)]
        shown[model.unknown_id] = " ⁇ "
        for b, i in enumerate(model.byte_ids if has_bytes else ()):
            shown[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.shown = shown
        self.is_byte = np.zeros(len(model.pieces), bool)
        if has_bytes:
            self.is_byte[self.byte_ids] = True
        self.pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.whole = any(p[1] == SPACE != p[0] for p in self.pairs)  # pieces go on after a space: texts stay whole
        crossing = sorted(p for p in self.pairs if SPACE not in p and (_KIND[ord(p[0]) if p[0] < "\x80" else 128] != _KIND[ord(p[1]) if p[1] < "\x80" else 128]))
        self.by_space = len(crossing) > MOST_CROSSING
        self.crossing = [] if self.by_space else [(c[0].encode(), c[1].encode()) for c in crossing]
        self._forget()

    def _forget(self) -> None:
        """Empties the memo: hashes (sorted) and, beside each, the number of its segment."""
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # --- index and edges -------------------------------------------------

    def _edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of every piece in code: (start, length, id), by start."""
        n = len(code)
        padded = np.zeros(n + self.words * 4, np.uint64)
        padded[:n] = code
        keys = [sum(padded[4 * w + k : 4 * w + k + n] << np.uint64(16 * (3 - k)) for k in range(4)) for w in range(self.words)]
        suffixes = self._suffix_array(keys)
        sorted_keys = np.stack([k[suffixes] for k in keys])
        low_key, high_key = self.patterns.copy(), self.patterns.copy()
        high_key[high_key == 0] = 0xFFFF
        pack = lambda m: [sum(m[:, 4 * w + k] << np.uint64(16 * (3 - k)) for k in range(4)) for w in range(self.words)]

        def search(wanted: list[np.ndarray], right: bool) -> np.ndarray:
            low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n, np.int64)
            while (open_ := low < high).any():
                middle = np.minimum((low + high) // 2, n - 1)
                less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
                for w in range(self.words):
                    there = sorted_keys[w][middle]
                    less |= same & (there < wanted[w])
                    same &= there == wanted[w]
                onward = (less | same if right else less) & open_
                low = np.where(onward, middle + 1, low)
                high = np.where(open_ & ~onward, middle, high)
            return low

        first, last = search(pack(low_key), False), search(pack(high_key), True)
        count = last - first
        piece = np.repeat(np.arange(len(count)), count)
        start = suffixes[np.arange(len(piece)) + np.repeat(first - np.cumsum(count) + count, count)]
        edges = np.sort((start << 32) | piece)  # by position
        start, piece = edges >> 32, edges & 0xFFFFFFFF
        return start, self.lengths[piece], self.ids[piece]

    def _suffix_array(self, keys: list[np.ndarray]) -> np.ndarray:
        """Suffixes in order of their first characters, as many as keys hold (four each), by doubling."""
        rank, width = keys[0], 1
        while True:
            order = np.argsort(rank)
            if width >= len(keys):
                return order
            put = rank[order]
            dense = np.zeros(len(rank), np.uint64)
            dense[order[1:]] = np.cumsum(put[1:] != put[:-1])
            shifted = np.zeros(len(rank), np.uint64)
            shifted[: max(len(rank) - 4 * width, 0)] = dense[4 * width :] + np.uint64(1)
            rank, width = (dense << np.uint64(32)) | shifted, 2 * width

    def _table(self, code: np.ndarray) -> np.ndarray:
        """Piece id by start and length, -1 where no edge is."""
        table = np.full((len(code), self.longest + 1), -1, np.int32)
        start, length, ids = self._edges(code)
        table[start, length] = ids
        return table

    # --- relaxation ------------------------------------------------------

    def _viterbi(self, table: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """True at each position where a token of the best path starts."""
        n = len(table)
        best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
        sizes = np.diff(bounds)
        # a position can end one segment and start the next: ends live at position + segment number
        own = np.repeat(np.arange(len(sizes)), sizes)
        best, back = np.full(n + len(sizes) + 1, -np.inf), np.zeros(n + len(sizes) + 1, np.int64)
        best[bounds[:-1] + np.arange(len(sizes))] = 0
        at = np.arange(n) - bounds[:-1][own]
        by_step = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[by_step], np.arange(at.max() + 2 if n else 1))
        for step in range(len(cuts) - 1):
            here = by_step[cuts[step] : cuts[step + 1]]
            node = here + own[here]
            for length in range(1, self.longest + 1):
                ids = table[here, length]
                score = np.where(ids >= 0, self.scores[ids], self.unknown_score if length == 1 else -np.inf)
                fits = here + length <= bounds[own[here] + 1]
                to, new = node[fits] + length, (best[node] + score)[fits]
                better = new > best[to]
                best[to[better]], back[to[better]] = new[better], length
        starts = np.zeros(n, bool)
        at_end = bounds[1:].copy()
        segment = np.arange(len(sizes))
        while len(segment):
            more = at_end > bounds[segment]
            at_end, segment = at_end[more], segment[more]
            at_end = at_end - back[at_end + segment]
            starts[at_end] = True
        return starts

    def _merge_lockstep(self, table: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """True at each position where a token starts; one merge in every segment a round."""
        starts = np.ones(len(table), bool)
        rank = self.rank
        symbol = np.arange(len(table), dtype=np.int64)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        while len(symbol) > 1:
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            if not len(pair):
                break
            after = np.append(symbol[1:], 0)
            end = np.where(np.append(owner[1:] != owner[:-1], True), bounds[owner + 1], after)
            length = end[pair + 1] - symbol[pair]
            ok = length <= self.longest
            pair, length = pair[ok], length[ok]
            worth = rank[table[symbol[pair], length]]
            ok = worth < _NONE
            pair, worth = pair[ok], worth[ok]
            if not len(pair):
                break
            key = (worth.astype(np.int64) << 32) | pair
            of = owner[pair]
            group = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            gone = (np.minimum.reduceat(key, group) & 0xFFFFFFFF) + 1
            starts[symbol[gone]] = False
            keep = np.zeros(bounds.shape[0], bool)
            keep[of[group]] = True
            left = keep[owner]
            left[gone] = False
            symbol, owner = symbol[left], owner[left]
        return starts

    def _merge_heap(self, table: np.ndarray, low: int, high: int) -> np.ndarray:
        """The same for one segment, by a heap of its pairs."""
        n = high - low
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and nxt[j] - i <= self.longest and (r := int(self.rank[table[low + i, nxt[j] - i]])) < _NONE:
                heapq.heappush(heap, (r, i, nxt[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := nxt[i]) >= n or nxt[j] != end:
                continue
            alive[j] = False
            nxt[i] = end
            if end < n:
                prev[end] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
        return np.array(alive, bool)

    def _relax(self, table: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.model.algorithm == "unigram":
            return self._viterbi(table, bounds)
        sizes = np.diff(bounds)
        starts = np.ones(len(table), bool)
        small = sizes <= LOCKSTEP_CHARS
        inside = np.repeat(small, sizes)
        short = np.concatenate(([0], np.cumsum(sizes[small])))
        starts[inside] = self._merge_lockstep(table[inside] if not small.all() else table, short)
        for k in np.flatnonzero(~small):
            starts[bounds[k] : bounds[k + 1]] = self._merge_heap(table, bounds[k], bounds[k + 1])
        return starts

    def _cut(self, segment: str) -> list[str]:
        """A long segment at every place that no piece reaches across."""
        marked = segment.replace(" ", SPACE)
        cuts = [0, *(k for k in range(1, len(segment)) if marked[k - 1 : k + 1] not in self.pairs), len(segment)]
        return [segment[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _encode_new(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, flat, and how many each has."""
        if self.byte_ids is not None and max(map(len, segments)) > LOCKSTEP_CHARS:
            parts = [self._cut(s) if len(s) > LOCKSTEP_CHARS else [s] for s in segments]
            ids, counts = self._encode_runs([x for p in parts for x in p])
            return ids, T.sums(counts, np.concatenate(([0], np.cumsum([len(p) for p in parts]))))
        return self._encode_runs(segments)

    def _encode_runs(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_encode_cut over runs of at most INDEX_CHARS characters, or one longer segment that can't be cut."""
        done, at = [], 0
        while at < len(segments) or not done:
            to, size = at, 0
            while to < len(segments) and (to == at or size + len(segments[to]) <= INDEX_CHARS):
                size += len(segments[to])
                to += 1
            done.append(self._encode_cut(segments[at:to]))
            at = max(to, 1)
        ids, counts = zip(*done, strict=True)
        return np.concatenate(ids), np.concatenate(counts)

    def _encode_cut(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in segments]))).astype(np.int64)
        # one code that stands in no piece between segments keeps matches inside them
        at = np.arange(len(points)) + np.repeat(np.arange(len(segments)), np.diff(bounds))
        spaced = np.ones(len(points) + len(segments), np.uint16)
        spaced[at] = self.codes[points]
        table = self._table(spaced)[at]
        starts = self._relax(table, bounds)
        begin = np.flatnonzero(starts)
        owner = np.searchsorted(bounds, begin, "right") - 1
        end = np.append(begin[1:], len(points))
        ids = table[begin, np.minimum(end - begin, self.longest)]
        lost = np.flatnonzero(ids < 0)
        if not len(lost):
            return ids, np.bincount(owner, minlength=len(segments))
        if self.byte_ids is None:
            ids[lost] = self.model.unknown_id
            if len(lost) > 1:  # neighbouring unknowns are one token
                again = lost[1:][(lost[1:] == lost[:-1] + 1) & (owner[lost[1:]] == owner[lost[:-1]])]
                keep = np.ones(len(ids), bool)
                keep[again] = False
                ids, owner = ids[keep], owner[keep]
            return ids, np.bincount(owner, minlength=len(segments))
        c = points[begin[lost]].astype(np.int64)
        size = np.ones(len(ids), np.int64)
        size[lost] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        out = np.repeat(ids, size)
        first = (np.cumsum(size) - size)[lost]
        for extra in range(4):
            mine = size[lost] > extra
            last = size[lost][mine] - 1
            bits = (c[mine] >> (6 * (last - extra))) & 0x3F
            if extra:
                value = 0x80 | bits
            else:
                value = np.where(last == 0, c[mine], ((0xFF00 >> (last + 1)) & 0xFF) | (c[mine] >> (6 * last)))
            out[first[mine] + extra] = self.byte_ids[value]
        return out, np.bincount(owner, weights=size, minlength=len(segments)).astype(np.int64)

    # --- texts -----------------------------------------------------------

    def _segments(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, segment starts with the end of the last, first segment of each text)."""
        data, offsets = chunk.data, chunk.offsets
        if b"\xe2\x96\x81" in (raw := data.tobytes()):  # the space mark itself stands for a space
            texts = [raw[a:b].replace(b"\xe2\x96\x81", b" ") for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        if self.model.dummy_prefix:
            full = offsets[:-1][np.diff(offsets) > 0]
            data = np.insert(data, full, 0x20)
            offsets = offsets + np.searchsorted(full, offsets, "left")
        n = len(data)
        begin = np.zeros(n, bool)
        if not self.whole and n:
            kind = _KIND[data]
            begin[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
            if self.by_space:
                begin &= kind == 0
            for left, right in self.crossing:
                raw, at = data.tobytes(), 0
                while (at := raw.find(left + right, at)) >= 0:
                    begin[at + len(left)] = False
                    at += 1
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        return data, np.append(starts, n), np.searchsorted(starts, offsets)

    def encode_chunk(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and where each text's ids start (one bound more than texts)."""
        data, cuts, first = self._segments(chunk)
        begin, end = cuts[:-1], cuts[1:]
        hashes = T.span_hashes(data, begin, end, lower=False)
        is_long = end - begin > LONG_BYTES
        hashes[is_long] = T.mix(begin[is_long].astype(np.uint64)) ^ np.uint64(_LONG_SEED)  # never looked up again
        distinct, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        found = np.zeros(len(distinct), bool)
        inside = place < len(self.known)
        found[inside] = self.known[place[inside]] == distinct[inside]
        found &= ~is_long[sample]
        if len(self.known) + (~found).sum() > MEMO_SEGMENTS and len(self.known):
            self._forget()
            found[:] = False
            place[:] = 0
        new = np.flatnonzero(~found)
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[sample[new]].tolist(), end[sample[new]].tolist(), strict=True)]
        number = np.empty(len(distinct), np.int64)
        number[found] = self.number[place[found]]
        number[new] = len(self.bounds) - 1 + np.arange(len(new))
        flats, counts, at = [self.flat], [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= INDEX_CHARS):
                size += len(texts[to])
                to += 1
            ids, count = self._encode_new(texts[at:to])
            flats.append(ids.astype(np.int32))
            counts.append(count)
            at = to
        flat = np.concatenate(flats)
        bounds = np.concatenate([self.bounds, *(len(self.flat) + np.cumsum(np.concatenate(counts)) for _ in counts[:1])])
        which = number[inverse]
        size = bounds[which + 1] - bounds[which]
        ids = flat[np.arange(int(size.sum())) + np.repeat(bounds[which] - np.cumsum(size) + size, size)]
        ends = np.concatenate(([0], np.cumsum(size)))
        if len(texts):
            self.known = np.concatenate([self.known, distinct[new]])
            self.number = np.concatenate([self.number, number[new]])
            order = np.argsort(self.known)
            self.known, self.number, self.flat, self.bounds = self.known[order], self.number[order], flat, bounds
        if is_long.any():
            self._forget()
        return ids, ends[first]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode_chunk for texts in memory."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        return self.encode_chunk(T.Chunk(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes put together, the dummy space gone."""
        text = "".join([self.shown[i] for i in ids])
        if self.byte_ids is not None:
            try:
                text.encode()
            except UnicodeEncodeError:
                text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def encoder_of(model, cache: dict = {}) -> PieceEncoder:  # noqa: B006  one per Python worker
    """The worker's encoder for a broadcast model."""
    if cache.get("of") is not model.value:
        cache["of"], cache["encoder"] = model.value, PieceEncoder(model.value)
    return cache["encoder"]


def chunk_texts(chunk: T.Chunk) -> list[str]:
    data, bounds = chunk.data.tobytes(), chunk.offsets.tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]


def encode(docs: DataFrame, model: PieceModel, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc, n_tokens, ids, round_trip (decoding gives the text back).

    A null or empty text has no ids and decodes to the empty text. The space
    mark U+2581 in a text decodes to a space, so such a text doesn't round-trip.
    Repeated rows give repeated results; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch, chunk, at):
        encoder = encoder_of(shared)
        texts = chunk_texts(chunk)
        ids, bounds = encoder.encode_chunk(chunk)
        flat, ends = ids.tolist(), bounds.tolist()
        same = [encoder.decode(flat[a:b]) == t for a, b, t in zip(ends, ends[1:], texts, strict=False)]
        return {"n_tokens": np.diff(bounds), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), "round_trip": pa.array(same, pa.bool_())}

    return T.map_text(docs.select(doc, text), text, "n_tokens long, ids array<int>, round_trip boolean", step, [doc])


def decode(encoded: DataFrame, model: PieceModel, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per encoded row: doc, text. Null ids decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    slim = encoded.select(doc, F.col(ids).cast("array<int>").alias("__ids"))

    def run(batches):
        encoder = encoder_of(shared)
        for batch in batches:
            texts = [encoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc, "text"])

    return slim.mapInArrow(run, f"`{doc}` {slim.schema[0].dataType.simpleString()}, text string")
