"""Token counts by a linear longest-match automaton.

Word-piece tokenisation takes the longest vocabulary piece from the left of
each word, again and again. Here the vocabulary is a trie with failure links:
where a character leads on from no child, the link names the node to go on at
and how many tokens have been completed on the way. Each character is read
once, and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import arrow_text as T

#: Distinct words whose counts a task remembers.
MEMO_WORDS = 400_000


@dataclass(frozen=True)
class WordPieces:
    """A vocabulary: pieces that start a word, and pieces that go on in one."""

    first: tuple[str, ...]
    later: tuple[str, ...]

    @classmethod
    def from_marked(cls, pieces: list[str], mark: str = "##") -> WordPieces:
        """From a list in which the mark stands before pieces that go on."""
        return cls(tuple(p for p in pieces if not p.startswith(mark)), tuple(p[len(mark) :] for p in pieces if p.startswith(mark) and len(p) > len(mark)))

    @classmethod
    def from_sentencepiece(cls, path: str) -> WordPieces:
        """From a SentencePiece file: pieces after one space mark start a word; words keep that mark."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return cls(tuple(p for p in normal if p.startswith("▁") and "▁" not in p[1:]), tuple(p for p in normal if "▁" not in p))


class LongestMatch:
    """The automaton. Node 0 starts a word, node 1 goes on in one."""

    def __init__(self, vocabulary: WordPieces):
        child: list[dict[str, int]] = [{}, {}]
        ends: list[bool] = [False, False]
        for root, pieces in ((0, vocabulary.first), (1, vocabulary.later)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in child[node]:
                        child[node][c] = len(child)
                        child.append({})
                        ends.append(False)
                    node = child[node][c]
                ends[node] = True
        fail, popped = [-1] * len(child), [0] * len(child)
        queue = deque([0, 1])
        while queue:
            v = queue.popleft()
            for c, u in child[v].items():
                if ends[u]:
                    fail[u], popped[u] = 1, 1
                else:
                    z, more = fail[v], popped[v]
                    while z >= 0 and c not in child[z]:
                        more += popped[z]
                        z = fail[z]
                    if z >= 0:
                        fail[u], popped[u] = child[z][c], more
                queue.append(u)
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: str) -> int:
        """Tokens of a word; 0 if it can't be tokenised."""
        child, fail, popped = self.child, self.fail, self.popped
        node = tokens = 0
        for c in word:
            while (to := child[node].get(c)) is None:
                if fail[node] < 0:
                    return 0
                tokens += popped[node]
                node = fail[node]
            node = to
        while node != 1:
            if fail[node] < 0:
                return 0
            tokens += popped[node]
            node = fail[node]
        return tokens


class _Counter:
    """Counts of distinct words of a chunk, with a memo bounded in words."""

    def __init__(self, vocabulary: WordPieces, prefix: str):
        self.automaton, self.prefix = LongestMatch(vocabulary), prefix
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def words(self, chunk: T.Chunk, w: T.Words) -> np.ndarray:
        """Tokens of each word, 0 where it can't be tokenised."""
        long_ = (w.ends - w.starts) > 64
        distinct, sample, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.known) > MEMO_WORDS:
            self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        place = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        found = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        tokens = np.zeros(len(distinct), np.int32)
        tokens[found] = self.counts[place[found]]
        new = np.flatnonzero(~found)
        raw, count, prefix = chunk.data.tobytes(), self.automaton.count, self.prefix
        spelled = zip(w.starts[sample[new]].tolist(), w.ends[sample[new]].tolist(), strict=True)
        tokens[new] = [count(prefix + raw[a:b].decode("utf-8", "replace")) for a, b in spelled]
        keep = new[~long_[sample[new]]]
        known = np.concatenate([self.known, distinct[keep]])
        order = np.argsort(known)
        self.known, self.counts = known[order], np.concatenate([self.counts, tokens[keep]])[order]
        out = tokens[inverse]
        for k in np.flatnonzero(long_):  # long words aren't told apart by a hash
            out[k] = count(prefix + raw[w.starts[k] : w.ends[k]].decode("utf-8", "replace"))
        return out


def _counter(shared, prefix: str, cache: dict = {}) -> _Counter:  # noqa: B006  one per Python worker
    if cache.get("of") is not shared.value:
        cache["of"], cache["counter"] = shared.value, _Counter(shared.value, prefix)
    return cache["counter"]


def token_counts(docs: DataFrame, vocabulary: WordPieces, doc: str = "doc_id", text: str = "text", prefix: str = "▁") -> DataFrame:
    """One row per document: doc, n_words, n_tokens, n_unknown.

    Words lie between ASCII white space; prefix is put before each. A word that
    the vocabulary can't spell is one token and counts in n_unknown. A null or
    empty text has zeros; repeated rows give repeated results; other columns are
    ignored. The vocabulary is broadcast; it is as large as its file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def step(batch, chunk, at):
        w = T.words(chunk, T.SPACED, lower=False)
        tokens = _counter(shared, prefix).words(chunk, w)
        unknown = T.sums(tokens == 0, w.bounds)
        return {"n_words": w.counts.astype(np.int64), "n_tokens": T.sums(tokens, w.bounds) + unknown, "n_unknown": unknown}

    return T.map_text(docs.select(F.col(doc), F.col(text)), text, "n_words long, n_tokens long, n_unknown long", step, [doc])
