"""Quality rules over tokeniser fertility.

A public tokeniser, trained on ordinary prose, needs more tokens for text unlike
prose. Measured per document: characters per token, the share of tokens that
fall back to bytes, and the entropy of the tokens. Each has an accepted band per
language, or per script where the language has none or the text isn't written in
its script; a document outside one is rejected, as is one that fails the base
rules on length and repetition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import arrow_text as T
from tallyhouse.llm.pieces import PieceModel, encoder_of

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """Accepted values of a language or script, ends included; script is the one a language is written in.

    The entropy of prose grows with its length, so it is held against a curve in
    x = log2(tokens), x kept within 6 to 15: curve[0] + curve[1] x + curve[2] x^2;
    entropy bounds the difference from it in bits.
    """

    chars_per_token: tuple[float, float]
    tokens_per_word: tuple[float, float]
    byte_share: tuple[float, float]
    entropy: tuple[float, float]
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    script: str = ""


#: Letters of each script as code point ranges, ends included. Where
#: a text has as many of two scripts, the earlier one counts.
SCRIPTS: dict[str, list[tuple[int, int]]] = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x531, 0x586)],
    "Hebrew": [(0x5D0, 0x5EA)],
    "Arabic": [(0x620, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)],
}


#: Bands by language and by script for the 32,000-piece vocabulary; the empty key
#: serves the rest. Those of scripts are wide: they come from short prose in each,
#: as the tables hold Latin alone. Tokens of line ends don't count as byte fallback.
BANDS: dict[str, Band] = {
    "en": Band((1.9, 8.0), (1.0, 3.25), (0.0, 0.05), (-0.37, 1.5), (1.625, 0.859, -0.0341), "Latin"),
    "de": Band((1.9, 8.0), (1.0, 3.25), (0.0, 0.05), (-0.38, 1.5), (2.058, 0.760, -0.0301), "Latin"),
    "fr": Band((1.8, 8.0), (1.0, 3.30), (0.0, 0.05), (-0.40, 1.5), (2.685, 0.636, -0.0247), "Latin"),
    "es": Band((1.8, 8.0), (1.0, 3.65), (0.0, 0.05), (-0.39, 1.5), (2.346, 0.703, -0.0271), "Latin"),
    "Latin": Band((1.2, 8.0), (1.0, 5.0), (0.0, 0.10), (4.0, 12.0)),
    "Greek": Band((0.8, 2.0), (2.5, 10.0), (0.0, 0.10), (3.2, 12.0)),
    "Cyrillic": Band((1.2, 5.0), (1.2, 6.0), (0.0, 0.10), (4.0, 12.0)),
    "Armenian": Band((0.6, 1.6), (4.0, 14.0), (0.0, 0.45), (3.2, 12.0)),
    "Hebrew": Band((0.8, 1.8), (2.5, 10.0), (0.0, 0.10), (3.2, 12.0)),
    "Arabic": Band((0.8, 2.2), (2.5, 10.0), (0.0, 0.15), (3.2, 12.0)),
    "Devanagari": Band((0.6, 1.8), (2.0, 10.0), (0.0, 0.30), (3.2, 12.0)),
    "Bengali": Band((0.6, 1.8), (2.5, 12.0), (0.0, 0.30), (3.2, 12.0)),
    "Tamil": Band((0.6, 1.8), (4.0, 18.0), (0.0, 0.35), (3.2, 12.0)),
    "Thai": Band((0.6, 1.8), (1.0, 400.0), (0.0, 0.25), (3.2, 12.0)),
    "Georgian": Band((0.6, 1.8), (4.0, 16.0), (0.0, 0.35), (3.2, 12.0)),
    "Kana": Band((0.5, 1.6), (1.0, 400.0), (0.0, 0.50), (4.0, 12.0)),
    "Han": Band((0.4, 1.4), (1.0, 400.0), (0.0, 0.70), (4.0, 12.0)),
    "Hangul": Band((0.4, 1.4), (2.5, 12.0), (0.0, 0.70), (4.0, 12.0)),
    "": Band((0.4, 12.0), (0.5, 400.0), (0.0, 0.25), (4.0, 16.0)),
}


def base_measures(chunk: T.Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed per text."""
    w = T.words(chunk, T.SPACED, lower=False)
    n_words = w.counts.astype(np.int64)
    made = {"n_words": n_words, "word_chars": chunk.per_row(T.SPACED[chunk.data] & T.LEAD[chunk.data]), "n_symbols": chunk.per_row(_SYMBOLS[chunk.data]), "n_dup_lines": _dup_lines(chunk)}
    at, hashes = T.windows(w, 3)
    flags = np.zeros(len(w.starts), bool)
    if len(at):
        rows = np.searchsorted(w.bounds, at, "right") - 1
        keys = T.mix(hashes ^ T.mix(rows.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        flags = T.covered(at[twice], 3, len(w.starts))
    made["n_repeat_words"] = T.sums(flags, w.bounds)
    return made | {"base_failed": (n_words < 50) | (100 * made["n_repeat_words"] > 50 * n_words)}


def _dup_lines(chunk: T.Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines = T.words(chunk, np.arange(256) != 0x0A, lower=False)
    worded = np.concatenate(([0], np.cumsum(T.SPACED[chunk.data])))
    ok = np.flatnonzero(worded[lines.ends] > worded[lines.starts])
    rows = lines.rows()[ok]
    keys = T.mix(lines.hashes[ok] ^ T.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1]) + 1
    return np.bincount(rows[order[same]], minlength=chunk.rows).astype(np.int64)


def fertility(encoder, chunk: T.Chunk) -> dict[str, np.ndarray]:
    """n_tokens, chars_per_token, byte_share and token_entropy (bits) per text; zeros for an empty one."""
    ids, bounds = encoder.encode_chunk(chunk)
    n = np.diff(bounds)
    chars = chunk.per_row(T.LEAD[chunk.data])
    by_byte = encoder.is_byte.copy()
    if encoder.byte_ids is not None:
        by_byte[encoder.byte_ids[[0x0A, 0x0D]]] = False
    share = T.sums(by_byte[ids], bounds) / np.maximum(n, 1)
    rows = np.repeat(np.arange(chunk.rows), n)
    keys = np.sort((rows.astype(np.int64) << 32) | ids)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys))).astype(float)
    spread = np.bincount(keys[first] >> 32, weights=counts * np.log2(np.maximum(counts, 1)), minlength=chunk.rows)
    entropy = np.where(n > 0, np.log2(np.maximum(n, 1)) - spread / np.maximum(n, 1), 0.0)
    return {"n_tokens": n.astype(np.int64), "chars_per_token": chars / np.maximum(n, 1), "byte_share": share, "token_entropy": np.maximum(entropy, 0.0)}


_NAMES = np.array([*SCRIPTS, ""])
_RANGES = np.array(sorted((low, high, k) for k, own in enumerate(SCRIPTS.values()) for low, high in own))
_ASCII_LETTERS = T.byte_set([(0x41, 0x5A), (0x61, 0x7A)])


def dominant_scripts(chunk: T.Chunk) -> np.ndarray:
    """The script of most letters of each text, as its place in SCRIPTS; one beyond the last for a text without letters."""
    padded = np.concatenate((chunk.data, np.zeros(3, np.uint8))).astype(np.int64)
    at = np.flatnonzero(chunk.data >= 0xC2)
    lead, tail = padded[at], [padded[at + i] & 0x3F for i in (1, 2, 3)]
    two = (lead & 0x1F) << 6 | tail[0]
    three = (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]
    four = (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    points = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    which = np.searchsorted(_RANGES[:, 0], points, "right") - 1
    known = points <= _RANGES[which, 1]
    rows = np.searchsorted(chunk.offsets, at[known], "right") - 1
    counts = np.bincount(_RANGES[which[known], 2] * chunk.rows + rows, minlength=len(SCRIPTS) * chunk.rows).reshape(len(SCRIPTS), chunk.rows)
    counts[list(SCRIPTS).index("Latin")] += chunk.per_row(_ASCII_LETTERS[chunk.data])
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), len(SCRIPTS))


def _key(lang: str | None, script: str, bands: dict[str, Band]) -> str:
    """The key of the band that holds a text: its language's if it is written in that one's script, then its script's."""
    if lang in bands and lang not in SCRIPTS and (not script or bands[lang].script in ("", script)):
        return lang
    return script if script in bands else ""


def _within(base: dict[str, np.ndarray], measured: dict[str, np.ndarray], langs: list[str | None], scripts: list[str], bands: dict[str, Band]) -> np.ndarray:
    known = sorted(bands)
    which = np.array([known.index(_key(*x, bands)) for x in zip(langs, scripts, strict=True)], np.int64)
    curve = np.array([bands[k].curve for k in known])[which]
    x = np.clip(np.log2(np.maximum(measured["n_tokens"], 1)), 6, 15)
    values = {
        "chars_per_token": measured["chars_per_token"],
        "tokens_per_word": measured["n_tokens"] / np.maximum(base["n_words"], 1),
        "byte_share": measured["byte_share"],
        "entropy": measured["token_entropy"] - (curve[:, 0] + curve[:, 1] * x + curve[:, 2] * x * x),
    }
    ok = np.ones(len(langs), bool)
    for name, value in values.items():
        low, high = np.array([getattr(bands[k], name) for k in known])[which].reshape(-1, 2).T
        ok &= (value >= low) & (value <= high)
    return ok


def quality_rules(docs: DataFrame, model: PieceModel, bands: dict[str, Band] | None = None, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc, the base measures, the fertility measures, base_failed, script, kept.

    A null text counts as empty and fails the base rules. A text in a language without a
    band (null too), or not in its language's script, takes the band of the script of most of its
    letters, and where bands has none that of the empty key, which is BANDS' own if bands lacks it.
    script is empty for a text without letters of SCRIPTS. Repeated rows give repeated results, an empty table an empty one; other
    columns are ignored, whatever their names.
    """
    bands = {"": BANDS[""]} | (BANDS if bands is None else bands)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(doc), F.col(lang).cast("string").alias("__lang"), F.col(text))

    def step(batch, chunk, at):
        base, more = base_measures(chunk), fertility(encoder_of(shared), chunk)
        langs = batch.column(1).slice(at, chunk.rows).to_pylist()
        scripts = _NAMES[dominant_scripts(chunk)].tolist()
        return base | more | {"script": scripts, "kept": ~base["base_failed"] & _within(base, more, langs, scripts, bands)}

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string, kept boolean"
    return T.map_text(slim, text, schema, step, [doc, "__lang"]).drop("__lang")


def keep_quality(docs: DataFrame, model: PieceModel, bands: dict[str, Band] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that quality_rules keeps, with all their columns.

    Null, empty and short texts go, as the base rules have it. Repeated rows are
    judged alike, an empty table gives an empty one.
    """
    bands = {"": BANDS[""]} | (BANDS if bands is None else bands)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text, at_lang = docs.columns.index(text), docs.columns.index(lang)

    def run(batches):
        for batch in batches:
            for at, chunk in T.chunks(batch.column(at_text)):
                part = batch.slice(at, chunk.rows)
                base = base_measures(chunk)
                langs = part.column(at_lang).to_pylist()
                scripts = _NAMES[dominant_scripts(chunk)].tolist()
                kept = ~base["base_failed"] & _within(base, fertility(encoder_of(shared), chunk), langs, scripts, bands)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
