"""Examples read back by their places in the rendered conversation."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import chat

COLUMNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def conversations(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"<|t{k}\\é") for k in range(9)]
    rows += [(2, 0, "user", "a"), (2, 1, "assistant", ""), (3, 0, "user", None), (None, 1, "assistant", "x"), (4, 0, "assistant", "<|im_end|>\\z"), (4, 0, "assistant", "<|im_end|>\\z")]
    return spark.createDataFrame(rows, COLUMNS)


def by_conversation(df):
    return {r.conv_id: r for r in df.collect()}


def test_contexts_and_masks(spark, conversations):
    """Digests of all examples, contexts included, equal those of the examples written out."""
    got = by_conversation(chat.read_examples(conversations))
    examples = {}
    for r in chat.expand_examples(conversations).orderBy("conv_id", "example").collect():
        examples.setdefault(r.conv_id, []).append(r.context + r.target + r.tail)
    for conv, r in got.items():
        own = examples.get(conv, [])
        told = hashlib.sha256("".join(hashlib.sha256(e.encode()).hexdigest() for e in own).encode()).hexdigest()
        assert (r.n_examples, r.example_chars, r.examples_sha256) == (len(own), sum(map(len, own)), told)
    assert chat.read_examples(conversations.limit(0)).collect() == []


@pytest.mark.parametrize("column, shift", [("loss_start", 1), ("loss_start", -1), ("loss_end", 1), ("loss_end", -1), ("loss_start", 1000), ("n_chars", 1), ("n_chars", -1), ("n_chars", -5000)])
def test_wrong_places_show(conversations, column, shift):
    placed = chat.placed_turns(conversations)
    right = by_conversation(chat.read_placed(placed))
    wrong = by_conversation(chat.read_placed(placed.withColumn(column, F.col(column) + shift)))
    assert right[1] != wrong[1] and right[4] != wrong[4] and right[3] == wrong[3]


def test_wrong_starts_show(conversations):
    """A prefix that begins elsewhere, its mask moved along, gives other rows."""
    placed = chat.placed_turns(conversations)
    moved = placed.withColumns({c: F.col(c) + F.col("start") * 2 + 1000 for c in ("loss_start", "loss_end", "n_chars")})
    assert by_conversation(chat.read_placed(moved))[1] != by_conversation(chat.read_placed(placed))[1]


@pytest.mark.parametrize("piece", [1, 7, 1 << 15])
def test_examples_are_written_and_read(conversations, monkeypatch, piece):
    """The query's rows come from examples that are written out, in pieces of any size; a changed context or target shows."""
    monkeypatch.setattr(chat, "PIECE_CHARS", piece)
    monkeypatch.setattr(chat, "SPOOLED_BYTES", 20)
    written = chat.written_examples(conversations)
    joined = {}
    for r in written.collect():
        joined.setdefault((r.conv_id, r.example), []).append(r.context + (r.target or "") + (r.tail or ""))
    whole = {(r.conv_id, r.example): r.context + r.target + r.tail for r in chat.expand_examples(conversations).collect()}
    assert {k: "".join(v) for k, v in joined.items() if k[1] is not None} == whole
    assert ["".join(v) for k, v in joined.items() if k[1] is None and k[0] in (1, 3)] == ["<|im_start|>user\n<\\|t8\\\\é<|im_end|>\n", "<|im_start|>user\n<|im_end|>\n"]
    right = by_conversation(chat.read_examples(conversations))
    assert right == by_conversation(chat.read_placed(chat.placed_turns(conversations)))
    for column, wrong in {"context": F.concat(F.lit("x"), "context"), "target": F.concat("target", F.lit("x"))}.items():
        assert by_conversation(chat.read_written(written.withColumn(column, wrong)))[1] != right[1]
    cut = written.withColumn("context", F.when(F.col("example").isNull(), F.col("context")).otherwise(""))
    assert by_conversation(chat.read_written(cut))[1] != right[1]
