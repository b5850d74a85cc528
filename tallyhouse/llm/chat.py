"""Chat formatting with one training example per assistant turn.

Each assistant turn becomes an example: all turns before it are context and
only its own text is trainable. The rendered form of a turn doesn't depend on
later turns, so example k of a conversation is a prefix of one rendered
conversation plus the range of its reply: example_spans keeps that compact form,
whose size follows the input. expand_examples writes the examples out, and so
does written_examples, in pieces of bounded size, which read_examples reads back.
"""

from __future__ import annotations

import hashlib
import io
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: About so many characters of written-out examples leave a task at once.
EXPANDED_CHARS = 1 << 24
#: written_examples cuts contexts into pieces of so many characters; a rendered conversation of more bytes waits in a task's temporary file.
PIECE_CHARS, SPOOLED_BYTES = 1 << 15, 1 << 24
#: Texts never hold "<|" after this, so a mark in the output is always ours.
_PLAIN, _ESCAPED, _BACKSLASH = "<|", "<\\|", "\\"


def escape(text):
    """A text column in which no control string can appear: \\ doubles, <| becomes <\\|."""
    doubled = F.replace(text, F.lit(_BACKSLASH), F.lit(_BACKSLASH * 2))
    return F.replace(doubled, F.lit(_PLAIN), F.lit(_ESCAPED))


def unescape(text):
    """The inverse of escape: runs of backslashes are of even length other than in <\\|."""
    halves = F.split(text, "\\\\\\\\", -1)
    return F.array_join(F.transform(halves, lambda part: F.replace(part, F.lit(_ESCAPED), F.lit(_PLAIN))), _BACKSLASH)


def _escape_role(role):
    """escape for the one-line header: a newline becomes \\n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role):
    halves = F.split(role, "\\\\\\\\", -1)
    return F.array_join(F.transform(halves, lambda part: F.replace(F.replace(part, F.lit(_ESCAPED), F.lit(_PLAIN)), F.lit("\\n"), F.lit("\n"))), _BACKSLASH)


def _ordered(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def format_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, role, head, body, tail, trainable.

    head + body + tail is the rendered turn; the rendered conversation is their
    concatenation by turn. body is the escaped text, the whole trainable part of
    an assistant's turn (trainable true). Null roles and texts count as empty.
    Rows with equal turns are ordered by role and text. Other columns are dropped.
    """
    rows = _ordered(conversations, conv, turn, role, text)
    return rows.select("conv_id", "turn", "role", F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), F.lit(f"{CLOSE}\n").alias("tail"), (F.col("role") == "assistant").alias("trainable"))


def placed_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn, in order within a conversation, which is whole in one partition: conv_id, turn,
    rendered, start, example, loss_start, loss_end, n_chars.

    Null roles and texts count as empty, ties are ordered by role and text, repeated rows are turns of their
    own; an empty table gives no rows. start is where the rendered turn begins in the rendered conversation. An assistant's
    turn is example number example (from 0): the first n_chars characters of the rendered
    conversation, with the mask [loss_start, loss_end). Other turns have nulls there.
    """
    rows = _ordered(conversations, conv, turn, role, text)
    sized = rows.withColumn("n", (F.length(_escape_role(F.col("role"))) + F.length(escape(F.col("text"))) + len(OPEN) + len(CLOSE) + 2).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    reply = F.col("role") == "assistant"
    at = sized.withColumns({"end": F.sum("n").over(before), "count": F.sum(reply.cast("long")).over(before)}).sortWithinPartitions("conv_id", "turn", "role", "text")
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    loss_end = F.col("end") - len(CLOSE) - 1
    named = {"example": F.col("count") - 1, "loss_start": loss_end - F.length(body), "loss_end": loss_end, "n_chars": F.col("end")}
    return at.select("conv_id", "turn", F.concat(head, body, F.lit(f"{CLOSE}\n")).alias("rendered"), (F.col("end") - F.col("n")).alias("start"), *(F.when(reply, c).alias(n) for n, c in named.items()))


def example_spans(conversations: DataFrame, **names) -> DataFrame:
    """One row per assistant turn: conv_id, example, turn, loss_start, loss_end, n_chars.

    Example number example (from 0) is the first n_chars characters of the
    rendered conversation; its mask is [loss_start, loss_end). A conversation without
    an assistant's turn has none, an empty reply has an empty mask. Null roles and
    texts count as empty; equal turns are in the order of role and text, repeated
    rows are turns of their own. Rows without conv_id are one conversation. Other
    columns are ignored.
    """
    return placed_turns(conversations, **names).filter("example is not null").select("conv_id", "example", "turn", "loss_start", "loss_end", "n_chars")


def expand_examples(conversations: DataFrame, **names) -> DataFrame:
    """One row per assistant turn: conv_id, example, turn, context, target, tail.

    context is every rendered turn before it and the head of its own; the mask is
    target alone. A task holds one rendered conversation at a time and brings its
    examples out one after another, however many turns it has. Written-out examples
    grow with the square of a conversation's turns; example_spans does not. Nulls,
    ties and repeated rows are as in example_spans; an empty table gives no examples.
    """
    return _written_out(placed_turns(conversations, **names))


def written_examples(conversations: DataFrame, **names) -> DataFrame:
    """expand_examples with long contexts in several rows, and the turns that are in no example.

    A context of more than PIECE_CHARS characters comes in several rows of its example, in order; only the last of them
    has target and tail. The turns after a conversation's last example come in the same way, as contexts of rows
    without example, so all turns are there. A task holds a piece at a time, and a rendered conversation of more than
    SPOOLED_BYTES in a temporary file; what is written grows with the square of a conversation's turns.
    """
    return _written_out(placed_turns(conversations, **names), PIECE_CHARS)


def _written_out(placed: DataFrame, piece: int | None = None) -> DataFrame:
    """expand_examples of placed_turns' rows, or with piece written_examples."""
    kind = placed.schema["conv_id"].dataType.simpleString()

    def cut(told, key, head="", target=None):
        text = told.read(piece or -1)
        while piece and (more := told.read(piece)):
            yield (*key, text, None, None)
            text = more
        if text or head or target is not None:
            yield (*key, text + head, target, None if target is None else f"{CLOSE}\n")

    def turns(batches):
        now, told, seen = None, None, 0
        for batch in batches:
            for conv, turn, rendered, start, example, loss_start, loss_end in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if told is None or conv != now:
                    if piece and told is not None:
                        told.seek(seen)
                        yield from cut(told, (now, None, None))
                    now, told, seen = conv, tempfile.SpooledTemporaryFile(SPOOLED_BYTES, "w+", encoding="utf-8", newline=""), 0
                if example is not None:
                    told.seek(0)
                    yield from cut(told, (conv, example, turn), rendered[: loss_start - start], rendered[loss_start - start : loss_end - start])
                    told.seek(0, io.SEEK_END)
                told.write(rendered)
                if example is not None:
                    seen = told.tell()
        if piece and told is not None:
            told.seek(seen)
            yield from cut(told, (now, None, None))

    def write(batches):
        names, found, held, schema = ("example", "turn", "context", "target", "tail"), [], 0, None

        def noted():
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([batch.schema.field("conv_id"), *((n, pa.int64() if n in ("example", "turn") else pa.string()) for n in names)])
                yield batch

        for row in turns(noted()):
            found.append(dict(zip(("conv_id", *names), row, strict=True)))
            held += len(row[3]) + len(row[4] or "")
            if held > EXPANDED_CHARS:
                yield pa.RecordBatch.from_pylist(found, schema=schema)
                found, held = [], 0
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return placed.mapInArrow(write, f"conv_id {kind}, example long, turn long, context string, target string, tail string")


def read_turns(formatted: DataFrame) -> DataFrame:
    """The turns behind format_turns' rows, parsed from their rendered text: conv_id, turn, role, text, loss."""
    return _parsed(formatted.select("conv_id", "turn", F.concat("head", "body", "tail").alias("rendered"), "trainable", F.length("head").alias("from"), F.length("body").alias("long")))


def _parsed(rendered: DataFrame, *more: str) -> DataFrame:
    """Turns (conv_id, turn, rendered) whose mask, where trainable, is the range of length long after from; or with
    the columns more in place of mask and length."""
    inner = F.expr(f"substring(rendered, {len(OPEN) + 1}, length(rendered) - {len(OPEN) + len(CLOSE) + 1})")
    cut = rendered.withColumn("inner", inner).withColumn("cut", F.locate("\n", F.col("inner")))
    role, text = F.expr("substring(inner, 1, cut - 1)"), F.expr("substring(inner, cut + 1)")
    masked = F.when(F.col("trainable"), F.expr("substring(rendered, `from` + 1, `long`)"))
    told = more or (unescape(masked).alias("loss"), F.length("rendered").cast("long").alias("n_chars"))
    return cut.select("conv_id", "turn", _unescape_role(role).alias("role"), unescape(text).alias("text"), *told)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rendered turns.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn),
    loss_chars, loss_sha256 (all trainable text, unescaped, in order), n_examples,
    formatted_chars (length of the rendered conversation). Turns stream through
    in order, so a conversation of any length takes bounded memory.
    """
    return _folded(read_turns(formatted).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))


def read_examples(conversations: DataFrame, **names) -> DataFrame:
    """One row per conversation, read back from its written examples: the columns of digests, example_chars, examples_sha256.

    Every example is written out, all turns before it as context, and read whole. loss_chars,
    loss_sha256 and n_examples are of the text under the masks, unescaped; example_chars is the length
    of all examples together, examples_sha256 a digest of their digests (lowercase hex, one after
    another), contexts included. Turns are parsed where an example first holds them.
    Null roles and texts count as empty; equal turns are in the order of role and text,
    repeated rows are turns of their own. Rows without conv_id are one conversation.
    Other columns are ignored; an empty table gives no rows.
    """
    return read_written(written_examples(conversations, **names))


def example_digests(conversations: DataFrame, **names) -> DataFrame:
    """read_examples with the columns of digests alone."""
    return read_examples(conversations, **names).drop("example_chars", "examples_sha256")


def _unescaped(text: str, role: bool = False) -> str:
    """unescape of a text, or of a role."""
    halves = (part.replace(_ESCAPED, _PLAIN) for part in text.split(_BACKSLASH * 2))
    return _BACKSLASH.join(half.replace("\\n", "\n") if role else half for half in halves)


class _Reader:
    """Reads a rendered conversation turn by turn, and its examples as ranges of what has been read.

    It counts characters itself and keeps one turn; of all before it there is a running
    digest, from which that of an example's prefix goes on. A place outside the turn that it
    belongs to finds other text, or none.
    """

    def __init__(self):
        self.turns = self.examples = self.example_chars = self.loss_chars = self.chars = 0
        self.told, self.rendered, self.loss, self.prefixes = (hashlib.sha256() for _ in range(4))

    def read(self, role: str, text: str, rendered: str, mask: tuple[int, int] | None, n_chars: int | None) -> None:
        self.turns += 1
        self.told.update(f"{role}\n{text}\n".encode())
        if mask is not None:
            low, high, end = (max(0, place - self.chars) for place in (*mask, n_chars))
            loss = _unescaped(rendered[low:high])
            self.loss_chars += len(loss)
            self.loss.update(loss.encode())
            prefix = self.rendered.copy()
            prefix.update(rendered[:end].encode())
            self.prefixes.update(prefix.hexdigest().encode())
            self.examples += 1
            self.example_chars += n_chars
        self.rendered.update(rendered.encode())
        self.chars += len(rendered)

    def result(self) -> list:
        return [self.turns, self.told.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.examples, self.chars, self.example_chars, self.prefixes.hexdigest()]


#: What read_examples tells of a conversation.
_TOLD = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "n_examples", "formatted_chars", "example_chars", "examples_sha256"]


class _WrittenReader:
    """Reads a conversation's written examples piece by piece. Text past the example before holds the turns that are
    new; of those it keeps what isn't parsed yet, of all else digests and counts."""

    def __init__(self):
        self.turns = self.examples = self.example_chars = self.loss_chars = self.chars = self.at = 0
        self.told, self.loss, self.digests, self.example = (hashlib.sha256() for _ in range(4))
        self.open, self.end = [], ""

    def read(self, example: int | None, context: str, target: str | None, tail: str | None) -> None:
        if example is None:
            self.chars += len(context)
            return self._parse(context)
        for text in (context, target, tail):
            self._piece(text or "")
        if target is not None:
            loss = _unescaped(target)
            self.loss_chars += len(loss)
            self.loss.update(loss.encode())
            self.digests.update(self.example.hexdigest().encode())
            self.examples += 1
            self.example_chars += self.at
            self.example, self.at = hashlib.sha256(), 0

    def _piece(self, text: str) -> None:
        self.example.update(text.encode())
        new = text[max(0, self.chars - self.at) :]
        self.at += len(text)
        self.chars = max(self.chars, self.at)
        self._parse(new)

    def _parse(self, text: str) -> None:
        self.open.append(text)
        ends = f"{CLOSE}\n" in self.end + text
        self.end = (self.end + text)[-len(CLOSE) :]
        if ends:
            *whole, left = "".join(self.open).split(f"{CLOSE}\n")
            self.open, self.end = [left], left[-len(CLOSE) :]
            for rendered in whole:
                role, _, body = rendered[len(OPEN) :].partition("\n")
                self.turns += 1
                self.told.update(f"{_unescaped(role, True)}\n{_unescaped(body)}\n".encode())

    def result(self) -> list:
        return [self.turns, self.told.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.examples, self.chars, self.example_chars, self.digests.hexdigest()]


def read_written(written: DataFrame) -> DataFrame:
    """read_examples of written_examples' rows, which come whole and in order."""
    kind = written.schema["conv_id"].dataType.simpleString()

    def read(batches):
        now, reader, schema = None, None, None
        for batch in batches:
            schema = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *((n, pa.string() if "sha" in n else pa.int64()) for n in _TOLD)])
            done = []
            for conv, *row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "example", "context", "target", "tail")), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(dict(zip(schema.names, [now, *reader.result()], strict=True)))
                    now, reader = conv, _WrittenReader()
                reader.read(*row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if reader is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [now, *reader.result()], strict=True))], schema=schema)

    return written.mapInArrow(read, f"conv_id {kind}, " + ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in _TOLD))


def read_placed(placed: DataFrame) -> DataFrame:
    """What read_examples tells, of placed_turns' rows, which come whole and in order: examples are read as ranges of the
    rendered conversation and not written out."""
    names = _TOLD
    kind = placed.schema["conv_id"].dataType.simpleString()
    parsed = _parsed(placed.withColumns({"trainable": F.lit(False), "from": F.lit(0), "long": F.lit(0)}), "rendered", "loss_start", "loss_end", "n_chars")

    def read(batches):
        now, reader, schema = None, None, None
        for batch in batches:
            schema = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *((n, pa.string() if "sha" in n else pa.int64()) for n in names)])
            done = []
            for conv, role, text, rendered, low, high, n_chars in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "rendered", "loss_start", "loss_end", "n_chars")), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(dict(zip(schema.names, [now, *reader.result()], strict=True)))
                    now, reader = conv, _Reader()
                reader.read(role, text, rendered, None if n_chars is None else (low, high), n_chars)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if reader is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [now, *reader.result()], strict=True))], schema=schema)

    return parsed.mapInArrow(read, f"conv_id {kind}, " + ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in names))


def _folded(turns: DataFrame) -> DataFrame:
    """One row per conversation of read_turns' rows, which come whole and in order."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "n_examples", "formatted_chars"]

    def fold(batches):
        now, state = None, None

        def closed(conv, s):
            return {"conv_id": conv, "n_turns": s[0], "turns_sha256": s[1].hexdigest(), "loss_chars": s[2], "loss_sha256": s[3].hexdigest(), "n_examples": s[4], "formatted_chars": s[5]}

        schema = None
        for batch in batches:
            schema = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *((n, pa.string() if "sha" in n else pa.int64()) for n in names[1:])])
            done = []
            for conv, role, text, loss, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(closed(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                    state[4] += 1
                state[5] += n
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([closed(now, state)], schema=schema)

    return turns.mapInArrow(fold, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, n_examples long, formatted_chars long")
