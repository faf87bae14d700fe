"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: its text holds all turns before it as context, then the reply, and
only the reply is trainable. Turns after the last reply, which are no reply's context, form one more example in
which nothing is trainable, so the output holds every turn of every conversation.

The turns of a conversation are read once in order and dealt into ranges of RANGE examples; a range begins with the
context so far. Ranges are then written out independently of each other, so the work of a long conversation, whose
output grows with the square of its turns, is spread over many tasks. One task reads the turns of one conversation,
and holds one example at a time, which must fit in a row anyway.

Template: ``<|turn|>role<|says|>text<|end|>``. Inside roles and texts a ``<`` before ``|`` or ``!`` is written
``<!``, so no control string can arise there, and undoing it is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
TARGET_ROLE = "assistant"
_CONTROL = re.compile(r"<(?=[|!])")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.S)

#: Examples that are written out together, and characters of a batch.
RANGE, BATCH_CHARS = 64, 1_000_000

PARTS = pa.schema([("conv_id", pa.int64()), ("range", pa.int32()), ("example", pa.int32()), ("delta", pa.large_string()), ("reply", pa.int64())])
PARTS_DDL = "conv_id long, range int, example int, delta string, reply long"
EXAMPLES = pa.schema(
    [("conv_id", pa.int64()), ("example", pa.int32()), ("trainable", pa.bool_()), ("text", pa.large_string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
)
EXAMPLES_DDL = "conv_id long, example int, trainable boolean, text string, loss_start long, loss_end long"


class _Batches:
    """Rows gathered to batches of a bounded number of characters (a larger row stands alone)."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: tuple, chars: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if self.chars >= BATCH_CHARS or len(self.rows) >= 5000:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.chars = [], 0


def escape(text: str) -> str:
    return _CONTROL.sub("<!", text)


def unescape(text: str) -> str:
    return text.replace("<!", "<")


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{SAYS}{escape(text)}{END}"


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; the inverse of joined format_turn()s."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order -> what each example adds to the one before (delta) and the length of its reply, escaped, or null.
    A range after the first begins with a row of its own, example -1, that holds the context so far."""
    out, now, example, context, delta = _Batches(PARTS), _turned, 0, [], []  # no conversation yet

    def close(reply: int | None) -> Iterator[pa.RecordBatch]:
        nonlocal example, delta
        where, text = example // RANGE, "".join(delta)
        if where and example % RANGE == 0:
            context[:] = ["".join(context)]
            yield from out.add((now, where, -1, context[0], None), len(context[0]))
        yield from out.add((now, where, example, text, reply), len(text))
        context.append(text)
        example, delta = example + 1, []

    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is _turned or conv != now:
                if delta:
                    yield from close(None)
                now, example, context, delta = conv, 0, [], []
            delta.append(format_turn(role, text))
            if role == TARGET_ROLE:
                yield from close(len(escape(text)))
    if delta:
        yield from close(None)
    yield from out.rest()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order of conversation, range and example -> whole examples."""
    out, now, context = _Batches(EXAMPLES), None, ""
    for batch in batches:
        for r in range(batch.num_rows):
            conv, where, example, delta, reply = (c[r].as_py() for c in batch.columns)
            if (conv, where) != now:
                now, context = (conv, where), ""
            context += delta
            if example >= 0:
                end = len(context) - len(END)
                yield from out.add((conv, example, reply is not None, context, *((None, None) if reply is None else (end - reply, end))), len(context))
    yield from out.rest()


def chat_examples(conversations: DataFrame) -> DataFrame:
    """Examples: conv_id, example (from 0), trainable, text, loss_start, loss_end.

    The text holds all turns up to the example's own; the loss mask is [loss_start, loss_end) of it, in code points: the
    reply, escaped, without marks (null where nothing is trainable). Turns go by turn, nulls first, then role and
    text, so ties and repeated rows have a defined order and all count as turns. A null role or text counts as
    empty; null conv_ids are one conversation. An empty table gives no rows; other columns are not read. Rows of a
    conversation meet in one task in order; its examples are written out in ranges.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = ordered.select("conv_id", "role", "text").mapInArrow(_turned, PARTS_DDL)
    return parts.repartition("conv_id", "range").sortWithinPartitions("conv_id", "range", "example").mapInArrow(_written, EXAMPLES_DDL)


SAID = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss", pa.large_string()), ("chars", pa.int64())])
SAID_DDL = "conv_id long, example int, n_turns long, turns_sha256 string, loss string, chars long"


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example -> its turns, counted and hashed, the text under its mask, and its length; from its own text alone."""
    out = _Batches(SAID)
    for batch in batches:
        for r in range(batch.num_rows):
            conv, example, trainable, text, start, end = (c[r].as_py() for c in batch.columns)
            turns, digest = 0, hashlib.sha256()
            for role, said in parse_turns(text):
                turns += 1
                digest.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            loss = unescape(text[start:end]) if trainable else ""
            yield from out.add((conv, example, turns, digest.hexdigest(), loss, len(text)), len(loss) + 100)
    yield from out.rest()


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
READ_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What examples say, in order -> one row per conversation. The turns are those of its last example."""
    out, now, turns, sha, chars, digest, whole = _Batches(READ), _summed, 0, "", 0, hashlib.sha256(), 0
    for batch in batches:
        for conv, _, n, turns_sha, loss, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is _summed or conv != now:
                if now is not _summed:
                    yield from out.add((now, turns, sha, chars, digest.hexdigest(), whole), 200)
                now, chars, digest, whole = conv, 0, hashlib.sha256(), 0
            turns, sha, chars, whole = n, turns_sha, chars + len(loss), whole + size
            digest.update(loss.encode("utf-8", "surrogatepass"))
    if now is not _summed:
        yield from out.add((now, turns, sha, chars, digest.hexdigest(), whole), 200)
    yield from out.rest()


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, read from the texts and masks of chat_examples: conv_id, n_turns and turns_sha256
    (of the last example, which holds all turns), loss_chars and loss_sha256 (all text under the masks, unescaped, in
    order), formatted_chars (the characters of all examples' texts). A digest is sequential, so the replies of one
    conversation stream through one task, in bounded memory."""
    said = examples.select("conv_id", "example", "trainable", "text", "loss_start", "loss_end").mapInArrow(_said, SAID_DDL)
    return said.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(_summed, READ_DDL)
