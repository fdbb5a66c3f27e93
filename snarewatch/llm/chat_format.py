"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context and its own
text as the only trainable span. Turns after the last assistant turn, or a
conversation without one, end in an example that trains nothing, so no turn is lost.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a
backslash goes between ``<`` (and backslashes after it) and ``|``, so no text can
hold a control string, and taking one backslash out again gives the text back. In
roles, backslash and line feed are written ``\\\\`` and ``\\n`` first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Output batches are cut at so many characters, whatever one conversation holds.
BATCH_CHARS = 4_000_000
EXAMPLE = pa.schema([("conv_id", pa.int64()), ("target", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
EXAMPLE_DDL = "conv_id bigint, target bigint, formatted string, loss_start bigint, loss_end bigint"
DIGEST_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.partition("\n")
        yield _unrole(role), unescape(text[: -len(END)])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _emit(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight > BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, examples out; holds one conversation's prefix at a time."""

    def examples():
        conv, prefix, n, open_turns = object(), [], 0, False
        for conv_id, role, text in _grouped(batches):
            if conv_id != conv:
                if open_turns:
                    yield conv, None, "".join(prefix), 0, 0
                conv, prefix, n = conv_id, [], 0
            head, body = f"{START}{_role(role or '')}\n", escape(text or "")
            prefix += [head, body, END]
            open_turns = role != "assistant"
            if not open_turns:
                whole = "".join(prefix)
                prefix = [whole]
                stop = len(whole) - len(END)
                yield conv_id, n, whole, stop - len(body), stop
            n += 1
        if open_turns:
            yield conv, None, "".join(prefix), 0, 0

    yield from _emit(examples(), EXAMPLE, lambda row: len(row[2]))


def expand_targets(turns: DataFrame) -> DataFrame:
    """Examples of all conversations, those of one conversation together and in order.

    Reads conv_id, turn, role and text. Turns go by turn, then role and text, nulls
    first; equal rows are turns of their own. A null text or role is empty; a null
    conv_id is one more conversation. Returns conv_id, target (position of the
    trained turn, null for trailing turns), formatted, and the code points
    loss_start and loss_end. Conversations are dealt out by id and sorted on disk;
    a task streams through them. No turns give no rows.
    """
    ordered = (
        turns.select(F.col("conv_id").cast("bigint"), "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return ordered.mapInArrow(_expand, EXAMPLE_DDL)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        conv, last, chars, n_loss, loss = object(), None, 0, 0, None

        def done():
            turns = hashlib.sha256()
            n = 0
            for role, text in parse(last):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            return conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars

        for conv_id, _, formatted, start, stop in _grouped(batches):
            if conv_id != conv:
                if last is not None:
                    yield done()
                conv, chars, n_loss, loss = conv_id, 0, 0, hashlib.sha256()
            trained = unescape(formatted[start:stop])
            loss.update(trained.encode())
            n_loss += len(trained)
            chars += len(formatted)
            last = formatted
        if last is not None:
            yield done()

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    yield from _emit(rows(), schema, lambda row: 400)


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say, parsed from their text alone.

    ``examples`` must be ``expand_targets``' own rows in their order: the last
    example of a conversation holds all of its turns.
    """
    return examples.mapInArrow(_digest, DIGEST_DDL)
