r"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\ntext<|im_end|>\n``. In roles and texts every
``<`` that is followed by backslashes and a bar gets one backslash more, so no
``<|`` of a text remains and taking one away restores it; a role's own line
breaks and backslashes are escaped too. For each Arrow batch, segment lengths
give offsets by cumulative sums, offsets give scatter indices, and headers and
contents are copied into one preallocated buffer that becomes the Arrow column.

Turns are dealt by range of (conversation, turn), so a conversation of any
length is assembled by many tasks, each giving parts in order.

Defined results: a null text or role is empty; turns of equal number are
ordered by role, then text, nulls first; repeated rows are turns of their own;
a null conversation is one conversation; a null turn comes first; an empty
table gives no rows. The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

START, END = b"<|im_start|>", b"<|im_end|>\n"
LEARNT = "assistant"
_UNESCAPE = re.compile(rb"<(\\+)\|")


def escaped(values: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(values, ""), r"<(\\*)\|", r"<\1\\|")


def escaped_roles(values: pa.Array) -> pa.Array:
    values = pc.replace_substring(pc.replace_substring(pc.fill_null(values, ""), "\\", "\\\\"), "\n", "\\n")
    return pc.replace_substring_regex(values, r"<(\\*)\|", r"<\1\\|")


def unescaped(raw: bytes) -> bytes:
    return _UNESCAPE.sub(lambda m: b"<" + m[1][1:] + b"|", raw) if b"<\\" in raw else raw


def unescaped_role(raw: bytes) -> bytes:
    raw = unescaped(raw)
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], raw, flags=re.DOTALL) if b"\\" in raw else raw


def _parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column, and each value's place and length in them."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets[:-1] - low, np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, each turn's start, each text's start and end in them)."""
    n = len(roles)
    role, role_at, role_size = _parts(escaped_roles(roles))
    text, text_at, text_size = _parts(escaped(texts))
    start, stop = np.frombuffer(START, np.uint8), np.frombuffer(END, np.uint8)
    sizes = np.stack([np.full(n, len(start)), role_size, np.ones(n, np.int64), text_size, np.full(n, len(stop))], 1)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    begins = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    out[begins[:, :1] + np.arange(len(start))] = start
    out[begins[:, 2]] = 10
    out[begins[:, 4:] + np.arange(len(stop))] = stop
    for data, at, size, to in ((role, role_at, role_size, begins[:, 1]), (text, text_at, text_size, begins[:, 3])):
        out[np.arange(len(data)) + np.repeat(to - at, size)] = data
    return out, begins[:, 0], begins[:, 3], ends[:, 3]


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId() << 40, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv_id")
        ids, missing = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False), pc.is_null(conv).to_numpy(zero_copy_only=False)
        out, turn_at, low, high = assemble(batch.column("role"), batch.column("text"))
        first = np.r_[0, np.flatnonzero((np.diff(ids) != 0) | (np.diff(missing.astype(int)) != 0)) + 1]
        at = np.r_[turn_at[first], len(out)]
        learnt = pc.fill_null(pc.equal(batch.column("role"), LEARNT), False).to_numpy(zero_copy_only=False)
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))[learnt]
        mask = np.stack([low[learnt], high[learnt]], 1) - at[run][:, None]
        counts = np.bincount(run, minlength=len(first))
        formatted = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays(
            [
                conv.take(pa.array(first)), pa.array(task + number + np.arange(len(first))), pa.array(np.diff(np.r_[first, n])), formatted,
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(2 * counts)].astype(np.int32)), pa.array(mask.ravel().astype(np.int64))),
            ],
            ["conv_id", "part", "n_turns", "formatted", "loss"],
        )
        number += len(first)


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss): formatted bytes by conversation, in parts that follow each other.

    ``loss`` lists start and end, in bytes of the part, of each text under the loss mask.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", "role", "text")
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_assembled, f"conv_id {kind}, part long, n_turns long, formatted binary, loss array<long>")


def turns_of(part: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted part."""
    turns = []
    for own in part.split(START)[1:]:
        role, _, body = own.partition(b"\n")
        turns.append((unescaped_role(role), unescaped(body[: -len(END)])))
    return turns


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read parts back in order; a conversation is closed when the next one begins."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv, state = None, None

    def closed(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3], pa.int64()), pa.array(columns[4]), pa.array(columns[5], pa.int64())], names)

    def row():
        return (conv, state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

    kind = None
    for batch in batches:
        kind, rows = batch.schema.field("conv_id").type, []
        for i in range(batch.num_rows):
            own = batch.column("conv_id")[i].as_py()
            if state is None or own != conv:
                if state is not None:
                    rows.append(row())
                conv, state = own, {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            part = batch.column("formatted")[i].as_py()
            for role, text in turns_of(part):
                state["turns"] += 1
                state["all"].update(role + b"\n" + text + b"\n")
            spans = batch.column("loss")[i].as_py()
            for low, high in zip(spans[::2], spans[1::2], strict=True):
                text = unescaped(part[low:high])
                state["loss"].update(text)
                state["loss_chars"] += len(text.decode("utf-8", "surrogatepass"))
            state["chars"] += len(part.decode("utf-8", "surrogatepass"))
        if rows:
            yield closed(rows)
    if state is not None:
        yield closed([row()])


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted parts; parts stream, none is held."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    return (
        parts.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
        .mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )
