"""Conversations as formatted training text: columnar byte assembly with numpy.

**Template.**  A turn is ``<|im_start|>role\\n`` + content + ``<|im_end|>\\n``.  Control strings inside
roles and contents (those of this template and of other common ones) are escaped reversibly: every
backslash is doubled and a backslash is put after the first character of a control string; a line end
inside a role is written as a backslash and an ``n``.

**Assembly.**  A batch of turns is three byte columns (headers, contents, closings).  Segment lengths
give cumulative offsets in one preallocated output buffer; headers, contents and closings are
scattered to their places with computed indices, whole columns at a time.  The loss mask (assistant
contents) falls out of the same offsets as spans.

**Spark.**  Rows are range-partitioned by (conversation, turn), so a conversation that holds a third of
all rows is formatted by many tasks, and sorted inside the partition.  Tasks stream over Arrow batches
and write a conversation as *parts*, one for each batch it touches, numbered by partition and place, so
memory is bounded by the batch.  Reading back streams over the parts of a conversation in their order; its
hashes are one sequence by definition and are updated turn by turn.

Edge cases.  Null texts are empty, null roles are empty names.  Rows of a conversation are ordered by
(turn, role, text), nulls first; repeated rows are repeated turns; rows with a null conv_id form one
conversation.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import scratch_path

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# control strings of common chat templates, none may appear unescaped in a text (fixed values)
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LOSS_ROLE = "assistant"
ROLE_LINE = "\\n"             # a line end inside a role; no control string goes on with an n

PART = "conv_id long, part long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_AFTER_FIRST = "(" + "|".join(sorted({re.escape(c[0]) for c in CONTROL})) + ")(" + "|".join(
    re.escape(c[1:]) for c in CONTROL) + ")"
_TAIL = re.compile(r"\\(\\?)")
_ROLE_TAIL = re.compile(r"\\([\\n]?)")


def escape_column(col):
    """An Arrow string column with nulls as empty texts and all control strings escaped."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.replace_substring(pc.fill_null(col, ""), "\\", "\\\\")
    return pc.replace_substring_regex(col, _AFTER_FIRST, r"\1\\\2")


def unescape(text: str) -> str:
    return _TAIL.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return _ROLE_TAIL.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
    """Copy segment ``i`` of a byte column to ``out[at[i]:]`` for all segments at once."""
    ln = np.diff(off)
    out[np.arange(len(data)) + np.repeat(at - off[:-1], ln)] = data


def assemble(roles, texts):
    """Formatted bytes of a batch of turns: ``(buffer, turn offsets, content start, content end)``."""
    import pyarrow as pa
    import pyarrow.compute as pc
    roles, texts = pc.replace_substring(escape_column(roles), "\n", ROLE_LINE), escape_column(texts)
    head = pc.binary_join_element_wise(pa.scalar(OPEN), roles, pa.scalar("\n"), pa.scalar(""))
    hd, ho = tb.text_bytes(head)
    cd, co = tb.text_bytes(texts)
    tail = np.frombuffer(CLOSE.encode(), np.uint8)
    n = len(roles)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(np.diff(ho) + np.diff(co) + len(tail), out=total[1:])
    start = total[:-1] + np.diff(ho)
    end = start + np.diff(co)
    out = np.empty(total[-1], np.uint8)
    scatter(out, total[:-1], hd, ho)
    scatter(out, start, cd, co)
    scatter(out, end, np.tile(tail, n), np.arange(n + 1) * len(tail))
    return out, total, start, end


def _runs(ids):
    """Borders of runs of equal conv_id (nulls equal) in an Arrow column."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    v = np.asarray(pc.fill_null(ids, 0))
    null = np.asarray(ids.is_null())
    new = np.flatnonzero((v[1:] != v[:-1]) | (null[1:] != null[:-1])) + 1
    return np.concatenate([[0], new, [len(v)]]).astype(np.int64)


def _char_offsets(buf: np.ndarray) -> np.ndarray:
    """Number of characters that start before each byte."""
    return np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])


def _format_rows(batches):
    import pyarrow as pa
    from pyspark import TaskContext
    part = TaskContext.get().partitionId() << 32           # range partitions are in order
    for rb in batches:
        if not rb.num_rows:
            continue
        ids = rb.column(0)
        buf, off, start, end = assemble(rb.column(1), rb.column(2))
        chars = _char_offsets(buf)
        loss = np.asarray(rb.column(1).fill_null("").to_numpy(zero_copy_only=False) == LOSS_ROLE, bool)
        cut = _runs(ids)
        rows = []
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            conv, part = ids[a].as_py(), part + 1
            k = np.flatnonzero(loss[a:b]) + a
            base = chars[off[a]]
            rows.append((conv, part, b - a, buf[off[a]: off[b]].tobytes().decode(),
                         (chars[start[k]] - base).tolist(), (chars[end[k]] - base).tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                                                         pa.list_(pa.int64()), pa.list_(pa.int64())])],
            names=["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Parts ``conv_id, part, n_turns, formatted, loss_start, loss_end`` (spans in characters of the
    part); the parts of a conversation in order are its whole formatted text."""
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
                             F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    t = t.select("conv_id", "role", "text")
    return t.mapInArrow(_format_rows, PART)


def parse_turns(formatted: str):
    """``(role, text)`` of every turn of a part; the inverse of the template."""
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn[len(OPEN):].partition("\n")
        yield unescape_role(role), unescape(text)


def _digest_rows(batches):
    import pyarrow as pa
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in DIGEST.split(", ")]
    cur, state = None, None

    def done():
        turns, loss = state[1], state[3]
        return (cur, state[0], turns.hexdigest(), state[2], loss.hexdigest(), state[4])
    for rb in batches:
        rows = []
        for conv, _, _, text, starts, ends in zip(*(rb.column(i).to_pylist() for i in range(6))):
            if state is None or conv != cur:
                if state is not None:
                    rows.append(done())
                cur, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, content in parse_turns(text):
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode())
            for a, b in zip(starts, ends):
                under = unescape(text[a:b])
                state[2] += len(under)
                state[3].update(under.encode())
            state[4] += len(text)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(done(), kinds)], names=names)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Digests of every conversation, from the written parts alone."""
    parts = spark.read.parquet(path).select(*(f.split()[0] for f in PART.split(", ")))
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(_digest_rows, DIGEST)


def formatted_digests(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Format all conversations, write the parts and read them back."""
    spark = conversations.sparkSession
    path = path or scratch_path(spark, "chat-parts")
    format_conversations(conversations).write.mode("overwrite").parquet(path)
    return read_back(spark, path)
