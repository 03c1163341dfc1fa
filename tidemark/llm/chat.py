r"""Chat formatting by columnar byte assembly.

Per Arrow batch, segment lengths (opening, role, newline, text, closing) are computed as a matrix, their
cumulative offsets give every segment's place, and numpy scatter indices copy all bytes into one
preallocated buffer that becomes the Arrow result without another copy.

Template: a turn is ``[INST]role\ntext[/INST]``, an assistant's ``<s>role\ntext</s>``. Inside texts and
roles a control string gets a backslash after its first character (one more if it has some), which undoes
exactly; a role's own newlines and backslashes are written ``\n`` and ``\\``.

Long conversations come out as several pieces, cut between turns, so no value outgrows ``PIECE_BYTES`` plus
one turn; rows stream through sorted partitions and no conversation is ever held whole.

Defined results: null text or role: empty; null conversation id: one conversation of its own; ties in turn:
by role, then text; repeated rows: all kept; an empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 4 << 20
ESCAPE = r"([<\[])(\\*)(/?(?:s>|INST\]))"
UNESCAPE = re.compile(rb"([<\[])(\\*)\\(/?(?:s>|INST\]))")
OPEN, CLOSE = (b"[INST]", b"<s>"), (b"[/INST]", b"</s>")
TURN = re.compile(rb"\[INST\]|<s>")
FORMATTED = "conv_id long, piece int, formatted binary, n_turns long, loss_starts array<long>, loss_lengths array<long>"
ASSISTANT = "assistant"


def _column(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data bytes, starts and lengths of a string array without nulls."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
    """Copy segment k, ``n[k]`` bytes from ``data[at[k]]``, to ``out[to[k]]``."""
    if total := int(n.sum()):
        step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = data[np.repeat(at, n) + step]


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' bytes, each turn's start (and the end), the text's start and length in each turn."""
    loss = pc.equal(role, ASSISTANT).to_numpy(zero_copy_only=False).astype(np.int64)
    role = pc.replace_substring(pc.replace_substring(role, "\\", "\\\\"), "\n", "\\n")
    parts = [_column(pc.replace_substring_regex(x, ESCAPE, r"\1\2\\\3")) for x in (role, text)]
    head, tail = (np.frombuffer(b"".join(x), np.uint8) for x in (OPEN, CLOSE))
    head_n, tail_n = (np.array([len(x) for x in pair]) for pair in (OPEN, CLOSE))
    lengths = np.stack([head_n[loss], parts[0][2], np.ones(len(loss), np.int64), parts[1][2], tail_n[loss]], 1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if len(loss) else 0, np.uint8)
    _scatter(out, starts[:, 0], head, loss * head_n[0], lengths[:, 0])
    _scatter(out, starts[:, 1], *parts[0])
    out[starts[:, 2]] = 10
    _scatter(out, starts[:, 3], *parts[1])
    _scatter(out, starts[:, 4], tail, loss * tail_n[0], lengths[:, 4])
    return out, np.append(starts[:, 0], len(out)), starts[:, 3], lengths[:, 3]


def _small(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES * 4) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about ``most`` bytes at most (or one row)."""
    for b in batches:
        n = max(1, int(b.num_rows * most / max(b.nbytes, 1)))
        for k in range(0, b.num_rows, n):
            yield b.slice(k, n)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, piece = object(), 0
    for b in _small(batches):
        conv = b.column("conv_id").to_pylist()
        role, text = (pc.fill_null(b.column(c), "").cast(pa.large_string()) for c in ("role", "text"))
        loss = pc.equal(role, ASSISTANT).to_numpy(zero_copy_only=False)
        out, turn_at, text_at, text_n = assemble(role, text)
        cuts, ids, pieces = [], [], []
        for k, c in enumerate(conv):  # a cut where the conversation changes or the piece is full
            if c != last or not cuts or turn_at[k] - turn_at[cuts[-1]] >= PIECE_BYTES:
                piece = 0 if c != last else piece + 1
                last = c
                cuts.append(k)
                ids.append(c)
                pieces.append(piece)
        cuts = np.array([*cuts, len(conv)])
        offsets = turn_at[cuts].astype(np.int32)
        chosen = np.flatnonzero(loss)
        per = np.searchsorted(chosen, cuts).astype(np.int32)
        base = np.repeat(turn_at[cuts[:-1]], np.diff(per))
        formatted = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
        yield pa.record_batch(
            [
                pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), formatted, pa.array(np.diff(cuts), pa.int64()),
                pa.ListArray.from_arrays(pa.array(per), pa.array(text_at[chosen] - base, pa.int64())),
                pa.ListArray.from_arrays(pa.array(per), pa.array(text_n[chosen], pa.int64())),
            ],
            names=["conv_id", "piece", "formatted", "n_turns", "loss_starts", "loss_lengths"],
        )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted pieces of every conversation, with the byte spans of the loss mask.

    The rows of a conversation come to one task, in order and as a stream: its digest and its pieces follow
    the order of its turns. Partitions are sorted with spill; memory does not grow with a conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")])
    return rows.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def unescape(value: bytes) -> bytes:
    return UNESCAPE.sub(rb"\1\2\3", value)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) pairs of a formatted piece."""
    turns, at = [], 0
    while at < len(formatted):
        kind = 0 if formatted.startswith(OPEN[0], at) else 1
        at += len(OPEN[kind])
        end = formatted.index(CLOSE[kind], at)
        role, _, text = formatted[at:end].partition(b"\n")
        role = re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role), flags=re.S)
        turns.append((role, unescape(text)))
        at = end + len(CLOSE[kind])
    return turns


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: what its pieces hold, read from the formatted bytes and the loss spans alone."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, done = None, []

    def close() -> None:
        if now:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    for b in batches:
        for conv, piece, data, starts, lengths in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "formatted", "loss_starts", "loss_lengths")), strict=True):
            if piece == 0:
                close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(data):
                now[1] += 1
                now[2].update(role + b"\n" + text + b"\n")
            for at, n in zip(starts, lengths, strict=True):
                said = unescape(data[at : at + n])
                now[3] += len(said.decode("utf-8", "replace"))
                now[4].update(said)
            now[5] += len(data.decode("utf-8", "replace"))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
