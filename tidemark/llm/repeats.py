"""Repeated byte strings by a depth-limited radix sort of suffixes.

Two suffixes matter only through their first ``length`` bytes: where these are equal the string is repeated.
The sort goes by most-significant-digit passes, and a group of one leaves it at once. What makes it fit a
cluster is that suffixes are handled in runs that share their digits:

* First digit: every window of ``length`` bytes contains a synchronising gram (its least gram hash), which
  depends on the window's bytes alone, so equal windows have equal grams at equal offsets. Consecutive
  suffixes with the same gram form one run; a run is one row, about ``2 / length`` rows per byte of text.
* A pass looks at cells of consecutive suffixes of a run. The bytes all of a cell's windows have in common
  are the digit: where no other cell has it, no window of the cell repeats. The bytes of all its windows
  together are the next digit: where another cell has it, every one of its windows repeats. Only a cell
  between the two is divided and goes to the next pass, down to single suffixes, where both digits are the
  window itself and the equal groups are exactly the repeated windows.

Digits travel as hashes of bytes, offset and cell, of 64 bits where they only nominate and of 128 where they decide; nothing is paired, keys are only counted (with
partial aggregates), so a string that occurs a million times is one key. Only cells that stay open carry
bytes. Nothing is sampled or capped; all suffixes of all texts are covered, and every decision is on whole
windows of the input.

Defined results: null text: empty; texts shorter than ``length``: nothing repeats; overlapping repeats inside
one text count; an empty table: no rows; repeated rows: each is a text of its own (rows are told apart by
their id and text together: equal ids with equal texts are joined back to one decision); extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.memory import tidy
from tidemark.session import discard, staged

LENGTH = 400
GRAM = 32
BRANCH = 8
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM bytes, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M[0]
    h ^= h >> np.uint64(32)
    width = 1
    for m in _M:
        h = h[:-width] * m + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h * _M[1]


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of every ``width`` values, by doubling."""
    step = 1
    while 2 * step <= width:
        x = best(x[:-step], x[step:])
        step *= 2
    return best(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Synchronising positions and, for each, the first and last window start it stands for.

    Of equal least grams in a window the leftmost counts, so positions only grow along the starts. A gram's rank is the
    upper half of its hash, with its position below.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    h = gram_hashes(data)
    half = np.uint64(32)
    ranked = (h >> half << half) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding(ranked, length - GRAM + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # per window start
    first = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
    return at[first], first, np.append(first[1:], len(at)) - 1


def _signed(h: int) -> int:
    return h - (1 << 63)


def _keyed(parts: bytes, a: int, b: int, c: int) -> bytes:
    return parts + a.to_bytes(4, "little", signed=True) + b.to_bytes(4, "little", signed=True) + c.to_bytes(4, "little")


def _key(parts: bytes, a: int, b: int, c: int) -> bytes:
    return xxhash.xxh3_128_digest(_keyed(parts, a, b, c))


def _bytes_of(value) -> bytes:
    text = value.as_py()
    return text.encode("utf-8", "replace") if text else b""


def _first_pass(length: int):
    names = ["doc", "first", "last", "at", "narrow", "wide"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                cols: list[list] = [[] for _ in names]
                for doc, text in zip(part.column("doc").to_pylist(), part.column("text"), strict=True):
                    data = _bytes_of(text)
                    if len(data) < length:
                        continue
                    at, first, last = runs(np.frombuffer(data, np.uint8), length)
                    at, first, last = at.tolist(), first.tolist(), last.tolist()
                    cols[0] += [doc] * len(at)
                    cols[1] += first
                    cols[2] += last
                    cols[3] += at
                    cols[4] += [_signed(xxhash.xxh3_64_intdigest(data[a : a + GRAM])) for a in at]
                    cols[5] += [_key(data[f : n + length], a - f, a - n, 1) for a, f, n in zip(at, first, last, strict=True)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=names)

    return work, "doc binary, first int, last int, at int, narrow long, wide binary"


def _with_bytes(length: int):
    """Attach to each open run the bytes its windows cover."""
    names = ["doc", "first", "last", "at", "low", "size", "bytes", "decided"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                doc, data = b.column("doc")[k].as_py(), _bytes_of(b.column("text")[k])
                cells = b.column("cells")[k].as_py()
                for at in range(0, len(cells), 4096):
                    part = cells[at : at + 4096]
                    f, n, a, w = ([c[x] for c in part] for x in ("first", "last", "at", "decided"))
                    yield pa.record_batch(
                        [
                            pa.array([doc] * len(part), pa.binary()), pa.array(f, pa.int32()), pa.array(n, pa.int32()), pa.array(a, pa.int32()), pa.array([-(length - GRAM)] * len(part), pa.int32()),
                            pa.array([length - GRAM + 1] * len(part), pa.int32()), pa.array([data[x : y + length] for x, y in zip(f, n, strict=True)], pa.binary()), pa.array(w, pa.bool_()),
                        ],
                        names=names,
                    )

    return work, "doc binary, first int, last int, at int, low int, size int, bytes binary, decided boolean"


def _divide(length: int, size: int):
    """Cells of at most ``size`` window starts, aligned to the gram, with both digits and their bytes.

    ``low`` and ``size`` are a cell's place on the grid around the gram; ``first`` and ``last`` its window
    starts in the text; ``bytes`` begin at ``first``.
    """
    names = ["doc", "first", "last", "at", "low", "size", "bytes", "decided", "narrow", "wide"]
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.binary())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                cols: list[list] = [[] for _ in names]
                for doc, first, last, at, low, old, data, decided in zip(*(b.slice(k, 256).column(c).to_pylist() for c in names[:8]), strict=True):
                    for cell in range(low, low + old, size):
                        f, n = max(first, at + cell), min(last, at + cell + size - 1, at + low + old - 1)
                        if f > n:
                            continue
                        own = data[f - first : n - first + length]
                        top = at + cell + size - 1  # the last window start the grid's cell could have
                        common = own[max(0, top - f) : at + cell + length - f]
                        wide = _key(own, at - f, at - n, size)
                        narrow = int.from_bytes(wide[:8], "little", signed=True) if size == 1 else _signed(xxhash.xxh3_64_intdigest(_keyed(common, cell, 0, size)))
                        for c, v in zip(cols, (doc, f, n, at, cell, size, own, decided, narrow, wide), strict=True):
                            c.append(v)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return work, "doc binary, first int, last int, at int, low int, size int, bytes binary, decided boolean, narrow long, wide binary"


def _judged(cells: DataFrame) -> DataFrame:
    """Cells whose common bytes occur in another cell, with ``repeated``: all their bytes do, and ``next``:
    they go to the next pass.

    Of the cells with one and the same digit pair one stays as a witness for cells that share only the common
    bytes; ``decided`` marks witnesses, which report nothing more. Where no undecided cell is left, all go.
    """
    both = cells.groupBy("narrow", "wide").agg(F.count(F.lit(1)).alias("n_wide"), F.sum(F.when(F.col("decided"), 0).otherwise(1)).alias("n_fresh"), F.min(F.struct("doc", "first")).alias("witness"))
    single = (F.col("n_wide") == 1) & (F.col("n_fresh") == 1)
    narrow = both.groupBy(F.col("narrow").alias("digit")).agg(F.sum("n_wide").alias("n_narrow"), F.sum(F.when(single, 1).otherwise(0)).alias("n_open")).where("n_narrow > 1")
    digits = both.join(narrow, F.col("narrow") == F.col("digit"))
    digits = digits.select("digit", F.col("wide").alias("digit2"), (F.col("n_wide") > 1).alias("repeated"), (F.col("n_open") > 0).alias("open"), "witness")
    found = cells.join(digits, (cells.narrow == digits.digit) & (cells.wide == digits.digit2))
    chosen = (F.col("witness.doc") == F.col("doc")) & (F.col("witness.first") == F.col("first"))
    found = found.withColumn("next", F.col("open") & (~F.col("repeated") | chosen)).drop("digit", "digit2", "narrow", "wide", "witness", "open").where("next or (repeated and not decided)")
    return found.withColumn("bytes", F.when(F.col("next"), F.col("bytes"))) if "bytes" in found.columns else found


def _done(judged: DataFrame) -> DataFrame:
    return judged.where("repeated and not decided").select("doc", "first", "last")


def _going_on(judged: DataFrame) -> DataFrame:
    return judged.where("next").withColumn("decided", F.col("decided") | F.col("repeated")).drop("repeated", "next")


def repeated_windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, first, last): runs of window starts whose ``length`` bytes start anywhere else too.

    ``texts`` has the columns doc (binary key of a row) and text.
    """
    work, schema = _first_pass(length)
    runs_ = staged(texts.mapInArrow(tidy(work), schema).withColumn("decided", F.lit(False)), "runs")
    judged = staged(_judged(runs_), "judged")
    discard(runs_)
    done = staged(_done(judged), "done")
    lists = _going_on(judged).groupBy("doc").agg(F.collect_set(F.struct("first", "last", "at", "decided")).alias("cells"))  # a text's own runs
    work, schema = _with_bytes(length)
    cells = texts.join(lists, "doc").mapInArrow(tidy(work), schema)
    size = length - GRAM + 1
    while size > 1:
        size = -(-size // BRANCH)
        work, schema = _divide(length, size)
        divided = staged(cells.mapInArrow(tidy(work), schema), "cells")
        discard(judged)
        judged = staged(_judged(divided), "judged")
        discard(divided)
        done = done.union(staged(_done(judged), "done"))  # no bytes: the rest of a pass goes with the next one's cells
        cells = _going_on(judged)
        if size > 1 and cells.isEmpty():
            break
    discard(judged)
    return done


def spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered byte ranges [begin, end) of window-start runs."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64) + length)
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _cut(length: int):
    names = ["id", "n_bytes", "begins", "ends", "kept", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part, cols = b.slice(k, 64), [[] for _ in names]
                for id_, text, first, last in zip(part.column("id").to_pylist(), part.column("text"), part.column("firsts").to_pylist(), part.column("lasts").to_pylist(), strict=True):
                    data = _bytes_of(text)
                    begin, end = spans(np.array(first), np.array(last), length) if first else (np.zeros(0, np.int64),) * 2
                    kept, at = [], 0
                    for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                        kept.append(data[at:x])
                        at = y
                    kept.append(data[at:])
                    kept = b"".join(kept)
                    left = None if text.as_py() is None else kept.decode("utf-8", "replace")
                    for c, v in zip(cols, (id_, len(data), begin, end, kept, left), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return work, "id long, n_bytes long, begins array<long>, ends array<long>, kept binary, text string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_bytes, the removed byte ranges (begins, ends), the bytes kept, and these as text.

    A cut inside a character leaves a replacement character in ``text``; a null text stays null there.
    """
    source = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    # The key of a row: its id and a digest of its text, which tells rows with equal or null ids apart.
    keyed = source.select("id", "text", F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))).alias("doc"))
    found = repeated_windows(keyed.select("doc", "text"), length)
    lists = found.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("w")).select("doc", F.col("w.first").alias("firsts"), F.col("w.last").alias("lasts"))
    work, schema = _cut(length)
    return keyed.join(lists, "doc", "left").select("id", "text", "firsts", "lasts").mapInArrow(tidy(work), schema)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "text"
    )

