"""Near-duplicate lines by a segment-partition edit join.

A line within ``EDITS`` edits of another keeps at least one of the other's ``EDITS + 1`` even segments whole,
at nearly the same place. Every line is indexed under its segments (with length and number) and probes, for
each length up to ``EDITS`` shorter, the few places where such a segment can still lie: shifts from the left
are bounded by the segments before it, from the right by those after it. Lines that meet under a key are
compared by character counts and then by a bit-parallel edit distance in the band of ``2 EDITS + 1`` diagonals.

Shape at scale: keys are first only counted, with partial aggregates. Keys with several different lines set
bits in a filter of 256 bits for each of them, 32 MB at most, which is broadcast; only lines with such a key move, once, with their text. A
key with many lines is split into chunks compared chunk against chunk, so a task holds two chunks and only
links within a block leave it. If the filter fills up, more lines move; results stay the same.

Classes are the components of the links; equal lines are in one class. Lines are equal if their digests of 128 bits
are: half of it is the code by which lines meet, both halves name a line wherever one is deleted for another. The
first line of a class by (id, number) stays, later ones repeat it.

Lines under ``SHORTEST`` characters are too short for two edits to mean the same line. With ``short`` they repeat
where they are equal; they have a code but no keys, so they stay out of the edit join.

Defined results: lines are stripped of blanks at both ends; blank lines never repeat, and those under ``SHORTEST``
characters only with ``short``; null or empty text: no lines; null id: its lines neither repeat nor are repeated; rows with equal ids are treated as
one document; an empty table: no rows; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected
from tidemark.llm.memory import tidy
from tidemark.session import discard, staged

EDITS = 2
SHORTEST = 24
CHUNK = 256
LEAST_BITS, MOST_BITS = 16, 28


def lines_of(text: str | None, least: int = SHORTEST) -> list[tuple[int, str]]:
    """(number, line) of the lines of ``least`` characters or more; by default those of the edit join."""
    if not text:
        return []
    return [(k, s) for k, x in enumerate(text.split("\n")) if len(s := x.strip(" \t\r")) >= least]


def _names(lines: list[str]) -> np.ndarray:
    """(lines, 2) code and check, the halves of each line's digest."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x.encode("utf-8", "replace"), 5) for x in lines]), np.int64).reshape(-1, 2)


def _codes(lines: list[str]) -> np.ndarray:
    return _names(lines)[:, 0]


def _segments(n: int, parts: int) -> list[tuple[int, int]]:
    """Place and length of the even segments of a string of n characters, the longer ones last."""
    size, more = divmod(n, parts)
    at, out = 0, []
    for k in range(parts):
        length = size + (k >= parts - more)
        out.append((at, length))
        at += length
    return out


@lru_cache(maxsize=1 << 14)
def _places(n: int, edits: int) -> tuple[tuple[int, int, int], ...]:
    """(start, end, seed) of the substrings of a line of n characters that are indexed or probe."""
    out = set()
    for other in range(max(n - edits, 1), n + 1):
        gap = n - other
        for k, (at, size) in enumerate(_segments(other, edits + 1)):
            after = edits - k
            for start in range(max(at - k, at + gap - after, 0), min(at + k, at + gap + after, n - size) + 1):
                out.add((start, start + size, other * 16 + k))
    return tuple(sorted(out))


def keys_of(line: str, edits: int = EDITS) -> list[bytes]:
    """Index and probe keys of a line, eight bytes each; some may occur twice. Two bytes a character, so that places
    are found without a walk; only lines with characters beyond these are cut by themselves."""
    data, hashed = line.encode("utf-16-le", "replace"), xxhash.xxh3_64_digest
    if len(data) == 2 * len(line):
        return [hashed(data[2 * a : 2 * b], seed) for a, b, seed in _places(len(line), edits)]
    return [hashed(line[a:b].encode("utf-16-le", "replace"), seed) for a, b, seed in _places(len(line), edits)]


def within(x: str, y: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``.

    Row e of the state says, for the 2 edits + 1 diagonals around the current one, which prefixes of x
    match the prefix of y so far with e errors or fewer; one step of y updates all diagonals with a few word
    operations.
    """
    if abs(len(x) - len(y)) > edits:
        return False
    if x == y:
        return True
    low, high = 0, min(len(x), len(y))
    while low < high:  # the common beginning, by halves
        mid = (low + high + 1) // 2
        if x.startswith(y[:mid]):
            low = mid
        else:
            high = mid - 1
    x, y = x[low:], y[low:]
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x.endswith(y[len(y) - mid :]):
            low = mid
        else:
            high = mid - 1
    x, y = x[: len(x) - low], y[: len(y) - low]
    places: dict[str, int] = {}
    for k, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << k
    mask = (1 << (2 * edits + 1)) - 1
    rows = [((1 << (e + 1)) - 1) << edits for e in range(edits + 1)]
    for j, c in enumerate(y):
        at, shift = places.get(c, 0), j - edits
        match = (at >> shift if shift >= 0 else at << -shift) & mask
        before = rows[0]
        rows[0] = before & match
        for e in range(1, edits + 1):
            old = rows[e]
            rows[e] = ((old & match) | before | (before >> 1) | (rows[e - 1] << 1)) & mask
            before = old
        if not rows[edits]:
            return False
    return bool(rows[edits] >> (len(x) - len(y) + edits) & 1)


def _occurrences(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, numbers, lines = [], [], []
                part = b.slice(at, 256)
                for id_, text in zip(part.column("id").to_pylist(), part.column("text"), strict=True):
                    for k, line in lines_of(text.as_py(), least):
                        ids.append(id_)
                        numbers.append(k)
                        lines.append(line)
                names = _names(lines)
                columns = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())]
                yield pa.record_batch(columns, names=["id", "line", "code", "check"])

    return work


def _keyed(edits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                keys, sizes = [], []
                lines = list({line for text in b.slice(at, 256).column("text") for _, line in lines_of(text.as_py())})
                for line in lines:
                    own = keys_of(line, edits)
                    keys += own
                    sizes.append(len(own))
                yield pa.record_batch([pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(np.repeat(_codes(lines), sizes))], names=["key", "code"])

    return work


def _filtered(edits: int, bits: bytes):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(bits, np.uint8)
        shift = np.uint64(64 - 3 - (len(filter_).bit_length() - 1))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                keys, sizes = [], []
                lines = list({line for text in b.slice(at, 256).column("text") for _, line in lines_of(text.as_py())})
                for line in lines:
                    own = keys_of(line, edits)
                    keys += own
                    sizes.append(len(own))
                keys = np.frombuffer(b"".join(keys), np.uint64)
                cell = keys >> shift
                hit = (filter_[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
                of = pa.array(np.repeat(np.arange(len(sizes)), sizes)[hit])
                yield pa.record_batch([pa.array(keys[hit].view(np.int64)), pa.array(_codes(lines).copy()).take(of), pa.array(lines, pa.string()).take(of)], names=["key", "code", "text"])

    return work


def _counts(lines: list[str]) -> np.ndarray:
    out = np.zeros((len(lines), 32), np.int16)
    for k, line in enumerate(lines):
        out[k] = np.minimum(np.bincount(np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32) & 31, minlength=32), 30000)
    return out


def _block(rows: list[dict], edits: int) -> list[tuple[str, str]]:
    """Links between the lines of a block: a spanning forest of them, as texts."""
    same = rows[0]["lo"] == rows[0]["hi"]
    left = rows if same else [r for r in rows if r["chunk"] == r["lo"]]
    right = rows if same else [r for r in rows if r["chunk"] == r["hi"]]
    if not left or not right:
        return []
    x, y = (_counts([r["text"] for r in side]) for side in (left, right))
    near = np.zeros((len(left), len(right)), np.int32)
    for c in range(32):
        near += np.abs(x[:, None, c].astype(np.int32) - y[None, :, c])
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while root.get(k, k) != k:
            k = root[k]
        return k

    out = []
    for i, j in np.argwhere(near <= 2 * edits).tolist():
        if same and i >= j:
            continue
        a, b = left[i], right[j]
        if a["code"] != b["code"] and top(a["code"]) != top(b["code"]) and within(a["text"], b["text"], edits):
            root[top(a["code"])] = top(b["code"])
            out.append((a["text"], b["text"]))
    return out


LINKS = "a struct<code: long, check: long>, b struct<code: long, check: long>"


def _links(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    sides = []
    for k in (0, 1):
        names = _names([p[k] for p in pairs])
        sides.append(pa.StructArray.from_arrays([pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())], ["code", "check"]))
    return pa.record_batch(sides, names=["a", "b"])


def _blocks(edits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for b in batches:
            for r in b.to_pylist():
                at = (r["key"], r["lo"], r["hi"])
                if at != now:
                    if len(rows) > 1:
                        out += _block(rows, edits)
                    now, rows = at, []
                rows.append(r)
            yield _links(out)
            out = []
        if len(rows) > 1:
            out += _block(rows, edits)
        yield _links(out)

    return work


def _filter_of(keys: DataFrame) -> bytes:
    """Bits of the keys; at most 2^MOST_BITS / 64 words come to the driver, whatever the input."""
    width = min(MOST_BITS, max(LEAST_BITS, (256 * keys.count()).bit_length()))
    cell = F.shiftrightunsigned("key", 64 - width)
    words = keys.withColumn("c", cell).select(F.shiftright("c", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(c & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (width - 6), np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.tobytes()


def line_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, short: bool = False) -> DataFrame:
    """(id, line, repeats): every line that can repeat, and whether it repeats an earlier one."""
    source = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
    lines = staged(source.mapInArrow(tidy(_occurrences(1 if short else SHORTEST)), "id long, line int, code long, check long"), "lines")
    firsts = lines.groupBy("code", "check").agg(F.min(F.struct("id", "line")).alias("first"))

    keys = source.select("text").mapInArrow(tidy(_keyed(edits)), "key long, code long")
    shared = staged(keys.groupBy("key").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).where("lo <> hi").select("key"), "keys")
    met = source.select("text").mapInArrow(tidy(_filtered(edits, _filter_of(shared))), "key long, code long, text string")
    met = full = staged(met.join(shared, "key", "left_semi").dropDuplicates(["key", "code"]), "met")
    sizes = met.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    met = met.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("key", "code", "text", "chunk", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"))
    links = staged(met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_blocks(edits), LINKS).distinct(), "links")
    discard(shared, full)

    components = connected(links).select(F.col("id.code").alias("code"), F.col("id.check").alias("check"), "component")
    known = staged(firsts.join(components, ["code", "check"], "left").withColumn("component", F.coalesce("component", F.struct("code", "check"))), "firsts")
    discard(links)
    tops = known.groupBy("component").agg(F.min("first").alias("top"))
    known = known.join(tops, "component").select("code", "check", "top")
    return lines.join(known, ["code", "check"]).select("id", "line", (F.struct("id", "line") != F.col("top")).alias("repeats"))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, leave: float = 1.0, short: bool = False) -> DataFrame:
    """The rows with repeated lines taken out of ``text``, and two columns more: n_lines and n_repeats.

    A text of which more than the share ``leave`` of characters would go is a copy as a whole and stays as
    it is, for a later step on whole documents.
    """
    found = line_classes(docs, id, text, edits, short).where("repeats").groupBy("id").agg(F.collect_set("line").alias("gone"))  # a document's own lines
    found = found.select(F.col("id").alias("__tm_id"), F.array_sort("gone").alias("__tm_gone"))
    split = F.split(F.col(f"`{text}`"), "\n", -1)
    kept = F.filter(F.transform(F.col("__tm_lines"), lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda s: ~F.array_contains(F.col("__tm_gone"), s.k))
    names = [c for c in docs.columns if c not in ("n_lines", "n_repeats")]
    out = docs.select(*[F.col(f"`{c}`") for c in names]).join(found, F.col(f"`{id}`") == F.col("__tm_id"), "left")
    out = out.withColumn("__tm_lines", F.when(F.col("__tm_gone").isNotNull(), split)).withColumn("__tm_new", F.array_join(kept.x, "\n"))
    cut = F.col("__tm_gone").isNotNull() & (F.length(F.col(f"`{text}`")) - F.length("__tm_new") <= leave * F.length(F.col(f"`{text}`")))
    made = {c: F.col(f"`{c}`") for c in names} | {text: F.when(cut, F.col("__tm_new")).otherwise(F.col(f"`{text}`"))}
    n_lines = F.coalesce(F.size(split), F.lit(0)).cast("long")
    n_repeats = F.when(cut, F.size("__tm_gone")).otherwise(0).cast("long")
    return out.select(*[v.alias(k) for k, v in made.items()], F.when(F.col(f"`{text}`").isNull(), 0).otherwise(n_lines).alias("n_lines"), n_repeats.alias("n_repeats"))
