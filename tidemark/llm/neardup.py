"""Near-duplicate documents by HyperMinHash sketches, banded, estimated, then verified on full shingle sets.

Sketch: every shingle hash falls into one of ``REGISTERS`` buckets by its top bits; a bucket keeps its
smallest hash in compressed form, the leading-zero count (6 bits) and the next 10 mantissa bits. An empty
bucket borrows from a fixed pseudo-random order of the others for banding (so short texts band as well);
estimates use the buckets as they are. Bands hash ``ROWS`` compressed registers each. Simulated with these picks, a
pair shares no band with a probability of about 5e-6 at a similarity of 0.85 and 4e-4 at 0.80.

Every document with an equal set is one class first. Then, over class representatives:

1. In each bucket of equal bands one pivot, the member with most company over all bands, is paired with
   the others: one row a member, however large the bucket.
2. Pairs are dropped by the estimate (five standard errors, corrected for accidental register collisions),
   then verified on the full sets. Links give components.
3. What a pivot left apart is settled exactly. In small buckets members of different components are compared
   where they meet; only hopeful pairs become rows.
   In large ones members are dealt into chunks and strays, the members in other components than the pivot, into
   blocks, and each block is compared with each chunk through their differences from the pivot: with D(x) the difference of x and the
   pivot, x ^ y = D(x) ^ D(y), so counting shared cells of these short sets decides a link exactly. Only links
   leave a chunk.

Nothing is capped: small and large buckets differ in route only. Links between different texts are found
from all buckets; copies stay rows of their class.

Defined results: null or empty text: an empty set, a component of its own; ties and repeated rows: copies of
one class; null id: not searched, it only takes the component of an equal text if there is one; empty table: no rows; extra
columns are ignored. The text column is read once for sketches and once for the sets of candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles as sh
from tidemark.llm.components import connected
from tidemark.llm.memory import tidy
from tidemark.session import discard, staged

REGISTERS = 256
MANTISSA = 10
BANDS, ROWS = 56, 8
SMALL_BUCKET = 8
CHUNK, CHUNK_CELLS, STRAYS = 256, 1 << 19, 1024

_rng = np.random.default_rng(20240601)
_BORROW = np.stack([_rng.permutation(REGISTERS) for _ in range(REGISTERS)]).astype(np.int16)
_PICK = np.stack([_rng.permutation(REGISTERS)[:ROWS] for _ in range(BANDS)])
_ODD = (_rng.integers(1, 1 << 62, (BANDS, ROWS), dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_SALT = sh.mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
EMPTY = np.uint16(0xFFFF)


def sketch(shingle_set: np.ndarray) -> np.ndarray:
    """Compressed registers (uint16) of a sorted set of hashes; ``EMPTY`` where no shingle falls."""
    shift = np.uint64(64 - REGISTERS.bit_length() + 1)
    bounds = np.arange(REGISTERS, dtype=np.uint64) << shift
    first = np.searchsorted(shingle_set, bounds)
    last = np.append(first[1:], len(shingle_set))
    out = np.full(REGISTERS, EMPTY, np.uint16)
    full = first < last
    rest = shingle_set[first[full]] << np.uint64(REGISTERS.bit_length() - 1)
    top = (rest >> np.uint64(11)).astype(np.float64)  # 53 bits, exact
    zeros = np.where(top > 0, 53 - np.frexp(np.maximum(top, 1))[1], 53).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[full] = (np.minimum(zeros, np.uint64(62)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; empty registers borrow."""
    empty = registers == EMPTY
    if empty.any():
        if empty.all():
            return np.zeros(0, np.int64)
        lender = _BORROW[empty]
        full = registers.copy()
        full[empty] = registers[lender[np.arange(len(lender)), np.argmax(~empty[lender], 1)]]
        registers = full
    x = registers[_PICK].astype(np.uint64) + np.uint64(1)
    return sh.mixed((x * _ODD).sum(1, dtype=np.uint64) ^ _SALT).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, sizes: tuple[int, int]) -> tuple[float, int]:
    """Jaccard estimate of two sketches, corrected for accidental collisions, and the registers it rests on.

    Two different minima agree in zeros and mantissa by accident with a probability of about
    2^-MANTISSA times the chance that they have the same zeros, at most one third for like sizes.
    """
    used = (a != EMPTY) | (b != EMPTY)
    n = int(used.sum())
    if not n:
        return 0.0, 0
    same = int(((a == b) & used).sum())
    accident = 2.0**-MANTISSA / 3 * min(sizes) / max(sizes)
    return max(0.0, (same / n - accident) / (1 - accident)), n


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            sizes, digests, sketches, bands = [], [], [], []
            for text in part.column("text"):
                s = sh.shingle_set(text.as_py())
                r = sketch(s)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(r.tobytes())
                bands.append(band_keys(r))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            offsets = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            yield pa.record_batch([part.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "n_shingles", "digest", "sketch", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield pa.record_batch([part.column("id"), pa.array([sh.shingle_set(t.as_py()).tobytes() for t in part.column("text")], pa.binary())], names=["id", "shingles"])


def _hopeful(least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b")), strict=True):
                got, on = estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), (n, m))
                keep.append(got >= least - 5 * (least * (1 - least) / max(on, 1)) ** 0.5 - 0.02)
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return work


def _met(least: float):
    """Pairs of a bucket's members in different components whose sizes and sketches allow a link.

    Rows come sorted by key. Sketches are compared where they meet; a pair becomes a row only if it is hopeful.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, out = None, [], []

        def compare() -> None:
            for k, (x, cx, nx, sx) in enumerate(members):
                for y, cy, ny, sy in members[:k]:
                    if cx != cy and min(nx, ny) >= least * max(nx, ny) - 1e-9:
                        got, on = estimate(sx, sy, (nx, ny))
                        if got >= least - 5 * (least * (1 - least) / max(on, 1)) ** 0.5 - 0.02:
                            out.append((min(x, y), max(x, y)))

        for b in batches:
            for key, id_, component, n, sketch_ in zip(*(b.column(c).to_pylist() for c in ("key", "id", "component", "n_shingles", "sketch")), strict=True):
                if key != now:
                    compare()
                    now, members = key, []
                members.append((id_, component, n, np.frombuffer(sketch_, np.uint16)))
            yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out.clear()
        compare()
        yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return work


def _verified(percent: int, differences: bool):
    """Keep linked pairs, or say of each pair how it differs: what a adds to b, what it lacks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for a_id, b_id, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "set_a", "set_b")), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    if differences:
                        added, removed = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
                        rows.append((a_id, b_id, len(x), len(y), added.view(np.int64), removed.view(np.int64)))
                    else:
                        both = len(np.intersect1d(x, y, True))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            rows.append((a_id, b_id))
                names, kinds = ["a", "b"], [pa.int64(), pa.int64()]
                if differences:
                    names, kinds = [*names, "n_a", "n_b", "added", "removed"], [*kinds, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return work


class _Search:
    def __init__(self, profiles: DataFrame, sets: DataFrame, percent: int):
        self.profiles, self.sets, self.percent = profiles, sets, percent

    def _with(self, pairs: DataFrame, table: DataFrame, column: str, prefix: str, size: bool = False) -> DataFrame:
        for side in "ab":
            names = [F.col("id").alias(side), F.col(column).alias(f"{prefix}_{side}")] + ([F.col("n_shingles").alias(f"n_{side}")] if size else [])
            pairs = pairs.join(table.select(*names), side)
        return pairs

    def hopeful(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and sketches allow a link."""
        got = self._with(pairs, self.profiles, "sketch", "sketch", True)
        got = got.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        return got.mapInArrow(_hopeful(self.percent / 100), "a long, b long")

    def linked(self, pairs: DataFrame) -> DataFrame:
        return self._with(pairs, self.sets, "shingles", "set").mapInArrow(_verified(self.percent, False), "a long, b long")

    def differences(self, pairs: DataFrame) -> DataFrame:
        return self._with(pairs, self.sets, "shingles", "set").mapInArrow(_verified(self.percent, True), "a long, b long, n_a long, n_b long, added array<long>, removed array<long>")


def _labelled(entries: DataFrame, components: DataFrame) -> DataFrame:
    found = components.select(F.col("id"), F.col("component"))
    return entries.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Per row: id, n_shingles, component (smallest id reachable by links), class (smallest id with an equal set)."""
    source = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    profiles = staged(source.mapInArrow(tidy(_profiles, sh.forget), "id long, n_shingles long, digest binary, sketch binary, bands array<long>"), "profiles")
    known = profiles.where("id is not null and digest is not null")
    classes = staged(known.groupBy("digest").agg(F.min("id").alias("class")), "classes")
    heads = known.join(classes, [known.id == classes["class"], known.digest == classes.digest], "left_semi")

    # Buckets: only band keys that at least two class representatives share.
    entries = heads.select("id", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = staged(entries.join(shared, "key"), "buckets")
    company = entries.groupBy("id").agg(F.sum("n").alias("company"))
    ranked = entries.join(company, "id")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("less"))).alias("top")).select("key", (-F.col("top.less")).alias("pivot"))
    first, entries = entries, staged(entries.join(pivots, "key"), "buckets")
    discard(first)

    members = entries.select("id").distinct()
    wanted = source.where("id is not null").join(members, "id", "left_semi")
    sets = staged(wanted.mapInArrow(tidy(_sets, sh.forget), "id long, shingles binary"), "sets")
    search = _Search(heads.join(members, "id", "left_semi").select("id", "n_shingles", "sketch"), sets, percent)

    pairs = staged(search.hopeful(entries.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()), "pairs")
    links = staged(search.linked(pairs), "links")
    components = connected(links)

    # What is left: buckets that still hold more than one component.
    labelled = _labelled(entries, components)
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    labelled = staged(labelled.join(open_keys, "key"), "open")
    small = labelled.where(F.col("n") <= SMALL_BUCKET)
    small = small.join(search.profiles, "id").select("key", "id", "component", "n_shingles", "sketch").repartition("key").sortWithinPartitions("key")
    crossing = small.mapInArrow(_met(percent / 100), "a long, b long").distinct()
    crossing = crossing.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = staged(search.linked(crossing).union(_beside_pivots(search, labelled.where(F.col("n") > SMALL_BUCKET), percent)), "links")
    links = links.union(more)
    components = connected(links)
    discard(entries, labelled, pairs, sets)

    joined = profiles.join(classes, "digest", "left")
    lookup = components.select(F.col("id").alias("class"), "component")
    joined = joined.join(lookup, "class", "left")
    out = joined.select("id", "n_shingles", F.coalesce("component", "class", "id").alias("component"), F.coalesce("class", "id").alias("class"))
    out.parts = (profiles, classes)  # for whoever makes a table of the result and needs them no longer
    return out


def _beside(percent: int):
    """Links of strays to members of other components in a chunk, exactly, by their differences from the pivot.

    Rows come sorted by pivot, chunk and block, members before strays. The members' differences, of bounded size, are one
    sorted index of cells; strays stream past it, and their overlaps with every member are counts of owners in it. One
    link for each pair of components leaves a chunk.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, index, root = None, [], None, {}
        out: list[tuple[int, int]] = []

        def top(k: int) -> int:
            while root.get(k, k) != k:
                k = root[k]
            return k

        def indexed():
            size = np.array([len(m["cells"]) for m in members], np.int64)
            cells = np.concatenate([m["cells"] for m in members])
            order = np.argsort(cells, kind="stable")
            ids, component, n = (np.array([m[k] for m in members], np.int64) for k in ("a", "component", "n"))
            return ids, component, n, size, cells[order], np.repeat(np.arange(len(members)), size)[order]

        def compare(x: dict) -> None:
            ids, component, n, size, cells, owner = index
            low, high = np.searchsorted(cells, x["cells"]), np.searchsorted(cells, x["cells"], "right")
            met = [owner[i:j] for i, j in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True)]
            both = np.bincount(np.concatenate(met), minlength=len(ids)) if met else np.zeros(len(ids), np.int64)
            apart = len(x["cells"]) + size - 2 * both
            linked = (100 * (x["n"] + n - apart) >= percent * (x["n"] + n + apart)) & (component != x["component"])
            for k in np.flatnonzero(linked).tolist():
                i, j = top(x["component"]), top(int(component[k]))
                if i != j:
                    root[i] = j
                    out.append((x["a"], int(ids[k])))

        for b in batches:
            flat, ends = b.column("cells").flatten().to_numpy(zero_copy_only=False), b.column("cells").offsets.to_numpy()
            ends = ends - ends[0]
            for k, r in enumerate(b.drop_columns(["cells"]).to_pylist()):
                if (r["pivot"], r["chunk"], r["block"]) != now:
                    now, members, index, root = (r["pivot"], r["chunk"], r["block"]), [], None, {}
                r["cells"] = flat[ends[k] : ends[k + 1]]
                if r["asks"] == 0:
                    members.append(r | {"cells": r["cells"].copy()})  # not the whole batch
                elif members:
                    index = index or indexed()
                    compare(r)
            yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out.clear()

    return work


def _beside_pivots(search: _Search, entries: DataFrame, percent: int) -> DataFrame:
    """Links between members of one large bucket that its pivot does not connect.

    A pivot's members are dealt into chunks, and its strays, the members in other components than the pivot, into blocks;
    each chunk meets each block by itself. So a task's share is one chunk and one block however large the bucket, rows are
    strays times chunks plus members times blocks, and comparing makes no rows but links.
    """
    pairs = entries.select("id", "pivot", "component").distinct()
    head = pairs.where("id = pivot").select("pivot", F.col("component").alias("pivot_component"))
    pairs = pairs.join(head, "pivot")
    far = search.differences(pairs.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    far = far.join(pairs.select(F.col("id").alias("a"), F.col("pivot").alias("b"), "component", "pivot_component"), ["a", "b"])
    far = far.select("a", F.col("b").alias("pivot"), F.col("n_a").alias("n"), "component", (F.col("component") != F.col("pivot_component")).alias("stray"), F.concat("added", "removed").alias("cells"))
    far = staged(far, "differences")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum(F.size("cells")) / CHUNK_CELLS)).cast("int")
    sizes = far.groupBy("pivot").agg(chunks.alias("chunks"), F.ceil(F.count_if("stray") / STRAYS).cast("int").alias("blocks")).where("blocks > 0")
    dealt = far.join(sizes, "pivot")
    place = lambda n: F.pmod(F.xxhash64("a", F.lit(n)), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    seat = lambda chunk, block, asks: F.struct(chunk.alias("chunk"), block.alias("block"), F.lit(asks).alias("asks"))
    own = F.transform(each("blocks"), lambda k: seat(place("chunks"), k, 0))
    asking = F.when(F.col("stray"), F.transform(each("chunks"), lambda k: seat(k, place("blocks"), 1)))
    seats = F.concat(own, F.coalesce(asking, F.slice(own, 1, 0)))
    dealt = dealt.withColumn("seat", F.explode(seats)).select("pivot", "seat.*", "a", "n", "component", "cells")
    dealt = dealt.repartition("pivot", "chunk", "block").sortWithinPartitions("pivot", "chunk", "block", "asks")
    return dealt.mapInArrow(_beside(percent), "a long, b long").distinct()
