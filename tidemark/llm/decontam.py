"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so a plain MinHash of whole documents would see almost no
similarity. Both sides are partitioned by size instead: items by the power of two ``B`` that holds their
shingles, documents into windows of ``2 B`` consecutive shingles every ``B``, one windowing per item class
present. An item that a document contains lies in one window, whose Jaccard similarity with it is at
least about 0.19 at a containment of 0.8; with ``HASHES`` one-row bands a hit is missed with a probability
of about 1e-6. Every hit is then verified: exact containment of the item's shingle set in the document's
whole set.

One narrow pass over the documents for every slice of about ``SLICE`` items or ``SLICE_BYTES`` of their text, whichever
is less, which bounds what is sent to the executors; larger benchmarks take more passes. Long texts are searched in
overlapping pieces, so memory does not grow with them beyond their own words.

Defined results: null or empty texts match nothing; items with fewer than five words count as one shingle of
their own length; repeated items and documents each give their own rows; empty tables: no rows; extra columns
are ignored; very long texts are processed in the same windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles as sh
from tidemark.llm.memory import tidy

HASHES = 64
SLICE, SLICE_BYTES = 50_000, 1 << 26
STEP, PIECE = 4000, 1 << 15  # shingles whose minima are worked out at a time, and of one text at most
_rng = np.random.default_rng(4711)
_A = (_rng.integers(1, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_C = _rng.integers(0, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64)
_SALT = sh.mixed(np.arange(1, HASHES + 1, dtype=np.uint64))[:, None]
_BITS = np.uint64(42)  # a filter of 2^22 cells
OUT = "doc_id long, item_id long, shared long, item_shingles long, containment double"


def _keys(minima: np.ndarray) -> np.ndarray:
    """(HASHES, n) minima as keys that also say which hash they belong to."""
    return sh.mixed(minima ^ _SALT)


class _Items:
    """Items of one slice: per shingle length and size class, a filter and a table from key to items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.sets: list[tuple[int, int, np.ndarray]] = []  # item, words in a shingle, shingles
        self.classes: dict[tuple[int, int], tuple[np.ndarray, dict[int, list[int]]]] = {}
        for item_id, text in items:
            hashes = sh.word_hashes(text)
            if not len(hashes):
                continue
            s = np.unique(sh.shingles_of(hashes))
            place = len(self.sets)
            k = min(sh.K, len(hashes))
            self.sets.append((item_id, k, s))
            at = (k, 1 << max(0, int(len(s) - 1).bit_length()))
            filter_, table = self.classes.setdefault(at, (np.zeros(1 << 22, bool), {}))
            keys = _keys((s[None, :] * _A[:, None] + _C[:, None]).min(1)[:, None])[:, 0]
            filter_[keys >> _BITS] = True
            for key in keys.tolist():
                table.setdefault(key, []).append(place)


def _candidates(items: _Items, hashes: list[np.ndarray]) -> dict[int, set[int]]:
    """Places of items that may be contained, by place of the document in the batch."""
    found: dict[int, set[int]] = {}
    by_length: dict[int, list[int]] = {}
    for k, size in items.classes:
        by_length.setdefault(k, []).append(size)
    for k, sizes in by_length.items():
        over = 2 * max(sizes)  # a window of any size lies in one piece
        docs = [(d, s[at : at + PIECE + over]) for d, h in enumerate(hashes) if len(h) >= k for s in (sh.shingles_of(h, k),) for at in range(0, max(1, len(s) - over), PIECE)]
        for at, part in _steps(docs):
            _search(items, k, sizes, docs[at:part], found)
    return found


def _steps(docs: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Ranges of pieces with about STEP shingles, a longer piece by itself."""
    first = total = 0
    for k, (_, s) in enumerate(docs):
        if k > first and total + len(s) > STEP:
            yield first, k
            first, total = k, 0
        total += len(s)
    if first < len(docs):
        yield first, len(docs)


def _search(items: _Items, k: int, sizes: list[int], docs: list[tuple[int, np.ndarray]], found: dict[int, set[int]]) -> None:
    """Add the candidates of some pieces to ``found``."""
    flat = np.concatenate([s for _, s in docs])
    lengths = np.array([len(s) for _, s in docs])
    begins = np.cumsum(lengths) - lengths
    values = flat[None, :] * _A[:, None] + _C[:, None]
    for size in sizes:
        blocks = -(-lengths // size)
        owner = np.repeat(np.arange(len(docs)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        low = np.minimum.reduceat(values, begins[owner] + nth * size, axis=1)
        joined = low.copy()
        together = owner[1:] == owner[:-1]
        joined[:, :-1][:, together] = np.minimum(low[:, :-1], low[:, 1:])[:, together]
        filter_, table = items.classes[k, size]
        keys = _keys(joined)
        _, windows = hit = np.nonzero(filter_[keys >> _BITS])
        for key, w in zip(keys[hit].tolist(), windows.tolist(), strict=True):
            if key in table:
                found.setdefault(docs[owner[w]][0], set()).update(table[key])


def _work(items: list[tuple[int, str]], least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Items(items)
        for b in batches:
            at = 0
            while at < b.num_rows:
                hashes, total, first = [], 0, at
                while at < b.num_rows and (not hashes or total < STEP):
                    hashes.append(sh.word_hashes(b.column("text")[at].as_py()))
                    total += len(hashes[-1])
                    at += 1
                rows = []
                for d, places in sorted(_candidates(known, hashes).items()):
                    whole: dict[int, np.ndarray] = {}
                    for place in sorted(places):
                        item_id, k, s = known.sets[place]
                        if k not in whole:
                            whole[k] = sh.shingles_of(hashes[d], k)
                        shared = int(np.isin(s, whole[k]).sum())
                        if shared >= least * len(s):
                            rows.append((b.column("doc_id")[first + d].as_py(), item_id, shared, len(s), shared / len(s)))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "shared", "item_shingles", "containment"])

    return work


def contained(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for every contained test item."""
    source = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = benchmark.select("item_id", "text").where("text is not null")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices = max(1, -(-n // SLICE), -(-size // SLICE_BYTES))
    out = None
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        got = source.mapInArrow(tidy(_work([tuple(r) for r in part.toLocalIterator()], least), sh.forget), OUT)
        out = got if out is None else out.unionByName(got)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that contain no test item; rows and columns as they come."""
    bad = contained(docs, benchmark, least, id, text).select(F.col("doc_id").alias("__tm_bad")).distinct()
    return docs.join(bad, F.col(f"`{id}`") == F.col("__tm_bad"), "left_anti")
