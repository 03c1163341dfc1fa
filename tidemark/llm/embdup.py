"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

A vector is normalised; each of ``TABLES`` tables hashes ``WIDTHS`` quantised Gaussian projections
floor((a.x + b) / WIDTH). Cosine 0.98 is Euclidean distance 0.2, where one projection agrees with
probability 0.87 and at least one table with 1 - 7e-5; higher cosines do better. Only vectors with equal
labels and dimensions can share a key.

Equal vectors of a label are one class with a weight, so copies cost nothing. Buckets larger than ``CHUNK``
are split into chunks and processed chunk against chunk, so a task holds at most two chunks; inside a block
cosines are one matrix product, and only per-member link weights and a spanning forest leave it. A pair that
meets in several tables counts in the first of them.

Defined results: a null label or vector, a zero vector and one with null or non-finite components: no links,
a component of its own; ties: the smallest id names a component; repeated rows: copies of a class; null id: no
component; empty table: no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected
from tidemark.llm.shingles import mixed
from tidemark.session import staged

TABLES, WIDTHS, WIDTH = 48, 12, 1.2
CHUNK = 512


def _planes(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977 + dim)
    odd = rng.integers(1, 1 << 62, (TABLES, WIDTHS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.standard_normal((dim, TABLES * WIDTHS)), rng.uniform(0, WIDTH, TABLES * WIDTHS), odd


def table_keys(unit: np.ndarray, label: int) -> np.ndarray:
    """(rows, TABLES) keys of unit vectors of one label."""
    planes, shift, odd = _planes(unit.shape[1])
    cells = np.floor((unit @ planes + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), TABLES, WIDTHS)
    salt = mixed(np.arange(TABLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(np.array([label & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] + np.uint64(unit.shape[1]))
    return mixed((cells * odd).sum(2, dtype=np.uint64) ^ salt).view(np.int64)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, label, vectors = b.column("id"), b.column("label").to_pylist(), b.column("embedding").to_pylist()
        n = b.num_rows
        digest, unit, keys = [None] * n, [None] * n, [None] * n
        groups: dict[tuple[int, int], list[int]] = {}
        for k, (y, v) in enumerate(zip(label, vectors, strict=True)):
            if y is not None and v and None not in v:
                groups.setdefault((y, len(v)), []).append(k)
        for (y, _), rows in groups.items():
            x = np.array([vectors[k] for k in rows], np.float64)
            top = np.abs(x).max(1)
            good = np.isfinite(top) & (top > 0)
            rows, x = [k for k, g in zip(rows, good, strict=True) if g], x[good]
            if not rows:
                continue
            x += 0.0  # one zero
            scaled = x / np.abs(x).max(1, keepdims=True)
            u = scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))
            for k, raw, v, t in zip(rows, x, u, table_keys(u, y), strict=True):
                digest[k] = hashlib.blake2b(raw.tobytes(), digest_size=16, key=str(y).encode()).digest()
                unit[k], keys[k] = v.tobytes(), t
        yield pa.record_batch([ids, b.column("label"), pa.array(digest, pa.binary()), pa.array(unit, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "label", "digest", "unit", "keys"])


def _block(rows: list[dict], least: float) -> list[tuple[int, int, int]]:
    """(id, weight of members linked to it for the first time here, a member it is connected with)."""
    same = rows[0]["lo"] == rows[0]["hi"]
    left = rows if same else [r for r in rows if r["chunk"] == r["lo"]]
    right = rows if same else [r for r in rows if r["chunk"] == r["hi"]]
    if not left or not right:
        return []
    x, y = (np.stack([np.frombuffer(r["unit"]) for r in side]) for side in (left, right))
    own = [np.array([r["label"] for r in side]) for side in (left, right)]
    i, j = np.nonzero((x @ y.T >= least) & (own[0][:, None] == own[1][None, :]))
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return []
    members = left if same else left + right
    shift = 0 if same else len(left)
    kx, ky = (np.array([r["keys"] for r in side]) for side in (left, right))
    key = rows[0]["key"]
    place = int(np.argmax(kx[0] == key))
    first = np.ones(len(i), bool)
    if place:
        for at in range(0, len(i), 65536):
            part = slice(at, at + 65536)
            first[part] = ~(kx[i[part], :place] == ky[j[part], :place]).any(1)
    weight = np.array([r["n"] for r in members])
    links = np.zeros(len(members), np.int64)
    np.add.at(links, i[first], weight[j[first] + shift])
    np.add.at(links, j[first] + shift, weight[i[first]])
    root = np.arange(len(members))
    a, b = i, j + shift
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(r["id"], int(n), members[k]["id"]) for r, n, k in zip(members, links, root, strict=True) if n or members[k]["id"] != r["id"]]


def _blocks(least: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], schema=schema)
            out.clear()
            return made

        for b in batches:
            for r in b.to_pylist():
                at = (r["key"], r["lo"], r["hi"])
                if at != now:
                    if len(rows) > 1:
                        out.extend(_block(rows, least))
                    now, rows = at, []
                rows.append(r)
            yield flush()
        if len(rows) > 1:
            out.extend(_block(rows, least))
        yield flush()

    return work


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """Per row: id, n_links (other vectors linked directly) and component (smallest id reachable)."""
    source = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("embedding"))
    profiles = staged(source.mapInArrow(_profiles, "id long, label long, digest binary, unit binary, keys array<long>"), "vectors")
    known = profiles.where("id is not null and digest is not null")
    classes = staged(known.groupBy("digest").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n")), "classes")
    heads = known.join(classes, [known.digest == classes.digest, known.id == classes["class"]]).select("id", "label", "n", "unit", "keys").dropDuplicates(["id"])

    entries = heads.select("id", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = entries.join(shared, "key").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    entries = entries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    entries = entries.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    entries = entries.select("id", "key", "chunk", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"))
    full = entries.join(heads, "id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = staged(full.mapInArrow(_blocks(least), "id long, links long, other long"), "found")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct())
    lookup = classes.join(links, classes["class"] == links.id, "left").select("digest", "class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    lookup = lookup.join(components, lookup["class"] == components.id, "left").select("digest", "n_links", F.coalesce("component", "class").alias("component"))
    return profiles.join(lookup, "digest", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
