"""Hard negatives by k-means inverted lists with stored centroid radii.

Centroids are fitted on a bounded sample (``SAMPLE`` rows with the smallest hashes of their ids); every row goes to
its nearest centroid's list, and a list stores the largest distance of a member to its centroid. An anchor q meets
a list with centroid c and radius r only within <q,c> - |q| r and <q,c> + |q| r (Cauchy-Schwarz). A list is
skipped if these bounds lie outside of the anchor's score windows, and as soon as its upper bound is
strictly below the k-th score found so far; equal scores are still looked at, as smaller ids win ties.

A search runs twice over the lists. The first pass visits for each anchor the ``PROBES`` lists with the highest
bounds and yields a floor, a k-th score that is surely reached. The second pass visits all lists that neither windows nor
floors exclude, best bound first, and raises the floors as it goes. So the result is exact for any
centroids; they only decide how much is skipped.

Positives are a search with one open window among the anchor's label, negatives one with a window for each
positive among the other labels.

Shape at scale: anchors are a stated share of the rows and are searched in blocks of ``BLOCK`` anchors from
neighbouring lists. A list is kept in pieces of ``PIECE`` rows dealt by hash, so a list with a third of all rows is many
pieces. Blocks and pieces meet in (block, group), where a group has some ``GROUP_ROWS`` rows of the visited
pieces; a task holds one block and one piece at a time and only k rows per anchor and window leave it. What is
broadcast are at most ``MOST_LISTS`` centroids and radii, whatever the input.

Scores are integers and exact: products of doubles while they fit 53 bits, else of 64-bit integers. Defined results:
a null id, label or vector, an empty vector, one with a null or non-finite component or with a squared norm of
2^62 or more (scores would not fit 64 bits): the row takes no part; rows that repeat in id, label and
vector count once; rows that share an id only are rows of their own, ties go by id, then by a hash of
label and vector; vectors of different lengths have no score; fewer rows than asked: all of them; an empty table:
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import discard, staged

SAMPLE, ROUNDS, MOST_LISTS = 20_000, 8, 1024
PROBES = 4
BLOCK, PIECE, GROUP_ROWS = 512, 2048, 1 << 15
LOWEST, HIGHEST = -(1 << 62), 1 << 62


@dataclass
class Lists:
    """Centroids by vector length, numbered over all lengths, and the radius of every list."""

    centroids: dict[int, np.ndarray]
    first: dict[int, int]
    radius: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and distance of vectors of one length."""
        c = self.centroids[x.shape[1]]
        x = x.astype(np.float64)
        at = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        return at + self.first[x.shape[1]], np.sqrt(((x - c[at]) ** 2).sum(1))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, lists of their length) lowest and highest possible score, with room for rounding."""
        c, first = self.centroids[q.shape[1]], self.first[q.shape[1]]
        q = q.astype(np.float64)
        mid, size = q @ c.T, np.sqrt((q * q).sum(1))
        reach = size[:, None] * self.radius[first : first + len(c)][None, :]
        room = 1.0 + 1e-9 * (np.abs(mid) + reach)
        return mid - reach - room, mid + reach + room


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of rows, from evenly spaced distinct rows; an empty cluster keeps its centroid."""
    x = x.astype(np.float64)
    start = np.unique(x, axis=0)
    c = start[np.linspace(0, len(start) - 1, min(k, len(start))).astype(int)]
    for _ in range(rounds):
        at = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def prepared(vectors: DataFrame, id: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """(id, label, uid, dim, x): rows that take part, x their components floor(scale * x) as 32-bit integers."""
    raw = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda v: F.floor(v * scale).cast("double"))
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"), raw.alias("w"))
    odd = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.aggregate("w", F.lit(0.0), lambda a, v: a + v * v)
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & ~F.coalesce(odd, F.lit(True)))
    rows = rows.where(norm < float(HIGHEST)).withColumn("x", F.transform("w", lambda v: v.cast("int")))
    rows = rows.select("id", "label", F.xxhash64("label", "x").alias("uid"), F.size("x").alias("dim"), "x")
    return rows.dropDuplicates(["id", "label", "uid"])


def fitted(rows: DataFrame) -> tuple[DataFrame, Lists, dict[int, int]]:
    """Rows with their list, the lists with radii, and each list's number of rows; ``MOST_LISTS`` numbers come back."""
    total = rows.count()
    sample = rows.select("x").orderBy(F.xxhash64("id", "uid"), "id").limit(SAMPLE).collect()  # the bounded sample
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.x), []).append(r.x)
    wanted = min(MOST_LISTS, max(1, round(total**0.5 / 2)))
    centroids, first, n = {}, {}, 0
    for dim, xs in sorted(by_dim.items()):
        centroids[dim], first[dim] = kmeans(np.array(xs), max(1, wanted * len(xs) // len(sample))), n
        n += len(centroids[dim])
    lists = Lists(centroids, first, np.zeros(n))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, far = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                if int(dim) in lists.centroids:
                    mine = np.flatnonzero(dims == dim)
                    at[mine], far[mine] = lists.nearest(_matrix(b.column("x").take(pa.array(mine)), int(dim)))
            yield pa.record_batch([*b.columns, pa.array(at.astype(np.int32)), pa.array(far)], names=[*b.schema.names, "list", "far"])

    kept = "id long, label long, uid long, dim int, x array<int>"
    placed = staged(rows.mapInArrow(assign, f"{kept}, list int, far double"), "lists")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    missing = [r for r in sizes if r["list"] < 0]  # lengths that the sample does not have: one list each, with no bound
    if missing:
        dims = [r.dim for r in placed.where("list < 0").groupBy("dim").count().orderBy("dim").limit(MOST_LISTS).collect()]
        for dim in dims:
            lists.centroids[dim], lists.first[dim] = np.zeros((1, dim)), len(lists.radius)
            lists.radius = np.append(lists.radius, np.inf)
        where = F.create_map(*[F.lit(v) for d in dims for v in (d, lists.first[d])])
        old, placed = placed, staged(placed.withColumn("list", F.when(F.col("list") < 0, where[F.col("dim")]).otherwise(F.col("list"))), "lists")
        discard(old)
        sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    for r in sizes:
        if np.isfinite(lists.radius[r["list"]]):
            lists.radius[r["list"]] = r.radius * (1 + 1e-9)
    return placed, lists, {r["list"]: r.n for r in sizes}


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _blocked(anchors: DataFrame) -> DataFrame:
    """Anchors with a block of ``BLOCK`` anchors about, of lists that follow each other; one number per list is gathered."""
    counts = anchors.groupBy("list").agg(F.count(F.lit(1)).alias("n")).orderBy("list").collect()
    start, parts, block, room = {}, {}, 0, BLOCK
    for r in counts:
        if r.n > room and room < BLOCK:
            block, room = block + 1, BLOCK
        start[r["list"]], parts[r["list"]] = block, max(1, -(-r.n // BLOCK))
        if r.n >= BLOCK:
            block, room = block + parts[r["list"]], BLOCK
        else:
            room -= r.n
    if not counts:
        return anchors.withColumn("block", F.lit(0))
    at = F.create_map(*[F.lit(v) for x in start.items() for v in x])
    n = F.create_map(*[F.lit(v) for x in parts.items() for v in x])
    return anchors.withColumn("block", at[F.col("list")] + F.pmod(F.xxhash64("id", "uid"), n[F.col("list")]).cast("int"))


ASKED = "block int, a_id long, a_uid long, a_label long, dim int, a_x array<int>, lows array<long>, highs array<long>, floors array<long>"


def _allowed(lists: Lists, q: np.ndarray, lows: np.ndarray, highs: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, lists): whether a list may hold rows of one of the anchor's windows, and its highest possible score."""
    low, high = lists.bounds(q)
    least = np.maximum(lows, floors)
    allowed = np.zeros(low.shape, bool)
    for w in range(lows.shape[1]):
        allowed |= (high >= least[:, w, None]) & (low <= highs[:, w, None])
    return allowed, high


def _visits(lists: Lists, probes: int | None):
    """(block, list, bound) of the lists that a block's anchors have to see, or of each one's ``probes`` best."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, dims = b.column("block").to_numpy(), b.column("dim").to_numpy()
            out = []
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                part = b.take(pa.array(mine))
                n = len(part.column("lows")[0]) if len(mine) else 0
                windows = [_matrix(part.column(c), n) for c in ("lows", "highs", "floors")]
                allowed, high = _allowed(lists, _matrix(part.column("a_x"), int(dim)), *windows)
                if probes is not None and probes < high.shape[1]:
                    ranked = np.where(allowed, high, -np.inf)
                    kth = np.partition(ranked, -probes, 1)[:, -probes]
                    allowed &= ranked >= kth[:, None]
                for block in np.unique(blocks[mine]):
                    own = blocks[mine] == block
                    best = np.where(allowed[own], high[own], -np.inf).max(0)
                    seen = np.flatnonzero(best > -np.inf)
                    out += [(int(block), int(lists.first[int(dim)] + k), float(best[k])) for k in seen]
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], names=["block", "list", "bound"])

    return work


class _Block:
    """A block of anchors with the best rows found so far for each window."""

    def __init__(self, rows: list[tuple], k: int, same: bool, lists: Lists) -> None:
        self.k, self.same, self.lists = k, same, lists
        self.ids, self.uids, self.labels = (np.array([r[j] for r in rows], np.int64) for j in (0, 1, 2))
        self.x = np.stack([r[3] for r in rows]).astype(np.int64)
        self.lows, self.highs, self.floors = (np.array([r[j] for r in rows], np.int64) for j in (4, 5, 6))
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(1))
        self.best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.allowed: dict[int, np.ndarray] = {}

    def open(self, number: int) -> np.ndarray:
        """The anchors that the list can still concern."""
        first = self.lists.first[self.x.shape[1]]
        allowed, _ = _allowed_one(self.lists, self.x, number - first, self.lows, self.highs, self.floors)
        return np.flatnonzero(allowed)

    def see(self, number: int, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        rows = self.open(number)
        if not len(rows):
            return
        order = np.lexsort((uids, ids))
        ids, uids, labels, x = ids[order], uids[order], labels[order], x[order]
        q = self.x[rows]
        if self.norm[rows].max() * np.sqrt((x.astype(np.float64) ** 2).sum(1).max()) < 2.0**52:
            scores = (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        else:
            scores = q @ x.astype(np.int64).T
        fits = (labels[None, :] == self.labels[rows, None]) == self.same
        if self.same:
            fits &= ~((ids[None, :] == self.ids[rows, None]) & (uids[None, :] == self.uids[rows, None]))
        for i, a in enumerate(rows.tolist()):
            mine = np.flatnonzero(fits[i])
            s = scores[i, mine]
            for w in range(self.lows.shape[1]):
                at = np.flatnonzero((s >= max(self.lows[a, w], self.floors[a, w])) & (s <= self.highs[a, w]))
                if not len(at):
                    continue
                if len(at) > 4 * self.k:
                    at = at[s[at] >= np.partition(s[at], -self.k)[-self.k]]
                at = at[np.argsort(-s[at], kind="stable")[: self.k]]
                new = [(-int(s[j]), int(ids[mine[j]]), int(uids[mine[j]])) for j in at]
                best = self.best[a, w] = sorted(self.best.get((a, w), []) + new)[: self.k]
                if len(best) == self.k:
                    self.floors[a, w] = max(self.floors[a, w], -best[-1][0])

    def rows(self) -> list[tuple]:
        return [(int(self.ids[a]), int(self.uids[a]), w, n, u, -s) for (a, w), found in self.best.items() for s, n, u in found]


def _allowed_one(lists: Lists, q: np.ndarray, at: int, lows: np.ndarray, highs: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dim = q.shape[1]
    one = Lists({dim: lists.centroids[dim][at : at + 1]}, {dim: 0}, lists.radius[lists.first[dim] + at : lists.first[dim] + at + 1])
    allowed, high = _allowed(one, q, lows, highs, floors)
    return allowed[:, 0], high[:, 0]


FOUND = "a_id long, a_uid long, w int, id long, uid long, score long"


def _search(lists: Lists, k: int, same: bool):
    """Rows come sorted: of a (block, group) first the anchors, then the pieces, best bound first."""
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (c.split() for c in FOUND.split(", "))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = piece = None
        asked: list[tuple] = []
        held: list[tuple] = []
        blocks: dict[int, _Block] = {}

        def close_piece() -> None:
            if held and asked:
                for dim in {len(r[3]) for r in asked}:
                    blocks[dim] = _Block([r for r in asked if len(r[3]) == dim], k, same, lists)
                asked.clear()
            if held and (block := blocks.get(len(held[0][3]))):
                block.see(piece[0], *(np.array([r[j] for r in held], np.int64) for j in (0, 1, 2)), np.stack([r[3] for r in held]))
            held.clear()

        def close_block() -> list[tuple]:
            out = [r for b in blocks.values() for r in b.rows()]
            blocks.clear()
            asked.clear()
            return out

        for b in batches:
            out: list[tuple] = []
            xs, lows, highs, floors = (_ragged(b.column(c)) for c in ("x", "lows", "highs", "floors"))
            columns = ("block", "group", "list", "piece", "id", "uid", "label")
            for j, (block, group, number, part, id_, uid, label) in enumerate(zip(*(b.column(c).to_pylist() for c in columns), strict=True)):
                if (block, group) != now:
                    close_piece()
                    out += close_block()
                    now, piece = (block, group), None
                if number is None:
                    asked.append((id_, uid, label, xs[j], lows[j], highs[j], floors[j]))
                    continue
                if (number, part) != piece or len(held) >= 2 * PIECE:
                    close_piece()
                    piece = (number, part)
                held.append((id_, uid, label, xs[j]))
            yield table(out)
        close_piece()
        yield table(close_block())

    return work


def _ragged(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays of their own."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0, int)
    return [x.copy() for x in np.split(flat, ends[:-1])] if len(column) else []


def _pass(asked: DataFrame, rows: DataFrame, lists: Lists, sizes: dict[int, int], k: int, same: bool, probes: int | None) -> DataFrame:
    """The k best rows of each window among the lists visited: (a_id, a_uid, w, id, uid, score, rank)."""
    visits = asked.mapInArrow(_visits(lists, probes), "block int, list int, bound double")
    visits = visits.groupBy("block", "list").agg(F.max("bound").alias("bound"))
    counts = F.create_map(*[F.lit(v) for x in sizes.items() for v in x])
    visits = staged(visits.withColumn("rows", counts[F.col("list")].cast("long")).where("rows > 0"), "visits")
    pieces = lambda n: F.ceil(n / PIECE).cast("int")
    groups = visits.groupBy("block").agg(F.ceil(F.sum("rows") / GROUP_ROWS).cast("int").alias("groups"))
    dealt = visits.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces(F.col("rows")) - 1))).join(groups, "block")
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("list", "piece"), F.col("groups")).cast("int"))

    none = F.lit(None).cast("array<long>")
    members = rows.withColumn("piece", F.pmod(F.xxhash64("id", "uid"), pieces(counts[F.col("list")])).cast("int"))
    left = members.join(dealt, ["list", "piece"]).select("block", "group", "bound", "list", "piece", "id", "uid", "label", "x", none.alias("lows"), none.alias("highs"), none.alias("floors"))
    heads = asked.join(dealt.select("block", "group").distinct(), "block")
    heads = heads.select("block", "group", F.lit(float("inf")).alias("bound"), F.lit(None).cast("int").alias("list"), F.lit(None).cast("int").alias("piece"), F.col("a_id").alias("id"), F.col("a_uid").alias("uid"), F.col("a_label").alias("label"), F.col("a_x").alias("x"), "lows", "highs", "floors")
    both = heads.unionByName(left).repartition("block", "group").sortWithinPartitions("block", "group", F.desc("bound"), "list", "piece")
    found = both.mapInArrow(_search(lists, k, same), FOUND)
    best = Window.partitionBy("a_id", "a_uid", "w").orderBy(F.desc("score"), "id", "uid")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = staged(found, "found")
    discard(visits)
    return out


def search(asked: DataFrame, rows: DataFrame, lists: Lists, sizes: dict[int, int], k: int, same: bool) -> DataFrame:
    """The k best rows for every window of the anchors ``asked``: a pass for floors, then one over what they leave."""
    probed = _pass(asked, rows, lists, sizes, k, same, PROBES)
    floors = probed.where(F.col("rank") == k).groupBy("a_id", "a_uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("known"))
    window = F.sequence(F.lit(0), F.size("lows") - 1)
    raised = F.transform(window, lambda w: F.coalesce(F.col("known")[w], F.lit(LOWEST)))
    columns = [c.split()[0] for c in ASKED.split(", ")]
    again = staged(asked.join(floors, ["a_id", "a_uid"], "left").withColumn("floors", raised).select(*columns), "asked")
    out = _pass(again, rows, lists, sizes, k, same, None)
    discard(again, probed)
    return out


def hard_negatives(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", every: int = 100,
    positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, whose id ``every`` divides.

    A negative's score lies between ``window`` hundredths of the positive's.
    """
    rows = prepared(vectors, id, vector, F.col(f"`{label}`") if isinstance(label, str) else label)
    rows = staged(rows, "vectors")
    placed, lists, sizes = fitted(rows)
    if not sizes:
        return placed.select(*[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long".split(", "))]).limit(0)
    anchors = _blocked(placed.where(F.col("id") % every == 0))
    longs = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    anchors = anchors.select("block", F.col("id").alias("a_id"), F.col("uid").alias("a_uid"), F.col("label").alias("a_label"), "dim", F.col("x").alias("a_x"))
    asked = staged(anchors.select("*", longs(LOWEST).alias("lows"), longs(HIGHEST).alias("highs"), longs(LOWEST).alias("floors")), "asked")
    liked = search(asked, placed, lists, sizes, positives, True)

    low, high = window
    at = F.array_sort(F.collect_list(F.struct("rank", "score")))  # ``positives`` rows an anchor at most
    bounds = liked.groupBy("a_id", "a_uid").agg(at.alias("p"))
    lows = F.transform("p", lambda p: F.ceil(F.lit(low).cast("decimal(20,0)") * p["score"] / 100).cast("long"))
    highs = F.transform("p", lambda p: F.floor(F.lit(high).cast("decimal(20,0)") * p["score"] / 100).cast("long"))
    missing = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(positives) - F.size("p")))
    empty = F.array_repeat(F.lit(-1).cast("long"), F.lit(positives) - F.size("p"))  # a window from 0 to -1 for each positive that there is not
    windows = bounds.select("a_id", "a_uid", missing(lows).alias("lows"), F.concat(highs, empty).alias("highs"), F.array_repeat(F.lit(LOWEST), positives).alias("floors"))
    wanted = staged(asked.select("block", "a_id", "a_uid", "a_label", "dim", "a_x").join(windows, ["a_id", "a_uid"]).select(*[c.split()[0] for c in ASKED.split(", ")]), "asked")
    found = search(wanted, placed, lists, sizes, negatives, False)
    chosen = liked.select("a_id", "a_uid", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(chosen, ["a_id", "a_uid", "w"])
    discard(rows, asked, wanted)
    return out.select(F.col("a_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
