"""The online random-cut forest: its trees against their definition, and the stream against the table."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import randomcut as rc
from tidemark.streaming.forest import forest_stream

FIRST = 1_700_000_000  # a stream's watermark begins at 0


def members(tree, at):
    if tree.left[at] < 0:
        return [tree.lo[at]] * tree.n[at]
    return members(tree, tree.left[at]) + members(tree, tree.right[at])


def holds(tree, at, above=-1):
    """Boxes, counts and cuts of a subtree are those of its points."""
    own = np.array(members(tree, at))
    assert tree.up[at] == above and tree.n[at] == len(own)
    assert tree.lo[at] == tuple(own.min(0)) and tree.hi[at] == tuple(own.max(0))
    if tree.left[at] < 0:
        assert (own == own[0]).all()
        return
    d = tree.dim[at]
    assert (np.array(members(tree, tree.left[at]))[:, d] <= tree.cut[at]).all() and (np.array(members(tree, tree.right[at]))[:, d] > tree.cut[at]).all()
    holds(tree, tree.left[at], at)
    holds(tree, tree.right[at], at)


def displaced(tree, leaf):
    """By definition: for all subtrees around a leaf, points that move up when the subtree goes, for each point of it."""
    around, at = [], tree.root
    point = tree.lo[leaf]
    while at != leaf:
        kids = (tree.left[at], tree.right[at])
        near = kids[0] if point[tree.dim[at]] <= tree.cut[at] else kids[1]
        around.append(len(members(tree, sum(kids) - near)) / len(members(tree, near)))
        at = near
    return max(around, default=0.0)


def test_trees_stay_what_their_points_make_them():
    rng = np.random.default_rng(5)
    tree = rc.RandomCutTree(np.random.default_rng(1), most=40)
    live = []
    for k in range(400):
        p = rng.integers(0, 6, 3).astype(float) if k % 3 else rng.normal(0, 10.0 ** rng.integers(-300, 300), 3)
        score = tree.update(p)
        live = [*live, tuple(float(x) / 12 for x in p)][-40:]
        assert sorted(members(tree, tree.root)) == sorted(live)
        assert score == displaced(tree, tree.order[-1])
        if k % 20 == 0:
            holds(tree, tree.root)
    assert len(tree.n) <= 2 * 41
    before = sorted(members(tree, tree.root))
    assert tree.score([1e308, -1e308, 1e308]) > 5
    assert sorted(members(tree, tree.root)) == before and len(tree.order) == 40
    holds(tree, tree.root)


def test_cuts_are_drawn_as_over_all_points():
    """The first cut parts {0, 1} from 10 nine times of ten, in whatever order points come and others go."""
    hits = {"in": 0, "out": 0}
    for k in range(3000):
        tree = rc.RandomCutTree(np.random.default_rng(k))
        for x in np.random.default_rng(k).permutation([0.0, 1.0, 10.0]):
            tree.insert([x])
        hits["in"] += 0.25 <= tree.cut[tree.root] < 2.5
        tree = rc.RandomCutTree(np.random.default_rng(k), most=3)
        for x in (500.0, 0.0, 10.0, -60.0, 1.0, 0.0, 10.0):
            tree.update([x])
        hits["out"] += 0.25 <= tree.cut[tree.root] < 2.5
    assert all(abs(n / 3000 - 0.9) < 0.025 for n in hits.values()), hits


def test_a_point_costs_a_path():
    tree = rc.RandomCutTree(np.random.default_rng(2))
    v = np.random.default_rng(3).normal(size=(1256, 4))
    for p in v[:256]:
        tree.update(p)
    tree.visited = 0
    for p in v[256:]:
        tree.update(p)
    assert tree.visited / 1000 < 256 * 4 / 10  # nodes a point; every value of all points would be 1,024


def test_stream_scores_as_the_table(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(s, FIRST + 3600 * k, float(x)) for s in ("a", "b") for k, x in enumerate(rng.normal(10, 1, 90))]
    rows[70] = ("a", FIRST + 3600 * 70, 99.0)
    rows += [("a", FIRST + 3600 * 90, float("nan")), ("b", FIRST + 3600 * 90, None)]
    df = spark.createDataFrame(rows, "series_id string, t long, value double").select("series_id", F.timestamp_seconds("t").alias("ts"), "value")
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = forest_stream(stream, trees=5, most=32).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None

    for a, b in ((0, 30), (30, 60), (60, 200)):  # the state comes back from the checkpoint
        df.where((F.unix_seconds("ts") >= FIRST + 3600 * a) & (F.unix_seconds("ts") < FIRST + 3600 * b)).coalesce(1).write.mode("append").parquet(source)
        run()
    table = {(r.series_id, r.ts): r.score for r in rc.forest_scores(df, trees=5, most=32).collect()}
    got = {(r.series_id, r.ts): r.score for r in spark.read.parquet(target).collect()}
    assert got == table and len(got) == 180
    assert max(got, key=got.get) == ("a", df.where("value = 99").first().ts)
    assert rc.forest_scores(df.limit(0)).count() == 0
