"""Conversation repair, hard negatives and archives against plain versions, with their edge cases."""

import glob
import gzip
import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import convrepair, hardneg, queries, repeats, warc
from tidemark.session import staged

EXTRA = "digest string, seen int, `a b` int"


def cheapest(turns):
    """All edit sequences with at most two insertions at one place."""
    best = 2 * len(turns), "D" * len(turns)

    def go(k, initials, audit, cost, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if k == len(turns) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best, (cost, audit))
        if inserts < 2:
            for x in "ua":
                go(k, initials + x, audit + "I", cost + 5, inserts + 1)
        if k < len(turns):
            initial, fault = turns[k]
            go(k + 1, initials, audit + "D", cost + 2, 0)
            if fault in (convrepair.NONE, convrepair.CUT):
                more = 5 if fault == convrepair.CUT else 0
                go(k + 1, initials + (initial or "?"), audit + "K", cost + more, 0)
                for x in "ua":
                    go(k + 1, initials + x, audit + "R", cost + more + 1, 0)

    go(0, "", "", 0, 0)
    return best


def test_paths_against_all_edits():
    r = random.Random(7)
    for _ in range(400):
        turns = [(r.choice(["s", "u", "a", "a", "u", "x", ""]), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randrange(6))]
        assert convrepair.shortest(turns) == cheapest(turns), turns


def test_long_conversation_keeps_little():
    paths = convrepair.Paths()
    for _ in range(20_000):
        paths.add("u", convrepair.NONE)  # no two paths of it ever meet
    cost, audit = paths.finish()
    assert len(audit) == 20_000 and cost == 10_000 and len(paths.back) == 80_000


def test_plans_and_repaired_turns(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 4, "assistant", "no end"), (1, 5, "user", " \n"),
        (2, None, "system", None), (3, 7, None, "What?"), (None, 1, "user", "A?"), (None, 2, "assistant", "B!\v"), (4, 3, "user", "One."), (4, 3, "user", "Two."),
        (5, 1, "user", "x" * 200_000 + "."), (5, None, "assistant", "First."), (5, 2, "user", "x" * 200_000 + "."),
    ]
    turns = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}")
    made = staged(convrepair.plans(turns), "made")
    got = {r.conv_id: tuple(r)[1:] for r in made.collect()}
    assert got[1] == (2, 1, 1, 1, 2, 6, "KKDDD") and got[2] == (0, 1, 0, 0, 0, 2, "D") and got[3] == (0, 0, 0, 0, 0, 2, "D")
    assert got[None] == (0, 0, 0, 0, 0, 0, "KK") and got[4] == (0, 0, 0, 0, 1, 1, "KR") and got[5] == (0, 0, 1, 0, 1, 4, "RRD")
    said = {}
    for r in convrepair.repaired(turns, made).orderBy("conv_id", "position").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text[:8], r.edit))
    assert said[1] == [("user", "Hi.", "K"), ("assistant", "Yes.", "K")] and said[None] == [("user", "A?", "K"), ("assistant", "B!\v", "K")]
    assert said[4][0][0] == "user" and said[4][1][0] == "assistant" and said[4][1][2] == "R" and 2 not in said and 3 not in said
    assert convrepair.plans(turns.limit(0)).count() == 0 and convrepair.repaired(turns.limit(0), made.limit(0)).count() == 0


def plain_negatives(rows, every, positives, negatives):
    rows = [(i, y, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, y, v in rows]
    out = []
    for i, y, v in rows:
        if i % every:
            continue
        scores = [(-int(v @ w), j, z) for j, z, w in rows if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scores if x[2] == y)[:positives]:
            fit = sorted(x for x in scores if x[2] != y and -30 * s <= -100 * x[0] <= -90 * s)[:negatives]
            out += [(i, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many lists, pieces, blocks and groups
        for name, value in {"PIECE": 16, "BLOCK": 2, "GROUP_ROWS": 32, "PROBES": 1}.items():
            monkeypatch.setattr(hardneg, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(k, int(rng.integers(0, 4)), (centres[k % 6] * (1 if small else 0.2) + rng.normal(size=8) * 0.3).tolist()) for k in range(300)]
    rows += [(300 + k, k % 4, [0.5] * 8) for k in range(60)] + [(1000, 1, [1.0, 2.0]), (1001, 1, [1.0, 1.0]), (1002, 2, [1.0, 0.0]), (2000, 9, [1e7, 3e7, 0.0]), (2001, 9, [3e7, 1e7, 1.0]), (2002, 8, [2e7, 1e6, 0.0])]
    odd = [(5, None, [1.0] * 8), (10, 1, None), (20, 1, [float("nan")] * 8), (30, 1, [float("inf")] * 8), (40, 1, [None] * 8), (None, 1, [1.0] * 8), (50, 1, []), (60, 1, [1e30] * 8)]
    table = spark.createDataFrame([(*r, "u", 1) for r in [*rows, rows[20], *odd]], "vec_id long, label int, embedding array<double>, uid string, `list` int")
    got = hardneg.hard_negatives(table, every=20)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, 20, 5, 10)
    assert len(want) > 200 and sorted(tuple(r) for r in got.collect()) == want
    assert hardneg.hard_negatives(table.limit(0)).count() == 0


def test_lists_are_skipped(spark):
    """Bounds hold for every member, and some lists lie outside of what an anchor needs."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * np.concatenate([rng.normal(size=(100, 8)) * 0.05 + c for c in rng.normal(size=(10, 8)) * 2])).astype(np.int64)
    c = hardneg.kmeans(x, 10)
    at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    radius = np.array([np.sqrt(((x[at == k] - c[k]) ** 2).sum(1)).max(initial=0) for k in range(len(c))])
    lists = hardneg.Lists({8: c}, {8: 0}, radius)
    low, high = lists.bounds(x[:50])
    scores = x[:50] @ x.T
    assert (low[:, at] <= scores).all() and (scores <= high[:, at]).all()
    fifth = np.sort(scores, 1)[:, -5:-4]
    allowed, _ = hardneg._allowed(lists, x[:50], np.full((50, 1), hardneg.LOWEST), np.full((50, 1), hardneg.HIGHEST), fifth)
    assert allowed[np.arange(50), at[:50]].all() and allowed.mean() < 0.5


def test_archives(spark, tmp_path):
    text = "body " * 40
    rows = [(k, f"http://x.example/{k}", text + str(k % 3)) for k in range(9)] + [(20, "http://x.example/20", "short")] * 3 + [(21, None, None), (None, "u", text + "0"), (30, "a b\r\n", "é" * 80), (30, "a b\r\n", "é" * 80)]
    tricky = text + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n"
    rows += [(40, "t", tricky), (41, "t", tricky), (42, "z", "y" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, target string, payload string").selectExpr("page_id", "target", "cast(coalesce(payload, '') as binary) as payload", "1 as copies", "'d' as digest", "2 as `a b`")
    path = str(tmp_path / "archive")
    warc.write_archives(pages.repartition(3), path)
    got = warc.resolved(warc.read_archives(spark, path)).collect()
    first = {}
    for i, _, t in rows:
        t = t or ""
        if len(t.encode()) >= 100 and i is not None:
            first[t] = min(first.get(t, i), i)
    seen, want = {}, []
    for i, _, t in rows:
        t = t or ""
        again = t in first and (i != first[t] or seen.setdefault(t, 0) > 0)
        if t in first and i == first[t]:
            seen[t] = seen.get(t, 0) + 1
        want.append((i, "revisit" if again else "response", len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), first[t] if again else None, t.encode()))
    key = lambda r: repr(r[:5])
    assert sorted(((r.page_id, r.record_type, r.n_bytes, r.digest, r.original_page, bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    assert len({r.record_id for r in got}) == len(got) == len(rows)
    files = glob.glob(f"{path}/part-*")
    held = b"".join(gzip.open(f).read() for f in files)
    assert held.count(b"WARC-Type: revisit") == sum(w[1] == "revisit" for w in want) and held.count(text.encode() + b"0") == 1
    assert {r.target for r in got if r.page_id == 30} == {"a%20b%0D%0A"}

    again = str(tmp_path / "again")
    warc.deduplicated(spark, path, again, "2025-05-05T00:00:00Z")
    new = warc.resolved(warc.read_archives(spark, again)).collect()
    pick = lambda r: (r.page_id, r.record_type, r.digest, r.original_page)
    assert sorted(map(repr, map(pick, new))) == sorted(map(repr, map(pick, got)))
    assert {r.date for r in new} == {"2025-05-05T00:00:00Z"} and not {r.record_id for r in new} & {r.record_id for r in got}

    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_damaged_archives_are_noticed():
    whole = warc._member(warc.record(1, "urn:uuid:1", "response", "t", "d", "0", b"x" * 300, None, None))
    assert [b[-3:] for _, b in warc.records_of(whole + warc.SEPARATOR)] == [b"xxx"]
    with pytest.raises(Exception):  # noqa: B017  inside a member zlib says it, after it the reader
        list(warc.records_of(whole[:-30]))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records_of(gzip.decompress(whole)[:-100]))


def test_queries_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, 0, None, None), (None, None, "user", "A."), (1, 0, None, None), (9, 3, "user", "")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {1, None, 9} and got[9].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    spark.createDataFrame([(None, None, None), (1, "u", None), (1, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op13_warc_revisits(spark, str(tmp_path)).collect()
    assert len(got) == 3 and {(r.payload_bytes, r.record_type) for r in got} == {(0, "response")}


def test_op3_runs_cover_every_window_start():
    """Also where equal grams tie, as in texts of one word said over and over."""
    r = np.random.default_rng(5)
    texts = [b"the " * 300, b" On" * 70 + b" the" * 200 + b" of it" * 90, b"a" * 900, b"ab" * 300 + b"ba" * 300, bytes(r.integers(97, 99, 2000).astype(np.uint8)), b"".join(r.choice([b" x", b" yy", b" zzz"]) * int(r.integers(1, 150)) for _ in range(30))]
    for text in texts:
        at, first, last = repeats.runs(np.frombuffer(text, np.uint8), 400)
        n = len(text) - 399
        got = [(s, a) for a, f, l in zip(at.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(f, l + 1)]
        assert [s for s, _ in got] == list(range(n)) and all(s <= a <= s + 400 - repeats.GRAM for s, a in got)
        offsets = {}
        for s, a in got:  # equal windows have their gram at the same place
            assert offsets.setdefault(text[s : s + 400], a - s) == a - s


def test_op3_finds_repeats_between_words_said_over_and_over(spark):
    both = " the" * 130 + " cat and the dog" + " of it" * 60
    data = [(1, "left " + " On" * 40 + both + " one end of " * 3), (2, " no" * 500 + both + " another" * 90), (3, " the" * 104)]
    want, data_ = [], [(i, t.encode()) for i, t in data]
    counts = {}
    for _, b in data_:
        for s in range(len(b) - 399):
            counts[b[s : s + 400]] = counts.get(b[s : s + 400], 0) + 1
    for i, b in data_:
        gone = set()
        for s in range(len(b) - 399):
            if counts[b[s : s + 400]] > 1:
                gone.update(range(s, s + 400))
        want.append((i, len(b), len(gone)))
    got = repeats.digest(repeats.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"))).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed) for x in got) == want
