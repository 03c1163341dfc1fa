"""Every operator against a plain brute-force version, and the defined edge cases."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontam, embdup, linedup, neardup, pii, repeats, sharding, shingles, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, `a b` int"


def docs_of(spark, texts):
    """Documents with clashing extra columns and ids in order (null ids and repeated rows: test_edges.py)."""
    rows = [(k, t, "en", "s", len(t or ""), "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rng_words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# sharding ------------------------------------------------------------------------------------------------

def test_sharding_law(spark):
    d = docs_of(spark, [None, "", "x" * 5000] + [f"text {k % 7}" * (k % 50) for k in range(800)])
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    got = sharding.shard_records(d, 4, ["doc_id"], size, keep=["doc_id"]).toPandas()
    assert len(got) == 803
    held = got.groupby("shard")["size"].sum()
    assert held.max() - held.min() <= 600
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sharding.shard_records(d.limit(0), 4, ["doc_id"], size).count() == 0


def test_rebalance_moves_little(spark):
    stats = pd.DataFrame({"vslot": range(4096), "slot_rows": 1, "slot_bytes": [(k * 7919) % 1000 + 1 for k in range(4096)]})
    first = sharding.build_map(stats, 16)
    grown = sharding.rebalance(first, stats, 17)
    moved = first.merge(grown, on="vslot").query("shard_x != shard_y")
    assert (moved.shard_y == 16).all() and grown.version.iloc[0] == 2
    held = grown.groupby("shard").slot_bytes.sum()
    assert held.max() < 1.1 * held.mean()


# repeats -------------------------------------------------------------------------------------------------

def test_repeats_against_brute_force(spark):
    r = random.Random(5)
    piece = "".join(r.choice("abcdé ") for _ in range(150))
    texts = [None, "", "z" * 300, piece, piece[:70] + "XY" + piece[60:], "q" + piece[20:110], piece * 2, "tiny"]
    texts += ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(400))) + piece[k : k + 64 + k] + "end" for k in range(12)]
    length = 60
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    want = {}
    for n, b in enumerate(raw):
        mark = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mark[k : k + length] = [True] * length
        spans = sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))
        want[n] = (len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest())
    got = repeats.digest(repeats.remove_repeats(docs_of(spark, texts), length)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert repeats.remove_repeats(docs_of(spark, texts).limit(0), length).count() == 0


# decontamination -----------------------------------------------------------------------------------------

def test_contained_against_brute_force(spark):
    items = [(k, " ".join(rng_words(100 + k, n))) for k, n in enumerate([40, 17, 60, 5, 3])] + [(9, None), (10, "")]
    texts = [None, "", " ".join(rng_words(1, 3000))]
    for k, t in items[:5]:
        w = t.split()
        texts += [" ".join(rng_words(k, 700)) + " " + t.upper() + " " + " ".join(rng_words(k + 50, 300)), " ".join(w[: len(w) // 2])]
        texts.append(" ".join([*w[:-1], "changed", *rng_words(k, 50)]))
    bench = spark.createDataFrame(items, "item_id long, text string")

    def grams(t, n):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    want = set()
    for d, t in enumerate(texts):
        for k, item in items:
            n = min(5, len((item or "").split()))
            own = grams(item, n) if n else set()
            if own and len(own & grams(t, n)) >= 0.8 * len(own):
                want.add((d, k, len(own & grams(t, n))))
    d = docs_of(spark, texts)
    got = {(r.doc_id, r.item_id, r.shared) for r in decontam.contained(d, bench).collect()}
    assert got == want and len(want) >= 5
    clean = decontam.decontaminated(d, bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {x[0] for x in want} and clean.columns == d.columns
    assert decontam.contained(d, bench.limit(0)).count() == 0 == decontam.contained(d.limit(0), bench).count()


# near duplicates -----------------------------------------------------------------------------------------

def brute_components(n, linked):
    root = list(range(n))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(k) for k in range(n)]


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        k = r.randrange(len(words))
        words[k : k + r.choice([0, 1, 1])] = r.choice([[], [f"e{r.randrange(10**6)}"], [f"e{r.randrange(5)}"]])
    return words


@pytest.mark.parametrize("small_bucket", [8, 2])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small_bucket):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small_bucket)
    r = random.Random(11)
    base = rng_words(3, 150)
    texts = [None, "", "  \n", "a b", "A  b", "a b c d e", " ".join(rng_words(8, 20000, 9000))]
    texts += [" ".join(edited(r, base, r.randrange(8))) for _ in range(120)] + [" ".join(base)] * 5
    for k in range(15):
        w = rng_words(50 + k, r.randrange(6, 60))
        texts += [" ".join(w), " ".join(edited(r, w, 1)).upper(), " ".join(w)]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = brute_components(len(sets), linked)
    got = {x.id: x for x in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[k].component for k in range(len(sets))] == want
    assert [got[k].n_shingles for k in range(len(sets))] == [len(s) for s in sets]
    empty = docs_of(spark, texts).limit(0)
    assert neardup.near_duplicates(empty).count() == 0


def test_sketch_registers_and_estimate():
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 1 << 63, 4000, dtype=np.int64).astype(np.uint64) << np.uint64(1))
    y = np.union1d(x[:3000], np.unique(r.integers(0, 1 << 63, 1000, dtype=np.int64).astype(np.uint64) << np.uint64(1)))
    got, on = neardup.estimate(neardup.sketch(x), neardup.sketch(y), (len(x), len(y)))
    assert on == neardup.REGISTERS and abs(got - 0.6) < 0.12
    assert len(neardup.band_keys(neardup.sketch(np.array([], np.uint64)))) == 0
    assert len(neardup.band_keys(neardup.sketch(np.array([5], np.uint64)))) == neardup.BANDS


# chat ----------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark, monkeypatch):
    r = random.Random(2)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\/INST]", "\n", "é漢😀", "<", "[", " ok "]
    rows = [(None, 1, "user", "n"), (5, None, "assistant", "first"), (5, 2, None, None), (5, 2, "assistant", ""), (5, 2, "a\\n\nb[INST]", "x"), (6, 1, "assistant", "y" * 100_000)]
    rows += [(k % 9 + 10, k, r.choice(["user", "assistant", "system"]), "".join(r.choice(bits) for _ in range(r.randrange(12)))) for k in range(300)]
    rows += rows[-3:]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    monkeypatch.setattr(chat, "PIECE_BYTES", 200)
    got = {x.conv_id: x for x in chat.format_conversations(turns).mapInArrow(chat.read_back, chat.READ_BACK).collect()}
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x[1:2]) + tuple((v is not None, v or "") for v in x[2:])
    by = {}
    for x in rows:
        by.setdefault(x[0], []).append(x)
    assert got.keys() == by.keys()
    for conv, own in by.items():
        own.sort(key=key)
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(said).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(turns.limit(0)).count() == 0


# tokens --------------------------------------------------------------------------------------------------

def test_bpe_like_tiktoken(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    machine = bpe.codec(path, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=machine.ranks.ranks, special_tokens={})
    r = random.Random(4)
    texts = [None, "", " ", "a" * 30_000, "".join(r.choice("ethanio") for _ in range(5000)), "漢字かな😀" * 50, "it's \n\n  x\t1234 <|endoftext|>"]
    texts += ["".join(r.choice("abcdefgh   \n\n\t'sTHEé漢😀01!?ü") for _ in range(r.randrange(80))) for _ in range(300)]
    got = bpe.encode(docs_of(spark, texts).withColumn("n_tokens", F.lit("clash")), path, public_tokenizers.PATTERN).collect()
    for x in got:
        ids = np.frombuffer(x.token_ids, "<u4").tolist()
        assert ids == plain.encode_ordinary(x.text or "") and x.n_tokens == len(ids)
        assert machine.decode(x.token_ids).decode() == (x.text or "") == "".join(machine.decode_text(ids))
    small = bpe.Codec(machine.ranks.ranks, public_tokenizers.PATTERN)
    bpe.MAX_STATES, was = 50, bpe.MAX_STATES
    try:  # tables that start again all the time change nothing
        assert all(np.frombuffer(small.encode(t or ""), "<u4").tolist() == plain.encode_ordinary(t or "") for t in texts[:60])
    finally:
        bpe.MAX_STATES = was


def test_utf8_stream_cuts_anywhere():
    data = "aé漢😀z".encode() + b"\xff\xc3" + "ü".encode() + b"\xe2\x82"
    want = data.decode("utf-8", "replace")
    for step in range(1, 6):
        s = bpe.Utf8Stream()
        assert "".join([s.feed(data[k : k + step]) for k in range(0, len(data), step)] + [s.close()]) == want


# toxicity ------------------------------------------------------------------------------------------------

def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(6)
    texts, labels = [None, ""], []
    for k in range(2, 1600):
        bad = r.random() < 0.2
        w = rng_words(k, 60, 3000) if False else ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(60)]
        if bad:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["zorkel", "zorkelish", "wumpfer", "wumpfig"])
        texts.append(" ".join(w))
        labels.append((k, 0, int(bad)))
    labels += [(None, None, 1), (3, 1, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs_of(spark, texts)
    grammar = toxicity.fit(d, table)
    assert any("zorkel".startswith(s) for s in grammar.stems) and any("wumpfer".startswith(s) for s in grammar.stems)
    got = {x.doc_id: x for x in toxicity.score(d, grammar).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    right = [got[k].predicted == y for k, _, y in labels if k is not None and y is not None and got[k].held]
    assert len(right) > 300 and np.mean(right) > 0.99 and got[0].predicted == got[1].predicted == 0
    assert toxicity.score(d.limit(0), grammar).count() == 0
    none = toxicity.fit(d, table.limit(0))
    assert not none.stems and toxicity.score(d, none).count() == len(texts)


def test_grammar_arcs():
    g = toxicity.Grammar({"idio": 5.0})
    plain, aimed, negated, reported = (g.features(t) for t in ("an idiot here", "you idiot", "you are not an idiot", "she said he is an idiot"))
    assert plain[1] and aimed[2] and negated[3] and reported[4]
    s = g.scores(np.array([plain, aimed, negated, reported, g.features("fine day")]))
    assert s[1] > s[0] > s[2] > s[4] and s[0] > s[3]


def test_composition_like_its_parts():
    r = random.Random(1)
    for _ in range(4000):
        symbols = [r.choice([0, 0, 0, 1, 2, 3, 4, 5]) for _ in range(r.randrange(9))]
        states, state = [0] * len(toxicity.PARTS), 0
        for symbol in symbols:
            x = symbol
            for k, part in enumerate(toxicity.PARTS):
                states[k], x = part[states[k], x]
            state = toxicity.CLAUSE[state << 3 | symbol]
        assert toxicity.FINAL[state] == toxicity.arc_of(tuple(states))
        # by the definition: the strongest reading of the clause's insults
        hits = [k for k, x in enumerate(symbols) if x == toxicity.INSULT]
        denied = lambda k: any(x == toxicity.NEGATION for x in symbols[max(0, k - toxicity.SCOPE) : k])
        if not hits:
            assert toxicity.FINAL[state][0] == 0
        elif all(denied(k) for k in hits):
            assert toxicity.FINAL[state][0] == 3
        elif any(not denied(k) and toxicity.NEGATION not in symbols[k:] for k in hits):
            assert toxicity.FINAL[state][0] == (4 if toxicity.REPORT in symbols else 2 if toxicity.TARGET in symbols else 1)


def test_grammar_words_and_sums():
    g = toxicity.Grammar({"idio": 5.0, "zor": 4.0})
    assert g.emit("idiotic") == (toxicity.INSULT, 5.0) and g.emit("zor")[0] == toxicity.INSULT and g.emit("zorro")[0] == toxicity.OTHER
    assert g.emit("killed")[0] == g.emit("kills")[0] == toxicity.THREAT and g.emit("skill")[0] == toxicity.OTHER
    once, often = (g.features("you idiot. " * n)[2] for n in (1, 9))
    assert abs(np.expm1(often) - 9 * np.expm1(once)) < 1e-9  # every clause counts
    assert g.features("you idiot, she said")[4] > 0 and g.features("an idiot, not")[3] > 0


# line dedup ----------------------------------------------------------------------------------------------

def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_machine_and_keys():
    r = random.Random(0)
    for _ in range(3000):
        a = "".join(r.choice("abcé😀") for _ in range(r.randrange(14)))
        b = "".join(r.choice("abc") if r.random() < 0.2 else c for c in a if r.random() > 0.1)
        d = levenshtein(a, b)
        for most in (1, 2, 3):
            assert linedup.within(a, b, most) == (d <= most)
            if d <= most and min(len(a), len(b)) > most:
                assert set(linedup.keys_of(a, most)) & set(linedup.keys_of(b, most))


def test_line_dedup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linedup, "CHUNK", 4)
    r = random.Random(9)
    lines = ["".join(r.choice("abcdefg é") for _ in range(r.randrange(10, 60))) for _ in range(40)]

    def near(x):
        x = list(x)
        for _ in range(r.randrange(4)):
            x[r.randrange(len(x))] = r.choice("abXY")
        return "".join(x)

    texts = [None, "", "\n", "x" * 60_000] + ["\n".join(near(r.choice(lines)) + r.choice(["", " ", "\r"]) for _ in range(r.randrange(8))) for _ in range(60)]
    where = [(d, k, s) for d, t in enumerate(texts) for k, s in linedup.lines_of(t)]
    linked = [(a, b) for a in range(len(where)) for b in range(a) if abs(len(where[a][2]) - len(where[b][2])) <= 2 and levenshtein(where[a][2], where[b][2]) <= 2]
    top = brute_components(len(where), linked)
    gone = {where[k][:2] for k in range(len(where)) if top[k] != k}
    d = docs_of(spark, texts)
    got = linedup.without_repeats(d).collect()
    for x in got:
        want = None if x.text is None and texts[x.doc_id] is None else "\n".join(s for k, s in enumerate((texts[x.doc_id] or "").split("\n")) if (x.doc_id, k) not in gone)
        assert x.text == want
        assert x.n_repeats == sum(g[0] == x.doc_id for g in gone)
    assert len(got) == len(texts) and len(gone) > 10
    assert linedup.without_repeats(d.limit(0)).count() == 0
    left = {x.doc_id: x.text for x in linedup.without_repeats(d, leave=0.0).collect()}
    assert left == dict(enumerate(texts))


def test_short_lines_repeat_where_equal(spark):
    from tidemark.llm import queries

    long = "a line of more than twenty-four characters"
    texts = ["Fin.\nAll rights reserved.\n" + long, " Fin. \nAll rights preserved.\n\n" + long, "Fin\n}\n\n}\n", "All rights reserved.\r\nx", None]
    d = docs_of(spark, texts)
    got = {x.doc_id: (x.text, x.n_repeats) for x in linedup.without_repeats(d, short=True).collect()}
    assert got == {0: (texts[0], 0), 1: ("All rights preserved.\n", 2), 2: ("Fin\n}\n\n", 1), 3: ("x", 1), 4: (None, 0)}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries, "table", lambda *_: d)
        assert {x.doc_id: x.n_repeats for x in queries.op9_line_edit_join(spark, "").collect()} == {k: n for k, (_, n) in got.items()}


# vectors -------------------------------------------------------------------------------------------------

def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embdup, "CHUNK", 8)
    r = np.random.default_rng(3)
    base = r.standard_normal((12, 16))
    rows = [(0, None, 1), (1, [0.0] * 16, 1), (2, [1.0, None, *[0.0] * 14], 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, 1), (5, base[0].tolist(), None), (6, [1.0, 2.0], 1), (7, [], 1)]
    for k in range(200):
        v = base[r.integers(12)] + 0.1 * r.standard_normal(16) * r.random()
        rows.append((8 + k, (v * r.choice([1.0, 1.0, 3.0, 1e-200, 1e200])).tolist(), int(r.integers(2))))
    rows += [(300 + k, rows[20][1], rows[20][2]) for k in range(5)]
    got = {x.id: x for x in embdup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}

    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and rows[a][2] == rows[b][2] is not None and units[a] @ units[b] >= 0.98]
    top = brute_components(len(rows), linked)
    count = np.bincount(np.array(linked).ravel(), minlength=len(rows))
    assert [(got[x[0]].n_links, got[x[0]].component) for x in rows] == [(count[k], rows[top[k]][0]) for k in range(len(rows))]


# personal data -------------------------------------------------------------------------------------------

def test_surrogates(spark):
    texts = [None, "", "no data here", "mail Ann.Lee@mail5.example.com or ANN.LEE@MAIL5.EXAMPLE.COM, call +1 (743) 555-3824 / +1 743 555 3824",
             "card 4539578763621486 and 4539-5787-6362-1486 bad 4539578763621487 ip 10.1.2.3 192.168.0.7 8.8.8.8", "Frau Müller met Herr Ivan Petrov and Frau Müller",
             "key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "г-н text Señora Иванова came", "ssn 123-45-6789"] + [f"ip 10.0.{k // 250}.{k % 250}" for k in range(500)]
    got = {x.doc_id: x for x in pii.with_surrogates(docs_of(spark, texts), "k").collect()}
    assert len(got) == len(texts) and got[0].text is None and got[1].text == "" and got[2].text == texts[2] and got[2].n_entities == 0
    a = re.fullmatch(r"mail (\S+) or (\S+), call (\+1 \(\d{3}\) \d{3}-\d{4}) / (\+1 \d{3} \d{3} \d{4})", got[3].text)
    assert a and a[1].upper() == a[2] and re.sub(r"\D", "", a[3]) == re.sub(r"\D", "", a[4]) and "Ann" not in a[1]
    c = re.fullmatch(r"card (\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4}) bad (\d{16}) ip (10\.\S+) (192\.168\.\S+) (\S+)", got[4].text)

    def luhn(x):
        return sum((v * 2 - 9 if v * 2 > 9 else v * 2) if k % 2 == 0 else v for k, v in enumerate(map(int, x))) % 10 == 0

    assert c and c[1] == c[2].replace("-", "") and luhn(c[1]) and not luhn(c[3]) and c[1] != c[3]
    n = re.fullmatch(r"Frau (\S+) met Herr (\S+ \S+) and Frau (\S+)", got[5].text)
    assert n and n[1] == n[3] != "Müller" and n[2].split()[0] in pii.GIVEN["m", "latin"]
    assert re.fullmatch(r"key [0-9a-f]{40}", got[6].text) and got[6].text != texts[6]
    assert re.search(r"Señora [А-Яа-я]+ came", got[7].text) and "Иванова" not in got[7].text
    made = [got[k].text for k in range(9, len(texts))]
    assert len(set(made)) == 500 and not set(made) & set(texts)  # distinct, and none a real one
    assert pii.with_surrogates(docs_of(spark, texts).limit(0), "k").count() == 0


def test_surrogates_of_people_and_numbers(spark):
    texts = ["John Smith called. Mr John Smith and Mr Smith met Smith's wife.", "Dr Jane Doe, Prof. Dr. Jane Doe and г-н Иванов", "call 555-123-4567 or +1 555 123 4567", "IBAN DE89370400440532013000 and DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, DE00370400440532013000", "Κυρία Παπαδοπούλου", "Mr Smith"]
    got = {x.doc_id: x.text for x in pii.with_surrogates(docs_of(spark, texts), "k").collect()}
    a = re.fullmatch(r"(\S+) (\S+) called. Mr (\S+) (\S+) and Mr (\S+) met (\S+)'s wife.", got[0])
    assert a and a[1] == a[3] in pii.GIVEN["m", "latin"] and a[2] == a[4] == a[5] == a[6] != "Smith" and got[5] == f"Mr {a[2]}"
    b = re.fullmatch(r"Dr (\S+) (\S+), Prof. Dr. (\S+) (\S+) and г-н ([А-Яа-я]+)", got[1])
    assert b and b[1] == b[3] in pii.GIVEN["n", "latin"] and b[2] == b[4] and b[5] != "Иванов"
    c = re.fullmatch(r"call (\d{3}-\d{3}-\d{4}) or \+1 (\d{3} \d{3} \d{4})", got[2])
    assert c and re.sub(r"\D", "", c[1]) == re.sub(r"\D", "", c[2]) != "5551234567"
    d = re.fullmatch(r"IBAN (\S+) and (\S+ \S+ \S+ \S+ \S+ \S+), (\S+), (\S+)", got[3])
    right = lambda x: int("".join(str(int(ch, 36)) for ch in x[4:] + x[:4])) % 97 == 1
    assert d and d[1] == d[2].replace(" ", "") and right(d[1]) and right(d[3]) and d[3].startswith("GB") and not right(d[4])
    assert re.fullmatch(r"Κυρία [Α-Ωα-ωά-ώ]+", got[4]) and "Παπαδοπούλου" not in got[4]


def test_surrogates_never_run_out(spark):
    n = 100_000
    made = pii.assign(spark.range(n).select(F.lit("family").alias("kind"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("canonical")), "k")
    assert made.count() == n == made.select("surrogate").distinct().count()


def test_shingle_sets():
    assert len(shingles.shingle_set(None)) == 0 == len(shingles.shingle_set(" \n"))
    assert (shingles.shingle_set("A b\tc d e f") == shingles.shingle_set("a B c D e F")).all()
    assert len(shingles.shingle_set("a b")) == 1 and len(shingles.shingle_set("a b c d e f")) == 2
    assert shingles.shingle_set("É")[0] != shingles.shingle_set("é")[0]
