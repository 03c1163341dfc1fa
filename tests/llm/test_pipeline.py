"""The pipeline as a whole against its stages done plainly, one text at a time."""

import random
import re

import corpus_pipeline
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, levenshtein

from tidemark.llm import linedup
from tidemark.session import staged


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_against_plain_stages(spark, tmp_path):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randrange(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    boiler, leak = line(9), line(30)
    texts, toxic = [], []
    for k in range(260):
        lines = [line(r.randrange(8, 16)) for _ in range(4)]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                j = r.randrange(4)
                lines[j] = f"{line(3)} zorkel{r.choice(['', 'ish', 'ed'])} {lines[j]}"
        if k % 9 == 1:
            lines.insert(2, boiler[:-1] + r.choice("xyz"))
        if k % 50 == 3:
            lines[1] += " " + leak
        texts.append("\n".join(lines))
        toxic.append(int(bad))
    for k in (5, 6, 7):  # exact and near copies
        texts += [texts[k], texts[k] + " " + word()]
        toxic += [toxic[k]] * 2
    texts += [None, ""]
    toxic += [0, 0]
    n = len(texts)
    pd.DataFrame({"doc_id": range(n), "text": texts, "lang": "en", "source": "s", "n_chars": [len(t or "") for t in texts]}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": range(n), "quality": 1, "toxic": toxic}).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame({"item_id": [1], "text": [leak]}).to_parquet(tmp_path / "benchmark.parquet")

    docs = {k: t for k, t in enumerate(texts) if not toxic[k]}

    def firsts():
        ids = sorted(docs)
        sets = [grams(docs[d] or "") for d in ids]
        top = brute_components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
        return [d for k, d in enumerate(ids) if top[k] == k]

    whole = firsts()
    assert len(whole) < len(docs)
    docs = {d: docs[d] for d in whole}
    where = [(d, k, s) for d, t in docs.items() for k, s in linedup.lines_of(t)]
    top = brute_components(len(where), [(a, b) for a in range(len(where)) for b in range(a) if abs(len(where[a][2]) - len(where[b][2])) <= 2 and len(set(where[a][2]) ^ set(where[b][2])) <= 4 and levenshtein(where[a][2], where[b][2]) <= 2])
    gone = {where[k][:2] for k in range(len(where)) if top[k] != k}
    assert gone
    for d, t in docs.items():
        if t and any(g[0] == d for g in gone):
            cut = "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
            docs[d] = cut
    kept = firsts()
    want = [d for d in kept if len(grams(leak) & grams(docs[d] or "")) < 0.8 * len(grams(leak))]
    assert len(want) < len(kept)

    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == want
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d in want:
        assert got[d].text == docs[d] and np.frombuffer(got[d].token_ids, "<u4").tolist() == plain.encode_ordinary(docs[d] or "")


def test_line_stage_cuts_all_but_whole_copies(spark):
    r = random.Random(4)
    new = lambda n: [" ".join("".join(r.choice("abcdefghijklm") for _ in range(6)) for _ in range(8)) for _ in range(n)]
    first, block, others, tail = new(10), new(3), new(4), new(1)
    texts = [first, first[:6] + others, first[:6] + others, block * 4, [*first, *tail], None]
    texts = [t and "\n".join(t) for t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], schema)
    got = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    want = {0: first, 1: others, 3: block, 5: None}  # 2 and 4 are copies of 1, itself cut, and of 0
    want = {k: t and "\n".join(t) for k, t in want.items()}
    assert got == {k: (t, len(t or "")) for k, t in want.items()}


def test_no_line_goes_for_a_copy_that_goes(spark):
    """A line that a whole copy and a third document share stays in the third, once; every line that a kept document had stays."""
    r = random.Random(6)
    new = lambda n: [" ".join("".join(r.choice("abcdefghijklm") for _ in range(6)) for _ in range(8)) for _ in range(n)]
    first, third, only = new(30), new(30), new(1)
    texts = ["\n".join(x) for x in (first, first + only, third + only, third[:3] + new(20))]
    docs = spark.createDataFrame([(k + 1, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.text.split("\n") for x in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert sorted(got) == [1, 3, 4] and got[1] == first and got[3] == third + only and not set(got[4]) & set(third)
    held = [x for t in got.values() for x in t]
    assert len(held) == len(set(held)) and {x for t in texts for x in t.split("\n")} == set(held)


def test_rows_go_to_python_in_bounded_batches(spark, tmp_path):
    """A batch of long texts is bounded by bytes; a session's own limit stays, and which rows share a batch changes nothing."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(limit, None)
    said = [("word%d " % k) * 2_000 for k in range(4)]
    docs = staged(spark.range(3_000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, said)), (F.col("id") % 4 + 1).cast("int")).alias("text")).coalesce(1), "long")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    try:
        spark.conf.unset(limit)
        corpus_pipeline.add_tokens(spark, docs, str(tmp_path))
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(x.n for x in got) == 3_000 and max(x.size for x in got) < 6e6
        few = docs.where("doc_id < 8")
        whole = corpus_pipeline.add_tokens(spark, few, str(tmp_path)).orderBy("doc_id").collect()
        spark.conf.set(limit, "1k")
        assert corpus_pipeline.add_tokens(spark, few, str(tmp_path)).orderBy("doc_id").collect() == whole
        assert spark.conf.get(limit) == "1k"
    finally:
        spark.conf.unset(limit) if was is None else spark.conf.set(limit, was)
