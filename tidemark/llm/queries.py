"""The queries of this subpackage, as ``__spark_entry__`` registers them, and their SQL where there is some."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, convrepair, decontam, embdup, hardneg, linedup, neardup, pii, repeats, sharding, toxicity, warc
from tidemark.session import discard, expiring, shared_folder, staged, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, key="tidemark-1")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("__tm_size"))
    ask = {"keys": ["doc_id", "text_crc32"], "size": F.col("__tm_size"), "map_path": sharding.new_path(spark)}
    sharding.shard_records(docs, 15, **ask)  # the map's first version, as if the last shard came later
    placed = sharding.shard_records(docs, 16, **ask)  # its second, edited: a sixteenth moves
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_conversations(turns.unionByName(extra)).mapInArrow(chat.read_back, chat.READ_BACK)


def _bpe_digest(machine: bpe.Codec, ids: bytes) -> list:
    return [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(machine.decode(ids)).hexdigest()]


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=_bpe_digest, digest_schema="n_tokens long, ids_sha256 string, decoded_sha256 string", keep=True)


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.coalesce("text", F.lit(""))
    return linedup.without_repeats(docs, short=True).select("doc_id", "n_lines", "n_repeats", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


def op10_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = embdup.near_vectors(table(spark, sf_dir, "embeddings"))
    return got.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by crc32(conv_id:turn) % 20: a turn dropped, emptied, cut, repeated or said by another."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", either("role").alias("role"), either("text").alias("text"))
    rows = rows.withColumn("fault", F.crc32(F.concat_ws(":", either("conv_id"), either("turn"))) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def _turns_digest(batches):
    """(conv_id, repaired_sha256) of repaired turns that come in order."""
    import pyarrow as pa

    now, out = None, []
    for b in batches:
        for conv, position, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
            said = f"{role}:{text}".encode("utf-8", "replace")
            if position == 0:
                if now is not None:
                    out.append((now[0], now[1].hexdigest()))
                now = (conv, hashlib.sha256(said))
            else:
                now[1].update(b"\n" + said)
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
        out.clear()
    if now is not None:
        yield pa.record_batch([pa.array([now[0]], pa.int64()), pa.array([now[1].hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    turns = damaged(conversations)
    made = staged(convrepair.plans(turns), "repairs")
    digests = convrepair.repaired(turns, made).mapInArrow(_turns_digest, "conv_id long, repaired_sha256 string")
    out = conversations.select("conv_id").distinct().alias("c")
    out = out.join(made.alias("p"), F.expr("c.conv_id <=> p.conv_id"), "left").join(digests.alias("d"), F.expr("c.conv_id <=> d.conv_id"), "left")
    counts = [F.coalesce(F.col(f"p.{n}"), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("c.conv_id", *counts, F.coalesce("p.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


def op13_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("target"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    path = expiring(spark, f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}")
    warc.write_archives(pages, path)
    records = staged(warc.read_archives(spark, path, payloads=False), "records")
    discard(path)
    got = warc.resolved(records)
    return got.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("original_page").alias("refers_to"))


QUERIES = {"op1_pii_surrogates": op1_pii_surrogates, "op9_line_edit_join": op9_line_edit_join, "op8_toxicity_grammar": op8_toxicity_grammar, "op3_repeated_bytes": op3_repeated_bytes, "op4_decontamination": op4_decontamination, "op10_pstable_vectors": op10_pstable_vectors, "op5_hyperminhash": op5_hyperminhash, "op2_virtual_slots": op2_virtual_slots, "op6_chat_format": op6_chat_format, "op7_byte_bpe": op7_byte_bpe, "op11_conversation_repair": op11_conversation_repair, "op12_hard_negatives": op12_hard_negatives, "op13_warc_revisits": op13_warc_revisits}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_SHINGLES = "CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)] END"

SQL: dict[str, str] = {
    "op5_hyperminhash": f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS} AS w FROM documents), d AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, p.b FROM r JOIN p ON r.seen = p.a),
m AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, t.doc_id = component_id AS kept FROM t LEFT JOIN n USING (doc_id) JOIN m ON m.id = t.doc_id""",
    "op6_chat_format": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(CASE WHEN role = 'assistant' THEN 7 ELSE 13 END + 1 + length(role) + length(regexp_replace(text, '([<\\[])(\\\\*)(/?(?:s>|INST\\]))', '\\1\\2\\\\\\3', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
    "op4_decontamination": f"""
WITH d AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 5),
b AS (SELECT DISTINCT item_id, unnest({_SHINGLES}) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, item_shingles, count(*)::DOUBLE / item_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= 0.8 * item_shingles""",
    "op10_pstable_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON r.seen = p.a),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id""",
    "op11_conversation_repair": """
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
f AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(place, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), [k::BIGINT FOR k IN range(8)]), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS fault FROM c),
t AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS said FROM t),
g AS (SELECT *, left(role, 1) AS i, left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) || left(role, 1) AS pair,
 CASE WHEN said = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS bad FROM o),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE bad = 1) AS blank, count(*) FILTER (WHERE bad = 2) AS duplicate, count(*) FILTER (WHERE bad = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
arc(g, x, h) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins AS (SELECT g, g AS h, 0 AS c, '' AS l, [] AS made FROM (VALUES (0), (1), (2), (3)) v(g) UNION ALL SELECT g, h, 5, 'I', [CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM arc WHERE x <> 's'
 UNION ALL SELECT a.g, b.h, 10, 'II', [CASE a.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END, CASE b.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM arc a JOIN arc b ON a.h = b.g WHERE a.x <> 's' AND b.x <> 's'),
step AS (SELECT conv_id, k, v.g, v.g AS h, 2 AS c, 'D' AS l, [] AS made FROM g, (VALUES (0), (1), (2), (3)) v(g)
 UNION ALL SELECT conv_id, k, a.g, h, CASE WHEN bad = 3 THEN 5 ELSE 0 END, 'K', [role || ':' || text] FROM g JOIN arc a ON a.x = i WHERE bad IN (0, 3)
 UNION ALL SELECT conv_id, k, a.g, h, CASE WHEN bad = 3 THEN 6 ELSE 1 END, 'R', [CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM g JOIN arc a ON a.x <> 's' WHERE bad IN (0, 3)),
p(conv_id, k, way) AS (SELECT conv_id, 0, {'cost': 0, 'audit': '', 'state': 0, 'made': []::VARCHAR[]} FROM s
 UNION ALL SELECT conv_id, k, min(way) FROM (SELECT p.conv_id, step.k::INT AS k, step.h, {'cost': p.way.cost + ins.c + step.c, 'audit': p.way.audit || ins.l || step.l, 'state': step.h, 'made': list_concat(list_concat(p.way.made, ins.made), step.made)} AS way
  FROM p JOIN ins ON ins.g = p.way.state JOIN step ON step.conv_id IS NOT DISTINCT FROM p.conv_id AND step.k = p.k + 1 AND step.g = ins.h) GROUP BY conv_id, k, h),
e AS (SELECT p.conv_id, min({'cost': p.way.cost + ins.c, 'audit': p.way.audit || ins.l, 'made': list_concat(p.way.made, ins.made)}) AS best FROM p JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.n = p.k JOIN ins ON ins.g = p.way.state WHERE ins.h IN (0, 3) GROUP BY p.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op12_hard_negatives": """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10""",
    "op13_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
o AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM o""",
}
