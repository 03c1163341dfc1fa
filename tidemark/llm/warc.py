r"""WARC archives of pages, with revisits resolved and each payload stored once.

Writing: headers (page, address, payload digest, size) go first, without payloads. They are shuffled by digest
with partial aggregates; equal payloads of ``LEAST`` bytes or more have one original, the record with the
smallest page id, and headers that repeat it become revisit records, which carry no payload. Originals are one
aggregate by digest, so copies meet in the tasks that read them and a payload is shuffled once, however frequent
it is. Nothing joins payloads.

Archives are ordinary Spark output: the text writer commits them, every record is a gzip member of its own, and
the line separator is an empty member, which readers of ``.warc.gz`` pass over. Record ids, dates and digests are
fresh and depend on the record alone, so a repeated task writes the same bytes.

Reading: a file is one row of at most ``FILE_RECORDS`` records; it is inflated as a stream and cut by the
lengths in the headers, so nothing inside a payload can be taken for a record. Digests are computed from what was
read and compared with the stored ones. ``resolved`` joins revisits to the records they refer to. ``deduplicated``
does all this again for archives from elsewhere.

Defined results: null html: empty payload; null address: no target; a null page id counts as the largest and is
left out of the header; repeated rows: one original, the others refer to it (payloads under ``LEAST`` bytes:
all stored); ties in page id: the smallest address, nulls first; an empty table: an archive without records;
other columns are ignored. Control characters and blanks of an address are
percent-encoded in headers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import discard, staged

LEAST = 100
FILE_RECORDS = 8192
LEVEL = 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, record_id string, record_type string, target string, date string, digest string, n_bytes long, refers_to string, payload binary"


def _member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: An empty gzip member.
SEPARATOR = _member(b"")


def _escaped(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, record_id: str, kind: str, target: str | None, date: str, digest: str, payload: bytes, refers: str | None, refers_target: str | None) -> bytes:
    """A record's bytes, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"\r\n" if kind == "revisit" else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    head += [("WARC-Target-URI", _escaped(target))] if target is not None else []
    head += [("WARC-Page-ID", str(page_id))] if page_id is not None else []
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers}>")]
        head += [("WARC-Refers-To-Target-URI", _escaped(refers_target))] if refers_target is not None else []
        head += [("WARC-Refers-To-Date", date)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head), "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "record_id", "record_type", "target", "date", "digest", "payload", "refers_to", "refers_target")
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            rows = zip(*(part.column(c).to_pylist() for c in names), strict=True)
            yield pa.record_batch([pa.array([_member(record(*r[:6], r[6] or b"", *r[7:])) for r in rows], pa.binary())], names=["record"])


def _uri(*parts: Column | str) -> Column:
    """A record id of what identifies a record."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def _order_fields() -> list[Column]:
    return [F.col("page_id").isNull().alias("missing"), F.col("page_id").alias("page_id"), F.col("target").alias("target")]


def planned(pages: DataFrame, date: str, least: int = LEAST) -> DataFrame:
    """Records to write: originals with their payload, revisits with what they refer to.

    ``pages`` has page_id, target and payload.
    """
    pages = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    small = F.when(F.col("n") < least, F.col("payload"))
    headers = pages.select("page_id", "target", "digest", "n", small.alias("payload"), F.spark_partition_id().alias("part"))
    headers = staged(headers.groupBy("page_id", "target", "digest", "n", "payload", "part").agg(F.count(F.lit(1)).cast("int").alias("copies")), "headers")

    large = headers.where(F.col("n") >= least)
    shared = large.groupBy("digest").agg(F.min(F.struct(*_order_fields(), "part")).alias("first"), F.sum("copies").alias("all")).where(F.col("all") > 1)
    shared = shared.select(F.col("digest").alias("d"), "first")
    at = F.struct(*_order_fields(), "part")
    left = F.col("copies") - F.when(at == F.col("first"), 1).otherwise(0)
    repeats = large.join(shared, F.col("digest") == F.col("d")).withColumn("left", left).where("left > 0")
    repeats = repeats.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("left"))))
    original = [F.col("first.page_id"), F.col("first.target"), F.col("digest")]
    none = F.lit(None).cast("string")
    revisits = repeats.select(
        "page_id", _uri("revisit", F.col("page_id"), F.col("target"), F.col("digest"), F.col("part"), F.col("k"), F.lit(date)).alias("record_id"), F.lit("revisit").alias("record_type"),
        "target", F.lit(date).alias("date"), "digest", F.lit(None).cast("binary").alias("payload"), _uri("response", *original, F.lit(date)).alias("refers_to"), F.col("first.target").alias("refers_target"),
    )

    firsts = pages.where(F.col("n") >= least).groupBy("digest").agg(F.min(F.struct(*_order_fields(), "payload")).alias("first"))
    firsts = firsts.select(F.col("first.page_id").alias("page_id"), F.col("first.target").alias("target"), "digest", F.col("first.payload").alias("payload"))
    firsts = firsts.withColumn("record_id", _uri("response", F.col("page_id"), F.col("target"), F.col("digest"), F.lit(date)))
    short = headers.where(F.col("n") < least).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    short = short.withColumn("record_id", _uri("short", F.col("page_id"), F.col("target"), F.col("digest"), F.col("part"), F.col("k"), F.lit(date)))
    same = ["page_id", "record_id", F.lit("response").alias("record_type"), "target", F.lit(date).alias("date"), "digest", "payload", none.alias("refers_to"), none.alias("refers_target")]
    out = firsts.select(*same).unionByName(short.select(*same)).unionByName(revisits)
    out.headers = headers
    return out


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Write ``pages`` (page_id, target, payload) as ``.warc.gz`` files below ``path``; one record a row."""
    records = planned(pages, date, least)
    packed = records.mapInArrow(_packed, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = packed.write.mode("overwrite").option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", FILE_RECORDS).text(path)
    discard(records.headers)


def inflated(data: bytes, step: int = 1 << 13) -> Iterator[bytes]:
    """Pieces of a file of gzip members, one after the other; plain bytes pass. What a step reads beyond a member is
    read again for the next, so steps are about a record long."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        one, end = zlib.decompressobj(31), at
        while not one.eof:
            if end >= len(view) and not one.unconsumed_tail:
                raise ValueError("an archive ends inside a gzip member")
            take = view[end : end + step]
            yield one.decompress(take)
            end += len(take)
        at = end - len(one.unused_data)


class Stream:
    """Bytes of pieces that come one by one."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def _more(self) -> bool:
        if self.at > 1 << 20:
            del self.held[: self.at]
            self.at = 0
        for piece in self.pieces:
            if piece:
                self.held += piece
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is passed over; None at the end."""
        start = self.at
        while (found := self.held.find(mark, max(self.at, start))) < 0:
            start = max(self.at, len(self.held) - len(mark))
            base = self.at
            if not self._more():
                if self.held[self.at :].strip():
                    raise ValueError("an archive ends inside a record's header")
                return None
            start -= base - self.at
        out = bytes(self.held[self.at : found])
        self.at = found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        out = bytes(memoryview(self.held)[self.at : self.at + n])
        self.at += n
        return out


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of the records of a file, compressed or not."""
    stream = Stream(inflated(data))
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, block


def _read(payloads: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORDS.split(", "))])
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for fields, block in records_of(content.as_py()):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    stored = fields.get("warc-block-digest")
                    if stored and stored.startswith("sha256:") and stored[7:] != hashlib.sha256(block).hexdigest():
                        raise ValueError(f"the block of {fields['warc-record-id']} is damaged")
                    digest, n, payload = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        n, found = len(payload), hashlib.sha256(payload).hexdigest()
                        if stored and digest and digest != found and fields["warc-payload-digest"].startswith("sha256:"):
                            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                        digest = found
                    page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to", "").strip("<>") or None
                    rows.append((int(page) if page else None, fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), digest, n, refers, payload if payloads else None))
                    held += len(payload or b"") if payloads else 0
                    if len(rows) >= 1024 or held >= 16 << 20:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return work


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the files below ``path``; digests and sizes are those of the bytes read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_read(payloads), RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload, size and page of what they refer to; null where the original is missing."""
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("o"), F.col("page_id").alias("o_page"), F.col("digest").alias("o_digest"), F.col("n_bytes").alias("o_bytes"), F.col("payload").alias("o_payload"))
    visits = records.where("record_type = 'revisit'").join(originals, (F.col("refers_to") == F.col("o")) & (F.col("digest") == F.col("o_digest")), "left")
    visits = visits.select("page_id", "record_id", "record_type", "target", "date", "digest", F.col("o_bytes").alias("n_bytes"), "refers_to", F.col("o_payload").alias("payload"), F.col("o_page").alias("original_page"))
    return records.where("record_type = 'response'").withColumn("original_page", F.lit(None).cast("long")).unionByName(visits)


def deduplicated(spark: SparkSession, source: str, path: str, date: str, least: int = LEAST) -> None:
    """Write the records of the archives below ``source`` anew, revisits resolved, payloads once, headers fresh."""
    found = resolved(read_archives(spark, source)).where("payload is not null")
    write_archives(found.select("page_id", "target", "payload"), path, date, least)
