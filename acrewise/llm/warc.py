"""Op 3, WARC archives with segment reassembly.

Writing: a page becomes an HTTP response with chunked transfer framing. A
block longer than ``SEGMENT`` is cut: the first part stays in the response
record (segment 1), the others are ``continuation`` records that name it by
``WARC-Segment-Origin-ID``; the last one carries the total length. Of pages
with equal payloads the one with the smallest id is stored, the others are
``revisit`` records that refer to it. Spark's text writer lays the records
down as gzipped files in the shared folder; as every record is bounded by the
segment size, so is every file.

Reading: files come in through Spark's ``binaryFile`` source. Records are cut
out by their declared lengths. Segmented records are grouped by origin
identifier wherever they lie, ordered by segment number, checked for gaps and
for the declared total length, and joined; then the HTTP header is split off
and the chunked framing decoded. Only segmented records are shuffled.

Defined cases: a null html is an empty payload; a null id is written without
an id, counts as larger than any other and comes back as null; of rows equal
in id, url and html one is a response and the others revisit it; a damaged
archive (bad framing, missing segment, wrong total or digest) raises
ValueError; an empty table gives an empty archive and result. Columns beyond
id, url and html are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrewise.llm.common import on_arrow, scratch, stored, table

MIN_BYTES = 0          # payloads shorter than this are never revisits
SEGMENT = 16_384       # bytes of a record's block
CHUNK = 4_096          # bytes of an HTTP chunk
RECORDS_PER_FILE = 1_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(repr((page_id, url, copy)).encode()).hexdigest())}>"


def framed(payload: bytes) -> bytes:
    parts = [payload[i:i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    """Decode chunked transfer framing (chunk extensions are skipped)."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size, at = int(body[at:end].split(b";")[0], 16), end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size line says")
        out.append(body[at:at + size])
        at += size + 2


def record(kind: str, block: bytes, **fields) -> bytes:
    """One WARC record, without the two line ends that close it."""
    head = {"WARC-Type": kind, "WARC-Date": DATE, **{k.replace("_", "-"): v for k, v in fields.items() if v is not None},
            "Content-Length": len(block)}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block


def quoted(url: str | None) -> str | None:
    """A url that cannot break the header line."""
    return None if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, copy, first_id, first_url) -> WARC records."""
    for b in batches:
        out = []
        for page, url, html, copy, first, first_url, found in zip(*(c.to_pylist() for c in b.columns)):
            payload, own = html or b"", record_id(page, url, copy)
            names = {"WARC_Record_ID": own, "WARC_Target_URI": quoted(url), "X_Page_ID": page, "WARC_Payload_Digest": "sha1:" + digest(payload)}
            if found and (first, first_url, 0) != (page, url, copy):
                out.append(record("revisit", HTTP, **names, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                                  WARC_Refers_To=record_id(first, first_url, 0)))
                continue
            block = HTTP + framed(payload)
            parts = [block[i:i + SEGMENT] for i in range(0, len(block), SEGMENT)]
            if len(parts) == 1:
                out.append(record("response", block, **names))
                continue
            out.append(record("response", parts[0], **names, WARC_Segment_Number=1))
            for n, part in enumerate(parts[1:], 2):
                out.append(record("continuation", part, WARC_Record_ID=f"{own[:-1]}-{n}>", WARC_Segment_Origin_ID=own, WARC_Segment_Number=n,
                                  WARC_Segment_Total_Length=len(block) if n == len(parts) else None))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_archive(pages: DataFrame, path: str, folder: str, min_bytes: int = MIN_BYTES) -> None:
    """Archive (page_id, url, html) under ``path``; ``folder`` is scratch."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html).alias("sha"))
    same = rows.where(F.length("html") >= min_bytes).groupBy("page_id", "url", "sha").agg(F.count(F.lit(1)).alias("n"))
    groups = same.groupBy("sha").agg(F.sum("n").alias("total"), F.min(F.struct(
        F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")).where("total > 1").drop("total")
    # the rows whose payload is not theirs alone; narrow, and stored so that
    # its size is known when the join with the pages is planned
    shared = stored(same.join(groups, "sha"), folder, "shared")
    key = [rows[c].eqNullSafe(shared[c]) for c in ("page_id", "url", "sha")]
    tagged = rows.join(shared, key, "left").select(rows["page_id"], rows["url"], rows["sha"], "html", "n", "first")
    once = tagged.where("n IS NULL OR n = 1").withColumn("copy", F.lit(0))
    more = (tagged.where("n > 1").dropDuplicates(["page_id", "url", "sha"])
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))))
    records = once.unionByName(more).select("page_id", "url", "html", "copy", F.col("first.page_id").alias("first_id"),
                                            F.col("first.url").alias("first_url"), F.col("first").isNotNull().alias("found"))
    (on_arrow(records, compose, "value binary").select(F.col("value").cast("string")).write
     .option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


RECORD = "kind string, id string, origin string, segment int, total long, page_id long, refers_to string, digest string, block binary"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files -> records, by declared lengths."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
    for b in batches:
        for content in b.column(0):
            data, at, rows = zlib.decompressobj(47).decompress(content.as_py()), 0, []
            while at < len(data):
                end = data.find(b"\r\n\r\n", at)
                if not data.startswith(b"WARC/", at) or end < 0:
                    raise ValueError("not the start of a WARC record")
                f = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
                block = data[end + 4:end + 4 + int(f["Content-Length"])]
                at = end + 4 + len(block)
                if data[at:at + 4] != b"\r\n\r\n":
                    raise ValueError("record does not end where its length says")
                at += 4
                number = lambda k: int(f[k]) if k in f else None
                rows.append((f["WARC-Type"], f["WARC-Record-ID"], f.get("WARC-Segment-Origin-ID"), number("WARC-Segment-Number"),
                             number("WARC-Segment-Total-Length"), number("X-Page-ID"), f.get("WARC-Refers-To"),
                             f.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, block))
                if len(rows) == 500:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records (their segments in order) -> payloads."""
    for b in batches:
        out = []
        for kind, rid, page, refers, said, total, numbers, blocks in zip(*(c.to_pylist() for c in b.columns)):
            block = b"".join(blocks)
            if numbers != list(range(1, len(numbers) + 1)) or (total if len(numbers) > 1 else len(block)) != len(block):
                raise ValueError(f"{rid}: segments {numbers}, {len(block)} bytes of {total}")
            head, _, body = block.partition(b"\r\n\r\n")
            payload = None
            if kind == "response":
                payload = unframed(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body
                if said != digest(payload):
                    raise ValueError(f"{rid}: payload does not match its digest")
            out.append((kind, rid, page, refers, said, payload))
        cols = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()))],
                                         ["kind", "id", "page_id", "refers_to", "digest", "payload"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """kind, id, page_id, refers_to (a record id), digest, payload (null for
    revisits) of every reassembled record under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    records = on_arrow(files, cut, RECORD)
    whole = records.where("segment IS NULL").select(
        "kind", "id", "page_id", "refers_to", "digest", F.octet_length("block").cast("long").alias("total"),
        F.array(F.lit(1)).alias("numbers"), F.array("block").alias("blocks"))
    head = F.col("kind") != "continuation"
    parts = (records.where("segment IS NOT NULL").groupBy(F.coalesce("origin", "id").alias("id"))
             .agg(F.max(F.when(head, F.col("kind"))).alias("kind"), F.max(F.when(head, F.col("page_id"))).alias("page_id"),
                  F.max(F.when(head, F.col("digest"))).alias("digest"), F.max("total").alias("total"),
                  F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"))
             .select("kind", "id", "page_id", F.lit(None).cast("string").alias("refers_to"), "digest", "total",
                     F.col("s.segment").alias("numbers"), F.col("s.block").alias("blocks")))
    return on_arrow(whole.unionByName(parts).select("kind", "id", "page_id", "refers_to", "digest", "total", "numbers", "blocks"), decode,
                    "kind string, id string, page_id long, refers_to string, digest string, payload binary")


def op3(spark, sf_dir):
    """Archive all pages, read the archive back, resolve the revisits."""
    folder = scratch(spark)
    write_archive(table(spark, sf_dir, "pages"), f"{folder}/warc", folder)
    got = read_archive(spark, f"{folder}/warc")
    back = stored(got.select("kind", "id", "page_id", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes")), folder, "read")
    full = back.where("kind = 'response'")
    visits = back.where("kind = 'revisit'").drop("payload_bytes", "digest").join(
        full.select(F.col("id").alias("refers_to"), F.col("page_id").alias("first"), "payload_bytes", "digest"), "refers_to", "left")
    cols = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type")]
    return full.select(*cols, F.lit(None).cast("long").alias("refers_to")).unionByName(
        visits.select(*cols, F.col("first").alias("refers_to")))


# base32 of the SHA-1: eight groups of 20 bits, four letters each.
SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url) AS k,
  first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url) AS f FROM p)
SELECT page_id, octet_length(b) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + (i // 4) * 5 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)),
    lambda x, y: x || y) AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to
FROM r"""
