"""WARC archives: records in segments with chunked transfer framing, and their reassembly.

A page becomes an HTTP response record. Its block is cut into segments of at most `segment_bytes`: the first
is the response record (WARC-Segment-Number 1), the others are continuation records that name it by
WARC-Segment-Origin-ID; the last carries WARC-Segment-Total-Length. Bodies use chunked transfer framing.
Records are gzip members of their own, as is usual; archives hold about `archive_bytes` of html each, and any gzip
reader reads them to their end (they are named part-*, as Spark's writer names files).

Reading groups segments by origin, orders them by number, checks that the numbers are gapless and that the
lengths add up to the total, decodes the chunked framing and checks the payload digest; a record that fails
raises ValueError.

Among rows with equal payloads of at least `min_bytes`, those of the largest page_id are responses (several,
if that row is repeated), the others revisit it; a null page_id is smaller than all others. Null html is an
empty payload, a null url is written as an empty target; an empty table gives no archives; other columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body) AS payload_bytes, unhex(sha1(body)) AS raw FROM p),
     bits AS (SELECT page_id, payload_bytes, raw,
                     array_to_string(list_transform(range(0, 32), lambda i:
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0b' || substr(CAST(CAST(raw AS BIT) AS VARCHAR), CAST(i * 5 + 1 AS INT), 5)) AS INT), 1)), '') AS payload_digest
              FROM d),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY raw) AS top FROM bits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""


def chunked(payload: bytes, size: int) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + n])
        at += n + 2


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def records(page: dict, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of a page: keys uid, page_id, url, html (bytes), refers_to (page id, or None), revisit."""
    key = hashlib.md5(f"{page['uid']}/{page['page_id']}".encode()).hexdigest()
    origin = f"<urn:uuid:{key[:8]}-{key[8:12]}-{key[12:16]}-{key[16:20]}-{key[20:]}>"
    uri = " ".join((page["url"] or "").split())
    common_fields = [("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", uri)]
    first = [("WARC-Payload-Digest", f"sha1:{digest(page['html'])}"), ("Page-Id", "" if page["page_id"] is None else page["page_id"]), ("Content-Type", "application/http; msgtype=response")]
    if page["revisit"]:
        refers = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-Id", page["refers_to"]), ("Payload-Length", len(page["html"]))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *common_fields, *first, *refers], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(page["html"], chunk_bytes)
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, cut in enumerate(cuts, 1):
        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", origin if k == 1 else f"<urn:continuation:{key}:{k}>"), *common_fields]
        fields += first if k == 1 else [("WARC-Segment-Origin-ID", origin)]
        if len(cuts) > 1:
            fields.append(("WARC-Segment-Number", k))
            if k == len(cuts):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(fields, cut)


def archive_of(members: list[bytes]) -> bytes:
    """Members in a row. A member ends in the highest byte of its size, which is zero below 16 MB; else an empty member ends the archive."""
    whole = b"".join(members)
    return whole if whole[-1:] == b"\0" else whole + gzip.compress(b"", mtime=0)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each gzip member that isn't empty."""
    at = 0
    view = memoryview(archive)
    while at < len(archive):
        z = zlib.decompressobj(31)
        data = z.decompress(view[at:]) + z.flush()
        if not z.eof:
            raise ValueError("cut archive")
        at = len(archive) - len(z.unused_data)
        if not data:
            continue
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(fields["content-length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError("wrong Content-Length")
        yield fields, rest[:n]


def payload(block: bytes) -> bytes:
    """The body of an HTTP response, without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def write(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = 16 << 10, chunk_bytes: int = 4 << 10, archive_bytes: int = 16 << 20) -> None:
    """Archives of all pages; html is shuffled once, by its digest, to meet the page that it may revisit."""
    common.tune(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    src = src.withColumn("uid", F.monotonically_increasing_id()).withColumn("sha", F.sha1("html"))
    tops = src.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("top"))
    # written first, so that the join of a very common payload may be split
    tops = common.staged(tops.withColumnRenamed("sha", "top_sha"), "tops")
    marked = src.join(tops, src["sha"] == tops["top_sha"], "left")
    marked = marked.withColumn("revisit", F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")))
    marked = marked.select("uid", "page_id", "url", "html", "revisit", F.when(F.col("revisit"), F.col("top")).alias("refers_to"))

    def archive(batches):
        held, size = [], 0
        for b in batches:
            for page in b.to_pylist():
                held += records(page, segment_bytes, chunk_bytes)
                size += len(page["html"])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"file": pa.array([archive_of(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"file": pa.array([archive_of(held)], pa.binary())})

    common.write_files(marked.mapInArrow(archive, "file binary"), path)


_FIELDS = "origin string, number int, total long, block binary, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _batch(rows: list[tuple], types=tuple(_TYPES), names=tuple(x.split()[0] for x in _FIELDS.split(", "))):
    cols = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=list(names))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: segments keep their block, whole records are decoded on the spot."""

    def read(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for f, block in parse(content.as_buffer().to_pybytes()):
                    number, origin = f.get("warc-segment-number"), f.get("warc-segment-origin-id", f["warc-record-id"])
                    total = f.get("warc-segment-total-length")
                    page, told = (int(f["page-id"]) if f.get("page-id") else None), f.get("warc-payload-digest", "").removeprefix("sha1:")
                    kind = f["warc-type"]
                    if number is not None:
                        rows.append((origin, int(number), total and int(total), block, page, None, told or None, kind if kind != "continuation" else None, None))
                    elif kind == "revisit":
                        rows.append((origin, None, None, None, page, int(f["payload-length"]), told, kind, int(f["refers-to-page-id"])))
                    else:
                        body = payload(block)
                        if digest(body) != told:
                            raise ValueError(f"digest of {origin}")
                        rows.append((origin, None, None, None, page, len(body), told, kind, None))
                    if len(rows) >= 2000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return common.read_files(spark, path).mapInArrow(read, _FIELDS)


def reassemble(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (of records that were in segments).

    `found` must be a written table. Only segments are shuffled, by origin; a group is one record.
    """
    whole = found.where("number IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.lit(None).cast("binary").alias("payload"))
    parts = found.where("number IS NOT NULL").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.max("page_id").alias("page_id"),
        F.max("payload_digest").alias("payload_digest"), F.max("record_type").alias("record_type"),
    )

    def decode(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if [p["number"] for p in r["parts"]] != list(range(1, len(r["parts"]) + 1)):
                    raise ValueError(f"missing segments of {r['origin']}")
                block = b"".join(p["block"] for p in r["parts"])
                if len(block) != r["total"]:
                    raise ValueError(f"length of {r['origin']}")
                body = payload(block)
                if digest(body) != r["payload_digest"]:
                    raise ValueError(f"digest of {r['origin']}")
                rows.append((r["page_id"], len(body), r["payload_digest"], r["record_type"], None, body))
            yield _batch(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"))

    return whole.union(parts.mapInArrow(decode, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"))


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark, "warc")
    write(common.read_table(spark, sf_dir, "pages"), path)
    found = common.staged(scan(spark, path), "records")
    common.tune(spark, 16)
    return reassemble(found).drop("payload")
