"""WARC archives: pages written as records in segments, and read back by reassembling the segments."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import shared_path, table

#: Bytes of a block that one record holds, of a chunk of the transfer coding, records in one archive file.
SEGMENT, CHUNK, FILE_RECORDS = 8192, 4096, 2000
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = "kind string, record string, origin string, segment int, total bigint, page string, digest string, refers string, block binary"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """Without the two line ends that close a record: the writer adds them."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def chunked(body: bytes) -> bytes:
    parts = [f"{len(body[i : i + CHUNK]):x}\r\n".encode() + body[i : i + CHUNK] + CRLF for i in range(0, len(body), CHUNK)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes | None:
    """The body of chunked framing; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        try:
            size = int(data[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        if not size:
            return b"".join(out) if data[end + 2 :] == CRLF else None
        chunk = data[end + 2 : end + 2 + size]
        if len(chunk) < size or data[end + 2 + size : end + 4 + size] != CRLF:
            return None
        out.append(chunk)
        at = end + 4 + size


def _written(name) -> str | None:
    """An id as a header can hold it: line ends, white space and % percent-encoded."""
    return None if name is None else quote(str(name), safe="!#$&'()*+,/:;=?@[]~")


def _read(name: str | None) -> str | None:
    return None if name is None else unquote(name)


def records_of(row: int, page, url: str | None, digest: str, refers, payload: bytes, refers_url: str | None = None) -> list[bytes]:
    """One page's records: a revisit, or a response in segments of SEGMENT bytes."""
    name = lambda k: f"<urn:sha1:{hashlib.sha1(f'{row}:{page}:{k}'.encode()).hexdigest()}>"
    uri = quote(url or "", safe="%!#$&'()*+,/:;=?@[]~") or None  # what a header cannot hold is percent-encoded
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Page-ID", _written(page)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if payload is None or refers is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload or b'')}\r\n\r\n".encode()
        refer = [("WARC-Refers-To-Target-URI", quote(refers_url or "", safe="%!#$&'()*+,/:;=?@[]~") or None), ("WARC-Refers-To-Date", DATE), ("WARC-Refers-To-Page-ID", _written(refers))]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), *common, ("WARC-Profile", PROFILE), *refer], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *common], block)]
    cuts = range(0, len(block), SEGMENT)
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *common, ("WARC-Segment-Number", 1)], block[:SEGMENT])]
    for k, at in enumerate(cuts[1:], 2):
        total = len(block) if k == len(cuts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name(1)), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], block[at : at + SEGMENT]))
    return out


def opened(data: bytes) -> bytes:
    """The archive without its gzip coding (any number of members); of a truncated or broken one what can be read."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out) if out or data[:2] == b"\x1f\x8b" else data


def parsed(data: bytes) -> Iterator[tuple]:
    """The records of an uncompressed archive, as in _FIELDS.

    What cannot be read as a record ends the archive: it comes back as one record of kind ``broken``, and so
    does a record that is cut short.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = dict(line.partition(": ")[::2] for line in data[at : max(at, end)].decode("utf-8", "replace").split("\r\n")[1:])
        size, number, total = (head.get(k, "") for k in ("Content-Length", "WARC-Segment-Number", "WARC-Segment-Total-Length"))
        name, kind = head.get("WARC-Record-ID"), head.get("WARC-Type")
        block = data[end + 4 : end + 4 + int(size)] if end >= 0 and size.isdecimal() else b""
        if not (size.isdecimal() and name and kind and len(block) == int(size)):
            yield ("broken", name, name, None, None, _read(head.get("WARC-Page-ID")), None, None, b"")
            return
        yield (
            kind, name, head.get("WARC-Segment-Origin-ID", name), int(number) if number.isdecimal() else None, int(total) if total.isdecimal() else None,
            _read(head.get("WARC-Page-ID")), head.get("WARC-Payload-Digest"), _read(head.get("WARC-Refers-To-Page-ID")), block,
        )
        at = end + 4 + int(size) + 4


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Write archives, gzip files of records, of ``pages`` to the folder ``path``.

    Of rows with equal payloads of ``least_bytes`` or more, those with the smallest id are responses and
    others revisits of it; smaller payloads are all responses. A null html is an empty payload, and a null id
    counts as the largest; rows that repeat are written as often; other columns aren't read. Only ids and
    digests meet by digest, however many pages share one; the pages themselves meet them by id and digest.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    narrow = rows.groupBy("page", "sha1").agg(F.first(F.length("payload")).alias("n"), F.min("url").alias("url"))
    first = narrow.where((F.col("n") >= least_bytes) & F.col("page").isNotNull()).groupBy("sha1").agg(F.min(F.struct("page", "url")).alias("f")).select("sha1", F.col("f.page").alias("first"), F.col("f.url").alias("first_url"))
    refers = narrow.join(first, "sha1").where(~F.col("page").eqNullSafe(F.col("first"))).select(F.col("page").alias("_page"), F.col("sha1").alias("_sha1"), "first", "first_url")
    marked = rows.join(refers, F.col("page").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left").select("page", "url", "sha1", "payload", "first", "first_url")
    marked = marked.withColumn("row", F.monotonically_increasing_id())

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for page, url, sha1, payload, first, first_url, row in zip(*batch.columns):
                found = records_of(row.as_py(), page.as_py(), url.as_py(), base32_sha1(sha1.as_py()), first.as_py(), payload.as_py(), first_url.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["value"])

    # A record ends with two line ends: what the text writer puts after each row.
    text = marked.mapInArrow(batches, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page string, payload binary, payload_bytes, digest, record_type, refers string, valid) of the archives in ``path``.

    Continuations meet their first segment by its record id, are ordered by number and joined; valid says
    that the numbers have no gap, the joined length is the total given by the last, the chunked framing is
    whole and the digest is that of the payload. A revisit has no payload; its length and digest are those
    given. Only records in segments are shuffled. A record that is broken or cut short comes back as invalid, of
    type ``broken``, and ends its archive; an empty folder gives no rows. Fields this reader doesn't know are
    ignored.
    """

    def records(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for content in batch.column(0):
                data = content.as_py()
                found = list(parsed(opened(data)))
                for i in range(0, len(found), 256):
                    kinds = [pa.string()] * 3 + [pa.int32(), pa.int64()] + [pa.string()] * 3 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i : i + 256]), kinds)], names=[f.split()[0] for f in _FIELDS.split(", ")])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, _FIELDS)
    parts = found.where("segment is not null").groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.col("kind"))).alias("kind"), F.max("page").alias("page"), F.max("digest").alias("digest"), F.max("refers").alias("refers"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"), F.sum(F.length("block")).alias("length"),
        F.max("segment").alias("last"), F.count_distinct("segment").alias("distinct"), F.count("*").alias("n"),
    )
    whole = (F.col("total") == F.col("length")) & (F.col("last") == F.col("n")) & (F.col("distinct") == F.col("n")) & F.col("kind").isNotNull()
    joined = parts.select("kind", "page", "digest", "refers", F.transform("parts", lambda p: p["block"]).alias("blocks"), F.coalesce(whole, F.lit(False)).alias("whole"))
    single = found.where("segment is null").select("kind", "page", "digest", "refers", F.array("block").alias("blocks"), (F.col("kind") != "broken").alias("whole"))

    def decoded(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            out = []
            for kind, page, digest, refers, blocks, whole in zip(*(c.to_pylist() for c in batch.columns)):
                head, _, body = b"".join(blocks).partition(b"\r\n\r\n")
                fields = {k: v for k, _, v in (line.partition(": ") for line in head.decode("latin-1").split("\r\n")[1:])}
                payload = body
                if fields.get("Transfer-Encoding") == "chunked":
                    payload = unchunked(body)
                    whole, payload = whole and payload is not None, payload or b""
                own = digest.removeprefix("sha1:") if digest else None
                if kind == "broken":
                    out.append((page, None, None, None, kind, None, False))
                elif kind == "revisit":
                    out.append((page, None, int(fields.get("Content-Length", 0)), own, kind, refers, whole))
                else:
                    sha1 = base32_sha1(hashlib.sha1(payload).hexdigest())
                    out.append((page, payload, len(payload), sha1, kind, refers, whole and sha1 == own))
            kinds = [pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page", "payload", "payload_bytes", "digest", "record_type", "refers", "valid"])

    return single.unionByName(joined).mapInArrow(decoded, "page string, payload binary, payload_bytes bigint, digest string, record_type string, refers string, valid boolean")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """The pages as written archives give them back, as the contract of this query asks."""
    path = shared_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select(
        F.col("page").cast("bigint").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers").cast("bigint").alias("refers_to"), "valid"
    )


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * g + 1, 5))::BIGINT >> (15 - 5 * k)) & 31)::INT + 1, 1), '' ORDER BY g, k) AS digest
      FROM f, range(8) a(g), range(4) b(k) GROUP BY h)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS valid
FROM p JOIN f USING (h) JOIN d USING (h)
"""
