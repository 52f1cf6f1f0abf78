"""WARC archives: write pages as records, read archives back, reassemble segments.

Writing: a page is an HTTP response in chunked transfer framing. Among records with equal payloads of at
least ``least`` bytes the smallest page_id is the response, the others are revisits that refer to it. A
block longer than ``segment`` bytes is cut into a first record and continuation records, which may
lie in any archive. Every record is a gzip member of its own, so a reader can start at any record.

Archives are written by Spark's text writer, so they go to any file system with Spark's commit protocol: its
lines are runs of whole members of about ``RUN`` bytes, its line separator is an empty member, and an archive has
``RUNS`` lines at most. So archives are bounded in bytes (64 MB), however large the pages are.

Reading: archives of this or another writer are unpacked and parsed by Content-Length piece by piece; records that are
no responses, resources or revisits are passed over. Records in one piece are decoded at once, segments are
grouped by origin identifier, ordered by number, held against the total length, and then decoded.

Cases: null html is an empty payload; repeated rows are records each for themselves (every row with the
group's smallest page_id is a response); a null page_id is a response only if its whole group has none;
an empty table writes an archive without records and gives no rows."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEGMENT, CHUNK, RUN, RUNS = 32_768, 8_192, 1 << 20, 64
_DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """Payload of chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0].strip(), 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + n


def decode_http(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return dechunk(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records_of(row: str, page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, segment: int = SEGMENT) -> list[bytes]:
    """Records of one page, without the empty line that ends a record."""
    name = f"<urn:tessera:{row}>"
    head = [f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Target-URI: {(url or 'about:blank').replace(chr(13), '').replace(chr(10), '')}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

    def record(kind: str, ident: str, more: list[str], block: bytes) -> bytes:
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", *more, f"Content-Length: {len(block)}", "", ""]
        return "\r\n".join(lines).encode() + block

    if revisit:
        more = [*head, f"WARC-Refers-To: <urn:tessera:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "Content-Type: application/http; msgtype=response"]
        return [record("revisit", name, more, b"HTTP/1.1 200 OK\r\n\r\n")]
    block = http + chunked(payload)
    more = [*head, "Content-Type: application/http; msgtype=response"]
    if len(block) <= segment:
        return [record("response", name, more, block)]
    cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record("response", name, [*more, "WARC-Segment-Number: 1"], cuts[0])]
    for n, cut in enumerate(cuts[1:], 2):
        own = [f"WARC-Date: {_DATE}", f"WARC-Segment-Origin-ID: {name}", f"WARC-Segment-Number: {n}"]
        if n == len(cuts):
            own.append(f"WARC-Segment-Total-Length: {len(block)}")
        out.append(record("continuation", f"<urn:tessera:{row}:{n}>", own, cut))
    return out


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member; the same bytes for the same data."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def unpacked(packed: bytes, step: int = 1 << 18, most: int = 1 << 22) -> Iterator[bytes]:
    """Bytes of a gzip file of any number of members, at most ``most`` at once."""
    part = None
    for at in range(0, len(packed), step):
        piece = packed[at : at + step]
        while piece:
            part = part or zlib.decompressobj(31)
            yield part.decompress(piece, most)
            piece = part.unconsumed_tail or part.unused_data
            if part.eof:
                part = None
    if part is not None:
        yield part.flush()
        if not part.eof:
            raise ValueError("the archive is cut off")


def parse(source: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive, given whole or in pieces; one record and one
    piece are held at a time."""
    pieces, held, at = iter([source] if isinstance(source, bytes) else source), bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        held.extend(piece)
        at = 0
        return True

    while True:
        while len(held) - at < 5 and more():
            pass
        if at >= len(held):
            return
        if held[at : at + 2] == b"\r\n":
            at += 2
            continue
        if held[at : at + 5] != b"WARC/":
            raise ValueError("no record where one should begin")
        while held.find(b"\r\n\r\n", at) < 0:
            if not more():
                raise ValueError("a record's header is cut off")
        size = held.find(b"\r\n\r\n", at) - at
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in held[at : at + size].decode("utf-8", "replace").split("\r\n")[1:])}
        n = int(fields["content-length"])
        while len(held) - at < size + 4 + n:
            if not more():
                raise ValueError(f"{fields.get('warc-record-id')}: the record is cut off")
        yield fields, bytes(held[at + size + 4 : at + size + 4 + n])
        at += size + 4 + n


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, run_bytes: int = RUN, runs: int = RUNS) -> None:
    """Write pages (page_id, url, html) as archives under ``path``."""
    spark = pages.sparkSession
    common.ship(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    keyed = rows.withColumn("_digest", F.unhex(F.sha1("payload")))
    # the digest alone is grouped; payloads never are, and only payloads met again need to know their first
    same = common.stored(keyed.where(F.octet_length("payload") >= least).groupBy("_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_digest", "first"), "warc-same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = bytearray()
        for batch in batches:
            ids, urls, payloads, firsts, known = (batch.column(i).to_pylist() for i in range(5))
            for page, url, payload, first, grouped in zip(ids, urls, payloads, firsts, known, strict=True):
                revisit = bool(grouped) and page != first
                for record in records_of(uuid.uuid4().hex, page, url, payload, first, revisit, segment):
                    line += member(record + b"\r\n\r\n")
                    if len(line) >= run_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([bytes(line)], pa.binary())], names=["value"])
                        line.clear()
        if line:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(line)], pa.binary())], names=["value"])

    digests = keyed.select("page_id", "url", "payload", "_digest")
    marked = digests.join(same.withColumn("_known", F.lit(True)), "_digest", "left").select("page_id", "url", "payload", "first", F.coalesce("_known", F.lit(False)).alias("known"))
    records = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    nothing = member(b"").decode("latin-1")
    records.write.option("encoding", "ISO-8859-1").option("lineSep", nothing).option("maxRecordsPerFile", runs).text(path)


_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, origin string, number int, total long, block binary"


def read(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    with common.tidy(spark) as keep:
        return keep(common.stored(_read(spark, path), "warc-read"))


def _read(spark, path: str) -> DataFrame:
    common.ship(spark)

    def of(fields: dict[str, str], payload: bytes) -> tuple:
        found = digest(payload)
        if fields.get("warc-payload-digest", f"sha1:{found}") != f"sha1:{found}":
            raise ValueError(f"{fields['warc-record-id']}: the payload's digest differs")
        return (int(fields["x-page-id"]) if fields.get("x-page-id") else None, len(payload), found, "response", None, None, None, None, None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(unpacked(blob.as_py())):
                    if fields["warc-type"] not in ("response", "resource", "revisit", "continuation"):
                        continue
                    if fields["warc-type"] == "revisit":
                        page = int(fields["x-page-id"]) if fields.get("x-page-id") else None
                        refers = fields.get("warc-refers-to", "").rpartition(":")[2].rstrip(">")
                        rows.append((page, None, fields.get("warc-payload-digest", "").removeprefix("sha1:"), "revisit", int(refers) if refers.isdecimal() else None, None, None, None, None))
                    elif "warc-segment-number" in fields:
                        page = int(fields["x-page-id"]) if fields.get("x-page-id") else None
                        total = fields.get("warc-segment-total-length")
                        rows.append((page, None, fields.get("warc-payload-digest"), "segment", None, fields.get("warc-segment-origin-id", fields["warc-record-id"]), int(fields["warc-segment-number"]), int(total) if total else None, block))
                        held += len(block)
                    else:
                        rows.append(of(fields, decode_http(block) if fields["warc-type"] == "response" else block))
                    if len(rows) >= 2000 or held >= 1 << 23:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["number"])
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError(f"{r['origin']}: segments are missing or their length is wrong")
                rows.append(of({"warc-record-id": r["origin"], "warc-payload-digest": parts[0]["payload_digest"], "x-page-id": "" if parts[0]["page_id"] is None else str(parts[0]["page_id"])}, decode_http(block)))
            yield batch_of(rows)

    parsed = common.stored(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, _FIELDS), "warc-parsed")
    # a group is one page's segments
    grouped = parsed.where("record_type = 'segment'").groupBy("origin").agg(F.collect_list(F.struct("page_id", "payload_digest", "number", "total", "block")).alias("parts"))
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = parsed.where("record_type = 'response'").select(*shown).unionByName(grouped.mapInArrow(whole, _FIELDS).select(*shown))
    responses = common.stored(responses, "warc-responses")
    revisits = parsed.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to")
    sizes = responses.join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi").groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    return responses.unionByName(revisits.join(sizes, "payload_digest", "left").select(*shown))


def op6_warc_segments(spark, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "warc")
    with common.tidy(spark) as keep:
        write(common.tables(spark, sf_dir, "pages"), path)
        found = keep(read(spark, path))
    common.remove(spark, path)
    return found


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h),
n AS (SELECT d.page_id, d.payload_bytes, d.h, f.first,
      list_transform(range(8), lambda g: list_sum(list_transform(range(5), lambda i:
        (strpos('0123456789abcdef', substr(d.h, (g * 5 + i + 1)::INT, 1)) - 1) * (1 << (4 * (4 - i))::INT)))::BIGINT) AS w
      FROM d JOIN f ON d.h = f.h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(w, lambda v: array_to_string(list_transform(range(4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v >> (5 * (3 - k))::INT) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM n"""
