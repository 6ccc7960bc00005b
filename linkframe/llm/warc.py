"""WARC archives under Zstandard: the dictionary in a leading skippable frame, then one frame per record.

An archive is a binary value of bounded size; a table of archives has columns archive_id and content.
Files that already are archives come in by ``spark.read.format("binaryFile")``.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Magic number of the skippable frame that holds the dictionary, and of a Zstandard frame. Fixed values of the format.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
REVISIT_LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, uri: str, rid: str, payload: bytes, digest: str, full: int, refers: str | None) -> bytes:
    """One record; a revisit has an empty block, and names the record it refers to."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {full}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {PROFILE}"]
    block = payload if refers is None else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive. Its dictionary is raw content: the start of its first records, bounded."""
    share = max(1, DICTIONARY_BYTES // 16)
    raw = b"".join(r[:share] for r in records[:16])[:DICTIONARY_BYTES]
    pack = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    stored = zstandard.ZstdCompressor(level=3).compress(raw)
    return struct.pack("<II", SKIPPABLE, len(stored)) + stored + b"".join(map(pack.compress, records))


def frame_size(data: memoryview, at: int) -> int:
    """The length of the Zstandard frame at ``at``, from its block headers."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError("no Zstandard frame where a record should start")
    flags = data[at + 4]
    single = flags >> 5 & 1
    end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if end > len(data):
            raise ValueError("a Zstandard frame runs past the end of its archive")
        if head & 1:
            end += 4 * (flags >> 2 & 1)
            if end > len(data):
                raise ValueError("a Zstandard frame runs past the end of its archive")
            return end - at


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, its version line, headers and length checked."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"a WARC header line without a name: {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"a WARC record lacks {name}")
    if not fields["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length says {size}, the record has {len(rest) - 4}")
    return fields, rest[:size]


def read(content: bytes):
    """Headers and block of every record of an archive, one frame each; the dictionary is optional."""
    data, at, words = memoryview(content), 0, None
    if len(data) >= 8 and (head := struct.unpack_from("<II", data))[0] == SKIPPABLE:
        at = 8 + head[1]
        if at > len(data):
            raise ValueError("the dictionary runs past the end of its archive")
        words = bytes(data[8:at])
        if words[:4] == struct.pack("<I", FRAME):
            words = zstandard.ZstdDecompressor().decompress(words)
        words = zstandard.ZstdCompressionDict(words)
    unpack = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("bytes that are no frame at the end of an archive")
        if 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        size = frame_size(data, at)
        with unpack.stream_reader(data[at : at + size]) as r:
            yield parse(r.read())
        at += size


def deduplicated(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """Add payload (null html: empty), digest and refers_to: of equal payloads of at least ``least`` bytes all but the
    largest page_id refer to that one.

    Rows with null page_id count as smallest. Rows that share the largest page_id are responses each.
    Counts per digest combine before they shuffle, and only digests that recur are joined back.
    """
    pages = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("full", F.length("payload"))
    same = pages.where(F.col("full") >= least).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1")
    return pages.join(same, "digest", "left").withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("latest")), None).otherwise(F.col("latest")))


def archives(pages: DataFrame, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of about ``size`` bytes of payload, as (archive_id, content). Input: what ``deduplicated`` returns; repeated rows are
    records each, a null url is empty, an empty table has no archive."""

    def run(batches):
        held, total = [], 0
        for part in pieces(batches):
            for row in part.to_pylist():
                rid = "urn:page:" + ("" if row["page_id"] is None else str(row["page_id"]))
                refers = None if row["refers_to"] is None else f"urn:page:{row['refers_to']}"
                uri = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
                held.append(record("response" if refers is None else "revisit", uri, rid, row["payload"], row["digest"], row["full"], refers))
                total += len(held[-1])
                if total >= size:
                    yield packed(held)
                    held, total = [], 0
        if held:
            yield packed(held)

    def packed(held: list[bytes]) -> pa.RecordBatch:
        content = archive(held)
        return pa.RecordBatch.from_pydict({"archive_id": [hashlib.sha1(content).hexdigest()], "content": [content]}, pa.schema([("archive_id", pa.string()), ("content", pa.binary())]))

    return pages.select("page_id", "url", "payload", "digest", "full", "refers_to").mapInArrow(run, "archive_id string, content binary")


RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])


def records(table: DataFrame, content: str = "content", blocks: bool = True) -> DataFrame:
    """A row per record of a table of archives, each response's digest and length checked against its block. Null or empty content has
    no records; a damaged archive raises ValueError."""

    def run(batches):
        for part in pieces(batches, 1):
            rows = []
            for fields, block in read(part.column(0)[0].as_py() or b""):
                digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                full = int(fields.get("x-payload-length", len(block)))
                if fields["warc-type"] == "response" and (digest and hashlib.sha1(block).hexdigest() != digest or full != len(block)):
                    raise ValueError(f"{fields['warc-record-id']}: the payload isn't what its digest and length say")
                refers = fields.get("warc-refers-to")
                rows.append({"record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"), "refers_to": refers and refers.strip("<>"), "payload_bytes": full, "payload_digest": digest, "block": block if blocks else None})
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    return table.select(content).mapInArrow(run, "record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string, block binary")


def page_records(found: DataFrame) -> DataFrame:
    """Records as rows per page."""
    page = lambda c: F.expr(f"try_cast(substring({c}, {len('urn:page:') + 1}) as bigint)")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
