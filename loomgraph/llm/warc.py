"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

Archives are rows of a table (archive, records, image), so that Spark's committer writes them and any file system holds them; an
image's bytes are a whole .warc.zst file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import by_key, counted, discard, hot_keys, table, work_path

#: Pages that the dictionary is trained on, about, and how much of each (records are always whole); its bytes at most; bytes of records
#: after which an archive is closed.
SAMPLE, SAMPLE_CHARS, DICTIONARY, ARCHIVE = 200, 20_000, 32_768, 8_000_000
#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, records long, image binary"
RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, refers_to_record string"
#: Repeated payloads whose digests are broadcast, at about 100 bytes; more are joined by digest, very frequent ones apart.
REPEATED = 300_000


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, number: int) -> str:
    """number tells apart rows of one page id, or of none."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{number}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, number: int = 0, refers_to_number: int = 0) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    heads = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, number)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
    ]
    if url is not None:
        heads.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page is not None:
        heads.append(f"Page-ID: {page}")
    if revisit:
        heads += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_to_number)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(heads).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The record's fields; ValueError where a head, a length or a digest is wrong.

    Reads what record() writes: responses and revisits whose HTTP head has a Content-Length, without a transfer coding, and no WARC
    head twice; responses have a payload digest in SHA-1, revisits a Refers-To-Page-ID and no payload. Other valid records (warcinfo,
    request, metadata, chunked responses, repeated WARC-Concurrent-To) raise ValueError, too.
    """
    top, gap, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    heads = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in heads:
            raise ValueError(f"a damaged head: {line!r}")
        heads[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(heads):
        raise ValueError(f"heads are missing: {sorted(missing)}")
    size = int(heads["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length isn't Content-Length")
    block = rest[:size]
    if "sha1:" + digest32(block) != heads.get("warc-block-digest", "sha1:" + digest32(block)):
        raise ValueError("the block's digest is wrong")
    http, gap, payload = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    if not gap or not found:
        raise ValueError("a damaged HTTP head")
    revisit = heads["warc-type"] == "revisit"
    if not revisit and (int(found[1]) != len(payload) or heads.get("warc-payload-digest") != "sha1:" + digest32(payload)):
        raise ValueError("the payload's length or digest is wrong")
    if revisit and ("refers-to-page-id" not in heads or payload):
        raise ValueError("a damaged revisit record")
    return {
        "page_id": int(heads["page-id"]) if "page-id" in heads else None,
        "url": heads.get("warc-target-uri"),
        "payload_bytes": int(found[1]),
        "payload_digest": heads["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": heads["warc-type"],
        "refers_to": int(heads["refers-to-page-id"]) if revisit else None,
        "payload": None if revisit else payload,
        "record_id": heads["warc-record-id"],
        "refers_to_record": heads.get("warc-refers-to"),
    }


def _frame_length(data: memoryview) -> int:
    """A frame's length by the heads of its blocks."""
    at, last = zstandard.frame_header_size(data), 0
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * zstandard.get_frame_parameters(data).has_checksum


def read_archive(image: bytes) -> list[dict]:
    """The records of an image, each from a frame of its own, by the dictionary of the leading skippable frame."""
    if len(image) < 8:
        raise ValueError("an archive is cut off")
    magic, size = struct.unpack_from("<II", image)
    at, dictionary = 0, b""
    if magic == SKIPPABLE:
        at, dictionary = 8 + size, image[8 : 8 + size]
    if dictionary[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):  # it may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    view, out = memoryview(image), []
    while at < len(image):
        n = _frame_length(view[at:])
        if at + n > len(image):
            raise ValueError("a frame is cut off")
        out.append(parse_record(reader.decompress(view[at : at + n], max_output_size=1 << 31)))
        at += n
    return out


def train_dictionary(samples: list[bytes]) -> bytes:
    """Of few or no samples, their ends serve as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", sample: int = SAMPLE) -> None:
    """A record for each row, payload the html in UTF-8 (null: empty).

    Of equal payloads of at least min_bytes, the one with the largest id is a response, and the others revisit it; rows that share
    that largest id are all responses, and so are rows with null ids if there is no other. An empty table gives no archive. Every record
    has an id of its own, by the row's number in the table, which two reads of the same files give alike.

    Only digests are grouped, with partial sums. Those of repeated payloads are broadcast, up to REPEATED; beyond, pages are shuffled once
    by digest to meet them, and those of a very frequent payload stay where they are.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1(F.encode("html", "utf-8"))), "number": F.monotonically_increasing_id()})
    share = min(1.0, sample / max(1, pages.count()))
    chosen = rows.where(F.shiftrightunsigned(F.xxhash64("page_id", "digest"), 11) / float(1 << 53) < share)
    first = sorted(chosen.select("page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("html")).limit(4 * sample).collect(), key=str)
    dictionary = train_dictionary([record(r.page_id, r.url, r.html.encode("utf-8", "surrogatepass"), None, False, date) for r in first])
    same = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "number")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    same, n = counted(same.where("n > 1 and keeper.page_id is not null"), "payloads")
    keepers = same.select("digest", "keeper")
    marked = rows.join(F.broadcast(keepers), "digest", "left") if n <= REPEATED else by_key(rows, keepers, "digest", hot_keys(same, "digest", same.agg(F.sum("n")).first()[0]), "left")
    revisit = ~F.col("keeper.page_id").eqNullSafe(F.col("page_id"))
    marked = marked.select("page_id", "url", "html", "number", F.when(revisit, F.col("keeper.page_id")).alias("refers_to"), F.when(revisit, F.col("keeper.number")).alias("keeper"))

    def run(batches):
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True) if dictionary else zstandard.ZstdCompressor(level=3, write_checksum=True)
        head = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
        frames, held, seq = [head], 0, 0

        def row():
            name = f"part-{TaskContext.get().partitionId():06d}-{seq:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(frames) - 1], pa.int64()), pa.array([b"".join(frames)], pa.binary())], ["archive", "records", "image"])

        for b in batches:
            for page, url, html, number, refers_to, keeper in zip(*(c.to_pylist() for c in b.columns)):
                made = record(page, url, html.encode("utf-8", "surrogatepass"), refers_to, refers_to is not None, date, number, keeper)
                frames.append(coder.compress(made))
                held += len(made)
                if held >= ARCHIVE:
                    yield row()
                    frames, held, seq = [head], 0, seq + 1
        if len(frames) > 1:
            yield row()

    marked.mapInArrow(run, ARCHIVES).write.parquet(path)
    discard(same)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record below path; every head, length and digest is verified, and a damaged archive raises ValueError."""
    names = [x.split(" ")[0] for x in RESULT.split(", ")]

    def run(batches):
        for b in batches:
            for image in b.column(0):
                found = read_archive(image.as_py())
                if not payloads:
                    for r in found:
                        r["payload"] = None
                for i in range(0, len(found), 1000):
                    yield pa.RecordBatch.from_pylist(found[i : i + 1000], schema=pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]))))

    return spark.read.schema(ARCHIVES).parquet(path).select("image").mapInArrow(run, RESULT)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of 20 bytes: eight times five hexadecimal digits, each five giving four characters.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INT), 1)), '')"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN k USING (h)
"""
