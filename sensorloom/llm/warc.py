"""WARC archives of zstandard frames: one skippable frame with the dictionary, then one frame for each record.

Records are written by Spark's text writer, which commits whole files and puts bytes out as they are.
It ends every row with a separator; here that is an empty skippable frame, which decoders pass over.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import lookup, new_folder, small_batches, stored

#: fixed by the zstandard and WARC-zstd formats
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
RAW_DICTIONARY = b"\x37\xa4\x30\xec"
SEPARATOR = "P*M\x18\x00\x00\x00\x00"

#: fixed by the contract: shorter payloads are stored again and again
LEAST_REVISIT = 100

#: bounded sample that the dictionary is trained on, and its size
SAMPLE_PAGES = 400
SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: bytes of payload in an archive, about
FILE_BYTES = 8 << 20
#: payload that a task holds before it passes records on
HELD_BYTES = 2 << 20
DATE = "2024-01-01T00:00:00Z"


def trained(pages: DataFrame) -> bytes:
    """A dictionary for the pages, empty when they are too few to learn from.

    The sample is the ``SAMPLE_PAGES`` pages with the least hash; it bears on size only, never on content.
    """
    sample = pages.filter(F.length("html") > 0).select(F.substring(F.col("html"), 1, SAMPLE_BYTES).alias("html"), F.xxhash64("html").alias("h"))
    texts = [r["html"].encode() for r in sample.orderBy("h").limit(SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) > 16 else b""
    except zstandard.ZstdError:
        return b""


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One WARC record; line breaks inside a header value become blanks."""
    lines = ["WARC/1.1", *[f"{k}: {' '.join(v.split())}" for k, v in headers], f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a decoded record; raises ValueError where it breaks the format."""
    head, mark, body = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not mark or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line or no end of headers")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"header without a name: {line[:40]}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name} header")
    length = headers["content-length"]
    if not length.isdigit() or len(body) != int(length) + 4 or body[-4:] != b"\r\n\r\n":
        raise ValueError(f"content is not {length} bytes and two line ends")
    payload = body[:-4]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:]:
        raise ValueError("the block digest does not match")
    return headers, payload


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame, found from frame and block headers alone."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"archive ends inside a frame at byte {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            end = at + 8 + size
        elif magic == FRAME_MAGIC:
            end = at + zstandard.frame_header_size(data[at:at + 18])
            last = False
            while not last:
                if end + 3 > len(data):
                    raise ValueError(f"archive ends inside a frame at byte {at}")
                block = int.from_bytes(data[end:end + 3], "little")
                last, kind = bool(block & 1), block >> 1 & 3
                end += 3 + (1 if kind == 1 else block >> 3)
            end += 4 if data[at + 4] & 4 else 0
        else:
            raise ValueError(f"no frame at byte {at}")
        if end > len(data):
            raise ValueError(f"archive ends inside a frame at byte {at}")
        yield magic, at, end
        at = end


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """(offset, headers, payload, error) of every record of an archive.

    A damaged record has an error and no payload; where the frames themselves cannot be told apart any
    more, the rest of the archive is one such record.
    """
    decoder, at = zstandard.ZstdDecompressor(), 0
    try:
        for magic, at, end in frames(data):  # noqa: B007  at is the place of the error
            if magic == DICTIONARY_MAGIC and at == 0:
                body = data[8:end]
                if body[:4] == FRAME_MAGIC.to_bytes(4, "little"):
                    body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
                kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == RAW_DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))
            elif magic == FRAME_MAGIC:
                try:
                    headers, payload = parsed(decoder.decompressobj().decompress(data[at:end]))
                    yield at, headers, payload, None
                except (ValueError, zstandard.ZstdError) as wrong:
                    yield at, {}, b"", str(wrong)
    except (ValueError, zstandard.ZstdError) as wrong:
        yield at, {}, b"", str(wrong)


def page_roles(pages: DataFrame) -> DataFrame:
    """Every page with ``digest``, ``bytes`` and, for a repeated payload, ``refers_to``.

    Of equal payloads of at least 100 bytes the smallest page_id is the response. Rows that share that
    id are all responses, as are payloads of which no row has an id; nulls count as larger than any id.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    long_enough = F.col("bytes") >= LEAST_REVISIT
    firsts = stored(rows.filter(long_enough).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                    .filter("n > 1 AND first_id IS NOT NULL").drop("n"), "repeated-payloads")
    with_first = lookup(rows, firsts, ["digest"])
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return with_first.withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each page; a null html is an empty payload.

    A revisit keeps digest and length of the full payload in its headers and has no content.
    """
    dictionary = trained(pages)

    def frames_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_checksum=True, write_content_size=True)
        first = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary] if dictionary else []
        for batch in batches:
            out, held = first, 0
            first = []
            for row in range(batch.num_rows):
                page_id, url, payload, digest, size, refers_to = (batch.column(i)[row].as_py() for i in range(6))
                headers = [("WARC-Type", "response" if refers_to is None else "revisit"),
                           ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
                           *([("WARC-Target-URI", url)] if url else []),
                           ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
                if refers_to is not None:
                    headers.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
                body = payload if refers_to is None else b""
                headers.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}"))
                out.append(packer.compress(record(headers, body)))
                held += len(payload)
                if held > HELD_BYTES:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["frame"])
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], ["frame"])
    rows = page_roles(pages).select("page_id", "url", "payload", "digest", "bytes", "refers_to")
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    dealt = rows.repartition(-(-total // file_bytes) or 1, F.xxhash64("page_id", "digest"))
    with small_batches(pages.sparkSession):
        (dealt.mapInArrow(frames_of, "frame binary").select(F.col("frame").cast("string").alias("value"))
         .write.option("lineSep", SEPARATOR).text(folder))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, offset, headers, payload, error) of every record under ``folder``; ``error`` is null for sound records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
        names = ["path", "offset", "headers", "payload", "error"]

        def batch_of(rows):
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for at, headers, payload, error in records(content.as_py()):
                    rows.append((path.as_py(), at, list(headers.items()), payload, error))
                    held += len(payload)
                    if held > HELD_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, "path string, offset long, headers map<string,string>, payload binary, error string")


def _urn(header: str) -> Column:
    return F.regexp_extract(F.col("headers")[header], r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from archives; damaged records raise.

    Digest and length come from the content of a response and from the headers of a revisit.
    """
    sound = F.when(F.col("error").isNull(), F.col("headers")["warc-type"]).otherwise(
        F.raise_error(F.concat("path", F.lit(", byte "), F.col("offset").cast("string"), F.lit(": "), "error")))
    rows = read_archives(spark, folder).withColumn("record_type", sound)
    whole = F.col("record_type") == "response"
    return rows.select(
        _urn("warc-record-id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("headers")["x-payload-length"].cast("long")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring(F.col("headers")["warc-payload-digest"], 8, 64)).alias("payload_digest"),
        "record_type", _urn("warc-refers-to").alias("refers_to"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    folder = new_folder(pages.sparkSession, "archives")
    write_archives(pages, folder)
    with small_batches(pages.sparkSession):
        return stored(page_records(pages.sparkSession, folder), "page-records")
