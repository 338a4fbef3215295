"""WARC archives in Zstandard: a writer, and a reader that checks what it reads.

An archive starts with a skippable frame that holds the dictionary; each record
is one frame. The reader loads the dictionary, decodes frame by frame, and
checks the version line, the fields, the lengths, the end of the record, the
block digest, and for responses the payload digest.

Records of equal payloads of at least `revisit_bytes` bytes: the one with the
smallest id is a response, the others are revisits of it. Null payloads are
empty ones; null ids and urls leave their fields out; of rows that repeat id
and payload, one is the response; an empty table writes no archive and gives an
empty result; other columns are not read. A damaged archive raises ValueError,
or gives a row with its fault where errors="report".
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_folder, shuffle_partitions, written
from .files import make_folder, open_sink, open_stream

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")

READ_SCHEMA = "address string, position long, record_type string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, fault string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{copy}')}>"


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, with its end."""
    head = HTTP % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, copy)), ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Payload-Length", str(len(payload))), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=_SAFE)))
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    if revisit:
        fields.append(("WARC-Profile", PROFILE))
        fields.append(("WARC-Refers-To", _record_id(refers_to, 1)))
        if refers_to is not None:
            fields.append(("Refers-To-Page-Id", str(refers_to)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields and payload of one record; raises ValueError on any fault."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line or end of header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.strip().lower().decode()] = value.strip().decode()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"missing fields {sorted(missing)}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length is not its Content-Length")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("the block digest does not match")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise ValueError("no end of the HTTP header")
    if fields["warc-type"] == "response":
        if "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
            raise ValueError("the payload digest does not match")
        if "payload-length" in fields and int(fields["payload-length"]) != len(payload):
            raise ValueError("the payload's length does not match")
    return fields | {"payload": payload}


def frames(stream, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(position, content) of each frame; loads the dictionary of the leading skippable frame."""
    held, position, dictionary, first, ended = b"", 0, None, True, False

    def more() -> bool:
        nonlocal held, ended
        got = b"" if ended else bytes(stream.read(chunk))
        ended = ended or not got
        held += got
        return bool(got)

    while True:
        while len(held) < 8 and more():
            pass
        if not held:
            return
        if len(held) < 8:
            raise ValueError("a frame is cut off")
        magic, size = struct.unpack("<II", held[:8])
        if magic in SKIPPABLE:
            while len(held) < 8 + size:
                if not more():
                    raise ValueError("a skippable frame is cut off")
            if first and magic == DICTIONARY_MAGIC:
                content = held[8 : 8 + size]
                if content[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
            held, position = held[8 + size :], position + 8 + size
        elif magic == FRAME_MAGIC:
            reader = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            at, parts, used = position, [], 0
            while True:
                parts.append(reader.decompress(held))
                used += len(held)
                if reader.eof:
                    held = reader.unused_data
                    break
                held = b""
                if not more():
                    raise ValueError("a frame is cut off")
            position += used - len(held)
            yield at, b"".join(parts)
        else:
            raise ValueError(f"no frame at byte {position}")
        first = False


def train_dictionary(pages: DataFrame, payload_col: str, size: int = 16384, samples: int = 512, sample_chars: int = 8192) -> bytes:
    """A dictionary from at most `samples` payloads of at most `sample_chars` characters."""
    rows = pages.select(F.substring(payload_col, 1, sample_chars).alias("p")).filter(F.length("p") > 0).withColumn("h", F.xxhash64("p"))
    # the smallest hashes first, then only their payloads: little goes to the driver
    cut = [r.h for r in rows.select("h").distinct().orderBy("h").limit(samples).collect()]
    some = rows.filter(F.col("h") <= cut[-1]).groupBy("h").agg(F.first("p").alias("p")).orderBy("h").limit(samples).collect() if cut else []
    try:
        return zstandard.train_dictionary(size, [r.p.encode() for r in some]).as_bytes() if some else b""
    except zstandard.ZstdError:  # too few or too small samples
        return b""


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0, file_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write the archives; returns their list: address, records, bytes."""
    make_folder(folder)
    text = F.coalesce(F.col(payload_col), F.lit(""))
    i = F.col(id_col).cast("long")
    rows = pages.select(i.alias("i"), F.coalesce(i, F.lit(0)).alias("k"), i.isNull().alias("z"), F.col(url_col).alias("u"), text.alias("p"), F.sha1(text.cast("binary")).alias("d"))
    dictionary = train_dictionary(rows, "p")
    # only ids and digests meet by digest, the payloads by id
    keys = rows.filter(F.octet_length("p") >= revisit_bytes).groupBy("k", "z", "d").agg(F.max("i").alias("i"), F.count("*").alias("n"))
    firsts = keys.groupBy("d").agg(F.min("i").alias("f"), F.sum("n").alias("n"))
    roles = keys.select("k", "z", "d").join(firsts.filter("n > 1"), "d").select("k", "z", "d", "f", F.lit(True).alias("again"))
    met = rows.join(roles, ["k", "z", "d"], "left")
    copy = F.row_number().over(W.partitionBy("k", "z", "d").orderBy("u"))
    typed = met.withColumn("copy", copy).select(
        "i", "u", "p", "copy", "f", (F.col("again").isNotNull() & ~(F.col("i").eqNullSafe(F.col("f")) & (F.col("copy") == 1))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sink, address, records, size = TaskContext.get().partitionId(), None, "", 0, 0
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)

        def done() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"address": [address], "records": [records], "bytes": [size]}, pa.schema([("address", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for i, u, p, copy, f, revisit in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    address, sink = open_sink(folder, f"pages-{part:06d}")
                    records = size = 0
                    if dictionary:
                        size += sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary) or 0
                data = packer.compress(record(i, copy, u, p.encode(), f if revisit else None, revisit))
                sink.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    yield done()
                    sink = None
        if sink is not None:
            yield done()

    return written(typed.mapInArrow(write, "address string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, payload: bool = True, errors: str = "raise") -> DataFrame:
    """The records of the archives listed in column `address`."""
    if errors not in ("raise", "report"):
        raise ValueError("errors is raise or report")
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in READ_SCHEMA.split(", ")])

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def rows_of(address: str) -> Iterator[dict]:
        at = -1
        try:
            with open_stream(address) as stream:
                for at, raw in frames(stream):
                    r = parse_record(raw)
                    digest = r.get("warc-payload-digest", f"sha1:{base32_sha1(r['payload'])}").removeprefix("sha1:")
                    yield {
                        "address": address, "position": at, "record_type": r["warc-type"], "record_id": r["warc-record-id"], "page_id": number(r.get("page-id")),
                        "url": unquote(r["warc-target-uri"]) if "warc-target-uri" in r else None, "payload_bytes": int(r.get("payload-length", len(r["payload"]))),
                        "payload_digest": digest, "refers_to": number(r.get("refers-to-page-id")), "payload": r["payload"] if payload and r["warc-type"] == "response" else None,
                    }
        except (ValueError, zstandard.ZstdError) as e:
            if errors == "raise":
                raise ValueError(f"{address}, after byte {at}: {e}") from e
            yield {"address": address, "position": at, "fault": str(e)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for address in b.column(0).to_pylist():
                held, size = [], 0
                for r in rows_of(address):
                    held.append({n: r.get(n) for n in names})
                    size += 200 + len(r.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("address").repartition(shuffle_partitions(archives.sparkSession)).mapInArrow(read, READ_SCHEMA)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as archives and read them back, without payloads."""
    return read_archives(write_archives(pages, new_folder(pages.sparkSession, "warc"), **options), payload=False)
