"""WARC archives, Zstandard-compressed with a dictionary of their own.

Each archive starts with a skippable frame that embeds the dictionary; behind it every
record is a frame of its own, so that any record can be read alone.  The dictionary is
built from a sample of the records to be archived: ``DICT_RECORDS`` of them, picked by a hash
of the key, each with the first ``SAMPLE_CHARS`` characters of its payload, cut before
they leave the executors.  Where training refuses the sample (few records, or all alike), its bytes are
the dictionary.  The sample decides only how well records compress.

Records with equal payloads (of ``min_revisit`` bytes or more) are written once: the one
with the smallest key as a response, the others as revisits that refer to it.  Digests are
grouped, not payloads, and only the revisits are joined to the rows.

Archives are written by the tasks to the cluster's shared folder under names of their own;
an attempt that is lost leaves a file that no manifest row names, so it is never read.

Defined results: a null payload is an empty one; a null key sorts last, so it refers to
another record if there is an equal one; rows with equal key and payload are alike, so
they are all responses if their key is the smallest; an empty table writes no archive and
has no records; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

# Fixed values of the formats: the skippable frame's magic number, the version line.
DICT_FRAME_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
DICT_RECORDS, SAMPLE_CHARS, DICT_BYTES, ARCHIVE_BYTES = 512, 16 << 10, 64 << 10, 32 << 20
#: Bytes that are read at once, and that a batch of payloads may reach.
READ_BYTES, BATCH_BYTES = 256 << 10, 16 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = b"1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None) -> bytes:
    """One WARC record.  A revisit has the payload's digest and length but no payload."""
    block = HTTP if revisits else HTTP + payload
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisits else b"response"),
        b"WARC-Record-ID: <urn:x-page:%s>" % str(key).encode(),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(),
        b"WARC-Payload-Digest: sha1:" + digest_of(payload).encode(),
        b"X-Payload-Length: %d" % len(payload),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if revisits:
        head.insert(2, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(3, b"WARC-Refers-To: <urn:x-page:%s>" % str(refers_to).encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_FRAME_MAGIC, len(dictionary)) + dictionary


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload; the payload's digest is checked where there is a payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = {k.decode(): v.decode() for k, v in (line.split(b": ", 1) for line in lines[1:])}
    n = int(headers["Content-Length"])
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n" or len(block) < n:
        raise ValueError("a record is cut off")
    payload = block[len(HTTP) :]
    if headers["WARC-Type"] == "response" and "sha1:" + digest_of(payload) != headers["WARC-Payload-Digest"]:
        raise ValueError("a payload differs from its digest")
    return headers, payload


def read_archive(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame at a time, from a stream that is read piece by piece."""
    head = source.read(8)
    if not head:
        return
    magic, n = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICT_FRAME_MAGIC:
        raise ValueError("an archive without its dictionary")
    dictionary = source.read(n)
    if len(dictionary) < n:
        raise ValueError("a dictionary is cut off")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if n else None)
    piece = source.read(READ_BYTES)
    while piece:
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if not piece:
                raise ValueError("a frame is cut off")
            out.append(frame.decompress(piece))
            piece = frame.unused_data if frame.eof else source.read(READ_BYTES)
        yield parse_record(b"".join(out))
        piece = piece or source.read(READ_BYTES)


def train(records: list[bytes]) -> bytes:
    """A dictionary for records like these: trained, or their bytes where training refuses them."""
    size = min(DICT_BYTES, max(1 << 10, sum(map(len, records)) // 8))
    try:
        return zstandard.train_dictionary(size, records).as_bytes() if len(records) >= 8 else b"".join(records)[-DICT_BYTES:]
    except zstandard.ZstdError:
        return b"".join(records)[-DICT_BYTES:]


def build_dictionary(pages: DataFrame, key: str, url: str, payload: str, n: int) -> bytes:
    """A dictionary from a sample of the records, cut to SAMPLE_CHARS where it is read; empty only where there is no record."""
    every = max(1, n // (2 * DICT_RECORDS))
    cut = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.substring(F.coalesce(F.col(payload), F.lit("")), 1, SAMPLE_CHARS).alias("p"))
    sample = cut.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).limit(DICT_RECORDS).collect() or cut.limit(DICT_RECORDS).collect()
    return train([record(r["k"], r["u"], r["p"].encode(), False, None) for r in sample])


def revisits(pages: DataFrame, key: str, payload: str, min_revisit: int) -> DataFrame:
    """(key, digest, refers_to) of the rows whose payload a smaller key has too."""
    body = F.coalesce(F.col(payload), F.lit(""))
    digests = pages.select(F.col(key).alias("k"), F.unhex(F.sha1(body)).alias("d"), F.octet_length(body).alias("n")).where(F.col("n") >= min_revisit)
    firsts = digests.groupBy("d").agg(F.min("k").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    return digests.join(firsts, "d").where(~F.col("k").eqNullSafe(F.col("refers_to"))).select("k", "d", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 0) -> DataFrame:
    """Writes one record per row under ``folder``; the manifest: (path, n_records, n_bytes) per archive."""
    spark = pages.sparkSession
    words = spark.sparkContext.broadcast(build_dictionary(pages, key, url, payload, pages.count()))
    again = revisits(pages, key, payload, min_revisit)
    digest = F.unhex(F.sha1(F.coalesce(F.col(payload), F.lit(""))))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"), digest.alias("digest"))
    marked = rows.join(again, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left").select("key", "url", "payload", F.col("d").isNotNull().alias("again"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        held = zstandard.ZstdCompressionDict(words.value) if words.value else None
        press = zstandard.ZstdCompressor(level=3, dict_data=held, write_checksum=True, write_content_size=True)
        frames, size, count = [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(dictionary_frame(words.value))
                for x in frames:
                    f.write(x)
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_records": count, "n_bytes": size}])

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                k, u, p, a, r = (c[i].as_py() for c in columns)
                frames.append(press.compress(record(k, u, (p or "").encode(), a, r)))
                size, count = size + len(frames[-1]), count + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    frames, size, count = [], 0, 0
        if count:
            yield close()

    manifest = marked.mapInArrow(run, "path string, n_records long, n_bytes long")
    manifest.write.parquet(f"{folder}-manifest")  # once: archives of other attempts stay unnamed
    return spark.read.parquet(f"{folder}-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record that the
    manifest's archives hold.  All payloads are read and checked; without ``payloads`` they aren't returned."""
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(urn: str) -> int | None:
        x = urn[len("<urn:x-page:") : -1]
        return None if x == "None" else int(x)

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_stream(place, compression=None) as f:
                    for h, body in read_archive(f):
                        to, kind = h.get("WARC-Refers-To"), h["WARC-Type"]
                        kept = body if payloads and kind == "response" else None
                        rows.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], kind, number(to) if to else None, kept))
                        held += len(kept or b"")
                        if len(rows) == 1024 or held >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    # archives are a few MB each: one row of the manifest is a unit of work
    files = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism, "path")
    return files.mapInArrow(run, "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages and reads the archives back: one row per record."""
    manifest = write_archives(pages, shared_dir(pages.sparkSession))
    back = read_archives(manifest, payloads=False)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
