"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary. Every following frame is one
record, compressed with it. Equal payloads are stored once: the record with the largest id is the response, the
others are revisit records that name it and keep the headers only. The reader takes the dictionary from the
first frame, decodes frame by frame and checks header lines, lengths and digests; a record that fails
comes out with its error, and nothing after a broken frame is guessed.

Defined results: a null payload is empty; payloads are compared by digest; rows that repeat an id and a payload
are all responses; of null ids, the record refers to the largest id, and a payload that only null ids carry has
responses only. An empty table writes no file. Only the id, url and payload columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, filesystem
from tidemark.session import shared_dir, written

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
# Production parameters: dictionary size and the bounded sample it is trained on, level, file and read sizes.
DICTIONARY_BYTES = 64 << 10
DICTIONARY_ROWS = 512
DICTIONARY_SAMPLE_BYTES = 32 << 10
LEVEL = 3
FILE_BYTES = 128 << 20
READ_BYTES = 1 << 20
MIN_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long,"
    " path string, at long, error string, payload binary"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(pages: DataFrame, id_col: str, payload: str) -> bytes:
    """A dictionary from the first bytes of a bounded sample: the rows with the smallest hashes of their ids."""
    filled = pages.filter(F.octet_length(F.col(payload)) > 0)
    starts = F.substring(F.col(payload).cast("binary"), 1, DICTIONARY_SAMPLE_BYTES)
    sample = bounded_sample(filled.select(F.col(id_col).alias("id"), starts.alias("b")), filled.count(), "id", DICTIONARY_ROWS)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["b"]) for r in sample]).as_bytes()
    except zstandard.ZstdError:
        # too few or too short samples: plain content works as a dictionary, too
        return b"".join(bytes(r["b"]) for r in sample)[:DICTIONARY_BYTES] or b"<!DOCTYPE html><html><head><body>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record. A revisit keeps the response's headers, which state the full payload's length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if c > " " else "%{:02X}".format(ord(c)) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {target}"] if target else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    name = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def referred(pages: DataFrame, id_col: str, payload: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to): the largest id of each payload, found by a summed grouping on digests.

    Only digests of more than one row travel back to the pages; copies of one page may be a third of them, and
    adaptive execution splits that side of the join.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url"), body.alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    groups = (
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("key")
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("key", "last")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.join(groups, "key", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write(pages: DataFrame, id_col: str = "page_id", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives into the shared folder; returns the manifest (path, records, bytes).

    Tasks name their files anew per attempt, and only files in the committed manifest are archives.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    dictionary = train(pages, id_col, payload)
    schema = "path string, records long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        out, path, records, rows = None, "", 0, []
        for batch in batches:
            for page_id, url, body, refers in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    path, records = f"{folder}/{name}", 0
                    out = store.open_output_stream(f"{root}/{name}")
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                out.write(packer.compress(record(page_id, url, body, refers, digest_of(body))))
                records += 1
                if out.tell() >= FILE_BYTES:
                    rows.append((path, records, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            rows.append((path, records, out.tell()))
            out.close()
        paths, counts, sizes = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"]
        )

    return written(spark, referred(pages, id_col, payload, min_bytes).mapInArrow(run, schema))


def frames(file) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, content, error) per frame of an open archive; stops after a frame that does not decode."""
    head = file.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != DICTIONARY_MAGIC:
        yield 0, None, "no dictionary frame at the start"
        return
    size = struct.unpack("<II", head)[1]
    raw = file.read(size)
    if len(raw) != size:
        yield 0, None, "dictionary frame is cut off"
        return
    if raw[:4] == FRAME_MAGIC:  # the dictionary itself may be a frame
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at, rest = 8 + size, b""
    while True:
        if not rest:
            rest = file.read(READ_BYTES)
            if not rest:
                return
        frame, parts, used = unpacker.decompressobj(), [], 0
        try:
            while True:
                parts.append(frame.decompress(rest))
                if frame.eof:
                    used += len(rest) - len(frame.unused_data)
                    rest = frame.unused_data
                    break
                used += len(rest)
                rest = file.read(READ_BYTES)
                if not rest:
                    yield at, None, "frame is cut off"
                    return
        except zstandard.ZstdError as error:
            yield at, None, f"frame does not decode: {error}"
            return
        yield at, b"".join(parts), None
        at += used


def parse(content: bytes) -> dict:
    """Fields of one record; ``error`` names the first check that fails."""
    fields = dict.fromkeys(("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "error"))
    try:
        head, blank, rest = content.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        named = dict(line.split(": ", 1) for line in lines)
        if not blank or version != "WARC/1.1":
            raise ValueError("not a WARC/1.1 record")
        if len(named) != len(lines):
            raise ValueError("a header is repeated")
        length = int(named["Content-Length"])
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise ValueError("block has a wrong length")
        fields["record_type"] = named["WARC-Type"]
        fields["page_id"] = _page_of(named["WARC-Record-ID"])
        fields["url"] = named.get("WARC-Target-URI")
        fields["payload_digest"] = named["WARC-Payload-Digest"].removeprefix("sha1:")
        http, blank, payload = rest[:length].partition(b"\r\n\r\n")
        status, *lines = http.decode().split("\r\n")
        size = int(dict(line.split(": ", 1) for line in lines)["Content-Length"])
        if not blank or not status.startswith("HTTP/"):
            raise ValueError("not an HTTP response")
        fields["payload_bytes"] = size
        if named["WARC-Type"] == "revisit":
            fields["refers_to"] = _page_of(named["WARC-Refers-To"])
            if payload:
                raise ValueError("revisit record has a payload")
        elif named["WARC-Type"] == "response":
            if len(payload) != size:
                raise ValueError("payload has a wrong length")
            if digest_of(payload) != fields["payload_digest"]:
                raise ValueError("payload does not match its digest")
            fields["payload"] = payload
        else:
            raise ValueError(f"record type {named['WARC-Type']}")
    except KeyError as error:
        fields["error"] = f"no header {error.args[0]}"
    except ValueError as error:
        fields["error"] = str(error)
    return fields


def read(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives named in ``manifest.path``; see READ_SCHEMA."""
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in READ_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = filesystem(path)
                with store.open_input_stream(name) as file:
                    rows, size = [], 0
                    for at, content, error in frames(file):
                        row = parse(content) if error is None else {"error": error}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row | {"path": path, "at": at})
                        size += len(row.get("payload") or b"") + 256
                        if size > READ_BYTES:
                            yield _batch(rows, names, types)
                            rows, size = [], 0
                    yield _batch(rows, names, types)

    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(n, "path").mapInArrow(run, READ_SCHEMA)


def _batch(rows: list[dict], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names
    )
