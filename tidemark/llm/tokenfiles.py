"""Token files: frequency-ranked ids in a byte-aligned code with separate control bytes.

Ids are replaced by their rank in the corpus, so frequent ids take one byte. A file is

    magic, number of ids, the ids in rank order (uint32)
    blocks: number of documents, of values, of control bytes and of data bytes (uint32 each),
            document ids (int64) with a null flag each (uint8), lengths (uint32), control bytes, data bytes

A control byte holds the byte lengths (1 to 4) of four values, two bits each. Decoding looks the lengths up in
a table of 256 entries and gathers the data bytes with numpy.

Texts are tokenised once. The ids go to ranges of document ids, are sorted and written as an ordinary table,
counted, and recoded file by file. Files have names of their own per attempt and only those in the manifest,
a table that Spark commits, are read: a lost executor or a repeated task leaves no trace in the result.

Defined results: a null or empty text is a document of the end id alone; null ids come first; rows with equal
ids are ordered by a hash of their text, and a hot id is split over ranges by that hash; equal rows follow each
other. An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem
from tidemark.llm.wordcache import id_cache, tokenizer
from tidemark.session import shared_dir, written

MAGIC = b"TMIDS001"
END_ID = 2
BLOCK_VALUES = 1 << 18
# Bytes of text per range of documents, and documents tokenised at a time.
RANGE_BYTES = 32 << 20
_ENDS = np.array([1, 2, 3, 4], dtype=np.int64)
# Byte lengths of the four values of each control byte.
_LENGTHS = _ENDS[(np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    code = np.concatenate([code, np.zeros(-len(code) % 4, np.uint8)]).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values behind ``pack``'s bytes."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths)
    if len(ends) and ends[-1] != len(data) or not len(ends) and data:
        raise ValueError(f"control bytes ask for {ends[-1] if n else 0} data bytes, {len(data)} are there")
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    at = ends - lengths
    values = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        values[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def tokenised(df: DataFrame, path: str, bounds: list[int], end_id: int, id_col: str, text: str, wide: bool) -> DataFrame:
    """(doc_id, salt, part, ids): raw ids with the end id, and the range of the document."""
    dtype = "<u4" if wide else "<u2"

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = id_cache(path, dtype)
        limits = np.array(bounds, dtype=np.int64)
        end = np.array([end_id], dtype=dtype).tobytes()
        for batch in tables:
            keys = batch.column(0)
            filled = keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            salts = batch.column(1).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(limits, filled, "left"), np.searchsorted(limits, filled, "right")
            # an id that is a limit itself lies in several ranges; the hash says in which
            share = (salts >> 1).astype(np.float64) / 2.0**62 / 2 + 0.5
            part = low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)
            raw = ids.run(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column(1), pa.array(part, pa.int32()), pa.array([r + end for r in raw], pa.binary())],
                names=["doc_id", "salt", "part", "ids"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("salt"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, salt long, part int, ids binary")


def _ranges(df: DataFrame, id_col: str, text: str) -> list[int]:
    """Limits that cut the document ids into ranges of about RANGE_BYTES of text; ascending, perhaps repeated."""
    total, low = df.agg(F.sum(F.octet_length(F.col(text))), F.count(F.col(id_col))).first()
    n = min(10_000, max(int((total or 0) // RANGE_BYTES), df.sparkSession.sparkContext.defaultParallelism))
    if not low or n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    return df.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, 100 * n)).first()[0]


def _count(ids: DataFrame, dtype: str) -> dict[int, int]:
    """Occurrences per id: summed in each task, then over tasks; as many rows as the vocabulary has ids."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in tables:
            seen = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype))
            if len(seen) > len(total):
                seen, total = total, seen
            total[: len(seen)] += seen
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def _block(docs: list, dtype: str, rank: np.ndarray) -> bytes:
    lengths = np.array([len(raw) // np.dtype(dtype).itemsize for _, _, raw in docs], dtype="<u4")
    control, data = pack(rank[np.frombuffer(b"".join(raw for _, _, raw in docs), dtype)])
    head = np.array([len(docs), int(lengths.sum()), len(control), len(data)], dtype="<u4")
    ids = np.array([d or 0 for d, _, _ in docs], dtype="<i8")
    nulls = np.array([d is None for d, _, _ in docs], dtype=np.uint8)
    return b"".join([head.tobytes(), ids.tobytes(), nulls.tobytes(), lengths.tobytes(), control, data])


def _write(ids: DataFrame, folder: str, order: np.ndarray, dtype: str) -> DataFrame:
    """Writes the files; one manifest row per block. A file is an ascending run of one range."""
    manifest = "part int, first_id long, first_salt long, path string, at long, bytes long, n_docs long, n_tokens long"

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(int(order.max(initial=0)) + 1, dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        head = MAGIC + np.array([len(order)], dtype="<u4").tobytes() + order.astype("<u4").tobytes()
        rows: list[tuple] = []
        out, path, part, docs, size, last = None, "", None, [], 0, None

        def flush():
            nonlocal docs, size
            if docs:
                block = _block(docs, dtype, rank)
                rows.append((part, docs[0][0], docs[0][1], path, out.tell(), len(block), len(docs), size))
                out.write(block)
                docs, size = [], 0

        for batch in tables:
            for key, salt, at, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                place = (key is not None, key or 0, salt)
                if at != part or place < last:
                    flush()
                    if out is not None:
                        out.close()
                    name = f"ids-{at:05d}-{uuid.uuid4().hex}.tmi"
                    part, path = at, f"{folder}/{name}"
                    out = store.open_output_stream(f"{root}/{name}")
                    out.write(head)
                docs.append((key, salt, raw))
                size += len(raw) // np.dtype(dtype).itemsize
                last = place
                if size >= BLOCK_VALUES:
                    flush()
        flush()
        if out is not None:
            out.close()
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=[c.split()[0] for c in manifest.split(", ")],
        )

    return written(ids.sparkSession, ids.select("doc_id", "salt", "part", "ids").mapInArrow(run, manifest))


def encode(df: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the documents as token files in the shared folder; returns the manifest, one row per block."""
    spark = df.sparkSession
    wide = tokenizer(path).get_vocab_size(with_added_tokens=True) > 0x10000 or end_id > 0xFFFF
    dtype = "<u4" if wide else "<u2"
    bounds = _ranges(df, id_col, text)
    ids = tokenised(df, path, bounds, end_id, id_col, text, wide)
    ids = ids.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "salt")
    folder = shared_dir(spark)
    ids.write.option("compression", "zstd").parquet(f"{folder}/ids")
    ids = spark.read.schema("doc_id long, salt long, part int, ids binary").parquet(f"{folder}/ids")
    counts = _count(ids, dtype)
    order = np.array(sorted(counts, key=lambda i: (-counts[i], i)), dtype=np.int64)
    return _write(ids, f"{folder}/files", order, dtype)


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids before each block. Ranges are summed first, so no task orders all blocks."""
    inside = Window.partitionBy("part").orderBy(F.col("first_id").asc_nulls_first(), "first_salt", "path", "at")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")
    )
    run = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("run", run).join(parts, "part").withColumn("start", F.col("run") + F.col("part_start")).drop("run", "part_start")


def read_blocks(path: str, places: list[tuple[int, int]]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Document ids and id arrays of the blocks of a file at (offset, bytes)."""
    store, name = filesystem(path)
    with store.open_input_file(name) as file:
        head = file.read(12)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        order = np.frombuffer(file.read(4 * int.from_bytes(head[8:12], "little")), "<u4")
        for at, size in places:
            file.seek(at)
            raw = file.read(size)
            n_docs, n, n_control, n_data = np.frombuffer(raw, "<u4", 4).tolist()
            if size != 16 + 13 * n_docs + n_control + n_data or len(raw) != size:
                raise ValueError(f"block at {at} of {path} has a wrong length")
            keys = np.frombuffer(raw, "<i8", n_docs, 16)
            nulls = np.frombuffer(raw, np.uint8, n_docs, 16 + 8 * n_docs)
            lengths = np.frombuffer(raw, "<u4", n_docs, 16 + 9 * n_docs).astype(np.int64)
            start = 16 + 13 * n_docs
            values = order[unpack(raw[start : start + n_control], raw[start + n_control :], n)]
            if lengths.sum() != n:
                raise ValueError(f"lengths in the block at {at} of {path} do not add up")
            yield (
                [None if null else key for key, null in zip(keys.tolist(), nulls.tolist(), strict=True)],
                np.split(values, np.cumsum(lengths)[:-1]),
            )


def read(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            for path, at, size, start in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for keys, ids in read_blocks(path, [(at, size)]):
                    n = np.array([len(i) for i in ids], dtype=np.int64)
                    columns = [
                        pa.array(keys, pa.int64()),
                        pa.array(start + np.cumsum(n) - n, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    blocks = with_starts(manifest).select("path", "at", "bytes", "start")
    n = min(manifest.count(), 4 * spark.sparkContext.defaultParallelism)
    return blocks.repartition(max(n, 1), "path", "at").mapInArrow(run, schema)
