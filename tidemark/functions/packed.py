"""Grams of many articles in few rows: what statistics and scores send through an exchange.

The grams of a chunk, a run of articles, are made at once. A gram is sent once per chunk, as compressed text in the bucket of its
hash, with the places in the chunk of the articles that have it. A bucket has a gram's rows of all chunks, so its statistics are
those of all articles, and go back to the articles as one sum per chunk and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as t

# Bytes of clean sentences, and articles, of a chunk.
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 1 << 15
# Bytes of clean sentences whose grams a bucket gets on average.
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 1 << 16
# Articles whose sums a task holds before it hands them on.
HELD = 4_000_000

_GROUP = "chunk bigint, articles int, entries int, pairs bigint, lengths binary, grams binary, counts binary, places binary, heads binary"
_DEALT = f"bucket int, {_GROUP}"
_STATED = f"{_GROUP}, documents binary, increase binary"
_SUMMED = "chunk bigint, articles int, pairs bigint, sums binary, heads binary"


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers, all first bytes before all second ones and so on, compressed."""
    return _codec().compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), asbytes=True)


def _restored(content: bytes, kind: type, length: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(_codec().decompress(content, length * size), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, length).T).view(kind).ravel()


def buckets_of(sentenced: DataFrame, sentences: str = "sentences") -> int:
    """Number of buckets for the grams of all rows, a power of 2."""
    length = F.aggregate(sentences, F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s))
    size = sentenced.agg(F.sum(length)).first()[0] or 0
    return min(MOST_BUCKETS, 1 << max(1, (size // BUCKET_BYTES).bit_length()))


def deal(
    articles: DataFrame, n: int, buckets: int, sentences: str = "sentences", rose: str = "rose", placed: bool = True
) -> DataFrame:
    """Distinct grams of 1..n words of chunks of rows, in ``buckets`` (a power of 2), with the places of the rows that have them.

    ``rose`` is 1, 0, or null where a row does not count for the statistics; all rows get sums. A chunk's other columns and
    numbers of grams go along in one more row, as ``heads``. Places and heads are left out unless ``placed``.
    """
    place, mark = articles.columns.index(sentences), articles.columns.index(rose)
    others = [i for i in range(len(articles.columns)) if i not in (place, mark)]
    names, bits = [*(articles.columns[i] for i in others), "count_"], buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, table in enumerate(_chunks(batches, place)):
            chunk, count = part << 32 | number, table.num_rows
            marks = table.column(mark).cast(pa.int8()).fill_null(-1).to_numpy()
            one = table.column(place).combine_chunks()
            one = one if isinstance(one, pa.Array) else pa.concat_arrays(one.chunks)
            packs, numbers, pairs = _packed(one, marks, n, bits, placed)
            heads = pa.table([*(table.column(i) for i in others), pa.array(numbers)], names=names)
            own = {"bucket": chunk % 1_000_003 % buckets, "entries": 0, "pairs": -pairs, "heads": _written(heads)}
            del one, table
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "articles": count, **p} for p in ([own] * placed + packs)], _arrow(_DEALT))
            del packs, heads, own
            pa.default_memory_pool().release_unused()

    return articles.mapInArrow(run, _DEALT)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _chunks(batches: Iterator[pa.RecordBatch], place: int, most: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    held, size, count = [], 0, 0
    for batch in batches:
        held.append(batch)
        size, count = size + batch.column(place).nbytes, count + batch.num_rows
        if size >= CHUNK_BYTES or count + batch.num_rows > most:
            yield pa.Table.from_batches(held)
            held, size, count = [], 0, 0
    if count:
        yield pa.Table.from_batches(held)


def known(stats: DataFrame, n: int, buckets: int) -> DataFrame:
    """Rows of ``stats`` (gram, documents, occurrences, increase) packed as by ``deal``, for no articles."""
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, 0, CHUNK_BYTES):
            gram = pa.concat_arrays(table.column(0).chunks)
            split = pc.split_pattern(gram, " ")
            lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
            coded = pc.list_flatten(split).dictionary_encode()
            start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            place = np.arange(len(coded)) - np.repeat(start, lengths)
            hashed = t._hashed_words(coded.dictionary, n)[coded.indices.to_numpy(), place, 0]
            bucket = _bucket(np.add.reduceat(hashed, start), bits)
            order = np.argsort(bucket, kind="stable")
            counts = np.stack([np.zeros(len(gram)), *(table.column(i).to_numpy() for i in (1, 3, 2))]).astype(np.uint32)[:, order]
            text = gram.cast(pa.large_binary()).take(pa.array(order))
            packs = _packs(bucket[order], text, counts)
            yield pa.RecordBatch.from_pylist([{"chunk": -1, "articles": 0, **p} for p in packs], _arrow(_DEALT))

    return stats.select("gram", "documents", "occurrences", "increase").mapInArrow(run, _DEALT)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.uint16)


def _packed(sentences: pa.ListArray, marks: np.ndarray, n: int, bits: int, placed: bool) -> tuple[list[dict], np.ndarray, int]:
    """One pack per bucket, the number of distinct grams of each row, and their sum."""
    texts, hashed, rows, entries, times, first = [], [], [], [], [], 0
    for row, named, codes, number in t._coded(sentences, n, False, _texts_and_keys, ordered=True):
        distinct, inverse = np.unique(codes, return_inverse=True)
        text, keys = named(distinct)
        texts.append(text)
        hashed.append(keys[:, 0])
        rows.append(row.astype(np.uint16))
        entries.append(inverse + first)
        times.append(np.bincount(inverse, weights=number * (marks[row] >= 0), minlength=len(distinct)))
        first += len(distinct)
    bucket = _bucket(np.concatenate(hashed), bits)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    entry, row = rank[np.concatenate(entries)], np.concatenate(rows)
    by = np.argsort(entry, kind="stable")
    entry, row = entry[by], row[by]
    sizes = np.bincount(entry, minlength=first)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    steps = np.diff(row, prepend=row[:1])
    steps[edge[:-1]] = row[edge[:-1]]
    marked = marks[row]
    documents = np.bincount(entry, weights=marked >= 0, minlength=first)
    increase = np.bincount(entry, weights=marked == 1, minlength=first)
    counts = np.stack([sizes, documents, increase, np.concatenate(times)[order]]).astype(np.uint32)
    text = pa.concat_arrays(texts).cast(pa.large_binary()).take(pa.array(order))
    packs = _packs(bucket[order], text, counts, (edge, steps) if placed else None)
    return packs, np.bincount(row, minlength=len(sentences)), len(row)


def _packs(bucket: np.ndarray, text: pa.Array, counts: np.ndarray, places: tuple | None = None) -> list[dict]:
    """One row per bucket of entries in order of their buckets."""
    ends, content = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1], text.buffers()[2]
    found, start = np.unique(bucket, return_index=True)
    packs = []
    for b, low, high in zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(text)]):
        edge, steps = places or (np.zeros(len(text) + 1, np.int64), np.zeros(0, np.uint16))
        packs.append({
            "bucket": b, "entries": high - low, "pairs": int(edge[high] - edge[low]),
            "lengths": _squeezed(np.diff(ends[low : high + 1]).astype(np.uint32)),
            "grams": _codec().compress(content[int(ends[low]) : int(ends[high])], asbytes=True) if ends[high] > ends[low] else b"",
            "counts": _squeezed(counts[:, low:high].ravel()), "places": _squeezed(steps[edge[low] : edge[high]]),
        })
    return packs


def _texts_and_keys(words: pa.Array, n: int):
    texts, keys = t._texts(words, n), t._keys(words, n)

    def name(k: int, shorter: tuple | None, codes: np.ndarray) -> tuple:
        text, key = shorter or (None, None)
        return texts(k, text, codes), keys(k, key, codes)

    return name


def statistics(dealt: DataFrame) -> DataFrame:
    """The rows of ``deal`` with the statistics of each of their grams: counted documents, and those of them that rose."""

    def run(bucket: pa.Table) -> pa.Table:
        rows = bucket.drop_columns("bucket").to_pylist()
        packs = [r for r in rows if r["heads"] is None]
        if packs:
            _, gram, counts = _grams(packs)
            documents = np.bincount(gram, weights=counts[1]).astype(np.int64)[gram]
            increase = np.bincount(gram, weights=counts[2]).astype(np.int64)[gram]
            start = 0
            for r in packs:
                own = slice(start, start := start + r["entries"])
                r["documents"], r["increase"] = documents[own].tobytes(), increase[own].tobytes()
        return pa.Table.from_pylist([r for r in rows if r["articles"]], _arrow(_STATED))

    return dealt.groupBy("bucket").applyInArrow(run, _STATED)


def _grams(packs: list[dict]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct grams of a bucket, and of all entries the number of their gram and their counts."""
    content, lengths, counts = [], [], []
    for r in packs:
        length = _restored(r["lengths"], np.uint32, r["entries"])
        total = int(length.sum())
        content.append(_codec().decompress(r["grams"], total, asbytes=True) if total else b"")
        lengths.append(length)
        counts.append(_restored(r["counts"], np.uint32, 4 * r["entries"]).reshape(4, -1))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype=np.int64)])
    texts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(content))])
    coded = texts.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.concatenate(counts, axis=1)


def gram_rows(dealt: DataFrame) -> DataFrame:
    """Grams of the rows that ``deal`` counted, in order of their texts in each bucket, with their statistics."""
    schema = "gram string, documents bigint, occurrences bigint, increase bigint, decrease bigint, n int"

    def run(bucket: pa.Table) -> pa.Table:
        texts, gram, counts = _grams(bucket.to_pylist())
        documents, increase, times = (np.bincount(gram, weights=c).astype(np.int64) for c in counts[1:])
        texts = texts.cast(pa.large_string()).cast(pa.string())
        words = pc.add(pc.count_substring(texts, " "), pa.scalar(1, pa.int32()))
        table = pa.table([texts, documents, times, increase, documents - increase, words],
                         names=["gram", "documents", "occurrences", "increase", "decrease", "n"])
        return table.filter(pc.greater(table["documents"], 0)).sort_by("gram")

    return dealt.groupBy("bucket").applyInArrow(run, schema)


def share_sums(stated: DataFrame) -> DataFrame:
    """Rows of ``deal`` by their own columns, with ``count_``, the number of their grams, and ``total``, the sum of the rising shares.

    ``stated`` comes from ``statistics``, and ``heads`` names the columns. A gram without counted documents has no share.
    """

    def summed(held: dict) -> Iterator[pa.RecordBatch]:
        for chunk, (pairs, sums) in held.items():
            row = {"chunk": chunk, "articles": len(sums), "pairs": pairs, "sums": _squeezed(sums)}
            yield pa.RecordBatch.from_pylist([row], _arrow(_SUMMED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = {}, 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["heads"] is not None:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("chunk", "articles", "pairs", "heads")}], _arrow(_SUMMED))
                    continue
                if r["chunk"] not in held:
                    held[r["chunk"]] = [0, np.zeros(r["articles"])]
                    count += r["articles"]
                own = held[r["chunk"]]
                own[0] += r["pairs"]
                own[1] += _sums(r)
                if count > HELD:
                    yield from summed(held)
                    held, count = {}, 0
        yield from summed(held)

    return stated.mapInArrow(run, _SUMMED)


def _sums(pack: dict) -> np.ndarray:
    documents, increase = np.frombuffer(pack["documents"], np.int64), np.frombuffer(pack["increase"], np.int64)
    share = np.divide(increase, documents, out=np.zeros(len(documents)), where=documents > 0)
    sizes = _restored(pack["counts"], np.uint32, 4 * pack["entries"])[: pack["entries"]].astype(np.int64)
    row = np.cumsum(_restored(pack["places"], np.uint16, pack["pairs"]), dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # steps count from 0 again at each gram
    before = np.where(start > 0, row[start - 1], 0)
    row -= np.repeat(before, sizes)
    return np.bincount(row, weights=np.repeat(share, sizes), minlength=pack["articles"])


def article_totals(stated: DataFrame, articles: DataFrame) -> DataFrame:
    """Rows of ``deal`` with ``count_`` and ``total``; ``articles`` names their columns and types."""
    fields = [(f.name, f.dataType.simpleString()) for f in articles.schema]
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in fields), "count_ bigint, total double"])

    def run(chunk: pa.Table) -> pa.Table:
        rows = chunk.to_pylist()
        if sum(r["pairs"] for r in rows) or sum(r["heads"] is not None for r in rows) != 1:
            raise RuntimeError("grams of a chunk of articles are missing or come twice")
        total = np.zeros(rows[0]["articles"])
        for r in rows:
            if r["sums"] is not None:
                total += _restored(r["sums"], np.float64, r["articles"])
        heads = pa.ipc.open_stream(next(r["heads"] for r in rows if r["heads"] is not None)).read_all()
        return heads.append_column("total", pa.array(total))

    return share_sums(stated).groupBy("chunk").applyInArrow(run, schema)
