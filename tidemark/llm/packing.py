"""Best-fit packing of token sequences under several capacities at once.

A bin has room for tokens, documents and attention cost (the sum of squared lengths, as attention stays inside a
document). Pieces come in decreasing length. Of the bins with room in every dimension, ``norm`` takes the one
whose residual vector would be shortest, ``dot`` the one whose residual vector has the largest product with the
piece's demands; each dimension is divided by its capacity and has a weight. A piece without such a bin opens one.

Texts are tokenised once and cut into pieces, which are written as a table with a number of their own. Packing
reads lengths only: pieces are dealt by hash into groups of about GROUP_PIECES, and each group is packed by
itself, so no task sees all pieces and every group but for its last bin is as full as one big one.

Defined results: a null or empty text is a piece of the end id alone; repeated rows and ids are packed one by
one; a null id is kept. A piece that breaks a capacity by itself has a bin of its own. Only the id and the text
are read, so other columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import settle
from tidemark.llm.wordcache import by_size, id_cache, tokenizer
from tidemark.session import written

# Production parameters. With 4,096 tokens, the other two bounds are reached by no set of pieces that fits: they only
# break ties between bins, in favour of those with fewer documents and less attention left.
TOKENS = 4096
DOCUMENTS = 4096
COST = 4096.0**2
WEIGHTS = (1.0, 0.001, 0.001)
END_ID = 1
GROUP_PIECES = 1 << 16
# Characters tokenised at a time: the ids of more would fill an Arrow batch.
CHUNK_CHARS = 1 << 20

PIECES = "doc_id long, piece int, start long, length long, number long, ids binary"


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, tokens: int = TOKENS) -> DataFrame:
    """PIECES of every text: little-endian uint32 ids, and a number that no other row of one run has."""
    dtype = "<u2" if max(tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 0x10000 else "<u4"

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = id_cache(path, dtype)
        end = np.array([end_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        for batch in tables:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in by_size(texts, CHUNK_CHARS):
                rows: list[tuple] = []
                for key, raw in zip(keys[first:last], ids.run(texts[first:last]), strict=True):
                    raw = np.frombuffer(raw, dtype).astype("<u4").tobytes() + end
                    for piece, at in enumerate(range(0, len(raw), 4 * tokens)):
                        part = raw[at : at + 4 * tokens]
                        rows.append((key, piece, at // 4, len(part) // 4, number, part))
                        number += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES
                )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def best_fit(lengths, capacities=(TOKENS, DOCUMENTS, COST), weights=WEIGHTS, method: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and place (in tokens) of every length.

    Pieces of one length fill a chosen bin before they turn to the next: under ``norm`` a bin that was nearest stays
    nearest while it has room, so one ranking of the bins per length gives what placing one by one gives.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    caps, scale = np.array(capacities, dtype=np.float64), np.sqrt(np.array(weights, dtype=np.float64)) / np.array(capacities)
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.empty((0, 3))
    used = 0

    def put(rows: np.ndarray, at: int, size: int) -> None:
        first = int(caps[0] - room[at, 0])
        bins[rows], places[rows] = at, first + size * np.arange(len(rows))

    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, edges) if len(order) else []:
        size = int(lengths[rows[0]])
        need = np.array([size, 1.0, float(size) ** 2])
        if used + len(rows) > len(room):
            room = np.concatenate([room[:used], np.empty((used + len(rows), 3))])
        while len(rows):
            open_ = np.flatnonzero((room[:used] >= need).all(axis=1))
            if method == "dot":
                if len(open_):
                    at = open_[np.argmax((room[open_] * need * scale**2).sum(axis=1))]
                    put(rows[:1], at, size)
                    room[at] -= need
                    rows = rows[1:]
                    continue
            else:
                left = (room[open_] - need) * scale
                for at in open_[np.argsort((left**2).sum(axis=1), kind="stable")].tolist():
                    n = min(len(rows), int((room[at] // need).min()))
                    put(rows[:n], at, size)
                    room[at] -= n * need
                    rows = rows[n:]
                    if not len(rows):
                        break
            if len(rows):
                # no open bin is left for this length: a new one takes what it can, one piece at least
                n = max(1, min(len(rows), int((caps // need).min()))) if method == "norm" else 1
                room[used] = caps
                put(rows[:n], used, size)
                room[used] -= n * need
                used += 1
                rows = rows[n:]
    return bins, places


def pack(
    sized: DataFrame, capacities=(TOKENS, DOCUMENTS, COST), weights=WEIGHTS, method: str = "norm", group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """The rows of ``sized``, a written table with ``number`` and ``length``, with their sequence_id and offset."""
    groups = max(1, -(-sized.count() // group_pieces))
    schema = sized.schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(table: pa.Table) -> pa.Table:
        # rows arrive in any order; their numbers make a rerun pack them alike
        table = table.sort_by("number")
        bins, places = best_fit(table.column("length").to_numpy(), capacities, weights, method)
        bins = bins * groups + table.column("pack_group")[0].as_py()
        table = table.drop_columns("pack_group")
        return table.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(places))

    grouped = sized.withColumn("pack_group", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int"))
    return grouped.groupBy("pack_group").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(
    spark: SparkSession, df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID,
    capacities=(TOKENS, DOCUMENTS, COST), weights=WEIGHTS, method: str = "norm", group_pieces: int = GROUP_PIECES,
) -> tuple[DataFrame, DataFrame]:
    """The written pieces with their ids, and every piece's place: doc_id, piece, start, length, number, ids_crc32,
    sequence_id, offset."""
    settle(spark)
    stored = written(spark, pieces(df, path, id_col, text, end_id, int(capacities[0])))
    sized = written(spark, stored.select("doc_id", "piece", "start", "length", "number", F.crc32("ids").alias("ids_crc32")))
    return stored, pack(sized, capacities, weights, method, group_pieces)


def sequences(stored: DataFrame, packed: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, ids): the packed sequences; ``ids`` are little-endian uint32."""
    part = F.struct("offset", "doc_id", "length", "ids").alias("part")
    joined = packed.select("number", "sequence_id", "offset").join(stored, "number").select("sequence_id", part)
    whole = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.aggregate("parts", F.lit(b""), lambda raw, p: F.concat(raw, p["ids"])).alias("ids"),
    )
