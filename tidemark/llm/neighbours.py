"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample turns a vector into a binary code whose Hamming distances follow angles.
The code is split into substrings and each substring is indexed. If two codes differ in at most R bits, some
substring of them differs in at most R // substrings bits (pigeonhole), so probing every substring value within
that distance finds every code within the radius. What is found is checked on the whole code and reranked by the
inner product of the original vectors in double precision. R is fitted on the sample so that a wanted share
of true neighbours lies within it.

Vectors are dealt by a hash of their id into index blocks of bounded size; each travels to its block once, and
every query to every block. Within a partition a block's vectors come first and its queries behind them: the block
builds its substring tables once, answers the queries batch by batch as they arrive and returns the best k of each,
so a task holds one block and one batch, and rows between tasks are k per query and index block. Nothing is
broadcast but the code's parameters, whose size depends on the dimension alone.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than
most vectors take no part. Ties go to smaller ids; a query skips every row with its own id; rows that repeat an
id are reported once, with their best score. With fewer candidates than k all are returned: an index
block that finds fewer than k ids within the radius doubles its radius until it has k or all. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample

# Production parameters.
K = 20
SUBSTRING_BITS = 8
SAMPLE_ROWS = 8192
SAMPLE_QUERIES = 256
WANTED = 0.985
ROTATIONS = 30
BLOCK_VECTORS = 8192
SEED = 7


def usable(vector: Column) -> Column:
    """True for vectors of finite components that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def lifted(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """Unit vectors of one more dimension whose angles order like inner products with ``top`` the largest norm."""
    norms = np.linalg.norm(x, axis=1)
    if query:
        return np.column_stack([x / norms[:, None], np.zeros(len(x))])
    return np.column_stack([x / top, np.sqrt(np.maximum(0.0, 1 - (norms / top) ** 2))])


def learn(sample: np.ndarray, top: float, k: int = K) -> dict:
    """Centre, rotation and radius from sample vectors: principal directions, then iterative quantization.

    Neighbours in the sample are farther than those among all rows, so the radius errs to the large side.
    """
    rng = np.random.default_rng(SEED)
    x = lifted(sample, top, False)
    centre = x.mean(axis=0)
    bits = max(SUBSTRING_BITS, (sample.shape[1] + SUBSTRING_BITS - 1) // SUBSTRING_BITS * SUBSTRING_BITS)
    z = x - centre
    _, directions = np.linalg.eigh(z.T @ z)
    directions = directions[:, ::-1][:, :bits]
    # a code may have more bits than there are directions: further ones are random combinations
    z = z @ directions
    mix = np.linalg.qr(rng.normal(size=(bits, z.shape[1])))[0].T if bits >= z.shape[1] else np.eye(z.shape[1])
    for _ in range(ROTATIONS):
        signs = np.sign(z @ mix)
        u, _, vt = np.linalg.svd(signs.T @ z, full_matrices=False)
        mix = (u @ vt).T
    model = {"centre": centre, "turn": directions @ mix, "top": top, "bits": bits, "radius": bits}
    codes = encode(sample, model, False)
    some = rng.permutation(len(sample))[:SAMPLE_QUERIES]
    scores = sample[some] @ sample.T
    scores[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    if near.size:
        asked = encode(sample[some], model, True)
        distance = np.bitwise_count(asked[:, None, :] ^ codes[near]).sum(axis=2)
        model["radius"] = int(np.ceil(np.quantile(distance, WANTED)))
    return model


def encode(x: np.ndarray, model: dict, query: bool) -> np.ndarray:
    """Codes as one byte per substring."""
    return np.packbits((lifted(x, model["top"], query) - model["centre"]) @ model["turn"] > 0, axis=1)


def words(codes: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words, filled up with zeros."""
    padded = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    padded[:, : codes.shape[1]] = codes
    return padded.view(np.uint64)


class Index:
    """Substring tables of one block: for each substring, the rows sorted by its value.

    The rows that a substring value finds are kept as bits for the probes of ``radius``, which all queries share: at
    most 256 bytes per row and substring of eight bits, in all substrings together those of a few vectors.
    """

    def __init__(self, codes: np.ndarray, radius: int = 0):
        self.codes, self.words = codes, words(codes)
        self.order = np.argsort(codes, axis=0, kind="stable").T.copy()
        self.starts = np.stack([np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)])
        values = np.arange(256, dtype=np.uint8)
        self.ball = np.argsort(np.bitwise_count(values), kind="stable").astype(np.uint8)
        self.ball_ends = np.cumsum([math.comb(SUBSTRING_BITS, r) for r in range(SUBSTRING_BITS + 1)])
        self.kept_step = self.step(radius)
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def step(self, radius: int) -> int:
        """Bits in which some substring of a code within ``radius`` differs at most."""
        return min(radius // self.codes.shape[1], SUBSTRING_BITS)

    def probe(self, j: int, part: int, step: int) -> np.ndarray:
        """Bits of the rows whose substring ``j`` differs from ``part`` in at most ``step`` bits."""
        known = self.kept.get((j, part)) if step == self.kept_step else None
        if known is not None:
            return known
        values = self.ball[: self.ball_ends[step]] ^ np.uint8(part)
        first, last = self.starts[j, values], self.starts[j, values.astype(np.int64) + 1]
        size = last - first
        # rows of all probed values at once: runs first..last laid end to end
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        found = np.zeros(len(self.codes), bool)
        found[self.order[j, at]] = True
        bits = np.packbits(found)
        if step == self.kept_step:
            self.kept[j, part] = bits
        return bits

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits."""
        step = self.step(radius)
        found = np.bitwise_or.reduce([self.probe(j, part, step) for j, part in enumerate(code.tolist())])
        rows = np.flatnonzero(np.unpackbits(found, count=len(self.codes)))
        return rows[np.bitwise_count(self.words[rows] ^ words(code[None])).sum(axis=1) <= radius]


class Block:
    """The vectors of an index block, rows of an id together, with their substring tables."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, model: dict):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.model = ids[order], x[order], model
        self.distinct, self.group = np.unique(self.ids, return_inverse=True)
        self.index = Index(encode(self.x, model, False), model["radius"])

    def firsts(self, rows: np.ndarray) -> np.ndarray:
        """Places in ``rows`` where another id begins."""
        return np.flatnonzero(np.diff(self.ids[rows], prepend=self.ids[rows[:1]] - 1))

    def within(self, own: int, code: np.ndarray, k: int) -> np.ndarray:
        """Rows of other ids within the radius, widened until it holds ``k`` ids or all of them."""
        radius, others = self.model["radius"], None
        while True:
            rows = self.index.within(code, radius)
            rows = rows[self.ids[rows] != own]
            found = len(self.firsts(rows))
            if found >= k or radius >= self.model["bits"]:
                return rows
            if others is None:
                others = len(self.distinct) - int(own in self.distinct)
            if found == others:
                return rows
            radius = min(self.model["bits"], 2 * radius + 1)

    def best(self, asked: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
        """(query id, id, score) lists of the best ``k`` ids per query."""
        out: tuple[list, list, list] = ([], [], [])
        for own, vector, code in zip(asked, q, encode(q, self.model, True)):
            rows = self.within(own, code, k)
            # the best score of every id found, over all of its rows
            if len(self.distinct) < len(self.ids):
                some = np.zeros(len(self.distinct), bool)
                some[self.group[rows]] = True
                rows = np.flatnonzero(some[self.group])
            first = self.firsts(rows)
            found, scores = self.ids[rows][first], self.x[rows] @ vector
            scores = np.maximum.reduceat(scores, first) if len(first) else scores
            if len(found) > 4 * k:
                bar = np.partition(scores, len(found) - k)[len(found) - k]
                found, scores = found[scores >= bar], scores[scores >= bar]
            top = np.lexsort([found, -scores])[:k]
            out[0].extend([own] * len(top))
            out[1].extend(found[top])
            out[2].extend(scores[top])
        return out


def runs(batch: pa.RecordBatch, width: int):
    """(block, queries or not, ids, vectors) of the stretches of a batch that stand in one block and kind."""
    block, asks = batch.column("b").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
    ids = batch.column("vec_id").to_numpy()
    x = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(len(ids), width)
    edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1), len(ids)]
    for first, last in zip(edges, edges[1:]):
        if last > first:
            yield int(block[first]), bool(asks[first]), ids[first:last], x[first:last]


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``queries`` is true, against all rows but their own."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("x"),
        F.coalesce(queries, F.lit(False)).alias("asked"),
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("x")))
    shape = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    schema = "query_id long, vec_id long, score double"
    if shape is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n = shape["width"], shape["n"]
    rows = rows.filter(F.size("x") == width)
    sample = bounded_sample(rows.select("vec_id", "x"), n, "vec_id", SAMPLE_ROWS)
    top = rows.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))).first()[0]
    # an id counts once among the neighbours that the radius is fitted on
    model = learn(np.array(list({r["vec_id"]: r["x"] for r in sample}.values())), top, k)

    n_blocks = math.ceil(n / BLOCK_VECTORS)
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")
    indexed = rows.select(block.alias("b"), F.lit(False).alias("asks"), "vec_id", "x")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    questions = rows.filter("asked").select(every.alias("b"), F.lit(True).alias("asks"), "vec_id", "x")

    def run(batches):
        current, held, ready = None, [], None
        for batch in batches:
            for b, asks, ids, x in runs(batch, width):
                if b != current:
                    current, held, ready = b, [], None
                if not asks:
                    held.append((ids.copy(), x.copy()))
                elif held or ready is not None:
                    if ready is None:
                        ready, held = Block(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), model), []
                    found = ready.best(ids, x, k)
                    yield pa.record_batch(
                        {"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())}
                    )

    placed = indexed.unionByName(questions).repartition("b").sortWithinPartitions("b", "asks")
    near = placed.mapInArrow(run, schema)
    # rows that repeat a query's id ask alike; a neighbour counts once
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
