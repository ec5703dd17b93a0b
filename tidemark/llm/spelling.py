"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles over code-point matrices.

Two words differ by one inserted, deleted or replaced code point exactly if their common prefix and common suffix
together reach the length of the longer word minus one. Be that length M. Then the common suffix has two thirds of
M - 1 code points, or the common prefix has, or both have the rest; so words meet by (M, kind, prefix, suffix), a
word of length L for M = L and M = L + 1, and every pair is taken where the first of the three holds.

Words sorted by these keys are read in blocks. A block is two padded matrices of code points, one aligned at the
start and one at the end of the words; pairs of blocks that share a key are compared column by column, all rows
against all rows. Groups of more than HOT words are split into slots by hash, and every pair of slots is a group of
its own. Only pairs one edit apart leave a task, as sums per word.

Defined results: null and empty texts have no words; a null id counts as an empty string; repeated rows count again.
Texts of any length are read in parts cut between runs. Only the id and the text are read, so other columns cannot
clash. A table without words gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import written

# Production parameters.
MIN_LENGTH = 7
MIN_COUNT = 2
DROP_EVERY = 31
FACTOR = 10
RUN = "A-Za-zÀ-ÿ"
# Words per block, words of a group before it is split, and shares of a hot key in the join that splits it.
BLOCK = 128
HOT = 4096
SALTS = 32
# Code points of one matrix; longer words stand in blocks of fewer rows.
BLOCK_CELLS = 1 << 16
# Distinct words that a task sums before it passes them on, and characters of text read at once.
KEPT_WORDS = 400_000
CHUNK_CHARS = 1 << 20


def _parts(text: str, end: re.Pattern) -> Iterator[str]:
    """A long text in parts that end between runs."""
    start = 0
    while len(text) - start > CHUNK_CHARS:
        cut = end.search(text, start + CHUNK_CHARS)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def count_words(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): runs with A-Z lower-cased, every ``drop_every``-th by hash without one code point."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, end = re.compile(f"[{RUN}]{{{min_length},}}"), re.compile(f"[^{RUN}]")
        total: dict[str, int] = {}
        for batch in tables:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lead = zlib.crc32(f"{'' if key is None else key}:".encode())
                # lower() of bytes changes A-Z only
                for part in _parts((text.as_py() or "").encode().lower().decode(), end):
                    for word, n in Counter(runs.findall(part)).items():
                        h = zlib.crc32(word.encode(), lead)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                        total[word] = total.get(word, 0) + n
                if len(total) > KEPT_WORDS:
                    yield _counts(total)
                    total = {}
        yield _counts(total)

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(total: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def _bounds(longer):
    """Code points of the long prefix or suffix, and of each side in the middle, for a longer word of that length."""
    most = (2 * (longer - 1) + 2) // 3
    return most, longer - most


def _keyed(words: DataFrame) -> DataFrame:
    """(key, longer, kind, word, n): six rows per word."""
    size = F.length("word")

    def key(longer: Column, kind: int) -> Column:
        most = F.floor((2 * (longer - 1) + 2) / 3).cast("int")
        head = [F.lit(0), longer - most, most][kind]
        tail = [most, longer - most, F.lit(0)][kind]
        ends = [F.substring("word", F.lit(1), head), F.substring("word", size - tail + 1, tail)]
        return F.struct(F.xxhash64(longer, F.lit(kind), *ends).alias("key"), longer.alias("longer"), F.lit(kind).alias("kind"))

    keys = F.explode(F.array(*[key(size + more, kind) for more in (0, 1) for kind in range(3)]))
    return words.select(keys.alias("k"), "word", "n").select("k.*", "word", "n")


def _slotted(keyed: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, low, high, slot, longer, kind, word, n): groups of more than ``hot`` words become pairs of slots."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > hot)
    # a hot key meets its rows in SALTS shares, by hash of the word
    slots = F.ceil(F.col("size") / hot).cast("int").alias("slots")
    sizes = written(keyed.sparkSession, sizes.select(F.col("key").alias("h_key"), slots))
    sizes = sizes.withColumn("h_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
    met = salted.join(sizes, (F.col("key") == F.col("h_key")) & (F.col("salt") == F.col("h_salt")), "left")
    met = met.withColumn("slots", F.coalesce("slots", F.lit(1))).withColumn("slot", F.pmod(F.xxhash64("word", F.lit(1)), F.col("slots")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("other")
    met = met.select("key", "slot", others, "longer", "kind", "word", "n")
    return met.select("key", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"), "slot", "longer", "kind", "word", "n")


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words aligned at their starts and at their ends, padded with zeros, and their lengths."""
    sizes = np.array(list(map(len, words)), dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    if points.max(initial=0) < 256:
        points = points.astype(np.uint8)
    width = int(sizes.max(initial=0))
    head, tail = np.zeros((2, len(words), width), points.dtype)
    at = np.arange(width)
    head[at < sizes[:, None]] = points
    tail[at >= width - sizes[:, None]] = points
    return head, tail, sizes


def _common(a: np.ndarray, b: np.ndarray, alive: np.ndarray, columns) -> np.ndarray:
    """Number of leading ``columns`` in which rows of ``a`` and ``b`` agree, for the pairs that are ``alive``."""
    alive, length = alive.copy(), np.zeros(alive.shape, np.int32)
    for step, at in enumerate(columns):
        alive &= a[:, at][:, None] == b[:, at][None, :]
        length += alive
        if step % 4 == 3 and not alive.any():
            break
    return length


def tile(a: tuple, b: tuple, same: np.ndarray, longer: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which pairs of rows of two blocks are one edit apart and belong to this kind of key.

    A block is (head, tail, sizes); ``same`` holds the pairs to compare, ``longer`` and ``kind`` describe a's rows.
    """
    (head_a, tail_a, size_a), (head_b, tail_b, size_b) = a, b
    # a pair of two words that are both shorter than ``longer`` belongs to another key
    most = np.maximum(size_a[:, None], size_b[None, :])
    least = np.minimum(size_a[:, None], size_b[None, :])
    same = same & (most == longer[:, None]) & (most - least <= 1)
    width = min(head_a.shape[1], head_b.shape[1])
    # padding agrees with padding behind both ends, so common parts end with the shorter word
    prefix = np.minimum(_common(head_a, head_b, same, range(width)), least)
    suffix = np.minimum(_common(tail_a, tail_b, same, range(-1, -width - 1, -1)), least)
    long, rest = _bounds(longer)
    by_suffix, by_prefix = suffix >= long[:, None], prefix >= long[:, None]
    middle = (prefix >= rest[:, None]) & (suffix >= rest[:, None])
    first = np.where(by_suffix, 0, np.where(middle, 1, np.where(by_prefix, 2, 3)))
    return same & (prefix + suffix >= most - 1) & (first == kind[:, None])


def _near_in(rows: dict) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the rows of all pairs one edit apart; ``rows`` hold whole groups, sorted."""
    words, longer, kind, group = rows["word"], rows["longer"], rows["kind"], rows["group"]
    slot, split = rows["slot"], rows["low"] != rows["high"]
    starts, n = [], len(words)
    at = 0
    while at < n:
        starts.append(at)
        # rows are sorted by length first, so the last row of a block is among its longest
        step = BLOCK
        while step > 1 and int(longer[min(at + step, n) - 1]) * step > BLOCK_CELLS:
            step //= 2
        at += step
    edges = [*starts, n]
    left, right = [], []
    blocks: dict[int, tuple] = {}
    for i, first in enumerate(starts):
        a = slice(first, edges[i + 1])
        blocks = {k: v for k, v in blocks.items() if k >= i}
        for j in range(i, len(starts)):
            b = slice(starts[j], edges[j + 1])
            if group[b.start] > group[a.stop - 1]:
                break
            for k, part in ((i, a), (j, b)):
                if k not in blocks:
                    blocks[k] = matrices(words[part])
            same = group[a][:, None] == group[b][None, :]
            same &= ~split[a][:, None] | (slot[a][:, None] != slot[b][None, :])
            if i == j:
                same = np.triu(same, 1)
            if same.any():
                x, y = np.nonzero(tile(blocks[i], blocks[j], same, longer[a], kind[a]))
                left.append(x + a.start)
                right.append(y + b.start)
            if len(blocks) > 256:
                blocks.pop(j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


NEAR = "word string, n_near long, best_n long, best string"


def near(words: DataFrame, hot: int = HOT) -> DataFrame:
    """NEAR per word with a near word: how many it has, and the commonest of them (ties: smallest)."""
    slotted = _slotted(_keyed(words), hot)
    ordered = slotted.repartition("key", "low", "high").sortWithinPartitions("longer", "key", "low", "high")

    def found(table: pa.Table) -> pa.RecordBatch:
        rows = {c: table.column(c).to_numpy() for c in ("key", "low", "high", "slot", "longer", "kind", "n")}
        rows["word"] = table.column("word").to_pylist()
        change = np.zeros(table.num_rows, bool)
        for c in ("longer", "key", "low", "high"):
            change[1:] |= rows[c][1:] != rows[c][:-1]
        rows["group"] = np.cumsum(change)
        left, right = _near_in(rows)
        source, other = np.concatenate([left, right]), np.concatenate([right, left])
        # one row per word and task: its number of near words and the best of them
        ids, at = np.unique(np.concatenate([source, other]), return_inverse=True)
        names = [rows["word"][i] for i in ids.tolist()]
        rank = {w: k for k, w in enumerate(sorted(set(names)))}
        ranks = np.array([rank[w] for w in names], dtype=np.int64)
        name_of = sorted(rank)
        source, other = ranks[at[: len(source)]], at[len(source) :]
        counts = rows["n"][ids][other] if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((ranks[other] if len(ids) else other, -counts, source))
        first = order[np.flatnonzero(np.diff(source[order], prepend=-1))] if len(order) else order
        n_near = np.bincount(source, minlength=len(name_of))[source[first]] if len(order) else order
        columns = [
            pa.array([name_of[i] for i in source[first].tolist()], pa.string()),
            pa.array(n_near, pa.int64()),
            pa.array(counts[first], pa.int64()),
            pa.array([names[i] for i in other[first].tolist()], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NEAR.split(", ")])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a group may go on in the next batch: its rows wait for it
        kept: list[pa.RecordBatch] = []
        for batch in tables:
            if not batch.num_rows:
                continue
            differs = np.zeros(batch.num_rows, bool)
            for c in ("longer", "key", "low", "high"):
                values = batch.column(c).to_numpy()
                differs |= values != values[-1]
                last = kept[-1].column(c)[-1].as_py() if kept else None
                if kept and last != values[0]:
                    yield found(pa.Table.from_batches(kept))
                    kept = []
            whole = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if whole:
                yield found(pa.Table.from_batches([*kept, batch.slice(0, whole)]))
                kept = []
            kept.append(batch.slice(whole))
        if kept:
            yield found(pa.Table.from_batches(kept))

    per_task = ordered.mapInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best"))).alias("b")
    summed = per_task.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last by joining every word with its own target.

    Each join doubles the steps; a form is FACTOR times as frequent, so chains are short. Every round is written.
    """
    steps = written(spark, forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not steps.filter("moved").isEmpty():
        ahead = steps.select(F.col("word").alias("a_word"), F.col("root").alias("a_root"))
        joined = steps.join(ahead, F.col("root") == F.col("a_word"), "left")
        steps = written(spark, joined.select("word", F.coalesce("a_root", "root").alias("root"), F.col("a_root").isNotNull().alias("moved")))
    return steps.select("word", "root")


def variants(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT, factor: int = FACTOR, drop_every: int = DROP_EVERY, hot: int = HOT,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = written(spark, count_words(df, id_col, text, min_length, drop_every).filter(F.col("n") >= min_count))
    is_form = F.col("best_n") >= factor * F.col("n")
    found = near(words, hot).withColumnRenamed("word", "n_word")
    joined = words.join(found, F.col("word") == F.col("n_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    joined = written(spark, joined)
    last = roots(spark, joined.filter("form is not null")).withColumnRenamed("word", "r_word")
    out = joined.join(last, F.col("word") == F.col("r_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
