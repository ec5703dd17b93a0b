"""Deep forests measured on held-out rows: a task grows some trees of one variant, all their nodes a level at once.

Features become bins of one byte, between quantiles of the training rows. A tree draws its rows with Poisson weights; a
node asks the root of its columns, drawn anew, for the bound of largest Gini gain, and is a leaf if it is pure, none gains
or ``DEPTH`` is reached. Held-out rows go down with the others, so a task returns the votes of its trees and no tree is kept.

A tree's rows meet in one task, as bytes: a variant has a row per symbol, day and horizon, however many trades there
are. Tasks take fewer trees where the rows are more. Rows with a null or not finite feature are left out, as by the
assembler of the single fits; a variant without training or held-out rows has a null accuracy.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import split_rows
from tidemark.operators.shared_fits import SEED, TRAIN_SHARE, packed
from tidemark.session import written

TREES = 100
DEPTH = 30
BINS = 32
# Rows of all trees of a task.
TASK_ROWS = 400_000
BLOCKS = "variant string, block long, width int, x binary, y binary, train binary"
VOTES = "variant string, block long, place int, label double, rise double"


def bounds_of(grid: DataFrame, columns: Mapping[str, Sequence[str]]) -> tuple[dict[str, int], dict[str, list[np.ndarray]]]:
    """Training rows of every variant, and the bounds of each of its columns' bins: BINS - 1 numbers at most."""
    split = split_rows(grid.filter(F.col("variant").isin(*columns)), TRAIN_SHARE, "symbol", "trade_date", "horizon")
    names = sorted({c for own in columns.values() for c in own})
    shares = [i / BINS for i in range(1, BINS)]
    quantiles = [F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in names]
    train = split.filter("part = 'train' and label is not null")
    found = train.groupBy("variant").agg(F.count(F.lit(1)).alias("rows_"), *quantiles).collect()
    return (
        {r["variant"]: r["rows_"] for r in found},
        {r["variant"]: [np.unique(np.array(r[c] or [], dtype=float)) for c in columns[r["variant"]]] for r in found},
    )


def binned(spark: SparkSession, blocks: DataFrame, bounds: Mapping[str, Sequence[np.ndarray]]) -> DataFrame:
    """Blocks with features as bins, and with a number that no other block of the written table has."""
    types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"]).reshape(-1, r["width"])
                codes = [np.searchsorted(b, x[:, k], "left") for k, b in enumerate(bounds.get(r["variant"], ()))]
                if codes:
                    rows.append((r["variant"], number, r["width"], np.column_stack(codes).astype(np.uint8).tobytes(), r["y"], r["train"]))
                    number += 1
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return written(spark, blocks.mapInArrow(run, BLOCKS))


def _best_splits(x, row, node, w, rises, n_nodes: int, draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, last bin to the left, and whether there is a gain, for every node; its rows are given by ``row`` and ``node``."""
    width = x.shape[1]
    asked = int(np.ceil(np.sqrt(width)))
    chosen = np.argpartition(draw.random((n_nodes, width)), asked - 1, axis=1)[:, :asked]
    # the columns are dealt out of order, so equal gains do not favour the first ones
    total, total_1 = np.bincount(node, w, n_nodes), np.bincount(node, rises, n_nodes)
    pure = (total_1**2 + (total - total_1) ** 2) / total
    top, column, last = pure + 1e-9 * total, np.zeros(n_nodes, np.int64), np.full(n_nodes, -1)
    each = np.arange(n_nodes)
    for j in range(asked):
        key = node * BINS + x[row, chosen[node, j]]
        left = np.bincount(key, w, n_nodes * BINS).reshape(n_nodes, BINS).cumsum(axis=1)[:, :-1]
        left_1 = np.bincount(key, rises, n_nodes * BINS).reshape(n_nodes, BINS).cumsum(axis=1)[:, :-1]
        right, right_1 = total[:, None] - left, total_1[:, None] - left_1
        score = (left_1**2 + (left - left_1) ** 2) / np.maximum(left, 1.0) + (right_1**2 + (right - right_1) ** 2) / np.maximum(right, 1.0)
        at = score.argmax(axis=1)
        more = score[each, at] > top
        top[more], column[more], last[more] = score[each, at][more], chosen[more, j], at[more]
    return column, last, last >= 0


def votes(x: np.ndarray, y: np.ndarray, test_x: np.ndarray, trees: Sequence[int], depth: int = DEPTH) -> np.ndarray:
    """For every held-out row, the shares of rising rows in the leaves it reaches, added up over ``trees``."""
    draw = np.random.default_rng([SEED, TREES, trees[0]])
    weights = np.stack([np.random.default_rng([SEED, t]).poisson(1.0, len(y)) for t in trees])
    node, row = np.nonzero(weights)
    w = weights[node, row].astype(float)
    rises = w * y[row]
    test_node, test_row = np.repeat(np.arange(len(trees)), len(test_x)), np.tile(np.arange(len(test_x)), len(trees))
    found, n_nodes = np.zeros(len(test_x)), len(trees)
    for level in range(depth + 1):
        total, total_1 = np.bincount(node, w, n_nodes), np.bincount(node, rises, n_nodes)
        share = np.divide(total_1, total, out=np.full(n_nodes, 0.5), where=total > 0)
        column, last, splits = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64), (total_1 > 0) & (total_1 < total)
        if level == depth:
            splits[:] = False
        mixed = np.flatnonzero(splits)
        if len(mixed):
            own, inside = np.cumsum(splits) - 1, splits[node]
            args = row[inside], own[node[inside]], w[inside], rises[inside]
            column[mixed], last[mixed], splits[mixed] = _best_splits(x, *args, len(mixed), draw)
        done = ~splits[test_node]
        found += np.bincount(test_row[done], share[test_node[done]], len(test_x))
        if not splits.any():
            break
        own, inside, ahead = np.cumsum(splits) - 1, splits[node], ~done
        row, w, rises, node = row[inside], w[inside], rises[inside], node[inside]
        node = 2 * own[node] + (x[row, column[node]] > last[node])
        test_row, test_node = test_row[ahead], test_node[ahead]
        test_node = 2 * own[test_node] + (test_x[test_row, column[test_node]] > last[test_node])
        n_nodes = 2 * int(splits.sum())
    return found


def held_out_votes(blocks: DataFrame, rows: Mapping[str, int], trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """VOTES of every held-out row, one row per task that grew some of its variant's trees."""
    per_task = {v: max(1, min(trees, TASK_ROWS // max(n, 1))) for v, n in rows.items()}
    shares = [(v, first, min(first + n, trees)) for v, n in per_task.items() for first in range(0, trees, n)]
    spark = blocks.sparkSession
    dealt = blocks.join(F.broadcast(spark.createDataFrame(shares, "variant string, first int, end int")), "variant")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        width, first, end = (table.column(c)[0].as_py() for c in ("width", "first", "end"))
        sizes = [len(t) for t in table.column("train").to_pylist()]
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(-1, width)
        y = np.frombuffer(b"".join(table.column("y").to_pylist()))
        train = np.frombuffer(b"".join(table.column("train").to_pylist()), bool)
        number = np.repeat(table.column("block").to_numpy(), sizes)
        place = np.concatenate([np.arange(n) for n in sizes])
        rise = votes(x[train], y[train], x[~train], range(first, end), depth)
        named = pa.repeat(table.column("variant")[0], len(rise))
        return pa.table({"variant": named, "block": number[~train], "place": pa.array(place[~train], pa.int32()), "label": y[~train], "rise": rise})

    # a number of partitions that is not brought down to the few that the bytes would fill
    spread = dealt.repartition(max(2 * len(shares), 1), "variant", "first")
    return spread.groupBy("variant", "first").applyInArrow(run, VOTES)


def held_out_accuracies(
    spark: SparkSession, grid: DataFrame, columns: Mapping[str, Sequence[str]], name: str = "random_forest", trees: int = TREES, depth: int = DEPTH
) -> DataFrame:
    """(variant, classifier, accuracy) of a forest on the held-out rows of every variant of ``columns``."""
    rows, bounds = bounds_of(grid, columns)
    blocks = binned(spark, packed(spark, grid, columns), bounds)
    voted = held_out_votes(blocks, rows, trees, depth).groupBy("variant", "block", "place")
    summed = voted.agg(F.first("label").alias("label"), F.sum("rise").alias("rise"))
    hit = ((F.col("rise") > trees / 2) == (F.col("label") > 0.5)).cast("double")
    scored = summed.groupBy("variant").agg(F.avg(hit).alias("accuracy"))
    names = spark.createDataFrame([(v,) for v in columns], "variant string")
    return names.join(scored, "variant", "left").select("variant", F.lit(name).alias("classifier"), "accuracy")
