"""Linear machines and perceptrons of many variants fitted side by side, one pass over all rows a step.

A fit is a generator: it asks for sums at a point (loss and gradient over the training rows) and is sent them. Each
step adds up what all open fits ask for in one ``treeAggregate`` over stored blocks of rows, so the number of jobs is
that of the longest fit and not of all fits together. Only sums come to the driver: a few numbers per fit, whatever the
rows. Blocks are read from a written table, so lost ones are made again from it.

Rows with a null or not finite feature are left out, as by the assembler of the single fits. A column without spread
counts as 0. A variant without training or held-out rows has a null accuracy.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import split_rows
from tidemark.session import written

SEED = 12345
TRAIN_SHARE = 0.7
MEMORY = 10  # steps that the curvature is estimated from
PACKED = "variant string, width int, x binary, y binary, train binary"

Fit = Generator["Request", np.ndarray, float | None]


class Block(NamedTuple):
    """Rows of one variant: features (a last column of ones once scaled) and labels, for training and held out."""

    variant: str
    x: np.ndarray
    y: np.ndarray
    test_x: np.ndarray
    test_y: np.ndarray


class Request(NamedTuple):
    """What to sum at which weights; ``fixed`` are weights of an earlier phase of the fit."""

    sums: Callable[..., np.ndarray]
    weights: np.ndarray
    fixed: np.ndarray | None = None


# --- sums over one block -----------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, their column of ones as it is."""
    length = np.sqrt(np.einsum("ij,ij->i", x[:, :-1], x[:, :-1]))
    scaled = x / np.where(length > 0, length, 1.0)[:, None]
    scaled[:, -1] = 1.0
    return scaled


def _logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    return np.concatenate([[(np.logaddexp(0.0, z) - y * z).sum()], x.T @ (_sigmoid(z) - y)])


def _hinge_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    side = 2.0 * y - 1.0
    gap = 1.0 - side * (x @ w)
    short = gap > 0
    return np.concatenate([[gap[short].sum()], -(x.T @ (side * short))])


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.column_stack([x @ w, np.ones(len(x))])


def _layers(w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    hidden = (len(w) - 2) // (width + 2)
    return w[: width * hidden].reshape(width, hidden), w[width * hidden :].reshape(hidden + 1, 2)


def _forward(x: np.ndarray, w: np.ndarray):
    first, second = _layers(w, x.shape[1])
    hidden = np.column_stack([_sigmoid(x @ first), np.ones(len(x))])
    out = hidden @ second
    return hidden, out - np.logaddexp(out[:, :1], out[:, 1:]), second


def _perceptron_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    hidden, log_chance, second = _forward(x, w)
    wrong = np.exp(log_chance)
    loss = -np.where(y > 0.5, log_chance[:, 1], log_chance[:, 0]).sum()
    wrong[:, 1] -= y
    wrong[:, 0] -= 1.0 - y
    inner = hidden[:, :-1]
    back = (wrong @ second[:-1].T) * inner * (1.0 - inner)
    return np.concatenate([[loss], (x.T @ back).ravel(), (hidden.T @ wrong).ravel()])


def counted(block: Block, w, fixed) -> np.ndarray:
    return np.array([len(block.y), len(block.test_y)], dtype=float)


def totals(block: Block, w, fixed) -> np.ndarray:
    return np.concatenate([[len(block.y)], block.x.sum(axis=0)])


def squares(block: Block, mean, fixed) -> np.ndarray:
    return ((block.x - mean) ** 2).sum(axis=0)


def logistic_loss(block: Block, w, fixed) -> np.ndarray:
    return _logistic_sums(block.x, block.y, w)


def hinge_loss(block: Block, w, fixed) -> np.ndarray:
    return _hinge_sums(block.x, block.y, w)


def unit_hinge_loss(block: Block, w, fixed) -> np.ndarray:
    return _hinge_sums(_unit(block.x), block.y, w)


def calibration_loss(block: Block, w, fixed) -> np.ndarray:
    return _logistic_sums(_margin(block.x, fixed), block.y, w)


def unit_calibration_loss(block: Block, w, fixed) -> np.ndarray:
    return _logistic_sums(_margin(_unit(block.x), fixed), block.y, w)


def perceptron_loss(block: Block, w, fixed) -> np.ndarray:
    return _perceptron_sums(block.x, block.y, w)


def _hits(rise: np.ndarray, block: Block) -> np.ndarray:
    return np.array([(rise == (block.test_y > 0.5)).sum(), len(block.test_y)], dtype=float)


def linear_hits(block: Block, w, fixed) -> np.ndarray:
    return _hits(block.test_x @ w > 0, block)


def calibrated_hits(block: Block, w, fixed) -> np.ndarray:
    return _hits(_margin(block.test_x, fixed) @ w > 0, block)


def unit_calibrated_hits(block: Block, w, fixed) -> np.ndarray:
    return _hits(_margin(_unit(block.test_x), fixed) @ w > 0, block)


def perceptron_hits(block: Block, w, fixed) -> np.ndarray:
    log_chance = _forward(block.test_x, w)[1]
    return _hits(log_chance[:, 1] > log_chance[:, 0], block)


# --- fits --------------------------------------------------------------------------


def _newton_like(slope: np.ndarray, past: deque) -> np.ndarray:
    """The slope times the inverse curvature that the last steps suggest."""
    out, used = slope.copy(), []
    for step, bend in reversed(past):
        share = (step @ out) / (step @ bend)
        out -= share * bend
        used.append(share)
    if past:
        step, bend = past[-1]
        out *= (step @ bend) / (bend @ bend)
    for (step, bend), share in zip(past, reversed(used)):
        out += step * (share - (bend @ out) / (step @ bend))
    return out


def minimised(loss, width: int, rows: float, penalty: float = 0.0, steps: int = 100, tolerance: float = 1e-6, fixed=None):
    """Weights of least mean loss by limited-memory steps with a bisecting line search; the last weight has no penalty."""

    def objective(answer: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
        bound = np.append(at[:-1], 0.0)
        return answer[0] / rows + 0.5 * penalty * bound @ bound, answer[1:] / rows + penalty * bound

    w = np.zeros(width)
    value, slope = objective((yield Request(loss, w, fixed)), w)
    past: deque = deque(maxlen=MEMORY)
    for _ in range(steps):
        way = -_newton_like(slope, past)
        fall = slope @ way
        if fall >= -1e-12:
            break
        low, high = 0.0, None
        size = 1.0 if past else min(1.0, 1.0 / np.sqrt(slope @ slope))
        for _ in range(20):
            trial = w + size * way
            reached, trial_slope = objective((yield Request(loss, trial, fixed)), trial)
            if reached > value + 1e-4 * size * fall:
                high = size
            elif trial_slope @ way < 0.9 * fall:
                low = size
            else:
                break
            size = 2.0 * low if high is None else (low + high) / 2.0
        if reached >= value:
            break
        step, bend = trial - w, trial_slope - slope
        if step @ bend > 1e-12:
            past.append((step, bend))
        gained, w, value, slope = value - reached, trial, reached, trial_slope
        if gained <= tolerance * max(abs(value), 1.0):
            break
    return w


def _accuracy(hits: np.ndarray) -> float | None:
    return float(hits[0] / hits[1]) if hits[1] else None


def logistic(width: int, rows: float) -> Fit:
    w = yield from minimised(logistic_loss, width, rows, 1e-8)
    return _accuracy((yield Request(linear_hits, w)))


def margin_machine(width: int, rows: float, normalised: bool = False, calibrated: bool = True, cost: float = 1.0) -> Fit:
    """``cost`` weighs the summed hinge losses against half the squared length of the weights."""
    loss, calibration, hits = (
        (unit_hinge_loss, unit_calibration_loss, unit_calibrated_hits) if normalised else (hinge_loss, calibration_loss, calibrated_hits)
    )
    w = yield from minimised(loss, width, rows, 1.0 / (cost * rows))
    if not calibrated:
        return _accuracy((yield Request(linear_hits, w)))
    line = yield from minimised(calibration, 2, rows, fixed=w)
    return _accuracy((yield Request(hits, line, w)))


def perceptron(width: int, rows: float, rate: float, hidden: int, epochs: int = 500) -> Fit:
    """One hidden layer; the learning rate falls with the root of the epoch, as in the single fits."""
    draw = np.random.default_rng(SEED)
    sizes = ((width, hidden), (hidden + 1, 2))
    w = np.concatenate([draw.uniform(-2.4, 2.4, a * b) / a for a, b in sizes])
    for epoch in range(1, epochs + 1):
        w = w - rate / np.sqrt(epoch) * (yield Request(perceptron_loss, w))[1:] / rows
    return _accuracy((yield Request(perceptron_hits, w)))


def machines(epochs: int = 500) -> dict[str, Callable[[int, float], Fit]]:
    """The classifiers of the comparison that are fitted by sums over rows: all but the forest."""
    found: dict[str, Callable[[int, float], Fit]] = {
        "logistic": logistic,
        "svm_linear": margin_machine,
        "svm_normalised": lambda width, rows: margin_machine(width, rows, normalised=True),
        "svm_labelled_rbf": lambda width, rows: margin_machine(width, rows, calibrated=False),
    }
    for rate in (0.1, 0.3):
        for hidden in (1, 3):
            found[f"perceptron_{rate}_{hidden}"] = lambda width, rows, r=rate, h=hidden: perceptron(width, rows, r, h, epochs)
    return found


# --- passes ------------------------------------------------------------------------


def packed(spark: SparkSession, grid: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows of the grid as written blocks of one variant each, with that variant's own columns."""
    names = sorted({c for own in columns.values() for c in own})
    split = split_rows(grid.filter(F.col("variant").isin(*columns)), TRAIN_SHARE, "symbol", "trade_date", "horizon")
    doubles = [F.col(c).cast("double").alias(c) for c in names]
    rows = split.filter("label is not null").select("variant", (F.col("part") == "train").alias("train_"), F.col("label").alias("label_"), *doubles)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for variant, part in batch.groupby("variant"):
                x = part[list(columns[variant])].to_numpy(float)
                whole = np.isfinite(x).all(axis=1)
                y, train = part["label_"].to_numpy(float)[whole], part["train_"].to_numpy(bool)[whole]
                block = (variant, x.shape[1], x[whole].tobytes(), y.tobytes(), train.tobytes())
                yield pd.DataFrame([block], columns=["variant", "width", "x", "y", "train"])

    return written(spark, rows.mapInPandas(pack, PACKED))


def _opened(row) -> Block:
    x = np.frombuffer(bytes(row.x)).reshape(-1, row.width)
    y, train = np.frombuffer(bytes(row.y)), np.frombuffer(bytes(row.train), dtype=bool)
    return Block(row.variant, x[train], y[train], x[~train], y[~train])


def blocks_of(spark: SparkSession, grid: DataFrame, columns: Mapping[str, Sequence[str]]) -> RDD:
    return packed(spark, grid, columns).rdd.map(_opened)


def summed(blocks: RDD, asked: Mapping[tuple[str, str], Request]) -> dict[tuple[str, str], np.ndarray]:
    """What every (variant, name) asks for, over all blocks of its variant, in one pass."""
    by_variant: dict[str, dict[str, Request]] = {}
    for (variant, name), request in asked.items():
        by_variant.setdefault(variant, {})[name] = request
    shared = blocks.context.broadcast(by_variant)

    def add(total: dict, block: Block) -> dict:
        for name, request in shared.value.get(block.variant, {}).items():
            part = request.sums(block, request.weights, request.fixed)
            key = (block.variant, name)
            total[key] = total[key] + part if key in total else part
        return total

    def merge(one: dict, other: dict) -> dict:
        for key, part in other.items():
            one[key] = one[key] + part if key in one else part
        return one

    found = blocks.treeAggregate({}, add, merge)
    shared.destroy()
    return found


def row_counts(blocks: RDD, variants: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Training and held-out rows of every variant that has rows."""
    found = summed(blocks, {(v, ""): Request(counted, np.zeros(0)) for v in variants})
    return {v: (int(n[0]), int(n[1])) for (v, _), n in found.items()}


def scaled(blocks: RDD, variants: Sequence[str]) -> tuple[RDD, dict[str, tuple[int, float]]]:
    """Blocks with mean 0 and deviation 1 over the training rows and a column of ones; width and rows by variant."""
    first = {v: s for (v, _), s in summed(blocks, {(v, ""): Request(totals, np.zeros(0)) for v in variants}).items() if s[0]}
    means = {v: s[1:] / s[0] for v, s in first.items()}
    spread = summed(blocks, {(v, ""): Request(squares, m) for v, m in means.items()})
    scale = {}
    for (v, _), s in spread.items():
        deviation = np.sqrt(s / max(first[v][0] - 1.0, 1.0))
        scale[v] = means[v], np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    shared = blocks.context.broadcast(scale)

    def rescaled(block: Block) -> Block:
        mean, factor = shared.value[block.variant]
        x, test_x = (np.column_stack([(a - mean) * factor, np.ones(len(a))]) for a in (block.x, block.test_x))
        return block._replace(x=x, test_x=test_x)

    kept = blocks.filter(lambda block: block.variant in shared.value).map(rescaled)
    return kept, {v: (len(m) + 1, first[v][0]) for v, m in means.items()}


def fitted(blocks: RDD, fits: Mapping[tuple[str, str], Fit]) -> dict[tuple[str, str], float | None]:
    """Runs all fits step by step until the last one ends."""
    scores: dict[tuple[str, str], float | None] = {}
    asked = {key: next(fit) for key, fit in fits.items()}
    while asked:
        answers, further = summed(blocks, asked), {}
        for key in asked:
            try:
                further[key] = fits[key].send(answers[key])
            except StopIteration as end:
                scores[key] = end.value
        asked = further
    return scores


def held_out_accuracies(
    spark: SparkSession,
    grid: DataFrame,
    columns: Mapping[str, Sequence[str]],
    fits: Mapping[str, Callable[[int, float], Fit]],
) -> DataFrame:
    """(variant, classifier, accuracy) of every classifier on the held-out rows of every variant of ``columns``."""
    blocks, sizes = scaled(blocks_of(spark, grid, columns), list(columns))
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = fitted(blocks, {(v, name): fit(*size) for v, size in sizes.items() for name, fit in fits.items()})
    finally:
        blocks.unpersist()
    rows = [(v, name, found.get((v, name))) for v in columns for name in fits]
    return spark.createDataFrame(rows, "variant string, classifier string, accuracy double")
