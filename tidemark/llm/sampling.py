"""Distinct sampled segmentations by Gumbel top-k: perturbed A-star search over the lattices of a text.

Every segmentation has its log probability plus Gumbel noise as key, and the k largest keys are the sample: k
distinct segmentations, drawn without replacement. No segmentation is listed for that. The largest key under
a node of the lattice is Gumbel distributed around the node's log probability, which the lattice's totals give
exactly; so the search keeps, for every node of the paths found so far, an exact key of the best way that leaves
the path there, and opens the largest one next. What leaves a path is drawn below the key of the path.

All texts of a batch are searched together. Random numbers are hashes of the row's key, the sample's number and
the place in the text, so a row's samples do not depend on its batch, task or attempt.

The inclusion score of a sample is the log probability of being among the k, given the largest key left out:
log(1 - exp(-exp(log p - key))).

Defined results: a null or empty text has one segmentation, the empty one, with probability 1; a text with fewer
than k segmentations returns all it has, each with inclusion 1; equal keys and texts get equal samples; a null
key is a key of its own. Characters without a piece are spelled in bytes, or unknown if the model has no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_others, mix64, uniform
from tidemark.llm.lattice import Lattices, Pieces, decode, pieces
from tidemark.llm.wordcache import by_size

# Production parameters.
K = 2
SEED = 99
CHUNK_CHARS = 1 << 17
# Nodes of a path that get a key of their own; all later ones share one until it is opened.
OWN_KEYS = 64
_ODD = np.uint64(0xA0761D6478BD642F)
# What numbers are drawn for.
WALK, LEAVE, REST, FIRST, TURN, AGAIN, OPEN = range(7)


def _streams(keys: np.ndarray, use: int, sample: int) -> np.ndarray:
    """A stream of random numbers per row for one use in one sample."""
    with np.errstate(over="ignore"):
        return mix64(keys + np.uint64(8 * sample + use + 1) * _ODD)


def _noise(streams: np.ndarray, place) -> np.ndarray:
    """Uniform numbers at places of streams."""
    with np.errstate(over="ignore"):
        return uniform(mix64(streams + np.asarray(place).astype(np.uint64) * _ODD))


def _below(location: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers around ``location``, given that they are at most ``limit``; -inf where the location is."""
    with np.errstate(invalid="ignore", over="ignore"):
        drawn = location - np.log(np.exp(location - limit) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, drawn)


class _Path:
    """One sample of every text: edges in order, and keys of the ways that leave it.

    The first OWN_KEYS nodes from ``since`` on have keys of their own. The ways that leave later are one more
    group: their total is the probability up to there less the path's own.
    """

    def __init__(self, lattices: Lattices, edges, bounds, since):
        self.lattices, self.edges, self.bounds, self.since = lattices, edges, bounds, since
        logs = np.log(lattices.p[edges])
        # a running sum of its own per text, so that no text depends on those before it
        self.run, self.total = np.zeros(len(edges)), np.zeros(len(bounds) - 1)
        for text in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[text], bounds[text + 1]
            run = np.cumsum(logs[a:b])
            self.run[a + 1 : b], self.total[text] = run[:-1], run[-1]
        self.used: dict[int, list[int]] = {}
        self.opened: dict[int, np.ndarray] = {}

    def before(self, at):
        """Log probability of a text's path up to edge number ``at`` of all edges."""
        return self.run[at]

    def _locations(self, at):
        """Log probabilities of leaving the path at edges ``at``; -inf where there is no other edge."""
        e = self.edges[at]
        node = self.lattices.source[e]
        rest = 1.0 - self.lattices.p[e]
        # next to 1 the difference has few digits: the other edges are summed
        close = np.flatnonzero((rest < 1e-4) & (self.lattices.count[node] > 1))
        if len(close):
            size = self.lattices.count[node[close]]
            every = np.repeat(self.lattices.edge[node[close]], size) + _ramp(size)
            others = np.where(every == np.repeat(e[close], size), 0.0, self.lattices.p[every])
            rest[close] = np.add.reduceat(others, np.cumsum(size) - size)
        sole = (self.lattices.count[node] == 1) | (rest <= 0)
        return np.where(sole, -np.inf, self.before(at) + np.log(np.where(sole, 1.0, rest)))

    def leave(self, keys: np.ndarray, limit: np.ndarray, sample: int) -> None:
        """Draws the keys of leaving, below ``limit`` per text. Column OWN_KEYS is the group of the later ones."""
        n = len(limit)
        size = np.diff(self.bounds)
        own = np.clip(size - self.since, 0, OWN_KEYS)
        text = np.repeat(np.arange(n), own)
        at = np.repeat(self.bounds[:-1] + self.since, own) + _ramp(own)
        self.keys = np.full((n, OWN_KEYS + 1), -np.inf)
        drawn = _below(self._locations(at), limit[text], _noise(_streams(keys, LEAVE, sample)[text], at - self.bounds[text]))
        self.keys[text, _ramp(own)] = drawn
        more = np.flatnonzero(size - self.since > OWN_KEYS)
        if len(more):
            mark = self.bounds[more] + self.since[more] + OWN_KEYS
            before = self.before(mark)
            with np.errstate(divide="ignore"):
                location = before + np.log(-np.expm1(np.minimum(self.total[more] - before, 0.0)))
            self.keys[more, OWN_KEYS] = _below(location, limit[more], _noise(_streams(keys, REST, sample)[more], 0))

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text the largest key and its column; columns behind OWN_KEYS are those of an opened group."""
        column = np.argmax(self.keys, axis=1)
        top = self.keys[np.arange(len(column)), column]
        for text, drawn in self.opened.items():
            at = int(np.argmax(drawn))
            if drawn[at] > top[text]:
                top[text], column[text] = drawn[at], OWN_KEYS + 1 + at
        return top, column

    def open_rest(self, text: int, keys: np.ndarray, sample: int) -> int:
        """Splits the group of a text's later nodes, whose key was the largest; returns the column it belongs to.

        The key goes to one node, drawn by probability; the other nodes get keys below it.
        """
        key = self.keys[text, OWN_KEYS]
        at = np.arange(self.bounds[text] + self.since[text] + OWN_KEYS, self.bounds[text + 1])
        location = self._locations(at)
        weight = np.exp(location - location.max())
        streams = np.repeat(_streams(keys[text : text + 1], OPEN, sample), len(at) + 1)
        u = _noise(streams, np.arange(len(at) + 1))
        chosen = min(int(np.searchsorted(np.cumsum(weight), u[-1] * weight.sum())), len(at) - 1)
        self.keys[text, OWN_KEYS] = -np.inf
        self.opened[text] = _below(location, np.full(len(at), key), u[:-1])
        self.opened[text][chosen] = key
        return OWN_KEYS + 1 + chosen

    def set_key(self, text: int, column: int, key: float) -> None:
        if column > OWN_KEYS:
            self.opened[text][column - OWN_KEYS - 1] = key
        else:
            self.keys[text, column] = key

    def edge_of(self, text: int, column: int) -> int:
        """The edge number of a column; those behind the group's column stand one further."""
        return int(self.bounds[text] + self.since[text]) + column - (column > OWN_KEYS)


def _walk(lattices: Lattices, start: np.ndarray, streams: np.ndarray, places: np.ndarray):
    """Edges drawn from ``start`` to the end of every unit, in the order of the units, and their numbers per unit."""
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    active = np.flatnonzero(start >= 0)
    at = start[active]
    while len(active):
        e = lattices.choose(at, _noise(streams[active], places[active] * 128 + len(steps)))
        steps.append((active, e))
        more = lattices.to[e] >= 0
        active, at = active[more], lattices.to[e[more]]
    count = np.zeros(len(start), np.int64)
    for who, _ in steps:
        count[who] += 1
    first = np.cumsum(count) - count
    edges = np.zeros(int(count.sum()), np.int64)
    for k, (who, e) in enumerate(steps):
        edges[first[who] + k] = e
    return edges, count


def search(lattices: Lattices, keys: np.ndarray, k: int) -> list[tuple]:
    """k rounds of (present, edges, bounds, log probability, key, log inclusion) over all texts."""
    n = len(lattices.first) - 1
    texts = np.arange(n)
    text = np.repeat(texts, np.diff(lattices.first))
    place = np.arange(len(lattices.begin)) - lattices.first[text]
    edges, count = _walk(lattices, lattices.begin, _streams(keys, WALK, 0)[text], place)
    unit_ends = np.concatenate([[0], np.cumsum(count)])
    paths = [_Path(lattices, edges, unit_ends[lattices.first], np.zeros(n, np.int64))]
    score = -np.log(-np.log(_noise(_streams(keys, FIRST, 0), 0)))
    paths[0].leave(keys, score, 0)
    found = [(np.ones(n, bool), paths[0], score)]
    # the unit of every edge, to go on behind a turn
    owners = [np.repeat(np.arange(len(lattices.begin)), count)]

    def frontier():
        tops = [p.best() for p in paths]
        top = np.stack([t for t, _ in tops])
        which = np.argmax(top, axis=0)
        return top[which, texts], which, np.stack([c for _, c in tops])[which, texts]

    for sample in range(1, k):
        top, which, column = frontier()
        present = np.isfinite(top)
        turn, at = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        resume = np.full(n, len(lattices.begin), np.int64)
        draws = _noise(_streams(keys, TURN, sample), 0)
        again = _noise(_streams(keys, AGAIN, sample), 0)
        for t in np.flatnonzero(present).tolist():
            path, col = paths[which[t]], int(column[t])
            if col == OWN_KEYS:
                col = path.open_rest(t, keys, sample)
            where = path.edge_of(t, col)
            node = lattices.source[path.edges[where]]
            used = path.used.setdefault(where, [int(path.edges[where])])
            options = [e for e in range(lattices.edge[node], lattices.edge[node] + lattices.count[node]) if e not in used]
            weights = [float(lattices.p[e]) for e in options]
            draw, chosen = draws[t] * sum(weights), options[-1]
            for e, w in zip(options, weights, strict=True):
                draw -= w
                if draw <= 0:
                    chosen = e
                    break
            used.append(chosen)
            turn[t], at[t], resume[t] = chosen, where, owners[which[t]][where]
            # what else leaves here lies below the key just taken
            rest = sum(w for e, w in zip(options, weights, strict=True) if e != chosen)
            location = path.before(where) + np.log(rest) if rest > 0 else -np.inf
            path.set_key(t, col, _below(np.array([location]), top[t : t + 1], again[t : t + 1])[0])
        # units behind the turn are drawn anew; the unit of the turn goes on where its edge ends
        turned = np.flatnonzero(present)
        begin = np.where((np.arange(len(text)) > resume[text]) & present[text], lattices.begin, -1)
        begin[resume[turned]] = lattices.to[turn[turned]]
        drawn, count = _walk(lattices, begin, _streams(keys, WALK, sample)[text], place)
        ends = np.concatenate([[0], np.cumsum(count)])[lattices.first]
        # a new path is the old one up to the turn, the turn, and what was drawn
        old_start = np.stack([p.bounds[:-1] for p in paths])[which, texts]
        kept = np.where(present, at - old_start, 0)
        bounds = np.concatenate([[0], np.cumsum(np.where(present, kept + 1 + np.diff(ends), 0))])
        edges, owner = np.zeros(bounds[-1], np.int64), np.zeros(bounds[-1], np.int64)
        for r, path in enumerate(paths):
            own = np.flatnonzero(present & (which == r))
            spot = np.repeat(bounds[own], kept[own]) + _ramp(kept[own])
            old = np.repeat(path.bounds[own], kept[own]) + _ramp(kept[own])
            edges[spot], owner[spot] = path.edges[old], owners[r][old]
        edges[bounds[turned] + kept[turned]] = turn[turned]
        owner[bounds[turned] + kept[turned]] = resume[turned]
        fresh = np.diff(ends)[turned]
        spot = np.repeat(bounds[turned] + kept[turned] + 1, fresh) + _ramp(fresh)
        old = np.repeat(ends[turned], fresh) + _ramp(fresh)
        edges[spot], owner[spot] = drawn[old], np.repeat(np.arange(len(text)), count)[old]
        path = _Path(lattices, edges, bounds, np.where(present, kept + 1, 0))
        path.leave(keys, np.where(present, top, 0.0), sample)
        paths.append(path)
        owners.append(owner)
        found.append((present, path, top))
    left_out = frontier()[0]
    out = []
    for present, path, key in found:
        with np.errstate(invalid="ignore"):
            rate = np.where(np.isneginf(left_out), np.inf, path.total - left_out)
        out.append((present, path.edges, path.bounds, path.total, key, _log_inclusion(rate)))
    return out


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _log_inclusion(rate: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(rate))), exact for very small and very large rates."""
    with np.errstate(over="ignore", divide="ignore"):
        power = np.exp(rate)
        return np.where(rate < -30, rate, np.where(rate > 4, -np.exp(-power), np.log(-np.expm1(-np.exp(np.minimum(rate, 700))))))


def sample_texts(model: Pieces, texts: list[str | None], keys: np.ndarray, k: int):
    """Columns of the samples of some texts: text number, sample, ids (flat), bounds, log probability, key, inclusion."""
    lattices = Lattices(model, texts)
    rows, samples, logs, tops, inclusions, flat, sizes = [], [], [], [], [], [], []
    for number, (present, edges, bounds, total, key, inclusion) in enumerate(search(lattices, keys, k)):
        ids, ends = lattices.ids_of(edges, bounds)
        who = np.flatnonzero(present)
        rows.append(who)
        samples.append(np.full(len(who), number, np.int32))
        logs.append(total[who])
        tops.append(key[who])
        inclusions.append(inclusion[who])
        flat.append(ids)
        sizes.append(np.diff(ends)[who])
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return np.concatenate(rows), np.concatenate(samples), np.concatenate(flat), ends, np.concatenate(logs), np.concatenate(tops), np.concatenate(inclusions)


SCHEMA = "sample int, n_tokens int, ids array<int>, log_prob double, perturbed double, log_inclusion double"


def sample(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", k: int = K, seed: int = SEED) -> DataFrame:
    """Up to k rows per input row: id, sample (0 is the largest key), n_tokens, ids, log_prob, perturbed, log_inclusion."""
    rows = df.select(F.col(id_col).alias(id_col), F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"), F.col(text).alias("text"))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("lattices")
        model = pieces(path)
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            texts = batch.column(2).to_pylist()
            for start, end in by_size(texts, CHUNK_CHARS):
                who, number, ids, ends, logs, tops, inclusion = sample_texts(model, texts[start:end], keys[start:end], k)
                # a bounded number of rows at a time, so that what waits for the JVM stays small
                for a in range(0, len(who), 4096):
                    b = min(a + 4096, len(who))
                    lists = pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), pa.array(ids[ends[a] : ends[b]], pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(who[a:b] + start)),
                            pa.array(number[a:b], pa.int32()),
                            pa.array(np.diff(ends[a : b + 1]), pa.int32()),
                            lists,
                            pa.array(logs[a:b], pa.float64()),
                            pa.array(tops[a:b], pa.float64()),
                            pa.array(inclusion[a:b], pa.float64()),
                        ],
                        names=[id_col, *[c.split()[0] for c in SCHEMA.split(", ")]],
                    )

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, {SCHEMA}")


def decoded(path: str):
    """An Arrow function from arrays of piece ids to text."""

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        model = pieces(path)
        return pa.array([None if row is None else decode(model, row) for row in ids.to_pylist()], pa.string())

    return run
