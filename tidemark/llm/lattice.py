"""Segmentation lattices of many texts at once, under the pieces of a SentencePiece model.

A text is normalised as the model says (blanks become U+2581, one stands in front) and cut into units in front of
every run of blanks; no piece crosses such a cut. Equal units share one lattice. Edges are found by walking all
start positions down the trie of the pieces together, and each position gets the log of the total weight of the ways
from it to its unit's end, from which the probability of each edge follows.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import keeps, mix64

SPACE = 0x2581
# Pieces of a BPE model carry merge ranks, not probabilities; they follow Zipf's law with this offset.
ZIPF_OFFSET = 10.0
# Positions of units whose lattices a worker keeps; about 100 bytes each.
KEPT_POSITIONS = 300_000
_MODELS: dict[str, Pieces] = {}
keeps("lattices", _MODELS.clear)


class Pieces:
    """Pieces of a model: ids, texts, log probabilities and a trie over their characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.unknown = n, sp.unk_id()
        byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = np.array([byte.get(b, self.unknown) for b in range(256)], dtype=np.int32)
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in normal], dtype=np.float64)
        if np.all(scores == np.round(scores)):
            # merge ranks; pieces that are no merges have a very low score and come last
            rank = np.minimum(-scores, float(n))
            logs = -np.log(rank + ZIPF_OFFSET)
        else:
            logs = scores
        self.byte_log = float(logs.min() - 10.0)
        logs = logs - np.log(np.exp(logs).sum())
        self.bytes = [b""] * n
        for i in normal:
            self.bytes[i] = sp.id_to_piece(i).replace("▁", " ").encode()
        for b, i in byte.items():
            self.bytes[i] = bytes([b])
        self.store = empty_store()
        self._grow([(sp.id_to_piece(i), i, lp) for i, lp in zip(normal, logs.tolist(), strict=True)])

    def _grow(self, pieces: list[tuple[str, int, float]]) -> None:
        chars = sorted({c for text, _, _ in pieces for c in text if len(text) > 1} | {"▁"})
        self.dense = np.zeros(0x110000, np.int16)
        self.dense[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        children: list[dict[int, int]] = [{}]
        ids, logs = [-1], [0.0]
        self.single = np.full(0x110000, -1, np.int32)
        self.single_log = np.zeros(0x110000, np.float32)
        for text, i, lp in pieces:
            if len(text) == 1:
                self.single[ord(text)], self.single_log[ord(text)] = i, lp
                continue
            node = 0
            for c in text:
                k = int(self.dense[ord(c)])
                if k not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    ids.append(-1)
                    logs.append(0.0)
                node = children[node][k]
            ids[node], logs[node] = i, lp
        # nodes with children get a row of the transition table; 0 means no way on
        inner = [i for i, c in enumerate(children) if c]
        self.row = np.zeros(len(children), np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.step = np.zeros((len(inner) + 1, len(chars) + 1), np.int32)
        for i in inner:
            for k, to in children[i].items():
                self.step[self.row[i], k] = to
        self.ids, self.logs = np.array(ids, np.int32), np.array(logs, np.float64)


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


class Lattices:
    """Lattices of the units of some texts.

    ``first`` has the first unit of every text, ``begin`` the first position of every unit's lattice. The ``count[i]``
    edges of position i start at ``edge[i]`` and have target positions ``to``, probabilities ``p`` and their running
    sums ``c`` per position. A target that ends the unit is -1. ``piece`` is -1 for an edge that spells its character
    in bytes. Lattices of units seen before come from the model's store and precede the new ones.
    """

    def __init__(self, model: Pieces, texts: list[str | None]):
        self.model = model
        values = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        sizes = np.array([len(v) for v in values], dtype=np.int64)
        ends = np.cumsum(sizes)
        cut = np.zeros(len(codes) + 1, bool)
        blank = codes == SPACE
        cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[0] = len(codes) > 0
        cut[ends - sizes] = True
        cut[-1] = False
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(codes)))
        self.first = np.searchsorted(begin, np.append(ends - sizes, len(codes)))
        keys, some, unit, times = self._distinct(codes, begin, length)
        store = model.store
        place = np.minimum(np.searchsorted(store["keys"], keys), max(0, len(store["keys"]) - 1))
        known = store["keys"][place] == keys if len(store["keys"]) else np.zeros(len(keys), bool)
        starts = np.empty(len(keys), np.int64)
        starts[known] = store["starts"][place[known]]
        room = len(store["codes"]) < KEPT_POSITIONS
        for kept in (True, False):
            # units that repeat go to the store while it has room; the others live as long as these texts
            new = np.flatnonzero(~known & ((times > 1) == kept)) if room else np.flatnonzero(~known) if not kept else known[:0]
            built = _build(model, codes, begin[some[new]], length[some[new]])
            starts[new] = built["starts"] + len(store["codes"])
            store = _joined(store, built, keys[new])
            if kept:
                model.store = store
        self.codes, self.edge, self.count, self.to, self.source, self.piece, self.p, self.c = (store[x] for x in FIELDS)
        self.begin = starts[unit]

    @staticmethod
    def _distinct(codes, begin, length):
        """Sorted keys of the distinct units, an example of each, the distinct unit of every unit, and how often each occurs."""
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(length.max(initial=0)) + 1, np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)
            within = np.arange(len(codes)) - np.repeat(begin, length)
            terms = mix64(codes.astype(np.uint64) + np.uint64(1)) * power[within]
            keys = np.add.reduceat(terms, begin) if len(begin) else np.zeros(0, np.uint64)
        return np.unique(keys, return_index=True, return_inverse=True, return_counts=True)

    def choose(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of every position in ``at``, by the uniform numbers ``u``."""
        e = self.edge[at]
        last = e + self.count[at] - 1
        open_ = np.flatnonzero((u > self.c[e]) & (e < last))
        while len(open_):
            e[open_] += 1
            open_ = open_[(u[open_] > self.c[e[open_]]) & (e[open_] < last[open_])]
        return e

    def ids_of(self, edges: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of runs of edges, and the runs' new bounds; spelled characters become their bytes."""
        ids = self.piece[edges]
        spelled = np.flatnonzero(ids < 0)
        chars = self.codes[self.source[edges[spelled]]]
        ids[spelled] = self.model.byte_ids[np.minimum(chars, 127)]
        spelled, chars = spelled[chars > 127], chars[chars > 127]
        if not len(spelled):
            return ids, bounds
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars.tolist()]
        size = np.ones(len(ids), np.int64)
        size[spelled] = [len(r) for r in raw]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(ids, size)
        where = np.repeat(ends[spelled], size[spelled]) + np.concatenate([np.arange(len(r)) for r in raw])
        out[where] = self.model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, ends[bounds]


FIELDS = ("codes", "edge", "count", "to", "source", "piece", "p", "c")


def empty_store() -> dict[str, np.ndarray]:
    kinds = dict.fromkeys(("edge", "count", "to", "source", "starts"), np.int64) | {"codes": np.int32, "piece": np.int32, "keys": np.uint64}
    return {x: np.zeros(0, kinds.get(x, np.float64)) for x in (*FIELDS, "starts", "keys")}


def _joined(store: dict, built: dict, keys: np.ndarray) -> dict[str, np.ndarray]:
    """A store with more units behind its own."""
    if not len(keys):
        return store
    shift, edges = len(store["codes"]), len(store["to"])
    moved = {"edge": built["edge"] + edges, "to": np.where(built["to"] < 0, -1, built["to"] + shift), "source": built["source"] + shift}
    out = {x: np.concatenate([store[x], moved.get(x, built[x])]) for x in FIELDS}
    order = np.argsort(np.concatenate([store["keys"], keys]), kind="stable")
    out["keys"] = np.concatenate([store["keys"], keys])[order]
    out["starts"] = np.concatenate([store["starts"], built["starts"] + shift])[order]
    return out


def _build(m: Pieces, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Positions, edges and edge probabilities of units at ``begin`` of a text."""
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    n = int(starts[-1])
    codes = text[np.repeat(begin - starts[:-1], sizes) + np.arange(n)]
    left = np.repeat(starts[1:], sizes) - np.arange(n)  # characters up to the unit's end
    # edges by length: all starting positions walk down the trie together
    dense, row = m.dense[codes], m.row
    found = [(np.arange(n), m.single[codes], m.single_log[codes].astype(np.float64))]
    found[0][2][found[0][1] < 0] = m.byte_log
    alive, node, size, lengths = np.arange(n), np.zeros(n, np.int32), 0, [1]
    while len(alive):
        size += 1
        node = m.step[row[node], dense[alive + size - 1]]
        ok = np.flatnonzero(node)
        alive, node = alive[ok], node[ok]
        hit = np.flatnonzero(m.ids[node] >= 0)
        if len(hit):
            found.append((alive[hit], m.ids[node[hit]], m.logs[node[hit]]))
            lengths.append(size)
        more = np.flatnonzero((left[alive] > size) & (row[node] > 0))
        alive, node = alive[more], node[more]
    # positions from the shortest rest to the longest, longer edges first; short numbers are sorted faster
    order = np.argsort(left.astype(np.int16) if left.max(initial=0) < 1 << 15 else left, kind="stable")
    count = np.zeros(n, np.int64)
    for at, _, _ in found:
        count[at] += 1
    by_rank = np.concatenate([[0], np.cumsum(count[order])])
    total = int(by_rank[-1])
    edge = np.empty(n, np.int64)
    edge[order] = by_rank[:-1]
    piece, logs, to = np.empty(total, np.int32), np.empty(total), np.empty(total, np.int64)
    filled = edge.copy()
    for (at, ids, log), size in zip(reversed(found), reversed(lengths), strict=True):
        e = filled[at]
        piece[e], logs[e] = ids, log
        to[e] = np.where(left[at] == size, -1, at + size)
        filled[at] += 1
    # log of the total weight from each position to its unit's end, in waves over all units: a target's rest is shorter,
    # so each wave finds the totals that its edges lead to
    totals = np.zeros(n + 1)
    p = np.empty(total)
    bounds = np.cumsum(np.bincount(left, minlength=1))
    for r in range(1, len(bounds)):
        low, high = bounds[r - 1], bounds[r]
        a, b = by_rank[low], by_rank[high]
        if high > low:
            at, times = by_rank[low:high] - a, count[order[low:high]]
            way = logs[a:b] + totals[to[a:b]]
            # weights are taken relative to the position's heaviest edge, so that no sum is 0
            top = np.maximum.reduceat(way, at)
            weight = np.exp(way - np.repeat(top, times))
            sums = np.add.reduceat(weight, at)
            p[a:b] = weight / np.repeat(sums, times)
            totals[order[low:high]] = top + np.log(sums)
    source = np.repeat(order, count[order])
    # running sums per position, one edge of every position at a time
    c = p.copy()
    more, rank = np.flatnonzero(count > 1), 1
    while len(more):
        c[edge[more] + rank] += c[edge[more] + rank - 1]
        rank += 1
        more = more[count[more] > rank]
    return {"codes": codes, "edge": edge, "count": count, "starts": starts[:-1], "to": to, "source": source, "piece": piece, "p": p, "c": c}


def decode(model: Pieces, ids) -> str:
    """The text behind piece ids: pieces put together, without the blank in front."""
    text = b"".join([model.bytes[i] for i in ids]).decode("utf-8", "replace")
    return text.removeprefix(" ")
