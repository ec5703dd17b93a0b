"""Sets of hashed word shingles of whole texts, computed over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import mix64
from tidemark.llm.wordcache import by_size

WORDS = 5
CHUNK_CHARS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = mix64(np.arange(1, WORDS + 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLES = [_powers(1, _BASE), _powers(1, _INVERSE)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_TABLES[0]) < n:
        _TABLES[:] = [_powers(n, _BASE), _powers(n, _INVERSE)]
    return _TABLES


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the first word of every text (one more entry at the end)."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    raw = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    powers, inverses = _tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], dtype=np.uint64)])
        hashes = mix64((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, first


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of five words.

    A text of fewer words has one shingle, its whole sequence; without words, or null, it has none.
    """
    out: list[np.ndarray] = []
    for start, end in by_size(texts, CHUNK_CHARS):
        words, first = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts[start:end]])
        with np.errstate(over="ignore"):
            whole = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
            for j in range(WORDS):
                whole += words[j : j + len(whole)] * _PLACE[j]
            whole = mix64(whole)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= WORDS:
                    out.append(np.unique(whole[a : b - WORDS + 1]))
                elif b > a:
                    short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + _PLACE[WORDS] * np.uint64(b - a)
                    out.append(mix64(np.array([short], dtype=np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out
