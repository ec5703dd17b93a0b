"""Alignment of two tokenizers' tokens over the same bytes by diagonal run skipping.

Tokens of both sides end at byte offsets; an offset where both have an end closes a group. While groups hold one
token of each side, the two arrays of ends agree at a constant shift of their indexes: ``align`` compares slices
of doubling width at the current shift and jumps to the first difference. There the side that lags steps on until
both end together again, which fixes the shift of the next stretch.

Texts are cut where neither tokenizer sees across the cut: in front of a blank or line feed behind a visible
character. A worker tokenises and aligns each distinct piece once, many pieces joined, and puts documents together
from pieces. Texts with other white space or blanks in a row are cut between plain ASCII words only, and not kept.

In a linked pair, the bytes of one token end with those of the other. So the pairs that can occur follow from the two
vocabularies, a few per entry: their corpus-wide counts are one array of that size, counted and shared like the
vocabularies themselves.

Defined results: texts null or empty, or that one side does not give back byte by byte, have no tokens: zeros and an
empty string. A null id is kept, repeated rows count again. Only the id and the text are read, so other columns
cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_others, keeps
from tidemark.llm.wordcache import SAFE_CHARS, batches, by_size, is_odd, safe_parts
from tidemark.session import written

# Pieces kept by a worker before it starts over, about 200 MB; characters of pieces tokenised and aligned together.
KEPT_PIECES = 500_000
JOINED_CHARS = 1 << 16
SPACE = "▁"
_LOADED: dict[tuple[str, str], Aligner] = {}
keeps("alignment", _LOADED.clear)


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the entries that ascending end offsets ``a`` and ``b`` share."""
    found: list[tuple[int, int, int]] = []
    listed_a, listed_b = a.tolist(), b.tolist()
    i = j = 0
    while i < len(a) and j < len(b):
        # a stretch of one-to-one groups at the shift j - i, probed with doubling width
        start, width = i, 4
        while width and listed_a[i] == listed_b[j]:
            width = min(width, len(a) - i, len(b) - j)
            differ = a[i : i + width] != b[j : j + width]
            first = int(differ.argmax())
            step = first if differ[first] else width
            i, j = i + step, j + step
            width = 0 if step < width or i == len(a) or j == len(b) else 2 * width
        if i > start:
            found.append((start, j - i, i - start))
        # an irregular group: the side that lags steps on until both end together
        while i < len(a) and j < len(b) and listed_a[i] != listed_b[j]:
            if listed_a[i] < listed_b[j]:
                i += 1
            else:
                j += 1
    none = np.zeros(0, np.int64)
    at = np.concatenate([none, *(np.arange(s, s + n) for s, _, n in found)])
    return at, at + np.repeat([d for _, d, _ in found], [n for _, _, n in found]).astype(np.int64)


def byte_alphabet() -> dict[str, int]:
    """The byte behind every character of a byte-level vocabulary: visible Latin-1 stands for itself, the other bytes
    follow from code point 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, the bytes of their entries, the pairs that can be linked, and the pieces seen."""

    def __init__(self, bpe_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.bytes_a, self.bytes_b = self._bytes_a(), self._bytes_b()
        self.sizes_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.space = self.b.piece_to_id(SPACE)
        # a piece that reaches across a cut would make pieces of text depend on their neighbours
        inner = (self.b.id_to_piece(i) for i in range(len(self.b)))
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in inner) and "ByteLevel" in json.loads(self.a.to_str())["pre_tokenizer"]["type"]
        self.pairs = self._pairs()
        self.known: dict[str, tuple | None] = {}

    def _bytes_a(self) -> list[bytes]:
        alphabet = byte_alphabet()
        out = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        return out

    def _bytes_b(self) -> list[bytes]:
        out = []
        for i in range(len(self.b)):
            piece = self.b.id_to_piece(i)
            out.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
        return out

    def _pairs(self) -> np.ndarray:
        """Sorted codes (a << 32 | b) of all pairs in which one token's bytes end with the other's."""
        by_a: dict[bytes, list[int]] = {}
        by_b: dict[bytes, list[int]] = {}
        for side, tokens in ((by_a, self.bytes_a), (by_b, self.bytes_b)):
            for i, raw in enumerate(tokens):
                side.setdefault(raw, []).append(i)
        codes = {a << 32 | b for a, raw in enumerate(self.bytes_a) for k in range(len(raw)) for b in by_b.get(raw[k:], ())}
        codes |= {a << 32 | b for b, raw in enumerate(self.bytes_b) for k in range(len(raw)) for a in by_a.get(raw[k:], ())}
        return np.array(sorted(codes), dtype=np.int64)

    def _align(self, pieces: list[str]) -> list[tuple | None]:
        """Per piece its groups as text, its links as raw int32 places in ``pairs``, and numbers of tokens of both
        sides in one integer; None if a side does not give the piece back. A piece starts with the blank that the
        second tokenizer adds, or with a line feed."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        ids_b = self.b.encode([p[1:] if p[:1] == " " else p for p in pieces], num_threads=1)
        ids_b = [ids if p[:1] == " " else ids[1:] for p, ids in zip(pieces, ids_b, strict=True)]
        raw = [p.encode() for p in pieces]
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        good = [
            b"".join([bytes_a[i] for i in x]) == r and b"".join([bytes_b[i] for i in y]) == r
            for r, x, y in zip(raw, ids_a, ids_b, strict=True)
        ]
        use = [k for k, g in enumerate(good) if g]
        a = np.fromiter(chain.from_iterable(ids_a[k] for k in use), np.int64)
        b = np.fromiter(chain.from_iterable(ids_b[k] for k in use), np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        at_a, at_b = align(ends_a, ends_b)
        links = np.searchsorted(self.pairs, a[at_a] << 32 | b[at_b]).astype(np.int32).tobytes()
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        last = np.searchsorted(ends_a[at_a], np.cumsum([len(raw[k]) for k in use]), "right").tolist()
        groups, i, j = [], 0, 0
        for x, y in zip(at_a.tolist(), at_b.tolist(), strict=True):
            groups.append(f"{','.join(text_a[i : x + 1])}|{','.join(text_b[j : y + 1])}")
            i, j = x + 1, y + 1
        out: list[tuple | None] = [None] * len(pieces)
        first = 0
        for k, end in zip(use, last, strict=True):
            out[k] = (";".join(groups[first:end]), links[4 * first : 4 * end], len(ids_a[k]) | len(ids_b[k]) << 32)
            first = end
        return out

    def run(self, texts: list[str | None]) -> list[list[tuple | None]]:
        """Per text the results of its parts, in order."""
        keyed: list[list[str] | None] = []
        for text in texts:
            keyed.append(None if not text or not self.cuts or is_odd(text) else text.replace("\n", " \n").split(" "))
        if len(self.known) > KEPT_PIECES:
            self.known = {}
        known = self.known
        new = list(set(chain.from_iterable(k for k in keyed if k)).difference(known))
        for batch in batches((k if k[:1] == "\n" else " " + k for k in new), JOINED_CHARS):
            known.update(zip((p if p[:1] == "\n" else p[1:] for p in batch), self._align(batch), strict=True))
        out = []
        for text, keys in zip(texts, keyed, strict=True):
            if keys is not None:
                out.append([known[k] for k in keys])
            elif not text:
                out.append([])
            else:
                parts = safe_parts(" " + text, SAFE_CHARS) if self.cuts else [" " + text]
                out.append([x for batch in batches(parts, JOINED_CHARS) for x in self._align(batch)])
        return out


def aligner(bpe_path: str, piece_path: str) -> Aligner:
    """The worker's aligner for two files."""
    if (bpe_path, piece_path) not in _LOADED:
        _LOADED[bpe_path, piece_path] = Aligner(bpe_path, piece_path)
    return _LOADED[bpe_path, piece_path]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def aligned(df: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """ALIGNED per row: ``links`` are int32 places in the pairs of the aligner; with ``groups`` as text if asked for."""
    schema = ALIGNED + (", groups string" if with_groups else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), *[pa.int64()] * 3, pa.string(), pa.binary(), *[pa.string()] * with_groups]

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("alignment")
        work = aligner(bpe_path, piece_path)
        for batch in tables:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in by_size(texts):
                rows = []
                for key, parts in zip(keys[first:last], work.run(texts[first:last]), strict=True):
                    if not parts or None in parts:
                        rows.append((key, 0, 0, 0, "", b"", "")[: len(names)])
                        continue
                    groups, links, sizes = zip(*parts, strict=True)
                    groups, links, n = ";".join(groups), b"".join(links), sum(sizes)
                    digest = hashlib.sha256(groups.encode()).hexdigest()
                    rows.append((key, n & 0xFFFFFFFF, n >> 32, len(links) // 4, digest, links, groups)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links hold each pair: summed in each task, then over tasks; as long as the vocabularies allow."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in tables:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n_pairs)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["pair", "n"])

    counted = rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.zeros(n_pairs, np.int64)
    for r in counted.collect():
        counts[r["pair"]] = r["n"]
    return counts


def link_scores(spark: SparkSession, df: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, the groups."""
    rows = written(spark, aligned(df, bpe_path, piece_path, id_col, text, with_groups))
    pairs = aligner(bpe_path, piece_path).pairs
    counts = pair_counts(rows, len(pairs))
    b = pairs & 0xFFFFFFFF
    best = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(best, b, counts)
    # one count and one flag per pair that the vocabularies allow
    shared = spark.sparkContext.broadcast((counts, counts == best[b]))
    rest = ["groups_sha256", *["groups"] * with_groups]
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, " + ", ".join(f"{c} string" for c in rest)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, is_best = shared.value
        for batch in tables:
            links = batch.column("links").to_pylist()
            at = np.frombuffer(b"".join(links), np.int32)
            ends = np.cumsum([0, *(len(x) // 4 for x in links)])
            sums = [np.concatenate([[0], np.cumsum(v[at], dtype=np.int64)]) for v in (is_best, counts)]
            n_best, total = (pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)
            same = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(np.diff(ends)), n_best, total, *(batch.column(c) for c in rest)], names=[c.split()[0] for c in schema.split(", ")]
            )

    return rows.mapInArrow(run, schema)
