"""Batch tokenisation that sends each distinct piece of text to the library once.

A text is cut only where the cut cannot change its tokens: in front of a blank or line feed that follows a
visible character. The pre-tokenizers of both vocabularies end a match there, and neither looks back. Pieces
repeat a lot, so a worker keeps the results of the pieces it has seen, a bounded number of them. Texts with
other white space, or with blanks in a row, are cut between plain ASCII words only and not kept.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import drop_others, keeps

# Pieces kept by a worker process before it starts over; about 200 MB.
KEPT_PIECES = 1_000_000
# Characters of pieces sent to the library at once, and pieces joined to one text.
BATCH_CHARS = 1 << 20
JOINED_PIECES = 512
# Characters of texts cut at a time; the pieces of more would fill a worker's memory.
TEXT_CHARS = 4 << 20
SAFE_CHARS = 1 << 16

# White space other than blank and line feed, marks that a normalizer may take for it, and blanks in a row.
_ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ODD += ["\u180e", "\u200b", "\ufeff", "  ", " \n", "\n ", "\n\n", "<|"]
_ODD_ASCII = [mark for mark in _ODD if mark.isascii()]
# A Latin word with ASCII marks behind it; both pre-tokenizers part the two, whatever the marks but for apostrophes.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
# ASCII marks between a letter and the end of a piece.
_MARKS = r"([A-Za-z])([!-&(-/:-@\[-`{-~]+)([ \n]|$)"
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_SAFE = re.compile(r"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])")
_TOKENIZERS: dict[str, object] = {}
_CACHES: dict[tuple, PieceCache] = {}
keeps("pieces", _CACHES.clear)


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker and kept to one thread."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _TOKENIZERS[path] = loaded
    return _TOKENIZERS[path]


def batches(pieces: Iterable[str], limit: int = BATCH_CHARS):
    """Lists of pieces with about ``limit`` characters each."""
    batch, chars = [], 0
    for piece in pieces:
        batch.append(piece)
        chars += len(piece)
        if chars >= limit:
            yield batch
            batch, chars = [], 0
    if batch:
        yield batch


def safe_parts(text: str, limit: int = SAFE_CHARS) -> list[str]:
    """``text`` in parts of at least ``limit`` characters, cut between plain ASCII words only."""
    parts, start = [], 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def by_size(texts: list[str | None], limit: int = TEXT_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``limit`` characters each; a longer text is a range of its own."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def is_odd(text: str) -> bool:
    """Whether a text has white space at its ends, in a row or of an unusual kind; plain searches find that fastest."""
    if text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
        return True
    for mark in _ODD_ASCII if text.isascii() else _ODD:
        if mark in text:
            return True
    return False


def cut(texts: list[str | None]) -> tuple[list[str], list[int], list[int]]:
    """Distinct keys of the pieces of texts that are not odd, the pieces of all texts as places in them, and where
    each text's pieces end; a null text has none. A piece has lost the blank in front of it, unless a line feed
    stands there; the first piece of a text is marked. So are the marks behind an ASCII letter, pieces of their own:
    both pre-tokenizers part the two, and the words without marks are fewer."""
    marked = pa.array(["\r" + text if text else None for text in texts], pa.large_string())
    marked = pc.replace_substring_regex(marked, _MARKS, "\\1 \r\\2\\3")
    pieces = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
    coded = pc.list_flatten(pieces).dictionary_encode()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(pieces), 0).to_numpy())
    # by way of numpy, which makes plain lists several times as fast
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().tolist(), ends.tolist()


class PieceCache:
    """Results of ``value(encoding)`` by piece. ``join`` puts the results of a text's pieces together.

    With ``split``, pieces are encoded joined to texts of moderate length, and ``split(encoding)`` returns the
    results of the pieces; a call of the library costs more than a piece. Without ``glue`` only pieces that begin
    with white space are joined, and as they are. ``glue`` stands between any pieces that do not contain its mark;
    it goes with vocabularies of words, in which case and the blank in front do not count. A word with marks behind
    it is put together from the two. Latin words need no mark between them: ``split_words(encoding)`` parts them where
    a token ends a word.
    """

    def __init__(self, path: str, value: Callable, join: Callable, split: Callable | None = None, glue: str = "", split_words: Callable | None = None):
        self.path, self.value, self.join, self.split, self.glue, self.split_words = path, value, join, split, glue, split_words
        self.known: dict[str, object] = {}

    def _joins(self, key: str) -> bool:
        return self.glue.strip(" ") not in key

    def _parts(self, key: str) -> tuple[str, ...]:
        match = _WORD.fullmatch(key)
        if match is None:
            return (key,)
        word, marks = match.groups()
        word = word.lower()
        return (word, "\r" + marks) if marks else (word,)

    def _encode(self, pieces: Iterable[str]) -> list:
        encode = tokenizer(self.path).encode_batch_fast
        return [self.value(e) for batch in batches(pieces) for e in encode(batch, add_special_tokens=False)]

    def _encode_new(self, keys: list[str]) -> None:
        if self.split and not self.glue:
            plain = [k for k in keys if k and k[0] != "\r"]
            single = [k for k in keys if not k or k[0] == "\r"]
        else:
            plain = [k for k in keys if self.split and k and self._joins(k)]
            single = keys if not plain else [k for k in keys if not k or not self._joins(k)]
        self.known.update(zip(single, self._encode(map(_restore, single)), strict=True))
        if self.split_words:
            words = [k for k in plain if _LETTERS.fullmatch(k)]
            self._encode_joined(words, " ", self.split_words)
            plain = [k for k in plain if k not in self.known]
        self._encode_joined(plain, self.glue, self.split)

    def _encode_joined(self, keys: list[str], glue: str, split: Callable | None) -> None:
        encode = tokenizer(self.path).encode_batch_fast
        # as by ``_restore`` of every piece, over whole joined texts
        joined = [
            (" " + (glue + " ").join(keys[i : i + JOINED_PIECES])).replace(" \n", "\n").replace(" \r", "")
            for i in range(0, len(keys), JOINED_PIECES)
        ]
        results = (
            result
            for i in range(0, len(joined), 64)
            for encoding in encode(joined[i : i + 64], add_special_tokens=False)
            for result in split(encoding)
        )
        self.known.update(zip(keys, results, strict=True))

    def run(self, texts: list[str | None]) -> list:
        """One joined result per text; a null text counts as empty."""
        drop_others("pieces")
        return [result for start, end in by_size(texts) for result in self._run(texts[start:end])]

    def _run(self, texts: list[str | None]) -> list:
        strange = [bool(text) and is_odd(text) for text in texts]
        odd = [safe_parts(text) for text, is_ in zip(texts, strange, strict=True) if is_]
        distinct, places, ends = cut([None if is_ else text for text, is_ in zip(texts, strange, strict=True)])
        if len(self.known) > KEPT_PIECES:
            self.known = {}
        known = self.known
        new = [key for key in distinct if key not in known]
        if self.glue:
            parts = list(map(self._parts, new))
            self._encode_new(list(set(chain.from_iterable(parts)).difference(known)))
            for key, of in zip(new, parts, strict=True):
                if key not in known:
                    known[key] = self.join(map(known.__getitem__, of))
        else:
            self._encode_new(new)
        whole = iter(self._encode(chain.from_iterable(odd)))
        lengths = iter(map(len, odd))
        get = list(map(known.__getitem__, distinct)).__getitem__
        return [
            self.join([next(whole) for _ in range(next(lengths))]) if is_ else self.join(map(get, places[start:end]))
            for is_, start, end in zip(strange, [0, *ends[:-1]], ends, strict=True)
        ]


def _restore(piece: str) -> str:
    """The text of a key: the first piece of a text is marked, others had a blank or start with a line feed."""
    if piece[:1] == "\r":
        return piece[1:]
    return piece if piece[:1] == "\n" else " " + piece


def cache(kind: str, path: str, *how) -> PieceCache:
    """The worker's cache for one use of one file."""
    if (kind, path) not in _CACHES:
        _CACHES[kind, path] = PieceCache(path, *how)
    return _CACHES[kind, path]


def _word_ends(path: str) -> np.ndarray:
    """Which ids of a vocabulary of words end one."""
    vocab = tokenizer(path).get_vocab()
    suffix = json.loads(tokenizer(path).to_str())["model"]["end_of_word_suffix"]
    ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
    ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
    return ends


def word_mark(path: str) -> tuple[str, int] | None:
    """For a vocabulary with word ends: text to put between words, and the one id that it becomes; else None."""
    mark = "\0"
    model = json.loads(tokenizer(path).to_str())["model"]
    ids = tokenizer(path).encode(f"a {mark} a", add_special_tokens=False).ids if model.get("end_of_word_suffix") else []
    alone = tokenizer(path).encode("a", add_special_tokens=False).ids if ids else []
    return (f" {mark} ", ids[1]) if len(ids) == 3 and alone == ids[:1] == ids[2:] else None


def id_cache(path: str, dtype: str) -> PieceCache:
    """The worker's cache of pieces as raw ids of ``dtype``."""
    kind = f"ids {dtype}"
    if (kind, path) in _CACHES:
        return _CACHES[kind, path]
    size = np.dtype(dtype).itemsize
    glue, mark = word_mark(path) or ("", -1)
    vocab = tokenizer(path).get_vocab()
    leads = np.zeros(max(vocab.values(), default=0) + 1, bool)
    # the byte-level spelling of a blank and of a line feed
    leads[[i for token, i in vocab.items() if token[:1] in ("Ġ", "Ċ")]] = True

    def split(encoding):
        ids = np.array(encoding.ids, dtype=dtype)
        raw = ids.tobytes()
        if glue:
            ends = (np.flatnonzero(ids == mark) * size).tolist()
            return [raw[a:b] for a, b in zip([0, *(e + size for e in ends)], [*ends, len(raw)], strict=True)]
        starts = (np.flatnonzero(leads[ids]) * size).tolist()
        return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]

    last = _word_ends(path) if glue else leads

    def split_words(encoding):
        ids = np.array(encoding.ids, dtype=dtype)
        raw, ends = ids.tobytes(), ((np.flatnonzero(last[ids]) + 1) * size).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    return cache(kind, path, lambda e: np.array(e.ids, dtype=dtype).tobytes(), b"".join, split, glue, split_words if glue else None)


def count_cache(path: str) -> PieceCache:
    """The worker's cache of pieces as numbers of tokens."""
    if ("count", path) in _CACHES:
        return _CACHES["count", path]
    glue, mark = word_mark(path) or ("", -1)

    def split(encoding):
        ids = np.array(encoding.ids)
        ends = np.concatenate([[-1], np.flatnonzero(ids == mark), [len(ids)]])
        return (np.diff(ends) - 1).tolist()

    last = _word_ends(path) if glue else None

    def split_words(encoding):
        return np.diff(np.flatnonzero(last[np.array(encoding.ids)]) + 1, prepend=0).tolist()

    return cache("count", path, len, sum, *((split, glue, split_words) if glue else ()))
