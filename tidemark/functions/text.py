"""Sentences, words and n-grams as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BREAK = "\u0001"
# Rows whose grams a worker counts before it hands them on.
GRAM_ROWS = 512
# Bits by which grams are told apart before an exchange: 4 MB.
KEY_BITS = 1 << 25
# Longer words are hashed one by one.
TABLE_BYTES = 32
_SPACE = r"[ \t\n\x0B\r\f]"
# Everything but letters, white space and the sentence break. Spelt out as ranges: the
# negated form of the class takes several times as long.
_OTHER = r"[\x00\x02-\x08\x0E-\x1F!-@\[-`{-\x{10FFFF}]+"
# What is left of the upper case of other characters than a-z, where it has any of A-Z.
_UPPER = {
    "ß": "SS", "ı": "I", "ŉ": "N", "ſ": "S", "ǰ": "J", "ẖ": "H", "ẗ": "T", "ẘ": "W", "ẙ": "Y", "ẚ": "A",
    "ﬀ": "FF", "ﬁ": "FI", "ﬂ": "FL", "ﬃ": "FFI", "ﬄ": "FFL", "ﬅ": "ST", "ﬆ": "ST",
}


def _marked(text: Column) -> Column:
    return F.regexp_replace(text, rf"([.!?]){_SPACE}+", "$1" + _BREAK)


def split_sentences(text: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` followed by white space."""
    return F.split(_marked(text), _BREAK)


def locale_sentences(text: Column) -> Column:
    """Sentences by the rules of US English, as arrays of words."""
    return F.sentences(text, F.lit("en"), F.lit("US"))


def _letters(text: Column) -> Column:
    """Upper-case letters and white space only, with ``NOT `` turned into ``!``; keeps sentence breaks."""
    upper = F.regexp_replace(F.upper(text), _OTHER, "")
    return F.regexp_replace(F.replace(upper, F.lit("NOT "), F.lit("!")), _SPACE + "{2,}", " ")


def _trimmed(sentence: Column) -> Column:
    return F.btrim(sentence, F.lit(" \t\n\x0B\r\f"))


def clean_sentence(sentence: Column) -> Column:
    """Normal form of one sentence: null where nothing is left, empty if it was white space."""
    return _trimmed(F.nullif(_letters(sentence), F.lit("")))


def clean_sentences(text: Column) -> Column:
    """Clean sentences of a document. The patterns run once over the whole text, not per sentence."""
    pieces = F.split(_letters(_marked(text)), _BREAK)
    return F.transform(F.filter(pieces, lambda s: s != ""), lambda s: _trimmed(s))


def words(sentence: Column) -> Column:
    return F.split(sentence, " ")


def sentence_words(sentences: Column, keep_negation: bool = False) -> Column:
    """Word lists of clean sentences; the negation mark is dropped unless kept."""
    return F.transform(sentences, lambda s: words(s if keep_negation else F.translate(s, "!", "")))


def ngrams(word_lists: Column, n: int) -> Column:
    """All grams of 1..n words; a sentence of fewer than n words has none."""

    def grams(w: Column, k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - F.lit(k - 1))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))

    long_enough = F.filter(word_lists, lambda w: F.size(w) >= n)
    return F.flatten(
        F.transform(long_enough, lambda w: F.concat(w, *[grams(w, k) for k in range(2, n + 1)]))
    )


def add_clean_sentences(df: DataFrame, text: str, name: str = "sentences") -> DataFrame:
    """``clean_sentences`` of a text column in its place, made over Arrow arrays."""
    return _made(df, text, name, "array<string>", cleaned_sentences)


def cleaned_sentences(texts: pa.Array) -> pa.ListArray:
    """Clean sentences of each text, as by ``clean_sentences``; null for null."""
    marked = pc.replace_substring_regex(texts, rf"([.!?]){_SPACE}+", r"\1" + _BREAK)
    if pc.any(pc.match_substring_regex(marked, f"[{''.join(_UPPER)}]")).as_py():
        for character, letters in _UPPER.items():
            marked = pc.replace_substring(marked, character, letters)
    letters = pc.replace_substring_regex(pc.ascii_upper(marked), rf"[^A-Z \t\n\x0B\f\r{_BREAK}]+", "")
    letters = pc.replace_substring_regex(pc.replace_substring(letters, "NOT ", "!"), _SPACE + "{2,}", " ")
    split = pc.split_pattern(letters, _BREAK)
    pieces, row = pc.list_flatten(split), pc.list_parent_indices(split)
    full = pc.not_equal(pieces, "")
    ends = _ends(row.filter(full).to_numpy(zero_copy_only=False), len(texts))
    return pa.ListArray.from_arrays(ends, pc.ascii_trim(pieces.filter(full), " \t\n\x0B\r\f"), mask=pc.is_null(texts))


def drop_sentences(df: DataFrame, sentences: str, key: Callable[[Column], list[Column]], dropped: pa.Table) -> DataFrame:
    """``df`` without the sentences whose ``key``, two numbers, ``dropped`` has; the others stay in order, and null becomes empty."""
    first, second = (dropped.column(c).combine_chunks().to_numpy() for c in ("k1", "k2"))
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    most = int(np.unique(first, return_counts=True)[1].max(initial=0))
    shared = df.sparkSession.sparkContext.broadcast((first, second))
    place, names = df.columns.index(sentences), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = shared.value
        for batch in batches:
            column = batch.column(place)
            k1, k2 = (pc.list_flatten(batch.column(len(names) + i)).to_numpy() for i in range(2))
            at, kept = np.searchsorted(first, k1), np.ones(len(k1), bool)
            for i in range(most):
                near = np.minimum(at + i, len(first) - 1)
                kept &= (first[near] != k1) | (second[near] != k2)
            row = pc.list_parent_indices(column).to_numpy()
            left = pa.ListArray.from_arrays(_ends(row[kept], len(column)), pc.list_flatten(column).filter(pa.array(kept)))
            yield pa.RecordBatch.from_arrays([left if i == place else batch.column(i) for i in range(len(names))], names=names)

    k1, k2 = F.transform(sentences, lambda s: key(s)[0]), F.transform(sentences, lambda s: key(s)[1])
    return df.select("*", k1.alias("k1_"), k2.alias("k2_")).mapInArrow(run, df.schema)


def add_gram_counts(df: DataFrame, sentences: str, n: int, keep_negation: bool = False, name: str = "grams") -> DataFrame:
    """Adds the distinct grams of 1..n words of each row with their number, as by ``ngrams`` over ``sentence_words``."""
    kind = "array<struct<gram:string,times:bigint>>"
    return _made(df, sentences, name, kind, lambda part: counted_grams(part, n, keep_negation), kept=True)


def add_gram_keys(df: DataFrame, sentences: str, n: int, name: str = "grams") -> DataFrame:
    """Puts the keys of the distinct grams of each row, with their number, in the place of its sentences."""
    kind = "array<struct<k1:bigint,k2:bigint,times:bigint>>"
    return _made(df, sentences, name, kind, lambda part: counted_grams(part, n, keyed=True))


def add_gram_numbers(df: DataFrame, sentences: str, n: int, name: str = "count_") -> DataFrame:
    """Adds the number of distinct grams of each row."""
    return _made(df, sentences, name, "bigint", lambda part: gram_numbers(part, n), kept=True)


def key_bits(keys: DataFrame) -> np.ndarray:
    """Bits that are set where a key of ``keys`` falls. However many keys there are, the driver gets ``KEY_BITS`` bits."""
    place, bit = F.expr(f"shiftright(k1 & {KEY_BITS - 1}L, 6)"), F.expr("shiftleft(1L, cast(k1 & 63L as int))")
    rows = keys.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(KEY_BITS // 64, np.int64)
    bits[rows.column("place").to_numpy()] = rows.column("bits").to_numpy()
    return bits


def gram_keys(df: DataFrame, sentences: str, n: int, asked: np.ndarray) -> DataFrame:
    """Keys of the grams of all rows that fall on a bit of ``asked``: all keys it was made of, and a few others.

    A batch names each of its grams once; grams that batches share come repeatedly.
    """
    shared = df.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pc.list_flatten(batch.column(0))
            whole = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            for _, keys, _ in _distinct(whole, n, False, _keys):
                bit = keys[:, 0] & (KEY_BITS - 1)
                keys = keys[shared.value[bit >> 6] >> (bit & 63) & 1 == 1]
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["k1", "k2"])

    return df.select(sentences).mapInArrow(run, "k1 bigint, k2 bigint")


def _made(df: DataFrame, column: str, name: str, kind: str, make: Callable[[pa.Array], pa.Array], kept: bool = False) -> DataFrame:
    """``df`` with what ``make`` gives for a column, in its place or, where it is kept, behind all.

    The rows of an Arrow batch are taken a few at a time, so a worker holds the results of those only.
    """
    place = df.columns.index(column)
    rest = [i for i, c in enumerate(df.columns) if kept or c != column]
    names = [*(df.columns[i] for i in rest), name]
    schema = ", ".join([*(f"`{df.schema[i].name}` {df.schema[i].dataType.simpleString()}" for i in rest), f"`{name}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GRAM_ROWS):
                part = batch.slice(start, GRAM_ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), make(part.column(place))], names=names)

    return df.mapInArrow(run, schema)


def counted_grams(sentences: pa.ListArray, n: int, keep_negation: bool = False, keyed: bool = False) -> pa.ListArray:
    """Distinct grams of each row's clean sentences, or their keys, with their number, in no order; none for null."""
    rows, grams, times = zip(*_distinct(sentences, n, keep_negation, _keys if keyed else _texts))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    if keyed:
        keys = np.concatenate(grams)[order]
        fields = {"k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1])}
    else:
        fields = {"gram": pa.concat_arrays(grams).take(pa.array(order))}
    fields["times"] = pa.array(np.concatenate(times)[order])
    return pa.ListArray.from_arrays(_ends(row, len(sentences)), pa.StructArray.from_arrays([*fields.values()], names=[*fields]))


def gram_numbers(sentences: pa.ListArray, n: int) -> pa.Array:
    """Number of distinct grams of each row's clean sentences; 0 for null."""
    rows = [row for row, _, _ in _distinct(sentences, n, False, _unnamed)]
    return pa.array(np.bincount(np.concatenate(rows), minlength=len(sentences)))


def _ends(row: np.ndarray, rows: int) -> pa.Array:
    """Offsets of a list array whose items belong to ``row``."""
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32())


def _distinct(sentences: pa.ListArray, n: int, keep_negation: bool, naming: Callable) -> Iterator[tuple]:
    """For 1..n words, the row, name and number of the distinct grams of each row."""
    for row, named, codes, number in _coded(sentences, n, keep_negation, naming):
        yield row, named(codes), number


def _coded(sentences: pa.ListArray, n: int, keep_negation: bool, naming: Callable, ordered: bool = False) -> Iterator[tuple]:
    """For 1..n words, the row of the distinct grams of each row, a function that names grams by their codes, the codes and the number.

    ``naming`` takes the distinct words and gives a function that names grams by their length, the names of the grams
    without their last word, and codes: number of such a shorter gram * number of words + number of the last word. The
    words are numbered in their order if ``ordered``.
    """
    flat = pc.list_flatten(sentences)
    split = pc.split_pattern(flat if keep_negation else pc.replace_substring(flat, "!", ""), " ")
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(split).dictionary_encode()
    words_, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if ordered:
        order = pc.sort_indices(words_)
        words_, codes = words_.take(order), np.argsort(order.to_numpy())[codes]
    size = max(len(words_), 1)
    name = naming(words_, n)
    row = np.repeat(pc.list_parent_indices(sentences).to_numpy(zero_copy_only=False).astype(np.int64), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    enough = np.repeat(lengths >= n, lengths)
    # ``before`` has the numbers of the shorter grams by first word
    before, shorter, span = np.zeros(len(codes), np.int64), None, size
    for k in range(1, n + 1):
        starts = np.flatnonzero(enough & (left >= k))
        pairs = before[starts] * size + codes[starts + k - 1]
        found, number = np.unique(row[starts] * span + pairs, return_counts=True)
        yield found // span, partial(name, k, shorter), found % span, number
        if k < n:
            # The codes of the words number the grams of one word already.
            distinct, before[starts] = (np.arange(len(words_)), pairs) if k == 1 else np.unique(pairs, return_inverse=True)
            shorter, span = name(k, shorter, distinct), max(len(distinct), 1) * size


def _texts(words_: pa.Array, n: int) -> Callable:
    def name(k: int, shorter: pa.Array | None, pairs: np.ndarray) -> pa.Array:
        last = words_.take(pa.array(pairs % max(len(words_), 1)))
        if shorter is None:
            return last
        return pc.binary_join_element_wise(shorter.take(pa.array(pairs // max(len(words_), 1))), last, " ")

    return name


def _keys(words_: pa.Array, n: int) -> Callable:
    """Names of 128 bits: each word has some for every place in a gram, and a gram's are their sum."""
    hashed = _hashed_words(words_, n)

    def name(k: int, shorter: np.ndarray | None, pairs: np.ndarray) -> np.ndarray:
        last = hashed[pairs % max(len(words_), 1), k - 1]
        return last if shorter is None else shorter[pairs // max(len(words_), 1)] + last

    return name


def _hashed_words(words_: pa.Array, n: int) -> np.ndarray:
    """Two numbers of 64 bits per word and place in a gram of ``n`` words: sums of random numbers of its bytes by position."""
    start, table = _random_numbers(n)
    words_ = words_.cast(pa.large_binary())
    ends = np.frombuffer(words_.buffers()[1], np.int64)[words_.offset : words_.offset + len(words_) + 1]
    lengths = np.diff(ends)
    short = lengths <= TABLE_BYTES
    place = np.minimum(np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], lengths), TABLE_BYTES - 1)
    content = words_.buffers()[2]
    cell = place * 256 + (np.frombuffer(content, np.uint8)[ends[0] : ends[-1]] if content else 0)
    hashed = np.empty((len(words_), n, 2), np.int64)
    for i in range(n):
        for j in range(2):
            sums = np.concatenate([[0], np.cumsum(table[i, j][cell])])
            hashed[:, i, j] = sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]] + start[i, j]
    for w in np.flatnonzero(~short):
        hashed[w] = np.frombuffer(hashlib.shake_256(words_[int(w)].as_py()).digest(16 * n), "<i8").reshape(n, 2)
    return hashed


@cache
def _random_numbers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Random numbers that are the same in all workers: one, and one per position and byte, for each number of a word."""
    cells = 1 + TABLE_BYTES * 256
    drawn = np.frombuffer(hashlib.shake_256(b"gram keys").digest(n * 2 * cells * 8), "<i8").reshape(n, 2, cells)
    return drawn[:, :, 0], np.ascontiguousarray(drawn[:, :, 1:])


def _unnamed(words_: pa.Array, n: int) -> Callable:
    return lambda k, shorter, pairs: None


def first_of_each(sorted_items: Column) -> Column:
    """Pairs (item, is its first occurrence) of an already sorted array.

    Exploding these counts occurrences and containing rows in one grouping,
    without first grouping by row.
    """
    return F.transform(
        sorted_items,
        lambda x, i: F.struct(
            x.alias("item"), ((i == 0) | (F.get(sorted_items, i - 1) != x)).alias("is_first")
        ),
    )


def text_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))
