"""Packing, spelling variants and token alignment against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import alignment, packing, spelling


def plain_best_fit(lengths, caps, weights):
    """Places one piece after the other; the first of equally near bins, longest pieces first."""
    room, bins = [], [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = [lengths[k], 1, lengths[k] ** 2]
        open_ = [b for b, r in enumerate(room) if all(x >= n for x, n in zip(r, need))]
        left = lambda b: sum(w * ((x - n) / c) ** 2 for w, x, n, c in zip(weights, room[b], need, caps))
        b = min(open_, key=left) if open_ else len(room)
        if not open_:
            room.append(list(caps))
        bins[k] = b
        room[b] = [x - n for x, n in zip(room[b], need)]
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(2, 9), st.integers(400, 2000), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_every_capacity(lengths, documents, cost, method):
    caps, weights = (40, documents, cost), (1.0, 0.5, 0.25)
    bins, places = packing.best_fit(lengths, caps, weights, method)
    for b in set(bins.tolist()):
        inside = sorted((places[k], lengths[k]) for k in range(len(lengths)) if bins[k] == b)
        ends = np.cumsum([0, *(n for _, n in inside)])
        assert [p for p, _ in inside] == ends[:-1].tolist()
        alone = len(inside) == 1
        assert alone or ends[-1] <= 40 and len(inside) <= documents and sum(n * n for _, n in inside) <= cost
    if method == "norm":
        assert len(set(bins.tolist())) == len(set(plain_best_fit(lengths, caps, weights)))


@pytest.mark.parametrize("group_pieces", [1 << 16, 100])
def test_packed_documents(spark, odd_docs, vocabulary, group_pieces):
    path = vocabulary("word_bpe_49k.json")
    many = spark.range(300).selectExpr("id + 100 AS doc_id", "repeat(concat('word ', id, ' '), cast(id % 37 AS int)) AS text")
    docs = odd_docs.select("doc_id", "text").unionByName(many)
    stored, packed = packing.pack_documents(spark, docs, path, capacities=(512, 512, 512.0**2), group_pieces=group_pieces)
    rows = packed.collect()
    encode = Tokenizer.from_file(path).encode
    want = Counter()
    for r in docs.collect():
        ids = [*encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[r.doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = np.cumsum([0, *(n for _, n in sorted(places))])
        assert [p for p, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 512
    least = -(-sum(r.length for r in rows) // 512)
    assert len(by) <= least + max(1, -(-len(rows) // group_pieces)) + 1
    whole = {r.sequence_id: r for r in packing.sequences(stored, packed).collect()}
    assert {s: len(r.ids) // 4 for s, r in whole.items()} == {s: sum(n for _, n in p) for s, p in by.items()}
    assert packing.pack_documents(spark, docs.limit(0), path)[1].count() == 0


def one_apart(a, b):
    """Whether one insertion, deletion or replacement turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, factor=10):
    n = Counter()
    for key, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += len(word) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: sorted((x for x in n if one_apart(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] for w, x in near.items() if x and n[x[0]] >= factor * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


@pytest.fixture(scope="module")
def variant_docs(spark, odd_docs):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice(list("abÉé"), rng.integers(6, 10))) for _ in range(40)]
        rows.append((i, " ".join([*words, "Evening", "evening", "evenings" if i % 5 == 0 else "", "eveningss" if i % 100 == 0 else "", "aaaaaaa" * (i % 3)])))
    rows += [(None, "evening " * 900 + "aaaaaaaa aaaaaaaaa " * 3), (7, "y" * 3000 + " " + "y" * 3000 + " " + "y" * 3001 + " " + "y" * 3001)]
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))


@pytest.mark.parametrize("hot", [4096, 30])
def test_variants(spark, variant_docs, hot):
    want = plain_variants([tuple(r) for r in variant_docs.collect()])
    got = spelling.variants(spark, variant_docs, hot=hot).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert any(form for _, form, *_ in want) and any(r != w and r != f for w, f, r, *_ in want)


def test_variants_of_nothing(spark, variant_docs):
    assert spelling.variants(spark, variant_docs.limit(0)).count() == 0
    assert spelling.variants(spark, spark.createDataFrame([(1, None), (2, ""), (3, "short words")], "doc_id long, text string")).count() == 0


@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), max_size=60))
def test_aligned_ends(a, b):
    a, b = np.cumsum(a, dtype=np.int64), np.cumsum(b, dtype=np.int64)
    at_a, at_b = alignment.align(a, b)
    both = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[at_a].tolist() == both == b[at_b].tolist()


def plain_alignment(texts, bpe, piece):
    """Ids, byte offsets and links of whole texts, without cuts or known pieces."""
    import sentencepiece

    a, b = Tokenizer.from_file(bpe), sentencepiece.SentencePieceProcessor(model_file=piece)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    docs = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            docs.append(([], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links, groups, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(f"{','.join(map(str, ids_a[i:x]))}|{','.join(map(str, ids_b[j:y]))}")
            links.append((ids_a[x - 1], ids_b[y - 1]))
            i, j = x, y
        docs.append((ids_a, ids_b, links, ";".join(groups)))
    counts = Counter(link for d in docs for link in d[2])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for ids_a, ids_b, links, groups in docs:
        score = [counts[link] for link in links]
        top = sum(counts[x, y] == best[y] for x, y in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((len(ids_a), len(ids_b), len(links), len(links), top, sum(score), digest))
    return out


def test_token_alignment(spark, odd_docs, vocabulary):
    files = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    parts = ["the", " house", "\n", "  ", "é", "Straße", " 12", "中文", "\t", "<s>", "<|endoftext|>", "'s", "​", "😀", ".", " x", "\0", " ▁"]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(300)] + ["plain words of a text.\nNext line, too"] * 3 + ["a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 100)], "doc_id long, text string")
    docs = docs.unionByName(odd_docs.filter("doc_id is null or doc_id <> 6").select("doc_id", "text"))
    got = alignment.link_scores(spark, docs, *files, with_groups=True).collect()
    rows = docs.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, plain_alignment([r.text for r in rows], *files), strict=True))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in names) for r in got) == want
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    assert sum(r.n_a > 0 for r in got) > 150 and any(r.n_a == 0 for r in got)
    assert alignment.link_scores(spark, docs.limit(0), *files).count() == 0
    bound = sum(map(len, alignment.aligner(*files).bytes_a)) + 2 * sum(map(len, alignment.aligner(*files).bytes_b))
    assert len(alignment.aligner(*files).pairs) <= bound


def test_long_text_alignment(spark, odd_docs, vocabulary):
    files = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    docs = odd_docs.filter("doc_id = 6").select("doc_id", "text")
    (row,) = alignment.link_scores(spark, docs, *files, with_groups=True).collect()
    a = Tokenizer.from_file(files[0]).encode(" " + docs.first().text, add_special_tokens=False).ids
    assert row.n_a == len(a) and re.findall(r"\d+", row.groups.split("|")[0])[0] == str(a[0])
