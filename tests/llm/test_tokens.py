"""Token counts, token files and segmentations against the libraries and against enumeration."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import counts, lattice, sampling, tokenfiles, wordcache

ODD_PARTS = list("abÉ \0.\n\t '!5́ς\x1c\r中\xa0​") + ["<|endoftext|>", "don't", "  ", " Wörd,", " WÖRD).", "\nÀß×ÿ?!", " Ünd's", " a'S.", "İ", " ﬁne,", " e\u0301t."]
ODD_TEXT = st.lists(st.sampled_from(ODD_PARTS), max_size=30).map("".join)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cut_texts_have_the_library_tokens(name, vocabulary):
    path = vocabulary(name)
    encode = wordcache.tokenizer(path).encode
    counter = wordcache.count_cache(path)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(ODD_TEXT, max_size=5))
    def check(texts):
        assert counter.run(texts) == [len(encode(t, add_special_tokens=False)) for t in texts]
        raw = wordcache.id_cache(path, "<u2").run(texts)
        assert [np.frombuffer(r, "<u2").tolist() for r in raw] == [encode(t, add_special_tokens=False).ids for t in texts]

    check()
    long = "some words, and more. " * 9000
    assert counter.run([long, None, ""]) == [len(encode(long, add_special_tokens=False)), 0, 0]
    spaced = long.replace(" ", "  ", 3)
    assert counter.run([spaced]) == [len(encode(spaced, add_special_tokens=False))]


def test_counts_of_odd_rows(odd_docs, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    encode = wordcache.tokenizer(path).encode
    texts = [r.text or "" for r in odd_docs.select("text").collect()]
    out = counts.count_tokens(odd_docs, path).collect()
    want = sorted((len(t.encode()), len(encode(t, add_special_tokens=False).ids)) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in out)
    assert counts.count_tokens(odd_docs.limit(0), path).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packing_is_reversible(values):
    values = np.array(values, dtype=np.uint32)
    control, data = tokenfiles.pack(values)
    assert len(control) == -(-len(values) // 4)
    assert tokenfiles.unpack(control, data, len(values)).tolist() == values.tolist()


def test_packing_checks_lengths():
    control, data = tokenfiles.pack(np.array([1, 300, 70000]))
    assert len(data) == 1 + 2 + 3
    with pytest.raises(ValueError):
        tokenfiles.unpack(control, data + b"x", 3)


def test_token_files_round_trip(spark, odd_docs, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    encode = wordcache.tokenizer(path).encode
    manifest = tokenfiles.encode(odd_docs, path)
    rows = sorted(tokenfiles.read(spark, manifest, with_ids=True).collect(), key=lambda r: r.start)
    docs = [(r.doc_id, [*encode(r.text or "", add_special_tokens=False).ids, 2]) for r in odd_docs.collect()]
    order = [d for d, _ in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))]
    assert [r.doc_id for r in rows] == order
    assert sorted((r.doc_id or -1, r.ids) for r in rows) == sorted((d or -1, i) for d, i in docs)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    empty = tokenfiles.encode(odd_docs.limit(0), path)
    assert empty.count() == 0 and tokenfiles.read(spark, empty).count() == 0


def test_frequent_ids_take_one_byte(spark, vocabulary):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('the the the the ', id) AS text")
    manifest = tokenfiles.encode(docs, vocabulary("byte_bpe_50k.json"))
    size, tokens = manifest.selectExpr("sum(bytes)", "sum(n_tokens)").first()
    assert size < tokens * 1.5 + 13 * 300 + 16 * manifest.count() + tokens


def test_a_hot_id_is_split(spark, vocabulary):
    docs = spark.range(400).selectExpr("IF(id < 300, 5, id) AS doc_id", "concat('text ', id) AS text")
    manifest = tokenfiles.encode(docs, vocabulary("byte_bpe_50k.json"))
    assert manifest.filter("first_id = 5").select("part").distinct().count() > 1
    out = sorted(tokenfiles.read(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in docs.collect())


# segmentations


def segmentations(lat):
    """All segmentations of the only text, as edges, with probabilities."""
    out = {}

    def walk(unit, position, path, p):
        if position < 0:
            unit += 1
            if unit == len(lat.begin):
                out[tuple(path)] = p
                return
            position = lat.begin[unit]
        for e in range(lat.edge[position], lat.edge[position] + lat.count[position]):
            walk(unit, lat.to[e], [*path, int(e)], p * lat.p[e])

    walk(0, lat.begin[0], [], 1.0)
    return out


def draw(model, text, n, k):
    lat = lattice.Lattices(model, [text] * n)
    return lat, sampling.search(lat, lattice.mix64(np.arange(n, dtype=np.uint64) + np.uint64(5)), k)


def test_samples_follow_the_lattice(vocabulary):
    model = lattice.pieces(vocabulary("piece_bpe_32k.model"))
    n, k = 20_000, 3
    lat, rounds = draw(model, "of in the\ncat", n, k)
    single = lattice.Lattices(model, ["of in the\ncat"])
    assert np.isclose(sum(segmentations(single).values()), 1.0)
    paths = [[tuple(e[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for _, e, bounds, *_ in rounds]
    exact = segmentations(lat_of_first(lat))
    # the first sample follows the probabilities
    seen = Counter(paths[0])
    assert set(seen) <= set(exact)
    assert max(abs(seen[s] / n - p) for s, p in exact.items()) < 0.02
    # samples differ, keys fall, and weights by inclusion are unbiased
    assert all(len({p[i] for p in paths}) == k for i in range(0, n, 97))
    keys = np.stack([r[4] for r in rounds])
    assert np.all(np.diff(keys, axis=0) <= 0)
    total = sum(np.exp(r[3] - r[5]) for r in rounds)
    assert abs(total.mean() - 1) < 5 * total.std() / math.sqrt(n) + 1e-9
    # the second sample follows sampling without replacement
    second = Counter(zip(paths[0], paths[1], strict=True))
    for (a, b), times in second.most_common(5):
        assert abs(times / n - exact[a] * exact[b] / (1 - exact[a])) < 0.02


def lat_of_first(lat):
    """The lattice of the first of several equal texts."""
    import copy

    one = copy.copy(lat)
    one.begin = lat.begin[: lat.first[1]]
    return one


def test_groups_of_late_nodes_are_opened(vocabulary, monkeypatch):
    """With a single key of their own per path, results keep their distribution."""
    monkeypatch.setattr(sampling, "OWN_KEYS", 1)
    model = lattice.pieces(vocabulary("piece_bpe_32k.model"))
    n = 20_000
    lat, rounds = draw(model, "of in the", n, 2)
    exact = segmentations(lat_of_first(lat))
    paths = [[tuple(e[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for _, e, bounds, *_ in rounds]
    assert all(a != b for a, b in zip(*paths, strict=True))
    for (a, b), times in Counter(zip(*paths, strict=True)).most_common(8):
        assert abs(times / n - exact[a] * exact[b] / (1 - exact[a])) < 0.02


def test_all_segmentations_of_a_short_text(spark, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    out = sampling.sample(docs, path, k=50).collect()
    assert len({tuple(r.ids) for r in out}) == len(out) < 50
    assert all(r.log_inclusion == 0.0 for r in out)
    assert math.isclose(sum(math.exp(r.log_prob) for r in out), 1.0, rel_tol=1e-9)


def test_odd_rows_decode_to_their_text(spark, odd_docs, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    out = sampling.sample(odd_docs, path).withColumn("text", sampling.decoded(path)("ids"))
    got = Counter((r.doc_id, r.text) for r in out.filter("sample = 0").collect())
    assert got == Counter((r.doc_id, (r.text or "").replace("▁", " ")) for r in odd_docs.collect())
    # a row's samples depend on its key and text alone
    again = sampling.sample(odd_docs.repartition(5).filter("doc_id = 6"), path).collect()
    assert {(r.sample, tuple(r.ids)) for r in again} == {(r.sample, tuple(r.ids)) for r in out.filter("doc_id = 6").collect()}
    assert sampling.sample(odd_docs.limit(0), path).count() == 0


def test_long_units_and_ids_match_the_library_vocabulary(vocabulary):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = "x" * 1000 + " Ünïcode \U0001f600 words"
    _, _, ids, ends, *_ = sampling.sample_texts(lattice.pieces(path), [text], np.array([3], np.uint64), 2)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        assert sp.decode(ids[a:b].tolist()) == text


def test_pieces_cross_every_place_of_a_long_unit(vocabulary):
    """Probabilities in a unit of 10,000 characters against sums from its start, piece by piece."""
    model = lattice.pieces(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(["tion", "http", "://", "under", "城市", "9", "stand", "é"], 3000))[:10_000]
    lat = lattice.Lattices(model, [text, "a short text", text])
    assert len(set(lat.begin.tolist())) == 4
    own = dict(zip(model.ids.tolist(), model.logs.tolist(), strict=True))
    own |= {int(i): float(model.single_log[c]) for c, i in enumerate(model.single) if i >= 0}
    at, n = int(lat.begin[0]), len(text) + 1
    weight = lambda e: model.byte_log if lat.piece[e] < 0 else own[int(lat.piece[e])]
    # log of the total weight of the ways from each place to the end
    rest = np.full(n + 1, -np.inf)
    rest[n] = 0.0
    crossing = 0
    for i in range(n - 1, -1, -1):
        edges = range(lat.edge[at + i], lat.edge[at + i] + lat.count[at + i])
        ends = [n if lat.to[e] < 0 else int(lat.to[e]) - at for e in edges]
        crossing += any(i // 96 != (end - 1) // 96 for end in ends)
        ways = [weight(e) + rest[end] for e, end in zip(edges, ends, strict=True)]
        rest[i] = np.logaddexp.reduce(ways)
        assert np.allclose(lat.p[list(edges)], np.exp(np.array(ways) - rest[i]), rtol=1e-5, atol=1e-12)
    assert crossing >= 100
    who, _, ids, ends, logs, *_ = sampling.sample_texts(model, [text], np.array([5], np.uint64), 2)
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        chosen = [model.byte_log if own.get(int(i)) is None else own[int(i)] for i in ids[a:b]]
        assert lattice.decode(model, ids[a:b].tolist()) == text
        assert len(chosen) and logs[k] < 0 and np.isfinite(logs[k])
    assert len(who) == 2 and ids[ends[0] : ends[1]].tolist() != ids[ends[1] : ends[2]].tolist()


# units whose plain products of weights are below the smallest double
RARE_TEXTS = [
    "\n" * 60, "\t" * 50, "\n".join(str(i) for i in range(10, 45)), "\n".join("abcdefghijklmnopqrstuvwxyz" * 2), "\U0001f600\U0001f680" * 60,
    "这个城市的历史博物馆今天上午开放了新的展览" * 8, "これは日本語で書かれた長い文章です" * 8, "การศึกษาภาษาไทยในประเทศไทย" * 6,
]


def ways(lat, position):
    """Number of ways from a position to its unit's end."""
    known = {-1: 1}

    def count(at):
        if at not in known:
            known[at] = sum(count(int(lat.to[e])) for e in range(lat.edge[at], lat.edge[at] + lat.count[at]))
        return known[at]

    return count(position)


def test_rare_characters_next_to_ordinary_texts(vocabulary):
    model = lattice.pieces(vocabulary("piece_bpe_32k.model"))
    texts = [t for rare in RARE_TEXTS for t in (rare, "An ordinary text of some words.", "")]
    keys = lattice.mix64(np.arange(len(texts), dtype=np.uint64))
    lat = lattice.Lattices(model, texts)
    assert np.allclose(np.add.reduceat(lat.p, np.sort(lat.edge)), 1.0, atol=1e-12)
    assert np.all(lat.p > 0) and np.all(np.isfinite(lat.c))
    who, number, ids, ends, logs, tops, inclusion = sampling.sample_texts(model, texts, keys, 3)
    assert np.all(np.isfinite(logs)) and np.all(np.isfinite(tops)) and np.all(inclusion <= 0) and not np.any(np.isnan(inclusion))
    # pieces' own log probabilities: two samples of a text differ in log_prob as their pieces do
    own = dict(zip(model.ids.tolist(), model.logs.tolist(), strict=True))
    own |= {int(i): float(model.single_log[c]) for c, i in enumerate(model.single) if i >= 0}
    rounds = sampling.search(lat, keys, 3)
    for t, text in enumerate(texts):
        mine = np.flatnonzero(who == t)
        # all segmentations of a text that has fewer than 3
        assert len(mine) == min(3, math.prod(ways(lat, b) for b in lat.begin[lat.first[t] : lat.first[t + 1]].tolist()))
        weights = []
        for _, edges, bounds, *_ in rounds[: len(mine)]:
            pieces = lat.piece[edges[bounds[t] : bounds[t + 1]]]
            weights.append(sum(model.byte_log if i < 0 else own[int(i)] for i in pieces))
        assert np.allclose(logs[mine] - logs[mine[0]], np.array(weights) - weights[0], rtol=1e-6, atol=1e-4)
        # a text's samples are those it has alone
        alone = sampling.sample_texts(model, [text], keys[t : t + 1], 3)
        assert alone[4].tolist() == logs[mine].tolist() and alone[6].tolist() == inclusion[mine].tolist()
        assert alone[2].tolist() == [i for m in mine for i in ids[ends[m] : ends[m + 1]].tolist()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_marks_behind_words_are_pieces_of_their_own(name, vocabulary):
    path = vocabulary(name)
    wordcache._CACHES.clear()
    cache = wordcache.id_cache(path, "<u2")
    texts = ["Alpha, beta. Alpha$$$\nbeta, it's, it',' a.b, ü, (c) [d].", None, "", "beta*** x1, ,,", "beta"]
    expected = [wordcache.tokenizer(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(r, "<u2").tolist() for r in cache.run(texts)] == expected
    assert {"beta", "\r,", "\r.", "\r$$$", "\r***"} <= cache.known.keys()
    assert not {"beta,", "beta.", "beta***", "\nbeta,"} & cache.known.keys()
