"""Quality rules, near duplicates, mixing, language and reputation on small tables and against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, mixing, neardup, quality, reputation, shingles
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
BLANK = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(BLANK, text or "") if w]


# quality


def repeat_words(text):
    w = words_of(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    return len({i + j for spots in at.values() if len(spots) > 1 for i in spots for j in range(8)})


def test_quality_counts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["x\ny\nx\n\n \nx", "# a|b <c> $%& 😀 é", "\x0b\x0c\r\n", None, "", "w " * 9, "q r s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(docs, ["doc_id"]).collect():
        text = texts[r.doc_id] or ""
        w = words_of(text)
        lines = [x for x in text.split("\n") if words_of(x)]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w))), text
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeat_words(text), text
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_of_odd_rows(odd_docs):
    out = quality.judge(odd_docs, ["doc_id", "key", "w"])
    assert out.count() == odd_docs.count()
    kept = quality.passing(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() < odd_docs.count()
    assert quality.judge(odd_docs.limit(0), ["doc_id"]).count() == 0


def test_quality_plan_is_native(spark):
    plan = quality.judge(table(spark, SF, "documents"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_rules_agree_with_labels(spark):
    sf = SF.replace("0.001", "0.01")
    out = quality.judge(table(spark, sf, "documents"), ["doc_id"]).join(table(spark, sf, "labels"), "doc_id")
    good = out.filter("quality = 1 AND NOT base_failed")
    assert good.filter("kept").count() == good.count()
    assert out.filter("quality = 0 AND kept").count() < 0.1 * out.filter("quality = 0").count()


# near duplicates


def components_by_hand(rows, threshold=85):
    sets = {}
    for i, (_, text) in enumerate(rows):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(text)]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= threshold * (len(sets[i]) + len(sets[j]) - same):
                label[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    out = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = (len(sets[i]), min(ids, default=None))
    return out


def near_copies(seed, groups, copies, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,groups,copies,edits", [(1, 30, 8, 4), (2, 2, 150, 3), (3, 3, 60, 6)])
def test_near_duplicates_against_all_pairs(spark, seed, groups, copies, edits, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = near_copies(seed, groups, copies, edits)
    want = components_by_hand(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == {rows[i][0]: v for i, v in want.items()}
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(odd_docs):
    out = {(r.id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(odd_docs).collect()}
    assert out[1, 14] == (1, True) and out[2, 14] == (1, False)
    assert out[3, 0] == (3, True) and out[4, 0] == (4, True) and out[5, 0] == (5, True)
    assert out[7, 1] == (7, True) and out[8, 1] == (7, False)
    assert out[None, 0] == (None, True)
    assert neardup.near_duplicates(odd_docs.limit(0)).count() == 0


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(0)
    for n, share in ((400, 0.9), (5000, 0.5)):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[int(n * (1 - share)) : int(n * (2 - share))])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            guess, _ = neardup.estimate(
                neardup.registers(a)[None], neardup.registers(b)[None], np.array([n]), np.array([n])
            )
            errors.append(guess[0] - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_shingles_do_not_depend_on_the_batch():
    texts = ["a b c d e f", "A B\tC  d e F ", "a b", "", None, "é b c d e"]
    one = [shingles.shingle_sets([t])[0].tolist() for t in texts]
    assert [s.tolist() for s in shingles.shingle_sets(texts)] == one
    assert one[0] == one[1] and [len(s) for s in one] == [2, 2, 1, 0, 0, 1]


# mixing


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        share = (total - sum(capped.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if share * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: share * weight[s] for s in rest}
        capped |= {s: 3 * sizes[s] for s in over}


def test_targets(spark):
    rng = random.Random(5)
    for _ in range(6):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 100_000]) for i in range(rng.randrange(1, 8))} | {None: 17}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        assert got == pytest.approx(targets_by_hand(sizes))


def test_mix_is_near_its_targets_and_repeatable(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", None]), rng.randrange(200), rng.choice([1.0, 0.5, 0.25])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "id long, source string, size long, weight double")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    taken, whole, parts, target = collections.Counter(), collections.Counter(), collections.Counter(), {}
    for r in out:
        assert r.size * r.epochs <= r.taken <= min(3, r.epochs + 1) * r.size
        # one document of a source, at its border, may be taken in part
        parts[r.source] += r.taken not in (r.size * r.epochs, r.size * (r.epochs + 1))
        taken[r.source] += r.taken
        whole[r.source] += r.size * (r.epochs + r.drawn)
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.5 and abs(whole[s] - t) <= 100 for s, t in target.items())
    assert max(parts.values()) <= 1
    again = {r.id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.id: r.taken for r in out}


def test_mix_order_is_efraimidis_spirakis(spark):
    """The drawn documents are those with the smallest keys of their source."""
    rows = [(i, "ab"[i % 2], 10, [1.0, 0.5, 0.25][i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "id long, source string, size long, weight double")
    h = F.shiftrightunsigned(F.xxhash64("id", F.lit(mixing.SEED)), 11)
    key = -F.log((h + F.lit(0.5)) * F.lit(2.0**-53)) / F.col("weight")
    keys = {r.id: r.k for r in docs.select("id", key.alias("k")).collect()}
    by = collections.defaultdict(list)
    for r in mixing.mix(docs).collect():
        by[r.source].append((keys[r.id], r.drawn))
    for drawn in ([d for _, d in sorted(v)] for v in by.values()):
        assert drawn == sorted(drawn, reverse=True)


def test_mix_of_odd_rows(spark, odd_docs):
    sized = odd_docs.select(F.col("doc_id").alias("id"), "source", mixing.size_of(F.col("text")).alias("size"), F.lit(0.5).alias("weight"))
    out = mixing.mix(sized).collect()
    assert len(out) == odd_docs.count() and all(r.taken == 0 for r in out if r["size"] == 0)
    assert mixing.mix(sized.limit(0)).count() == 0


# language


def test_language_accuracy_without_declaration(spark):
    sf = SF.replace("0.001", "0.1")
    docs = table(spark, sf, "documents").filter("doc_id % 5 = 0")
    out = language.identify(docs, F.col("text"), F.when(F.xxhash64("doc_id") % 2 == 0, F.col("lang")), F.col("source"))
    held = out.filter("row.doc_id IS NOT NULL AND xxhash64(row.doc_id) % 2 <> 0").selectExpr("row.lang = language AS right", "kept")
    n = held.count()
    assert held.filter("right").count() > 0.985 * n and held.filter("kept").count() > 0.99 * n


def test_evidence_counts(spark):
    """Host, declaration and suffix settle texts that say little, and other scripts are no language."""
    rows = [(i, "the house of the man is on the hill and that was it", "en", "h1") for i in range(60)]
    rows += [(i + 100, "das Haus von dem Mann ist auf dem Berg und das war es", "de", "h2") for i in range(60)]
    rows += [(200, "x1 z9", None, "h1"), (201, "x1 z9", None, "h2"), (202, "x1 z9", "de", None), (203, "日本語のテキストです。それは家です。" * 5, None, "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.row.doc_id: r for r in language.identify_documents(docs).collect()}
    assert out[200].language == "en" and out[201].language == "de" and out[202].language == "de"
    assert out[203].language == "und" and not out[203].kept
    assert all(out[i].language == "en" and out[i].kept for i in range(60))


PAGES = [
    ("<html lang=de><p>the cat sat on the mat with the other cat in the house</p></html>", "http://a.example.de/x"),
    ("<html><body>der Hund und die Katze sind in dem Haus auf der Strasse</body></html>", "http://a.example.de/y"),
    ("<HTML data-x=1 LANG='de-AT'>der Mann und die Frau sind nicht in dem Haus</HTML>", "https://b.example.de"),
    ("<html lang=en>the man and the woman are not in the house of the cat</html>", "http://c.net/p?q"),
    ("<html lang=fr><script>der die das</script>le chat est dans la maison avec les autres chats</html>", "http://c.net/"),
    ("<html lang=fr>le chien et le chat sont dans la rue de la ville</html>", "http://d.fr"),
    ("<html>ok</html>", "http://d.fr/ok"),
    ("<html lang=xx>ok</html>", None),
    ("<html lang=es></html>", "http://e.es"),
    (None, "http://e.es"),
    ("", ""),
    ("<html>la casa de los perros y el gato en la calle</html>", "http://e.es"),
]


def plain_posteriors(rows, model):
    """Language and posterior of every page from the model's log probabilities, one page at a time."""
    names = [*language.LANGUAGES, "und"]
    pages = []
    for html, url in rows:
        html = html or ""
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html)
        raw = re.sub(b"[A-Z]", lambda m: m[0].lower(), text.encode()) + b"\n\n"
        codes = [raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16 for i in range(len(raw) - 2)]
        bins = [(c * 2654435761 & 0xFFFFFFFF) >> (32 - language.BINS_LOG2) for c in codes]
        n = len(bins)
        ll = [min(n / 3, language.EFFECTIVE) * sum(float(m[b]) for b in bins) / n for m in model] if text.strip() else None
        said = re.search(r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2})", html)
        said = said[1].lower() if said and said[1].lower() in language.LANGUAGES else None
        host = re.sub(r"^\w+://|[/?#].*$", "", url) if url else None
        domain = ".".join(host.split(".")[-2:]) if host else None
        pages.append([ll, said, host or None, domain, host.split(".")[-1] if host else None])
    for p in pages:
        p.append(p[0].index(max(p[0])) if p[0] else None)
    voted = [p for p in pages if p[5] is not None]
    votes = lambda level, value: [sum(p[5] == i for p in voted if level is None or p[level] == value) for i in range(5)]
    world = votes(None, None)
    top = [(v + 1) / (sum(world) + 4) * (1 - language.PRIOR_UNKNOWN) for v in world[:4]] + [language.PRIOR_UNKNOWN]
    out = []
    for p in pages:
        if p[0] is None:
            out.append(("und", None))
            continue
        prior = top
        for level in (4, 3, 2):
            if p[level] is not None:
                seen = [v - (p[5] == i) for i, v in enumerate(votes(level, p[level]))]
                prior = [(v + language.STRENGTH * q) / (sum(seen) + language.STRENGTH) for v, q in zip(seen, prior)]
        logs = []
        for i, name in enumerate(names):
            value = p[0][i] + math.log(prior[i])
            if p[1] is not None:
                with_vote = [q for q in voted if q[5] == i and q[1] is not None]
                agree = sum(q[1] == p[1] for q in with_vote) + (2.0 if name == p[1] else 0.5)
                value += math.log(agree / (len(with_vote) + 2.0 + 1.5))
            if language.SUFFIX_LANGUAGE.get(p[4]) == name:
                value += math.log(language.SUFFIX_FACTOR)
            logs.append(value)
        at = max(range(5), key=lambda i: logs[i])
        out.append((names[at], 1 / sum(math.exp(x - logs[at]) for x in logs)))
    return out


def test_page_evidence_by_hand(spark, monkeypatch):
    monkeypatch.setattr(language, "EFFECTIVE", 3.0)
    rows = PAGES * 3
    table = [(i, html, url, 1, "r", "h", 1.0) for i, (html, url) in enumerate(rows)]
    schema = "page_id long, html string, url string, ll int, row string, host string, v_host double"
    pages = spark.createDataFrame(table, schema)
    markup = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2})", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    model = language.fit(pages.select(text.alias("t"), markup.alias("d")), "t", "d")
    got = {r.row.page_id: r for r in language.identify_pages(pages).collect()}
    assert len(got) == len(rows) and got[0].row.v_host == 1.0
    for i, (name, posterior) in enumerate(plain_posteriors(rows, model)):
        assert got[i].language == name and got[i].kept == (name != "und" and posterior >= language.MIN_POSTERIOR)
        assert got[i].posterior is None if posterior is None else got[i].posterior == pytest.approx(posterior, rel=1e-6)
    assert len({r.language for r in got.values()}) >= 4
    assert language.identify_pages(pages.limit(0)).count() == 0


def test_sums_of_texts_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    table = rng.random((64, 3)).astype(np.float32)
    bins = rng.integers(0, 64, 1000)
    starts, ends = np.array([0, 10, 500]), np.array([8, 498, 1000])
    want = [table[bins[a:b]].astype(float).sum(axis=0) for a, b in zip(starts, ends)]
    assert np.allclose(language._sums(table, bins, starts, ends), want)
    monkeypatch.setattr(language, "CHUNK_CHARS", 7)
    assert np.allclose(language._sums(table, bins, starts[1:2], ends[1:2]), want[1:2])


def test_pipeline_filter_keeps_long_texts(spark):
    lines = " ".join(f"the w{i:x} of" for i in range(400_000))
    assert quality.passing(spark.createDataFrame([(3, lines)], "doc_id long, text string")).count() == 1


def test_language_of_odd_rows(odd_docs):
    out = language.identify_documents(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert all((r.language, r.kept) == ("und", False) for r in rows if not (r.row.text or "").strip())
    assert out.select("row.*").columns == odd_docs.columns
    assert language.identify_documents(odd_docs.limit(0)).count() == 0


# reputation


def judged(spark, urls, labels=()):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame(list(labels), "id long, bad int")
    return {r.page_id: r for r in reputation.judge(pages, outcomes).collect()}


def test_rules_and_parts_of_urls(spark):
    urls = [
        "http://A.Example.org/en/12?x", "https://example.org/es/", "http://notexample.org/es/1", "http://x.com/fr/1", "http://x.com/de/",
        "http://x.com/defoo", None, "no scheme", "http://org", "http://h.net?q=/a#b", "ftp://u@h.net:80/p#/z", "http://x.com/de/#a\nhttp://y",
    ]
    out = judged(spark, urls)
    want = [
        ("a.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/es/", "example.org/es/", "block"),
        ("notexample.org", "/es/1", "org/", "allow"), ("x.com", "/fr/1", "com/fr/", "allow"), ("x.com", "/de/", "com/de/", "block"),
        ("x.com", "/defoo", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "", None, "allow"),
        ("h.net", "", None, "allow"), ("u@h.net:80", "/p", None, "allow"), ("x.com", "/de/", "com/de/", "block"),
    ]
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(len(urls))] == want


def test_bad_hosts_are_blocked_on_evidence_only(spark):
    urls = ["http://bad.a.net/1"] * 40 + ["http://good.a.net/1"] * 40 + ["http://once.a.net/1", "http://other.b.net/x"]
    labels = [(i, 1) for i in range(40)] + [(40 + i, 0) for i in range(40)] + [(80, 1), (7777, 1), (0, None), (None, 1)]
    out = judged(spark, urls, labels)
    assert out[0].verdict == "block" and out[40].verdict == "allow" and out[80].verdict == "allow" and out[81].verdict == "allow"


def test_reputation_of_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert reputation.judge(pages, spark.createDataFrame([(1, 1)], "id long, bad int")).count() == 0
    pages = spark.createDataFrame([(None, "http://a.b/"), (None, None), (1, "http://a.b/"), (1, "http://a.b/")], "page_id long, url string")
    assert reputation.judge(pages, spark.createDataFrame([], "id long, bad int")).filter("verdict = 'allow'").count() == 4


def test_workers_give_memory_back_between_operators(monkeypatch):
    from tidemark.llm import common, sampling

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(common._RUNNING[0]))
    monkeypatch.setattr(common, "_RUNNING", [])
    monkeypatch.setattr(common, "_KEPT", {})
    for operator in ("language", "language", "lattices", "lattices", "language"):
        common.drop_others(operator)
    assert given == ["language", "lattices", "language"]
    # the waves over one chunk of texts are the larger part of a worker's memory
    assert sampling.CHUNK_CHARS <= 1 << 17


def test_memory_is_given_back():
    from tidemark.llm import common

    common.give_back()
