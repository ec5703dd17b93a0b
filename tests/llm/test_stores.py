"""Archives and neighbours against brute force; the pipeline's stages on odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import neighbours, warc
from tidemark.llm.common import filesystem, table

SF = "/root/testdata/sf0.001"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "k", "p") for r in rows], "page_id long, url string, html string, key string, payload string")


def test_archives_round_trip(spark):
    big = "<p>" + "long text " * 300_000
    rows = [(1, "http://a/ b", "same"), (5, None, "same"), (3, "u", "same"), (2, "u", None), (4, "u", ""), (6, "ü", big), (None, "u", "x"),
            (7, "u", "x"), (8, "u", "tie"), (8, "u", "tie"), (None, "u", "only null"), (None, "u", "only null")]
    manifest = warc.write(pages_of(spark, rows))
    out = warc.read(spark, manifest, with_payload=True).collect()
    assert len(out) == len(rows) and all(r.error is None for r in out)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in out)
    last = {"same": 5, "": 4, big: 6, "x": 7, "tie": 8, "only null": None}
    want = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        refers = None if last[html or ""] in (page_id, None) else last[html or ""]
        want.append((page_id or 0, "response" if refers is None else "revisit", refers, len(body), warc.digest_of(body)))
    assert got == sorted(want, key=lambda w: (w[0], w[1], w[2] or 0, w[3], w[4]))
    assert {bytes(r.payload) for r in out if r.payload is not None} == {(h or "").encode() for _, _, h in rows}


def test_smaller_payloads_can_stay_responses(spark):
    out = warc.read(spark, warc.write(pages_of(spark, [(1, "u", "ab"), (2, "u", "ab")]), min_bytes=3)).collect()
    assert [r.record_type for r in out] == ["response", "response"]


def test_empty_table_has_no_archive(spark):
    manifest = warc.write(pages_of(spark, [(1, "u", "x")]).limit(0))
    assert manifest.count() == 0 and warc.read(spark, manifest).count() == 0


def test_broken_archives_are_reported(spark):
    rows = [(i, "u", f"body text {i} " * 50) for i in range(20)]
    path = warc.write(pages_of(spark, rows).coalesce(1)).first().path
    store, name = filesystem(path)
    with store.open_input_stream(name) as file:
        raw = file.read()

    def errors(data):
        return [error for _, _, error in warc.frames(pa.BufferReader(data)) if error]

    assert errors(raw) == []
    assert errors(raw[:-3]) == ["frame is cut off"]
    assert errors(raw[8:]) == ["no dictionary frame at the start"] and errors(raw[:100]) == ["dictionary frame is cut off"]
    broken = bytearray(raw)
    broken[-40:] = bytes(40)
    assert len(errors(bytes(broken))) == 1
    contents = [c for _, c, _ in warc.frames(pa.BufferReader(raw))]
    assert len(contents) == 20 and contents[0].startswith(b"WARC/1.1\r\n")
    good = contents[0]
    assert warc.parse(good)["error"] is None
    assert warc.parse(good[:-1])["error"] == "block has a wrong length"
    assert warc.parse(good.replace(b"body text", b"body tixt"))["error"] == "payload does not match its digest"
    assert warc.parse(good.replace(b"WARC-Type: response\r\n", b""))["error"] == "no header WARC-Type"
    assert warc.parse(good.replace(b"WARC/1.1", b"WARC/9.9"))["error"] == "not a WARC/1.1 record"


def neighbours_by_hand(ids, x, asked, k):
    out = {}
    for i in np.flatnonzero(asked):
        best = {}
        for j in np.flatnonzero(ids != ids[i]):
            best[ids[j]] = max(best.get(ids[j], -np.inf), float(x[j] @ x[i]))
        out[ids[i]] = [v for v, _ in sorted(best.items(), key=lambda b: (-b[1], b[0]))[:k]]
    return out


def test_recall_on_the_table(spark):
    rows = table(spark, SF.replace("0.001", "0.1"), "embeddings")
    got = {}
    for r in neighbours.search(rows, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    local = rows.collect()
    ids, x = np.array([r.vec_id for r in local]), np.array([r.embedding for r in local], dtype=np.float64)
    want = neighbours_by_hand(ids, x, ids % 20 == 0, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[q] & set(v)) / 20 for q, v in want.items()]) > 0.95


def test_blocks_and_queries_cut_by_batches(spark, monkeypatch):
    """Several index blocks in a partition, whose rows come in small Arrow batches."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 60)
    monkeypatch.setattr(neighbours, "WANTED", 1.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = neighbours.search(rows, F.col("vec_id") % 10 == 0, k=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = neighbours_by_hand(np.arange(700), x, np.arange(700) % 10 == 0, 5)
    assert len(found) == 5 * 70 == len({(r.query_id, r.rank) for r in found})
    assert sum(r.vec_id in want[r.query_id] for r in found) > 0.95 * 5 * 70


def test_lengths_of_vectors_count(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.2, 3, size=(600, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.search(rows, F.col("vec_id") % 10 == 0, k=5).collect()
    want = neighbours_by_hand(np.arange(600), x, np.arange(600) % 10 == 0, 5)
    hits = sum(r.vec_id in want[r.query_id] for r in found)
    assert hits > 0.9 * 5 * 60
    assert all(r.score == pytest.approx(float(x[r.vec_id] @ x[r.query_id])) for r in found)


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, size=(3000, 4), dtype=np.uint8)
    for index in (neighbours.Index(codes), neighbours.Index(codes, 9)):
        for radius in (0, 3, 9, 14, 32):
            for code in [*codes[:20], *codes[:20]]:
                want = np.flatnonzero(np.bitwise_count(codes ^ code).sum(axis=1) <= radius)
                assert index.within(code, radius).tolist() == want.tolist()
    wide = rng.integers(0, 256, size=(500, 11), dtype=np.uint8)
    index = neighbours.Index(wide, 36)
    for code in wide[:20]:
        assert index.within(code, 36).tolist() == np.flatnonzero(np.bitwise_count(wide ^ code).sum(axis=1) <= 36).tolist()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1.0]), (9, []), (10, [2.0, 0.0]), (10, [3.0, 0.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, x string, score double")
    out = neighbours.search(df, F.col("vec_id") % 10 == 0, k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out if r.query_id == 0] == [
        (0, 1, 10, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, -1.0),
    ]
    assert {r.query_id for r in out} == {0, 10, 20}
    assert neighbours.search(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def repeated_vectors(times):
    """Rows that repeat ids: ``times`` gives the copies of each id, each a little off the first."""
    rng = np.random.default_rng(3)
    ids = np.repeat(np.arange(len(times)), times)
    x = rng.normal(size=(len(times), 16))[ids] + 0.05 * rng.normal(size=(len(ids), 16))
    return ids, x


@pytest.mark.parametrize("times", [[2] * 900, [90 if i % 10 == 5 else 1 for i in range(600)]], ids=["twice", "hot"])
def test_repeated_ids_count_once(spark, times):
    ids, x = repeated_vectors(times)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    asked = len(times) // 30
    got = {}
    for r in neighbours.search(rows, F.col("vec_id") % asked == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    # the best score of every id per row that asks
    asking = np.flatnonzero(ids % asked == 0)
    starts = np.flatnonzero(np.diff(ids, prepend=-1))
    best = np.maximum.reduceat(x[asking] @ x.T, starts, axis=1)
    assert set(got) == set(ids[asking].tolist()) and all(len(found) == 20 for found in got.values())
    hits = 0
    for q, found in got.items():
        mine = best[ids[asking] == q]
        assert all(any(v == pytest.approx(m[i]) for m in mine) for i, v in found.items())
        order = [i for i in np.argsort(-mine.max(axis=0)).tolist() if i != q]
        hits += len(set(found) & set(order[:20]))
    assert hits > 0.95 * 20 * len(got)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_take_odd_rows(spark, odd_docs, stage):
    out = stage[1](spark, odd_docs, SF)
    assert out.columns == odd_docs.columns
    out.collect()
    assert stage[1](spark, odd_docs.limit(0), SF).count() == 0


def test_one_document_of_each_group_stays(spark, odd_docs):
    out = corpus_pipeline.drop_near_duplicates(spark, odd_docs, SF)
    ids = sorted(r.doc_id or 0 for r in out.collect())
    assert ids == [0, 0, 1, 3, 4, 5, 6, 7, 9]


def test_mix_stage_repeats_documents(spark):
    docs = table(spark, SF, "documents")
    out = corpus_pipeline.mix_sources(spark, docs, SF)
    times = [r["count"] for r in out.groupBy("doc_id").count().collect()]
    assert max(times) <= 3 and out.select("doc_id").distinct().count() <= docs.count()


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.filter("sample = 0").count() > 100
    assert out.filter("n_tokens <> size(ids) OR log_prob > 0 OR log_inclusion > 0").count() == 0
