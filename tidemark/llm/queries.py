"""The queries over the driver's tables and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    alignment, counts, language, mixing, neardup, neighbours, packing, quality, reputation, sampling, spelling, tokenfiles, warc,
)
from tidemark.llm.common import settle, table
from tidemark.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            settle(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_sentencepiece_sampling")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read(spark, tokenfiles.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


@query("op3_multi_index_hashing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op4_source_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(mix_input(spark, table(spark, sf_dir, "documents"), sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "epochs", "drawn")


def mix_input(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(id, source, size, weight) of the documents as a written table: texts are read once."""
    sizes = docs.select(F.col("doc_id").alias("id"), "source", mixing.size_of(F.col("text")).alias("size"))
    weights = mixing.quality_weights(table(spark, sf_dir, "labels")).withColumnRenamed("id", "w_id")
    weight = F.coalesce("weight", F.lit(mixing.QUALITY_WEIGHT[None]))
    sized = written(spark, sizes).join(weights, F.col("id") == F.col("w_id"), "left")
    return written(spark, sized.select("id", "source", "size", weight.alias("weight")))


@query("op5_hyperminhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


QUALITY_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS times FROM places),
spots AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM windows WHERE times > 1),
repeats AS (SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n FROM spots GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
bare AS (SELECT doc_id, list_transform(w, lambda x: lower(rtrim(x, '.,;:!?'))) AS b FROM d),
base AS (
  SELECT d.doc_id, len(w) AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(list_filter(b, lambda x: x IN (STOPS))) AS n_stop,
         len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_sym,
         len(list_filter(w, lambda x: contains(x, '!!'))) AS n_bang,
         length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^\\p{Lu}]+', '', 'g')) AS n_upper
  FROM d JOIN lines USING (doc_id) JOIN bare USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 1000000 AND word_chars / n_words BETWEEN 2.0 AND 16.0
         AND n_sym / n_words <= 0.25 AND n_bang / n_words <= 0.5
         AND coalesce(n_upper / nullif(n_letters, 0), 0) <= 0.7 AND n_stop / n_words >= 0.02
         AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.6 AND n_repeat_words / n_words <= 0.3 AS kept
FROM judged""".replace(
    "STOPS", ", ".join(f"'{w}'" for w in sorted({w for line in quality.STOP_WORDS.values() for w in line.split()}))
)


@query("op6_quality_rules", QUALITY_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"]).select(*names)


REPUTATION_SQL = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
named AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\\d*$', '') AS site FROM p),
cut AS (
  SELECT *, array_to_string(string_split(site, '.')[-2:], '.') AS last2, array_to_string(string_split(site, '.')[-3:], '.') AS last3,
         string_split(site, '.')[-1] AS last1 FROM named),
leveled AS (
  SELECT page_id, host, path, site, CASE WHEN last2 IN (TWO) THEN last3 ELSE last2 END AS domain,
         CASE WHEN last2 IN (TWO) THEN last2 ELSE last1 END AS suffix FROM cut),
labelled AS (SELECT doc_id AS id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 THEN 0 END) AS bad FROM labels GROUP BY doc_id),
evidence AS (
  SELECT suffix, domain, site, bad FROM (SELECT DISTINCT page_id, suffix, domain, site FROM leveled) l
  JOIN labelled ON page_id = id WHERE bad IS NOT NULL),
sites AS (SELECT suffix, domain, site, count(*) AS n, sum(bad) AS bad FROM evidence GROUP BY ALL),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM sites GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
s0 AS (SELECT s.*, (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) FROM suffixes) AS mean FROM suffixes s),
s1 AS (SELECT STRENGTH AS strength FROM s0),
s2 AS (SELECT suffix, mean * strength + bad AS a, (1 - mean) * strength + n - bad AS b FROM s0, s1),
d0 AS (SELECT d.*, a / (a + b) AS mean FROM domains d JOIN s2 USING (suffix)),
d1 AS (SELECT suffix, STRENGTH AS strength FROM d0 GROUP BY suffix),
d2 AS (SELECT suffix, domain, mean * strength + bad AS a, (1 - mean) * strength + n - bad AS b FROM d0 JOIN d1 USING (suffix)),
h0 AS (SELECT h.*, a / (a + b) AS mean FROM sites h JOIN d2 USING (suffix, domain)),
h1 AS (SELECT suffix, domain, STRENGTH AS strength FROM h0 GROUP BY suffix, domain),
h2 AS (SELECT suffix, domain, site, mean * strength + bad AS a, (1 - mean) * strength + n - bad AS b FROM h0 JOIN h1 USING (suffix, domain)),
s3 AS (SELECT suffix, a / (a + b) * strength AS a, (1 - a / (a + b)) * strength AS b FROM s2 JOIN d1 USING (suffix)),
d3 AS (SELECT domain, a / (a + b) * strength AS a, (1 - a / (a + b)) * strength AS b FROM d2 JOIN h1 USING (suffix, domain)),
ruled AS (
  SELECT l.*, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    coalesce((SELECT BOUND FROM h2 WHERE h2.site = l.site), (SELECT BOUND FROM d3 WHERE d3.domain = l.domain),
             (SELECT BOUND FROM s3 WHERE s3.suffix = l.suffix), FALSE) AS bad
  FROM leveled l)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""".replace("TWO", ", ".join(f"'{s}'" for s in reputation.TWO_LABEL_SUFFIXES)).replace(
    "STRENGTH",
    "CASE WHEN sum(n * pow(bad / n - mean, 2)) <= sum(mean * (1 - mean)) THEN least(count(*), 1000.0) ELSE least(greatest("
    "sum(mean * (1 - mean) * (n - 1)) / (sum(n * pow(bad / n - mean, 2)) - sum(mean * (1 - mean))) - 1, 1.0), count(*), 1000.0) END",
).replace("BOUND", f"a / (a + b) - {reputation.BOUND_Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {reputation.MAX_BAD}")


@query("op7_url_reputation", REPUTATION_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), bad.alias("bad"))
    return reputation.judge(table(spark, sf_dir, "pages"), outcomes)


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op9_language_evidence")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("row.doc_id", F.col("row.lang").alias("declared"), "language", "posterior", "kept")


@query("page_language_evidence")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify_pages(table(spark, sf_dir, "pages"))
    return out.select("row.page_id", "language", "posterior", "kept")


@query("op10_warc_archives")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(spark, warc.write(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, packed = packing.pack_documents(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark, table(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.link_scores(spark, docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
