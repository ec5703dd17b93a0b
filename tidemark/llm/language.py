"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior per row: the likelihood of the text under byte trigram models, the
declared markup language, the country suffix of the address, and the host's prior. Priors come from votes of
the texts, counted by host, registered domain and suffix; each level is smoothed with the one above it and the
row's own vote is left out. A flat model stands for text in none of the languages.

The trigram models are fitted on a bounded sample of rows with a declared language (SAMPLE_ROWS per language,
the rows with the smallest hashes of their text); votes, reliabilities and priors cover all rows.

Defined results: a null, empty or blank text has no language and is rejected; a declaration outside of the
languages, or a null host or suffix, is no evidence; null hosts share the global prior. Repeated rows are
judged alike. Columns of the input are carried as they are, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_others
from tidemark.llm.wordcache import by_size
from tidemark.session import written

# Production parameters.
LANGUAGES = ("en", "de", "fr", "es")
UNKNOWN = "und"
SAMPLE_ROWS = 1500
BINS_LOG2 = 15
ADDED = 0.5
# Trigrams overlap: a text counts as a third of its trigrams, and as no more than EFFECTIVE of them.
EFFECTIVE = 150.0
STRENGTH = 20.0
PRIOR_UNKNOWN = 0.01
MIN_POSTERIOR = 0.5
# Characters whose trigrams are looked up at once; about 40 bytes each.
CHUNK_CHARS = 1 << 18
# Languages usual under country suffixes, and how much more likely such a suffix is for them.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
SUFFIX_FACTOR = 4.0


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all byte trigrams of the texts, A-Z lower-cased, and the first one of every text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n\n".join([*raw, b""]), np.uint8)
    # each text gives one trigram per byte; its last ones reach into the separator
    data = data | np.uint8(32) * ((data >= 65) & (data <= 90))
    wide = data.astype(np.uint32)
    code = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16) if len(wide) > 2 else np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        bins = (code * np.uint32(2654435761)) >> np.uint32(32 - BINS_LOG2)
    sizes = np.array([len(r) + 2 for r in raw], dtype=np.int64)
    return bins, np.concatenate([[0], np.cumsum(sizes)])


def fit(rows: DataFrame, text: str, declared: str, languages=LANGUAGES) -> np.ndarray:
    """Log probabilities of the bins per language, and of the flat model in the last row."""
    known = rows.select(F.col(text).alias("t"), F.col(declared).alias("d")).filter(F.col("d").isin(list(languages)))
    sizes = {r["d"]: r["n"] for r in known.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    # rows whose hash lies below the share that makes a sample of SAMPLE_ROWS, about, per language
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("d") == name, min(1.0, SAMPLE_ROWS / n)).otherwise(share)
    drawn = known.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches):
        drop_others("language")
        total = {name: np.zeros(1 << BINS_LOG2, np.int64) for name in languages}
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in by_size(texts, CHUNK_CHARS):
                bins, first = trigrams(texts[start:end])
                for name, a, b in zip(names[start:end], first[:-1], first[1:], strict=True):
                    total[name] += np.bincount(bins[a : max(a, b - 2)], minlength=1 << BINS_LOG2)
        for name, seen in total.items():
            at = np.flatnonzero(seen)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(seen[at])], names=["d", "bin", "n"])

    counted = drawn.mapInArrow(count, "d string, bin long, n long").groupBy("d", "bin").agg(F.sum("n").alias("n")).collect()
    seen = np.full((len(languages) + 1, 1 << BINS_LOG2), ADDED)
    seen[-1] = 1.0
    for r in counted:
        seen[languages.index(r["d"]), r["bin"]] += r["n"]
    logs = np.log(seen / seen.sum(axis=1, keepdims=True))
    # a language without samples is less likely than the flat model anywhere
    logs[:-1][seen[:-1].sum(axis=1) == ADDED * seen.shape[1]] -= 1.0
    return logs.astype(np.float32)


def _sums(table: np.ndarray, bins: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over bins[start:end]; a text of many chunks is summed chunk by chunk."""
    if not len(starts):
        return np.zeros((0, table.shape[1]))
    if len(starts) == 1:
        parts = range(int(starts[0]), int(ends[0]), CHUNK_CHARS)
        return sum((table[bins[a : min(a + CHUNK_CHARS, int(ends[0]))]].sum(axis=0, dtype=np.float64) for a in parts), np.zeros(table.shape[1]))[None]
    # sums between successive edges; those over the separators are left out
    edges = np.stack([starts, ends], axis=1).reshape(-1)
    inside = edges[:-1] if edges[-1] == len(bins) else edges
    return np.add.reduceat(table[bins], inside, axis=0, dtype=np.float64)[::2]


def likelihood(model: np.ndarray):
    """An Arrow function from texts to their tempered log likelihoods, one per model; null without trigrams."""
    table = np.ascontiguousarray(model.T)

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        drop_others("language")
        out: list = []
        for start, end in by_size(texts.to_pylist(), CHUNK_CHARS):
            values = texts.slice(start, end - start).to_pylist()
            bins, first = trigrams(values)
            # the last trigrams of a text reach into its separator
            ends = np.minimum(first[1:] - 2, len(bins))
            said = [k for k, value in enumerate(values) if (value or "").strip()]
            sums = iter(_sums(table, bins, first[:-1][said], ends[said]))
            sizes = ends - first[:-1]
            said = set(said)
            out += [next(sums) * (min(n / 3, EFFECTIVE) / max(1, n)) if k in said else None for k, n in enumerate(sizes.tolist())]
        return pa.array(out, pa.list_(pa.float64()))

    return score


def _normal(values: list[Column]) -> list[Column]:
    total = sum(values[1:], values[0])
    return [v / total for v in values]


def identify(
    rows: DataFrame,
    text: Column,
    declared: Column,
    host: Column | None = None,
    domain: Column | None = None,
    suffix: Column | None = None,
    languages=LANGUAGES,
) -> DataFrame:
    """(row, language, posterior, kept): ``row`` is the input row as one struct.

    Likelihoods are computed twice, for the votes and for the result: that takes less than writing whole rows
    in between. Priors and reliabilities are groupings of the votes.
    """
    nothing = F.lit(None).cast("string")
    model = fit(rows.select(text.alias("text"), declared.alias("declared")), "text", "declared", languages)
    # rows wait behind the Arrow function once, with the text as a part of them
    scored = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
        likelihood(model)(text).alias("ll"),
        F.when(declared.isin(list(languages)), declared).alias("declared"),
        (nothing if host is None else host).alias("host"),
        (nothing if domain is None else domain).alias("domain"),
        (nothing if suffix is None else suffix).alias("suffix"),
    )
    names = [*languages, UNKNOWN]
    vote = F.get(F.transform(F.array(F.col("ll")), lambda ll: F.array_position(ll, F.array_max(ll)).cast("int") - 1), F.lit(0))
    scored = scored.withColumn("vote", vote)

    counted = scored.filter("vote is not null").groupBy("host", "domain", "suffix", "declared", "vote").agg(F.count(F.lit(1)).alias("n"))
    counted = written(rows.sparkSession, counted)
    vector = F.array(*[F.sum(F.when(F.col("vote") == i, F.col("n")).otherwise(0)).cast("double") for i in range(len(names))])
    world = counted.agg(vector.alias("w")).first()["w"]
    total = sum(v or 0.0 for v in world) + len(languages)
    prior = [((v or 0.0) + 1.0) / total * (1 - PRIOR_UNKNOWN) for v in world[:-1]] + [PRIOR_UNKNOWN]
    # reliability of declarations: share of each declared language among the texts of a language, smoothed
    pairs = {(r["declared"], r["vote"]): r["n"] for r in counted.groupBy("declared", "vote").agg(F.sum("n").alias("n")).collect()}
    reliable = {}
    for d in languages:
        for i in range(len(names)):
            seen = sum(pairs.get((x, i), 0) for x in languages)
            reliable[d, i] = (pairs.get((d, i), 0) + (2.0 if i < len(languages) and names[i] == d else 0.5)) / (seen + 2.0 + 0.5 * (len(languages) - 1))

    hosts = counted.groupBy("host", "domain", "suffix").agg(vector.alias("v_host"))
    domains = counted.groupBy("domain", "suffix").agg(vector.alias("v_domain"))
    suffixes = counted.groupBy("suffix").agg(vector.alias("v_suffix"))
    same = lambda left, right, keys: left.join(
        right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in right.columns if c not in keys]),
        [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys], "left",
    ).drop(*[f"r_{k}" for k in keys])
    # a written table has a known size, so few hosts are broadcast by the planner and texts stay where they are
    table = written(rows.sparkSession, same(same(hosts, domains, ["domain", "suffix"]), suffixes, ["suffix"]))
    joined = same(scored, table, ["host", "domain", "suffix"])

    parts = [F.lit(p) for p in prior]
    for level, key in (("v_suffix", "suffix"), ("v_domain", "domain"), ("v_host", "host")):
        # counts without the row's own vote; an unknown name is no evidence
        use = F.col(key).isNotNull() & F.col(level).isNotNull()
        counts = [F.get(F.col(level), F.lit(i)) - F.when(F.col("vote") == i, 1.0).otherwise(0.0) for i in range(len(names))]
        seen = F.aggregate(F.col(level), F.lit(0.0), lambda s, v: s + v) - F.when(F.col("vote").isNotNull(), 1.0).otherwise(0.0)
        joined = joined.withColumns(
            {f"{level}_{i}": F.when(use, (c + STRENGTH * p) / (seen + STRENGTH)).otherwise(p) for i, (c, p) in enumerate(zip(counts, parts, strict=True))}
        )
        parts = [F.col(f"{level}_{i}") for i in range(len(names))]

    usual = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    country = F.get(F.transform(F.array(F.col("suffix")), lambda s: F.try_element_at(usual, s)), F.lit(0))
    logs = []
    for i, name in enumerate(names):
        said = F.lit(0.0)
        for d in languages:
            said = F.when(F.col("declared") == d, float(np.log(reliable[d, i]))).otherwise(said)
        place = F.when(country == name, float(np.log(SUFFIX_FACTOR))).otherwise(0.0)
        logs.append(F.get("ll", F.lit(i)) + F.log(parts[i]) + said + F.coalesce(place, F.lit(0.0)))
    joined = joined.select("row", "ll", F.array(*logs).alias("logs"))
    joined = joined.select("row", "ll", "logs", F.array_max("logs").alias("top"))
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    at = F.array_position("logs", F.col("top")).cast("int") - 1
    language = F.get(F.array(*[F.lit(n) for n in names]), at)
    out = joined.select(
        "row", F.coalesce(F.when(F.col("ll").isNotNull(), language), F.lit(UNKNOWN)).alias("language"),
        F.when(F.col("ll").isNotNull(), posterior).alias("posterior"),
    )
    kept = (F.col("language") != UNKNOWN) & (F.col("posterior") >= MIN_POSTERIOR)
    return out.withColumn("kept", F.coalesce(kept, F.lit(False)))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents: the declared ``lang`` and the ``source`` as host."""
    return identify(docs, F.col("text"), F.col("lang"), host=F.col("source"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """Web pages: the markup's ``lang``, the host with its domain and suffix, and the text without tags."""
    from tidemark.llm.reputation import host_of, levels

    markup = F.lower(F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2})", 1))
    text = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    by = {k: F.nullif(v, F.lit("")) for k, v in levels(host_of(F.col("url"))).items()}
    return identify(pages, text, markup, by["site"], by["domain"], by["suffix"])
