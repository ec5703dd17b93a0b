"""From raw documents to sampled token ids, in five stages.

Every stage reads what the one before it wrote, drops or repeats rows of ``documents``, and returns its columns;
the last one returns the segmentations of every remaining document. Other columns are carried whatever their names, and
an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, mixing, neardup, quality, sampling
from tidemark.llm.common import settle, table
from tidemark.session import written

# Draws, shuffles and segmentations of this pipeline follow from hashes and cannot be written in SQL.
ORACLE_SQL = None


def _row_key(docs: DataFrame) -> DataFrame:
    """A hash of the whole row, under a name that no column of ``docs`` has."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the evidence settles; null, empty and blank texts go, equal rows are judged alike."""
    settle(spark)
    return language.identify_documents(docs).filter("kept").select("row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the rule table; null and empty texts go, long ones do not go for their length."""
    return quality.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, of equal rows one."""
    keyed = _row_key(docs)
    key = keyed.columns[-1]
    # ids may be null or repeat; (no id, id, row) orders rows the same way and tells them apart
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("row"))
    out = neardup.near_duplicates(keyed.select(place.alias("place"), "text"), id_col="place")
    stay = out.filter("kept").select(F.col("id.row").alias(key)).distinct()
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats every document as often as the mix takes it whole; a null source is a source of its own, texts without
    words go, and of equal rows one is repeated for all."""
    weights = mixing.quality_weights(table(spark, sf_dir, "labels")).withColumnRenamed("id", "w_id")
    keyed = _row_key(docs)
    key = keyed.columns[-1]
    sizes = keyed.select(F.col(key).alias("id"), "doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    sized = written(spark, sizes).join(weights, F.col("doc_id") == F.col("w_id"), "left")
    weight = F.coalesce("weight", F.lit(mixing.QUALITY_WEIGHT[None]))
    taken = mixing.mix(written(spark, sized.select("id", "source", "size", weight.alias("weight"))))
    # equal rows have one key; their passes are summed and given to one of them
    passes = taken.groupBy(F.col("id").alias(key)).agg(F.sum(F.col("epochs") + F.col("drawn")).alias("passes"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    repeated = keyed.dropDuplicates([key]).join(passes.filter("passes > 0"), key)
    row = F.struct(*names).alias("row")
    return repeated.select(row, F.explode(F.array_repeat(F.lit(0), F.col("passes").cast("int")))).select("row.*")


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document; a null or empty text has the empty one, repeated rows have
    theirs each."""
    import public_tokenizers

    return sampling.sample(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("near-duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("segmentations", sample_segmentations),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    settle(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
