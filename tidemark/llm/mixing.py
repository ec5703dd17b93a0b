"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Sources get targets in words by weight; a target stops at a multiple of the source's size and the excess goes
to the others by weight. A source first gives its whole documents as many times as fit into the target
(complete epochs). The rest is drawn: every document has the key ``-ln(u) / weight`` with ``u`` from a hash of
its id, documents are sorted by key within the source, and a running sum of sizes selects them up to the
budget. Of the document on the border the mix takes the words that the budget still lacks, so a source's taken words
are its target but for rounding; ``drawn`` is for mixes of whole documents and says whether the border's document
brings their sum closer to the budget.

Sorting one source is split: the keys' distribution is known, a mixture of exponentials over the weight
levels, so its distribution function cuts a source of n documents into about sqrt(n) chunks of equal share.
A running sum needs one chunk per task and the totals of the chunks before it.

Defined results: null and empty texts have size 0 and are taken 0 words; a null source is a source of its own,
last in order; rows with a null id share one key; repeated rows are documents of their own, in the same
place of the order, and which of two equal rows is taken makes no difference. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD

SEED = 20_240_117
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
# Quality weights by label; the levels a key can be scaled by.
QUALITY_WEIGHT = {1: 1.0, None: 0.5, 0: 0.25}


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(id, weight) per labelled document; the lowest of several labels counts."""
    level = F.when(F.min("quality") == 1, QUALITY_WEIGHT[1]).when(F.min("quality") == 0, QUALITY_WEIGHT[0])
    return labels.groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(level, F.lit(QUALITY_WEIGHT[None])).alias("weight"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target words per source from rows (source, source_size): the water level that spends all sizes.

    Source i gets min(max_epochs * size_i, level * weight_i). Sources are put in the order in which a rising
    level caps them; the level that holds for the rest after capping a prefix is exact, and the first prefix
    whose next source is not capped by it is the answer. One row per source, so one task holds them.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    table = F.array(*[F.lit(w) for w in weights])
    rows = sizes.withColumn("w", F.get(table, (F.row_number().over(order) - 1) % len(weights)))
    cap = F.col("source_size") * max_epochs
    rows = rows.withColumn("cap", cap).withColumn("ratio", cap.cast("double") / F.col("w"))
    rising = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    rows = (
        rows.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("used", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
    )
    rows = rows.withColumn("level", (F.col("total") - F.col("spent")).cast("double") / (F.col("all_w") - F.col("used")))
    # the first source, in rising order, that its level leaves uncapped
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))
    rows = rows.withColumn("water", F.min(fits).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("water") * F.col("w"))
    return rows.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From rows (id, source, size, weight): id, source, size, source_size, target, epochs, drawn, taken.

    ``docs`` is read several times; hand in a written table, not a scan of texts.
    """
    levels = sorted(set(QUALITY_WEIGHT.values()))
    per_source = docs.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.when(F.col("weight") == level, 1).otherwise(0)).alias(f"n{i}") for i, level in enumerate(levels)],
    )
    plan = targets(per_source.select("source", "source_size"), weights, max_epochs)
    plan = plan.withColumnRenamed("source", "t_source").withColumnRenamed("source_size", "t_size")
    plan = per_source.join(plan, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source", "t_size")
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", F.least(epochs, F.lit(max_epochs).cast("long")))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumnRenamed("source", "p_source")

    u = (F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("key", -F.log(u) / F.col("weight"))
    share = sum(
        (F.col(f"n{i}") / F.col("n") * (1 - F.exp(-F.lit(level) * F.col("key"))) for i, level in enumerate(levels)), F.lit(0.0)
    )
    chunks = F.ceil(F.sqrt(F.col("n")))
    rows = rows.withColumn("chunk", F.least(F.floor(share * chunks), chunks - 1).cast("int"))

    totals = rows.groupBy("p_source", "chunk").agg(F.sum("size").alias("chunk_size"))
    earlier = Window.partitionBy("p_source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("p_source").alias("o_source"), F.col("chunk").alias("o_chunk"),
        F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("source", "chunk").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside)).join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("chunk") == F.col("o_chunk"))
    )
    end = F.col("offset") + F.col("inside")
    drawn = end - F.col("size") / 2 <= F.col("budget")
    part = F.least(F.greatest(F.round("budget").cast("long") - (end - F.col("size")), F.lit(0)), F.col("size"))
    part = F.when(F.col("epochs") < max_epochs, part).otherwise(0)
    return rows.select(
        "id",
        "source",
        "size",
        "source_size",
        "target",
        "epochs",
        (drawn & (F.col("epochs") < max_epochs)).cast("long").alias("drawn"),
        (F.col("size") * F.col("epochs") + part).cast("long").alias("taken"),
    )
