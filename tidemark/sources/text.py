"""Landed text files, read as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed pattern: what counts as a number in a price file.
NUMBER = r"^[-+]?\d*\.?\d+$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every file under ``path``; the file's base name is the symbol.

    ``line_no`` follows the order of the lines within a file: a split's offset,
    then the position inside the split.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return (
        spark.read.text(path)
        .select(
            "value",
            F.regexp_replace(name, r"\.[^.]*$", "").alias("symbol"),
            F.struct(
                F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")
            ).alias("line_no"),
        )
    )


def fields_of(line: str = "value") -> Column:
    """Comma-separated fields; empty fields at the end do not count."""
    return F.split(F.regexp_replace(line, ",+$", ""), ",")


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are computed once per row.

    Plain columns would be copied into every filter and projection behind them; what a generator makes is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def is_number(value: Column) -> Column:
    return F.coalesce(value.rlike(NUMBER), F.lit(False))
