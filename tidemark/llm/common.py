"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import prepare

# White space that separates words; both regular expression dialects read it alike.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(spark: SparkSession) -> SparkSession:
    """Runtime settings of these operators on top of the package's."""
    prepare(spark)
    # operators write tables between jobs; the shuffles before them need not outlive their job
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    # whole texts travel in batches: fewer rows and bytes each keep the workers small
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return spark


def words(text: Column) -> Column:
    """The words of a text as an array; no words for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def bounded_sample(df: DataFrame, n: int, key: str, rows: int) -> list:
    """About ``rows`` of the ``n`` rows of ``df``, those with small hashes of ``key``, collected in their order.

    Tasks drop the others themselves, so the driver gets twice that number at most, however many tasks there are.
    """
    spread = 1 << 30
    share = min(spread, -(-rows * spread // max(n, 1)))
    drawn = df.withColumn("__h", F.pmod(F.xxhash64(F.col(key)), F.lit(spread))).filter(F.col("__h") < share)
    return sorted(drawn.limit(2 * rows).collect(), key=lambda r: (r["__h"], str(r[key])))


# What the operators of a worker keep between batches, by operator: functions that let it go.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """Names the function that drops what ``operator`` keeps in a worker."""
    _KEPT[operator] = drop


# The operator whose tasks a worker ran last.
_RUNNING: list[str] = []


def drop_others(operator: str) -> None:
    """Lets go of what other operators keep: a worker goes on to the tasks of the next stage.

    What they freed goes back to the system first, or the next operator's memory would come on top of it.
    """
    for name, drop in _KEPT.items():
        if name != operator:
            drop()
    if _RUNNING != [operator]:
        _RUNNING[:] = [operator]
        give_back()


def give_back() -> None:
    """Returns freed memory of this process to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def filesystem(uri: str):
    """File system and path of ``uri``; works for every scheme that Arrow opens."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
