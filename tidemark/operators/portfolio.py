"""Return statistics, portfolio scoring and allocation.

A portfolio is a set of rows (portfolio_id, symbol, weight), dense over the
symbols. Its size is the number of symbols; the number of portfolios is what
grows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COST_RATE = 0.1
WEIGHT_TOLERANCE = 0.01


def return_stats(returns: DataFrame) -> DataFrame:
    return returns.groupBy("symbol").agg(
        F.avg("log_return").alias("mean"), F.var_samp("log_return").alias("variance"),
        F.stddev_samp("log_return").alias("stddev"),
    )


def return_vectors(returns: DataFrame) -> DataFrame:
    """One array of date-ordered returns per symbol; as long as the calendar."""
    dated = F.sort_array(F.collect_list(F.struct("trade_date", "log_return")))
    return returns.groupBy("symbol").agg(dated.alias("dated")).select(
        "symbol",
        F.transform("dated", lambda d: d.log_return).alias("returns"),
        F.transform("dated", lambda d: d.trade_date).alias("dates"),
    )


def _block_pairs(vectors: DataFrame, blocks: int) -> DataFrame:
    """Each vector once per pair of symbol blocks it belongs to.

    A pair of blocks is one matrix product of its own, so vectors travel
    ``blocks`` times instead of once per partner symbol.
    """
    own = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return (
        vectors.withColumn("own", own)
        .withColumn("other", other)
        .withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")})
        .drop("other")
    )


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return pdf[pdf["own"] == pdf["left"]], pdf[pdf["own"] == pdf["right"]]


def _names(values) -> pd.Series:
    """Symbols as plain objects: an extension type may reach Arrow in chunks."""
    return pd.Series(np.asarray(values, dtype=object), dtype=object)


def _nothing(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def covariance_matrix(vectors: DataFrame, blocks: int = 8) -> DataFrame:
    """Sample covariance of every pair of symbols, both orders; vectors share one calendar."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = _sides(pdf)
        if rows.empty or columns.empty:
            return _nothing("symbol_i", "symbol_j", "cov")
        x = np.vstack(rows["returns"].to_numpy())
        y = np.vstack(columns["returns"].to_numpy())
        x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        cov = x @ y.T / (x.shape[1] - 1)
        first = np.repeat(np.asarray(rows["symbol"], dtype=object), len(columns))
        second = np.tile(np.asarray(columns["symbol"], dtype=object), len(rows))
        values = cov.ravel()
        if pdf["left"].iloc[0] != pdf["right"].iloc[0]:
            first, second = np.concatenate([first, second]), np.concatenate([second, first])
            values = np.concatenate([values, values])
        out = pd.DataFrame({"symbol_i": _names(first), "symbol_j": _names(second), "cov": values})
        return out

    pairs = _block_pairs(vectors.select("symbol", "returns"), blocks)
    return pairs.groupBy("left", "right").applyInPandas(product, "symbol_i string, symbol_j string, cov double")


def return_pairs(vectors: DataFrame, blocks: int = 8) -> DataFrame:
    """Joint moments of each pair ``symbol_i <= symbol_j``: days and summed product of returns."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = _sides(pdf)
        if rows.empty or columns.empty:
            return _nothing("symbol_i", "symbol_j", "days", "product")
        x, y = np.vstack(rows["returns"].to_numpy()), np.vstack(columns["returns"].to_numpy())
        first = np.repeat(np.asarray(rows["symbol"], dtype=object), len(columns))
        second = np.tile(np.asarray(columns["symbol"], dtype=object), len(rows))
        swap = first > second
        low, high = np.where(swap, second, first), np.where(swap, first, second)
        out = pd.DataFrame({"symbol_i": _names(low), "symbol_j": _names(high)})
        out["days"], out["product"] = x.shape[1], (x @ y.T).ravel()
        return out.drop_duplicates(["symbol_i", "symbol_j"])

    pairs = _block_pairs(vectors.select("symbol", "returns"), blocks)
    return pairs.groupBy("left", "right").applyInPandas(
        product, "symbol_i string, symbol_j string, days long, product double"
    )


def rolling_calibration(vectors: DataFrame, look_back: int, blocks: int = 8) -> DataFrame:
    """Covariance of each pair ``symbol_i <= symbol_j`` over the last ``look_back`` dates, per date."""

    def rolling(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = _sides(pdf)
        pairs = {tuple(sorted((a, b))): (a, b) for a in rows["symbol"] for b in columns["symbol"]}
        if not pairs:
            return _nothing("symbol_i", "symbol_j", "trade_date", "cov")
        series = {s: pd.Series(r) for s, r in zip(pdf["symbol"], pdf["returns"])}
        cov = np.array([series[a].rolling(look_back).cov(series[b]).to_numpy() for a, b in pairs.values()])
        pair, day = np.nonzero(~np.isnan(cov))
        low, high = np.array(list(pairs), dtype=object).T
        dates = np.asarray(pdf["dates"].iloc[0])
        return pd.DataFrame(
            {"symbol_i": _names(low[pair]), "symbol_j": _names(high[pair]), "trade_date": dates[day], "cov": cov[pair, day]}
        )

    return _block_pairs(vectors, blocks).groupBy("left", "right").applyInPandas(
        rolling, "symbol_i string, symbol_j string, trade_date date, cov double"
    )


def portfolio_return(weights: DataFrame, means: DataFrame) -> DataFrame:
    joined = weights.join(means.select("symbol", "mean"), "symbol")
    return joined.groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("mean")).alias("expected_return"))


def portfolio_risk(weights: DataFrame, covariance: DataFrame) -> DataFrame:
    """Variance of each portfolio; a weight on a symbol without covariances adds nothing.

    Weights meet the covariance table once per side, whatever its size, so it is never moved whole.
    """
    half = (
        weights.join(covariance.withColumnRenamed("symbol_i", "symbol"), "symbol")
        .groupBy("portfolio_id", F.col("symbol_j").alias("symbol"))
        .agg(F.sum(F.col("weight") * F.col("cov")).alias("exposure"))
    )
    return (
        weights.join(half, ["portfolio_id", "symbol"])
        .groupBy("portfolio_id")
        .agg(F.sum(F.col("weight") * F.col("exposure")).alias("risk"))
    )


def return_risk_ratio(returns: DataFrame, risks: DataFrame) -> DataFrame:
    both = returns.join(risks, "portfolio_id")
    none = (F.col("expected_return") == 0) | (F.col("risk") == 0)
    return both.withColumn("ratio", F.when(none, 0.0).otherwise(F.col("expected_return") / F.col("risk")))


def transaction_cost(current: DataFrame, weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of moving from the current weights to each portfolio, at a share of the price."""
    known = prices.select("symbol", (F.col("close") * COST_RATE).alias("cost"))
    change = F.abs(F.coalesce("current_weight", F.lit(0.0)) - F.col("weight"))
    return (
        weights.join(current.select("symbol", F.col("weight").alias("current_weight")), "symbol", "left")
        .join(known, "symbol")
        .groupBy("portfolio_id")
        .agg(F.sum(change * F.col("cost")).alias("cost"))
    )


def weights_valid(weights: DataFrame) -> DataFrame:
    total = weights.groupBy("portfolio_id").agg(F.sum("weight").alias("total"))
    return total.withColumn("valid", F.abs(F.col("total") - 1) <= WEIGHT_TOLERANCE)


def equal_weights(members: DataFrame) -> DataFrame:
    """1/n per member; a portfolio has at most one row per symbol."""
    n = F.count(F.lit(1)).over(Window.partitionBy("portfolio_id"))
    return members.withColumn("weight", F.lit(1.0) / n)


def hash_uniform(*parts: Column) -> Column:
    """Repeatable uniform number in [0, 1) from the first 32 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_normal(*parts: Column) -> Column:
    """Repeatable standard normal number from two uniform ones."""
    u1, u2 = hash_uniform(*parts, F.lit("a")), hash_uniform(*parts, F.lit("b"))
    return F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * np.pi * u2)


def _normalised(ids: DataFrame, raw: Column) -> DataFrame:
    """Explodes an array of (symbol, weight) scaled to a total of 1, without a shuffle."""
    staged = ids.withColumn("raw", raw)
    total = F.aggregate("raw", F.lit(0.0), lambda acc, r: acc + r.weight)
    return (
        staged.withColumn("total", total)
        .select("portfolio_id", "total", F.inline("raw"))
        .select("portfolio_id", "symbol", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).alias("weight"))
    )


def candidate_portfolios(ids: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Random weights over all symbols for each portfolio id, scaled to 1."""
    raw = F.array(
        *[
            F.struct(F.lit(s).alias("symbol"), hash_uniform(F.col("portfolio_id"), F.lit(s)).alias("weight"))
            for s in symbols
        ]
    )
    return _normalised(ids, raw)


def perturb(weights: DataFrame, rate: float, round_no: int = 0) -> DataFrame:
    """Adds normal noise to a share of the weights, keeps them at 0 or above and rescales."""
    key = (F.col("portfolio_id"), F.col("symbol"), F.lit(round_no))
    moved = F.greatest(F.col("weight") + hash_normal(*key, F.lit("n")), F.lit(0.0))
    raw = weights.withColumn("weight", F.when(hash_uniform(*key, F.lit("p")) < rate, moved).otherwise(F.col("weight")))
    packed = raw.groupBy("portfolio_id").agg(F.sort_array(F.collect_list(F.struct("symbol", "weight"))).alias("raw_"))
    return _normalised(packed, F.col("raw_"))


def fitness(weights: DataFrame, means: DataFrame, covariance: DataFrame, current: DataFrame, prices: DataFrame) -> DataFrame:
    """Return over risk, less the cost of getting there."""
    ratio = return_risk_ratio(portfolio_return(weights, means), portfolio_risk(weights, covariance))
    return ratio.join(transaction_cost(current, weights, prices), "portfolio_id").withColumn(
        "fitness", F.col("ratio") - F.col("cost")
    )


def best_portfolios(scored: DataFrame, k: int, places: int = 9) -> DataFrame:
    """The ``k`` fittest; equal fitness up to ``places`` goes to the lower id."""
    return scored.orderBy(F.round("fitness", places).desc(), "portfolio_id").limit(k)


def allocate_funds(portfolio: DataFrame, weights: DataFrame, funds: Column) -> DataFrame:
    """New allocation per symbol; holdings stay, new symbols start without any."""
    fresh = weights.select("symbol", (funds * F.col("weight")).alias("new_allocation"))
    return portfolio.join(fresh, "symbol", "full_outer").select(
        "symbol",
        F.coalesce("new_allocation", "allocation").alias("allocation"),
        F.coalesce("held", F.lit(0.0)).alias("held"),
    )


def cutoffs(worth: DataFrame, expected_return: Column) -> DataFrame:
    """Loss and profit limits around a total worth, cut to two places, and whether they are hit."""
    cut = lambda c: F.floor(c * 100) / 100
    return (
        worth.withColumns(
            {
                "loss_cutoff": cut(F.col("base_worth") * (1 - expected_return)),
                "profit_cutoff": cut(F.col("base_worth") * (1 + expected_return)),
            }
        ).withColumn("triggered", (F.col("worth") <= F.col("loss_cutoff")) | (F.col("worth") >= F.col("profit_cutoff")))
    )
