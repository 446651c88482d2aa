"""Paired comparison of two sets of binary outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.numeric import binomial_two_sided, erfc


def contingency(a: DataFrame, b: DataFrame, key: str = "name", value: str = "outcome") -> DataFrame:
    """One row over the common keys: n, both, a_only, b_only, neither, the rates and their difference in points."""
    joined = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    is_ = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    rate = lambda c: 100.0 * F.avg(c)
    return joined.agg(
        F.count("*").alias("n"), is_(1, 1).alias("both"), is_(1, 0).alias("a_only"), is_(0, 1).alias("b_only"), is_(0, 0).alias("neither"),
        rate("a").alias("rate_a"), rate("b").alias("rate_b"), (rate("b") - rate("a")).alias("diff"),
    )


def mcnemar(counts: DataFrame) -> DataFrame:
    """The contingency row with the corrected statistic, its p and the exact p; null without discordant pairs."""
    a, b = F.col("a_only"), F.col("b_only")
    stat = F.when(a + b > 0, (F.abs(a - b) - 1) * (F.abs(a - b) - 1) / (a + b))
    return counts.withColumn("statistic", stat).withColumn("p_value", erfc(F.sqrt(F.col("statistic") / 2))).withColumn("p_exact", F.when(a + b > 0, binomial_two_sided(a, b)))


def bootstrap_ci(counts: DataFrame, samples: int = 10_000, seed: int = 0) -> DataFrame:
    """2.5 and 97.5 % order statistics, and the mean, of the resampled difference (b - a, in points).

    Pairs come in three kinds: a only, b only, and the rest.  How often a resample
    draws each is multinomial, so a resample is one draw of three counts, whatever
    the number of pairs.  Without pairs all are null.
    """

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for n, a, b in zip(rows["n"], rows["a_only"], rows["b_only"], strict=True):
                if not n:
                    out.append((None, None, None))
                    continue
                drawn = np.random.default_rng(seed).multinomial(n, [a / n, b / n, max(0.0, 1 - (a + b) / n)], samples)
                diffs = np.sort(100.0 * (drawn[:, 1] - drawn[:, 0]) / n)
                out.append((diffs[int(0.025 * samples)], diffs[int(0.975 * samples)], diffs.mean()))
            yield pd.DataFrame(out, columns=["low", "high", "mean"], dtype="float64")

    return counts.select("n", "a_only", "b_only").mapInPandas(resample, "low double, high double, mean double")  # one row
