"""Estimators and tail probabilities as expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k of ``c`` successes in ``n`` samples; an error if k is out of range or c > n."""
    if k <= 0:
        raise ValueError("k must be positive")
    product = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    bad = (n < k) | (c > n) | (c < 0)
    return F.when(bad, F.raise_error(F.lit("pass@k needs k samples and no more passes than samples")).cast("double")).when(n - c < k, 1.0).otherwise(1 - product)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def erfc(c: Column) -> Column:
    """Complementary error function; neither Spark nor ANSI SQL has it."""
    return F.pandas_udf(lambda x: pd.Series([None if v is None or v != v else math.erfc(v) for v in x], dtype="float64"), "double")(c)  # type: ignore[call-overload]


def two_sided(a: int, b: int) -> float:
    """Exact two-sided p of a : b discordant pairs: the lower tail of a fair coin, twice.

    Terms are summed from the largest down until they no longer count, so the work
    is that of the distribution's width, not of its size.
    """
    n, low = a + b, min(a, b)
    if not n:
        return 1.0
    top = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) - n * math.log(2)
    total, term, k = 0.0, 1.0, low
    while k >= 0 and term > 1e-18 * total:
        total += term
        term *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2 * math.exp(top) * total)


def binomial_two_sided(a: Column, b: Column) -> Column:
    run = lambda xs, ys: pd.Series([None if pd.isna(x) or pd.isna(y) else two_sided(int(x), int(y)) for x, y in zip(xs, ys, strict=True)], dtype="float64")
    return F.pandas_udf(run, "double")(a, b)  # type: ignore[call-overload]
