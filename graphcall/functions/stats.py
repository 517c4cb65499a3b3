"""Special functions as columns: constant-time or fixed-length folds that stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the error function's series; all are positive, so nothing cancels.
ERF_TERMS = 120


def log_factorial(n: Column) -> Column:
    """ln n!, exact up to 20 and by Stirling's series beyond (error below 1e-12)."""
    x = n.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def poisson_logpmf(n: Column, mean: Column) -> Column:
    return n * F.ln(mean) - mean - log_factorial(n)


def erf(x: Column) -> Column:
    """2/sqrt(pi) exp(-x^2) sum of 2^k x^(2k+1) / (2k+1)!!; one or minus one beyond 6."""
    a = F.abs(x)
    start = F.struct(a.alias("term"), a.alias("sum"))
    step = lambda s, k: F.struct((s["term"] * 2 * a * a / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * 2 * a * a / (2 * k + 1)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(ERF_TERMS)), start, step, lambda s: s["sum"])
    value = F.when(a > 6, F.lit(1.0)).otherwise(F.lit(2 / math.sqrt(math.pi)) * F.exp(-a * a) * total)
    return F.when(x < 0, -value).otherwise(value)


def normal_cdf(z: Column) -> Column:
    return (1 + erf(z / math.sqrt(2))) / 2


def chi2_survival(x: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom."""
    return 1 - erf(F.sqrt(x / 2))


def poisson_cdf(n: Column, mean: Column) -> Column:
    """P(X <= n), a sum in log space from the largest term on."""
    terms = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long")), lambda k: F.exp(poisson_logpmf(k, mean)))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def trunc_phred(error: Column) -> Column:
    """-10 log10 of an error, truncated; 100 where it is zero or below 1e-10."""
    return F.when((error <= 1e-10), F.lit(100)).otherwise(F.floor(-10 * F.log10(F.greatest(error, F.lit(1e-300)))).cast("int"))
