"""Location and spread of groups: plain, and the one-dimensional minimum covariance determinant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcall.operators import ordered
from graphcall.operators.storage import cut, each_copy

#: Squared distance, in variances, beyond which a value is no part of the reweighted fit: 97.5 % of chi-squared with one degree.
REWEIGHT_CUT = 5.02388618731489


def naive_fit(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample variance by group."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.count(value).alias("n"))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact medians by group, from counts of distinct values in ranges: no task holds a group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = ordered.running(ordered.sliced(counts, keys, [value]), keys, [value], sums={"_upto": F.col("_n")})
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    met = placed.join(total, keys)
    # The middle value of an odd number, the two middle ones of an even.
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    inside = lambda k: (F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k)
    return met.where(inside(low) | inside(high)).groupBy(*keys).agg(F.avg(value).alias("median"))


def basic(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    plain = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.min(value).alias("least"))
    return medians(rows, keys, value).join(plain, keys).select(*keys, "median", "mean", "variance", "least")


def argmin_all(rows: DataFrame, keys: list[str], value: str, id_col: str) -> DataFrame:
    """All rows that have their group's least value."""
    least = rows.groupBy(*keys).agg(F.min(value).alias("_least"))
    return rows.join(least, keys).where(F.col(value).eqNullSafe(F.col("_least"))).select(*keys, id_col, value)


def mcd_fit(rows: DataFrame, keys: list[str], value: str, fraction: float = 0.5) -> DataFrame:
    """Robust mean and variance: the half of the sorted values with the least variance, then those near it.

    Every window of h neighbours in order is a candidate; its variance comes from running sums over ranges
    of the group's values, so no task holds a group. Sums are of values
    less the group's mean, against cancellation. Ties go to the leftmost window.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("x"), F.xxhash64(*[F.col(k) for k in rows.columns]).alias("_tie")).where("x IS NOT NULL")
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("shift"))
    # Rows that repeat have one place in order; their copies are told apart there.
    rows = rows.groupBy(*keys, "x", "_tie").agg(F.count("*").alias("_m"))
    rows = each_copy(cut(rows, "values"), "_m", "_copy").drop("_m")
    rows = rows.join(whole, keys).withColumn("c", F.col("x") - F.col("shift"))
    order = ["x", "_tie", "_copy"]
    rows = ordered.running(ordered.sliced(rows, keys, order), keys, order, sums={"i": F.lit(1).cast("long"), "s1": F.col("c"), "s2": F.col("c") * F.col("c")}).drop("_slice")
    rows = rows.withColumn("h", F.least("n", F.floor(F.col("n") * fraction).cast("long") + 1))
    # The window that ends at rank i begins after rank i - h.
    begin = rows.select(*keys, (F.col("i") + F.col("h")).alias("i"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    ends = rows.where("i >= h").select(*keys, "i", "h", "n", "shift", "s1", "s2").join(begin, [*keys, "i"], "left")
    m = (F.col("s1") - F.coalesce("b1", F.lit(0.0))) / F.col("h")
    var = (F.col("s2") - F.coalesce("b2", F.lit(0.0))) / F.col("h") - m * m
    best = ends.select(*keys, F.struct(F.round(var, 12).alias("v"), "i", (m + F.col("shift")).alias("m"), var.alias("raw")).alias("w"))
    fit = best.groupBy(*keys).agg(F.min("w").alias("w")).select(*keys, F.col("w.m").alias("raw_mean"), F.greatest("w.raw", F.lit(0.0)).alias("raw_variance"))
    near = rows.select(*keys, "x").join(fit, keys)
    near = near.where((F.col("x") - F.col("raw_mean")) * (F.col("x") - F.col("raw_mean")) <= REWEIGHT_CUT * F.greatest("raw_variance", F.lit(1e-300)) * REWEIGHT_SCALE)
    return near.groupBy(*keys, "raw_mean", "raw_variance").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.count("*").alias("support"))


#: Consistency factor of the variance of the middle half of a normal sample.
REWEIGHT_SCALE = 6.9646
