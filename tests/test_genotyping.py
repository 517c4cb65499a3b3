"""Values of the genotype model that are known by hand or from formulas."""

import math

import pytest
from pyspark.sql import functions as F

from graphcall.functions import stats
from graphcall.operators import genotyping, robust


def call(spark, counts, depth=40.0, length=100.0, sd=20.0, ploidy=2):
    rows = spark.createDataFrame([(counts, depth, sd, length, ploidy)], "counts array<long>, depth double, depth_sd double, read_length double, ploidy int")
    return genotyping.called(rows).first()


@pytest.mark.parametrize(("counts", "gt"), [([20, 0], [0, 0]), ([20, 20], [0, 1]), ([0, 20], [1, 1]), ([1, 20, 2, 20, 2], [1, 3])])
def test_calls(spark, counts, gt):
    assert call(spark, counts).gt == gt


def test_haploid_and_none(spark):
    assert call(spark, [0, 20], ploidy=1).gt == [1]
    none = call(spark, [0, 0])
    assert none.gt is None and none.filters == ["NO_READS"]


def test_coverage_p_values(spark):
    assert call(spark, [0, 20]).pvalue == pytest.approx(0.24825223, abs=1e-7)
    row = spark.range(1).select(stats.poisson_cdf(F.lit(20), F.lit(33.6)).alias("p")).first()
    assert row.p == pytest.approx(0.0080560343, abs=1e-9)


@pytest.mark.parametrize(("counts", "gl"), [([564, 0], (-31.606, -395.74)), ([266, 266], (-462.35, -7.437, -462.35)), ([238, 238], (-420.65, -10.802, -420.65))])
def test_likelihoods(spark, counts, gl):
    got = call(spark, counts, depth=600.0, length=150.0).gl
    for a, b in zip(got, gl, strict=False):
        assert a == pytest.approx(b, rel=1e-4)


def test_conflict_is_called_again(spark):
    rows = spark.createDataFrame([(1, 1, [5, 5]), (1, 1, [0, 10])], "site int, sample_id int, counts array<long>")
    rows = rows.select("*", F.lit(10.0).alias("depth"), F.sqrt(F.lit(50.0)).alias("depth_sd"), F.lit(100.0).alias("read_length"), F.lit(2).alias("ploidy"))
    got = genotyping.combined(genotyping.called(rows), ["site", "sample_id"]).first()
    assert got.gt == [0, 1] and got.gq == 8 and "CONFLICT" in got.filter


def test_hardy_weinberg(spark):
    row = spark.range(1).select(genotyping.hwe_chisq(F.lit(83), F.lit(13), F.lit(4)).alias("c"), genotyping.hwe_exact(F.lit(83), F.lit(13), F.lit(4)).alias("e")).first()
    assert row.c == pytest.approx(0.0020474148859159769, abs=1e-10) and row.e == pytest.approx(0.010293433548874801, abs=1e-10)


def test_phred_likelihoods(spark):
    gl = lambda *n: genotyping.phred_likelihoods(genotyping.likelihoods(F.array(*map(F.lit, n)), F.lit(1.0 * (50 - 16) / 50), F.lit(2)))
    row = spark.range(1).select(gl(0, 1).alias("a"), gl(0, 4).alias("b")).first()
    assert row.a == [30, 7, 0] and row.b == [120, 28, 0]


def test_special_functions(spark):
    xs = [0.0, 0.3, 1.0, 2.5, 4.5, -1.7, 9.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erf(F.col("x")).alias("e")).collect()
    assert all(r.e == pytest.approx(math.erf(r.x), abs=1e-12) for r in rows)
    rows = spark.range(0, 400).select("id", stats.log_factorial(F.col("id")).alias("f")).collect()
    assert all(r.f == pytest.approx(math.lgamma(r.id + 1), rel=1e-12, abs=1e-12) for r in rows)


def test_robust_fit(spark):
    values = [1 + k / 10 for k in range(11)] + [10.0]
    rows = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    got = robust.mcd_fit(rows, ["k"], "v").first()
    assert got.mean == pytest.approx(1.5) and got.support == 11
