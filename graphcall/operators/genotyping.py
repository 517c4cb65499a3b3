"""The Poisson genotype model: likelihoods, calls, tests, combination over breakpoints, population statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcall.functions import stats

# Fixed values of the model.
MIN_OVERLAP = 16
ERROR_RATE = 0.05
HAPLOTYPE_FRACTION = 0.5
MIN_PASS_GQ = 10
HIGH_DEPTH_P = 0.02
LOW_DEPTH_P = 1e-4
#: Standard normal quantiles of the two tails.
HIGH_DEPTH_Z, LOW_DEPTH_Z = 2.0537489106318225, -3.719016485455709
#: Log of the least positive number: a probability of zero counts as this.
LOG_FLOOR = -745.0


def genotypes_of(n_alleles: Column, ploidy: int) -> Column:
    """All genotypes of ``ploidy`` copies in variant-file order: 0/0, 0/1, 1/1, 0/2, ... (by the last allele, then those before it)."""
    alleles = F.sequence(F.lit(0), n_alleles - 1)
    if ploidy == 1:
        return F.transform(alleles, lambda j: F.array(j))
    return F.flatten(F.transform(alleles, lambda j: F.transform(genotypes_of(j + 1, ploidy - 1), lambda g: F.concat(g, F.array(j)))))


def genotypes(n_alleles: Column, ploidy: Column, most: int = 2) -> Column:
    """All genotypes of as many copies as ``ploidy`` says, ``most`` at most."""
    found = genotypes_of(n_alleles, most)
    for p in range(1, most):
        found = F.when(ploidy == p, genotypes_of(n_alleles, p)).otherwise(found)
    return found


def expected_depth(depth: Column, read_length: Column) -> Column:
    """Reads expected to cross a breakpoint with enough overlap."""
    return depth * (read_length - MIN_OVERLAP) / read_length


def likelihoods(counts: Column, lam: Column, ploidy: Column) -> Column:
    """Log likelihood of each genotype, in order: counts are Poisson about their allele's copies."""

    def one(genotype: Column) -> Column:
        def term(total: Column, k: Column) -> Column:
            copies = F.size(F.filter(genotype, lambda a: a == k))
            mean = lam * F.when(copies > 0, copies * HAPLOTYPE_FRACTION).otherwise(F.lit(ERROR_RATE))
            return total + F.greatest(stats.poisson_logpmf(F.get(counts, k), mean), F.lit(LOG_FLOOR))

        return F.aggregate(F.sequence(F.lit(0), F.size(counts) - 1), F.lit(0.0), term)

    return F.transform(genotypes(F.size(counts), ploidy), one)


def called(rows: DataFrame, *, poisson: bool = False) -> DataFrame:
    """Adds gl, gt, gq, num_reads, pvalue and filters to rows of counts, depth, depth_sd, read_length, ploidy.

    The first genotype of the greatest likelihood wins. Without reads there is no genotype. Depth is held against a normal distribution, or
    against the narrower Poisson distribution of the reads expected.
    """
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n)
    rows = rows.withColumns({"lam": expected_depth(F.col("depth"), F.col("read_length")), "num_reads": total})
    rows = rows.withColumn("gl", likelihoods(F.col("counts"), F.col("lam"), F.col("ploidy")))
    best = F.array_max("gl")
    error = 1 - 1 / F.aggregate("gl", F.lit(0.0), lambda s, g: s + F.exp(g - best))
    z = (F.col("num_reads") - F.col("lam")) / F.col("depth_sd")
    some = F.col("num_reads") > 0
    rows = rows.withColumns({
        "gt": F.when(some, F.get(genotypes(F.size("counts"), F.col("ploidy")), F.array_position("gl", best).cast("int") - 1)),
        "gq": F.when(some, stats.trunc_phred(error)),
        "pvalue": stats.normal_cdf(-F.abs(z)),
    })
    depth_bad = (z > HIGH_DEPTH_Z) | (z < LOW_DEPTH_Z)
    if poisson:
        rows = rows.withColumn("_below", stats.poisson_cdf(F.col("num_reads"), F.col("lam")))
        high = F.col("_below") > 0.5
        rows = rows.withColumn("pvalue", F.when(high, 1 - F.col("_below")).otherwise(F.col("_below")))
        depth_bad = F.when(high, F.col("pvalue") < HIGH_DEPTH_P).otherwise(F.col("pvalue") < LOW_DEPTH_P)
    marks = F.array(F.when(~some, "NO_READS"), F.when(some & depth_bad, "BP_DEPTH"), F.when(F.col("gq") < MIN_PASS_GQ, "GQ"))
    return rows.withColumn("filters", F.array_compact(marks)).drop("_below")


def fractions(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n)
    return F.transform(counts, lambda n: F.when(total > 0, n / total).otherwise(0.0))


def genotype_name(gt: Column, names: Column) -> Column:
    """Allele names joined by a slash; a dot without a genotype."""
    return F.when(gt.isNull() | (F.size(gt) == 0), F.lit(".")).otherwise(F.array_join(F.transform(gt, lambda a: F.get(names, a)), "/"))


def relabelled(gt: Column, to: Column) -> Column:
    """A genotype in another allele order, sorted."""
    return F.array_sort(F.transform(gt, lambda a: F.get(to, a)))


def combined(calls: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each variant and sample from its breakpoints' calls.

    Breakpoints that pass and agree give their genotype, and failing ones theirs if none passes and
    they agree; calls that differ are made again on mean counts, rounded half up. A consensus has the
    smallest quality and the sum of reads; filters of breakpoints that were passed over are kept.
    """
    ok = (F.size("filters") == 0) & F.col("gt").isNotNull()
    have = F.col("gt").isNotNull()
    rows = calls.groupBy(*keys).agg(
        F.collect_set(F.when(ok, F.col("gt"))).alias("passing"), F.collect_set(F.when(have, F.col("gt"))).alias("all_gt"),
        F.min(F.when(ok, F.col("gq"))).alias("gq_pass"), F.min("gq").alias("gq_all"), F.sum("num_reads").alias("reads"),
        F.collect_list("counts").alias("all_counts"), F.array_distinct(F.flatten(F.collect_list("filters"))).alias("marks"),
        F.max("depth").alias("depth"), F.max("depth_sd").alias("depth_sd"), F.max("read_length").alias("read_length"), F.max("ploidy").alias("ploidy"),
    )
    n = F.size("all_counts")
    width = F.size(F.get("all_counts", F.lit(0)))
    average = F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda k: F.floor(F.aggregate("all_counts", F.lit(0).cast("long"), lambda s, c: s + F.get(c, k)) / n + 0.5).cast("long"),
    )
    rows = rows.withColumn("recall", average)
    again = called(rows.withColumn("counts", F.col("recall")))
    n_pass, n_all = F.size("passing"), F.size("all_gt")
    conflict = (n_pass > 1) | ((n_pass == 0) & (n_all > 1))
    gt = F.when(conflict, F.col("gt")).when(n_pass == 1, F.get("passing", F.lit(0))).when(n_all == 1, F.get("all_gt", F.lit(0)))
    gq = F.when(conflict, F.col("gq")).when(n_pass == 1, F.col("gq_pass")).when(n_all == 1, F.col("gq_all"))
    marks = (
        F.when(conflict, F.array_union(F.array(F.lit("CONFLICT")), F.col("marks")))
        .when(n_pass == 1, F.col("marks"))
        .when(n_all == 1, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("NO_VALID_GT")))
    )
    text = F.array_join(F.array_sort(marks), ";")
    return again.select(*keys, gt.alias("gt"), gq.alias("gq"), "reads", F.when(text == "", "PASS").otherwise(text).alias("filter"))


def consensus(calls: DataFrame, keys: list[str], *, pass_only: bool = False) -> DataFrame:
    """What breakpoints with one genotype say together: gt, gq, num_reads, fractions, gl and filters for each of ``keys``.

    ``calls`` has bp, gt, gq, num_reads, counts, gl and filters. Breakpoints without a genotype count as BP_NO_GT; with ``pass_only`` those
    with filters are passed over and leave these. Quality is the least, reads the sum, fractions are weighted by reads, and each genotype
    keeps its greatest likelihood.
    """
    none = F.array().cast("array<string>")
    used = F.col("gt").isNotNull() & ((F.size("filters") == 0) | F.lit(not pass_only))
    left = F.when(F.col("gt").isNull(), F.array(F.lit("BP_NO_GT"))).when(~used, F.col("filters")).otherwise(none)
    rows = calls.groupBy(*keys).agg(
        F.array_sort(F.min_by(F.when(used, F.col("gt")), F.when(used, F.col("bp")))).alias("gt"), F.coalesce(F.min(F.when(used, F.col("gq"))), F.lit(0)).alias("gq"), F.coalesce(F.sum(F.when(used, F.col("num_reads"))), F.lit(0)).alias("num_reads"),
        F.collect_list(F.when(used, F.struct("counts", "gl"))).alias("_used"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(left)))).alias("filters"),
    )
    first = F.get("_used", F.lit(0))
    rest = F.slice("_used", F.lit(2), F.greatest(F.size("_used") - 1, F.lit(0)))
    counts = F.aggregate(rest, first["counts"], lambda s, x: F.zip_with(s, x["counts"], lambda a, b: F.coalesce(a, F.lit(0).cast("long")) + F.coalesce(b, F.lit(0).cast("long"))))
    best = F.aggregate(rest, first["gl"], lambda s, x: F.zip_with(s, x["gl"], lambda a, b: F.greatest(a, b)))
    return rows.withColumns({"fractions": fractions(counts), "gl": best}).drop("_used")


def population(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Samples, call rate and allele frequencies (array by allele) of diploid calls."""
    rows = calls.groupBy(*keys).agg(F.count("*").alias("samples"), F.count("gt").alias("called"))
    freq = calls.select(*keys, F.explode("gt").alias("allele")).groupBy(*keys, "allele").agg(F.count("*").alias("n"))
    freq = freq.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return freq.join(rows, keys).select(*keys, "allele", "n", "frequency", "samples", (F.col("called") / F.col("samples")).alias("call_rate"))


def hwe_chisq(hom_ref: Column, het: Column, hom_alt: Column) -> Column:
    """Hardy-Weinberg p-value of a biallelic site by chi-squared with one degree of freedom; null without variation."""
    n = hom_ref + het + hom_alt
    p = (2 * hom_ref + het) / (2 * n)
    q = 1 - p
    square = lambda seen, want: F.when(want > 0, (seen - want) * (seen - want) / want).otherwise(0.0)
    x = square(hom_ref, n * p * p) + square(het, 2 * n * p * q) + square(hom_alt, n * q * q)
    return F.when((n > 0) & (p > 0) & (p < 1), stats.chi2_survival(x))


def hwe_chisq_table(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Hardy-Weinberg p-value by chi-squared with one degree of freedom for sites of any number of alleles, from diploid calls (keys, gt: array of two): keys, samples, chisq, p.

    All genotypes of alleles that occur count, those that nobody has too. Missing calls are left out; a site with one allele has p 1.
    """
    calls = calls.where("gt IS NOT NULL AND size(gt) = 2").select(*keys, F.array_sort("gt").alias("gt"))
    found = calls.groupBy(*keys, F.get("gt", F.lit(0)).alias("a"), F.get("gt", F.lit(1)).alias("b")).agg(F.count("*").alias("n"))
    copies = found.select(*keys, F.explode(F.array("a", "b")).alias("allele"), "n").groupBy(*keys, "allele").agg(F.sum("n").alias("n"))
    whole = found.groupBy(*keys).agg(F.sum("n").alias("samples"))
    share = copies.join(whole, keys).select(*keys, "allele", "samples", (F.col("n") / (2 * F.col("samples"))).alias("share"))
    pairs = share.select(*keys, "samples", F.col("allele").alias("a"), F.col("share").alias("p")).join(share.select(*keys, F.col("allele").alias("b"), F.col("share").alias("q")), keys).where("a <= b")
    want = F.when(F.col("a") == F.col("b"), 1).otherwise(2) * F.col("p") * F.col("q") * F.col("samples")
    rows = pairs.join(found, [*keys, "a", "b"], "left").withColumn("want", want).withColumn("off", F.coalesce("n", F.lit(0)) - F.col("want"))
    out = rows.groupBy(*keys, "samples").agg(F.sum(F.col("off") * F.col("off") / F.col("want")).alias("chisq"))
    return out.withColumn("p", stats.chi2_survival(F.col("chisq")))


def hwe_exact(hom_ref: Column, het: Column, hom_alt: Column) -> Column:
    """Hardy-Weinberg p-value by the exact test: all numbers of heterozygotes that are no likelier than the one seen.

    Two folds go up and down from the likeliest number, with probabilities relative to its, each from the one before by
    a ratio; what a step needs is in the fold's state, so nothing is worked out again. Numbers far off underflow to zero.
    """
    n = (hom_ref + het + hom_alt).cast("long")
    rare = (2 * F.least(hom_ref, hom_alt) + het).cast("long")
    common = 2 * n - rare
    mode = F.floor(rare * common / (2 * F.greatest(n, F.lit(1)))).cast("long")
    mode = F.least(mode + F.pmod(mode + rare, F.lit(2)), rare)

    def log_p(h: Column) -> Column:
        a, b = F.floor((rare - h) / 2).cast("long"), F.floor((common - h) / 2).cast("long")
        return h * math.log(2) - stats.log_factorial(h) - stats.log_factorial(a) - stats.log_factorial(b)

    seen = F.exp(log_p(het.cast("long")) - log_p(mode))
    zero = F.lit(0.0)
    start = F.struct(mode.cast("double").alias("h"), F.lit(1.0).alias("p"), zero.alias("total"), zero.alias("tail"), (seen * (1 + 1e-9)).alias("seen"), rare.cast("double").alias("rare"), common.cast("double").alias("common"))

    def step(ratio, way: int):
        def run(s: Column, _: Column) -> Column:
            return F.struct(
                (s["h"] + way).alias("h"), (s["p"] * ratio(s)).alias("p"), (s["total"] + s["p"]).alias("total"), (s["tail"] + F.when(s["p"] <= s["seen"], s["p"]).otherwise(0.0)).alias("tail"),
                s["seen"].alias("seen"), s["rare"].alias("rare"), s["common"].alias("common"),
            )

        return run

    up = F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor((rare - mode) / 2)), start, step(lambda s: (s["rare"] - s["h"]) * (s["common"] - s["h"]) / ((s["h"] + 2) * (s["h"] + 1)), 2))
    down = F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(mode / 2)), start, step(lambda s: s["h"] * (s["h"] - 1) / ((s["rare"] - s["h"] + 2) * (s["common"] - s["h"] + 2)), -2))
    both = F.struct(up.alias("u"), down.alias("d"))
    # Both folds count the likeliest number itself.
    share = F.transform(F.array(both), lambda x: (x["u"]["tail"] + x["d"]["tail"] - F.when(x["u"]["seen"] >= 1, 1.0).otherwise(0.0)) / (x["u"]["total"] + x["d"]["total"] - 1))
    return F.least(F.lit(1.0), F.get(share, F.lit(0)))


def needs_exact(hom_ref: Column, het: Column, hom_alt: Column) -> Column:
    """Whether the chi-squared approximation is poor: few samples, a rare genotype or a rare allele."""
    n = hom_ref + het + hom_alt
    maf = F.least(2 * hom_ref + het, 2 * hom_alt + het) / (2 * n)
    return (n <= 30) | (F.least(hom_ref, het, hom_alt) <= 20) | (maf * maf * n <= 20)


def phred_likelihoods(gl: Column) -> Column:
    """Likelihoods as non-negative integers relative to the best, capped; half goes to even."""
    raw = F.transform(gl, lambda g: F.least(F.bround(-10 * g).cast("long"), F.lit(32768).cast("long")))
    return F.transform(raw, lambda x: x - F.array_min(raw))
