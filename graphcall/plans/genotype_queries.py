"""Queries of the genotype model and of population statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphcall.functions import stats
from graphcall.operators import counting, genotyping, vcf
from graphcall.plans.registry import Views, query

# The model in DuckDB's terms, for two alleles and two copies.
_POIS = "({n} * ln({m}) - ({m}) - lgamma({n} + 1))"


def _gl(a: str, b: str) -> str:
    p = lambda n, m: "greatest(" + _POIS.format(n=n, m=m) + ", -745.0)"
    return f"{p(a, 'lam * 1.0')} + {p(b, 'lam * 0.05')} AS g0, {p(a, 'lam * 0.5')} + {p(b, 'lam * 0.5')} AS g1, {p(a, 'lam * 0.05')} + {p(b, 'lam * 1.0')} AS g2"


CALLS = f"""
b AS (SELECT *, depth * (read_length - 16) / read_length AS lam FROM (
  SELECT sample_id, site, bp, n_ref, n_alt, CAST(20 + sample_id AS DOUBLE) AS depth, CAST(5 + sample_id AS DOUBLE) AS depth_sd, CAST(100 + 50 * (sample_id % 2) AS DOUBLE) AS read_length FROM counts)),
g AS (SELECT *, {_gl("n_ref", "n_alt")} FROM b),
c AS (SELECT *, greatest(g0, g1, g2) AS best FROM g),
d AS (SELECT *, CASE WHEN g0 = best THEN '0/0' WHEN g1 = best THEN '0/1' ELSE '1/1' END AS gt, 1 - 1 / (exp(g0 - best) + exp(g1 - best) + exp(g2 - best)) AS err, (n_ref + n_alt - lam) / depth_sd AS z FROM c),
q AS (SELECT *, CASE WHEN err <= 1e-10 THEN 100 ELSE CAST(floor(-10 * log10(greatest(err, 1e-300))) AS INT) END AS gq FROM d),
calls AS (SELECT *, concat_ws(';', CASE WHEN z > 2.0537489106318225 OR z < -3.719016485455709 THEN 'BP_DEPTH' END, CASE WHEN gq < 10 THEN 'GQ' END) AS marks FROM q)
"""


def calls(v: Views) -> DataFrame:
    rows = v.counts.withColumns({
        "counts": F.array(F.col("n_ref").cast("long"), F.col("n_alt").cast("long")), "depth": (20 + F.col("sample_id")).cast("double"), "depth_sd": (5 + F.col("sample_id")).cast("double"),
        "read_length": (100 + 50 * (F.col("sample_id") % 2)).cast("double"), "ploidy": F.lit(2),
    })
    return genotyping.called(rows)


def _text(gt: str = "gt") -> F.Column:
    return F.array_join(F.transform(gt, lambda a: a.cast("string")), "/")


@query("""SELECT CAST(n AS INT) AS n_alleles, string_agg(CAST(i AS STRING) || '/' || CAST(j AS STRING), ',' ORDER BY j, i) AS genotypes
FROM range(1, 6) a(n), range(0, 6) b(j), range(0, 6) c(i) WHERE i <= j AND j < n GROUP BY n""")
def enumerate_genotypes(v: Views) -> DataFrame:
    rows = v.spark.range(1, 6).select(F.col("id").cast("int").alias("n_alleles"))
    every = genotyping.genotypes(F.col("n_alleles"), F.lit(2))
    return rows.select("n_alleles", F.array_join(F.transform(every, lambda g: F.array_join(F.transform(g, lambda a: a.cast("string")), "/")), ",").alias("genotypes"))


@query(f"WITH {CALLS} SELECT sample_id, site, bp, round(g0, 6) AS gl_ref, round(g1, 6) AS gl_het, round(g2, 6) AS gl_alt FROM g")
def genotype_likelihood(v: Views) -> DataFrame:
    return calls(v).select("sample_id", "site", "bp", *[F.round(F.get("gl", F.lit(k)), 6).alias(n) for k, n in enumerate(("gl_ref", "gl_het", "gl_alt"))])


@query(f"WITH {CALLS} SELECT sample_id, site, bp, gt, gq, marks, CAST(n_ref + n_alt AS BIGINT) AS num_reads FROM calls")
def breakpoint_genotype(v: Views) -> DataFrame:
    return calls(v).select("sample_id", "site", "bp", _text().alias("gt"), "gq", F.array_join("filters", ";").alias("marks"), "num_reads")


@query("SELECT sample_id, site, bp, round(n_ref / (n_ref + n_alt), 6) AS f_ref, round(n_alt / (n_ref + n_alt), 6) AS f_alt FROM counts")
def allele_fractions(v: Views) -> DataFrame:
    share = genotyping.fractions(F.array("n_ref", "n_alt"))
    return v.counts.select("sample_id", "site", "bp", F.round(F.get(share, F.lit(0)), 6).alias("f_ref"), F.round(F.get(share, F.lit(1)), 6).alias("f_alt"))


_ERF = "(2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum([exp(k * ln(2) + (2 * k + 1) * ln(greatest({x}, 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) FOR k IN range(0, 121)]))"


@query(f"WITH {CALLS} SELECT sample_id, site, bp, round((1 - CASE WHEN abs(z) / sqrt(2) > 6 THEN 1 ELSE {_ERF.format(x='(abs(z) / sqrt(2))')} END) / 2, 6) AS pvalue, z > 2.0537489106318225 OR z < -3.719016485455709 AS bad FROM calls")
def coverage_test(v: Views) -> DataFrame:
    return calls(v).select("sample_id", "site", "bp", F.round("pvalue", 6).alias("pvalue"), F.array_contains("filters", "BP_DEPTH").alias("bad"))


@query(f"""WITH {CALLS},
u AS (SELECT site, sample_id, count(DISTINCT gt) FILTER (marks = '') AS n_pass, min(gt) FILTER (marks = '') AS gt_pass, min(gq) FILTER (marks = '') AS gq_pass,
  count(DISTINCT gt) AS n_all, min(gt) AS gt_all, min(gq) AS gq_all, CAST(sum(n_ref + n_alt) AS BIGINT) AS reads, max(lam) AS lam, max(depth_sd) AS depth_sd,
  CAST(floor(sum(n_ref) / count(*) + 0.5) AS BIGINT) AS mr, CAST(floor(sum(n_alt) / count(*) + 0.5) AS BIGINT) AS ma,
  max(CASE WHEN marks LIKE '%BP_DEPTH%' THEN 1 ELSE 0 END) AS m_depth, max(CASE WHEN marks LIKE '%GQ%' THEN 1 ELSE 0 END) AS m_gq FROM calls GROUP BY site, sample_id),
r AS (SELECT *, {_gl("mr", "ma")} FROM u),
r2 AS (SELECT *, greatest(g0, g1, g2) AS best FROM r),
r3 AS (SELECT *, CASE WHEN mr + ma = 0 THEN NULL WHEN g0 = best THEN '0/0' WHEN g1 = best THEN '0/1' ELSE '1/1' END AS gt2, 1 - 1 / (exp(g0 - best) + exp(g1 - best) + exp(g2 - best)) AS err FROM r2),
r4 AS (SELECT *, CASE WHEN err <= 1e-10 THEN 100 ELSE CAST(floor(-10 * log10(greatest(err, 1e-300))) AS INT) END AS gq2, n_pass > 1 OR (n_pass = 0 AND n_all > 1) AS conflict FROM r3)
SELECT site, sample_id, CASE WHEN conflict THEN gt2 WHEN n_pass = 1 THEN gt_pass WHEN n_all = 1 THEN gt_all END AS gt,
  CASE WHEN conflict THEN gq2 WHEN n_pass = 1 THEN gq_pass WHEN n_all = 1 THEN gq_all END AS gq, reads,
  CASE WHEN NOT conflict AND n_pass = 0 AND n_all = 1 THEN 'PASS' ELSE coalesce(nullif(concat_ws(';', CASE WHEN m_depth = 1 THEN 'BP_DEPTH' END, CASE WHEN conflict THEN 'CONFLICT' END, CASE WHEN m_gq = 1 THEN 'GQ' END), ''), 'PASS') END AS filter
FROM r4""")
def combined_genotype(v: Views) -> DataFrame:
    return genotyping.combined(calls(v), ["site", "sample_id"]).withColumn("gt", _text())


@query(f"""WITH {CALLS} SELECT site, sample_id, min_by(gt, bp) AS gt, min(gq) AS gq, CAST(sum(n_ref + n_alt) AS BIGINT) AS reads, round(sum(n_ref) / sum(n_ref + n_alt), 6) AS f_ref, round(sum(n_alt) / sum(n_ref + n_alt), 6) AS f_alt,
round(max(g0), 6) AS gl_ref, round(max(g1), 6) AS gl_het, round(max(g2), 6) AS gl_alt FROM calls GROUP BY site, sample_id HAVING count(DISTINCT gt) = 1""")
def consensus_genotype(v: Views) -> DataFrame:
    rows = calls(v)
    agreed = rows.groupBy("site", "sample_id").agg(F.size(F.collect_set("gt")).alias("n")).where("n = 1").drop("n")
    out = genotyping.consensus(rows.join(agreed, ["site", "sample_id"], "left_semi"), ["site", "sample_id"])
    part = lambda c, k: F.round(F.get(c, F.lit(k)), 6)
    return out.select("site", "sample_id", _text().alias("gt"), "gq", F.col("num_reads").alias("reads"), part("fractions", 0).alias("f_ref"), part("fractions", 1).alias("f_alt"), *[part("gl", k).alias(n) for k, n in enumerate(("gl_ref", "gl_het", "gl_alt"))])


@query(f"""WITH {CALLS} SELECT site, sample_id, min_by(gt, bp) FILTER (marks = '') AS gt, coalesce(min(gq) FILTER (marks = ''), 0) AS gq, CAST(coalesce(sum(n_ref + n_alt) FILTER (marks = ''), 0) AS BIGINT) AS reads,
concat_ws(',', CASE WHEN bool_or(marks LIKE '%BP_DEPTH%') THEN 'BP_DEPTH' END, CASE WHEN bool_or(marks LIKE '%GQ%') THEN 'GQ' END) AS left_out FROM calls GROUP BY site, sample_id""")
def passing_consensus(v: Views) -> DataFrame:
    out = genotyping.consensus(calls(v), ["site", "sample_id"], pass_only=True)
    return out.select("site", "sample_id", _text().alias("gt"), "gq", F.col("num_reads").alias("reads"), F.array_join("filters", ",").alias("left_out"))


@query(f"""WITH {CALLS}, p AS (SELECT *, CAST(least(round_even(-10 * g0, 0), 32768) AS BIGINT) AS p0, CAST(least(round_even(-10 * g1, 0), 32768) AS BIGINT) AS p1, CAST(least(round_even(-10 * g2, 0), 32768) AS BIGINT) AS p2 FROM calls)
SELECT sample_id, site, bp, gt || ':.:' || replace(marks, ';', ',') || ':' || CAST(n_ref + n_alt AS STRING) || ':' || CAST(n_ref AS STRING) || ',' || CAST(n_alt AS STRING) || ':' || CAST(n_ref AS STRING) || ',' || CAST(n_alt - n_alt // 3 AS STRING) || ':0,' || CAST(n_alt // 3 AS STRING) || ':' ||
CAST(p0 - least(p0, p1, p2) AS STRING) || ',' || CAST(p1 - least(p0, p1, p2) AS STRING) || ',' || CAST(p2 - least(p0, p1, p2) AS STRING) AS text FROM p""")
def vcf_sample_fields(v: Views) -> DataFrame:
    pair = lambda f, r: F.struct(f.cast("long").alias("fwd"), r.cast("long").alias("rev"))
    ref, alt = F.col("n_ref"), F.col("n_alt")
    third = F.floor(alt / 3)
    names = F.array(F.lit("REF"), F.lit("ALT"))
    rows = calls(v).withColumns({
        "n_alts": F.lit(1), "allele_map": F.create_map(F.lit("REF"), F.lit(0), F.lit("ALT"), F.lit(1)), "alleles": F.create_map(F.lit("REF"), pair(ref, F.lit(0)), F.lit("ALT"), pair(alt - third, third)),
        "gl": F.create_map(F.lit("REF/REF"), F.get("gl", F.lit(0)), F.lit("REF/ALT"), F.get("gl", F.lit(1)), F.lit("ALT/ALT"), F.get("gl", F.lit(2))), "gt": F.transform("gt", lambda a: F.get(names, a)),
    })
    out = vcf.sample_fields(rows)
    return out.select("sample_id", "site", "bp", F.concat_ws(":", "GT", F.lit("."), "FT", "DP", "AD", "ADF", "ADR", "PL").alias("text"))


@query(f"WITH {CALLS} SELECT site, sample_id, CAST(floor(sum(n_ref) / count(*) + 0.5) AS BIGINT) AS mean_ref, CAST(floor(sum(n_alt) / count(*) + 0.5) AS BIGINT) AS mean_alt FROM calls GROUP BY site, sample_id HAVING count(DISTINCT gt) > 1")
def conflict_recall(v: Views) -> DataFrame:
    half = lambda c: F.floor(F.sum(c) / F.count("*") + 0.5).cast("long")
    rows = calls(v).groupBy("site", "sample_id").agg(half("n_ref").alias("mean_ref"), half("n_alt").alias("mean_alt"), F.size(F.collect_set("gt")).alias("n"))
    return rows.where("n > 1").drop("n")


@query("SELECT site, sample_id, CAST(least(1 - a, 1 - b) AS STRING) || '/' || CAST(greatest(1 - a, 1 - b) AS STRING) AS gt FROM genotypes")
def relabel_genotype(v: Views) -> DataFrame:
    swapped = genotyping.relabelled(F.array("a", "b"), F.array(F.lit(1), F.lit(0)))
    return v.genotypes.select("site", "sample_id", F.array_join(F.transform(swapped, lambda x: x.cast("string")), "/").alias("gt"))


@query("SELECT site, sample_id, CASE WHEN missing THEN '.' ELSE CASE a WHEN 0 THEN 'REF' ELSE 'ALT' END || '/' || CASE b WHEN 0 THEN 'REF' ELSE 'ALT' END END AS name FROM genotypes")
def gt_string(v: Views) -> DataFrame:
    gt = F.when(~F.col("missing"), F.array("a", "b"))
    return v.genotypes.select("site", "sample_id", genotyping.genotype_name(gt, F.array(F.lit("REF"), F.lit("ALT"))).alias("name"))


@query("""WITH k AS (SELECT site, unnest([a, b]) AS allele FROM genotypes WHERE NOT missing), s AS (SELECT site, count(*) AS samples, count(*) FILTER (NOT missing) AS called FROM genotypes GROUP BY site)
SELECT site, allele, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY site), 6) AS frequency, samples, round(called / samples, 6) AS call_rate FROM k JOIN s USING (site) GROUP BY site, allele, samples, called""")
def population_af(v: Views) -> DataFrame:
    rows = v.genotypes.withColumn("gt", F.when(~F.col("missing"), F.array("a", "b")))
    return genotyping.population(rows, ["site"]).withColumns({"frequency": F.round("frequency", 6), "call_rate": F.round("call_rate", 6)})


def _trio(v: Views) -> DataFrame:
    total = F.col("a") + F.col("b")
    return v.genotypes.where("NOT missing").groupBy("site").agg(*[F.count_if(total == k).alias(n) for k, n in enumerate(("rr", "ra", "aa"))])


TRIO = "t AS (SELECT site, count(*) FILTER (a + b = 0) AS rr, count(*) FILTER (a + b = 1) AS ra, count(*) FILTER (a + b = 2) AS aa FROM genotypes WHERE NOT missing GROUP BY site)"


@query(f"""WITH {TRIO}, p AS (SELECT *, rr + ra + aa AS n, (2 * rr + ra) / (2 * (rr + ra + aa)) AS p FROM t),
x AS (SELECT site, p, (rr - n * p * p) ** 2 / (n * p * p) + (ra - 2 * n * p * (1 - p)) ** 2 / (2 * n * p * (1 - p)) + (aa - n * (1 - p) * (1 - p)) ** 2 / (n * (1 - p) * (1 - p)) AS x FROM p WHERE p > 0 AND p < 1)
SELECT site, round(1 - CASE WHEN sqrt(x / 2) > 6 THEN 1 ELSE {_ERF.format(x='sqrt(x / 2)')} END, 6) AS p FROM x""")
def hwe_chisq(v: Views) -> DataFrame:
    return _trio(v).select("site", F.round(genotyping.hwe_chisq(F.col("rr"), F.col("ra"), F.col("aa")), 6).alias("p")).where("p IS NOT NULL")


@query(f"""WITH {TRIO}, r AS (SELECT *, rr + ra + aa AS n, 2 * least(rr, aa) + ra AS rare FROM t),
e AS (SELECT site, ra, unnest(range(rare % 2, rare + 1, 2)) AS h, n, rare FROM r),
l AS (SELECT site, h, ra, h * ln(2) - lgamma(h + 1) - lgamma((rare - h) // 2 + 1) - lgamma((2 * n - rare - h) // 2 + 1) AS lp FROM e),
m AS (SELECT *, max(lp) OVER (PARTITION BY site) AS top, max(lp) FILTER (h = ra) OVER (PARTITION BY site) AS own FROM l)
SELECT site, round(least(1.0, sum(exp(lp - top)) FILTER (lp <= own + 1e-9) / sum(exp(lp - top))), 6) AS p FROM m GROUP BY site""")
def hwe_exact(v: Views) -> DataFrame:
    return _trio(v).select("site", F.round(genotyping.hwe_exact(F.col("rr"), F.col("ra"), F.col("aa")), 6).alias("p"))


@query(f"""WITH {TRIO}, r AS (SELECT *, rr + ra + aa AS n, least(2 * rr + ra, 2 * aa + ra) / (2 * (rr + ra + aa)) AS maf FROM t)
SELECT site, n <= 30 OR least(rr, ra, aa) <= 20 OR maf * maf * n <= 20 AS exact FROM r""")
def hwe_gate(v: Views) -> DataFrame:
    return _trio(v).select("site", genotyping.needs_exact(F.col("rr"), F.col("ra"), F.col("aa")).alias("exact"))


@query(f"""WITH {CALLS}, p AS (SELECT sample_id, site, bp, CAST(least(round_even(-10 * g0, 0), 32768) AS BIGINT) AS p0, CAST(least(round_even(-10 * g1, 0), 32768) AS BIGINT) AS p1, CAST(least(round_even(-10 * g2, 0), 32768) AS BIGINT) AS p2 FROM g)
SELECT sample_id, site, bp, CAST(p0 - least(p0, p1, p2) AS STRING) || ',' || CAST(p1 - least(p0, p1, p2) AS STRING) || ',' || CAST(p2 - least(p0, p1, p2) AS STRING) AS pl FROM p""")
def phred_likelihoods(v: Views) -> DataFrame:
    pl = F.transform(genotyping.phred_likelihoods(F.col("gl")), lambda x: x.cast("string"))
    return calls(v).select("sample_id", "site", "bp", F.array_join(pl, ",").alias("pl"))


@query(f"WITH {CALLS} SELECT site, sum(CASE WHEN marks LIKE '%BP_DEPTH%' THEN 1 ELSE 0 END) * 2 > count(*) AS bp_depth, count(*) AS n FROM calls GROUP BY site")
def bp_depth_majority(v: Views) -> DataFrame:
    bad = F.array_contains("filters", "BP_DEPTH").cast("int")
    return calls(v).groupBy("site").agg((F.sum(bad) * 2 > F.count("*")).alias("bp_depth"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT s.sample_id, s.sex, r.chrom FROM samples s CROSS JOIN (SELECT unnest(['chr1', 'chrX', 'chrY']) AS chrom) r)
SELECT sample_id, chrom, CASE WHEN chrom = 'chrY' THEN 1 WHEN chrom = 'chrX' AND lower(substring(sex, 1, 1)) = 'm' THEN 1 ELSE 2 END AS ploidy FROM c""")
def sample_ploidy(v: Views) -> DataFrame:
    rows = v.samples.withColumn("chrom", F.explode(F.array(F.lit("chr1"), F.lit("chrX"), F.lit("chrY"))))
    male = F.lower(F.substring("sex", 1, 1)) == "m"
    return rows.select("sample_id", "chrom", F.when((F.col("chrom") == "chrY") | ((F.col("chrom") == "chrX") & male), 1).otherwise(2).alias("ploidy"))


@query("""SELECT l_linenumber AS n, round(sum(p), 6) AS cdf FROM (SELECT DISTINCT l_linenumber FROM lineitem), LATERAL (SELECT exp(k * ln(3.5) - 3.5 - lgamma(k + 1)) AS p FROM range(0, l_linenumber + 1) t(k)) GROUP BY 1""")
def poisson_cdf(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.col("l_linenumber").alias("n")).distinct()
    return rows.select("n", F.round(stats.poisson_cdf(F.col("n"), F.lit(3.5)), 6).alias("cdf"))


@query("""WITH f AS (SELECT sample_id, site, element, count(DISTINCT fragment_id) AS n FROM observations GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT sample_id, site FROM observations), e AS (SELECT unnest(['REF_RF', 'LF_ALT', 'LF_INS']) AS allele)
SELECT s.sample_id, s.site, e.allele, coalesce(f.n, 0) AS n FROM s CROSS JOIN e LEFT JOIN f ON f.sample_id = s.sample_id AND f.site = s.site AND f.element = e.allele""")
def dense_count_grid(v: Views) -> DataFrame:
    counted = counting.element_counts(counting.fragments(v.observations, ["sample_id", "site"]), ["sample_id", "site"])
    rows = v.observations.select("sample_id", "site").distinct()
    alleles = rows.select("site").distinct().withColumn("allele", F.explode(F.array(F.lit("REF_RF"), F.lit("LF_ALT"), F.lit("LF_INS"))))
    return counting.dense_grid(counted.select("sample_id", "site", F.col("element").alias("allele"), F.col("fragments").alias("n")), rows, alleles, ["sample_id", "site"])


@query("""WITH f AS (SELECT sample_id, site, bp, element AS edge, count(DISTINCT fragment_id) AS n FROM observations GROUP BY 1, 2, 3, 4),
m AS (SELECT * FROM (VALUES ('REF', 'REF_RF'), ('ALT', 'LF_ALT'), ('INS', 'LF_INS'), ('INS', 'LF_ALT')) t(allele, edge))
SELECT sample_id, site, bp, allele, CAST(sum(n) AS BIGINT) AS n FROM f JOIN m USING (edge) GROUP BY 1, 2, 3, 4""")
def breakpoint_allele_counts(v: Views) -> DataFrame:
    keys = ["sample_id", "site", "bp"]
    counted = counting.element_counts(counting.fragments(v.observations, keys), keys).select(*keys, F.col("element").alias("edge"), F.col("fragments").alias("n"))
    alleles = v.spark.createDataFrame([("REF", "REF_RF"), ("ALT", "LF_ALT"), ("INS", "LF_INS"), ("INS", "LF_ALT")], "allele string, edge string")
    return counting.allele_counts(counted, alleles, keys)


@query("""WITH e AS (SELECT DISTINCT n_regionkey AS bp, CASE WHEN n_nationkey % 3 = 0 THEN 'REF' ELSE 'A' || CAST(n_nationkey % 4 AS STRING) END AS allele, 'e' || CAST(n_nationkey % 2 AS STRING) AS edge FROM nation),
s AS (SELECT bp, allele, string_agg(edge, ';' ORDER BY edge) AS edges FROM e GROUP BY bp, allele)
SELECT bp, edges, CASE WHEN bool_or(allele = 'REF') THEN 'REF' ELSE min(allele) END AS canonical, count(*) AS n_alleles FROM s GROUP BY bp, edges""")
def canonical_alleles(v: Views) -> DataFrame:
    k = F.col("n_nationkey")
    rows = v.table("nation").select(
        F.col("n_regionkey").alias("bp"), F.when(k % 3 == 0, "REF").otherwise(F.concat(F.lit("A"), (k % 4).cast("string"))).alias("allele"), F.concat(F.lit("e"), (k % 2).cast("string")).alias("edge")
    )
    return counting.canonical_alleles(rows, ["bp"])


@query("SELECT sample_id, site, bp, rank() OVER (PARTITION BY site, bp ORDER BY n_ref + n_alt DESC) AS place, round((n_ref + n_alt - avg(n_ref + n_alt) OVER (PARTITION BY site, bp)) / stddev_samp(n_ref + n_alt) OVER (PARTITION BY site, bp), 6) AS z FROM counts")
def zscore(v: Views) -> DataFrame:
    group = Window.partitionBy("site", "bp")
    n = F.col("n_ref") + F.col("n_alt")
    return v.counts.select("sample_id", "site", "bp", F.rank().over(group.orderBy(n.desc())).alias("place"), F.round((n - F.avg(n).over(group)) / F.stddev_samp(n).over(group), 6).alias("z"))
