"""Queries of depth tests, populations, mates, filters, piles, record blocks and checks of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcall.functions import cigar
from graphcall.operators import counting, genotyping, graphs, intervals, matching
from graphcall.operators.storage import dealt
from graphcall.plans.genotype_queries import _ERF
from graphcall.plans.read_queries import REASON, _reason
from graphcall.plans.registry import Views, query
from graphcall.sources import files


@query("""WITH c AS (SELECT c.sample_id, c.site, c.bp, n_ref + n_alt AS n, depth * (read_length - 16) / read_length AS lam FROM counts c JOIN samples s ON s.sample_id = c.sample_id),
p AS (SELECT *, least(1.0, list_sum([exp(-lam + k * ln(lam) - lgamma(k + 1)) FOR k IN range(0, CAST(n + 1 AS BIGINT))])) AS below FROM c)
SELECT sample_id, site, bp, round(CASE WHEN below > 0.5 THEN 1 - below ELSE below END, 6) AS pvalue, CASE WHEN below > 0.5 THEN 1 - below < 0.02 ELSE below < 0.0001 END AS bad FROM p""")
def coverage_test_poisson(v: Views) -> DataFrame:
    rows = v.counts.join(v.samples.select("sample_id", F.col("depth"), F.lit(1.0).alias("depth_sd"), F.col("read_length")), "sample_id")
    rows = genotyping.called(rows.withColumns({"counts": F.array("n_ref", "n_alt"), "ploidy": F.lit(2)}), poisson=True)
    return rows.select("sample_id", "site", "bp", F.round("pvalue", 6).alias("pvalue"), F.array_contains("filters", "BP_DEPTH").alias("bad"))


#: Three alleles: the third where the sum of a genotype's copies and its sample says so.
_THREE = "t AS (SELECT site, least(x, y) AS a, greatest(x, y) AS b FROM (SELECT site, CASE WHEN sample_id % 5 = 0 THEN 2 ELSE a END AS x, b AS y FROM genotypes WHERE NOT missing))"


@query(f"""WITH {_THREE}, s AS (SELECT site, count(*) AS n FROM t GROUP BY 1), k AS (SELECT site, x AS allele, count(*) / (2 * any_value(n)) AS p FROM (SELECT site, unnest([a, b]) AS x FROM t) JOIN s USING (site) GROUP BY 1, 2),
g AS (SELECT site, a, b, count(*) AS n FROM t GROUP BY 1, 2, 3),
e AS (SELECT x.site, s.n AS samples, CASE WHEN x.allele = y.allele THEN 1 ELSE 2 END * x.p * y.p * s.n AS want, coalesce(g.n, 0) AS n FROM k x JOIN k y ON y.site = x.site AND x.allele <= y.allele JOIN s ON s.site = x.site LEFT JOIN g ON g.site = x.site AND g.a = x.allele AND g.b = y.allele),
q AS (SELECT site, samples, sum((n - want) * (n - want) / want) AS x FROM e GROUP BY 1, 2)
SELECT site, samples, round(x, 4) AS chisq, round(1 - CASE WHEN sqrt(x / 2) > 6 THEN 1 ELSE {_ERF.format(x='sqrt(x / 2)')} END, 6) AS p FROM q""")
def hwe_chisq_alleles(v: Views) -> DataFrame:
    own = v.genotypes.where("NOT missing").select("site", F.array(F.when(F.col("sample_id") % 5 == 0, 2).otherwise(F.col("a")), "b").alias("gt"))
    return genotyping.hwe_chisq_table(own, ["site"]).select("site", "samples", F.round("chisq", 4).alias("chisq"), F.round("p", 6).alias("p"))


@query("""WITH f AS (SELECT sample_id, site, fragment_id, count(*) AS n, CASE WHEN count(DISTINCT bp) = 1 THEN max(pos) - min(pos) END AS linear, CASE WHEN max(element) <> 'REF_RF' THEN max(qual) - min(qual) END AS graph FROM observations GROUP BY 1, 2, 3)
SELECT sample_id, round(avg(linear) FILTER (n >= 2), 6) AS mean_linear, round(quantile_cont(linear, 0.5) FILTER (n >= 2), 6) AS median_linear, round(var_pop(linear) FILTER (n >= 2), 6) AS variance_linear, count(*) FILTER (linear IS NULL) AS problematic_linear,
round(avg(graph) FILTER (n >= 2), 6) AS mean_graph, round(quantile_cont(graph, 0.5) FILTER (n >= 2), 6) AS median_graph, round(var_pop(graph) FILTER (n >= 2), 6) AS variance_graph, count(*) FILTER (graph IS NULL) AS problematic_graph,
count(*) FILTER (n = 1) AS single_read, count(*) FILTER (n = 2) AS paired_read, count(*) FILTER (n > 2) AS multi_read FROM f GROUP BY 1""")
def fragment_lengths(v: Views) -> DataFrame:
    frags = v.observations.groupBy("sample_id", "site", "fragment_id").agg(
        F.count("*").alias("n_reads"), F.when(F.count_distinct("bp") == 1, F.max("pos") - F.min("pos")).alias("linear"), F.when(F.max("element") != "REF_RF", F.max("qual") - F.min("qual")).alias("graph"),
    )
    out = counting.fragment_statistics(frags, ["sample_id"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.split("_")[0] in ("mean", "median", "variance")})


@query(f"""WITH r AS (SELECT sample_id, {REASON} AS reason FROM reads), n AS (SELECT sample_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2)
SELECT t.sample_id, t.total, round(coalesce(b.n, 0) / t.total, 6) AS bad_alignment_pct, (SELECT string_agg(reason || '=' || CAST(n AS VARCHAR), ',' ORDER BY reason) FROM n WHERE n.sample_id = t.sample_id) AS filtered
FROM (SELECT sample_id, count(*) AS total FROM r GROUP BY 1) t LEFT JOIN n b ON b.sample_id = t.sample_id AND b.reason = 'bad_align'""")
def filter_summary(v: Views) -> DataFrame:
    out = counting.filter_summary(v.reads.select("sample_id", _reason().alias("reason")), ["sample_id"])
    text = F.array_join(F.transform(F.array_sort(F.map_entries("filtered")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("sample_id", "total", F.round("bad_alignment_pct", 6).alias("bad_alignment_pct"), text.alias("filtered"))


def _pile_sql(c: str) -> str:
    mean = f"coalesce(sum({c}), 0) / any_value(last - first + 1)"
    return mean if "_w" in c else f"floor({mean})"


_PILES = [f"{kind}_{p}" for kind in ("ref", "other") for p in counting.PILES]
_IS = {"ref": "element = 'REF_RF'", "other": "element <> 'REF_RF'", "alt": "element = 'LF_INS'"}
_AGGS = ", ".join(f"coalesce(sum(CASE WHEN {_IS[k]} AND {'' if p.endswith('rev') else 'NOT '}is_reverse THEN {'1 - pow(10, -qual / 10)' if p[0] == 'w' else '1'} ELSE 0 END), 0) AS {k}_{p}" for k in ("ref", "other", "alt") for p in counting.PILES)


@query(f"""WITH d AS (SELECT site, pos, {_AGGS} FROM observations GROUP BY 1, 2), i AS (SELECT id, pos % 50 AS site, pos % 2000 AS start, pos % 2000 + length(ref) - 1 - CASE WHEN id % 4 = 0 THEN length(ref) ELSE 0 END AS stop FROM variants),
s AS (SELECT *, greatest(least(start, stop), 0) AS first, greatest(start, stop) AS last FROM i),
m AS (SELECT s.id, {', '.join(f'{_pile_sql(c)} AS {c}' for c in _PILES)}, {', '.join(f"coalesce(any_value(CASE WHEN d.pos = s.start THEN alt_{p} END), 0) AS alt_{p}" for p in counting.PILES)} FROM s LEFT JOIN d ON d.site = s.site AND d.pos BETWEEN s.first AND s.last GROUP BY s.id)
SELECT id, {', '.join(f"round(CAST(ref_{p} AS DOUBLE), 6) AS ref_{p}, round(CAST(greatest(other_{p} - alt_{p}, 0) AS DOUBLE), 6) AS other_{p}" for p in counting.PILES)} FROM m""")
def variant_piles(v: Views) -> DataFrame:
    """Depth of the reference and of what is neither it nor the variant, over every variant's place."""
    is_ = {"ref": F.col("element") == "REF_RF", "other": F.col("element") != "REF_RF", "alt": F.col("element") == "LF_INS"}
    weight = 1 - F.pow(F.lit(10.0), -F.col("qual") / 10)
    depth = v.observations.groupBy("site", "pos").agg(*[F.sum(F.when(is_[k] & (F.col("is_reverse") if p.endswith("rev") else ~F.col("is_reverse")), weight if p[0] == "w" else F.lit(1)).otherwise(F.lit(0.0) if p[0] == "w" else F.lit(0))).alias(f"{k}_{p}") for k in ("ref", "other", "alt") for p in counting.PILES])
    stop = F.col("start") + F.char_length("ref") - 1 - F.when(F.col("id") % 4 == 0, F.char_length("ref")).otherwise(0)
    own = v.variants.select("id", (F.col("pos") % 50).alias("site"), (F.col("pos") % 2000).alias("start"), "ref").withColumn("stop", stop).drop("ref")
    own = own.join(depth.select("site", F.col("pos").alias("start"), *[f"alt_{p}" for p in counting.PILES]), ["site", "start"], "left").na.fill(0, [f"alt_{p}" for p in counting.PILES])
    out = counting.variant_piles(own, depth, ["site"])
    return out.select("id", *[F.round(F.col(f"{k}_{p}").cast("double"), 6).alias(f"{k}_{p}") for k in ("ref", "other") for p in counting.PILES])


@query("""WITH m AS (SELECT *, mate_pos % 5 AS mp, (pos // 3) % 5 AS at0 FROM reads), z AS (SELECT * FROM m WHERE mapq < 30),
k AS (SELECT sample_id FROM z GROUP BY 1 HAVING count(*) < 1000000 AND floor(avg(len)) <= 2 * (37 + sample_id)), s AS (SELECT sample_id, fragment_id FROM z GROUP BY 1, 2 HAVING count(DISTINCT is_first_mate) = 1),
w AS (SELECT DISTINCT sample_id, fragment_id, NOT is_first_mate AS is_first_mate, mate_chrom, mp FROM z JOIN k USING (sample_id) JOIN s USING (sample_id, fragment_id) WHERE chrom <> mate_chrom OR abs(at0 - mp) >= 1000)
SELECT m.sample_id, m.fragment_id, m.line, m.chrom, m.at0 AS pos FROM m JOIN w ON w.sample_id = m.sample_id AND w.fragment_id = m.fragment_id AND w.is_first_mate = m.is_first_mate AND w.mate_chrom = m.chrom AND w.mp = m.at0""")
def recovered_mates(v: Views) -> DataFrame:
    """Mates of reads of low quality, where a sample's reads are short enough. Places are taken modulo five, so that mates are met."""
    reads = v.reads.withColumns({"pos": F.expr("pos div 3") % 5, "mate_pos": F.col("mate_pos") % 5, "longest": 37 + F.col("sample_id")})
    found = matching.recovered_mates(reads, reads.where("mapq < 30"), ["sample_id"], most=1_000_000, longest="longest")
    return found.select("sample_id", "fragment_id", "line", "chrom", "pos")


_NAMED = "x AS (SELECT id, chrom, start, stop, CASE WHEN weight % 7 > 0 THEN 'n' || CAST(weight % 3 AS VARCHAR) END AS name FROM intervals)"


def _modes() -> str:
    flag = {"lines": "1", "by_id": "CASE WHEN name IS NOT NULL AND name = lag(name) OVER w THEN 0 ELSE 1 END", "superloci": "CASE WHEN chrom = lag(chrom) OVER w AND start <= lag(greatest(start, stop)) OVER w + 3 THEN 0 ELSE 1 END"}
    parts = ["SELECT 'full' AS mode, id, CAST(0 AS BIGINT) AS block FROM x"]
    parts += [f"SELECT '{m}', id, CAST(sum(f) OVER (ORDER BY chrom, start, id) AS BIGINT) FROM (SELECT *, {f} AS f FROM x WINDOW w AS (ORDER BY chrom, start, id))" for m, f in flag.items()]
    return " UNION ALL ".join(parts)


@query(f"WITH {_NAMED} {_modes()}")
def record_blocks(v: Views) -> DataFrame:
    """Blocks of all records by each way of splitting a file."""
    rows = v.intervals.select("id", "chrom", "start", "stop", F.when(F.col("weight") % 7 > 0, F.concat(F.lit("n"), (F.col("weight") % 3).cast("string"))).alias("name"))
    out = None
    for mode in ("full", "lines", "by_id", "superloci"):
        one = intervals.split_records(rows, mode, gap=3).select(F.lit(mode).alias("mode"), "id", "block")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH p AS (SELECT id, 'NNN' || substring(seq, 4) AS ref, reverse(seq) AS read FROM bases), c AS (SELECT id, i, substring(read, i, 1) AS a, substring(ref, i, 1) AS b, length(ref) AS n, length(ref) - length(ltrim(ref, 'N')) AS l, length(ref) - length(rtrim(ref, 'N')) AS r FROM (SELECT *, unnest(range(1, length(ref) + 1)) AS i FROM p)),
o AS (SELECT id, i, CASE WHEN i <= l OR i > n - r THEN 'S' WHEN a = 'N' OR b = 'N' THEN 'N' WHEN a = b THEN 'M' ELSE 'X' END AS op FROM c), g AS (SELECT *, i - row_number() OVER (PARTITION BY id, op ORDER BY i) AS run FROM o),
t AS (SELECT id, op, min(i) AS at0, count(*) AS n FROM g GROUP BY id, op, run), e AS (SELECT id, string_agg(CAST(n AS VARCHAR) || op, '' ORDER BY at0) AS cigar, CAST(sum(CASE op WHEN 'M' THEN 0 WHEN 'N' THEN 3 WHEN 'S' THEN 4 ELSE 8 END + 16 * n) AS BIGINT) AS codes FROM t GROUP BY id)
SELECT id, cigar, codes FROM e""")
def placement_cigars(v: Views) -> DataFrame:
    """Every sequence turned round on itself with Ns in front: the alignment string, and the sum of its codes."""
    text = cigar.of_placement(F.reverse("seq"), F.concat(F.lit("NNN"), F.substring(F.col("seq"), F.lit(4), F.char_length("seq"))))
    # An array of one row: text and codes are made once, where a filter on columns would be moved down and make them again.
    made = F.transform(F.array(text), lambda t: F.struct(t.alias("cigar"), cigar.encoded(cigar.operations(t)).alias("codes")))
    rows = dealt(v.bases).select("id", F.inline(F.filter(made, lambda x: cigar.decoded(x["codes"]) == x["cigar"])))
    return rows.select("id", "cigar", F.aggregate("codes", F.lit(0).cast("long"), lambda s, c: s + c).alias("codes"))


@query("""WITH RECURSIVE ed AS (SELECT graph_id, a, b FROM edges UNION SELECT graph_id, b, a FROM edges WHERE label = 'ALT' AND a % 3 = 0), nd AS (SELECT n_regionkey AS graph_id, n_nationkey AS node, CASE WHEN n_nationkey % 4 > 0 THEN 'A' END AS seq FROM nation UNION ALL SELECT n_regionkey, n_nationkey, 'A' FROM nation WHERE n_nationkey % 7 = 0),
pe AS (SELECT DISTINCT graph_id, a, b FROM ed WHERE a <> b), w AS (SELECT graph_id, a, b FROM pe UNION SELECT w.graph_id, w.a, pe.b FROM w JOIN pe ON pe.graph_id = w.graph_id AND pe.a = w.b), cy AS (SELECT DISTINCT graph_id, a AS node FROM w WHERE a = b)
SELECT graph_id, 'name' AS flaw, CAST(node AS VARCHAR) AS what FROM nd GROUP BY graph_id, node HAVING count(*) > 1 UNION ALL SELECT graph_id, 'sequence', CAST(node AS VARCHAR) FROM nd WHERE seq IS NULL
UNION ALL SELECT DISTINCT graph_id, 'unknown node', CAST(a AS VARCHAR) || ' -> ' || CAST(b AS VARCHAR) FROM ed WHERE (graph_id, a) NOT IN (SELECT graph_id, node FROM nd) OR (graph_id, b) NOT IN (SELECT graph_id, node FROM nd)
UNION ALL SELECT DISTINCT graph_id, 'self', CAST(a AS VARCHAR) || ' -> ' || CAST(b AS VARCHAR) FROM ed WHERE a = b
UNION ALL SELECT DISTINCT graph_id, 'cycle', CAST(node AS VARCHAR) FROM (SELECT graph_id, node FROM cy UNION SELECT w.graph_id, w.b FROM w JOIN cy ON cy.graph_id = w.graph_id AND cy.node = w.a)""")
def graph_flaws(v: Views) -> DataFrame:
    back = v.edges.where("label = 'ALT' AND a % 3 = 0").select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))
    edges = v.edges.select("graph_id", "a", "b").unionByName(back).distinct()
    own = v.table("nation").select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("node"))
    nodes = own.withColumn("seq", F.when(F.col("node") % 4 > 0, F.lit("A"))).unionByName(own.where("node % 7 = 0").withColumn("seq", F.lit("A")))
    return graphs.flaws(nodes.withColumn("reference", F.lit(None).cast("string")), edges, ["graph_id"])


@query("""WITH x AS (SELECT event_id, value * CASE WHEN event_id % 3 = 0 THEN 1000 WHEN event_id % 3 = 1 THEN 0.001 ELSE -1 END AS y FROM events)
SELECT event_id, CASE WHEN y = 0 THEN 0 ELSE round(round(y * pow(10, 4 - floor(log10(abs(y))))) / pow(10, 4 - floor(log10(abs(y)))), 9) END AS y FROM x""")
def significant_digits(v: Views) -> DataFrame:
    i = F.col("event_id") % 3
    y = F.col("value") * F.when(i == 0, 1000).when(i == 1, 0.001).otherwise(-1)
    return v.table("events").select("event_id", F.round(files.significant(y), 9).alias("y"))


@query("""WITH l AS (SELECT CAST(fragment_id AS VARCHAR) || '-mapped-to-' || chrom || ':' || CAST(pos AS VARCHAR) AS k, list_sort(list(mapq)) AS l FROM reads WHERE line <= 5 GROUP BY 1), r AS (SELECT CAST(fragment_id AS VARCHAR) || '-mapped-to-' || chrom || ':' || CAST(pos AS VARCHAR) AS k, list_sort(list(CASE WHEN fragment_id % 5 = 0 THEN mapq + 1 ELSE mapq END)) AS r FROM reads WHERE line >= 2 GROUP BY 1)
SELECT coalesce(l.k, r.k) AS key, CASE WHEN l.l IS NULL OR r.r IS NULL THEN 'ID' WHEN len(l.l) <> len(r.r) THEN 'COUNT' ELSE 'DIFF' END AS kind FROM l FULL OUTER JOIN r ON l.k = r.k WHERE l.l IS NULL OR r.r IS NULL OR l.l <> r.r""")
def compare_placements(v: Views) -> DataFrame:
    second = v.reads.where("line >= 2").withColumn("mapq", F.when(F.col("fragment_id") % 5 == 0, F.col("mapq") + 1).otherwise(F.col("mapq")))
    return matching.compared_placements(v.reads.where("line <= 5"), second, "mapq")

