"""Queries over reads: scans, filters, counts, interval joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from graphcall.operators import counting, intervals, matching
from graphcall.plans.registry import Views, query

KEYS = ["sample_id", "site"]


@query("SELECT sample_id, fragment_id, chrom, pos, mapq FROM reads WHERE NOT is_secondary AND chrom = 'chr2' AND pos BETWEEN 300 AND 4000")
def scan_primary_reads(v: Views) -> DataFrame:
    return v.reads.where(~F.col("is_secondary") & (F.col("chrom") == "chr2") & F.col("pos").between(300, 4000)).select("sample_id", "fragment_id", "chrom", "pos", "mapq")


@query("""SELECT sample_id, site, fragment_id, count(*) AS n_reads, count(*) FILTER (NOT is_reverse) AS n_fwd, count(*) FILTER (is_reverse) AS n_rev,
string_agg(DISTINCT element, ',' ORDER BY element) AS elements FROM observations GROUP BY 1, 2, 3""")
def fragments(v: Views) -> DataFrame:
    return counting.fragments(v.observations, KEYS).withColumn("elements", F.array_join("elements", ","))


FRAGS = "f AS (SELECT sample_id, site, fragment_id, count(*) AS n_reads, count(*) FILTER (NOT is_reverse) AS n_fwd, count(*) FILTER (is_reverse) AS n_rev, list(DISTINCT {e}) AS els, max(pos) - min(pos) AS span FROM observations GROUP BY 1, 2, 3)"


@query("WITH " + FRAGS.format(e="element") + " SELECT sample_id, site, e AS element, count(*) AS fragments, CAST(sum(n_reads) AS BIGINT) AS reads, CAST(sum(n_fwd) AS BIGINT) AS fwd, CAST(sum(n_rev) AS BIGINT) AS rev FROM (SELECT *, unnest(els) AS e FROM f) GROUP BY 1, 2, 3")
def read_counts_by_edge(v: Views) -> DataFrame:
    return counting.element_counts(counting.fragments(v.observations, KEYS), KEYS)


@query("WITH " + FRAGS.format(e="split_part(element, '_', 1)") + " SELECT site, e AS element, count(*) AS fragments, CAST(sum(n_reads) AS BIGINT) AS reads, CAST(sum(n_fwd) AS BIGINT) AS fwd, CAST(sum(n_rev) AS BIGINT) AS rev FROM (SELECT *, unnest(els) AS e FROM f) GROUP BY 1, 2")
def read_counts_by_node(v: Views) -> DataFrame:
    nodes = v.observations.withColumn("element", F.split_part("element", F.lit("_"), F.lit(1)))
    return counting.element_counts(counting.fragments(nodes, KEYS), ["site"])


@query("WITH " + FRAGS.format(e="element") + " SELECT site, array_to_string(list_sort(els), ',') AS labels, count(*) AS fragments FROM f GROUP BY 1, 2")
def read_counts_by_sequence(v: Views) -> DataFrame:
    return counting.sequence_counts(counting.fragments(v.observations, KEYS), ["site"])


@query("WITH " + FRAGS.format(e="element") + """ SELECT sample_id, round(avg(span) FILTER (n_reads >= 2), 6) AS mean_length, round(quantile_cont(span, 0.5) FILTER (n_reads >= 2), 6) AS median_length,
round(var_pop(span) FILTER (n_reads >= 2), 6) AS variance, count(*) FILTER (n_reads = 1) AS single, count(*) FILTER (n_reads = 2) AS paired, count(*) FILTER (n_reads > 2) AS multi FROM f GROUP BY 1""")
def fragment_statistics(v: Views) -> DataFrame:
    frags = v.observations.groupBy("sample_id", "site", "fragment_id").agg(F.count("*").alias("n_reads"), (F.max("pos") - F.min("pos")).alias("span"))
    out = counting.spread(frags, ["sample_id"], F.col("span"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_length", "median_length", "variance")})


@query("""SELECT site, element, count(*) FILTER (NOT is_reverse) AS depth_fwd, count(*) FILTER (is_reverse) AS depth_rev,
round(sum(CASE WHEN is_reverse THEN 0 ELSE 1 - pow(10, -qual / 10) END), 6) AS weight_fwd, round(sum(CASE WHEN is_reverse THEN 1 - pow(10, -qual / 10) ELSE 0 END), 6) AS weight_rev FROM observations GROUP BY 1, 2""")
def variant_pileup(v: Views) -> DataFrame:
    return counting.strand_depth(v.observations, ["site", "element"]).withColumns({c: F.round(c, 6) for c in ("weight_fwd", "weight_rev")})


@query("""SELECT site, pos, count(*) FILTER (NOT is_reverse) AS depth_fwd, count(*) FILTER (is_reverse) AS depth_rev,
round(sum(CASE WHEN is_reverse THEN 0 ELSE 1 - pow(10, -qual / 10) END), 6) AS weight_fwd, round(sum(CASE WHEN is_reverse THEN 1 - pow(10, -qual / 10) ELSE 0 END), 6) AS weight_rev FROM observations GROUP BY 1, 2""")
def pileup(v: Views) -> DataFrame:
    return counting.strand_depth(v.observations, ["site", "pos"]).withColumns({c: F.round(c, 6) for c in ("weight_fwd", "weight_rev")})


@query("""WITH n AS (SELECT site, pos, count(*) FILTER (element = 'REF_RF') AS nref, count(*) FILTER (element <> 'REF_RF') AS nalt FROM observations GROUP BY 1, 2)
SELECT i.id, CAST(floor(avg(nref)) AS BIGINT) AS ref_depth, CAST(floor(avg(nalt)) AS BIGINT) AS alt_depth, count(*) AS positions FROM (SELECT id, pos % 50 AS site, pos % 2000 AS start, pos % 2000 + size AS stop FROM variants) i
JOIN n ON n.site = i.site AND n.pos BETWEEN i.start AND i.stop GROUP BY i.id""")
def variant_depths(v: Views) -> DataFrame:
    alt = F.col("element") != "REF_RF"
    depth = v.observations.groupBy("site", F.col("pos").alias("start"), F.col("pos").alias("stop")).agg(F.count_if(~alt).alias("nref"), F.count_if(alt).alias("nalt"))
    spans = v.variants.select("id", (F.col("pos") % 50).alias("site"), (F.col("pos") % 2000).alias("r_start"), (F.col("pos") % 2000 + F.col("size")).alias("r_stop"))
    hit = intervals.overlap_join(depth, spans, ["site"], width=64)
    return hit.groupBy("id").agg(F.floor(F.avg("nref")).alias("ref_depth"), F.floor(F.avg("nalt")).alias("alt_depth"), F.count("*").alias("positions"))


_W = "sum(CASE WHEN {w} THEN 1 - pow(10, -qual / 10) ELSE 0 END)"


@query(f"""WITH o AS (SELECT site, pos // 50 AS place, count(*) FILTER (element = 'REF_RF' AND NOT is_reverse) AS rf, count(*) FILTER (element = 'REF_RF' AND is_reverse) AS rr,
count(*) FILTER (element <> 'REF_RF' AND NOT is_reverse) AS vf, count(*) FILTER (element <> 'REF_RF' AND is_reverse) AS vr,
{_W.format(w="element = 'REF_RF' AND NOT is_reverse")} AS wrf, {_W.format(w="element = 'REF_RF' AND is_reverse")} AS wrr, {_W.format(w="element <> 'REF_RF' AND NOT is_reverse")} AS wvf, {_W.format(w="element <> 'REF_RF' AND is_reverse")} AS wvr FROM observations GROUP BY 1, 2),
n AS (SELECT site, max(pos) // 50 + 1 AS size FROM observations GROUP BY 1), c AS (SELECT site, size, CAST(sum(size) OVER (ORDER BY site) AS BIGINT) - size AS before FROM n), g AS (SELECT site, before, unnest(range(0, size)) AS place FROM c)
SELECT g.site, g.place AS "offset", before + g.place AS cpos, substring('ACGT', CAST(g.place % 4 + 1 AS INT), 1) AS base, coalesce(rf + rr, 0) AS ref, coalesce(rf, 0) AS ref_fwd, coalesce(rr, 0) AS ref_rev, coalesce(vf + vr, 0) AS other, coalesce(vf, 0) AS other_fwd, coalesce(vr, 0) AS other_rev,
round(coalesce(wrf + wrr, 0), 6) AS wref, round(coalesce(wrf, 0), 6) AS wref_fwd, round(coalesce(wrr, 0), 6) AS wref_rev, round(coalesce(wvf + wvr, 0), 6) AS wother, round(coalesce(wvf, 0), 6) AS wother_fwd, round(coalesce(wvr, 0), 6) AS wother_rev
FROM g LEFT JOIN o USING (site, place)""")
def node_coverage(v: Views) -> DataFrame:
    # A site's sequence is as long as its data reach.
    size = F.floor(F.max("pos") / 50) + 1
    nodes = v.observations.groupBy("site").agg(size.alias("size")).select("site", F.left(F.repeat(F.lit("ACGT"), F.ceil(F.col("size") / 4).cast("int")), F.col("size")).alias("seq"))
    bases = v.observations.select("site", F.floor(F.col("pos") / 50).alias("offset"), (F.col("element") == "REF_RF").alias("is_ref"), "is_reverse", "qual")
    rows = counting.coverage(nodes, bases, "site")
    return rows.withColumns({c: F.round(c, 6) for c in rows.columns if c.startswith("w")})


@query("""WITH o AS (SELECT site, element, count(*) AS depth FROM observations GROUP BY 1, 2), p AS (SELECT * FROM (VALUES ('REF', 0, 'REF_RF'), ('ALT', 0, 'LF_ALT'), ('ALT', 1, 'LF_INS')) t(path, place, element))
SELECT site, path, CAST(sum(depth) AS BIGINT) AS depth, count(*) AS nodes FROM o JOIN p USING (element) GROUP BY 1, 2""")
def path_coverage(v: Views) -> DataFrame:
    depth = v.observations.groupBy("site", "element").agg(F.count("*").alias("depth"))
    paths = v.spark.createDataFrame([("REF", 0, "REF_RF"), ("ALT", 0, "LF_ALT"), ("ALT", 1, "LF_INS")], "path string, place int, element string")
    return depth.join(paths, "element").groupBy("site", "path").agg(F.sum("depth").alias("depth"), F.count("*").alias("nodes"))


@query("WITH " + FRAGS.format(e="element") + " SELECT site, array_to_string(list_sort(els), ',') AS family, count(*) AS n FROM f WHERE len(els) > 1 GROUP BY 1, 2")
def phasing_families(v: Views) -> DataFrame:
    frags = counting.fragments(v.observations, KEYS).where(F.size("elements") > 1)
    return counting.sequence_counts(frags, ["site"]).select("site", F.col("labels").alias("family"), F.col("fragments").alias("n"))


@query("""SELECT site, element, count(*) AS reads, round(count(*) FILTER (is_reverse) / count(*), 6) AS reverse_rate, round(avg(qual), 6) AS mean_qual, round(count(*) FILTER (qual < 20) / count(*), 6) AS low_rate FROM observations GROUP BY 1, 2
UNION ALL SELECT site, 'all', count(*), round(count(*) FILTER (is_reverse) / count(*), 6), round(avg(qual), 6), round(count(*) FILTER (qual < 20) / count(*), 6) FROM observations GROUP BY 1""")
def alignment_statistics(v: Views) -> DataFrame:
    # Rates by element and over all elements from one pass.
    rows = v.observations.cube("site", "element").agg(
        F.count("*").alias("reads"), F.round(F.count_if("is_reverse") / F.count("*"), 6).alias("reverse_rate"), F.round(F.avg("qual"), 6).alias("mean_qual"),
        F.round(F.count_if(F.col("qual") < 20) / F.count("*"), 6).alias("low_rate"), F.grouping_id().alias("level"),
    )
    return rows.where("level < 2").withColumn("element", F.coalesce("element", F.lit("all"))).drop("level")


REASON = "CASE WHEN NOT is_unique THEN 'nonuniq' WHEN mapq < 12 THEN 'bad_align' WHEN len < 60 THEN 'kmer_tooshort' END"


def _reason() -> F.Column:
    return counting.filter_reason([("nonuniq", ~F.col("is_unique")), ("bad_align", F.col("mapq") < 12), ("kmer_tooshort", F.col("len") < 60)])


@query(f"SELECT sample_id, fragment_id, line, pos, coalesce({REASON}, 'pass') AS reason FROM reads")
def read_filter_chain(v: Views) -> DataFrame:
    return v.reads.select("sample_id", "fragment_id", "line", "pos", F.coalesce(_reason(), F.lit("pass")).alias("reason"))


@query(f"SELECT sample_id, {REASON} AS reason, count(*) AS n FROM reads WHERE {REASON} IS NOT NULL GROUP BY 1, 2")
def filter_counts(v: Views) -> DataFrame:
    return v.reads.select("sample_id", _reason().alias("reason")).where("reason IS NOT NULL").groupBy("sample_id", "reason").agg(F.count("*").alias("n"))


@query("""SELECT r.fragment_id, r.line, r.pos, r.mate_pos, g.region_id FROM reads r JOIN regions g ON r.chrom = g.chrom AND ((r.pos <= g.stop AND r.pos + r.len >= g.start) OR (r.mate_chrom = g.chrom AND r.mate_pos <= g.stop AND r.mate_pos + r.len >= g.start))""")
def read_or_mate_in_region(v: Views) -> DataFrame:
    found = matching.near_regions(v.reads, v.regions.select("region_id", "chrom", F.col("start").alias("r_start"), F.col("stop").alias("r_stop")), width=256)
    return found.select("fragment_id", "line", "pos", "mate_pos", "region_id")


@query("SELECT r.sample_id, r.fragment_id, r.pos, g.region_id FROM reads r JOIN regions g ON r.chrom = g.chrom AND r.pos <= g.stop AND r.pos + r.len >= g.start")
def region_range_join(v: Views) -> DataFrame:
    left = v.reads.select("sample_id", "fragment_id", "chrom", "pos", F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("stop"))
    right = v.regions.select("region_id", "chrom", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    return intervals.overlap_join(left, right, ["chrom"], width=256).select("sample_id", "fragment_id", "pos", "region_id")


@query("""WITH s AS (SELECT sample_id, fragment_id, count(DISTINCT is_first_mate) AS slots FROM reads GROUP BY 1, 2)
SELECT r.sample_id, r.fragment_id, r.line, r.pos, r.mate_pos FROM reads r JOIN s USING (sample_id, fragment_id) WHERE slots = 1 AND (chrom <> mate_chrom OR abs(pos - mate_pos) >= 1000)""")
def mate_recovery(v: Views) -> DataFrame:
    return matching.mates_to_recover(v.reads, ["sample_id", "fragment_id"]).select("sample_id", "fragment_id", "line", "pos", "mate_pos")


@query("SELECT sample_id, chrom, fragment_id, pos, row FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY pos, fragment_id, line, tie) AS row FROM reads) WHERE row <= 40")
def max_reads_cap(v: Views) -> DataFrame:
    return counting.capped(v.reads, ["sample_id", "chrom"], ["pos", "fragment_id", "line", "tie"], 40).select("sample_id", "chrom", "fragment_id", "pos", "row")


@query("""SELECT sample_id, fragment_id, is_first_mate, pos FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, fragment_id, is_first_mate ORDER BY line DESC, tie DESC, pos DESC) AS n FROM reads) WHERE n = 1""")
def last_mates(v: Views) -> DataFrame:
    order = [F.col("line"), F.col("tie"), F.col("pos")]
    return counting.last_of_mates(v.reads, ["sample_id", "fragment_id", "is_first_mate"], order).select("sample_id", "fragment_id", "is_first_mate", "pos")


@query("""WITH m AS (SELECT id, chrom, start, stop, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM intervals),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, stop, id) AS island FROM m)
SELECT chrom, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i GROUP BY chrom, island""")
def merge_intervals(v: Views) -> DataFrame:
    return intervals.merged(v.intervals, ["chrom"])


@query("""WITH m AS (SELECT id, chrom, start, stop, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM intervals)
SELECT id, chrom, CAST(sum(CASE WHEN before IS NULL OR start > before + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, stop, id) AS BIGINT) AS island FROM m""")
def interval_islands(v: Views) -> DataFrame:
    return intervals.islands(v.intervals, ["chrom"], slack=5).select("id", "chrom", "island")


@query("""WITH s AS (SELECT chrom, start AS pos, 1 AS step FROM intervals UNION ALL SELECT chrom, stop + 1, -1 FROM intervals), g AS (SELECT chrom, pos, sum(step) AS step FROM s GROUP BY 1, 2)
SELECT chrom, pos, depth FROM (SELECT chrom, pos, step, CAST(sum(step) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS depth FROM g) WHERE step <> 0""")
def depth_sweep(v: Views) -> DataFrame:
    return intervals.sweep(v.intervals, ["chrom"])


@query("""WITH e AS (SELECT DISTINCT chrom, pos FROM (SELECT chrom, start AS pos FROM intervals UNION ALL SELECT chrom, stop + 1 FROM intervals)),
n AS (SELECT chrom, pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS next FROM e)
SELECT n.chrom, n.pos AS start, n.next - 1 AS stop, count(*) AS cover FROM n JOIN intervals i ON i.chrom = n.chrom AND i.start <= n.pos AND i.stop >= n.next - 1 WHERE next IS NOT NULL GROUP BY 1, 2, 3""")
def split_overlaps(v: Views) -> DataFrame:
    return intervals.split_at_boundaries(v.intervals, ["chrom"])


@query("""WITH l AS (SELECT *, lag(stop) OVER (PARTITION BY chrom ORDER BY start, id) AS before FROM intervals)
SELECT id, chrom, CAST(sum(CASE WHEN before IS NULL OR start > before + 8 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, id) AS BIGINT) AS block FROM l""")
def superloci(v: Views) -> DataFrame:
    return intervals.blocks_by_gap(v.intervals, ["chrom"], 8).select("id", "chrom", "block")


@query("""WITH l AS (SELECT *, weight % 3 AS kind, lag(weight % 3) OVER (PARTITION BY chrom ORDER BY start, id) AS before FROM intervals)
SELECT id, chrom, kind, CAST(sum(CASE WHEN before IS NULL OR before <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, id) AS BIGINT) AS run FROM l""")
def split_by_id(v: Views) -> DataFrame:
    rows = v.intervals.withColumn("kind", F.col("weight") % 3)
    return intervals.runs(rows, ["chrom"], ["start", "id"], "kind").select("id", "chrom", "kind", "run")


@query("SELECT id, chrom, start, coalesce(max(stop) OVER (PARTITION BY chrom ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS boundary FROM intervals")
def running_max_boundary(v: Views) -> DataFrame:
    return intervals.stops_before(v.intervals, ["chrom"]).select("id", "chrom", "start", "boundary")


@query("""SELECT chrom, start, stop, string_agg(DISTINCT CAST(weight % 4 AS STRING), ',' ORDER BY CAST(weight % 4 AS STRING)) AS labels, count(*) AS n FROM intervals GROUP BY 1, 2, 3""")
def merge_ref_segments(v: Views) -> DataFrame:
    label = (F.col("weight") % 4).cast("string")
    return v.intervals.groupBy("chrom", "start", "stop").agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.count("*").alias("n"))


@query("""WITH b AS (SELECT chrom, weight, start, stop + 1 AS e, unnest(range(start // 64, stop // 64 + 1)) AS bin FROM intervals)
SELECT chrom, bin, round(sum(weight * (least(e, (bin + 1) * 64) - greatest(start, bin * 64)) / (e - start)), 4) AS amount, count(*) AS slices FROM b GROUP BY 1, 2""")
def range_bin_join(v: Views) -> DataFrame:
    rows = intervals.spread_over_bins(v.intervals.withColumn("stop", F.col("stop") + 1), width=64, amount="weight")
    return rows.groupBy("chrom", "bin").agg(F.round(F.sum("share"), 4).alias("amount"), F.count("*").alias("slices"))


@query("""WITH b AS (SELECT user_id % 40 AS bin, count(*) AS slices, sum(event_id % 997) AS bytes FROM events GROUP BY 1)
SELECT bin, slices, CAST(bytes AS BIGINT) AS bytes, round(bytes / avg(bytes) OVER (), 6) AS normalised FROM b""")
def index_bins(v: Views) -> DataFrame:
    # Forty bins whatever the input: the mean over all bins is a window over forty rows.
    rows = v.table("events").groupBy((F.col("user_id") % 40).alias("bin")).agg(F.count("*").alias("slices"), F.sum(F.col("event_id") % 997).alias("bytes"))
    return rows.withColumn("normalised", F.round(F.col("bytes") / F.avg("bytes").over(Window.partitionBy()), 6))


@query("SELECT chrom, CAST(quantile_cont(depth, 0.5) AS DOUBLE) AS median, round(var_pop(depth), 6) AS variance, CAST(sum(depth) AS BIGINT) AS reads FROM (SELECT chrom, pos, count(*) AS depth FROM reads GROUP BY 1, 2) GROUP BY 1")
def depth_estimate(v: Views) -> DataFrame:
    depth = v.reads.groupBy("chrom", "pos").agg(F.count("*").alias("depth"))
    return depth.groupBy("chrom").agg(F.percentile("depth", 0.5).alias("median"), F.round(F.var_pop("depth"), 6).alias("variance"), F.sum("depth").alias("reads"))


@query("WITH d AS (SELECT chrom, quantile_cont(depth, 0.5) AS median, max(pos) AS size FROM (SELECT chrom, pos, count(*) AS depth FROM reads GROUP BY 1, 2) GROUP BY 1) SELECT round(sum(size * median) / sum(size), 6) AS depth FROM d WHERE regexp_full_match(chrom, 'chr[1-4]')")
def autosome_depth(v: Views) -> DataFrame:
    depth = v.reads.where(F.col("chrom").rlike("^chr[1-4]$")).groupBy("chrom", "pos").agg(F.count("*").alias("depth"))
    by = depth.groupBy("chrom").agg(F.percentile("depth", 0.5).alias("median"), F.max("pos").alias("size"))
    return by.agg(F.round(F.sum(F.col("size") * F.col("median")) / F.sum("size"), 6).alias("depth"))


@query("""WITH k AS (SELECT n_nationkey * 3 AS key, n_name AS target FROM nation UNION ALL SELECT r_regionkey * 6, r_name FROM region), c AS (SELECT key, count(*) AS n, min(target) AS target FROM k GROUP BY 1)
SELECT s_suppkey, coalesce(a.n, b.n, 0) AS matches, CASE WHEN coalesce(a.n, b.n, 0) = 0 THEN 'UNMATCHED' WHEN coalesce(a.n, b.n) > 1 THEN 'MULTIMATCHED' ELSE 'MATCHED' END AS status, CASE WHEN coalesce(a.n, b.n, 0) = 1 THEN coalesce(a.target, b.target) END AS target
FROM supplier LEFT JOIN c a ON a.key = s_suppkey LEFT JOIN c b ON b.key = s_suppkey + 1""")
def match_with_fallback(v: Views) -> DataFrame:
    found = v.table("nation").select((F.col("n_nationkey") * 3).alias("key"), F.col("n_name").alias("target"))
    found = found.unionByName(v.table("region").select((F.col("r_regionkey") * 6).alias("key"), F.col("r_name").alias("target")))
    rows = v.table("supplier").select("s_suppkey", F.col("s_suppkey").alias("one"), (F.col("s_suppkey") + 1).alias("two"))
    return matching.match_with_fallback(rows, found, "one", "two").select("s_suppkey", "matches", "status", "target")


@query("""WITH l AS (SELECT fragment_id AS k, list_sort(list(pos)) AS l FROM reads WHERE line <= 5 GROUP BY 1), r AS (SELECT fragment_id AS k, list_sort(list(pos)) AS r FROM reads WHERE line >= 2 GROUP BY 1)
SELECT coalesce(l.k, r.k) AS fragment_id, CASE WHEN l.l IS NULL OR r.r IS NULL THEN 'ID' WHEN len(l.l) <> len(r.r) THEN 'COUNT' ELSE 'DIFF' END AS kind FROM l FULL OUTER JOIN r ON l.k = r.k WHERE l.l IS NULL OR r.r IS NULL OR l.l <> r.r""")
def compare_alignments(v: Views) -> DataFrame:
    return matching.compared(v.reads.where("line <= 5"), v.reads.where("line >= 2"), "fragment_id", "pos")


@query("SELECT sample_id, chrom, fragment_id, pos, rank() OVER (PARTITION BY sample_id, chrom, is_reverse ORDER BY mapq DESC) AS place FROM reads QUALIFY rank() OVER (PARTITION BY sample_id, chrom, is_reverse ORDER BY mapq DESC) <= 2")
def best_second_best(v: Views) -> DataFrame:
    place = F.rank().over(Window.partitionBy("sample_id", "chrom", "is_reverse").orderBy(F.desc("mapq")))
    return v.reads.withColumn("place", place).where("place <= 2").select("sample_id", "chrom", "fragment_id", "pos", "place")


@query("SELECT sample_id, chrom, pos, fragment_id, tie FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY len DESC, pos, fragment_id, tie) AS n FROM reads) WHERE n <= 3")
def topk_candidates(v: Views) -> DataFrame:
    order = Window.partitionBy("sample_id", "chrom").orderBy(F.desc("len"), "pos", "fragment_id", "tie")
    return v.reads.withColumn("n", F.row_number().over(order)).where("n <= 3").select("sample_id", "chrom", "pos", "fragment_id", "tie")


@query("SELECT sample_id, chrom, min(pos) AS pos, count(*) AS n FROM reads GROUP BY 1, 2, mapq, is_reverse")
def dedupe_seeds(v: Views) -> DataFrame:
    return v.reads.groupBy("sample_id", "chrom", "mapq", "is_reverse").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).drop("mapq", "is_reverse")


@query("SELECT sample_id, fragment_id, line, is_reverse FROM reads WHERE is_unique EXCEPT SELECT sample_id, fragment_id, line, is_reverse FROM reads WHERE is_secondary")
def sample_difference(v: Views) -> DataFrame:
    own = v.reads.select("sample_id", "fragment_id", "line", "is_reverse", "is_unique", "is_secondary")
    cols = ["sample_id", "fragment_id", "line", "is_reverse"]
    return own.where("is_unique").select(*cols).subtract(own.where("is_secondary").select(*cols))


@query("""SELECT element, count(DISTINCT mapped) AS alleles, round(count(*) FILTER (wrong) / count(*), 6) AS wrong_rate, CASE WHEN count(*) FILTER (wrong) = 0 THEN 60 ELSE CAST(floor(-10 * log10(count(*) FILTER (wrong) / count(*))) AS INT) END AS mapq
FROM (SELECT element, pos % 3 AS mapped, qual < 5 AND element <> 'REF_RF' AS wrong FROM observations) GROUP BY element""")
def validation_mapq(v: Views) -> DataFrame:
    wrong = (F.col("qual") < 5) & (F.col("element") != "REF_RF")
    share = F.count_if(wrong) / F.count("*")
    return v.observations.groupBy("element").agg(
        F.count_distinct(F.col("pos") % 3).alias("alleles"), F.round(share, 6).alias("wrong_rate"),
        F.when(F.count_if(wrong) == 0, F.lit(60)).otherwise(F.floor(-10 * F.log10(F.greatest(share, F.lit(1e-300)))).cast("int")).alias("mapq"),
    )


