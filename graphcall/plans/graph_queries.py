"""Queries over sequences, alignments, graphs and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphcall.functions import cigar, sequence
from graphcall.operators import alignment, alleles, building, events, graphs, haplotypes, matching, vcf
from graphcall.operators.storage import dealt, shuffled
from graphcall.plans.registry import Views, query
from graphcall.sources import files


@query("SELECT id, regexp_replace(upper(name), '[^ACGT]', 'N', 'g') AS seq FROM bases")
def fasta_normalize(v: Views) -> DataFrame:
    return v.bases.select("id", sequence.normalise_bases(F.col("name")).alias("seq"))


@query("SELECT id, length(trim(seq, 'N')) AS size, length(seq) AS whole FROM bases")
def contig_non_n_size(v: Views) -> DataFrame:
    return v.bases.select("id", sequence.non_n_size(F.col("seq")).cast("long").alias("size"), F.char_length("seq").cast("long").alias("whole"))


@query("SELECT id % 20 AS graph_id, max(length(seq)) AS longest FROM bases GROUP BY 1")
def longest_alt_insertion(v: Views) -> DataFrame:
    return v.bases.groupBy((F.col("id") % 20).alias("graph_id")).agg(F.max(F.char_length("seq")).cast("long").alias("longest"))


@query("SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM bases")
def reverse_complement(v: Views) -> DataFrame:
    return v.bases.select("id", sequence.reverse_complement(F.col("seq")).alias("rc"))


_WINDOWS = "w AS (SELECT id, unnest(range(0, length(seq) - 4)) AS pos, seq FROM bases), k AS (SELECT id, pos, substring(seq, pos + 1, 5) AS kmer FROM w), g AS (SELECT * FROM k WHERE NOT regexp_matches(kmer, '[^ACGT]'))"


@query(f"WITH {_WINDOWS} SELECT id, pos, kmer FROM g")
def kmers(v: Views) -> DataFrame:
    return v.bases.select("id", F.explode(sequence.kmers(F.col("seq"), 5)).alias("w")).select("id", F.col("w.pos").cast("long").alias("pos"), "w.kmer")


@query(f"""WITH {_WINDOWS} SELECT id, pos, CAST(list_reduce(list_prepend(0, [CAST(x AS BIGINT) FOR x IN string_split(translate(kmer, 'ACGT', '0123'), '')]), lambda a, b: a * 4 + b) AS BIGINT) AS code FROM g""")
def kmer_encode(v: Views) -> DataFrame:
    rows = v.bases.select("id", F.explode(sequence.kmers(F.col("seq"), 5)).alias("w"))
    return rows.select("id", F.col("w.pos").cast("long").alias("pos"), sequence.kmer_code(F.col("w.kmer")).alias("code"))


_LONG = _WINDOWS.replace("length(seq) - 4", "length(seq) - 8").replace("pos + 1, 5", "pos + 1, 9")


@query(f"WITH {_LONG}, o AS (SELECT kmer FROM g GROUP BY kmer HAVING count(*) = 1) SELECT id, count(*) AS unique_kmers FROM g JOIN o USING (kmer) GROUP BY id")
def kmer_stats(v: Views) -> DataFrame:
    return graphs.unique_kmers(dealt(v.bases.select("id", "seq")), 9).groupBy("id").agg(F.count("*").alias("unique_kmers"))


@query(f"WITH {_LONG}, r AS (SELECT id AS read, kmer, min(pos) AS read_pos FROM g GROUP BY 1, 2) SELECT read, g.id AS path, count(*) AS seeds, min(pos - read_pos) AS diagonal FROM r JOIN g USING (kmer) GROUP BY 1, 2")
def kmer_seed_join(v: Views) -> DataFrame:
    rows = v.bases.select("id", "seq")
    return matching.seed_pairs(rows, rows, 9)


@query(f"""WITH {_WINDOWS}, o AS (SELECT kmer FROM g GROUP BY kmer HAVING count(*) = 1), n AS (SELECT id, count(*) AS have, count(o.kmer) AS hit FROM g LEFT JOIN o USING (kmer) GROUP BY id)
SELECT b.id, CASE WHEN length(b.seq) < 12 THEN 'kmer_tooshort' WHEN have IS NULL THEN 'kmer_nomapping' WHEN hit = 0 THEN 'kmer_uncov' ELSE 'pass' END AS reason FROM bases b LEFT JOIN n ON n.id = b.id""")
def kmer_coverage_filter(v: Views) -> DataFrame:
    words = v.bases.select("id", F.explode(sequence.kmers(F.col("seq"), 5)).alias("w")).groupBy("id").agg(F.count("*").alias("have"))
    hit = graphs.unique_kmers(v.bases.select("id", "seq"), 5).groupBy("id").agg(F.count("*").alias("hit"))
    rows = v.bases.join(words, "id", "left").join(hit, "id", "left")
    reason = F.when(F.char_length("seq") < 12, "kmer_tooshort").when(F.col("have").isNull(), "kmer_nomapping").when(F.col("hit").isNull(), "kmer_uncov").otherwise("pass")
    return rows.select("id", reason.alias("reason"))


@query("SELECT p_size AS q, round(pow(10, -p_size / 10), 8) AS error, round(-10 * log10(p_size / 100), 6) AS back FROM part GROUP BY 1")
def phred(v: Views) -> DataFrame:
    q = F.col("p_size")
    rows = v.table("part").select("p_size").distinct()
    return rows.select(q.alias("q"), F.round(sequence.phred_to_error(q), 8).alias("error"), F.round(sequence.error_to_phred(q / 100), 6).alias("back"))


@query("SELECT region_id, chrom || ':' || CAST(start + 1 AS STRING) || '-' || CAST(stop + 1 AS STRING) AS text FROM regions")
def format_region(v: Views) -> DataFrame:
    return v.regions.select("region_id", sequence.format_region(F.col("chrom"), F.col("start"), F.col("stop")).alias("text"))


@query("SELECT region_id, chrom, CAST(start + 1000 AS BIGINT) AS start, CAST(CASE WHEN region_id % 2 = 0 THEN stop + 1000 ELSE -1 END AS BIGINT) AS stop FROM regions")
def parse_region(v: Views) -> DataFrame:
    text = F.concat("chrom", F.lit(":"), F.format_number(F.col("start") + 1001, 0), F.when(F.col("region_id") % 2 == 0, F.concat(F.lit("-"), F.format_number(F.col("stop") + 1001, 0))).otherwise(""))
    return v.regions.select("region_id", sequence.parse_region(text).alias("r")).select("region_id", "r.chrom", "r.start", F.col("r.end").alias("stop"))


@query("SELECT sample_id, regexp_replace(name || ' a/b', '[^A-Za-z0-9.-]', '_', 'g') AS safe FROM samples")
def safe_name(v: Views) -> DataFrame:
    return v.samples.select("sample_id", sequence.safe_name(F.concat("name", F.lit(" a/b"))).alias("safe"))


@query("SELECT sample_id, lower(substring(sex, 1, 1)) AS sex FROM samples")
def sex_normalize(v: Views) -> DataFrame:
    first = F.lower(F.substring("sex", 1, 1))
    return v.samples.select("sample_id", F.when(first.isin("m", "f", "u"), first).otherwise(F.raise_error(F.lit("unknown sex"))).alias("sex"))


@query("SELECT sample_id, round(coalesce(depth_sd, sqrt(depth_variance), sqrt(5 * depth)), 6) AS depth_sd FROM samples")
def manifest_depth_sd(v: Views) -> DataFrame:
    return v.samples.select("sample_id", F.round(F.coalesce("depth_sd", F.sqrt("depth_variance"), F.sqrt(5 * F.col("depth"))), 6).alias("depth_sd"))


@query("SELECT sample_id, upper(replace(name, '#', '-')) AS up, ends_with(name, '7') AS seven, len(string_split(name, '#')) AS parts, contains(name, '00') AS zeros FROM samples")
def string_utils(v: Views) -> DataFrame:
    n = F.col("name")
    return v.samples.select("sample_id", F.upper(F.replace(n, F.lit("#"), F.lit("-"))).alias("up"), F.endswith(n, F.lit("7")).alias("seven"), F.size(F.split(n, "#")).cast("long").alias("parts"), F.contains(n, F.lit("00")).alias("zeros"))


@query("SELECT n_name, length(n_name) > 8 AS alt, regexp_full_match(n_name, '[A-M].*') AS autosome, regexp_full_match(n_name, '[XYZ].*') AS sex FROM nation")
def contig_classify(v: Views) -> DataFrame:
    n = F.col("n_name")
    return v.table("nation").select("n_name", (F.char_length(n) > 8).alias("alt"), n.rlike("^([A-M].*)$").alias("autosome"), n.rlike("^([XYZ].*)$").alias("sex"))


# An alignment of 30 to 79 bases: matches with a mismatch, perhaps a clip, insertion or deletion.
_CIGAR = "CAST(l_quantity + 20 AS INT)"
_OPS = f"q AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS p, {_CIGAR} AS m, l_suppkey % 12 AS c, l_linenumber % 3 AS x, l_partkey % 4 AS d FROM lineitem)"


def _cigars(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"), (F.col("l_quantity") + 20).cast("int").alias("m"), (F.col("l_suppkey") % 12).alias("c"), (F.col("l_linenumber") % 3).alias("x"), (F.col("l_partkey") % 4).alias("d"))
    piece = lambda c, op: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(op))).otherwise("")
    return rows.withColumn("cigar", F.concat(piece("c", "S"), piece("m", "M"), piece("x", "X"), piece("d", "D")))


@query(f"WITH {_OPS} SELECT k, line, p, m AS matched, CAST(x AS INT) AS mismatched, CAST(c AS INT) AS clipped, CAST(d AS INT) AS deleted, CAST(m + x + c AS INT) AS query_length FROM q")
def cigar_stats(v: Views) -> DataFrame:
    s = cigar.sums(cigar.operations(F.col("cigar")))
    rows = _cigars(v).select("k", "line", "p", s.alias("s"))
    length = F.col("s.matched") + F.col("s.mismatched") + F.col("s.inserted") + F.col("s.clipped")
    return rows.select("k", "line", "p", "s.matched", "s.mismatched", "s.clipped", "s.deleted", length.alias("query_length"))


@query(f"WITH {_OPS} SELECT k, line, p, m + x < round((m + x + c) * 0.8) AS bad FROM q")
def bad_align_filter(v: Views) -> DataFrame:
    rows = _cigars(v).select("k", "line", "p", cigar.sums(cigar.operations(F.col("cigar"))).alias("s"))
    return rows.select("k", "line", "p", cigar.few_aligned(F.col("s")).alias("bad"))


@query(f"WITH {_OPS} SELECT k, line, p, CASE WHEN 2 * (m + x + d) < m + x + c THEN x + c + d = 0 ELSE 2 * (x + c + d) <= m + x + d END AS supported FROM q")
def node_support(v: Views) -> DataFrame:
    ops = cigar.operations(F.col("cigar"))
    length = F.col("m") + F.col("x") + F.col("d")
    return _cigars(v).select("k", "line", "p", cigar.node_supported(ops, length, F.col("m") + F.col("x") + F.col("c")).alias("supported"))


@query(f"""WITH {_OPS}, s AS (SELECT *, CAST(floor((m + x + c + 40) / 10) AS INT) + 1 AS need FROM q)
SELECT k, line, p, m >= least(m + x + d, need) AND m + x + c < 2 * (m + x + d) AND m >= least(m + x + d, need) AND 40 - c >= least(40, need) AND 40 < 80 AND 40 - c >= least(40, need) AS supported FROM s""")
def edge_support(v: Views) -> DataFrame:
    left = cigar.operations(F.col("cigar"))
    right = cigar.operations(F.concat((40 - F.col("c")).cast("string"), F.lit("M"), F.when(F.col("c") > 0, F.concat(F.col("c").cast("string"), F.lit("X"))).otherwise("")))
    length, read = F.col("m") + F.col("x") + F.col("d"), F.col("m") + F.col("x") + F.col("c") + 40
    return _cigars(v).select("k", "line", "p", cigar.edge_supported(left, length, right, F.lit(40), read).alias("supported"))


@query(f"WITH {_OPS} SELECT k, line, p, unnest([0, 1]) AS node, unnest([m + x + c, m]) AS bases, unnest([0, 1]) AS place FROM q")
def graph_cigar_parse(v: Views) -> DataFrame:
    text = F.concat(F.lit("0["), F.col("cigar"), F.lit("]1["), F.col("m").cast("string"), F.lit("M]"))
    rows = _cigars(v).select("k", "line", "p", F.posexplode(cigar.graph_nodes(text)).alias("place", "n"))
    return rows.select("k", "line", "p", F.col("n.node").alias("node"), cigar.total(F.col("n.ops"), "MXIS").alias("bases"), "place")


@query(f"WITH {_OPS} SELECT k, line, p, 0 AS a, 1 AS b, m > 40 AS long FROM q UNION ALL SELECT k, line, p, 1, 2, m > 40 FROM q WHERE x > 0")
def path_edges(v: Views) -> DataFrame:
    text = F.concat(F.lit("0["), F.col("cigar"), F.lit("]1["), F.col("m").cast("string"), F.lit("M]"), F.when(F.col("x") > 0, F.lit("2[5M]")).otherwise(""))
    path = F.transform(cigar.graph_nodes(text), lambda n: n["node"])
    rows = _cigars(v).withColumn("path", path)
    pairs = F.zip_with(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return rows.select("k", "line", "p", F.explode(pairs).alias("e"), (F.col("m") > 40).alias("long")).select("k", "line", "p", "e.a", "e.b", "long")


#: Every row against itself with a base in front, two inserted behind the eighth, three left out behind the tenth and its letters turned round where its id is even.
_ALIGNED = """g AS (SELECT id, seq AS ref, 'G' || substring(seq, 1, 8) || 'TT' || substring(seq, 9, 2) || CASE WHEN id % 2 = 0 THEN translate(substring(seq, 14), 'AC', 'CA') ELSE substring(seq, 14) END AS alt FROM bases WHERE length(seq) > 14),
b AS (SELECT id, ref, alt, unnest(range(0, length(ref))) AS r FROM g), m AS (SELECT id, ref, alt, r, CASE WHEN r < 8 THEN r + 1 WHEN r < 10 THEN r + 3 ELSE r END AS a, CASE WHEN r < 8 THEN 1 WHEN r < 10 THEN 2 ELSE 3 END AS block FROM b WHERE r < 10 OR r >= 13),
p AS (SELECT *, substring(ref, r + 1, 1) AS x, substring(alt, a + 1, 1) AS y FROM m), q AS (SELECT *, r - row_number() OVER (PARTITION BY id, block, x = y ORDER BY r) AS run FROM p)
SELECT id, r AS start, r AS stop, y AS alt, a AS at FROM p WHERE x <> y UNION ALL SELECT id, min(r), max(r), '.', min(a) FROM q WHERE x = y GROUP BY id, block, run
UNION ALL SELECT id, 8, 7, 'TT', 9 FROM g UNION ALL SELECT id, 10, 12, '', 13 FROM g"""


@query(f"WITH {_ALIGNED}")
def cigar_variants(v: Views) -> DataFrame:
    s = F.col("seq")
    tail = F.substring(s, F.lit(14), F.char_length(s))
    alt = F.concat(F.lit("G"), F.left(s, F.lit(8)), F.lit("TT"), F.substring(s, 9, 2), F.when(F.col("id") % 2 == 0, F.translate(tail, "AC", "CA")).otherwise(tail))
    text = F.concat(F.lit("1S8M2I2M3D"), (F.char_length(s) - 13).cast("string"), F.lit("M"))
    rows = dealt(v.bases.where(F.char_length("seq") > 14)).select("id", "seq", alt.alias("alt"), cigar.operations(text).alias("ops"))
    return rows.select("id", F.explode(alleles.cigar_variants(F.col("seq"), F.col("alt"), F.col("ops"), matches=True)).alias("v")).select("id", "v.*")


@query("SELECT id, round((pow(10, -(id % 40) / 10) + pow(10, -((id + 7) % 40) / 10)) / 2, 8) AS error FROM bases")
def mean_qual(v: Views) -> DataFrame:
    quals = F.concat(F.lit("!"), F.char(33 + F.col("id") % 40), F.char(33 + (F.col("id") + 7) % 40), F.lit("!"))
    return v.bases.select("id", F.round(sequence.quality_error(quals, F.lit(2), F.lit(2)), 8).alias("error"))


@query("SELECT id, length(seq) AS n, CAST(list_sum([CASE WHEN substring(seq, i, 1) <> substring(reverse(seq), i, 1) THEN 1 ELSE 0 END FOR i IN range(1, length(seq) + 1)]) AS BIGINT) AS mismatches FROM bases")
def hamming_mismatch(v: Views) -> DataFrame:
    return v.bases.select("id", F.char_length("seq").cast("long").alias("n"), alignment.mismatches(F.col("seq"), F.reverse("seq")).cast("long").alias("mismatches"))


#: Forty rows in order are a contig; a row is its place there.
_CONTIGS = "o AS (SELECT id, id // 40 AS contig, id % 40 AS k, translate(seq, 'N', 'A') AS seq FROM bases)"


def _contigs(v: Views) -> DataFrame:
    return v.bases.select("id", F.expr("id div 40").alias("contig"), (F.col("id") % 40).alias("k"), F.translate("seq", "N", "A").alias("seq"))


def _joined(rows: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "seq"))), lambda x: x["seq"]), "")
    return rows.groupBy("contig").agg(whole.alias("seq"))


@query(f"""WITH {_CONTIGS}, c AS (SELECT contig, string_agg(seq, '' ORDER BY k) AS whole FROM o GROUP BY contig)
SELECT o.id AS read, c.contig AS path, instr(whole, seq) - 1 AS pos FROM o JOIN c ON contains(whole, seq)""")
def exact_path_match(v: Views) -> DataFrame:
    """Whole rows as reads of all whole contigs: the first forward placement without mismatches on each."""
    rows = _contigs(v)
    found = alignment.exact(rows.select("id", "seq"), _joined(rows).withColumnRenamed("contig", "path"))
    return found.groupBy(F.col("id").alias("read"), "path").agg(F.min("start").cast("long").alias("pos"))


@query("WITH r AS (SELECT a.id AS read, b.id AS truth, contains(b.seq, a.seq) AS ok FROM bases a JOIN bases b ON b.id = a.id % 50) SELECT truth, count(*) AS total, count(*) FILTER (NOT ok) AS wrong FROM r GROUP BY truth")
def validation_mismap(v: Views) -> DataFrame:
    truth = v.bases.select(F.col("id").alias("truth"), F.col("seq").alias("whole"))
    rows = v.bases.withColumn("truth", F.col("id") % 50).join(truth, "truth")
    return rows.groupBy("truth").agg(F.count("*").alias("total"), F.count_if(~F.contains("whole", "seq")).alias("wrong"))


def _placed(v: Views) -> DataFrame:
    """Whole sequences as reads, of odd ids turned, placed on whole sequences as paths."""
    turned = F.when(F.col("id") % 2 == 1, sequence.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return alignment.gapless(v.bases.select("id", turned.alias("seq")), v.bases.select(F.col("id").alias("path"), "seq"), seed=10)


_PLACED = """r AS (SELECT id, CASE WHEN id % 2 = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq FROM bases),
s AS (SELECT id, seq, false AS turned FROM r UNION ALL SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')), true FROM r),
x AS (SELECT path, pos, substring(seq, pos + 1, 10) AS kmer FROM (SELECT id AS path, seq, unnest(range(0, length(seq) - 9)) AS pos FROM bases)),
u AS (SELECT kmer, min(path) AS path, min(pos) AS at0 FROM x WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY kmer HAVING count(*) = 1),
w AS (SELECT id, turned, seq, pos, substring(seq, pos + 1, 10) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - 9)) AS pos FROM s)),
h AS (SELECT DISTINCT w.id, w.turned, w.seq, u.path, u.at0 - w.pos AS start FROM w JOIN u USING (kmer) WHERE u.at0 >= w.pos),
m AS (SELECT h.id, h.turned, h.path, h.start, CAST(list_sum([CASE WHEN substring(h.seq, i, 1) <> substring(b.seq, CAST(h.start + i AS BIGINT), 1) THEN 1 ELSE 0 END FOR i IN range(1, length(h.seq) + 1)]) AS BIGINT) AS mismatches
  FROM h JOIN bases b ON b.id = h.path WHERE h.start + length(h.seq) <= length(b.seq)),
k AS (SELECT * FROM m WHERE mismatches <= 2 QUALIFY mismatches = min(mismatches) OVER (PARTITION BY id)),
n AS (SELECT id, CASE WHEN count(DISTINCT CAST(path AS VARCHAR) || ':' || CAST(start AS VARCHAR)) = 1 THEN 'MAPPED' ELSE 'BAD_ALIGN' END AS status FROM k GROUP BY id)"""


@query(f"WITH {_PLACED} SELECT k.id AS read, path, start, turned AS reverse, mismatches, status FROM k JOIN n ON n.id = k.id")
def gapless_placement(v: Views) -> DataFrame:
    return _placed(v).select(F.col("id").alias("read"), "path", F.col("start").cast("long").alias("start"), "reverse", F.col("mismatches").cast("long").alias("mismatches"), "status")


@query(f"""WITH {_PLACED}, f AS (SELECT k.id, min(status) AS status, bool_or(path = k.id AND start = 0 AND turned = (k.id % 2 = 1)) AS ok FROM k JOIN n ON n.id = k.id GROUP BY k.id)
SELECT bases.id % 50 AS truth, count(*) AS total, count(*) FILTER (status = 'MAPPED') AS mapped, count(*) FILTER (status = 'BAD_ALIGN') AS bad_align, count(*) FILTER (status IS NULL) AS unplaced,
  count(*) FILTER (status = 'MAPPED' AND NOT ok) AS wrong FROM bases LEFT JOIN f ON f.id = bases.id GROUP BY 1""")
def gapless_validation(v: Views) -> DataFrame:
    """Each read's true place is all of its own path, reverse if its id is odd; reads without a place are counted too."""
    true = (F.col("path") == F.col("id")) & (F.col("start") == 0) & (F.col("reverse") == (F.col("id") % 2 == 1))
    found = _placed(v).groupBy("id").agg(F.first("status").alias("status"), F.bool_or(true).alias("ok"))
    rows = v.bases.select("id").join(shuffled(found), "id", "left")
    mapped = F.coalesce(F.col("status") == "MAPPED", F.lit(False))
    return rows.groupBy((F.col("id") % 50).alias("truth")).agg(
        F.count("*").alias("total"), F.count_if(mapped).alias("mapped"), F.count_if(F.coalesce(F.col("status") == "BAD_ALIGN", F.lit(False))).alias("bad_align"),
        F.count_if(F.col("status").isNull()).alias("unplaced"), F.count_if(mapped & ~F.col("ok")).alias("wrong"),
    )


# Graphs.


def _nodes(v: Views) -> DataFrame:
    return v.table("nation").select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("node"))


_N = "n AS (SELECT n_regionkey AS graph_id, n_nationkey AS node FROM nation)"


@query(f"WITH {_N} SELECT graph_id, node, 'source' AS role FROM n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.b = n.node) UNION ALL SELECT graph_id, node, 'sink' FROM n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.a = n.node)")
def source_sink_nodes(v: Views) -> DataFrame:
    return graphs.source_sink(_nodes(v), v.edges, ["graph_id"])


@query(f"WITH {_N} SELECT DISTINCT graph_id, a, b FROM edges e WHERE a = b OR NOT EXISTS (SELECT 1 FROM n WHERE n.graph_id = e.graph_id AND n.node = a) OR NOT EXISTS (SELECT 1 FROM n WHERE n.graph_id = e.graph_id AND n.node = b)")
def graph_dangling_edges(v: Views) -> DataFrame:
    return graphs.dangling(_nodes(v), v.edges, ["graph_id"])


@query("SELECT graph_id, a AS node FROM edges INTERSECT SELECT graph_id, b FROM edges")
def label_intersect(v: Views) -> DataFrame:
    return v.edges.select("graph_id", F.col("a").alias("node")).intersect(v.edges.select("graph_id", F.col("b").alias("node")))


@query("""WITH s AS (SELECT site, [x FOR x IN ['A', 'B', 'C'] IF (x = 'A' AND site % 2 = 0) OR (x = 'B' AND site % 3 = 0) OR x = 'C'] AS i, [x FOR x IN ['A', 'B', 'D'] IF (x = 'A' AND site % 5 < 3) OR (x = 'B' AND site % 3 < 2) OR x = 'D'] AS o FROM (SELECT DISTINCT site FROM counts))
SELECT site, array_to_string(list_sort(list_distinct(list_intersect(i, o) || [x FOR x IN i IF NOT list_contains(['A', 'D'], x)] || [x FOR x IN o IF NOT list_contains(['A', 'C'], x)])), ',') AS labels FROM s""")
def label_algebra(v: Views) -> DataFrame:
    s = F.col("site")
    pick = lambda *rules: F.array_compact(F.array(*[F.when(r, F.lit(x)) for x, r in rules]))
    into = pick(("A", s % 2 == 0), ("B", s % 3 == 0), ("C", F.lit(True)))
    out = pick(("A", s % 5 < 3), ("B", s % 3 < 2), ("D", F.lit(True)))
    labels = graphs.label_algebra(into, out, F.array(F.lit("A"), F.lit("C")), F.array(F.lit("A"), F.lit("D")))
    return v.counts.select("site").distinct().select("site", F.array_join(labels, ",").alias("labels"))


@query("SELECT graph_id, a, b FROM edges UNION SELECT graph_id, b AS a, a AS b FROM edges WHERE label = 'ALT'")
def graph_union(v: Views) -> DataFrame:
    back = v.edges.where("label = 'ALT'").select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))
    return v.edges.select("graph_id", "a", "b").unionByName(back).distinct()


def _chain_nodes(v: Views) -> DataFrame:
    return v.chain.select("graph_id", F.col("a").alias("node")).unionByName(v.chain.select("graph_id", F.col("b").alias("node"))).distinct()


@query(f"""WITH d AS (SELECT * FROM chain), o AS (SELECT graph_id, a FROM d GROUP BY 1, 2 HAVING count(*) = 1), i AS (SELECT graph_id, b FROM d GROUP BY 1, 2 HAVING count(*) = 1)
SELECT d.graph_id, d.a, d.b FROM d JOIN o ON o.graph_id = d.graph_id AND o.a = d.a JOIN i ON i.graph_id = d.graph_id AND i.b = d.b""")
def combine_nodes(v: Views) -> DataFrame:
    return graphs.combinable(v.chain, ["graph_id"]).select("graph_id", "a", "b")


@query(f"""WITH RECURSIVE d AS (SELECT * FROM chain), w AS (SELECT DISTINCT graph_id, a AS node, 0 AS level FROM d UNION SELECT DISTINCT graph_id, b, 0 FROM d UNION SELECT w.graph_id, d.b, w.level + 1 FROM w JOIN d ON d.graph_id = w.graph_id AND d.a = w.node)
SELECT graph_id, node, max(level) AS level FROM w GROUP BY 1, 2""")
def topological_levels(v: Views) -> DataFrame:
    return graphs.levels(v.chain, ["graph_id"])


@query(f"""WITH RECURSIVE d AS (SELECT * FROM chain), s AS (SELECT DISTINCT graph_id, a FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.graph_id = d.graph_id AND x.b = d.a)),
p AS (SELECT graph_id, CAST(a AS STRING) AS path, a AS last FROM s UNION ALL SELECT p.graph_id, p.path || '-' || CAST(d.b AS STRING), d.b FROM p JOIN d ON d.graph_id = p.graph_id AND d.a = p.last)
SELECT graph_id, path FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.graph_id = p.graph_id AND d.a = p.last)""")
def enumerate_paths(v: Views) -> DataFrame:
    return v.spark.sql(
        """
WITH RECURSIVE s AS (SELECT DISTINCT graph_id, a FROM {d} d WHERE NOT EXISTS (SELECT 1 FROM {d} x WHERE x.graph_id = d.graph_id AND x.b = d.a)),
p AS (SELECT graph_id, CAST(a AS STRING) AS path, a AS last FROM s
  UNION ALL SELECT p.graph_id, p.path || '-' || CAST(d.b AS STRING), d.b FROM p JOIN {d} d ON d.graph_id = p.graph_id AND d.a = p.last)
SELECT p.graph_id, p.path FROM p LEFT ANTI JOIN {d} d ON d.graph_id = p.graph_id AND d.a = p.last""",
        d=v.chain,
    )


@query(f"""WITH l AS (SELECT graph_id, a, b, unnest(['L' || CAST(a % 3 AS STRING), 'ALL']) AS label FROM chain), n AS (SELECT graph_id, b AS node, label FROM l INTERSECT SELECT graph_id, a, label FROM l)
SELECT graph_id, label, CAST(sum(10 + node) AS BIGINT) AS length, count(*) AS nodes FROM n GROUP BY 1, 2""")
def allele_lengths(v: Views) -> DataFrame:
    label = F.explode(F.array(F.concat(F.lit("L"), (F.col("a") % 3).cast("string")), F.lit("ALL")))
    edges = v.chain.withColumn("label", label)
    lengths = _chain_nodes(v).withColumn("length", 10 + F.col("node"))
    return graphs.allele_lengths(edges, lengths, ["graph_id"])


@query(f"""WITH l AS (SELECT graph_id, a, b, ['L' || CAST(a % 2 AS STRING), 'X'] AS labels FROM chain), i AS (SELECT graph_id, b AS mid, a, labels FROM l WHERE b % 5 = 0), o AS (SELECT graph_id, a AS mid, b, labels FROM l WHERE a % 5 = 0),
ai AS (SELECT graph_id, mid, list(DISTINCT x) AS s FROM (SELECT *, unnest(labels) AS x FROM i) GROUP BY 1, 2), ao AS (SELECT graph_id, mid, list(DISTINCT x) AS s FROM (SELECT *, unnest(labels) AS x FROM o) GROUP BY 1, 2),
j AS (SELECT i.graph_id, i.a, o.b, list_intersect(i.labels, o.labels) || [x FOR x IN i.labels IF NOT list_contains(ao.s, x)] || [x FOR x IN o.labels IF NOT list_contains(ai.s, x)] AS labels FROM i JOIN o ON o.graph_id = i.graph_id AND o.mid = i.mid JOIN ai ON ai.graph_id = i.graph_id AND ai.mid = i.mid JOIN ao ON ao.graph_id = i.graph_id AND ao.mid = i.mid),
u AS (SELECT graph_id, a, b, unnest(labels) AS x FROM (SELECT * FROM j UNION ALL SELECT * FROM l WHERE a % 5 <> 0 AND b % 5 <> 0))
SELECT graph_id, a, b, string_agg(DISTINCT x, ',' ORDER BY x) AS labels FROM u GROUP BY 1, 2, 3""")
def remove_empty_nodes(v: Views) -> DataFrame:
    edges = v.chain.withColumn("labels", F.array(F.concat(F.lit("L"), (F.col("a") % 2).cast("string")), F.lit("X")))
    gone = _chain_nodes(v).where("node % 5 = 0")  # the nodes that hold no bases
    return graphs.without_nodes(edges, gone, ["graph_id"]).withColumn("labels", F.array_join("labels", ","))


@query("SELECT x.chrom, x.id AS a, y.id AS b FROM intervals x JOIN intervals y ON x.chrom = y.chrom AND x.stop + 1 = y.start")
def adjacent_node_edges(v: Views) -> DataFrame:
    return graphs.adjacent_edges(v.intervals, ["chrom"])


@query("SELECT id, '' AS part, start, stop FROM intervals WHERE stop - start + 1 <= 20 UNION ALL SELECT id, 'left', start, start + 4 FROM intervals WHERE stop - start + 1 > 20 UNION ALL SELECT id, 'right', stop - 4, stop FROM intervals WHERE stop - start + 1 > 20")
def split_long_nodes(v: Views) -> DataFrame:
    return graphs.split_long(v.intervals.select("id", "start", "stop"), 20, 5).select("id", "part", "start", "stop")


@query("""WITH c AS (SELECT id, start + o AS p, stop FROM intervals, (VALUES (3), (9)) t(o) WHERE start + o <= stop UNION SELECT id, start, stop FROM intervals)
SELECT id, p AS start, coalesce(lead(p) OVER (PARTITION BY id ORDER BY p) - 1, stop) AS stop FROM c""")
def split_node(v: Views) -> DataFrame:
    cuts = v.intervals.select("id", F.explode(F.array(F.lit(3), F.lit(9))).alias("offset"))
    return graphs.split_at(v.intervals.select("id", "start", "stop"), cuts)


_EVENT = "e AS (SELECT o_orderkey AS id, o_orderkey % 500 + 200 AS start, o_orderkey % 500 + 200 + o_custkey % 60 - 1 AS stop, CASE WHEN o_orderkey % 3 = 0 THEN 'ACGT' END AS ins FROM orders)"
_KIND = "CASE WHEN ins IS NOT NULL AND stop < start THEN 'ins' WHEN stop - start + 1 <= 40 THEN CASE WHEN ins IS NOT NULL THEN 'swap' ELSE 'del' END WHEN ins IS NOT NULL THEN 'longswap' ELSE 'longdel' END"


def _events(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    rows = v.table("orders").select(k.alias("id"), (k % 500 + 200).alias("start"), (k % 500 + 200 + F.col("o_custkey") % 60 - 1).alias("stop"), F.when(k % 3 == 0, F.lit("ACGT")).alias("ins"))
    return rows.withColumn("kind", graphs.event_type(F.col("start"), F.col("stop"), F.col("ins"), F.lit(20)))


@query(f"WITH {_EVENT} SELECT id, {_KIND} AS kind FROM e")
def event_type(v: Views) -> DataFrame:
    return _events(v).select("id", "kind")


@query(f"""WITH {_EVENT}, k AS (SELECT id, {_KIND} AS kind FROM e), t AS (SELECT * FROM (VALUES ('del', ['LF_MID', 'MID_RF', 'LF_RF']), ('swap', ['LF_RF', 'LF_MID', 'MID_RF', 'LF_INS', 'INS_RF']), ('ins', ['LF_INS', 'INS_RF', 'LF_RF']), ('longdel', ['LF_MID_L', 'MID_R_RF', 'LF_RF']), ('longswap', ['LF_RF', 'LF_MID_L', 'MID_R_RF', 'LF_INS', 'INS_RF'])) x(kind, edges))
SELECT id, kind, unnest(edges) AS edge FROM k JOIN t USING (kind)""")
def event_graph_edges(v: Views) -> DataFrame:
    return _events(v).select("id", "kind", F.explode(graphs.template_edges(F.col("kind"))).alias("edge"))


@query(f"WITH {_EVENT} SELECT id, coalesce(length(ins), 0) AS ins_len, greatest(stop - start + 1, 0) AS del_len, greatest(coalesce(length(ins), 0), stop - start + 1) AS len, row_number() OVER (ORDER BY id) - 1 AS n_ev FROM e WHERE greatest(coalesce(length(ins), 0), stop - start + 1) >= 30 ORDER BY id LIMIT 500")
def event_lengths(v: Views) -> DataFrame:
    # The limit is the feature: the first events of sufficient length.
    size = F.col("stop") - F.col("start") + 1
    ins = F.coalesce(F.char_length("ins"), F.lit(0)).cast("long")
    rows = _events(v).select("id", ins.alias("ins_len"), F.greatest(size, F.lit(0)).alias("del_len"), F.greatest(ins, size).alias("len"))
    rows = rows.where("len >= 30").orderBy("id").limit(500)
    return rows.withColumn("n_ev", F.row_number().over(Window.orderBy("id")) - 1)


@query("SELECT id % 50 AS path, string_agg(seq, '' ORDER BY id) AS seq, CAST(count(*) AS INT) AS n_nodes FROM bases GROUP BY 1")
def path_fasta(v: Views) -> DataFrame:
    nodes = v.bases.select(F.col("id").alias("node"), "seq")
    paths = v.bases.select((F.col("id") % 50).alias("path"), F.col("id").alias("place"), F.col("id").alias("node"))
    return graphs.path_sequences(paths, nodes, [])


@query("""SELECT id, '  "' || CAST(id AS STRING) || '" [label="' || CASE WHEN length(seq) > 30 THEN substring(seq, 1, 14) || '...' || right(seq, 14) ELSE seq END || '"];' AS line FROM bases""")
def dot_export(v: Views) -> DataFrame:
    return v.bases.select("id", F.concat(F.lit('  "'), F.col("id").cast("string"), F.lit('" [label="'), graphs.short_label(F.col("seq")), F.lit('"];')).alias("line"))


@query("SELECT o.site, o.pos, b.id AS node, substring(b.seq, CAST(1 + o.pos % 10 AS BIGINT), 5) AS seq FROM (SELECT DISTINCT site, pos FROM observations) o JOIN bases b ON b.id = o.site")
def node_sequence_lookup(v: Views) -> DataFrame:
    rows = v.observations.select("site", "pos").distinct().join(v.bases.select(F.col("id").alias("site"), "seq"), "site")
    return rows.select("site", "pos", F.col("site").alias("node"), F.substring(F.col("seq"), (1 + F.col("pos") % 10).cast("int"), F.lit(5)).alias("seq"))


@query("""WITH f AS (SELECT sample_id, site, fragment_id, list(DISTINCT element) AS els FROM observations GROUP BY 1, 2, 3)
SELECT sample_id, site, fragment_id, list_has_all(['LF_ALT', 'LF_INS'], els) AS in_alt, list_has_all(['REF_RF'], els) AS in_ref FROM f""")
def path_family_contains(v: Views) -> DataFrame:
    rows = v.observations.groupBy("sample_id", "site", "fragment_id").agg(F.collect_set("element").alias("els"))
    inside = lambda *edges: F.forall("els", lambda e: e.isin(*edges))
    return rows.select("sample_id", "site", "fragment_id", inside("LF_ALT", "LF_INS").alias("in_alt"), inside("REF_RF").alias("in_ref"))


# Variants.


@query("SELECT sample_id, site, bp, n_alt, round(n_alt / (n_ref + n_alt), 6) AS fraction FROM counts WHERE n_alt >= 3 AND n_alt / (n_ref + n_alt) >= 0.4")
def variant_min_support(v: Views) -> DataFrame:
    share = F.col("n_alt") / (F.col("n_ref") + F.col("n_alt"))
    return v.counts.where((F.col("n_alt") >= 3) & (share >= 0.4)).select("sample_id", "site", "bp", "n_alt", F.round(share, 6).alias("fraction"))


_PRE = "CAST(coalesce(list_max([k FOR k IN range(0, least(length({a}), length({b})) + 1) IF substring({a}, 1, k) = substring({b}, 1, k)]), 0) AS INT)"


@query(f"""WITH s AS (SELECT id, pos, ref, alt, {_PRE.format(a='reverse(ref)', b='reverse(alt)')} AS tail FROM variants), t AS (SELECT id, pos, substring(ref, 1, length(ref) - tail) AS r, substring(alt, 1, length(alt) - tail) AS a FROM s),
h AS (SELECT *, {_PRE.format(a='r', b='a')} AS head FROM t) SELECT id, pos + head AS pos, substring(r, head + 1) AS ref, substring(a, head + 1) AS alt FROM h""")
def trim_alleles(v: Views) -> DataFrame:
    cut = alleles.trimmed(F.col("pos"), F.col("ref"), F.col("alt"))
    return v.variants.select("id", cut.alias("t")).select("id", "t.pos", "t.ref", "t.alt")


@query(f"""WITH s AS (SELECT id, pos, ref, alt, least({_PRE.format(a='reverse(ref)', b='reverse(alt)')}, least(length(ref), length(alt)) - 1) AS tail FROM variants), t AS (SELECT id, pos, substring(ref, 1, length(ref) - tail) AS r, substring(alt, 1, length(alt) - tail) AS a FROM s),
h AS (SELECT *, least({_PRE.format(a='r', b='a')}, least(length(r), length(a)) - 1) AS head FROM t) SELECT id, pos + head AS pos, substring(r, head + 1) AS ref, substring(a, head + 1) AS alt FROM h""")
def trim_vcf_alleles(v: Views) -> DataFrame:
    cut = alleles.trimmed(F.col("pos"), F.col("ref"), F.col("alt"), keep=1)
    return v.variants.select("id", cut.alias("t")).select("id", "t.pos", "t.ref", "t.alt")


@query("SELECT id, substring(seq, 1, 4) || 'TTG' || substring(seq, 5 + id % 5) AS seq FROM bases")
def apply_variant(v: Views) -> DataFrame:
    return v.bases.select("id", alleles.applied(F.col("seq"), F.lit(4), (3 + F.col("id") % 5).cast("int"), F.lit("TTG")).alias("seq"))


@query("""WITH t AS (SELECT id, pos, ref, alt, unnest(range(1, least(length(ref), length(alt)) + 1)) AS i FROM variants)
SELECT id, pos + i - 1 AS pos, substring(ref, i, 1) AS ref, substring(alt, i, 1) AS alt, (substring(ref, i, 1) || substring(alt, i, 1)) IN ('AG', 'GA', 'CT', 'TC') AS transition FROM t WHERE substring(ref, i, 1) <> substring(alt, i, 1)""")
def primitives(v: Views) -> DataFrame:
    rows = v.variants.select("id", "pos", F.explode(alleles.substitutions(F.col("ref"), F.col("alt"))).alias("s"))
    return rows.select("id", (F.col("pos") + F.col("s.offset")).alias("pos"), "s.ref", "s.alt", alleles.is_transition(F.col("s.ref"), F.col("s.alt")).alias("transition"))


@query("SELECT id, CASE WHEN id % 17 = 0 THEN 'symbolic' WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snp' WHEN length(ref) = length(alt) THEN 'mnp' WHEN length(ref) > length(alt) THEN 'deletion' ELSE 'insertion' END AS kind FROM variants")
def classify_variant(v: Views) -> DataFrame:
    alt = F.when(F.col("id") % 17 == 0, F.lit("<DEL>")).otherwise(F.col("alt"))
    return v.variants.select("id", alleles.variant_class(F.col("ref"), alt).alias("kind"))


@query("SELECT id, unnest([1, 2]) AS n, unnest([alt, alt || 'A']) AS alt FROM variants")
def split_multiallelic(v: Views) -> DataFrame:
    rows = v.variants.select("id", F.posexplode(F.array(F.col("alt"), F.concat("alt", F.lit("A")))).alias("k", "alt"))
    return rows.select("id", (F.col("k") + 1).alias("n"), "alt")


@query("SELECT id, 'v' || CAST(id AS STRING) || ':' || CAST(unnest([0, 1]) AS STRING) AS allele_id, unnest([ref, alt]) AS bases FROM variants")
def allele_ids(v: Views) -> DataFrame:
    rows = v.variants.select("id", F.posexplode(F.array("ref", "alt")).alias("k", "bases"))
    return rows.select("id", F.concat(F.lit("v"), F.col("id").cast("string"), F.lit(":"), F.col("k").cast("string")).alias("allele_id"), "bases")


@query("SELECT id, 'c' || CAST(chrom AS STRING) || ':' || CAST(pos AS STRING) || '-' || CAST(row_number() OVER (PARTITION BY chrom, pos ORDER BY id) AS STRING) AS variant_id FROM variants")
def variant_ids(v: Views) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("id"))
    return v.variants.select("id", F.concat(F.lit("c"), F.col("chrom").cast("string"), F.lit(":"), F.col("pos").cast("string"), F.lit("-"), n.cast("string")).alias("variant_id"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN seq || 'ACGT' WHEN 2 THEN seq || seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END AS bases FROM bases")
def symbolic_alleles(v: Views) -> DataFrame:
    kind = F.element_at(F.array(F.lit("<DEL>"), F.lit("<INS>"), F.lit("<DUP>"), F.lit("<INV>")), (F.col("id") % 4 + 1).cast("int"))
    return v.bases.select("id", alleles.symbolic_allele(kind, F.col("seq"), F.lit("ACGT")).alias("bases"))


_SHIFT = """s AS (SELECT id, seq, id % 7 + 6 AS at0, id % 7 + 6 - CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS end0, CASE WHEN id % 2 = 0 THEN substring(seq, 5, 2) ELSE '' END AS alt FROM bases),
w AS (SELECT * FROM s UNION ALL SELECT id, seq, at0 - 1, end0 - 1, CASE WHEN alt <> '' THEN substring(seq, at0, 1) || substring(alt, 1, length(alt) - 1) ELSE '' END FROM w
  WHERE (end0 >= at0) <> (alt <> '') AND at0 > 0 AND substring(seq, at0, 1) <> 'N' AND substring(seq, at0, 1) = CASE WHEN alt <> '' THEN right(alt, 1) ELSE substring(seq, end0 + 1, 1) END)"""


@query(f"WITH RECURSIVE {_SHIFT} SELECT id, CAST(min(at0) AS BIGINT) AS start, CAST(min(end0) AS BIGINT) AS \"end\", arg_min(alt, at0) AS alt FROM w GROUP BY id")
def left_shift(v: Views) -> DataFrame:
    rows = v.bases.select("id", "seq", (F.col("id") % 7 + 6).alias("start"), (F.col("id") % 7 + 6 - F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("end"), F.when(F.col("id") % 2 == 0, F.substring("seq", 5, 2)).otherwise("").alias("alt"))
    return alleles.left_shifted(rows)


#: Contigs in which every second row is a repeat of its first two bases, and in each row a deletion of two bases or an insertion of the two before.
_REPEATS = """o AS (SELECT id, id // 40 AS contig, id % 40 AS k, CASE WHEN id % 2 = 0 THEN repeat(substring(seq, 2, 2), 9) ELSE seq END AS seq FROM bases), c AS (SELECT contig, string_agg(seq, '' ORDER BY k) AS whole FROM o GROUP BY contig),
u AS (SELECT o.id, o.contig, whole, CAST(sum(length(o.seq)) OVER (PARTITION BY o.contig ORDER BY o.k) - 6 AS BIGINT) AS at0 FROM o JOIN c USING (contig)),
s AS (SELECT id, contig, whole, at0, at0 + CASE WHEN id % 4 < 2 THEN 1 ELSE -1 END AS end0, CASE WHEN id % 4 < 2 THEN '' ELSE substring(whole, at0 - 1, 2) END AS alt FROM u)"""
_LEFT = """w AS (SELECT * FROM s UNION ALL SELECT id, contig, whole, at0 - 1, end0 - 1, CASE WHEN alt <> '' THEN substring(whole, at0, 1) || substring(alt, 1, length(alt) - 1) ELSE '' END FROM w
  WHERE at0 > 0 AND substring(whole, at0, 1) <> 'N' AND substring(whole, at0, 1) = CASE WHEN alt <> '' THEN right(alt, 1) ELSE substring(whole, end0 + 1, 1) END)"""
_RIGHT = """w AS (SELECT * FROM s UNION ALL SELECT id, contig, whole, at0 + 1, end0 + 1, CASE WHEN alt <> '' THEN substring(alt, 2) || substring(whole, end0 + 2, 1) ELSE '' END FROM w
  WHERE end0 + 1 < length(whole) AND substring(whole, end0 + 2, 1) <> 'N' AND substring(whole, end0 + 2, 1) = CASE WHEN alt <> '' THEN left(alt, 1) ELSE substring(whole, at0 + 1, 1) END)"""


def _repeats(v: Views, right: bool) -> DataFrame:
    rows = v.bases.select("id", F.expr("id div 40").alias("contig"), (F.col("id") % 40).alias("k"), F.when(F.col("id") % 2 == 0, F.repeat(F.substring("seq", 2, 2), 9)).otherwise(F.col("seq")).alias("seq"))
    upto = F.sum(F.char_length("seq")).over(Window.partitionBy("contig").orderBy("k")) - 6
    # Forty rows make a contig, so the window sees forty rows.
    placed = rows.withColumn("start", upto).join(_joined(rows).withColumnRenamed("seq", "whole"), "contig")
    gone = F.col("id") % 4 < 2
    made = placed.select("id", "contig", "start", (F.col("start") + F.when(gone, 1).otherwise(-1)).alias("end"), F.when(gone, "").otherwise(F.substring(F.col("whole"), (F.col("start") - 1).cast("int"), F.lit(2))).alias("alt"))
    return alleles.shifted(made, files.chunked(_joined(rows), 64), 64, right=right, window=8)


@query(f"WITH RECURSIVE {_REPEATS}, {_LEFT} SELECT id, contig, min(at0) AS start, min(end0) AS \"end\", arg_min(alt, at0) AS alt FROM w GROUP BY id, contig")
def left_shift_in_chunks(v: Views) -> DataFrame:
    return _repeats(v, False)


@query(f"WITH RECURSIVE {_REPEATS}, {_RIGHT} SELECT id, contig, max(at0) AS start, max(end0) AS \"end\", arg_max(alt, at0) AS alt FROM w GROUP BY id, contig")
def right_shift_in_chunks(v: Views) -> DataFrame:
    return _repeats(v, True)


@query(f"""WITH {_CONTIGS}, c AS (SELECT contig, string_agg(seq, '' ORDER BY k) AS whole FROM o GROUP BY contig),
x AS (SELECT id, o.contig, k * 20 + id % 5 AS at0, k * 20 + id % 5 + id % 4 - 1 AS end0, CASE WHEN id % 3 = 0 AND id % 4 > 0 THEN '' ELSE 'GA' END AS alt, whole FROM o JOIN c USING (contig)), y AS (SELECT * FROM x WHERE end0 + 2 < length(whole)),
s AS (SELECT id // 4 AS site, contig, whole, min(greatest(least(at0, end0), 0)) AS first, max(end0) AS last FROM y GROUP BY 1, 2, 3),
t AS (SELECT s.site, s.contig, s.first, y.id, substring(s.whole, CAST(first + 1 AS BIGINT), CAST(at0 - first AS BIGINT)) || alt || substring(s.whole, CAST(greatest(end0 + 1, at0) + 1 AS BIGINT), CAST(last - greatest(end0 + 1, at0) + 1 AS BIGINT)) AS text, substring(s.whole, CAST(first + 1 AS BIGINT), CAST(last - first + 1 AS BIGINT)) AS ref FROM s JOIN y ON y.id // 4 = s.site)
SELECT site, contig, CAST(first AS BIGINT) AS first, any_value(ref) || '|' || string_agg(CASE WHEN text = '' THEN '<DEL>' ELSE text END, '|' ORDER BY id) AS alleles FROM t GROUP BY site, contig, first""")
def site_alleles(v: Views) -> DataFrame:
    """Four variants a site, on every contig."""
    rows = _contigs(v)
    start, i = F.col("k") * 20 + F.col("id") % 5, F.col("id")
    made = rows.select("contig", i.alias("number"), F.expr("id div 4").alias("site"), start.alias("start"), (start + i % 4 - 1).alias("end"), F.when((i % 3 == 0) & (i % 4 > 0), "").otherwise("GA").alias("alt"))
    whole = _joined(rows)
    made = made.join(whole.select("contig", F.char_length("seq").alias("n")), "contig").where("end + 2 < n").drop("n")
    found = alleles.site_alleles(made, files.chunked(whole, 100), 100, ["site"])
    return found.select("site", "contig", "first", F.array_join("alleles", "|").alias("alleles"))


# Graphs from variants: deletions, insertions and replacements of a block.

BLOCKS = "s AS (SELECT id % 60 AS block, id, pos AS start, pos + CASE WHEN id % 3 = 1 THEN -1 ELSE length(ref) - 1 END AS stop, CASE WHEN id % 3 = 0 THEN '' ELSE alt END AS alt FROM variants)"
REFS = """e AS (SELECT block, start AS at0 FROM s UNION SELECT block, stop + 1 FROM s UNION SELECT block, greatest(min(start) - 150, 0) FROM s GROUP BY 1 UNION SELECT block, max(stop) + 151 FROM s GROUP BY 1),
r AS (SELECT block, at0 AS start, lead(at0) OVER (PARTITION BY block ORDER BY at0) - 1 AS stop FROM e),
n AS (SELECT block, 'ref' AS kind, start, stop, CAST(NULL AS STRING) AS seq, 'ref-' || CAST(start AS STRING) || '-' || CAST(stop AS STRING) AS name FROM r WHERE stop IS NOT NULL
  UNION ALL SELECT DISTINCT block, 'alt', start, stop, alt, CAST(start AS STRING) || '-' || CAST(stop AS STRING) || ':' || alt FROM s WHERE alt <> '')"""


def _blocks(v: Views) -> DataFrame:
    stop = F.col("pos") + F.when(F.col("id") % 3 == 1, F.lit(-1)).otherwise(F.char_length("ref") - 1)
    return v.variants.select((F.col("id") % 60).alias("block"), "id", F.col("pos").alias("start"), stop.alias("stop"), F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("alt")).alias("alt"))


@query(f"WITH {BLOCKS}, {REFS} SELECT block, kind, name, start, stop, seq FROM n")
def variant_graph_nodes(v: Views) -> DataFrame:
    return building.graph_nodes(_blocks(v), ["block"])


@query(f"""WITH {BLOCKS}, {REFS}, l AS (SELECT block, name AS a, stop + 1 AS p FROM n WHERE kind = 'ref'), q AS (SELECT block, name AS b, start AS p FROM n WHERE kind = 'ref')
SELECT l.block, a, b, 'REF' AS label FROM l JOIN q USING (block, p)
UNION SELECT n.block, l.a, n.name, 'ALT' FROM n JOIN l ON l.block = n.block AND l.p = n.start WHERE kind = 'alt'
UNION SELECT n.block, n.name, q.b, 'ALT' FROM n JOIN q ON q.block = n.block AND q.p = n.stop + 1 WHERE kind = 'alt'
UNION SELECT s.block, l.a, q.b, 'ALT' FROM s JOIN l ON l.block = s.block AND l.p = s.start JOIN q ON q.block = s.block AND q.p = s.stop + 1 WHERE s.alt = '' AND s.stop >= s.start""")
def variant_graph_edges(v: Views) -> DataFrame:
    rows = _blocks(v)
    return building.graph_edges(building.graph_nodes(rows, ["block"]), rows, ["block"])


_GAPPED = """c AS (SELECT id, k, substring(ref, k, 1) AS r, substring(alt, k, 1) AS a FROM (SELECT *, unnest(range(1, length(ref) + 1)) AS k FROM g)),
b AS (SELECT *, coalesce(sum(CASE WHEN r <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, sum(CASE WHEN r = a THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS same FROM c)
SELECT id, CAST(min(base) AS BIGINT) AS start, CAST(min(base) + length(replace(string_agg(r, '' ORDER BY k), '-', '')) - 1 AS BIGINT) AS stop, replace(string_agg(r, '' ORDER BY k), '-', '') AS ref, replace(string_agg(a, '' ORDER BY k), '-', '') AS alt
FROM b WHERE r <> a GROUP BY id, same"""


@query(f"WITH g AS (SELECT id, seq || '--' AS ref, '--' || replace(seq, 'A', '-') AS alt FROM bases), {_GAPPED}")
def gapped_differences(v: Views) -> DataFrame:
    return alleles.gapped_differences(v.bases.select("id", F.concat("seq", F.lit("--")).alias("ref"), F.concat(F.lit("--"), F.replace("seq", F.lit("A"), F.lit("-"))).alias("alt")))


@query(f"WITH g AS (SELECT id, replace(seq, 'C', '-') AS ref, replace(reverse(seq), 'A', '-') AS alt FROM bases), {_GAPPED}")
def whole_gapped_differences(v: Views) -> DataFrame:
    return alleles.gapped_differences(v.bases.select("id", F.replace("seq", F.lit("C"), F.lit("-")).alias("ref"), F.replace(F.reverse("seq"), F.lit("A"), F.lit("-")).alias("alt")))


@query(None)
def global_alignment(v: Views) -> DataFrame:
    return alignment.global_alignments(dealt(v.variants.select("id", "ref", "alt"))).select("id", "score", "gapped_ref", "gapped_alt")


@query(None)
def realign_primitives(v: Views) -> DataFrame:
    return alleles.realigned(v.variants)


@query("""WITH p AS (SELECT id, unnest(range(1, least(length(ref), length(alt)) + 1)) AS i, ref, alt FROM variants), s AS (SELECT id, substring(ref, i, 1) AS r, substring(alt, i, 1) AS a FROM p)
SELECT id % 20 AS batch, count(*) FILTER ((r || a) IN ('AG', 'GA', 'CT', 'TC')) AS transitions, count(*) FILTER ((r || a) NOT IN ('AG', 'GA', 'CT', 'TC')) AS transversions FROM s WHERE r <> a GROUP BY 1""")
def transition_counts(v: Views) -> DataFrame:
    rows = v.variants.select((F.col("id") % 20).alias("batch"), F.explode(alleles.substitutions(F.col("ref"), F.col("alt"))).alias("s"))
    return alleles.substitution_counts(rows.select("batch", "s.ref", "s.alt"), ["batch"])


# Paths of reads: each lies on a run of consecutive nodes of its site's graph.

_PATHS = "r AS (SELECT DISTINCT l_orderkey AS fragment_id, l_partkey % 12 AS first, l_partkey % 12 + l_linenumber % 4 AS last FROM lineitem)"


def _fragment_paths(v: Views) -> DataFrame:
    first = F.col("l_partkey") % 12
    reads = v.table("lineitem").select(F.col("l_orderkey").alias("fragment_id"), F.sequence(first, first + F.col("l_linenumber") % 4).alias("path"))
    return haplotypes.fragment_paths(reads, ["fragment_id"])


@query(f"""WITH {_PATHS}, b AS (SELECT *, max(last) OVER (PARTITION BY fragment_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r),
g AS (SELECT *, sum(CASE WHEN seen >= first THEN 0 ELSE 1 END) OVER (PARTITION BY fragment_id ORDER BY first, last) AS n FROM b), m AS (SELECT fragment_id, min(first) AS first, max(last) AS last FROM g GROUP BY fragment_id, n)
SELECT fragment_id, array_to_string(range(first, last + 1), '-') AS path FROM m""")
def fragment_paths(v: Views) -> DataFrame:
    return _fragment_paths(v).select("fragment_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query(f"""WITH {_PATHS}, e AS (SELECT DISTINCT fragment_id, unnest(range(first, last)) AS a FROM r), f AS (SELECT fragment_id, string_agg(CAST(a AS STRING) || '-' || CAST(a + 1 AS STRING), ',' ORDER BY a) AS edges FROM e GROUP BY 1)
SELECT fragment_id % 10 AS sample_id, edges, count(*) AS n FROM f GROUP BY 1, 2""")
def path_families(v: Views) -> DataFrame:
    paths = _fragment_paths(v).withColumn("sample_id", F.col("fragment_id") % 10)
    text = F.array_join(F.transform("edges", lambda e: F.concat_ws("-", e["a"].cast("string"), e["b"].cast("string"))), ",")
    return haplotypes.families(paths, ["sample_id"], "fragment_id").select("sample_id", text.alias("edges"), "n")


def _chain_families(v: Views) -> DataFrame:
    """Fragments cover the edges of two neighbouring windows of three nodes: through all nodes, past the forks, or all edges."""
    window = F.explode(F.array_distinct(F.array(F.floor(F.col("a") / 3), F.floor((F.col("a") + 1) / 3)))).alias("at")
    way = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("way")
    edges = v.chain.select("graph_id", "a", "b", window).select("*", way)
    edges = edges.where("way = 2 OR way = 0 AND b = a + 1 OR way = 1 AND a % 4 <> 1 AND (a % 4 > 0 OR b = a + 2)")
    sets = edges.groupBy("graph_id", "at", "way").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("edges"))
    return sets.groupBy("graph_id", "edges").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE w AS (SELECT graph_id, a, b FROM chain UNION SELECT w.graph_id, w.a, c.b FROM w JOIN chain c ON c.graph_id = w.graph_id AND c.a = w.b) SELECT graph_id, a, b FROM w")
def reachable_nodes(v: Views) -> DataFrame:
    return graphs.reachable(v.chain, ["graph_id"])


@query("""WITH RECURSIVE w AS (SELECT graph_id, a, b FROM chain UNION SELECT w.graph_id, w.a, c.b FROM w JOIN chain c ON c.graph_id = w.graph_id AND c.a = w.b),
e AS (SELECT DISTINCT graph_id, unnest([a // 3, (a + 1) // 3]) AS f, a, b FROM chain),
k AS (SELECT graph_id, f * 3 + way AS f, a, b FROM e, (VALUES (0), (1), (2)) t(way) WHERE way = 2 OR way = 0 AND b = a + 1 OR way = 1 AND a % 4 <> 1 AND (a % 4 > 0 OR b = a + 2)),
o AS (SELECT *, lag(b) OVER (PARTITION BY graph_id, f ORDER BY a, b) AS before FROM k),
x AS (SELECT o.graph_id, o.f, bool_or(before IS NOT NULL AND before <> o.a AND w.a IS NULL) AS broken, string_agg(CAST(o.a AS STRING) || '-' || CAST(o.b AS STRING), ',' ORDER BY o.a, o.b) AS edges
  FROM o LEFT JOIN w ON w.graph_id = o.graph_id AND w.a = o.before AND w.b = o.a GROUP BY 1, 2)
SELECT graph_id, edges, count(*) AS n FROM x WHERE NOT broken GROUP BY 1, 2""")
def linear_families(v: Views) -> DataFrame:
    kept = haplotypes.linear(_chain_families(v), graphs.reachable(v.chain, ["graph_id"]), ["graph_id"])
    text = F.array_join(F.transform("edges", lambda e: F.concat_ws("-", e["a"].cast("string"), e["b"].cast("string"))), ",")
    return kept.select("graph_id", text.alias("edges"), "n")


@query(None)
def haplotype_paths(v: Views) -> DataFrame:
    kept = haplotypes.linear(_chain_families(v), graphs.reachable(v.chain, ["graph_id"]), ["graph_id"])
    return haplotypes.haplotypes(kept, ["graph_id"])


@query("""WITH f AS (SELECT id, 'f' || CAST(id % 3 AS STRING) AS file, chrom, pos // 40 AS block FROM variants)
SELECT id, file || '@' || sha256(file) || ':' || CAST(dense_rank() OVER (PARTITION BY file ORDER BY chrom, block) AS STRING) AS block_id FROM f""")
def block_ids(v: Views) -> DataFrame:
    file = F.concat(F.lit("f"), (F.col("id") % 3).cast("string"))
    rows = v.variants.select("id", file.alias("file"), "chrom", F.floor(F.col("pos") / 40).alias("block"))
    digests = v.spark.range(3).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file")).withColumn("digest", F.sha2("file", 256))
    return building.block_ids(rows, digests).select("id", "block_id")


@query("""SELECT id, CASE WHEN pos <= 100 THEN 'start' WHEN length(ref) > 1 AND substring(alt, 1, 1) <> substring(ref, 1, 1) THEN 'padding base' ELSE 'none' END AS flaw FROM variants WHERE alt <> '' AND ref <> ''""")
def record_flaws(v: Views) -> DataFrame:
    rows = v.variants.where("alt <> '' AND ref <> ''")
    reason = vcf.flaw(F.col("ref"), F.col("alt"), F.col("pos"), F.lit(None).cast("long"), F.lit(None).cast("string"), 100)
    return rows.select("id", F.coalesce(reason, F.lit("none")).alias("flaw"))


@query("""WITH n AS (SELECT graph_id, a AS node FROM edges UNION SELECT graph_id, b FROM edges),
l AS (SELECT graph_id, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM edges UNION ALL SELECT graph_id, 'source', CAST(node AS VARCHAR) FROM n WHERE (graph_id, node) NOT IN (SELECT graph_id, b FROM edges)
UNION ALL SELECT graph_id, CAST(node AS VARCHAR), 'sink' FROM n WHERE (graph_id, node) NOT IN (SELECT graph_id, a FROM edges)) SELECT graph_id, a, b FROM l""")
def source_sink_links(v: Views) -> DataFrame:
    edges = v.edges.select("graph_id", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    nodes = edges.select("graph_id", F.col("a").alias("node")).unionByName(edges.select("graph_id", F.col("b").alias("node"))).distinct().withColumn("seq", F.lit("A"))
    return graphs.with_source_and_sink(nodes, edges, ["graph_id"])[1]


@query(None)
def covering_paths(v: Views) -> DataFrame:
    found = graphs.covering_paths(v.chain.select("graph_id", "a", "b"), ["graph_id"])
    return found.select("graph_id", "number", F.array_join(F.transform("path", lambda n: n.cast("string")), "_").alias("path"))


def _contig_events(v: Views) -> tuple[DataFrame, DataFrame]:
    """An event for each contig, over its rows 19 and 20, and reads: every row with the next one and with the third behind it, of odd ids turned."""
    rows = _contigs(v)
    size = F.aggregate(F.filter("parts", lambda p: p["k"] < 19), F.lit(0), lambda n, p: n + F.char_length(p["seq"]))
    gone = F.aggregate(F.filter("parts", lambda p: p["k"].isin(19, 20)), F.lit(0), lambda n, p: n + F.char_length(p["seq"]))
    place = rows.groupBy("contig").agg(F.collect_list(F.struct("k", "seq")).alias("parts")).where("size(parts) = 40").select("contig", size.cast("long").alias("before"), gone.cast("long").alias("gone"))
    kind = F.col("contig") % 5
    made = place.select(F.col("contig").alias("graph_id"), F.col("contig").alias("chrom"), (F.col("before") + 1).alias("start"), F.when(kind == 4, F.col("before")).otherwise(F.col("before") + F.col("gone")).alias("end"),
                        F.when(kind % 2 == 0, F.lit("ACGTTGCA")).alias("ins"), F.when(kind < 2, 20).otherwise(60).cast("int").alias("flank"))
    described = events.event_graphs(made, _joined(rows).select("contig", F.lit(0).alias("chunk_id"), "seq"))
    other = rows.select("contig", (F.col("k")).alias("k2"), F.col("seq").alias("seq2"))
    near = rows.join(other, "contig").where("k2 - k IN (1, 3)")
    text = F.concat("seq", "seq2")
    turned = F.when(F.col("id") % 2 == 1, sequence.reverse_complement(text)).otherwise(text)
    return described, near.select(F.col("contig").alias("graph_id"), "id", (F.col("id") % 997).alias("fragment_id"), (F.col("id") * 2 + F.col("k2") - F.col("k")).alias("read"), turned.alias("seq"))


@query(None)
def event_support_counts(v: Views) -> DataFrame:
    """Counts of nodes, edges and sequences by kind of event, from all pairs of near rows of each contig."""
    described, reads = _contig_events(v)
    counts = events.count_reads(reads, described, ["graph_id"]).join(described.select("graph_id", F.col("kind").alias("event")), "graph_id")
    return counts.groupBy("event", "kind", "element").agg(F.sum("fragments").alias("fragments"), F.sum("reads").alias("reads"), F.sum("fwd").alias("fwd"), F.sum("rev").alias("rev"))


def _contig_graphs(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph of four nodes for each contig, from its first rows, its three paths, and two reads for each row: a path with one base changed, and the row itself."""
    rows = _contigs(v)
    heads = rows.where("k < 4").groupBy("contig").agg(F.sort_array(F.collect_list(F.struct("k", "seq"))).alias("parts")).where("size(parts) = 4")
    node = F.transform("parts", lambda p, k: F.struct(k.cast("long").alias("id"), p["seq"].alias("seq")))
    edge = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in ((0, 1), (1, 3), (0, 2), (2, 3), (0, 3))])
    described = heads.select(F.col("contig").alias("graph_id"), node.alias("nodes"), edge.alias("edges"))
    ways = F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.array(*[F.lit(x).cast("long") for x in w]).alias("nodes")) for n, w in (("ALT", (0, 2, 3)), ("DEL", (0, 3)), ("REF", (0, 1, 3)))])).alias("w")
    paths = described.select("graph_id", ways).select("graph_id", "w.path", "w.nodes")
    seqs = alignment.path_sequences(paths, described).select(F.col("graph_id").alias("contig"), "path", F.col("seq").alias("whole"))
    own = rows.withColumn("path", F.element_at(F.array(F.lit("ALT"), F.lit("DEL"), F.lit("REF")), (F.col("id") % 3 + 1).cast("int"))).join(seqs, ["contig", "path"])
    at = (F.col("id") * 7 % F.char_length("whole")).cast("int")
    changed = F.concat(F.left("whole", at), F.element_at(F.array(*map(F.lit, "ACGT")), (F.col("id") % 4 + 1).cast("int")), F.substring("whole", at + 2, F.char_length("whole")))
    turned = F.when(F.col("id") % 2 == 1, sequence.reverse_complement(changed)).otherwise(changed)
    reads = own.select(F.col("contig").alias("graph_id"), F.explode(F.array(F.struct((2 * F.col("id")).alias("id"), turned.alias("seq")), F.struct((2 * F.col("id") + 1).alias("id"), F.col("seq").alias("seq")))).alias("r"))
    return reads.select("graph_id", "r.id", "r.seq"), described, paths


@query(None)
def aligner_cascade(v: Views) -> DataFrame:
    reads, described, paths = _contig_graphs(v)
    return alignment.cascade(reads, described, paths, seed=12)


@query(None)
def path_alignment(v: Views) -> DataFrame:
    """The pairwise stage by itself, over all reads."""
    reads, described, paths = _contig_graphs(v)
    return alignment.path_alignments(reads, described, paths).drop("seq")
