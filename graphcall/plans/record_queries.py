"""Queries from records to calls, of depth by samples, and of alignments as records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcall import api
from graphcall.functions import sequence
from graphcall.operators import msa, records
from graphcall.plans.graph_queries import _contigs, _joined
from graphcall.plans.kmer_queries import GRAPHS
from graphcall.plans.registry import Views, query
from graphcall.sources import files

SAMPLES = [0, 1, 2]


def _records(v: Views) -> tuple[DataFrame, DataFrame]:
    """A record for each whole contig, over its rows 19 and 20 or behind row 18, and the contigs in chunks."""
    rows = _contigs(v)
    size = lambda test: F.aggregate(F.filter("parts", test), F.lit(0).cast("long"), lambda n, p: n + F.char_length(p["seq"]))
    place = rows.groupBy("contig").agg(F.sort_array(F.collect_list(F.struct("k", "seq"))).alias("parts")).where("size(parts) = 40")
    whole = F.array_join(F.transform("parts", lambda p: p["seq"]), "")
    place = place.select("contig", whole.alias("whole"), size(lambda p: p["k"] < 19).alias("before"), size(lambda p: p["k"].isin(19, 20)).alias("gone"))
    kind = F.col("contig") % 4
    anchor = F.substring(F.col("whole"), F.col("before").cast("int"), F.lit(1))
    long = F.substring(F.col("whole"), F.col("before").cast("int"), (F.col("gone") + 1).cast("int"))
    insert = F.concat(anchor, F.lit("GATTACAGATTACACATTAGATCCAGTACAGA"))
    ref = F.when(kind == 0, long).when(kind == 1, long).otherwise(anchor)
    alts = F.when(kind == 0, F.array(anchor)).when(kind == 1, F.array(insert, anchor)).when(kind == 2, F.array(insert)).otherwise(F.array(F.lit("<DEL>")))
    end = F.when(kind == 2, F.col("before")).otherwise(F.col("before") + F.col("gone"))
    out = place.select(F.col("contig").alias("graph_id"), F.col("contig").cast("string").alias("chrom"), F.col("before").alias("pos"), end.alias("end"), ref.alias("ref"), alts.alias("alts"), F.lit(None).cast("string").alias("inserted"), "whole")
    chunks = files.chunked(_joined(rows).select(F.col("contig").cast("string").alias("contig"), "seq"), 256)
    return out, chunks


@query(None)
def record_genotypes(v: Views) -> DataFrame:
    """Records to graphs to counts to calls of three samples: reads of sixty bases over each row's place, from a copy with the first alternative or without it."""
    made, chunks = _records(v)
    alt = F.get("alts", F.lit(0))
    other = F.concat(F.left("whole", (F.col("pos") - 1).cast("int")), F.when(alt == "<DEL>", F.col("ref")).otherwise(alt), F.substring(F.col("whole"), (F.col("end") + 1).cast("int"), F.char_length("whole")))
    copies = made.select("graph_id", "chrom", "pos", F.explode(F.array(F.struct(F.lit(0).alias("allele"), F.col("whole").alias("text")), F.struct(F.lit(1).alias("allele"), other.alias("text")))).alias("c")).select("graph_id", "chrom", "pos", "c.allele", "c.text")
    sample = F.explode(F.array(*map(F.lit, SAMPLES))).alias("sample_id")
    reads = copies.select("*", sample).where("sample_id = 1 OR sample_id = 2 * allele")
    # Every third base around the record begins a read, twice where a sample has one kind of copy only.
    begins = F.explode(F.sequence(F.greatest(F.col("pos") - 90, F.lit(1)), F.col("pos") + 60, F.lit(3).cast("long"))).alias("at")
    twice = F.explode(F.when(F.col("sample_id") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("copy")
    reads = reads.select("*", begins).select("*", twice)
    text = F.substring(F.col("text"), F.col("at").cast("int"), F.lit(60))
    name = F.concat_ws("-", F.col("allele").cast("string"), F.col("at").cast("string"), F.col("copy").cast("string"))
    reads = reads.select("sample_id", "chrom", (F.col("at") - 1).alias("pos"), F.lit(60).cast("long").alias("len"), name.alias("fragment_id"), F.lit(True).alias("is_first_mate"), F.when(F.col("at") % 2 == 0, sequence.reverse_complement(text)).otherwise(text).alias("seq"))
    samples = v.spark.range(3).select(F.col("id").cast("int").alias("sample_id"), F.lit(40.0).alias("depth"), F.lit(15.0).alias("depth_sd"), F.lit(60.0).alias("read_length"))
    calls = api.genotype_records(made.drop("whole"), reads, samples, chunks, SAMPLES, chunk_size=256, flank=100)
    return calls.select("graph_id", "sample_id", F.array_join("gt", "/").alias("gt"), "num_reads", F.array_join("filters", ";").alias("filters"))


@query(f"""WITH {GRAPHS}, n AS (SELECT DISTINCT graph_id FROM nd), lab AS (SELECT * FROM (VALUES (0, 1, 'ALT1'), (1, 3, 'ALT1'), (0, 2, 'REF'), (2, 3, 'REF'), (0, 3, 'ALT2')) t(a, b, allele)),
side AS (SELECT a, b, allele, CAST(a AS VARCHAR) || '_' AS breakpoint FROM lab WHERE a = 0 UNION ALL SELECT a, b, allele, '_' || CAST(b AS VARCHAR) FROM lab WHERE b = 3),
c AS (SELECT id % 3 AS sample_id, id // 40 AS graph_id, id % 4 AS a, CASE WHEN id % 4 = 0 THEN 1 + id % 3 ELSE 3 END AS b, CAST(sum(id % 17 + 1) AS BIGINT) AS fragments FROM bases WHERE id % 4 < 3 GROUP BY 1, 2, 3, 4),
z AS (SELECT n.graph_id, s.sample_id, side.breakpoint, side.allele, CAST(coalesce(sum(c.fragments), 0) AS BIGINT) AS n FROM n JOIN (VALUES (0), (1), (2)) s(sample_id) ON true JOIN side ON true LEFT JOIN c ON c.graph_id = n.graph_id AND c.sample_id = s.sample_id AND c.a = side.a AND c.b = side.b GROUP BY 1, 2, 3, 4)
SELECT graph_id, CAST(sample_id AS INT) AS sample_id, breakpoint, string_agg(CAST(n AS VARCHAR), ',' ORDER BY CASE allele WHEN 'REF' THEN 0 WHEN 'ALT1' THEN 1 ELSE 2 END) AS counts FROM z GROUP BY 1, 2, 3""")
def graph_breakpoint_counts(v: Views) -> DataFrame:
    """Counts of edges to arrays by breakpoint and allele, for three samples and every graph."""
    heads = _contigs(v).where("k < 4").groupBy("contig").agg(F.count("*").alias("n")).where("n = 4").select(F.col("contig").alias("graph_id"))
    node = F.array(*[F.struct(F.lit(k).cast("long").alias("id"), F.lit(str(k)).alias("name"), F.lit("A").alias("seq")) for k in range(4)])
    edge = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(f"{a}_{b}").alias("name"), F.array(F.lit(x)).alias("labels")) for a, b, x in ((0, 1, "ALT1"), (1, 3, "ALT1"), (0, 2, "REF"), (2, 3, "REF"), (0, 3, "ALT2"))])
    described = heads.select("graph_id", F.lit(2).alias("n_alts"), node.alias("nodes"), edge.alias("edges"))
    i = F.col("id")
    rows = v.bases.where("id % 4 < 3").select((i % 3).cast("int").alias("sample_id"), F.expr("id div 40").alias("graph_id"), F.concat_ws("_", (i % 4).cast("string"), F.when(i % 4 == 0, 1 + i % 3).otherwise(3).cast("string")).alias("element"), (i % 17 + 1).alias("n"))
    counts = rows.groupBy("sample_id", "graph_id", "element").agg(F.sum("n").alias("fragments"))
    found = records.breakpoint_counts(counts, records.breakpoints(described), described, SAMPLES)
    return found.select("graph_id", "sample_id", "breakpoint", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"))


@query(None)
def sampled_depth(v: Views) -> DataFrame:
    """Depth of the five contigs from samples of their places."""
    reads = v.reads.select(F.col("chrom").alias("contig"), "pos", "len")
    contigs = reads.groupBy("contig").agg(F.max(F.col("pos") + F.col("len")).alias("length"))
    return api.estimate_depth(reads, contigs, stretch=200, longest=3000)


#: The rows of a contig, without their first base and padded with gaps, are an alignment; of odd ids without their Cs.
_MSA = """o AS (SELECT id, id // 40 AS contig, id % 40 AS k, translate(substring(seq, 2), 'N', 'A') AS seq FROM bases),
a AS (SELECT id, contig, k, rpad(CASE WHEN id % 2 = 1 THEN replace(seq, 'C', '-') ELSE seq END, 30, '-') AS seq FROM o)"""


@query(f"""WITH {_MSA}, f AS (SELECT contig, arg_min(seq, k) AS ref, min(k) AS lead FROM a GROUP BY contig), g AS (SELECT id, contig, ref, seq AS alt FROM a JOIN f USING (contig) WHERE k > lead),
c AS (SELECT id, contig, k, substring(ref, k, 1) AS r, substring(alt, k, 1) AS a FROM (SELECT *, unnest(range(1, length(ref) + 1)) AS k FROM g)),
b AS (SELECT *, coalesce(sum(CASE WHEN r <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, sum(CASE WHEN r = a THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS same FROM c WHERE r <> '-' OR a <> '-'),
d AS (SELECT id, contig, min(base) AS start, replace(string_agg(r, '' ORDER BY k), '-', '') AS ref, replace(string_agg(a, '' ORDER BY k), '-', '') AS alt FROM b WHERE r <> a GROUP BY id, contig, same),
h AS (SELECT id, contig, start - CASE WHEN (d.ref = '' OR alt = '') AND start > 0 THEN 1 ELSE 0 END AS start, CASE WHEN (d.ref = '' OR alt = '') AND start > 0 THEN substring(replace(f.ref, '-', ''), CAST(start AS BIGINT), 1) ELSE '' END AS x,
  CASE WHEN (d.ref = '' OR alt = '') AND start = 0 THEN substring(replace(f.ref, '-', ''), length(d.ref) + 1, 1) ELSE '' END AS y, d.ref, alt FROM d JOIN f USING (contig))
SELECT contig, CAST(start AS BIGINT) AS start, x || ref || y AS ref, array_to_string(list_sort(list(DISTINCT x || alt || y)), ',') AS alts, count(*) AS n FROM h GROUP BY contig, start, x || ref || y, y <> ''""")
def alignment_sites(v: Views) -> DataFrame:
    """The sites of every contig's whole rows as an alignment."""
    rows = _contigs(v).withColumn("seq", F.substring(F.col("seq"), F.lit(2), F.char_length("seq")))
    text = F.rpad(F.when(F.col("id") % 2 == 1, F.replace("seq", F.lit("C"), F.lit("-"))).otherwise(F.col("seq")), 30, "-")
    found = msa.sites(rows.select("contig", F.col("id").alias("name"), F.col("k").alias("number"), text.alias("seq")), ["contig"])
    return found.select("contig", F.col("start").cast("long").alias("start"), "ref", F.array_join("alts", ",").alias("alts"), F.size("calls").cast("long").alias("n"))
