"""Queries over k-mers of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcall.operators import kmers
from graphcall.plans.graph_queries import _CONTIGS, _contig_graphs
from graphcall.plans.registry import Views, query

#: The graphs of the contigs: four nodes each, whose middle ones are alternatives and may be passed.
GRAPHS = f"""{_CONTIGS}, nd AS (SELECT contig AS graph_id, k AS node, seq FROM o WHERE k < 4 QUALIFY count(*) OVER (PARTITION BY contig) = 4),
ed AS (SELECT DISTINCT graph_id, a, b FROM nd, (VALUES (0, 1), (1, 3), (0, 2), (2, 3), (0, 3)) t(a, b))"""
#: All k-mers of the graphs for the lengths in ks.
KMERS = """p AS (SELECT graph_id, kk, node AS start, off, substring(seq, off + 1, kk) AS kmer, [node] AS path FROM (SELECT graph_id, node, seq, kk, unnest(range(0, length(seq))) AS off FROM nd, ks)
  UNION ALL SELECT p.graph_id, kk, start, off, kmer || substring(n.seq, 1, kk - length(kmer)), list_append(path, n.node) FROM p JOIN ed e ON e.graph_id = p.graph_id AND e.a = path[len(path)] JOIN nd n ON n.graph_id = e.graph_id AND n.node = e.b WHERE length(kmer) < kk),
u AS (SELECT graph_id, kk, kmer, min(path) AS path FROM p WHERE length(kmer) = kk GROUP BY 1, 2, 3 HAVING count(*) = 1)"""
COVERED = """x AS (SELECT graph_id, kk, 'node' AS kind, unnest(path) AS a, CAST(NULL AS BIGINT) AS b, kmer FROM u UNION ALL SELECT graph_id, kk, 'edge', path[i], path[i + 1], kmer FROM (SELECT *, unnest(range(1, len(path))) AS i FROM u)),
e0 AS (SELECT graph_id, 'node' AS kind, node AS a, CAST(NULL AS BIGINT) AS b FROM nd UNION ALL SELECT graph_id, 'edge', a, b FROM ed),
c AS (SELECT e0.graph_id, ks.kk, e0.kind, e0.a, e0.b, count(x.kmer) AS n FROM e0 JOIN ks ON true LEFT JOIN x ON x.graph_id = e0.graph_id AND x.kk = ks.kk AND x.kind = e0.kind AND x.a = e0.a AND x.b IS NOT DISTINCT FROM e0.b GROUP BY 1, 2, 3, 4, 5)"""


def _tables(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    reads, described, _ = _contig_graphs(v)
    nodes = described.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", F.col("n.id").alias("node"), "n.seq")
    return nodes, described.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.a", "e.b"), reads


@query(f"WITH RECURSIVE {GRAPHS}, ks AS (SELECT unnest([6, 11]) AS kk), {KMERS}, {COVERED} SELECT graph_id, kk AS k, kind, a, b, n FROM c")
def graph_kmer_stats(v: Views) -> DataFrame:
    """Unique k-mers over every node and edge, for two lengths."""
    nodes, edges, _ = _tables(v)
    sizes = nodes.select("graph_id").distinct().select("graph_id", F.explode(F.array(F.lit(6), F.lit(11))).alias("k"))
    return kmers.coverage(kmers.unique_kmers(kmers.graph_kmers(nodes, edges, sizes)), nodes, edges, sizes)


@query(f"""WITH RECURSIVE {GRAPHS}, ks AS (SELECT unnest(range(3, 13)) AS kk), {KMERS}, {COVERED}, z AS (SELECT graph_id, kk FROM c GROUP BY 1, 2 HAVING min(n) >= 4)
SELECT g.graph_id, CAST(min(z.kk) AS INT) AS k FROM (SELECT DISTINCT graph_id FROM nd) g LEFT JOIN z ON z.graph_id = g.graph_id GROUP BY g.graph_id""")
def covering_kmer_length(v: Views) -> DataFrame:
    """The smallest length, of 3 to 12, for which all nodes and edges have four unique k-mers."""
    nodes, edges, _ = _tables(v)
    return kmers.covering_length(nodes, edges, 4, shortest=3, longest=12)


#: Reads as they lie: the first part of a row on its graph's first two nodes or on the first and the last, clipped at the start.
_READS = """rd AS (SELECT o.id AS read, o.contig AS graph_id, o.id % 2 AS way, o.id % 7 AS clip, a.seq AS sa, b.seq AS sb, o.seq FROM o JOIN nd a ON a.graph_id = o.contig AND a.node = 0 JOIN nd b ON b.graph_id = o.contig AND b.node = CASE WHEN o.id % 2 = 0 THEN 1 ELSE 3 END),
r2 AS (SELECT read, graph_id, CASE WHEN way = 0 THEN [0, 1] ELSE [0, 3] END AS nodes, clip, CASE WHEN read % 3 = 0 THEN substring(seq, 1, CAST(clip AS BIGINT)) || sa || seq ELSE substring(seq, 1, CAST(clip AS BIGINT)) || sa || sb END AS seq FROM rd)"""


@query(f"""WITH RECURSIVE {GRAPHS}, ks AS (SELECT 9 AS kk), {KMERS}, {_READS},
w AS (SELECT DISTINCT read, graph_id, substring(seq, i, 9) AS kmer FROM (SELECT *, unnest(range(clip + 1, length(seq) - 7)) AS i FROM r2)),
v AS (SELECT DISTINCT w.read, unnest(u.path) AS node FROM w JOIN u ON u.graph_id = w.graph_id AND u.kmer = w.kmer), t AS (SELECT DISTINCT graph_id, unnest(path) AS node FROM u),
q AS (SELECT r2.read, r2.graph_id, unnest(range(1, 3)) AS i, nodes FROM r2),
s AS (SELECT q.read, q.graph_id, string_agg('_' || CAST(q.nodes[q.i] AS VARCHAR), '' ORDER BY q.i) FILTER (t.node IS NOT NULL AND v.node IS NULL) AS names, (SELECT count(*) FROM v WHERE v.read = q.read) AS hit
  FROM q LEFT JOIN t ON t.graph_id = q.graph_id AND t.node = q.nodes[q.i] LEFT JOIN v ON v.read = q.read AND v.node = q.nodes[q.i] GROUP BY q.read, q.graph_id)
SELECT graph_id, read, CASE WHEN names IS NOT NULL OR hit = 0 THEN 'kmer_uncov' || coalesce(names, '') END AS reason FROM s""")
def kmer_node_filter(v: Views) -> DataFrame:
    """Reads on two nodes, some of which hold another sequence than the second node's: which nodes no unique k-mer covers."""
    nodes, edges, _ = _tables(v)
    sizes = nodes.select("graph_id").distinct().withColumn("k", F.lit(9))
    unique = kmers.unique_kmers(kmers.graph_kmers(nodes, edges, sizes))
    rows = v.bases.select(F.col("id").alias("read"), F.expr("id div 40").alias("graph_id"), F.translate("seq", "N", "A").alias("seq"))
    node = lambda d, n, name: d.where(n).select("graph_id", F.col("node").alias(f"n{name}"), F.col("seq").alias(name))
    second = F.when(F.col("read") % 2 == 0, 1).otherwise(3)
    rows = rows.join(node(nodes, F.col("node") == 0, "sa"), "graph_id").join(node(nodes, F.col("node") > 0, "sb"), "graph_id").where(F.col("nsb") == second)
    clip = (F.col("read") % 7).cast("int")
    text = F.concat(F.left("seq", clip), "sa", F.when(F.col("read") % 3 == 0, F.col("seq")).otherwise(F.col("sb")))
    size = lambda c: F.char_length(c).cast("string")
    where = F.concat(F.lit("0["), F.when(clip > 0, F.concat(clip.cast("string"), F.lit("S"))).otherwise(""), size("sa"), F.lit("M]"), second.cast("string"), F.lit("["), size("sb"), F.lit("M]"))
    return kmers.filter_reasons(rows.select("graph_id", "read", text.alias("seq"), where.alias("graph_cigar")), unique)
