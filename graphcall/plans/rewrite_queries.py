"""Queries over graphs that are made from graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcall.operators import rewriting
from graphcall.operators.storage import shuffled
from graphcall.plans.graph_queries import BLOCKS, _blocks
from graphcall.plans.registry import Views, query

#: The chain graphs with nodes of ten bases: the first seven are the reference, and three in a row have the same labels.
_NODES = """ed AS (SELECT DISTINCT graph_id, a, b FROM chain), nd AS (SELECT graph_id, a AS node FROM ed UNION SELECT graph_id, b FROM ed),
l AS (SELECT * FROM ed WHERE b = a + 1 AND (a < 7) = (b < 7) AND a // 3 = b // 3 QUALIFY true), l1 AS (SELECT l.* FROM l WHERE (SELECT count(*) FROM ed x WHERE x.graph_id = l.graph_id AND x.a = l.a) = 1 AND (SELECT count(*) FROM ed x WHERE x.graph_id = l.graph_id AND x.b = l.b) = 1),
h AS (SELECT graph_id, node, node AS head, 0 AS place FROM nd WHERE NOT EXISTS (SELECT 1 FROM l1 WHERE l1.graph_id = nd.graph_id AND l1.b = nd.node) UNION ALL SELECT h.graph_id, l1.b, h.head, h.place + 1 FROM h JOIN l1 ON l1.graph_id = h.graph_id AND l1.a = h.node)"""


def _chains(v: Views) -> tuple[DataFrame, DataFrame]:
    edges = v.chain.select("graph_id", "a", "b").withColumn("labels", F.array().cast("array<string>"))
    n = F.col("node")
    nodes = edges.select("graph_id", F.col("a").alias("node")).unionByName(edges.select("graph_id", F.col("b").alias("node"))).distinct()
    letters = F.repeat(F.char(65 + n), 10)
    return nodes.select("graph_id", "node", F.lit("c").alias("chrom"), (10 * n).alias("start"), (10 * n + 9).alias("stop"), (n < 7).alias("is_ref"), F.when(n >= 7, letters).alias("seq"), F.array(F.concat(F.lit("L"), F.expr("node div 3").cast("string"))).alias("labels")), edges


@query(f"""WITH RECURSIVE {_NODES.replace(' QUALIFY true', '')} SELECT graph_id, head AS node, CAST(10 * head AS BIGINT) AS start, CAST(10 * max(node) + 9 AS BIGINT) AS stop, head < 7 AS is_ref,
CASE WHEN head >= 7 THEN string_agg(repeat(chr(CAST(65 + node AS INT)), 10), '' ORDER BY place) END AS seq, 'L' || CAST(head // 3 AS VARCHAR) AS labels, CAST(count(*) AS INT) AS n_merged FROM h GROUP BY graph_id, head""")
def merged_nodes(v: Views) -> DataFrame:
    nodes, _ = rewriting.merged(*_chains(v), ["graph_id"])
    return nodes.select("graph_id", "node", "start", "stop", "is_ref", "seq", F.array_join("labels", ",").alias("labels"), "n_merged")


@query(f"WITH RECURSIVE {_NODES.replace(' QUALIFY true', '')} SELECT ed.graph_id, x.head AS a, y.head AS b FROM ed JOIN h x ON x.graph_id = ed.graph_id AND x.node = ed.a JOIN h y ON y.graph_id = ed.graph_id AND y.node = ed.b WHERE x.head <> y.head")
def merged_edges(v: Views) -> DataFrame:
    return rewriting.merged(*_chains(v), ["graph_id"])[1].select("graph_id", "a", "b")


@query("""WITH RECURSIVE ed AS (SELECT DISTINCT graph_id, a, b FROM chain), nd AS (SELECT graph_id, a AS node FROM ed UNION SELECT graph_id, b FROM ed),
g AS (SELECT graph_id, list(node ORDER BY node) AS nodes FROM nd GROUP BY 1), e AS (SELECT graph_id, list({'a': a, 'b': b} ORDER BY a, b) AS edges FROM ed GROUP BY 1),
w AS (SELECT g.graph_id, nodes, edges, CAST([] AS BIGINT[]) AS stack, CAST([] AS BIGINT[]) AS seen, CAST([] AS BIGINT[]) AS gone, 0 AS step FROM g JOIN e USING (graph_id)
  UNION ALL SELECT graph_id, nodes, edges,
    CASE WHEN next IS NOT NULL THEN list_append(stack, next) WHEN len(stack) > 0 THEN stack[:len(stack) - 1] ELSE [start] END, CASE WHEN next IS NOT NULL THEN list_append(seen, next) WHEN len(stack) > 0 THEN seen ELSE list_append(seen, start) END,
    CASE WHEN next IS NULL AND len(stack) > 0 THEN list_append(gone, stack[len(stack)]) ELSE gone END, step + 1
  FROM (SELECT *, [x.b FOR x IN edges IF x.a = stack[len(stack)] AND NOT list_contains(seen, x.b)][1] AS next, [x FOR x IN nodes IF NOT list_contains(seen, x)][1] AS start FROM w) s WHERE len(stack) > 0 OR start IS NOT NULL),
z AS (SELECT graph_id, arg_max(gone, step) AS gone FROM w GROUP BY 1)
SELECT graph_id, unnest(list_reverse(gone)) AS node, CAST(unnest(range(0, len(gone))) AS INT) AS place FROM z""")
def depth_first_order(v: Views) -> DataFrame:
    nodes, edges = _chains(v)
    return rewriting.depth_first_order(nodes.select("graph_id", "node"), edges, ["graph_id"])


#: Sequences as nodes, sixty graphs of which each is a line, with two variants for each node.
_CALLED = """nd AS (SELECT id % 60 AS graph_id, CAST(id AS VARCHAR) AS node, id, length(seq) AS size, seq FROM bases), ed AS (SELECT x.graph_id, x.node AS a, y.node AS b FROM nd x JOIN nd y ON y.id = x.id + 60),
v AS (SELECT graph_id, node, id % 4 AS start, id % 4 + id % 3 - 1 AS stop, CASE WHEN id % 3 = 0 OR id % 2 = 0 THEN 'TTG' ELSE '' END AS alt, size, seq FROM nd UNION SELECT graph_id, node, size - 2, size - 1, '', size, seq FROM nd),
c AS (SELECT graph_id, node, start AS p, size, seq FROM v UNION SELECT graph_id, node, stop + 1, size, seq FROM v UNION SELECT graph_id, node, -1, size, seq FROM v),
k AS (SELECT graph_id, node, size, seq, greatest(p, 0) AS low, coalesce(lead(p) OVER (PARTITION BY graph_id, node ORDER BY p) - 1, size - 1) AS high, row_number() OVER (PARTITION BY graph_id, node ORDER BY p) - 1 AS piece FROM c),
m AS (SELECT v.*, node || ':' || CAST(start AS VARCHAR) || '-' || CAST(stop AS VARCHAR) || ':' || alt AS name FROM v)"""


def _called(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    i, n = F.col("id"), F.char_length("seq")
    own = v.bases.select((i % 60).alias("graph_id"), i.cast("string").alias("node"), "id", "seq")
    none = F.array().cast("array<string>")
    nodes = own.select("graph_id", "node", F.lit("c").alias("chrom"), F.lit(0).cast("long").alias("start"), (n - 1).cast("long").alias("stop"), F.lit(False).alias("is_ref"), "seq", none.alias("labels"))
    edges = own.join(shuffled(own.select((i - 60).alias("id"), F.col("node").alias("b"))), "id").select("graph_id", F.col("node").alias("a"), "b", none.alias("labels"))
    one = own.select("graph_id", "node", (i % 4).alias("start"), (i % 4 + i % 3 - 1).alias("stop"), F.when((i % 3 == 0) | (i % 2 == 0), "TTG").otherwise("").alias("alt"))
    return nodes, edges, one.unionByName(own.select("graph_id", "node", (n - 2).cast("long").alias("start"), (n - 1).cast("long").alias("stop"), F.lit("").alias("alt")))


@query(f"""WITH {_CALLED} SELECT graph_id, node || '.' || CAST(piece AS VARCHAR) AS node, CAST(low AS BIGINT) AS start, CAST(high AS BIGINT) AS stop, substring(seq, CAST(low + 1 AS BIGINT), CAST(high - low + 1 AS BIGINT)) AS seq FROM k
UNION ALL SELECT graph_id, name, CAST(start AS BIGINT), CAST(stop AS BIGINT), alt FROM m""")
def called_variant_nodes(v: Views) -> DataFrame:
    nodes, _ = rewriting.with_variants(*_called(v), ["graph_id"])
    return nodes.select("graph_id", "node", "start", "stop", "seq")


@query(f"""WITH {_CALLED}, t AS (SELECT graph_id, node, max(piece) AS piece FROM k GROUP BY 1, 2)
SELECT ed.graph_id, a || '.' || CAST(t.piece AS VARCHAR) AS a, b || '.0' AS b FROM ed JOIN t ON t.graph_id = ed.graph_id AND t.node = ed.a
UNION ALL SELECT graph_id, node || '.' || CAST(piece - 1 AS VARCHAR), node || '.' || CAST(piece AS VARCHAR) FROM k WHERE piece > 0
UNION ALL SELECT m.graph_id, m.node || '.' || CAST(k.piece AS VARCHAR), m.name FROM m JOIN k ON k.graph_id = m.graph_id AND k.node = m.node AND k.high = m.start - 1 AND EXISTS (SELECT 1 FROM k x WHERE x.graph_id = k.graph_id AND x.node = k.node AND x.piece = k.piece + 1)
UNION ALL SELECT m.graph_id, m.name, m.node || '.' || CAST(k.piece AS VARCHAR) FROM m JOIN k ON k.graph_id = m.graph_id AND k.node = m.node AND k.low = m.stop + 1 AND k.piece > 0""")
def called_variant_edges(v: Views) -> DataFrame:
    return rewriting.with_variants(*_called(v), ["graph_id"])[1].select("graph_id", "a", "b")


#: Every block's variants are carried by one of three haplotypes, and the reference there by another.
_HAPLO = f"""{BLOCKS}, e AS (SELECT block, start AS at0 FROM s UNION SELECT block, stop + 1 FROM s UNION SELECT block, greatest(min(start) - 150, 0) FROM s GROUP BY 1 UNION SELECT block, max(stop) + 151 FROM s GROUP BY 1),
r AS (SELECT * FROM (SELECT block, at0 AS start, lead(at0) OVER (PARTITION BY block ORDER BY at0) - 1 AS stop FROM e) WHERE stop IS NOT NULL),
rl AS (SELECT DISTINCT r.block, r.start, r.stop, 'h' || CAST((s.id + 1) % 3 AS VARCHAR) AS label FROM r JOIN s ON s.block = r.block AND r.start >= s.start AND r.stop <= s.stop AND s.stop >= s.start),
nd AS (SELECT block, 'ref-' || CAST(start AS VARCHAR) || '-' || CAST(stop AS VARCHAR) AS node, start, stop, true AS ref FROM r UNION ALL SELECT DISTINCT block, 'alt-' || CAST(start AS VARCHAR) || '-' || CAST(stop AS VARCHAR) || ':' || alt, start, stop, false FROM s),
w AS (SELECT block, 'ref-' || CAST(start AS VARCHAR) || '-' || CAST(stop AS VARCHAR) AS node, label FROM rl UNION SELECT block, 'alt-' || CAST(start AS VARCHAR) || '-' || CAST(stop AS VARCHAR) || ':' || alt, 'h' || CAST(id % 3 AS VARCHAR) FROM s)"""
_HAPLO_EDGES = """tt AS (SELECT x.block, x.node AS a, y.node AS b, x.ref AS aref, y.ref AS bref, x.stop < x.start AND y.stop < y.start AS empties FROM nd x JOIN nd y ON y.block = x.block AND y.start = x.stop + 1 AND y.node <> x.node),
st AS (SELECT * FROM (SELECT w.block, w.label, w.node AS a, lead(w.node) OVER q AS b, nd.stop AS stop, lead(nd.start) OVER q AS follows FROM w JOIN nd ON nd.block = w.block AND nd.node = w.node WINDOW q AS (PARTITION BY w.block, w.label ORDER BY nd.start, nd.stop, w.node)) WHERE follows = stop + 1),
pp AS (SELECT block, a, b FROM tt WHERE aref AND bref UNION SELECT block, a, b FROM st UNION {plain}),
ow AS (SELECT pp.block, pp.a, pp.b, w.label FROM pp JOIN w ON w.block = pp.block AND w.node = pp.a WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.block = w.block AND st.label = w.label AND st.a = w.node)),
iw AS (SELECT pp.block, pp.a, pp.b, w.label FROM pp JOIN w ON w.block = pp.block AND w.node = pp.b WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.block = w.block AND st.label = w.label AND st.b = w.node) AND NOT EXISTS (SELECT 1 FROM ow WHERE ow.block = w.block AND ow.label = w.label AND ow.b = w.node)),
la AS (SELECT block, a, b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT block, a, b, label FROM st UNION SELECT * FROM ow UNION SELECT * FROM iw) GROUP BY 1, 2, 3)
SELECT pp.block, pp.a, pp.b, coalesce(la.labels, '') AS labels FROM pp LEFT JOIN la ON la.block = pp.block AND la.a = pp.a AND la.b = pp.b"""


def _haplotype_nodes(v: Views) -> DataFrame:
    who = lambda n: F.array(F.concat(F.lit("h"), (n % 3).cast("string")))
    rows = _blocks(v).withColumns({"haplotypes": who(F.col("id")), "ref_haplotypes": who(F.col("id") + 1)})
    return rewriting.haplotype_nodes(rows, ["block"], F.lit("c"))


@query(f"WITH {_HAPLO} SELECT nd.block, nd.node, nd.start, nd.stop, nd.ref AS is_ref, coalesce(string_agg(w.label, ',' ORDER BY w.label), '') AS labels FROM nd LEFT JOIN w ON w.block = nd.block AND w.node = nd.node GROUP BY 1, 2, 3, 4, 5")
def haplotype_graph_nodes(v: Views) -> DataFrame:
    return _haplotype_nodes(v).select("block", "node", "start", "stop", "is_ref", F.array_join("labels", ",").alias("labels"))


_IN_HAPLOTYPES = """SELECT block, a, b FROM tt WHERE aref AND NOT bref AND NOT EXISTS (SELECT 1 FROM st WHERE st.block = tt.block AND st.b = tt.b) UNION SELECT block, a, b FROM tt WHERE NOT aref AND bref AND NOT EXISTS (SELECT 1 FROM st WHERE st.block = tt.block AND st.a = tt.a)"""


@query(f"WITH {_HAPLO}, {_HAPLO_EDGES.format(plain=_IN_HAPLOTYPES)}")
def haplotype_graph_edges(v: Views) -> DataFrame:
    return rewriting.haplotype_edges(_haplotype_nodes(v), ["block"]).select("block", "a", "b", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {_HAPLO}, {_HAPLO_EDGES.format(plain='SELECT block, a, b FROM tt WHERE NOT (aref AND bref) AND NOT empties')}")
def allele_graph_edges(v: Views) -> DataFrame:
    return rewriting.haplotype_edges(_haplotype_nodes(v), ["block"], alleles=True).select("block", "a", "b", F.array_join("labels", ",").alias("labels"))
