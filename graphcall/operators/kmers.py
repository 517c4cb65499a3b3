"""K-mers of sequence graphs: where each lies, which lie on one path only, the least length that tells all nodes and edges apart, and the filter of reads by them.

Graphs are tables of nodes (graph_id, node, seq) and edges (graph_id, a, b), small each and many, and all of them are worked on at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcall.functions import cigar, sequence
from graphcall.operators.storage import cut


def graph_kmers(nodes: DataFrame, edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """All k-mers of graphs for the lengths that ``sizes`` (graph_id, k) asks for: graph_id, k, kmer, start, offset, path (nodes).

    K-mers inside a node are cut from it. Those that reach over its end grow along edges, a node a round, until they have k bases
    or their way ends; each way is a path of its own. Nodes without bases are on a path that goes through them.
    """
    own = nodes.select("graph_id", F.col("node").cast("long").alias("node"), F.upper(F.coalesce("seq", F.lit(""))).alias("seq")).join(sizes.select("graph_id", "k"), "graph_id")
    at = F.explode(F.sequence(F.lit(0), F.char_length("seq") - 1)).alias("offset")
    rows = own.where("seq <> ''").select("graph_id", "k", "node", "seq", at)
    rows = rows.select("graph_id", "k", F.col("node").alias("start"), "offset", F.substring(F.col("seq"), F.col("offset") + 1, F.col("k")).alias("kmer"), F.array("node").alias("path"))
    size = F.char_length("kmer")
    done, open_ = rows.where(size == F.col("k")), cut(rows.where(size < F.col("k")))
    steps = edges.select("graph_id", F.col("a").cast("long").alias("_last"), F.col("b").cast("long").alias("node")).distinct()
    steps = cut(steps.join(nodes.select("graph_id", F.col("node").cast("long").alias("node"), F.upper(F.coalesce("seq", F.lit(""))).alias("seq")), ["graph_id", "node"]))
    while not open_.isEmpty():
        grown = open_.withColumn("_last", F.element_at("path", -1)).join(steps, ["graph_id", "_last"])
        grown = grown.withColumns({"kmer": F.concat("kmer", F.left("seq", F.col("k") - size)), "path": F.concat("path", F.array("node"))}).select(*rows.columns)
        grown = cut(grown)
        done, open_ = done.unionByName(grown.where(size == F.col("k"))), grown.where(size < F.col("k"))
    return done.where(~F.col("kmer").rlike("[^ACGT]"))


def unique_kmers(kmers: DataFrame) -> DataFrame:
    """K-mers that lie on one path of their graph: graph_id, k, kmer, path."""
    return kmers.groupBy("graph_id", "k", "kmer").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")


def coverage(unique: DataFrame, nodes: DataFrame, edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Unique k-mers over each node and edge: graph_id, k, kind, a (the node or where the edge begins), b, n."""
    node = F.transform(F.array_distinct("path"), lambda x: F.struct(F.lit("node").alias("kind"), x.alias("a"), F.lit(None).cast("long").alias("b")))
    last = F.size("path") - 1
    edge = F.zip_with(F.slice("path", F.lit(1), last), F.slice("path", F.lit(2), last), lambda a, b: F.struct(F.lit("edge").alias("kind"), a.alias("a"), b.alias("b")))
    hit = unique.select("graph_id", "k", F.explode(F.concat(node, F.array_distinct(edge))).alias("e")).groupBy("graph_id", "k", "e.kind", "e.a", "e.b").agg(F.count("*").alias("n"))
    every = nodes.select("graph_id", F.lit("node").alias("kind"), F.col("node").cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    every = every.unionByName(edges.select("graph_id", F.lit("edge").alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()).join(sizes.select("graph_id", "k"), "graph_id")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("graph_id", "k", "kind", "a", "b")]
    rows = every.alias("x").join(hit.alias("y"), same[0] & same[1] & same[2] & same[3] & same[4], "left")
    return rows.select("x.graph_id", "x.k", "x.kind", "x.a", "x.b", F.coalesce("y.n", F.lit(0).cast("long")).alias("n"))


def covering_length(nodes: DataFrame, edges: DataFrame, least: int, *, shortest: int = 10, longest: int = 63) -> DataFrame:
    """The smallest k for which every node and edge of a graph has ``least`` unique k-mers over it: graph_id, k (null if none up to ``longest`` has).

    A longer k need not have more, so all are tried in order, in batches that double; a graph that has its k drops out.
    """
    left = cut(nodes.select("graph_id").distinct())
    done, low, width = None, shortest, 4
    while low <= longest:
        lengths = F.explode(F.sequence(F.lit(low), F.lit(min(longest, low + width - 1)))).alias("k")
        sizes = left.select("graph_id", lengths)
        own_nodes, own_edges = (d.join(left, "graph_id", "left_semi") for d in (nodes, edges))
        counts = coverage(unique_kmers(graph_kmers(own_nodes, own_edges, sizes)), own_nodes, own_edges, sizes)
        enough = counts.groupBy("graph_id", "k").agg(F.min("n").alias("n")).where(F.col("n") >= least).groupBy("graph_id").agg(F.min("k").alias("k"))
        enough = cut(enough)
        done = enough if done is None else done.unionByName(enough)
        left = cut(left.join(enough, "graph_id", "left_anti"))
        if left.isEmpty():
            return done
        low, width = low + width, 2 * width
    none = left.withColumn("k", F.lit(None).cast("int"))
    return none if done is None else done.unionByName(none)


def filter_reasons(reads: DataFrame, unique: DataFrame) -> DataFrame:
    """Why k-mers reject aligned reads (graph_id, read, seq as it lies on the graph, graph_cigar): graph_id, read, reason (null: they don't).

    ``unique`` has graph_id, k, kmer and path, one k for each graph. Every node of a read's path that has unique k-mers must be covered by the path of
    one that the read has outside its clipped ends: those of the first node before it and those of the last behind it. Nodes that aren't covered are named in order.
    The join carries a read's k-mers and paths; a read without a graph's k keeps no reason.
    """
    sizes = unique.select("graph_id", "k", F.explode("path").alias("node")).groupBy("graph_id").agg(F.max("k").alias("k"), F.collect_set("node").alias("told"))
    path = cigar.graph_nodes(F.col("graph_cigar"))
    rows = reads.select("graph_id", "read", F.upper("seq").alias("seq"), path.alias("path")).join(sizes, "graph_id", "left")
    clip = lambda n: F.coalesce(cigar.total(n["ops"], "S"), F.lit(0))
    rows = rows.withColumns({"left": clip(F.get("path", F.lit(0))), "right": clip(F.element_at("path", F.when(F.size("path") > 0, -1))), "nodes": F.transform("path", lambda n: n["node"].cast("long"))})
    rows = cut(rows.drop("path").withColumn("rest", F.char_length("seq") - F.col("left") - F.col("right")))
    here = rows.where("size(nodes) > 0 AND rest >= k")
    places = F.sequence(F.col("left") + 1, F.col("left") + 1 + F.col("rest") - F.col("k"))
    words = here.select("graph_id", "k", "read", F.explode(F.array_distinct(F.transform(places, lambda p: F.substring(F.col("seq"), p, F.col("k"))))).alias("kmer"))
    covered = words.join(unique.select("graph_id", "k", "kmer", F.col("path").alias("_path")), ["graph_id", "k", "kmer"]).groupBy("graph_id", "read").agg(F.array_distinct(F.flatten(F.collect_set("_path"))).alias("covered"))
    rows = rows.join(covered, ["graph_id", "read"], "left")
    asked = F.filter("nodes", lambda n: F.array_contains("told", n))
    open_ = F.filter(asked, lambda n: ~F.coalesce(F.array_contains("covered", n), F.lit(False)))
    uncovered = F.when((F.size(open_) > 0) | (F.col("covered").isNull()), F.concat_ws("_", F.lit("kmer_uncov"), F.transform(open_, lambda n: n.cast("string"))))
    reason = F.when(F.col("k").isNull(), F.lit(None).cast("string")).when(F.size("nodes") == 0, "kmer_nomapping").when(F.col("rest") < F.col("k"), "kmer_tooshort").otherwise(uncovered)
    return rows.select("graph_id", "read", reason.alias("reason"))


def on_graph(seq: Column, reverse: Column) -> Column:
    """A read's bases in the direction in which it lies on its graph."""
    return F.when(reverse, sequence.reverse_complement(seq)).otherwise(seq)
