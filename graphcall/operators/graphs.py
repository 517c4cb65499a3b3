"""Sequence graphs as tables of nodes, edges and paths, and rewriting of these tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphcall.functions import sequence
from graphcall.operators.storage import cut


def source_sink(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes without incoming (source) or outgoing (sink) edges."""
    into, out = edges.select(*keys, F.col("b").alias("node")), edges.select(*keys, F.col("a").alias("node"))
    first = nodes.join(into, [*keys, "node"], "left_anti").withColumn("role", F.lit("source"))
    return first.unionByName(nodes.join(out, [*keys, "node"], "left_anti").withColumn("role", F.lit("sink")))


def with_source_and_sink(nodes: DataFrame, edges: DataFrame, keys: list[str], *, names: tuple[str, str] = ("source", "sink"), seq: str = "N" * 10) -> tuple[DataFrame, DataFrame]:
    """Nodes (keys, node, seq) and edges (keys, a, b) of graphs with a source before every node without a way in, and a sink behind those without a way out.

    Graphs that have nodes of these names keep them; these aren't linked themselves.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.lit(seq).alias("seq")) for n in names])).alias("e")
    made = nodes.select(*keys).distinct().select(*keys, ends).select(*keys, "e.node", "e.seq").join(nodes.select(*keys, "node"), [*keys, "node"], "left_anti")
    open_ = source_sink(nodes.select(*keys, "node"), edges, keys).where(~F.col("node").isin(*names))
    first = F.col("role") == "source"
    links = open_.select(*keys, F.when(first, names[0]).otherwise(F.col("node")).alias("a"), F.when(first, F.col("node")).otherwise(names[1]).alias("b"))
    return nodes.select(*keys, "node", "seq").unionByName(made.select(*keys, "node", "seq")), edges.select(*keys, "a", "b").unionByName(links)


def covering_paths(edges: DataFrame, keys: list[str], label: str | None = None) -> DataFrame:
    """Paths (keys, path number, nodes) that together use every edge (keys, a, b, labels; nodes numbered in topological order) of a label, or every edge.

    Walks go on along edges that no path has used, smallest end first, and a path is what a walk passes until it can't; so there are at most as many
    paths as edges, where all paths of a graph grow exponentially. A graph's edges meet in one task: graphs are small, their number is not.
    """
    own = edges if label is None else edges.where(F.array_contains("labels", label))
    out = T.StructType([*own.select(*keys).schema, *T.StructType.fromDDL("number int, path array<long>")])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        after: dict[int, list[int]] = {}
        for a, b in sorted({(int(a), int(b)) for a, b in zip(rows["a"], rows["b"], strict=True)}):
            after.setdefault(a, []).append(b)
        used: set[tuple[int, int]] = set()
        found: list[list[int]] = []
        for start in sorted(after):
            for end in after[start]:
                if (start, end) in used:
                    continue
                used.add((start, end))
                stack = [([start, end], False)]
                while stack:
                    path, grown = stack.pop()
                    free = [b for b in after.get(path[-1], []) if (path[-1], b) not in used]
                    if free:
                        used.add((path[-1], free[0]))
                        stack += [(path, True), ([*path, free[0]], False)]
                    elif not grown:
                        found.append(path)
        return pd.DataFrame([(*key, k, p) for k, p in enumerate(found)], columns=out.names)

    return own.select(*keys, "a", "b").groupBy(*keys).applyInPandas(run, out)


def dangling(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that name an unknown node or lead back to their own."""
    known = lambda c: nodes.select(*keys, F.col("node").alias(c))
    bad = edges.join(known("a"), [*keys, "a"], "left_anti").unionByName(edges.join(known("b"), [*keys, "b"], "left_anti")).unionByName(edges.where("a = b"))
    return bad.select(*keys, "a", "b").distinct()


def flaws(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """What is wrong with graphs of nodes (keys, node, seq, reference) and edges (keys, a, b): keys, flaw, what.

    Names that come twice, nodes that have neither bases nor a place on a reference, edges to nodes that aren't there, edges from a node to itself, and
    nodes that lie on cycles or behind them.
    """
    text = lambda c: F.col(c).cast("string")
    row = lambda d, flaw, what: d.select(*keys, F.lit(flaw).alias("flaw"), what.alias("what"))
    arrow = F.concat(text("a"), F.lit(" -> "), text("b"))
    twice = row(nodes.groupBy(*keys, "node").agg(F.count("*").alias("n")).where("n > 1"), "name", text("node"))
    bare = row(nodes.where("seq IS NULL AND reference IS NULL"), "sequence", text("node"))
    known = nodes.select(*keys, "node").distinct()
    lost = edges.join(known.withColumnRenamed("node", "a"), [*keys, "a"], "left_anti").select(*keys, "a", "b").unionByName(edges.join(known.withColumnRenamed("node", "b"), [*keys, "b"], "left_anti").select(*keys, "a", "b")).distinct()
    own = edges.where("a = b").select(*keys, "a", "b").distinct()
    # Nodes without a way in are taken off, again and again; what stays lies on a cycle or behind one.
    left = cut(edges.where("a <> b").select(*keys, "a", "b").distinct())
    while True:
        stuck = left.select(*keys, F.col("b").alias("a")).distinct()
        new = cut(left.join(stuck, [*keys, "a"], "left_semi"))
        if new.count() == left.count():
            break
        left = new
    return twice.unionByName(bare).unionByName(row(lost, "unknown node", arrow)).unionByName(row(own, "self", arrow)).unionByName(row(left.select(*keys, "b").distinct(), "cycle", text("b")))


def united(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two tables of graphs as one: nodes, edges and paths, each different row once; the labels of an edge that both have are put together."""
    out = {k: first[k].unionByName(second[k]) for k in first if k in second} | {k: d for k, d in [*first.items(), *second.items()] if not (k in first and k in second)}
    for k, d in out.items():
        if "labels" in d.columns:
            rest = [c for c in d.columns if c != "labels"]
            out[k] = d.groupBy(*rest).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))
        else:
            out[k] = d.distinct()
    return out


def without_nodes(edges: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Edges after nodes are removed: each pair of an edge in and an edge out becomes one.

    Its labels are those on both, those that come in and never go out, and those that go out and never came in.
    """
    gone = gone.select(*keys, F.col("node"))
    into = edges.join(gone.withColumnRenamed("node", "b"), [*keys, "b"]).select(*keys, F.col("b").alias("mid"), "a", F.col("labels").alias("in_labels"))
    out = edges.join(gone.withColumnRenamed("node", "a"), [*keys, "a"]).select(*keys, F.col("a").alias("mid"), F.col("b"), F.col("labels").alias("out_labels"))
    union = lambda d, c, n: d.groupBy(*keys, "mid").agg(F.array_distinct(F.flatten(F.collect_list(c))).alias(n))
    both = into.join(out, [*keys, "mid"]).join(union(into, "in_labels", "all_in"), [*keys, "mid"]).join(union(out, "out_labels", "all_out"), [*keys, "mid"])
    joined = both.select(*keys, "a", "b", label_algebra(F.col("in_labels"), F.col("out_labels"), F.col("all_in"), F.col("all_out")).alias("labels"))
    rest = edges.join(gone.withColumnRenamed("node", "a"), [*keys, "a"], "left_anti").join(gone.withColumnRenamed("node", "b"), [*keys, "b"], "left_anti")
    every = rest.select(*keys, "a", "b", "labels").unionByName(joined)
    return every.groupBy(*keys, "a", "b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))


def label_algebra(into: Column, out: Column, all_in: Column, all_out: Column) -> Column:
    return F.array_sort(F.array_union(F.array_intersect(into, out), F.array_union(F.array_except(into, all_out), F.array_except(out, all_in))))


def adjacent_edges(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Edges between segments where one begins right after another ends."""
    left = segments.select(*keys, F.col("id").alias("a"), (F.col("stop") + 1).alias("_at"))
    right = segments.select(*keys, F.col("id").alias("b"), F.col("start").alias("_at"))
    return left.join(right, [*keys, "_at"]).select(*keys, "a", "b")


def split_long(nodes: DataFrame, longest: int, padding: int) -> DataFrame:
    """Nodes longer than ``longest`` become their first and last ``padding`` bases."""
    whole = F.array(F.struct(F.lit("").alias("part"), F.col("start").alias("start"), F.col("stop").alias("stop")))
    ends = F.array(
        F.struct(F.lit("left").alias("part"), F.col("start").alias("start"), (F.col("start") + padding - 1).alias("stop")),
        F.struct(F.lit("right").alias("part"), (F.col("stop") - padding + 1).alias("start"), F.col("stop").alias("stop")),
    )
    parts = F.when(F.col("stop") - F.col("start") + 1 > longest, ends).otherwise(whole)
    return nodes.withColumn("p", F.explode(parts)).drop("start", "stop").select("*", "p.part", "p.start", "p.stop").drop("p")


def split_at(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Nodes (id, start, stop) cut before each offset of ``cuts`` (id, offset from the node's start)."""
    inner = cuts.join(nodes, "id").where((F.col("offset") > 0) & (F.col("start") + F.col("offset") <= F.col("stop"))).select("id", (F.col("start") + F.col("offset")).alias("at"))
    begins = inner.unionByName(nodes.select("id", F.col("start").alias("at"))).distinct()
    ends = F.lead("at").over(Window.partitionBy("id").orderBy("at"))
    return begins.withColumn("next", ends).join(nodes.select("id", "stop"), "id").select("id", F.col("at").alias("start"), F.coalesce(F.col("next") - 1, "stop").alias("stop"))


def levels(edges: DataFrame, keys: list[str], guard: int = 1 << 20) -> DataFrame:
    """Longest distance from a source for each node of graphs without cycles; a path of over ``guard`` edges raises."""
    nodes = edges.select(*keys, F.col("a").alias("node")).unionByName(edges.select(*keys, F.col("b").alias("node"))).distinct()
    found = cut(nodes.withColumn("level", F.lit(0)))
    edges = edges.select(*keys, "a", "b")
    for _ in range(guard):
        step = found.withColumnRenamed("node", "a").join(edges, [*keys, "a"]).select(*keys, F.col("b").alias("node"), (F.col("level") + 1).alias("level"))
        new = cut(found.unionByName(step).groupBy(*keys, "node").agg(F.max("level").alias("level")))
        if new.exceptAll(found).isEmpty():
            return found
        found = new
    raise ValueError(f"a path has over {guard} edges, or the graph has a cycle")


def reachable(edges: DataFrame, keys: list[str], guard: int = 1 << 30) -> DataFrame:
    """Pairs of nodes (a, b) with a path of at least one edge between them; lengths double in each round, until a round adds nothing.

    A graph whose longest way is over twice ``guard`` raises.
    """
    found = cut(edges.select(*keys, "a", "b").distinct())
    size, longest = -1, 1
    while (now := found.count()) > size:
        if longest > 4 * guard:
            raise ValueError(f"ways are longer than {guard} edges")
        size, longest = now, 2 * longest
        on = found.select(*keys, F.col("a").alias("mid"), "b")
        found = cut(found.unionByName(found.withColumnRenamed("b", "mid").join(on, [*keys, "mid"]).select(*keys, "a", "b")).distinct())
    return found


def allele_lengths(edges: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Summed length of the nodes that carry a label both on an edge in and on an edge out."""
    into = edges.select(*keys, F.col("b").alias("node"), "label").distinct()
    out = edges.select(*keys, F.col("a").alias("node"), "label").distinct()
    return into.intersect(out).join(lengths, [*keys, "node"]).groupBy(*keys, "label").agg(F.sum("length").alias("length"), F.count("*").alias("nodes"))


def combinable(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges whose start has no other way out and whose end no other way in: their nodes can be merged."""
    out = edges.groupBy(*keys, "a").agg(F.count("*").alias("n_out"))
    into = edges.groupBy(*keys, "b").agg(F.count("*").alias("n_in"))
    return edges.join(out.where("n_out = 1").drop("n_out"), [*keys, "a"], "left_semi").join(into.where("n_in = 1").drop("n_in"), [*keys, "b"], "left_semi")


def event_type(start: Column, end: Column, ins: Column, flank: Column) -> Column:
    """The template that an event needs: an insertion, or a deletion or swap, long if over two flanks."""
    size = end - start + 1
    has = F.coalesce(F.char_length(ins), F.lit(0)) > 0
    return F.when(has & (size <= 0), "ins").when(size <= 2 * flank, F.when(has, "swap").otherwise("del")).otherwise(F.when(has, "longswap").otherwise("longdel"))


#: Edges of each template.
TEMPLATES = {
    "del": ("LF_MID", "MID_RF", "LF_RF"),
    "swap": ("LF_RF", "LF_MID", "MID_RF", "LF_INS", "INS_RF"),
    "ins": ("LF_INS", "INS_RF", "LF_RF"),
    "longdel": ("LF_MID_L", "MID_R_RF", "LF_RF"),
    "longswap": ("LF_RF", "LF_MID_L", "MID_R_RF", "LF_INS", "INS_RF"),
}


def template_edges(kind: Column) -> Column:
    found = F.array().cast("array<string>")
    for name, edges in TEMPLATES.items():
        found = F.when(kind == name, F.array(*map(F.lit, edges))).otherwise(found)
    return found


def path_sequences(paths: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Bases along each path (rows of path, place, node)."""
    rows = paths.join(nodes, [*keys, "node"]).groupBy(*keys, "path").agg(F.sort_array(F.collect_list(F.struct("place", "seq"))).alias("parts"))
    return rows.select(*keys, "path", F.array_join(F.transform("parts", lambda p: p["seq"]), "").alias("seq"), F.size("parts").alias("n_nodes"))


def short_label(seq: Column) -> Column:
    """For drawings: sequences over 30 bases as their first and last 14."""
    return F.when(F.char_length(seq) > 30, F.concat(F.substring(seq, 1, 14), F.lit("..."), F.right(seq, F.lit(14)))).otherwise(seq)


def unique_kmers(paths: DataFrame, k: int) -> DataFrame:
    """K-mers that occur once over all paths (id, seq), with their place."""
    rows = paths.select("id", F.explode(sequence.kmers(F.col("seq"), k)).alias("w")).select("id", "w.pos", "w.kmer")
    once = rows.groupBy("kmer").agg(F.count("*").alias("n")).where("n = 1").select("kmer")
    return rows.join(once, "kmer")
