"""Graphs made from graphs: chains of nodes merged, variants called on nodes as nodes of their own, graphs of haplotypes, and the depth-first order of nodes.

Nodes are rows of keys, node, chrom, start, stop (closed; stop = start - 1 is empty), is_ref, seq (null for the reference) and labels (sorted array);
edges of keys, a, b and labels. All graphs of a table are worked on at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphcall.operators import intervals
from graphcall.operators.storage import cut, shuffled


def _named(nodes: DataFrame, keys: list[str], end: str, *columns: str) -> DataFrame:
    """Some columns of nodes, as those of the ``end`` (a or b) of an edge."""
    return nodes.select(*keys, F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])


def links(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, a, b) over which nodes can be merged: no other way out of a or into b, neighbours on the contig, of one kind and with the same labels."""
    pairs = edges.select(*keys, "a", "b").distinct()
    out = pairs.groupBy(*keys, "a").agg(F.count("*").alias("n_out")).where("n_out = 1")
    into = pairs.groupBy(*keys, "b").agg(F.count("*").alias("n_in")).where("n_in = 1")
    rows = pairs.join(out, [*keys, "a"]).join(into, [*keys, "b"])
    columns = ("chrom", "start", "stop", "is_ref", "labels")
    rows = rows.join(_named(nodes, keys, "a", *columns), [*keys, "a"]).join(_named(nodes, keys, "b", *columns), [*keys, "b"])
    same = (F.col("a_chrom") == F.col("b_chrom")) & (F.col("a_stop") + 1 == F.col("b_start")) & (F.col("a_is_ref") == F.col("b_is_ref")) & (F.array_sort("a_labels") == F.array_sort("b_labels"))
    return rows.where(same).select(*keys, "a", "b")


def chain_places(nodes: DataFrame, chain: DataFrame, keys: list[str], guard: int = 64) -> DataFrame:
    """Every node with ``head``, the first node of its chain, and ``place``, its distance from it, for chains of edges (keys, a, b) without forks.

    Pointer jumping: a node points to the one before it; in each round it takes over the pointer of the node that it points to, so a
    chain of n nodes is ranked in log2 n rounds. A cycle never ends and raises.
    """
    before = chain.select(*keys, F.col("b").alias("node"), F.col("a").alias("head"))
    rows = nodes.select(*keys, "node").join(before, [*keys, "node"], "left")
    rows = cut(rows.select(*keys, "node", F.coalesce("head", "node").alias("head"), F.col("head").isNotNull().cast("long").alias("place")))
    for _ in range(guard):
        ahead = rows.select(*keys, F.col("node").alias("head"), F.col("head").alias("_next"), F.col("place").alias("_more"))
        rows = cut(rows.join(ahead, [*keys, "head"]).select(*keys, "node", F.col("_next").alias("head"), (F.col("place") + F.col("_more")).alias("place"), (F.col("_more") > 0).alias("_moved")))
        if rows.where("_moved").isEmpty():
            return rows.drop("_moved")
        rows = rows.drop("_moved")
    raise ValueError("a chain of nodes is a cycle")


def merged(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with every chain of :func:`links` as one node, named as its first one and with the bases of all in order; n_merged counts them."""
    places = cut(chain_places(nodes, links(nodes, edges, keys), keys))
    parts = nodes.join(places, [*keys, "node"]).groupBy(*keys, F.col("head").alias("node")).agg(F.sort_array(F.collect_list(F.struct("place", "start", "stop", "seq"))).alias("_parts"), F.min_by(F.struct("chrom", "is_ref", "labels"), "place").alias("_first"))
    text = F.when(~F.col("_first.is_ref"), F.array_join(F.transform("_parts", lambda p: F.coalesce(p["seq"], F.lit(""))), ""))
    whole = parts.select(*keys, "node", "_first.chrom", F.get("_parts", F.lit(0))["start"].alias("start"), F.element_at("_parts", -1)["stop"].alias("stop"), "_first.is_ref", text.alias("seq"), "_first.labels", F.size("_parts").alias("n_merged"))
    at = lambda end: places.select(*keys, F.col("node").alias(end), F.col("head").alias(f"_{end}"))
    kept = edges.join(at("a"), [*keys, "a"]).join(at("b"), [*keys, "b"]).where("_a <> _b")
    return whole, kept.select(*keys, F.col("_a").alias("a"), F.col("_b").alias("b"), "labels")


def with_variants(nodes: DataFrame, edges: DataFrame, variants: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after variants (keys, node, start, stop, alt; places from 0 in the node, stop = start - 1 inserts) became nodes.

    Nodes (named by text) are cut before and behind each of their variants, all at once; pieces are called node.0, node.1, ... and keep its labels, edges into a node
    lead to its first piece and edges out of it come from its last. A cut at an end leaves an empty piece there. A
    variant is a node beside the pieces it replaces, without labels, an empty one for a deletion; equal variants are one. An insertion without bases, or one that
    reaches over its node, raises.
    """
    size = F.col("stop") - F.col("start") + 1
    own = nodes.select(*keys, "node", F.col("start").alias("_from"), size.alias("_size"), "chrom")
    rows = variants.select(*keys, "node", "start", "stop", F.coalesce("alt", F.lit("")).alias("alt")).distinct().join(shuffled(own), [*keys, "node"])
    wrong = (F.col("start") > F.col("stop") + 1) | ((F.col("start") == F.col("stop") + 1) & (F.col("alt") == "")) | (F.col("start") < 0) | (F.col("stop") >= F.col("_size"))
    rows = cut(rows.where(F.when(wrong, F.raise_error(F.lit("a variant doesn't fit its node")).cast("boolean")).otherwise(True)))
    cuts = rows.select(*keys, "node", F.explode(F.array("start", F.col("stop") + 1)).alias("at")).distinct()
    order = Window.partitionBy(*keys, "node").orderBy("at")
    # One piece before each cut, and one behind the last.
    ends = cuts.withColumns({"piece": F.row_number().over(order) - 1, "low": F.coalesce(F.lag("at").over(order), F.lit(0)), "high": F.col("at") - 1})
    last = cuts.groupBy(*keys, "node").agg(F.max("at").alias("low"), F.count("*").cast("int").alias("piece")).join(shuffled(own.select(*keys, "node", (F.col("_size") - 1).alias("high"))), [*keys, "node"])
    pieces = cut(ends.select(*keys, "node", "piece", "low", "high").unionByName(last.select(*keys, "node", "piece", "low", "high")))
    name = lambda n, k: F.concat_ws(".", n, k.cast("string"))
    split = pieces.join(shuffled(nodes), [*keys, "node"])
    seq = F.when(~F.col("is_ref"), F.substring(F.col("seq"), (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low") + 1).cast("int")))
    new = split.select(*keys, name(F.col("node"), F.col("piece")).alias("node"), "chrom", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("stop"), "is_ref", seq.alias("seq"), "labels")
    called = F.concat("node", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit(":"), "alt")
    none = F.array().cast("array<string>")
    made = rows.select(*keys, called.alias("node"), "chrom", (F.col("_from") + F.col("start")).alias("start"), (F.col("_from") + F.col("stop")).alias("stop"), F.lit(False).alias("is_ref"), F.col("alt").alias("seq"), none.alias("labels"))
    rest = nodes.join(shuffled(pieces.select(*keys, "node").distinct()), [*keys, "node"], "left_anti")
    out_nodes = rest.select(*made.columns).unionByName(new).unionByName(made)

    tail = last.select(*keys, F.col("node").alias("a"), name(F.col("node"), F.col("piece")).alias("_a"))
    head = last.select(*keys, F.col("node").alias("b"), name(F.col("node"), F.lit(0)).alias("_b"))
    kept = edges.join(shuffled(tail), [*keys, "a"], "left").join(shuffled(head), [*keys, "b"], "left").select(*keys, F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "labels")
    along = pieces.where("piece > 0").select(*keys, name(F.col("node"), F.col("piece") - 1).alias("a"), name(F.col("node"), F.col("piece")).alias("b"), none.alias("labels"))
    into = rows.join(shuffled(ends.select(*keys, "node", F.col("at").alias("start"), "piece")), [*keys, "node", "start"]).select(*keys, name(F.col("node"), F.col("piece")).alias("a"), called.alias("b"), none.alias("labels"))
    behind = ends.select(*keys, "node", (F.col("at") - 1).alias("stop"), (F.col("piece") + 1).alias("piece"))
    out = rows.join(shuffled(behind), [*keys, "node", "stop"]).select(*keys, called.alias("a"), name(F.col("node"), F.col("piece")).alias("b"), none.alias("labels"))
    return out_nodes, kept.unionByName(along).unionByName(into).unionByName(out)


def depth_first_order(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with ``place`` in the order that a depth-first walk leaves them, turned around: walks start at nodes in their order and follow smaller nodes first.

    A cycle raises. The order is one walk through a graph, so a graph is a group; graphs are small, their number is not.
    """
    own = nodes.select(*keys, "node", F.lit(None).cast(nodes.schema["node"].dataType).alias("b")).unionByName(edges.select(*keys, F.col("a").alias("node"), "b"))
    out = T.StructType([*nodes.select(*keys, "node").schema, T.StructField("place", T.IntegerType())])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        after: dict = {n: [] for n in rows["node"][rows["b"].isna()]}
        for a, b in zip(rows["node"], rows["b"], strict=True):
            if not pd.isna(b):
                after.setdefault(a, []).append(type(a)(b) if not isinstance(b, str) else b)
        for ways in after.values():
            ways.sort()
        state, left = dict.fromkeys(after, 0), []
        for start in sorted(after):
            stack = [] if state[start] else [start]
            while stack:
                node = stack[-1]
                state[node] = 1
                following = after[node]
                while following and state.setdefault(following[0], 0) == 2:
                    following.pop(0)
                if not following:
                    state[node] = 2
                    left.append(stack.pop())
                elif state[following[0]] == 1:
                    raise ValueError(f"graph has a cycle at {node} -> {following[0]}")
                else:
                    after.setdefault(following[0], [])
                    stack.append(following[0])
        left.reverse()
        return pd.DataFrame([(*key, n, k) for k, n in enumerate(left)], columns=out.names)

    return own.groupBy(*keys).applyInPandas(run, out)


def haplotype_edges(nodes: DataFrame, keys: list[str], *, alleles: bool = False) -> DataFrame:
    """Edges (keys, a, b, labels) of graphs of reference and alternative nodes, whose labels are the haplotypes that carry them.

    The reference's nodes follow each other. Each haplotype walks through its nodes in order of place and labels the steps between neighbours. An
    alternative without a way in or out is linked to the reference there; with ``alleles`` set, every one is linked to the reference before it and to every node that
    begins behind it, but insertions not to insertions. A haplotype that no step leads out of one of its nodes, or into it, may take
    all ways there are; ways out are opened first, and what they open counts for ways in.
    """
    place = cut(nodes.select(*keys, "node", "start", "stop", "is_ref", "labels"), "haplotype-nodes")
    end = lambda d, e, at: d.select(*keys, F.col("node").alias(e), F.col("is_ref").alias(f"{e}_ref"), (F.col("stop") < F.col("start")).alias(f"{e}_empty"), at.alias("at"))
    left, right = end(place, "a", F.col("stop") + 1), end(place, "b", F.col("start"))
    # Pairs of alternatives that no edge can come from are left out at once: at one place they are all pairs.
    wanted = "a_ref OR b_ref OR NOT (a_empty AND b_empty)" if alleles else "a_ref OR b_ref"
    touching = cut(left.join(right, [*keys, "at"]).where("a <> b").where(wanted).drop("at"), "touching-nodes")
    along = touching.where("a_ref AND b_ref AND NOT a_empty AND NOT b_empty").select(*keys, "a", "b")

    carried = place.select(*keys, "node", "start", "stop", F.explode("labels").alias("label")).where("label IS NOT NULL").distinct()
    order = Window.partitionBy(*keys, "label").orderBy("start", "stop", "node")
    following = carried.withColumns({"b": F.lead("node").over(order), "next": F.lead("start").over(order)})
    steps = cut(following.where(F.col("next") == F.col("stop") + 1).select(*keys, F.col("node").alias("a"), "b", "label"), "haplotype-steps")

    alts = touching.where("NOT b_ref AND a_ref"), touching.where("NOT a_ref AND b_ref")
    if alleles:
        beyond = touching.where("NOT a_ref AND NOT b_ref")
        plain = alts[0].select(*keys, "a", "b").unionByName(alts[1].select(*keys, "a", "b")).unionByName(beyond.select(*keys, "a", "b"))
    else:
        into = alts[0].join(steps.select(*keys, "b").distinct(), [*keys, "b"], "left_anti")
        out = alts[1].join(steps.select(*keys, "a").distinct(), [*keys, "a"], "left_anti")
        plain = into.select(*keys, "a", "b").unionByName(out.select(*keys, "a", "b"))
    pairs = cut(along.unionByName(plain).unionByName(steps.select(*keys, "a", "b")).distinct(), "haplotype-edges")

    who = carried.select(*keys, "node", "label")
    stuck = who.join(steps.select(*keys, F.col("a").alias("node"), "label"), [*keys, "node", "label"], "left_anti")
    opened = cut(pairs.join(stuck.withColumnRenamed("node", "a"), [*keys, "a"]).select(*keys, "a", "b", "label"), "open-ways")
    reached = steps.select(*keys, F.col("b").alias("node"), "label").unionByName(opened.select(*keys, F.col("b").alias("node"), "label")).distinct()
    lone = who.join(reached, [*keys, "node", "label"], "left_anti")
    entered = pairs.join(lone.withColumnRenamed("node", "b"), [*keys, "b"]).select(*keys, "a", "b", "label")
    labelled = steps.unionByName(opened).unionByName(entered).groupBy(*keys, "a", "b").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return pairs.join(labelled, [*keys, "a", "b"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def _each(labels: str) -> Column:
    """A row ``_one`` for each label, null for a row without labels."""
    return F.explode_outer(F.transform(labels, lambda x: F.struct(x.alias("label")))).alias("_one")


def _sets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of :func:`_each` as one sorted array a key; equal ones are met before their shuffle."""
    return rows.groupBy(*keys).agg(F.array_sort(F.transform(F.collect_set("_one"), lambda x: x["label"])).alias("labels"))


def haplotype_nodes(variants: DataFrame, keys: list[str], chrom: Column, *, padding: int = 150) -> DataFrame:
    """Reference and alternative nodes of graphs of variants (keys, start, stop, alt, haplotypes, ref_haplotypes), with the haplotypes that carry them as labels.

    The reference, ``padding`` before and behind, is cut at every variant's ends; a piece is labelled by whoever carries the reference at a variant over it.
    Alternatives are one for each place and bases; a deletion is a node without bases.
    """
    span = variants.groupBy(*keys).agg(F.greatest(F.min("start") - padding, F.lit(0)).alias("low"), (F.max("stop") + padding + 1).alias("high"))
    cuts = variants.select(*keys, F.explode(F.array("start", F.col("stop") + 1)).alias("start")).unionByName(span.select(*keys, F.explode(F.array("low", "high")).alias("start"))).distinct()
    order = Window.partitionBy(*keys).orderBy("start")
    pieces = cut(cuts.withColumns({"stop": F.lead("start").over(order) - 1, "_n": F.row_number().over(order)}).where("stop IS NOT NULL"), "pieces")
    none = F.array().cast("array<string>")
    # A variant's own ends are cuts, so what a label's variants cover are whole pieces, from the one that begins with it to the one that ends with it; each is met once.
    support = variants.where("stop >= start").select(*keys, "start", "stop", _each("ref_haplotypes")).where("_one IS NOT NULL").distinct()
    spans = intervals.merged(support.withColumn("id", F.lit(0)), [*keys, "_one"])
    first, last = pieces.select(*keys, "start", F.col("_n").alias("_low")), pieces.select(*keys, "stop", F.col("_n").alias("_high"))
    met = spans.join(shuffled(first), [*keys, "start"]).join(shuffled(last), [*keys, "stop"])
    over = _sets(met.select(*keys, "_one", F.explode(F.sequence("_low", "_high")).alias("_n")), [*keys, "_n"])
    place = lambda p: F.concat_ws("-", F.lit(p), F.col("start").cast("string"), F.col("stop").cast("string"))
    own = [] if "chrom" in keys else [chrom.alias("chrom")]
    ref = pieces.join(shuffled(over), [*keys, "_n"], "left").select(*keys, place("ref").alias("node"), *own, "start", "stop", F.lit(True).alias("is_ref"), F.lit(None).cast("string").alias("seq"), F.coalesce("labels", none).alias("labels"))
    alt = _sets(variants.select(*keys, "start", "stop", "alt", _each("haplotypes")), [*keys, "start", "stop", "alt"])
    return ref.unionByName(alt.select(*keys, F.concat_ws(":", place("alt"), "alt").alias("node"), *own, "start", "stop", F.lit(False).alias("is_ref"), F.col("alt").alias("seq"), "labels"))
