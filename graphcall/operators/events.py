"""From events to graphs, and from aligned reads to what they support and counts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcall.functions import cigar, sequence
from graphcall.operators import alignment, counting, graphs, kmers
from graphcall.operators.storage import cut, shuffled

#: Bases of the nodes that stand before and behind a graph with open ends.
EDGE_NODE = "N" * 10


def interval_sequences(intervals: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """``intervals`` (contig, start, stop, ...; 1-based, closed) with ``seq``, from a reference in chunks of ``size`` bases (contig, chunk_id, seq).

    Each chunk that an interval touches is met by an equi-join; nothing holds a whole contig. Bases off the contig are left out.
    """
    keys = intervals.columns
    first, last = F.floor((F.col("start") - 1) / size), F.floor((F.greatest("stop", "start") - 1) / size)
    rows = intervals.withColumn("chunk_id", F.explode(F.sequence(first, last))).join(chunks.select("contig", F.col("chunk_id").cast("long"), F.col("seq").alias("_chunk")), ["contig", "chunk_id"], "left")
    low = F.greatest(F.col("start") - F.col("chunk_id") * size, F.lit(1))
    high = F.least(F.col("stop") - F.col("chunk_id") * size, F.lit(size))
    part = F.substring(F.col("_chunk"), low.cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int"))
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_id", F.coalesce(part, F.lit("")).alias("part")))).alias("_parts"))
    return rows.select(*keys, F.array_join(F.transform("_parts", lambda p: p["part"]), "").alias("seq"))


def _pieces(kind: Column, start: Column, end: Column, flank: Column) -> Column:
    """The reference intervals (name, start, stop) that an event's template needs, in topological order."""
    left = F.greatest(start - 1 - flank, F.lit(1))
    piece = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.cast("long").alias("start"), b.cast("long").alias("stop"))
    outer = piece("LF", left, F.when(kind == "ins", end - 1).otherwise(start - 1)), piece("RF", end + 1, end + 1 + flank)
    long = F.array(outer[0], piece("MID_L", start, start + flank - 1), piece("MID_R", end - flank, end - 1), outer[1])
    return F.when(kind == "ins", F.array(*outer)).when(kind.isin("del", "swap"), F.array(outer[0], piece("MID", start, end), outer[1])).otherwise(long)


#: Order of the nodes of every template.
NODE_ORDER = ("source", "LF", "MID_L", "MID", "INS", "MID_R", "RF", "sink")


def event_graphs(events: DataFrame, chunks: DataFrame, size: int = 1 << 20, *, flank: int = 150) -> DataFrame:
    """Events (graph_id, chrom, start, end, ins, flank; 1-based, end = start - 1 inserts) to graphs: graph_id, kind, nodes, edges.

    ``nodes`` is an array of struct id, name, seq in topological order, ``edges`` of struct a, b, name, labels. Long events keep only the
    flanks of their middle, and have a source and a sink of Ns.
    """
    rows = events.withColumn("flank", F.coalesce("flank", F.lit(flank))).withColumn("ins", F.coalesce("ins", F.lit("")))
    rows = rows.withColumn("kind", graphs.event_type(F.col("start"), F.col("end"), F.col("ins"), F.col("flank")))
    place = rows.select("graph_id", F.col("chrom").alias("contig"), F.explode(_pieces(F.col("kind"), F.col("start"), F.col("end"), F.col("flank"))).alias("p")).select("graph_id", "contig", "p.*")
    found = interval_sequences(place, chunks, size).groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "seq"))).alias("bases"))
    rows = rows.join(found, "graph_id")
    many = F.col("kind").startswith("long")
    bases = F.map_concat("bases", F.when(F.col("ins") != "", F.create_map(F.lit("INS"), F.upper("ins"))).otherwise(F.create_map().cast("map<string,string>")),
                         F.when(many, F.create_map(F.lit("source"), F.lit(EDGE_NODE), F.lit("sink"), F.lit(EDGE_NODE))).otherwise(F.create_map().cast("map<string,string>")))
    order = F.filter(F.array(*map(F.lit, NODE_ORDER)), lambda n: F.element_at("bases", n).isNotNull())
    rows = rows.withColumn("bases", bases).withColumn("order", order)
    number = lambda n: (F.array_position("order", n) - 1).cast("long")
    has = lambda n: F.array_contains("order", n)
    edge = lambda a, b, label: F.when(has(a) & has(b), F.struct(number(a).alias("a"), number(b).alias("b"), F.lit(f"{a}_{b}").alias("name"), F.array(*([F.lit(label)] if label else [])).cast("array<string>").alias("labels")))
    skip = F.when(F.col("kind") == "ins", edge("LF", "RF", "REF")).otherwise(edge("LF", "RF", "DEL"))
    every = [skip, *(edge(a, b, label) for a, b, label in (("LF", "MID", "REF"), ("MID", "RF", "REF"), ("LF", "INS", "INS"), ("INS", "RF", "INS"), ("LF", "MID_L", "REF"), ("MID_R", "RF", "REF"), ("source", "LF", ""), ("source", "MID_R", ""), ("MID_R", "sink", ""), ("RF", "sink", "")))]
    nodes = F.transform("order", lambda n, k: F.struct(k.cast("long").alias("id"), n.alias("name"), F.element_at("bases", n).alias("seq")))
    return rows.select("graph_id", "kind", nodes.alias("nodes"), F.array_compact(F.array(*every)).alias("edges"))


def described_tables(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node, seq) and edges (graph_id, a, b) of graphs that are rows."""
    nodes = described.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", F.col("n.id").alias("node"), "n.seq")
    return nodes, described.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.a", "e.b")


def read_supports(aligned: DataFrame, described: DataFrame, *, bad_fraction: float = 0.8, unique_only: bool = True, kmer: int | None = None) -> DataFrame:
    """Aligned reads (graph_id, seq, reverse, graph_cigar, is_unique, ...) with status, reason, nodes, edges and sequences that each supports.

    The first rule that holds is a read's reason: nonuniq, bad_align (too few aligned bases), or that of its k-mers, if ``kmer`` asks for
    them: their length, or if negative the number of unique ones that each node and edge must have (see :mod:`kmers`). Such
    reads are BAD_ALIGN and support nothing. A read
    supports a sequence if one of its supported edges has the label and all edges of its path have it.
    """
    keep = aligned.columns
    if kmer is not None:
        aligned = cut(aligned.withColumn("_read", F.monotonically_increasing_id()), "aligned-reads")
    # A row of its own for what is read from the text, so that it is read once and not again by each filter that is moved down.
    path = F.transform(cigar.graph_nodes(F.col("graph_cigar")), lambda n: F.struct(n["node"].alias("node"), n["ops"].alias("ops"), cigar.sums(n["ops"]).alias("sums")))
    told = lambda p: F.struct(p.alias("path"), cigar.sums(F.flatten(F.transform(p, lambda n: n["ops"]))).alias("sums"))
    rows = aligned.select("*", F.explode(F.transform(F.array(path), told)).alias("_told"))
    rows = rows.join(described.select("graph_id", F.col("nodes").alias("_nodes"), F.col("edges").alias("_edges")), "graph_id")
    bad = (F.size("_told.path") == 0) | cigar.few_aligned(F.col("_told.sums"), bad_fraction)
    reason = F.when(~F.col("is_unique") & F.lit(unique_only), "nonuniq").when(bad, "bad_align")
    if kmer is not None:
        nodes, edges = described_tables(described)
        sizes = described.select("graph_id", F.lit(kmer).alias("k")) if kmer > 0 else kmers.covering_length(nodes, edges, -kmer).where("k IS NOT NULL")
        unique = cut(kmers.unique_kmers(kmers.graph_kmers(nodes, edges, sizes)), "unique-kmers")
        told = kmers.filter_reasons(aligned.select("graph_id", F.col("_read").alias("read"), kmers.on_graph(F.col("seq"), F.col("reverse")).alias("seq"), "graph_cigar"), unique)
        rows = rows.join(told.select("graph_id", F.col("read").alias("_read"), F.col("reason").alias("_kmer")), ["graph_id", "_read"], "left")
        reason = F.coalesce(reason, "_kmer")
    rows = rows.withColumn("reason", reason)
    status = F.when(F.col("reason").isNotNull(), "BAD_ALIGN").otherwise("MAPPED")
    node = F.transform("_told.path", lambda n: F.struct(n["sums"].alias("sums"), F.get("_nodes", n["node"])["name"].alias("name"), F.char_length(F.get("_nodes", n["node"])["seq"]).alias("length"), n["node"].alias("node")))
    rows = rows.withColumns({"status": status, "_path": node, "_n": F.char_length("seq")})
    nodes = F.transform(F.filter("_path", lambda n: cigar.node_supported_by(n["sums"], n["length"], F.col("_n"))), lambda n: n["name"])
    pairs = F.zip_with(F.slice("_path", F.lit(1), F.greatest(F.size("_path") - 1, F.lit(0))), F.slice("_path", 2, F.greatest(F.size("_path") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumn("_pairs", F.transform(pairs, lambda p: F.struct(
        F.concat(p["a"]["name"], F.lit("_"), p["b"]["name"]).alias("name"),
        F.flatten(F.transform(F.filter("_edges", lambda e: (e["a"] == p["a"]["node"]) & (e["b"] == p["b"]["node"])), lambda e: e["labels"])).alias("labels"),
        cigar.edge_supported_by(p["a"]["sums"], p["a"]["length"], p["b"]["sums"], p["b"]["length"], F.col("_n")).alias("ok"),
    )))
    sure = F.filter("_pairs", lambda p: p["ok"])
    labels = F.array_distinct(F.flatten(F.transform(sure, lambda p: p["labels"])))
    labels = F.filter(labels, lambda x: F.forall("_pairs", lambda p: F.array_contains(p["labels"], x)))
    none = F.array().cast("array<string>")
    mapped = F.col("status") == "MAPPED"
    return rows.select(
        *keep, "status", "reason",
        F.when(mapped, F.array_sort(F.array_distinct(nodes))).otherwise(none).alias("nodes_supported"),
        F.when(mapped, F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["name"])))).otherwise(none).alias("edges_supported"),
        F.when(mapped, F.array_sort(labels)).otherwise(none).alias("sequences_supported"),
    )


def support_counts(supports: DataFrame, keys: list[str]) -> DataFrame:
    """Supports of reads to (keys, kind, element, fragments, reads, fwd, rev): nodes, edges and sets of sequences, by fragment.

    One shuffle on the fragment gives all three kinds; what any read of a fragment supports, the fragment does.
    """
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    frags = supports.where("status = 'MAPPED'").groupBy(*keys, "fragment_id").agg(
        F.count("*").alias("n_reads"), F.count_if(~F.col("reverse")).alias("n_fwd"), F.count_if("reverse").alias("n_rev"),
        union("nodes_supported").alias("nodes"), union("edges_supported").alias("edges"), union("sequences_supported").alias("sequences"),
    )
    named = lambda kind, c: F.transform(c, lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("element")))
    joined = F.when(F.size("sequences") > 0, F.array(F.array_join("sequences", ","))).otherwise(F.array().cast("array<string>"))
    rows = frags.select(*keys, "n_reads", "n_fwd", "n_rev", F.explode(F.concat(named("node", F.col("nodes")), named("edge", F.col("edges")), named("sequence", joined))).alias("e"))
    return rows.groupBy(*keys, "e.kind", "e.element").agg(F.count("*").alias("fragments"), F.sum("n_reads").alias("reads"), F.sum("n_fwd").alias("fwd"), F.sum("n_rev").alias("rev"))


def count_reads(reads: DataFrame, described: DataFrame, keys: list[str], *, kmer: int | None = None) -> DataFrame:
    """Reads (keys, graph_id, fragment_id, seq) and graphs (as :func:`event_graphs` gives them) to counts of nodes, edges and sequences; ``kmer`` as in :func:`read_supports`.

    What a read supports follows from its graph and its bases, so each different sequence of a graph is aligned and judged once, and reads meet what they support by both.
    """
    plain = described.select("graph_id", F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), n["seq"].alias("seq"))).alias("nodes"), F.transform("edges", lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"))).alias("edges"))
    reads = cut(reads.select(*dict.fromkeys([*keys, "graph_id", "fragment_id", "seq"])), "counted-reads")
    judged = read_supports(alignment.graph_alignments(reads.select("graph_id", "seq").distinct(), plain), described, kmer=kmer).where("status = 'MAPPED'")
    judged = judged.select("graph_id", "seq", "status", "reverse", "nodes_supported", "edges_supported", "sequences_supported")
    return support_counts(reads.join(shuffled(judged), ["graph_id", "seq"]), keys)


def alignment_statistics(supports: DataFrame, described: DataFrame, keys: list[str]) -> DataFrame:
    """Strands, mismatch, gap and clip rates and depth of each node, edge and sequence (keys, kind, element), from mapped reads.

    Rates are over matched, differing and gap bases. Clips at source and sink aren't counted: at either for a node, for
    an edge at its end, and at its start if that is right behind the source. One pass over the reads makes all three kinds.
    """
    rows = supports.where("status = 'MAPPED'").join(described.select("graph_id", F.col("nodes").alias("_nodes"), F.col("edges").alias("_edges")), "graph_id")
    total = cigar.total
    last = F.size("_nodes") - 1
    ends = (F.get("_nodes", F.lit(0))["name"] == "source") | (F.get("_nodes", last)["name"] == "sink")
    rows = rows.withColumn("_has_ends", ends).withColumn("_path", F.transform(cigar.graph_nodes(F.col("graph_cigar")), lambda n: F.struct(
        n["node"].alias("node"), F.get("_nodes", n["node"])["name"].alias("name"), F.char_length(F.get("_nodes", n["node"])["seq"]).alias("length"),
        total(n["ops"], "M=").alias("match"), total(n["ops"], "X").alias("differ"), total(n["ops"], "ID").alias("gap"), total(n["ops"], "S").alias("clip"),
        (F.col("_has_ends") & ((n["node"] == 0) | (n["node"] == last))).alias("edge"),
    )))
    entry = lambda kind, name, length, match, differ, gap, clip: F.struct(
        F.lit(kind).alias("kind"), name.alias("element"), length.cast("long").alias("length"), match.alias("match"), differ.alias("differ"), gap.alias("gap"), clip.alias("clip"))
    nodes = F.transform("_path", lambda n: entry("node", n["name"], n["length"], n["match"], n["differ"], n["gap"], F.when(n["edge"], 0).otherwise(n["clip"])))
    n = F.greatest(F.size("_path") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_path", F.lit(1), n), F.slice("_path", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edges = F.transform(pairs, lambda p: entry(
        "edge", F.concat(p["a"]["name"], F.lit("_"), p["b"]["name"]), p["a"]["length"] + p["b"]["length"], p["a"]["match"] + p["b"]["match"], p["a"]["differ"] + p["b"]["differ"],
        p["a"]["gap"] + p["b"]["gap"], F.when(F.col("_has_ends") & (p["b"]["node"] == 1), p["a"]["clip"]).otherwise(0) + F.when(p["b"]["edge"], p["b"]["clip"]).otherwise(0)))
    sum_of = lambda c: F.aggregate("_path", F.lit(0), lambda s, x: s + x[c])
    clips = F.aggregate("_path", F.lit(0), lambda s, x: s + F.when(x["edge"], 0).otherwise(x["clip"]))
    carried = lambda s: F.filter("_nodes", lambda v: F.exists("_edges", lambda e: (e["b"] == v["id"]) & F.array_contains(e["labels"], s)) & F.exists("_edges", lambda e: (e["a"] == v["id"]) & F.array_contains(e["labels"], s)))
    alleles = F.transform("sequences_supported", lambda s: entry("sequence", s, F.aggregate(carried(s), F.lit(0), lambda t, v: t + F.char_length(v["seq"])), sum_of("match"), sum_of("differ"), sum_of("gap"), clips))
    rows = rows.select(*keys, "reverse", "score", F.explode(F.concat(nodes, edges, alleles)).alias("e"))
    out = rows.groupBy(*keys, "e.kind", "e.element").agg(
        F.count_if(~F.col("reverse")).alias("fwd"), F.count_if("reverse").alias("rev"), F.sum("e.match").alias("match"), F.sum("e.differ").alias("differ"),
        F.sum("e.gap").alias("gap"), F.sum("e.clip").alias("clip"), F.max("e.length").alias("length"), F.avg("score").alias("avg_score"),
    )
    bases = F.col("match") + F.col("differ") + F.col("gap")
    rate = lambda c: F.when(bases > 0, F.col(c) / bases)
    return out.select(*keys, "kind", "element", "fwd", "rev", rate("differ").alias("mismatch_rate"), rate("gap").alias("gap_rate"), rate("clip").alias("clip_rate"),
                      F.when(F.col("length") > 0, F.col("match") / F.col("length")).alias("match_base_depth"), "length", F.when(F.col("kind") == "sequence", F.col("avg_score")).alias("avg_score"))


def select_outputs(counts: DataFrame, options: set[str]) -> DataFrame:
    """Only the kinds of counts that output options name: node_read_counts, edge_read_counts, path_read_counts."""
    wanted = {"node_read_counts": "node", "edge_read_counts": "edge", "path_read_counts": "sequence"}
    unknown = options - set(wanted)
    if unknown:
        raise ValueError(f"unknown output options: {sorted(unknown)}")
    return counts.where(F.col("kind").isin(*[wanted[o] for o in sorted(options)]))


def normalised(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("seq", sequence.normalise_bases(F.col("seq")))
