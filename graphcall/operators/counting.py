"""From read supports to fragments, and from fragments to counts of nodes, edges and haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcall.operators import intervals, ordered
from graphcall.operators.storage import cut, dealt, shuffled


def fragments(reads: DataFrame, keys: list[str], *, id_col: str = "fragment_id", elements: str = "element", reverse: str = "is_reverse") -> DataFrame:
    """One row a fragment: reads by strand and the set of elements that any of its reads supports.

    One shuffle, on the fragment; reads are partly counted before it.
    """
    return reads.groupBy(*keys, id_col).agg(
        F.count("*").alias("n_reads"),
        F.count_if(~F.col(reverse)).alias("n_fwd"),
        F.count_if(F.col(reverse)).alias("n_rev"),
        F.array_sort(F.collect_set(elements)).alias("elements"),
    )


def element_counts(frags: DataFrame, keys: list[str]) -> DataFrame:
    """Each fragment counts once for every element it supports; its reads count by strand as a whole."""
    return (
        frags.select(*keys, F.explode("elements").alias("element"), "n_reads", "n_fwd", "n_rev")
        .groupBy(*keys, "element")
        .agg(F.count("*").alias("fragments"), F.sum("n_reads").alias("reads"), F.sum("n_fwd").alias("fwd"), F.sum("n_rev").alias("rev"))
    )


def sequence_counts(frags: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments by the exact set of labels that they are consistent with."""
    return frags.groupBy(*keys, F.array_join("elements", ",").alias("labels")).agg(F.count("*").alias("fragments"))


def spread(frags: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """Mean, median and variance of fragment length over fragments of two reads or more, and fragments by reads."""
    several = F.when(F.col("n_reads") >= 2, length)
    return frags.groupBy(*keys).agg(
        F.avg(several).alias("mean_length"), F.percentile(several, 0.5).alias("median_length"), F.var_pop(several).alias("variance"),
        F.count_if(F.col("n_reads") == 1).alias("single"), F.count_if(F.col("n_reads") == 2).alias("paired"), F.count_if(F.col("n_reads") > 2).alias("multi"),
    )


def strand_depth(bases: DataFrame, keys: list[str], *, quality: str = "qual", reverse: str = "is_reverse") -> DataFrame:
    """Depth and quality-weighted depth by strand: a base of quality q weighs 1 - 10^(-q/10)."""
    weight = 1 - F.pow(F.lit(10.0), -F.col(quality) / 10)
    return bases.groupBy(*keys).agg(
        F.count_if(~F.col(reverse)).alias("depth_fwd"), F.count_if(F.col(reverse)).alias("depth_rev"),
        F.sum(F.when(~F.col(reverse), weight).otherwise(0.0)).alias("weight_fwd"), F.sum(F.when(F.col(reverse), weight).otherwise(0.0)).alias("weight_rev"),
    )


def canonical_alleles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Alleles of a breakpoint that use the same edges are one: REF if it is among them, else the first by name."""
    own = edges.groupBy(*keys, "allele").agg(F.array_join(F.array_sort(F.collect_set("edge")), ";").alias("edges"))
    return own.groupBy(*keys, "edges").agg(
        F.when(F.max((F.col("allele") == "REF").cast("int")) == 1, F.lit("REF")).otherwise(F.min("allele")).alias("canonical"), F.count("*").alias("n_alleles")
    )


def allele_counts(counts: DataFrame, alleles: DataFrame, keys: list[str]) -> DataFrame:
    """Allele counts as sums over the allele's edges; an edge that alleles share counts for each."""
    return counts.join(alleles, [k for k in keys if k in alleles.columns] + ["edge"]).groupBy(*keys, "allele").agg(F.sum("n").alias("n"))


def dense_grid(counts: DataFrame, rows: DataFrame, alleles: DataFrame, keys: list[str], *, value: str = "n") -> DataFrame:
    """Every row of ``rows`` with every allele of its keys; counts that are missing are zero."""
    shared = [c for c in rows.columns if c in alleles.columns]
    return rows.join(alleles, shared).join(counts, [*keys, "allele"], "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def last_of_mates(reads: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One read for each mate slot: the last in the given order."""
    slot = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return reads.withColumn("_row", F.row_number().over(slot)).where("_row = 1").drop("_row")


def capped(reads: DataFrame, keys: list[str], order: list[str], most: int, *, slices: int = 64) -> DataFrame:
    """At most ``most`` reads of each key, the first in order.

    Each slice of a key keeps its own first ones before the key's are ranked, so a key that holds most reads isn't
    sorted in one task; for a small ``most`` Spark cuts groups before their shuffle besides.
    """
    own = Window.partitionBy(*keys, "_slice").orderBy(*order)
    rows = reads.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices))).withColumn("row", F.row_number().over(own)).where(F.col("row") <= most).drop("_slice")
    return rows.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("row") <= most)


def filter_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules])


def coverage(nodes: DataFrame, bases: DataFrame, node: str, *, quality: str = "qual", width: int = 1024) -> DataFrame:
    """One row for each base of each node (``node``, seq): offset, cpos, base, and depth that matches (ref) and differs (other).

    ``bases`` has ``node``, offset, is_ref, is_reverse and a quality. Depths are whole and weighted by quality (w), together and by strand. ``cpos`` counts
    the bases of the nodes before; its running sum goes over ranges of the nodes. Sequences are cut into chunks of ``width``, which are dealt out; a row
    carries its own base only.
    """
    weight = 1 - F.pow(F.lit(10.0), -F.col(quality) / 10)
    cases = {"ref_fwd": F.col("is_ref") & ~F.col("is_reverse"), "ref_rev": F.col("is_ref") & F.col("is_reverse"), "other_fwd": ~F.col("is_ref") & ~F.col("is_reverse"), "other_rev": ~F.col("is_ref") & F.col("is_reverse")}
    depth = bases.groupBy(node, "offset").agg(*[F.count_if(c).alias(n) for n, c in cases.items()], *[F.sum(F.when(c, weight).otherwise(0.0)).alias(f"w{n}") for n, c in cases.items()])
    nodes, size = cut(nodes.select(node, "seq"), "nodes"), F.char_length("seq")
    starts = ordered.sliced(nodes.select(node, size.cast("long").alias("_size"), F.lit(0).alias("_all")), ["_all"], [node])
    starts = ordered.running(starts, ["_all"], [node], sums={"_upto": F.col("_size")}).select(node, (F.col("_upto") - F.col("_size")).alias("_before"))
    chunks = nodes.where(size > 0).join(shuffled(starts), node).select(node, "_before", F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("_chunk", "_part"))
    cells = dealt(chunks).select(node, "_before", "_chunk", "_part", F.explode(F.sequence(F.lit(0), F.char_length("_part") - 1)).alias("_at"))
    cells = cells.select(node, "_before", (F.col("_chunk").cast("long") * width + F.col("_at")).alias("offset"), F.substring(F.col("_part"), F.col("_at") + 1, F.lit(1)).alias("base"))
    rows = cells.join(shuffled(depth), [node, "offset"], "left")
    zero = {n: F.coalesce(n, F.lit(0).cast("long")) for n in cases} | {f"w{n}": F.coalesce(f"w{n}", F.lit(0.0)) for n in cases}
    rows = rows.withColumns(zero)
    both = {f"{w}{n}": F.col(f"{w}{n}_fwd") + F.col(f"{w}{n}_rev") for w in ("", "w") for n in ("ref", "other")}
    kinds = [f"{w}{n}{s}" for w in ("", "w") for n in ("ref", "other") for s in ("", "_fwd", "_rev")]
    return rows.withColumns(both).select(node, "offset", (F.col("_before") + F.col("offset")).alias("cpos"), "base", *kinds)


def fragment_statistics(frags: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of fragments (keys, n_reads, linear, graph: lengths on the reference and on the graph, null where a fragment has none).

    Mean, median and population variance of both lengths over fragments of two reads or more; fragments without a length; fragments of one, two and more reads.
    """
    out = []
    for kind in ("linear", "graph"):
        several = F.when(F.col("n_reads") >= 2, F.col(kind))
        out += [F.avg(several).alias(f"mean_{kind}"), F.percentile(several, 0.5).alias(f"median_{kind}"), F.var_pop(several).alias(f"variance_{kind}"), F.count_if(F.col(kind).isNull()).alias(f"problematic_{kind}")]
    reads = [F.count_if(F.col("n_reads") == 1).alias("single_read"), F.count_if(F.col("n_reads") == 2).alias("paired_read"), F.count_if(F.col("n_reads") > 2).alias("multi_read")]
    return frags.groupBy(*keys).agg(*out, *reads)


def filter_summary(reads: DataFrame, keys: list[str], *, reason: str = "reason") -> DataFrame:
    """How many reads each reason filtered (keys; ``reason`` is null for reads that stay): total, bad_alignment_pct (share of bad_align among all), filtered (map of reason to number)."""
    by = reads.groupBy(*keys, reason).agg(F.count("*").alias("n"))
    named = F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col(reason).isNotNull(), F.struct(reason, "n")))))
    return by.groupBy(*keys).agg(F.sum("n").alias("total"), (F.coalesce(F.sum(F.when(F.col(reason) == "bad_align", F.col("n"))), F.lit(0)) / F.sum("n")).alias("bad_alignment_pct"), named.alias("filtered"))


#: Depths of a pile, by what a read supports and by strand; those with w are weighted.
PILES = ("fwd", "rev", "wfwd", "wrev")


def variant_piles(variants: DataFrame, depth: DataFrame, keys: list[str], *, width: int = 256) -> DataFrame:
    """Variants (keys, id, start, stop and their own depth alt_fwd, alt_rev, alt_wfwd, alt_wrev) with the depth of the reference and of what else was seen over their place.

    ``depth`` has keys, pos and ref_ and other_ columns like those. Both are means over the variant's bases, cut to whole numbers where they aren't weighted; an
    insertion takes the bases on both sides. A variant's own depth is taken off what else was seen, down to zero.
    """
    low, high = F.greatest(F.least("start", "stop"), F.lit(0)), F.greatest("start", "stop")
    spans = variants.withColumns({"r_start": low.cast("long"), "r_stop": high.cast("long")})
    rows = depth.withColumns({"start": F.col("pos").cast("long"), "stop": F.col("pos").cast("long")})
    columns = [f"{kind}_{p}" for kind in ("ref", "other") for p in PILES]
    hit = intervals.overlap_join(rows.select(*keys, "start", "stop", *columns), spans.select(*keys, "id", "r_start", "r_stop"), keys, width=width)
    sums = hit.groupBy(*keys, "id").agg(*[F.sum(c).alias(c) for c in columns])
    out = spans.join(sums, [*keys, "id"], "left").withColumn("_n", F.col("r_stop") - F.col("r_start") + 1)

    def mean(c: str) -> Column:
        value = F.coalesce(F.col(c), F.lit(0)) / F.col("_n")
        return value if "_w" in c else F.floor(value)

    values = {c: mean(c) if c.startswith("ref") else F.greatest(mean(c) - F.col(c.replace("other", "alt")), F.lit(0)) for c in columns}
    return out.withColumns(values).drop("_n", "r_start", "r_stop")
