"""Sequence graphs from variants: reference segments, alternative nodes and labelled edges, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def graph_nodes(variants: DataFrame, keys: list[str], *, padding: int = 150) -> DataFrame:
    """Nodes (kind, name, start, stop, seq) of the graph of each block of variants (id, start, stop, alt; stop = start - 1 inserts).

    The reference from ``padding`` before the first variant to ``padding`` behind the last is cut at
    every variant's ends; each alternative with bases is a node of its own.
    """
    span = variants.groupBy(*keys).agg(F.greatest(F.min("start") - padding, F.lit(0)).alias("low"), (F.max("stop") + padding + 1).alias("high"))
    ends = F.explode(F.array(F.col("start"), F.col("stop") + 1)).alias("at")
    cuts = variants.select(*keys, ends).unionByName(span.select(*keys, F.explode(F.array("low", "high")).alias("at"))).distinct()
    stop = F.lead("at").over(Window.partitionBy(*keys).orderBy("at")) - 1
    ref = cuts.withColumn("stop", stop).where("stop IS NOT NULL").select(*keys, F.lit("ref").alias("kind"), F.col("at").alias("start"), "stop", F.lit(None).cast("string").alias("seq"))
    ref = ref.withColumn("name", F.concat(F.lit("ref-"), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string")))
    alt = variants.where("alt <> ''").select(*keys, F.lit("alt").alias("kind"), "start", "stop", F.col("alt").alias("seq")).distinct()
    alt = alt.withColumn("name", F.concat(F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit(":"), F.col("seq")))
    return ref.select(*keys, "kind", "name", "start", "stop", "seq").unionByName(alt.select(*keys, "kind", "name", "start", "stop", "seq"))


def graph_edges(nodes: DataFrame, variants: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b, label): along the reference, over each alternative, and past each deletion."""
    ref = nodes.where("kind = 'ref'")
    left = ref.select(*keys, F.col("name").alias("a"), (F.col("stop") + 1).alias("at"))
    right = ref.select(*keys, F.col("name").alias("b"), F.col("start").alias("after"))
    along = left.join(right.withColumnRenamed("after", "at"), [*keys, "at"]).select(*keys, "a", "b", F.lit("REF").alias("label"))
    alt = nodes.where("kind = 'alt'").select(*keys, "name", F.col("start").alias("at"), (F.col("stop") + 1).alias("after"))
    into = alt.join(left, [*keys, "at"]).select(*keys, "a", F.col("name").alias("b"), F.lit("ALT").alias("label"))
    out = alt.join(right, [*keys, "after"]).select(*keys, F.col("name").alias("a"), "b", F.lit("ALT").alias("label"))
    gone = variants.where("alt = '' AND stop >= start").select(*keys, F.col("start").alias("at"), (F.col("stop") + 1).alias("after")).distinct()
    past = gone.join(left, [*keys, "at"]).join(right, [*keys, "after"]).select(*keys, "a", "b", F.lit("ALT").alias("label"))
    return along.unionByName(into).unionByName(out).unionByName(past).distinct()


def block_ids(blocks: DataFrame, digests: DataFrame) -> DataFrame:
    """Blocks (file, chrom, block, ...) with block_id: file, its digest, and the block's number, from 1 by contig and block.

    Blocks are numbered within their contig; counts of contigs, few rows a file, give where a contig begins.
    """
    known = blocks.select("file", "chrom", "block").distinct()
    sizes = known.groupBy("file", "chrom").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("chrom")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("file", "chrom").orderBy("block"))
    ids = known.withColumn("place", place).join(starts, ["file", "chrom"]).join(digests, "file")
    text = F.concat("file", F.lit("@"), "digest", F.lit(":"), (F.col("before") + F.col("place")).cast("string"))
    return blocks.join(ids.select("file", "chrom", "block", text.alias("block_id")), ["file", "chrom", "block"])
