"""What a user calls: whole tasks over DataFrames with sample and graph as ordinary columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcall.operators import alignment, building, counting, depth, events, genotyping, graphs, intervals, matching, records, rewriting, vcf
from graphcall.operators.storage import cut

GROUP = ["sample_id", "graph_id"]


def select_reads(reads: DataFrame, regions: DataFrame, *, extension: int = 999, most: int = 10_000, bin_width: int = 4096) -> DataFrame:
    """Reads (sample_id, chrom, pos, len, mate_chrom, mate_pos, ...) that lie, or whose mate lies, near target regions (graph_id, chrom, start, stop), at most ``most`` for each sample and graph."""
    near = regions.select("graph_id", "chrom", F.greatest(F.col("start") - extension, F.lit(0)).alias("r_start"), (F.col("stop") + extension).alias("r_stop"))
    # A read that touches several regions of a graph comes with the first of them only.
    own = near.select("graph_id", "chrom", F.struct("r_start", "r_stop").alias("r")).groupBy("graph_id", "chrom").agg(F.array_sort(F.collect_set("r")).alias("all"))
    near = own.select("graph_id", "chrom", F.posexplode("all").alias("k", "r"), "all").select("graph_id", "chrom", "r.r_start", "r.r_stop", F.slice("all", 1, F.col("k")).alias("earlier"))
    found = matching.near_regions(reads, near, width=bin_width)
    mate = ("mate_chrom", "mate_pos") if "mate_pos" in reads.columns else ("chrom", "pos")
    hit = lambda r: matching.in_region(F.col("pos"), F.col("len"), F.col(mate[0]), F.col(mate[1]), F.col("chrom"), r["r_start"], r["r_stop"])
    found = found.where(~F.exists("earlier", hit)).drop("earlier", "r_start", "r_stop")
    return counting.capped(found, GROUP, ["pos", "fragment_id", "is_first_mate"], most).drop("row")


def mates_to_recover(reads: DataFrame) -> DataFrame:
    return matching.mates_to_recover(reads, [*GROUP, "fragment_id"])


def count_support(supports: DataFrame) -> DataFrame:
    """Supports (sample_id, graph_id, fragment_id, is_reverse, element) to counts of fragments and reads by element."""
    return counting.element_counts(counting.fragments(supports, GROUP), GROUP)


def count_events(reads: DataFrame, event_list: DataFrame, chunks: DataFrame, *, chunk_size: int = 1 << 20) -> DataFrame:
    """Reads (sample_id, graph_id, fragment_id, seq) of events (graph_id, chrom, start, end, ins, flank) to counts of nodes, edges and sequences by sample and event.

    ``chunks`` is the reference in pieces of ``chunk_size`` bases, as ``sources.files.chunked`` makes them.
    """
    return events.count_reads(reads, events.event_graphs(event_list, chunks, chunk_size), GROUP)


def genotype(counts: DataFrame, samples: DataFrame, *, ploidy: int = 2, poisson: bool = False) -> DataFrame:
    """Allele counts (sample_id, graph_id, breakpoint, counts) and samples (depth, depth_sd, read_length) to one call for each graph and sample.

    Samples are joined by their id; adaptive execution broadcasts them where their measured size allows.
    """
    rows = counts.join(samples.select("sample_id", "depth", "depth_sd", "read_length"), "sample_id").withColumn("ploidy", F.lit(ploidy))
    return genotyping.combined(genotyping.called(rows, poisson=poisson), ["graph_id", "sample_id"])


def genotype_records(variants: DataFrame, reads: DataFrame, samples: DataFrame, chunks: DataFrame, names: list, *, chunk_size: int = 1 << 20, flank: int = 150, ploidy: int = 2, kmer: int | None = None, poisson: bool = False) -> DataFrame:
    """Variant records, reads and samples to one call for each record and sample: the columns that ``vcf.sample_fields`` needs, with graph_id and sample_id.

    ``variants``: graph_id (one for each record), chrom, pos, end, ref, alts, inserted. ``reads``: sample_id, chrom, pos, len, fragment_id, is_first_mate, seq, perhaps
    mate_chrom and mate_pos. ``samples``: sample_id, depth, depth_sd, read_length; ``names`` their ids. Each record becomes a graph, reads near it are aligned
    to it, filtered and counted by its breakpoints' alleles, and these are called and combined.
    """
    described = cut(records.record_graphs(variants, chunks, chunk_size, flank=flank), "record-graphs")
    near = select_reads(reads, described.select("graph_id", "chrom", "start", F.greatest("stop", "start").alias("stop")), extension=flank)
    counts = cut(events.count_reads(near.select(*GROUP, "fragment_id", "seq"), described, GROUP, kmer=kmer), "element-counts")
    points = cut(records.breakpoints(described), "breakpoints")
    arrays = records.breakpoint_counts(counts.where("kind = 'edge'"), points, described, names)
    return records.calls_of(arrays, samples, counts.where("kind = 'sequence' AND NOT contains(element, ',')"), ploidy=ploidy, poisson=poisson)


def genotype_vcf(variants: DataFrame, calls: DataFrame, names: list[str], *, id_key: str = vcf.ID_KEY) -> DataFrame:
    """Records (graph_id, chrom, pos, id, ref, alts, qual, filter, info_text, old_gt) with the fields of ``calls``, as ``vcf.write_vcf`` writes them."""
    fields = vcf.sample_fields(calls).select(F.col("graph_id").alias("record"), F.col("sample_id").alias("sample"), "GT", "FT", "DP", "AD", "ADF", "ADR", "PL")
    found = calls.select(F.col("graph_id").alias("record")).distinct().select("record", F.lit(1).cast("long").alias("matches"), F.col("record").cast("string").alias("target"), F.array(F.col("record").cast("string")).alias("targets"))
    return vcf.annotated(variants.withColumnRenamed("graph_id", "record"), found, fields, names, id_key=id_key)


def estimate_depth(reads: DataFrame, contigs: DataFrame, **options) -> DataFrame:
    """Median depth and read length of each contig from samples, until they settle; see :func:`depth.sampled`."""
    return depth.sampled(reads, contigs, **options)


def variant_graphs(variants: DataFrame, *, gap: int = 150, mode: str = "variants") -> tuple[DataFrame, DataFrame]:
    """Variants (id, chrom, start, stop, alt) to nodes and edges of one graph for each block of near variants.

    ``mode`` says what edges follow: each variant by itself ("variants"), the alternatives' neighbours ("alleles"), or the haplotypes of columns
    haplotypes and ref_haplotypes ("haplotypes"); the latter two are graphs of :mod:`rewriting`.
    """
    blocks = intervals.blocks_by_gap(variants, ["chrom"], gap)
    keys = ["chrom", "block"]
    if mode in ("alleles", "haplotypes"):
        nodes = rewriting.haplotype_nodes(blocks.withColumn("_contig", F.col("chrom")), keys, F.col("chrom"), padding=gap)
        return nodes, rewriting.haplotype_edges(nodes, keys, alleles=mode == "alleles")
    if mode != "variants":
        raise ValueError(f"unknown mode: {mode}")
    nodes = building.graph_nodes(blocks, keys, padding=gap)
    return nodes, building.graph_edges(nodes, blocks, keys)


def path_fasta(paths: DataFrame, described: DataFrame) -> DataFrame:
    """Paths (graph_id, path, nodes) of graphs as records of a text: graph_id, path, text, a header with the path's nodes as an alignment string and its bases."""
    rows = alignment.path_sequences(paths, described)
    way = F.array_join(F.transform("nodes", lambda n: F.concat(n["node"].cast("string"), F.lit("["), n["length"].cast("string"), F.lit("M]"))), "")
    return rows.select("graph_id", "path", F.concat(F.lit(">"), F.col("path").cast("string"), F.lit(" "), way, F.lit("\n"), "seq").alias("text"))


def index_bins(slices: DataFrame, width: int) -> DataFrame:
    """Slices of an index (contig, start, span, bytes) to bytes by bin; a slice is shared among its bins by length."""
    rows = slices.where("span > 0").withColumns({"start": F.col("start"), "stop": F.col("start") + F.col("span")})
    return intervals.spread_over_bins(rows, width=width, amount="bytes").groupBy("contig", "bin").agg(F.sum("share").alias("bytes"), F.count("*").alias("slices"))


def kmer_stats(paths: DataFrame, k: int) -> DataFrame:
    return graphs.unique_kmers(paths, k).groupBy("id").agg(F.count("*").alias("unique_kmers"))
