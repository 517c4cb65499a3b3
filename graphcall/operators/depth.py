"""Depth of contigs from samples of their places, until it settles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcall.operators import intervals
from graphcall.operators.storage import cut


def _pieces(contigs: DataFrame, longest: int, most: int) -> DataFrame:
    """Contigs halved until their pieces are at most ``longest`` bases, or ``most`` and more: contig, piece, low, high."""
    halvings = F.least(F.ceil(F.log2(F.greatest(F.col("length") / longest, F.lit(1.0)))), F.ceil(F.log2(F.lit(float(most))))).cast("int")
    rows = contigs.select("contig", F.col("length").cast("long").alias("length"), F.pow(F.lit(2.0), halvings).cast("long").alias("n")).where("length > 0")
    rows = rows.select("contig", "length", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("piece"))
    edge = lambda k: F.expr(f"length * {k} div n")
    return rows.select("contig", "piece", edge("piece").alias("low"), (edge("(piece + 1)") - 1).alias("high")).where("low <= high")


def sampled(reads: DataFrame, contigs: DataFrame, *, stretch: int = 10_000, longest: int = 2_000_000, pieces: int = 20, rounds: int = 10, settled: float = 0.05) -> DataFrame:
    """Depth of contigs (contig, length) from reads (contig, pos, len): contig, depth_median, depth_variance, read_count, read_length, read_length_unique, rounds, converged.

    A round looks at the next ``stretch`` bases of every piece of every contig that is still open, all disjoint, at places half a read apart. A contig leaves when its
    median moved by less than ``settled``, when it has been seen as a whole, or after ``rounds`` rounds. Depths and lengths are kept as histograms, so a round adds little
    to what is kept. Only the reads over a round's stretches are joined.
    """
    parts = cut(_pieces(contigs, longest, pieces), "contig-pieces")
    reads = reads.select("contig", F.col("pos").cast("long").alias("start"), (F.col("pos") + F.col("len") - 1).cast("long").alias("stop"), F.col("len").cast("long").alias("len"))
    open_, lengths, depths, done = cut(parts.select("contig").distinct().withColumn("before", F.lit(None).cast("double"))), None, None, []
    for k in range(rounds):
        low = F.col("low") + k * stretch
        now = parts.join(open_.select("contig"), "contig").select("contig", low.alias("r_start"), F.least(low + stretch - 1, "high").alias("r_stop"), "high").where("r_start <= high")
        met = cut(intervals.overlap_join(reads, now.drop("high"), ["contig"], width=stretch), "sampled-reads")
        # A read is counted where it begins, or in the first stretch of its piece that it reaches.
        own = met.where((F.col("start") >= F.col("r_start")) | F.lit(k == 0)).groupBy("contig", "len").agg(F.count("*").alias("n"))
        lengths = cut(own if lengths is None else lengths.unionByName(own).groupBy("contig", "len").agg(F.sum("n").alias("n")), "read-lengths")
        steps = lengths.groupBy("contig").agg(F.greatest(F.floor(F.percentile("len", 0.5, F.col("n")) / 2), F.lit(1)).cast("long").alias("step"))
        places = now.drop("high").join(steps, "contig").select("contig", F.explode(F.sequence("r_start", "r_stop", "step")).alias("place"))
        first = F.col("r_start") + F.ceil((F.greatest("start", "r_start") - F.col("r_start")) / F.col("step")) * F.col("step")
        last = F.least("stop", "r_stop")
        hit = met.join(steps, "contig").withColumns({"_a": first.cast("long"), "_b": last}).where("_a <= _b").select("contig", F.explode(F.sequence("_a", "_b", "step")).alias("place"))
        hit = hit.groupBy("contig", "place").agg(F.count("*").alias("depth"))
        new = places.join(hit, ["contig", "place"], "left").groupBy("contig", F.coalesce("depth", F.lit(0).cast("long")).alias("depth")).agg(F.count("*").alias("n"))
        depths = cut(new if depths is None else depths.unionByName(new).groupBy("contig", "depth").agg(F.sum("n").alias("n")), "depths")
        median = depths.groupBy("contig").agg(F.percentile("depth", 0.5, F.col("n")).alias("now"))
        whole = parts.groupBy("contig").agg((F.max(F.col("high") - F.col("low") + 1) <= (k + 1) * stretch).alias("whole"))
        state = open_.join(median, "contig", "left").join(whole, "contig")
        calm = F.coalesce(F.abs(F.col("now") - F.col("before")) < settled, F.lit(False))
        state = cut(state.select("contig", "now", (calm & F.lit(k > 0)).alias("calm"), "whole"), "depth-state")
        leaves = F.col("calm") | F.col("whole") | F.lit(k == rounds - 1)
        done.append(state.where(leaves).select("contig", F.lit(k + 1).alias("rounds"), (F.col("calm") | F.col("whole")).alias("converged")))
        open_ = state.where(~leaves).select("contig", F.col("now").alias("before"))
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    n = F.sum("n")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / n
    var = lambda c: F.sum(F.col(c) * F.col(c) * F.col("n")) / n - mean(c) * mean(c)
    of_depth = depths.groupBy("contig").agg(F.round(F.percentile("depth", 0.5, F.col("n")), 2).alias("depth_median"), F.round(var("depth")).alias("depth_variance"))
    of_length = lengths.groupBy("contig").agg(n.alias("read_count"), F.floor(F.percentile("len", 0.5, F.col("n"))).alias("read_length"), (F.count("*") == 1).alias("read_length_unique"))
    return out.join(of_depth, "contig", "left").join(of_length, "contig", "left").select("contig", "depth_median", "depth_variance", F.coalesce("read_count", F.lit(0).cast("long")).alias("read_count"), "read_length", "read_length_unique", "rounds", "converged")
