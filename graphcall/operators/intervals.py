"""Interval joins, islands, sweeps and splits without nested loops over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcall.operators import ordered


def binned(rows: DataFrame, start: Column, stop: Column, width: int, name: str = "bin") -> DataFrame:
    """A row for each bin of ``width`` that the closed interval touches."""
    return rows.withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, stop) / width))))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], *, width: int) -> DataFrame:
    """Pairs of closed intervals (start, stop) and (r_start, r_stop) that overlap and agree on ``on``.

    Both sides are dealt to bins and equi-joined; a pair is kept in the bin where the later of the two
    begins only, so no pair comes twice and nothing is deduplicated.
    """
    a = binned(left, F.col("start"), F.col("stop"), width, "_bin")
    b = binned(right, F.col("r_start"), F.col("r_stop"), width, "_bin")
    home = F.floor(F.greatest("start", "r_start") / width) == F.col("_bin")
    return a.join(b, [*on, "_bin"]).where((F.col("start") <= F.col("r_stop")) & (F.col("r_start") <= F.col("stop")) & home).drop("_bin")


def _numbered(rows: DataFrame, keys: list[str], order: list[str], fresh: Column, name: str) -> DataFrame:
    """Sliced rows with the number of fresh rows up to each."""
    return ordered.running(rows.withColumn("_fresh", fresh.cast("long")), keys, order, sums={name: F.col("_fresh")}).drop("_fresh", "_slice", "_before")


def islands(rows: DataFrame, keys: list[str], *, slack: int = 0) -> DataFrame:
    """``rows`` with ``island``: intervals whose start is within ``slack`` of an earlier stop share one."""
    order = ["start", "stop", "id"]
    rows = ordered.running(ordered.sliced(rows, keys, order), keys, order, max_before={"_before": F.col("stop")})
    return _numbered(rows, keys, order, F.col("_before").isNull() | (F.col("start") > F.col("_before") + slack), "island")


def merged(rows: DataFrame, keys: list[str], *, slack: int = 0) -> DataFrame:
    """The union of intervals as disjoint intervals."""
    return islands(rows, keys, slack=slack).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("island")


def _depths(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sliced rows of each place where an interval starts or has just stopped: pos, step and the depth from there on."""
    steps = rows.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct((F.col("stop") + 1).alias("pos"), F.lit(-1).alias("step")))).alias("s"))
    steps = ordered.sliced(steps.groupBy(*keys, "s.pos").agg(F.sum("s.step").alias("step")), keys, ["pos"])
    return ordered.running(steps, keys, ["pos"], sums={"depth": F.col("step")})


def sweep(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Depth from each position where it changes: +1 at a start, -1 after a stop, summed in order."""
    return _depths(rows, keys).where("step <> 0").drop("step", "_slice")


def split_at_boundaries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Elementary segments between all starts and ends, with how many intervals cover each; gaps are left out."""
    cuts = ordered.running(_depths(rows, keys), keys, ["pos"], leads={"next": F.col("pos")})
    return cuts.where("next IS NOT NULL AND depth > 0").select(*keys, F.col("pos").alias("start"), (F.col("next") - 1).alias("stop"), F.col("depth").alias("cover"))


def blocks_by_gap(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """``rows`` with ``block``: a new one starts where a start lies over ``gap`` beyond the stop of the row before."""
    order = ["start", "id"]
    rows = ordered.running(ordered.sliced(rows, keys, order), keys, order, lags={"_before": F.col("stop")})
    return _numbered(rows, keys, order, F.coalesce(F.col("start") > F.col("_before") + gap, F.lit(True)), "block")


def split_records(rows: DataFrame, mode: str, *, gap: int = 150) -> DataFrame:
    """Records (chrom, start, stop, id, name) with ``block``, numbered from 1 in the order of the file: by contig, start and id.

    "full" is one block 0, "lines" one for each record, "by_id" one for neighbours of one name (records without a name are alone), "superloci" one for
    records of a contig no more than ``gap`` behind the end of the one before.
    """
    if mode == "full":
        return rows.withColumn("block", F.lit(0).cast("long"))
    order = ["chrom", "start", "id"]
    rows = rows.withColumn("_all", F.lit(0))
    sliced = ordered.sliced(rows, ["_all"], order)
    if mode == "lines":
        fresh, lags = F.lit(True), {}
    elif mode == "by_id":
        fresh, lags = F.col("name").isNull() | F.col("_lag.name").isNull() | (F.col("name") != F.col("_lag.name")), {"_lag": F.struct("name")}
    elif mode == "superloci":
        fresh, lags = F.col("_lag").isNull() | (F.col("_lag.chrom") != F.col("chrom")) | (F.col("start") > F.col("_lag.stop") + gap), {"_lag": F.struct("chrom", F.greatest("start", "stop").alias("stop"))}
    else:
        raise ValueError(f"unknown mode: {mode}")
    if lags:
        sliced = ordered.running(sliced, ["_all"], order, lags=lags)
    found = ordered.running(sliced.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("long")), ["_all"], order, sums={"block": F.col("_fresh")})
    return found.drop("_all", "_slice", "_fresh", "_lag")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``run``: adjacent rows of equal ``value`` share one."""
    rows = ordered.running(ordered.sliced(rows, keys, order), keys, order, lags={"_before": F.struct(value)})
    return _numbered(rows, keys, order, F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col(f"_before.{value}")), "run")


def stops_before(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``boundary``: the greatest stop of the rows before, -1 without one."""
    order = ["start", "id"]
    rows = ordered.running(ordered.sliced(rows, keys, order), keys, order, max_before={"boundary": F.col("stop")})
    return rows.withColumn("boundary", F.coalesce("boundary", F.lit(-1))).drop("_slice")


def spread_over_bins(rows: DataFrame, *, width: int, amount: str) -> DataFrame:
    """Shares of ``amount`` by bin, in proportion to each interval's overlap (closed start, open stop)."""
    b = binned(rows, F.col("start"), F.col("stop") - 1, width)
    low, high = F.greatest(F.col("start"), F.col("bin") * width), F.least(F.col("stop"), (F.col("bin") + 1) * width)
    return b.withColumn("share", F.col(amount) * (high - low) / (F.col("stop") - F.col("start")))
