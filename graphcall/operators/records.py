"""From variant records to calls in a file: a graph for each record, counts of its breakpoints' alleles, calls, and the record's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcall.operators import alleles, events, genotyping
from graphcall.operators.storage import cut, dealt


def allele_names(n_alts: Column) -> Column:
    """REF, ALT1, ALT2, ..."""
    return F.concat(F.array(F.lit("REF")), F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n_alts, F.lit(1))), F.lit(2), n_alts), lambda k: F.concat(F.lit("ALT"), k.cast("string"))))


def spans(records: DataFrame) -> DataFrame:
    """Records (chrom, pos, end, ref, alts; 1-based) with ``pad`` (whether their first base is only an anchor), ``start`` and ``stop`` of what they change; stop = start - 1 inserts."""
    pad = F.exists("alts", lambda a: a.startswith("<") | (F.char_length(a) != F.char_length("ref"))).cast("int")
    return records.withColumn("pad", pad).withColumns({"start": F.col("pos") + F.col("pad"), "stop": F.col("end").cast("long")})


def record_graphs(records: DataFrame, chunks: DataFrame, size: int, *, flank: int = 150) -> DataFrame:
    """Records (graph_id, chrom, pos, end, ref, alts, inserted: what <INS> stands for) to graphs: graph_id, chrom, start, stop, n_alts, nodes, edges.

    Nodes are LF, RF and one for each allele with bases; the reference's is cut to its two ends (REF_L, REF_R) if it is longer than two flanks. Edges
    carry the names of the alleles (REF, ALT1, ...) that go over them; alleles without bases go from LF to RF. ``nodes`` and
    ``edges`` are as :func:`events.event_graphs` makes them. Bases come from a reference in chunks of ``size``.
    """
    rows = cut(spans(records.select("graph_id", "chrom", F.col("pos").cast("long").alias("pos"), F.col("end").cast("long").alias("end"), F.upper("ref").alias("ref"), F.transform("alts", lambda a: F.upper(a)).alias("alts"), F.upper("inserted").alias("inserted"))), "records")
    n = F.col("stop") - F.col("start") + 1
    piece = lambda name, a, b, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("name"), a.cast("long").alias("start"), b.cast("long").alias("stop")))
    long = n > 2 * flank
    turned = F.exists("alts", lambda a: a.isin("<DUP>", "<INV>"))
    wanted = F.array_compact(F.array(
        piece("LF", F.greatest(F.col("start") - flank, F.lit(1)), F.col("start") - 1), piece("RF", F.col("stop") + 1, F.col("stop") + flank), piece("MID", F.col("start"), F.col("stop"), (n > 0) & (~long | turned)),
        piece("REF_L", F.col("start"), F.col("start") + flank - 1, long), piece("REF_R", F.col("stop") - flank + 1, F.col("stop"), long),
    ))
    place = rows.select("graph_id", F.col("chrom").alias("contig"), F.explode(wanted).alias("p")).select("graph_id", "contig", "p.*")
    bases = events.interval_sequences(place, chunks, size).groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "seq"))).alias("bases"))
    rows = rows.join(bases, "graph_id").withColumn("long", long)
    mid = F.coalesce(F.element_at("bases", F.lit("MID")), F.lit(""))
    alt = F.transform("alts", lambda a: F.when(a.startswith("<"), alleles.symbolic_allele(a, F.when(a == "<INS>", F.lit("")).otherwise(mid), F.coalesce("inserted", F.lit("")))).otherwise(F.substring(a, F.col("pad") + 1, F.char_length(a))))
    entry = lambda name, seq: F.struct(name.alias("name"), seq.alias("seq"))
    of = lambda name: entry(F.lit(name), F.coalesce(F.element_at("bases", F.lit(name)), F.lit("")))
    ref = F.when(F.col("long"), F.array(of("REF_L"), of("REF_R"))).otherwise(F.array(entry(F.lit("REF"), mid)))
    own = F.transform(alt, lambda a, k: entry(F.concat(F.lit("ALT"), (k + 1).cast("string")), a))
    inner = F.filter(F.concat(ref, own), lambda x: x["seq"] != "")
    rows = rows.withColumn("_nodes", F.concat(F.array(of("LF")), inner, F.array(of("RF"))))
    names = F.transform("_nodes", lambda x: x["name"])
    rows = rows.withColumn("_names", names)
    step = lambda a, b, label: F.struct(a.alias("a"), b.alias("b"), label.alias("label"))
    lf, rf = F.lit("LF"), F.lit("RF")
    through = lambda name, label: F.when(F.array_contains("_names", name), F.array(step(lf, name, label), step(name, rf, label))).otherwise(F.array(step(lf, rf, label)))
    along = F.when(F.col("long"), F.array(step(lf, F.lit("REF_L"), F.lit("REF")), step(F.lit("REF_R"), rf, F.lit("REF")))).otherwise(through(F.lit("REF"), F.lit("REF")))
    ways = F.concat(along, F.flatten(F.transform(F.slice(allele_names(F.size("alts")), F.lit(2), F.size("alts")), lambda x: through(x, x))))
    number = lambda x: (F.array_position("_names", x) - 1).cast("long")
    pairs = F.array_distinct(F.transform("_ways", lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"))))
    edges = F.transform(pairs, lambda p: F.struct(
        number(p["a"]).alias("a"), number(p["b"]).alias("b"), F.concat_ws("_", p["a"], p["b"]).alias("name"),
        F.transform(F.filter("_ways", lambda w: (w["a"] == p["a"]) & (w["b"] == p["b"])), lambda w: w["label"]).alias("labels"),
    ))
    nodes = F.transform("_nodes", lambda x, k: F.struct(k.cast("long").alias("id"), x["name"].alias("name"), x["seq"].alias("seq")))
    return rows.withColumn("_ways", ways).select("graph_id", "chrom", "start", "stop", F.size("alts").alias("n_alts"), nodes.alias("nodes"), edges.alias("edges"))


def breakpoints(described: DataFrame) -> DataFrame:
    """Where graphs fork or join: graph_id, breakpoint (LF_ for ways out, _RF for ways in), allele, canonical, edges (names, sorted).

    Alleles that use the same edges of a breakpoint are one there: REF if it is among them, else the first by name.
    """
    rows = described.select("graph_id", F.transform("nodes", lambda n: n["name"]).alias("names"), F.explode("edges").alias("e")).select("graph_id", F.get("names", F.col("e.a").cast("int")).alias("a"), F.get("names", F.col("e.b").cast("int")).alias("b"), F.col("e.name").alias("edge"), F.explode("e.labels").alias("allele"))
    sides = rows.select("graph_id", "edge", "allele", F.explode(F.array(F.concat("a", F.lit("_")), F.concat(F.lit("_"), "b"))).alias("breakpoint"))
    forks = sides.groupBy("graph_id", "breakpoint").agg(F.count_distinct("edge").alias("n")).where("n > 1").drop("n")
    own = sides.join(forks, ["graph_id", "breakpoint"]).groupBy("graph_id", "breakpoint", "allele").agg(F.array_sort(F.collect_set("edge")).alias("edges"))
    first = own.groupBy("graph_id", "breakpoint", "edges").agg(F.when(F.bool_or(F.col("allele") == "REF"), F.lit("REF")).otherwise(F.min("allele")).alias("canonical"))
    return own.join(first, ["graph_id", "breakpoint", "edges"]).select("graph_id", "breakpoint", "allele", "canonical", "edges")


def breakpoint_counts(edge_counts: DataFrame, points: DataFrame, graphs: DataFrame, samples: list) -> DataFrame:
    """Counts of edges (sample_id, graph_id, element, fragments) to arrays by breakpoint: graph_id, sample_id, breakpoint, counts (of REF, ALT1, ...).

    An allele's count is the sum over its edges there; one that shares them with another has none of its own. Every sample
    has every breakpoint of every graph (graph_id, n_alts); what isn't counted is zero.
    """
    canonical = points.where("allele = canonical").select("graph_id", "breakpoint", "allele", F.explode("edges").alias("element"))
    found = canonical.join(edge_counts.select("sample_id", "graph_id", "element", "fragments"), ["graph_id", "element"]).groupBy("graph_id", "breakpoint", "sample_id", "allele").agg(F.sum("fragments").alias("n"))
    found = found.groupBy("graph_id", "breakpoint", "sample_id").agg(F.map_from_entries(F.collect_list(F.struct("allele", "n"))).alias("own"))
    kind = edge_counts.schema["sample_id"].dataType
    every = points.select("graph_id", "breakpoint").distinct().join(graphs.select("graph_id", "n_alts"), "graph_id").withColumn("sample_id", F.explode(F.array(*[F.lit(s).cast(kind) for s in samples])))
    rows = every.join(found, ["graph_id", "breakpoint", "sample_id"], "left")
    counts = F.transform(allele_names(F.col("n_alts")), lambda a: F.coalesce(F.element_at("own", a), F.lit(0).cast("long")))
    return rows.select("graph_id", "sample_id", "breakpoint", "n_alts", counts.alias("counts"))


def calls_of(counts: DataFrame, samples: DataFrame, sequences: DataFrame, *, ploidy: int = 2, poisson: bool = False) -> DataFrame:
    """Counts by breakpoint and samples (sample_id, depth, depth_sd, read_length) to what :func:`vcf.sample_fields` needs: one row for each graph and sample.

    ``sequences`` has sample_id, graph_id, element, fwd and rev: reads that support one allele and no other. ``poisson`` as in :func:`genotyping.called`.
    """
    keys = ["graph_id", "sample_id"]
    rows = counts.join(samples.select("sample_id", F.col("depth").cast("double"), F.col("depth_sd").cast("double"), F.col("read_length").cast("double")), "sample_id").withColumn("ploidy", F.lit(ploidy))
    each = cut(genotyping.called(dealt(rows), poisson=poisson), "breakpoint-calls")
    both = each.groupBy(*keys).agg(F.collect_list("gl").alias("_all"), F.max("n_alts").alias("n_alts"))
    gl = F.aggregate(F.slice("_all", F.lit(2), F.greatest(F.size("_all") - 1, F.lit(0))), F.get("_all", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: F.greatest(a, b)))
    both = both.select(*keys, "n_alts", gl.alias("gl"))
    own = sequences.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("element", F.struct(F.col("fwd").cast("long").alias("fwd"), F.col("rev").cast("long").alias("rev"))))).alias("alleles"))
    out = genotyping.combined(each, keys).join(both, keys).join(own, keys, "left")
    names = allele_names(F.col("n_alts"))
    listed = F.transform(genotyping.genotypes(F.col("n_alts") + 1, F.lit(ploidy)), lambda g: F.array_join(F.transform(g, lambda a: F.get(names, a)), "/"))
    none = F.array().cast("array<string>")
    return out.select(
        *keys, "n_alts", F.map_from_arrays(names, F.sequence(F.lit(0), F.col("n_alts"))).alias("allele_map"), F.transform("gt", lambda a: F.get(names, a)).alias("gt"), "gq",
        F.when(F.col("filter") == "PASS", none).otherwise(F.split("filter", ";")).alias("filters"), F.col("reads").alias("num_reads"),
        F.coalesce("alleles", F.create_map().cast("map<string,struct<fwd:bigint,rev:bigint>>")).alias("alleles"), F.map_from_arrays(listed, "gl").alias("gl"),
    )
