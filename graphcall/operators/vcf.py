"""Annotated variant records: validation, matching to genotyped graphs, sample fields, header and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcall.operators import genotyping

#: Names, numbers and types of the fields and filters that annotation adds are fixed values of the format; what describes them is free.
FORMATS = (
    ("OLD_GT", "1", "String", "What GT was in the input"), ("GT", "1", "String", "Called alleles"), ("FT", "1", "String", "Filters that the call fails"),
    ("DP", "1", "Integer", "Reads that took part in the call"), ("AD", "R", "Integer", "Reads by allele"), ("ADF", "R", "Integer", "Forward reads by allele"), ("ADR", "R", "Integer", "Reverse reads by allele"),
    ("PL", "G", "Integer", "Likelihoods of all genotypes, Phred-scaled"),
)
FILTERS = (
    ("BP_DEPTH", "Depth at a breakpoint is far from that of the sample"), ("NO_VALID_GT", "No breakpoint has a call that stands"), ("CONFLICT", "Calls of the breakpoints differ"), ("BP_NO_GT", "A breakpoint has no call"),
    ("NO_READS", "A breakpoint has no reads"), ("DEPTH", "Depth is improbable under a Poisson distribution"),
    ("UNMATCHED", "No graph belongs to the record"), ("MULTIMATCHED", "Several graphs belong to the record"),
)
#: The INFO key for a record's graph, unless another is asked for.
ID_KEY = "GRAPH_ID"
FIELDS = "GT:OLD_GT:FT:DP:AD:ADF:ADR:PL"


def flaw(ref: Column, alt: Column, pos: Column, end: Column, inserted: Column, read_length: int) -> Column:
    """Why a record (1-based pos) can't become a graph; null if it can."""
    symbolic, odd = alt.contains("<"), "[^ACGTNXacgtnx]"
    return (
        F.when(pos <= read_length, "start").when((alt == "<INS>") & inserted.isNull(), "no insertion").when((alt == "<INS>") & inserted.rlike(odd), "insertion letters")
        .when(symbolic & (alt != "<INS>") & (F.coalesce(end, pos) == pos), "no end").when(~symbolic & (alt.rlike(odd) | (alt == "")), "allele letters")
        .when(~symbolic & (F.char_length(ref) > 1) & (F.upper(F.left(alt, F.lit(1))) != F.upper(F.left(ref, F.lit(1)))), "padding base")
    )


def haplotypes(alts: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """All haplotypes that a graph's alternatives and reference segments (keys, haplotypes: array) name."""
    rows = alts.select(*keys, F.explode("haplotypes").alias("haplotype")).unionByName(refs.select(*keys, F.explode("haplotypes").alias("haplotype")))
    return rows.where("haplotype IS NOT NULL").distinct()


def header_contigs(header: DataFrame, reference: DataFrame) -> DataFrame:
    """Contigs (contig, length) of reads that the reference has too; one that it lacks or has in another length raises when the rows are read."""
    both = header.join(reference.select("contig", F.col("length").alias("_length")), "contig", "left")
    missing = F.raise_error(F.concat(F.lit("the reference has no contig "), F.col("contig")))
    differs = F.raise_error(F.concat(F.lit("contig lengths don't match: "), F.col("contig")))
    length = F.when(F.col("_length").isNull(), missing.cast("long")).when(F.col("_length") != F.col("length"), differs.cast("long")).otherwise(F.col("length"))
    return both.select("contig", length.alias("length"))


def sample_fields(calls: DataFrame) -> DataFrame:
    """``calls`` with GT, FT, DP, AD, ADF, ADR and PL as text.

    Needed: n_alts, allele_map (name to number), gt (array of allele names, null without a call), filters (array), num_reads,
    alleles (name to struct fwd, rev) and gl (genotype such as REF/ALT to log likelihood). An allele that the record lacks
    makes the genotype missing, with UNMATCHED among the filters. Genotypes without a likelihood count as zero.
    """
    number = lambda a: F.coalesce(F.element_at("allele_map", a), F.lit(-1))
    own = F.array_sort(F.transform("gt", number))
    known = F.col("gt").isNotNull() & (F.size("gt") > 0) & ~F.exists(own, lambda n: n < 0)
    every = F.sequence(F.lit(0), F.col("n_alts"))
    depth = lambda value: F.array_join(F.transform(every, lambda k: F.aggregate(F.map_entries("alleles"), F.lit(0).cast("long"), lambda s, e: s + F.when(number(e["key"]) == k, value(e["value"])).otherwise(0)).cast("string")), ",")
    listed = F.transform(F.map_entries("gl"), lambda e: F.struct(F.array_sort(F.transform(F.split(e["key"], "/"), number)).alias("g"), F.least(F.bround(-10 * e["value"]).cast("long"), F.lit(32768).cast("long")).alias("pl")))
    ploidy = F.when(F.size("gt") == 1, 1).otherwise(2)
    order = genotyping.genotypes(F.col("n_alts") + 1, ploidy)
    least = F.array_min(F.transform("_pl", lambda x: x["pl"]))
    found = lambda g: F.coalesce(F.get(F.filter("_pl", lambda x: x["g"] == g), F.lit(0))["pl"], F.lit(0).cast("long"))
    pl = F.when(F.size("_pl") > 0, F.array_join(F.transform(order, lambda g: (found(g) - F.col("_least")).cast("string")), ",")).otherwise(".")
    filters = F.array_sort(F.array_distinct(F.concat("filters", F.when(known, F.array().cast("array<string>")).otherwise(F.array(F.lit("UNMATCHED"))))))
    rows = calls.withColumn("_pl", listed).withColumn("_least", least)
    return rows.withColumns({
        "GT": F.when(known, F.array_join(F.transform(own, lambda n: n.cast("string")), "/")).otherwise("."), "FT": F.array_join(filters, ","), "DP": F.coalesce("num_reads", F.lit(0)).cast("string"),
        "AD": depth(lambda x: x["fwd"] + x["rev"]), "ADF": depth(lambda x: x["fwd"]), "ADR": depth(lambda x: x["rev"]), "PL": pl,
    }).drop("_pl", "_least")


def matched(records: DataFrame, by_id: DataFrame, by_name: DataFrame, *, name: str = "id", id_key: str = ID_KEY) -> DataFrame:
    """Which graphs records (record, info, and ``name``) belong to: record, matches, target and targets, as :func:`annotated` needs them.

    A record whose info has ``id_key`` belongs to the graphs of that id (``by_id``: key, target), if there are any; else to those with a sequence of its name (``by_name``).
    """
    found = by_id.select(F.concat(F.lit("i:"), "key").alias("_key"), "target").unionByName(by_name.select(F.concat(F.lit("n:"), "key").alias("_key"), "target"))
    found = found.groupBy("_key").agg(F.array_sort(F.collect_set("target")).alias("_targets"))
    side = lambda n: found.select(F.col("_key").alias(f"_k{n}"), F.col("_targets").alias(f"_t{n}"))
    rows = records.select("record", F.concat(F.lit("i:"), F.element_at("info", F.lit(id_key))).alias("_k1"), F.concat(F.lit("n:"), F.col(name)).alias("_k2"))
    rows = rows.join(side(1), "_k1", "left").join(side(2), "_k2", "left").withColumn("targets", F.coalesce("_t1", "_t2", F.array().cast("array<string>")))
    n = F.size("targets").cast("long")
    return rows.select("record", n.alias("matches"), F.when(n == 1, F.get("targets", F.lit(0))).alias("target"), "targets")


def annotated(records: DataFrame, found: DataFrame, fields: DataFrame, samples: list[str], *, id_key: str = ID_KEY) -> DataFrame:
    """Records with their samples' fields: chrom, pos, id, ref, alt, qual, filter, info, format and an array of sample texts in the order of ``samples``.

    ``records``: record, chrom, pos, id, ref, alts, qual, filter, info_text, old_gt (map of sample to genotype). ``found``: record, matches, target
    (graph) and all targets, as matching with fallback gives them. ``fields``: record, sample and the columns of :func:`sample_fields`. Records that match no
    graph or several get UNMATCHED or MULTIMATCHED; ``id_key`` of the info text names the graph, in place of one that it had; a record whose calls are BP_DEPTH or BP_NO_GT in over half of its samples gets BP_DEPTH.
    """
    empty = lambda old, n: F.concat_ws(":", F.lit("."), F.coalesce(old, F.lit(".")), F.lit("."), F.lit("."), *[F.array_join(F.array_repeat(F.lit("."), n), ",")] * 3, F.lit("."))
    text = F.concat_ws(":", "GT", F.lit("\0"), "FT", "DP", "AD", "ADF", "ADR", "PL")
    bad = F.col("FT").rlike("(^|,)(BP_DEPTH|BP_NO_GT)(,|$)")
    own = fields.groupBy("record").agg(F.map_from_entries(F.collect_list(F.struct("sample", text.alias("text")))).alias("texts"), F.count_if(bad).alias("bad"), F.count("*").alias("n"))
    rows = records.join(found, "record", "left").join(own, "record", "left")
    n = F.coalesce("matches", F.lit(0))
    of = lambda s: F.when(n == 1, F.element_at("texts", F.lit(s)))
    old = lambda s: F.coalesce(F.element_at("old_gt", F.lit(s)), F.lit("."))
    cells = F.array(*[F.coalesce(F.replace(of(s), F.lit("\0"), old(s)), empty(old(s), F.size("alts") + 1)) for s in samples])
    added = F.when(n == 0, "UNMATCHED").when(n > 1, "MULTIMATCHED").when(2 * F.col("bad") > F.col("n"), "BP_DEPTH")
    given = F.when(F.col("filter").isin(".", "PASS") | F.col("filter").isNull(), F.lit(None).cast("string")).otherwise(F.col("filter"))
    target = F.when(n == 0, "UNMATCHED").when(n > 1, F.concat(F.lit("MULTIPLE:"), F.array_join(F.array_sort("targets"), ","))).otherwise(F.col("target"))
    kept = F.filter(F.split("info_text", ";"), lambda x: ~x.isin("", ".") & (F.substring_index(x, "=", 1) != id_key))
    info = F.concat_ws(";", kept, F.concat(F.lit(f"{id_key}="), target))
    mark = F.concat_ws(";", given, added)
    return rows.select("chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alt"), F.coalesce("qual", F.lit(".")).alias("qual"), F.when(mark == "", F.coalesce("filter", F.lit("."))).otherwise(mark).alias("filter"), info.alias("info"), F.lit(FIELDS).alias("format"), cells.alias("samples"))


def header_lines(given: list[str], samples: list[str], *, id_key: str = ID_KEY) -> list[str]:
    """A header with the lines given (without the column line), those that annotation adds and lack, and the column line. Without samples in the input (FORMAT lines), no old genotypes are declared."""
    out = list(given) or ["##fileformat=VCFv4.2"]
    has = lambda kind, name: any(x.startswith(f"##{kind}=<ID={name},") for x in out)
    out += [f'##FORMAT=<ID={n},Number={c},Type={t},Description="{d}">' for n, c, t, d in FORMATS if not has("FORMAT", n) and (n != "OLD_GT" or any(x.startswith("##FORMAT") for x in given))]
    if not has("INFO", id_key):
        out.append(f'##INFO=<ID={id_key},Number=1,Type=String,Description="The graph that the record was genotyped on">')
    out += [f'##FILTER=<ID={n},Description="{d}">' for n, d in FILTERS if not has("FILTER", n)]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def write_vcf(rows: DataFrame, path: str, given: list[str], samples: list[str], *, id_key: str = ID_KEY) -> None:
    """Rows of :func:`annotated` as text parts whose concatenation in order is a file: the header, then records by contig and place."""
    spark = rows.sparkSession
    head = spark.createDataFrame(list(enumerate(header_lines(given, samples, id_key=id_key))), "pos long, value string").select(F.lit("").alias("chrom"), "pos", F.lit("").alias("id"), "value")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", "info", "format", F.array_join("samples", "\t"))
    body = rows.select("chrom", F.col("pos").cast("long").alias("pos"), "id", line.alias("value"))
    head.unionByName(body).repartitionByRange("chrom", "pos", "id").sortWithinPartitions("chrom", "pos", "id").select("value").write.text(path)


def _by_name(entries: str, name: str) -> Column:
    """An array of structs in order of one of their fields; structs that hold maps have no order of their own."""
    return F.transform(F.array_sort(F.transform(entries, lambda e: e[name])), lambda n: F.get(F.filter(entries, lambda e: e[name] == n), F.lit(0)))


def genotype_documents(calls: DataFrame, combined: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """One JSON document for each graph: its samples' genotypes, their breakpoints' genotypes and counts, and the population's figures.

    ``calls`` (graph_id, sample, breakpoint, gt, gl, gq, filters, num_reads, edges and alleles as maps), ``combined`` (graph_id, sample, gt, gq, filters, num_reads) and
    ``population`` (graph_id and figures), which only graphs of several samples get.
    """
    one = F.struct("breakpoint", F.struct(F.struct(F.col("gt").alias("GT"), F.col("gl").alias("GL"), F.col("gq").alias("GQ"), "filters", "num_reads").alias("gt"), F.struct("edges", "alleles").alias("counts")).alias("call"))
    points = calls.groupBy("graph_id", "sample").agg(F.collect_list(one).alias("_points"))
    points = points.select("graph_id", "sample", F.map_from_entries(_by_name("_points", "breakpoint")).alias("breakpoints"))
    rows = combined.join(points, ["graph_id", "sample"], "left")
    own = F.struct("sample", F.struct(F.struct(F.col("gt").alias("GT"), F.col("gq").alias("GQ"), "filters", "num_reads").alias("gt"), "breakpoints").alias("call"))
    out = rows.groupBy("graph_id").agg(F.collect_list(own).alias("_samples"))
    parts = [F.struct(F.col("graph_id").alias("ID")).alias("graphinfo"), F.map_from_entries(_by_name("_samples", "sample")).alias("samples")]
    if population is not None:
        figures = [c for c in population.columns if c != "graph_id"]
        out = out.join(population.select("graph_id", F.struct(*figures).alias("_population")), "graph_id", "left")
        parts.append(F.when(F.size("_samples") > 1, F.col("_population")).alias("population"))
    return out.select("graph_id", F.to_json(F.struct(*parts)).alias("document"))
