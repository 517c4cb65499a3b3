"""Readers of the text formats: reads, references, graphs, manifests, variants, index slices; and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphcall.functions import sequence
from graphcall.operators import ordered

GRAPH = """model_name STRING, ID STRING, max_reads BIGINT, target_regions ARRAY<STRING>, sequencenames ARRAY<STRING>,
nodes ARRAY<STRUCT<name:STRING, sequence:STRING, reference:STRING, position:STRING, sequences:ARRAY<STRING>>>,
edges ARRAY<STRUCT<`from`:STRING, `to`:STRING, name:STRING, sequences:ARRAY<STRING>>>,
paths ARRAY<STRUCT<path_id:STRING, sequence:STRING, nodes:ARRAY<STRING>, nucleotide_length:BIGINT>>"""
#: Columns that a manifest may have, with underscores for spaces.
MANIFEST = frozenset("id path index_path counts_path depth_path depth read_length sex depth_variance depth_sd".split())
EVENTS = "ID STRING, desc STRING, chrom STRING, start BIGINT, end BIGINT, ins STRING, flank INT"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text without secondary and supplementary ones; positions are 0-based."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@"))).select(f.alias("f"))
    flag = F.get("f", F.lit(1)).cast("int")
    bit = lambda n: flag.bitwiseAND(n) != 0
    text = lambda k: F.get("f", F.lit(k))
    rows = rows.select(
        text(0).alias("fragment_id"), text(2).alias("chrom"), (text(3).cast("long") - 1).alias("pos"), text(4).cast("int").alias("mapq"), text(5).alias("cigar"),
        F.when(text(6) == "=", text(2)).otherwise(text(6)).alias("mate_chrom"), (text(7).cast("long") - 1).alias("mate_pos"), text(9).alias("bases"), text(10).alias("quals"),
        (~bit(4)).alias("is_mapped"), (~bit(8)).alias("is_mate_mapped"), bit(16).alias("is_reverse"), bit(32).alias("is_mate_reverse"), (~bit(128)).alias("is_first_mate"), flag.alias("flag"),
    )
    return rows.where(F.col("flag").bitwiseAND(0x900) == 0).drop("flag")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA text, without the mark that begins a record's line; one inside a line is text."""
    return spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of FASTA files: contig, seq (upper case, other letters N)."""
    records = _records(spark, path)
    name = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return records.select(name.alias("contig"), sequence.normalise_bases(body).alias("seq"))


def chunked(reference: DataFrame, size: int = 1 << 20) -> DataFrame:
    """Contigs in chunks of ``size`` bases: contig, chunk_id, chunk_start, seq."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("seq") - 1, F.lit(0)), F.lit(size))
    rows = reference.select("contig", F.posexplode(starts).alias("chunk_id", "chunk_start"), "seq")
    return rows.select("contig", "chunk_id", "chunk_start", F.substring(F.col("seq"), F.col("chunk_start") + 1, F.lit(size)).alias("seq"))


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Graph documents, with or without the ``graph`` wrapper, under a fixed schema."""
    plain = spark.read.option("multiLine", True).schema(f"{GRAPH}, graph STRUCT<{_nested(GRAPH)}>").json(path)
    columns = [c for c in plain.columns if c != "graph"]
    return plain.select(*[F.coalesce(c, f"graph.{c}").alias(c) for c in columns])


def _nested(ddl: str) -> str:
    depth, out = 0, []
    for word in ddl.replace("\n", " ").split(" "):
        out.append(word + ":" if depth == 0 and (not out or out[-1].endswith(",")) else word)
        depth += word.count("<") - word.count(">")
    return " ".join(out)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(EVENTS).json(path)


#: What a file of depths may hold.
DEPTHS = "depth DOUBLE, read_length INT, depth_variance DOUBLE, depth_sd DOUBLE, autosome STRUCT<depth:DOUBLE>"


def beside(path: str, name: Column) -> Column:
    """A path that a file names: as it stands if it is whole, else in the folder of the file."""
    return F.when(name.contains("://") | name.startswith("/"), name).otherwise(F.concat(F.lit(path.rpartition("/")[0] + "/"), name))


def with_depth_files(manifest: DataFrame, path: str) -> DataFrame:
    """A manifest's rows with depth, read_length and depth_variance from the JSON that ``depth_path`` names, where they have none of their own.

    Files are read in one scan and meet their rows by path; names are relative to the manifest's folder. A row that names a file
    and gives a depth or read length itself too raises, and so does a file that isn't there or has no depth.
    """
    spark = manifest.sparkSession
    own = [c for c in ("depth", "read_length", "depth_variance", "depth_sd") if c in manifest.columns]
    rows = manifest.withColumn("_full", F.when(F.col("depth_path") != "", beside(path, F.col("depth_path"))))
    names = [r[0] for r in rows.select("_full").where("_full IS NOT NULL").distinct().collect()]  # as many as there are files to open
    if not names:
        return rows.drop("_full", "depth_path")
    read = spark.read.option("multiLine", True).schema(DEPTHS).json(names).withColumn("_file", F.col("_metadata.file_path"))
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    found = read.select(plain(F.col("_file")).alias("_file"), F.coalesce("autosome.depth", "depth").alias("_depth"), F.col("read_length").alias("_length"), F.coalesce("depth_variance", F.col("depth_sd") * F.col("depth_sd")).alias("_variance"))
    rows = rows.withColumn("_file", plain(F.col("_full"))).join(found, "_file", "left")
    twice = F.lit(False)
    for c in own:
        twice = twice | (F.col("_full").isNotNull() & F.col(c).isNotNull())
    told = F.when(twice, F.raise_error(F.concat(F.lit("depths are given twice: "), "id")).cast("double")).when(F.col("_full").isNotNull() & F.col("_depth").isNull(), F.raise_error(F.concat(F.lit("no depth in "), "_full")).cast("double"))
    have = lambda c: F.col(c) if c in own else F.lit(None).cast("string")
    merged = {"depth": F.coalesce(told.cast("string"), F.col("_depth").cast("string"), have("depth")), "read_length": F.coalesce(F.col("_length").cast("string"), have("read_length")), "depth_variance": F.coalesce(F.col("_variance").cast("string"), have("depth_variance"))}
    return rows.withColumns(merged).drop("_full", "_file", "_depth", "_length", "_variance", "depth_path")


def read_manifest(spark: SparkSession, path: str, sep: str = "\t", *, names: dict[str, str] | None = None) -> DataFrame:
    """Samples with depth, read length, depth_sd (given, from the variance, or sqrt(5 depth)) and sex as m, f or u.

    ``names`` maps columns of older manifests to those of today, as depth_path for a file of depths (see :func:`with_depth_files`).
    """
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    raw = raw.toDF(*[(names or {}).get(c, c) for c in (c.lstrip("#").strip().lower().replace(" ", "_") for c in raw.columns)])
    if {"id", "depth_path"} <= set(raw.columns) <= MANIFEST:
        raw = with_depth_files(raw, path)
    if unknown := set(raw.columns) - MANIFEST:
        raise ValueError(f"unknown columns in the manifest: {sorted(unknown)}")
    if not {"id", "path"} <= set(raw.columns) or not {"depth", "read_length"} <= set(raw.columns):
        raise ValueError("a manifest needs id, path, depth and read length")
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    positive = lambda c, kind: F.when(F.coalesce(have(c).try_cast(kind) > 0, F.lit(False)), have(c).try_cast(kind)).otherwise(F.raise_error(F.concat(F.lit(f"{c} must be positive: "), F.col("id"))).cast(kind))
    depth = positive("depth", "double")
    sd = F.coalesce(have("depth_sd").cast("double"), F.sqrt(have("depth_variance").cast("double")), F.sqrt(5 * depth))
    sex = F.coalesce(F.lower(F.substring(have("sex"), 1, 1)), F.lit("u"))
    checked = F.when(sex.isin("m", "f", "u"), sex).otherwise(F.raise_error(F.concat(F.lit("unknown sex: "), have("sex"))))
    return raw.select("id", "path", depth.alias("depth"), positive("read_length", "int").alias("read_length"), sd.alias("depth_sd"), checked.alias("sex"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variant records: chrom, pos (1-based), id, ref, alts, qual, filter, info (also as it stands, info_text), calls (the format and the samples' texts), end."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(f.alias("f"))
    text = lambda k: F.get("f", F.lit(k))
    # A value may hold more equals signs; of a key that comes again, the first counts.
    pairs = F.transform(F.split(text(7), ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=?", "").alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    pairs = F.filter(pairs, lambda p, k: F.array_position(names, p["k"]) == k + 1)
    rows = rows.select(
        text(0).alias("chrom"), text(1).cast("long").alias("pos"), text(2).alias("id"), text(3).alias("ref"), F.split(text(4), ",").alias("alts"), text(5).alias("qual"),
        text(6).alias("filter"), F.map_from_entries(pairs).alias("info"), text(7).alias("info_text"), F.slice("f", F.lit(9), F.greatest(F.size("f") - 8, F.lit(0))).alias("calls"),
    )
    stop = F.coalesce(F.element_at("info", F.lit("END")).try_cast("long"), F.col("pos") + F.char_length("ref") - 1)
    return rows.withColumn("end", stop)


def read_vcf_header(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The header's lines but the last, and the samples that the last names; a header is small."""
    lines = [r.value for r in spark.read.text(path).where(F.startswith("value", F.lit("#"))).collect()]
    named = next((x for x in lines if x.startswith("#CHROM")), "")
    return [x for x in lines if x.startswith("##")], named.split("\t")[9:]


def old_genotypes(samples: list[str]) -> Column:
    """The genotypes that records of :func:`read_vcf` had, by sample."""
    place = F.array_position(F.split(F.get("calls", F.lit(0)), ":"), "GT").cast("int") - 1
    own = [F.when(place >= 0, F.get(F.split(F.get("calls", F.lit(k)), ":"), place)) for k in range(1, len(samples) + 1)]
    return F.create_map(*[x for s, v in zip(samples, own, strict=True) for x in (F.lit(s), v)]).cast("map<string,string>")


def read_index_slices(spark: SparkSession, path: str) -> DataFrame:
    """Slices of a compressed alignment index: six tab-separated fields."""
    return spark.read.option("sep", "\t").schema("contig INT, start BIGINT, span BIGINT, container BIGINT, slice BIGINT, bytes BIGINT").csv(path)


def read_aligned_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of one alignment; all must be of one length."""
    rows = _records(spark, path)
    rows = rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    size = F.char_length("seq")
    sizes = rows.agg(F.min(size).alias("a"), F.max(size).alias("b"))
    return rows.join(F.broadcast(sizes)).where(F.assert_true(F.col("a") == F.col("b")).isNull()).drop("a", "b")


def significant(value: Column, digits: int = 5) -> Column:
    """A number rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, value).otherwise(F.round(value * scale) / scale)


def _plain_numbers(value: Column, kind: T.DataType, name: str) -> Column:
    """A value with all its floating numbers at five significant digits; special numbers raise."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        number = value.cast("double")
        odd = F.isnan(number) | number.isin(float("inf"), float("-inf"))
        return F.when(odd, F.raise_error(F.lit(f"{name} is no number")).cast("double")).otherwise(significant(number))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_plain_numbers(value[f.name], f.dataType, f.name).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain_numbers(x, kind.elementType, name))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, x: _plain_numbers(x, kind.valueType, name))
    return value


def documents(rows: DataFrame) -> DataFrame:
    """Each row as a JSON text: numbers with five significant digits, none of them special."""
    return rows.select(F.to_json(F.struct(*[_plain_numbers(F.col(f.name), f.dataType, f.name).alias(f.name) for f in rows.schema])).alias("value"))


def write_documents(rows: DataFrame, path: str) -> None:
    """Rows as lines of :func:`documents`."""
    documents(rows).write.text(path)


def by_id_and_sequence(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genotyped graphs (ID, sequencenames, ...) by their id, and by the name of each of their sequences, as (key, target): what ``matching.match_with_fallback`` asks."""
    by_id = found.where("ID IS NOT NULL").select(F.col("ID").alias("key"), F.col("ID").alias("target"))
    return by_id, found.select(F.explode("sequencenames").alias("key"), F.col("ID").alias("target"))


def checked_graphs(found: DataFrame, *, regions: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Graph documents with ``longest_alt_insertion``; one without target regions raises unless ``regions`` are given, which go before its own, as ``most`` goes before its max_reads.

    Names that come twice, nodes without bases or place, and edges to nodes that aren't there or to themselves raise too. A document is checked in its row.
    """
    names = F.transform("nodes", lambda n: n["name"])
    edge = lambda e: (~F.array_contains(names, e["from"])) | (~F.array_contains(names, e["to"])) | (e["from"] == e["to"])
    bad = (
        F.when(F.size(F.array_distinct(names)) < F.size(names), "names come twice")
        .when(F.exists("nodes", lambda n: n["sequence"].isNull() & n["reference"].isNull()), "a node has neither bases nor a place")
        .when(F.exists("edges", edge), "an edge leads nowhere or to its own node")
        .when(F.lit(regions is None) & (F.coalesce(F.size("target_regions"), F.lit(0)) <= 0), "no target regions")
    )
    told = F.when(bad.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.coalesce("ID", F.lit("a graph")), F.lit(": "), bad)).cast("boolean"))
    rows = found.where(told)
    if regions is not None:
        rows = rows.withColumn("target_regions", F.array(*map(F.lit, regions)).cast("array<string>"))
    if most is not None:
        rows = rows.withColumn("max_reads", F.lit(most).cast("long"))
    longest = F.array_max(F.transform("nodes", lambda n: F.coalesce(F.char_length(n["sequence"]), F.lit(0))))
    return rows.withColumn("longest_alt_insertion", F.coalesce(longest, F.lit(0)))


def write_bins(bins: DataFrame, path: str) -> None:
    """Depth bins as tab-separated text with 1-based starts."""
    bins.withColumn("start", F.col("start") + 1).write.option("sep", "\t").option("header", True).csv(path)


def write_by_graph(documents: DataFrame, path: str) -> None:
    """JSON documents in a compressed folder for each graph; a graph's documents are dealt to one task, so it gets one file."""
    documents.repartition("graph_id").write.partitionBy("graph_id").option("compression", "gzip").json(path)


def event_ids(events: DataFrame, source: str) -> DataFrame:
    """Events with an id: their own, else the source and their number, from 0, over the whole list in the order of place.

    Numbers come from ranges of places and the counts of the ranges before, so the list is sorted but never in one task.
    Columns are compared as they are: events that agree in all of them share neither place nor number.
    """
    order = ["chrom", "start", "end", "ins"]
    rows = ordered.sliced(events.withColumns({"_all": F.lit(0), "_tie": F.rand(5)}), ["_all"], [*order, "_tie"])
    rows = ordered.running(rows, ["_all"], [*order, "_tie"], sums={"_n": F.lit(1).cast("long")})
    number = (F.col("_n") - 1).cast("string")
    return rows.withColumn("ID", F.coalesce("ID", F.concat(F.lit(f"{source}:"), number))).drop("_all", "_tie", "_n", "_slice")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name and SHA-256 (lowercase hex) of each file at ``path``, each of at most 2 GB: one row of bytes holds a file."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select(name.alias("file"), F.sha2("content", 256).alias("digest"))
