"""Multiple alignments to variant records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcall.operators import alleles


def sites(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Where the sequences of each alignment (keys; name, number, seq of one length with ``-`` for gaps) differ from its one of the least number: keys, start (0-based on its bases), ref, alts, calls (name to number of the allele).

    Columns that differ and touch are one variant of a sequence, those where both have a gap left out. What lacks bases on one side is anchored on the base before it, at the alignment's start on the
    one behind. Variants of one place and reference are one site with each different alternative once, in order; sequences without
    one there aren't among its calls. Each sequence meets the first one of its own alignment.
    """
    first = aligned.groupBy(*keys).agg(F.min_by(F.upper("seq"), "number").alias("_ref"), F.min("number").alias("_number"))
    rows = aligned.join(first, keys).where(F.col("number") != F.col("_number"))
    both = F.filter(F.arrays_zip(F.split("_ref", "").alias("r"), F.split(F.upper("seq"), "").alias("a")), lambda c: (c["r"] != "-") | (c["a"] != "-"))
    text = lambda side: F.array_join(F.transform("_columns", lambda c: c[side]), "").alias({"r": "ref", "a": "alt"}[side])
    found = alleles.gapped_differences(rows.withColumn("_columns", both).select(F.struct(*keys, "name").alias("id"), text("r"), text("a")))
    bases = first.select(*keys, F.replace("_ref", F.lit("-"), F.lit("")).alias("_bases"))
    found = found.select(*[F.col(f"id.{k}").alias(k) for k in keys], F.col("id.name").alias("name"), "start", "ref", "alt").join(bases, keys)
    lacks = (F.col("ref") == "") | (F.col("alt") == "")
    before = F.when(lacks & (F.col("start") > 0), F.substring(F.col("_bases"), F.col("start").cast("int"), F.lit(1))).otherwise("")
    behind = F.when(lacks & (F.col("start") == 0), F.substring(F.col("_bases"), F.char_length("ref") + 1, F.lit(1))).otherwise("")
    found = found.select(*keys, "name", (F.col("start") - F.char_length(before)).alias("start"), F.concat(before, "ref", behind).alias("ref"), F.concat(before, "alt", behind).alias("alt"), (behind != "").alias("_behind"))
    # What comes before the first base is a site of its own, as a sequence may have bases behind it too.
    own = found.groupBy(*keys, "start", "ref", "_behind").agg(F.array_sort(F.collect_set("alt")).alias("alts"), F.collect_list(F.struct("name", "alt")).alias("_own"))
    numbered = F.transform("_own", lambda x: F.struct(x["name"], F.array_position("alts", x["alt"]).cast("int")))
    return own.select(*keys, "start", "ref", "alts", F.map_from_entries(numbered).alias("calls"))


def site_records(found: DataFrame, names: list[str], *, chrom: str, start: int = 1) -> DataFrame:
    """Sites as rows that ``vcf.write_vcf`` writes, on a contig where the alignment begins at ``start`` (1-based): one haploid genotype for each of ``names``, a dot where it has no variant."""
    cells = F.array(*[F.coalesce(F.element_at("calls", F.lit(n)).cast("string"), F.lit(".")) for n in names])
    dot = F.lit(".")
    return found.select(F.lit(chrom).alias("chrom"), (F.col("start") + start).cast("long").alias("pos"), dot.alias("id"), "ref", F.array_join("alts", ",").alias("alt"), dot.alias("qual"), F.lit("PASS").alias("filter"), dot.alias("info"), F.lit("GT").alias("format"), cells.alias("samples"))
