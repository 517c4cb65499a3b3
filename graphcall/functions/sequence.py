"""Bases, regions and qualities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_bases(seq: Column) -> Column:
    """Upper case, everything but ACGT is N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def non_n_size(seq: Column) -> Column:
    """Length without the Ns at both ends."""
    return F.char_length(F.btrim(seq, F.lit("N")))


def kmers(seq: Column, k: int) -> Column:
    """All windows of k bases, those with other letters left out, in order (array of struct pos, kmer)."""
    n = F.char_length(seq) - k + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct((i - 1).alias("pos"), F.substring(seq, i, F.lit(k)).alias("kmer")))
    return F.filter(F.when(n >= 1, every).otherwise(F.slice(every, 1, 0)), lambda w: (F.char_length(w["kmer"]) == k) & ~w["kmer"].rlike("[^ACGT]"))


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, A C G T as 0 to 3, first base highest; up to 31 bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def phred_to_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def error_to_phred(p: Column) -> Column:
    return -10 * F.log10(p)


def quality_error(quals: Column, start: Column, length: Column) -> Column:
    """Mean base error of a stretch of a Phred+33 string."""
    codes = F.transform(F.sequence(start, start + F.greatest(length, F.lit(1)) - 1), lambda i: phred_to_error((F.ascii(F.substring(quals, i, F.lit(1))) - 33).cast("double")))
    return F.aggregate(codes, F.lit(0.0), lambda s, x: s + x) / F.size(codes)


def parse_region(text: Column) -> Column:
    """``chrom:start-end`` (1-based, closed, thousands marks allowed) to struct chrom, start, end (0-based, closed); -1 where unset."""
    clean = F.replace(text, F.lit(","), F.lit(""))
    part = lambda k: F.regexp_extract(clean, r"^([^:]+)(?::([0-9]+)(?:-([0-9]+))?)?$", k)
    number = lambda k: F.when(part(k) == "", F.lit(-1).cast("long")).otherwise(part(k).try_cast("long") - 1)
    return F.struct(part(1).alias("chrom"), number(2).alias("start"), number(3).alias("end"))


def format_region(chrom: Column, start: Column, end: Column) -> Column:
    """The reverse of :func:`parse_region`."""
    tail = F.when(end >= 0, F.concat(F.lit("-"), (end + 1).cast("string"))).otherwise("")
    return F.concat(chrom, F.when(start >= 0, F.concat(F.lit(":"), (start + 1).cast("string"), tail)).otherwise(""))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9.-]", "_")
