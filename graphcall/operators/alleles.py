"""Variants as columns: trimming, shifting, application, primitives, symbolic alleles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcall.operators import alignment
from graphcall.operators.events import interval_sequences
from graphcall.operators.storage import cut


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading bases that two strings share."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = lambda k, i: F.when((k == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), k + 1).otherwise(k)
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), same))


def trimmed(pos: Column, ref: Column, alt: Column, *, keep: int = 0) -> Column:
    """Without shared bases at the end, then at the start; ``keep`` bases of both stay. Struct pos, ref, alt."""
    room = F.least(F.char_length(ref), F.char_length(alt)) - keep
    tail = F.greatest(F.least(shared_prefix(F.reverse(ref), F.reverse(alt)), room), F.lit(0))
    r, a = F.left(ref, F.char_length(ref) - tail), F.left(alt, F.char_length(alt) - tail)
    head = F.greatest(F.least(shared_prefix(r, a), F.least(F.char_length(r), F.char_length(a)) - keep), F.lit(0))
    return F.struct((pos + head).alias("pos"), F.substring(r, head + 1, F.char_length(r)).alias("ref"), F.substring(a, head + 1, F.char_length(a)).alias("alt"))


def applied(seq: Column, start: Column, end: Column, alt: Column) -> Column:
    """``seq`` with bases start to end (0-based, closed) replaced; end before start inserts."""
    return F.concat(F.left(seq, start), alt, F.substring(seq, end + 2, F.char_length(seq)))


def substitutions(ref: Column, alt: Column) -> Column:
    """Single-base differences of two strings of one length: array of struct offset, ref, alt."""
    n = F.least(F.char_length(ref), F.char_length(alt))
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct((i - 1).alias("offset"), F.substring(ref, i, F.lit(1)).alias("ref"), F.substring(alt, i, F.lit(1)).alias("alt")))
    return F.filter(every, lambda s: s["ref"] != s["alt"])


def variant_class(ref: Column, alt: Column) -> Column:
    r, a = F.char_length(ref), F.char_length(alt)
    return F.when(alt.rlike("^<.*>$"), "symbolic").when((r == 1) & (a == 1), "snp").when(r == a, "mnp").when(r > a, "deletion").otherwise("insertion")


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def shared_suffix(a: Column, b: Column, *, most: int = 1 << 20) -> Column:
    """Number of trailing characters that two strings share, up to 2 ``most`` - 1: pieces of halving length are held against each other, no character alone."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    piece = lambda s, k, n: F.substring(s, F.char_length(s) - k - n + 1, n)
    room = F.least(F.char_length(a), F.char_length(b))
    return F.aggregate(steps, F.lit(0), lambda k, n: F.when((k + n <= room) & (piece(a, k, n) == piece(b, k, n)), k + n).otherwise(k))


def _jumped(rows: DataFrame, before: Column, removed: Column, alt: Column, most: int) -> DataFrame:
    """``rows`` with ``_moved``, how far an indel goes left in what stands ``before`` it (up to an N there), and ``_alt``, the alternative's bases then.

    Moving by one place gives the same bases if the one in front equals the last that is removed or inserted. So it
    moves as far as what stands before and what stands before and in it have one end, which is the whole run of its repeat.
    """
    rows = rows.withColumns({"_before": before, "_removed": removed, "_alt": alt})
    rows = rows.withColumn("_both", F.concat("_before", F.when(F.col("_alt") == "", F.col("_removed")).otherwise(F.col("_alt"))))
    n = F.instr(F.reverse("_before"), F.lit("N"))
    rows = rows.withColumn("_moved", shared_suffix(F.col("_before"), F.col("_both"), most=most))
    moved = F.least(F.col("_moved"), F.when(n > 0, n - 1).otherwise(F.char_length("_before")))
    rows = rows.withColumn("_moved", F.when((F.col("_alt") == "") != (F.col("_removed") == ""), moved).otherwise(0))
    size = F.char_length("_alt")
    turned = F.substring(F.col("_both"), F.char_length("_both") - F.col("_moved") - size + 1, size)
    return rows.withColumn("_alt", F.when((F.col("_alt") == "") | (F.col("_moved") == 0), F.col("_alt")).otherwise(turned)).drop("_removed", "_both")


def left_shifted(rows: DataFrame, *, lowest: int = 0) -> DataFrame:
    """Deletions and insertions of ``rows`` (id, seq, start, end, alt) at their leftmost place, not before ``lowest``.

    A substitution stays, and nothing moves over an N.
    """
    start = F.col("start").cast("int")
    before = F.substring(F.col("seq"), F.lit(lowest + 1), F.greatest(start - lowest, F.lit(0)))
    removed = F.substring(F.col("seq"), start + 1, F.greatest((F.col("end") - F.col("start") + 1).cast("int"), F.lit(0)))
    found = _jumped(rows, before, removed, F.col("alt"), 1 << 20)
    return found.select("id", (F.col("start") - F.col("_moved")).cast("long").alias("start"), (F.col("end") - F.col("_moved")).cast("long").alias("end"), F.col("_alt").alias("alt"))


def right_shifted(rows: DataFrame, *, highest: int | None = None) -> DataFrame:
    """Deletions and insertions of ``rows`` (id, seq, start, end, alt) at their rightmost place, not behind ``highest``; the mirror of :func:`left_shifted`."""
    stop = (F.col("end") + 1).cast("int")
    far = F.char_length("seq") if highest is None else F.least(F.lit(highest + 1), F.char_length("seq"))
    behind = F.reverse(F.substring(F.col("seq"), stop + 1, F.greatest(far - stop, F.lit(0))))
    removed = F.reverse(F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), F.greatest((F.col("end") - F.col("start") + 1).cast("int"), F.lit(0))))
    found = _jumped(rows, behind, removed, F.reverse("alt"), 1 << 20)
    return found.select("id", (F.col("start") + F.col("_moved")).cast("long").alias("start"), (F.col("end") + F.col("_moved")).cast("long").alias("end"), F.reverse("_alt").alias("alt"))


def shifted(variants: DataFrame, chunks: DataFrame, size: int, *, right: bool = False, window: int = 512, bound: str | None = None) -> DataFrame:
    """Deletions and insertions (id, contig, start, end, alt; 0-based) at their leftmost or rightmost place on a reference in chunks of ``size`` bases (contig, chunk_id, seq).

    A round reads ``window`` bases beside each variant that still moves and jumps as far as its repeat goes there; what comes to the window's end goes on with
    four times as many. No row holds a contig. ``bound`` names a column with the first place it may start at, or the last it may end at.
    """
    columns = ["id", "contig", "start", "end", "alt"]
    limit = F.col(bound).cast("long") if bound else F.lit(None).cast("long")
    left = cut(variants.select("id", "contig", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("alt", F.lit("")).alias("alt"), limit.alias("_limit")))
    done = []
    while True:
        last = F.greatest("end", F.col("start") - 1)
        low = F.col("start") if right else F.greatest(F.col("start") - window, F.coalesce("_limit", F.lit(0)), F.lit(0))
        high = F.greatest(last, F.least(last + window, F.coalesce("_limit", F.lit(2**62)))) if right else last
        asked = left.select("*", F.least(low, "start").alias("_low"), high.alias("_high"))
        read = asked.where("_high >= _low").select("contig", (F.col("_low") + 1).alias("start"), (F.col("_high") + 1).alias("stop")).distinct()
        found = interval_sequences(read, chunks, size).select("contig", (F.col("start") - 1).alias("_low"), (F.col("stop") - 1).alias("_high"), F.col("seq").alias("_seq"))
        rows = asked.join(found, ["contig", "_low", "_high"], "left").withColumn("_seq", F.coalesce("_seq", F.lit("")))
        n = F.greatest(F.col("end") - F.col("start") + 1, F.lit(0)).cast("int")
        if right:
            rows = _jumped(rows, F.reverse(F.substring(F.col("_seq"), n + 1, F.char_length("_seq"))), F.reverse(F.left("_seq", n)), F.reverse("alt"), window)
        else:
            rows = _jumped(rows, F.left("_seq", F.char_length("_seq") - n), F.right("_seq", n), F.col("alt"), window)
        step, alt = (F.col("_moved"), F.reverse("_alt")) if right else (-F.col("_moved"), F.col("_alt"))
        on = (F.col("_moved") > 0) & (F.col("_moved") == F.char_length("_before"))
        rows = cut(rows.select("id", "contig", (F.col("start") + step).alias("start"), (F.col("end") + step).alias("end"), alt.alias("alt"), "_limit", on.alias("_on")), "shifted-variants")
        done.append(rows.where("NOT _on").select(*columns))
        left = rows.where("_on").drop("_on")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        window *= 4


def variant_text(start: Column, end: Column, alt: Column) -> Column:
    """How a variant is written: start-end:alt."""
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), alt)


def site_alleles(variants: DataFrame, chunks: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """Variants (keys, contig, number, start, end, alt; 0-based) of a site as its alleles: keys, contig, first (place), alleles (the reference over the site, then each variant on it, by number).

    A site reaches from the first to the last base of its variants; one that inserts counts with the base before it, if there is one. An allele without bases
    is ``<DEL>``. The reference is read from chunks of ``size`` bases, over the sites only.
    """
    low = F.greatest(F.least("start", "end"), F.lit(0))
    own = F.array_sort(F.collect_list(F.struct("number", "start", "end", "alt")))
    rows = variants.groupBy(*keys, "contig").agg(F.min(low).cast("long").alias("first"), F.greatest(F.max("end"), F.min(low)).cast("long").alias("last"), own.alias("_own"))
    found = interval_sequences(rows.select("contig", (F.col("first") + 1).alias("start"), (F.col("last") + 1).alias("stop")).distinct(), chunks, size)
    rows = rows.join(found.select("contig", (F.col("start") - 1).alias("first"), (F.col("stop") - 1).alias("last"), "seq"), ["contig", "first", "last"])
    made = lambda v: F.concat(F.left("seq", (v["start"] - F.col("first")).cast("int")), v["alt"], F.substring(F.col("seq"), (F.greatest(v["end"] + 1, v["start"]) - F.col("first") + 1).cast("int"), F.char_length("seq")))
    texts = F.transform(F.concat(F.array("seq"), F.transform("_own", made)), lambda t: F.when(t == "", "<DEL>").otherwise(t))
    return rows.select(*keys, "contig", "first", texts.alias("alleles"))


VARIANT = "array<struct<start:bigint,stop:bigint,alt:string,at:bigint>>"


def cigar_variants(ref: Column, alt: Column, ops: Column, *, matches: bool = False) -> Column:
    """Variants that an alignment (operations of ``alt`` on ``ref``, both from their start) tells: array of struct start, stop, alt, at (the place in ``alt``).

    Single bases that differ, insertions (stop = start - 1) and deletions (alt is empty), in order; with ``matches``, runs of equal bases too, with alt ``.``. Bases
    that both sides lack end a run of pairs.
    """
    at = F.aggregate(
        ops, F.struct(F.lit(0).alias("r"), F.lit(0).alias("a"), F.array().cast("array<struct<op:string,n:int,r:int,a:int>>").alias("all")),
        lambda s, o: F.struct(
            (s["r"] + F.when(o["op"].isin("M", "=", "X", "D", "N"), o["len"]).otherwise(0)).alias("r"), (s["a"] + F.when(o["op"].isin("M", "=", "X", "I", "S"), o["len"]).otherwise(0)).alias("a"),
            F.concat(s["all"], F.array(F.struct(o["op"].alias("op"), o["len"].alias("n"), s["r"].alias("r"), s["a"].alias("a")))).alias("all"),
        ),
    )["all"]
    base = lambda s, k: F.substring(s, k + 1, F.lit(1))
    row = lambda a, b, text, k: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), text.alias("alt"), k.cast("long").alias("at"))
    none = F.array().cast(VARIANT)

    def pairs(o: Column) -> Column:
        n = F.greatest(F.least(o["n"], F.char_length(ref) - o["r"], F.char_length(alt) - o["a"]), F.lit(0))
        every = F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n)
        differ = F.filter(every, lambda k: base(ref, o["r"] + k) != base(alt, o["a"] + k))
        found = F.transform(differ, lambda k: row(o["r"] + k, o["r"] + k, base(alt, o["a"] + k), o["a"] + k))
        if not matches:
            return found
        edges = F.concat(F.array(F.lit(-1)), differ, F.array(n))
        between = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        runs = F.transform(F.filter(between, lambda g: g["y"] > g["x"] + 1), lambda g: row(o["r"] + g["x"] + 1, o["r"] + g["y"] - 1, F.lit("."), o["a"] + g["x"] + 1))
        return F.array_sort(F.concat(found, runs))

    return F.flatten(F.transform(at, lambda o: F.when(o["op"].isin("M", "=", "X"), pairs(o)).when(o["op"] == "I", F.array(row(o["r"], o["r"] - 1, F.substring(alt, o["a"] + 1, o["n"]), o["a"])))
                                 .when(o["op"] == "D", F.array(row(o["r"], o["r"] + o["n"] - 1, F.lit(""), o["a"]))).otherwise(none)))


def symbolic_allele(kind: Column, ref_segment: Column, inserted: Column) -> Column:
    """Bases that a symbolic allele stands for in place of the reference segment."""
    complement = F.reverse(F.translate(ref_segment, "ACGT", "TGCA"))
    return (
        F.when(kind == "<DEL>", F.lit("")).when(kind == "<INS>", F.concat(ref_segment, inserted)).when(kind == "<DUP>", F.concat(ref_segment, ref_segment)).when(kind == "<INV>", complement).otherwise(kind)
    )


def gapped_differences(rows: DataFrame) -> DataFrame:
    """Variants between two gapped strings of one length (id, ref, alt): start and stop on the bases of ref, and both sides' bases.

    Columns that differ and touch are one variant; stop is start - 1 for an insertion.
    """
    cells = rows.select("id", F.posexplode(F.arrays_zip(F.split("ref", "").alias("r"), F.split("alt", "").alias("a"))).alias("k", "c")).select("id", "k", F.col("c.r").alias("r"), F.col("c.a").alias("a"))
    order = Window.partitionBy("id").orderBy("k")
    base = F.sum((F.col("r") != "-").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumns({"base": F.coalesce(base, F.lit(0)), "same": F.sum((F.col("r") == F.col("a")).cast("long")).over(order)}).where("r <> a")
    text = lambda c: F.replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: x[c]), ""), F.lit("-"), F.lit(""))
    out = cells.groupBy("id", "same").agg(F.min("base").alias("start"), text("r").alias("ref"), text("a").alias("alt"))
    return out.select("id", "start", (F.col("start") + F.char_length("ref") - 1).alias("stop"), "ref", "alt")


def realigned(rows: DataFrame) -> DataFrame:
    """Variants (id, pos, ref, alt; id is unique) as substitutions, insertions and deletions of their end-to-end alignment.

    Each base that differs is a row of its own; stop is start - 1 for an insertion. Where a side has
    fewer than two bases, the two are held against each other from the left and nothing is aligned.
    """
    rows = rows.select("id", F.col("pos").cast("long"), F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("alt", F.lit("")).alias("alt"))
    size = F.greatest(F.char_length("ref"), F.char_length("alt"))
    short = F.least(F.char_length("ref"), F.char_length("alt")) < 2
    plain = rows.where(short).select("id", "pos", F.rpad("ref", size, F.lit("-")).alias("gapped_ref"), F.rpad("alt", size, F.lit("-")).alias("gapped_alt"))
    found = alignment.global_alignments(rows.where(~short)).select(plain.columns).unionByName(plain)
    cells = found.select("id", "pos", F.posexplode(F.arrays_zip(F.split("gapped_ref", "").alias("r"), F.split("gapped_alt", "").alias("a"))).alias("k", "c"))
    cells = cells.select("id", "pos", "k", "c.r", "c.a").where("r <> ''")
    kind = F.when(F.col("r") == "-", "insertion").when(F.col("a") == "-", "deletion").when(F.col("r") == F.col("a"), "same").otherwise("substitution")
    order = Window.partitionBy("id").orderBy("k")
    base = F.sum((F.col("r") != "-").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumns({"kind": kind, "base": F.coalesce(base, F.lit(0))})
    begins = (F.col("kind") == "substitution") | (F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit("")))
    cells = cells.withColumn("run", F.sum(begins.cast("long")).over(order)).where("kind <> 'same'")
    text = lambda c: F.replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: x[c]), ""), F.lit("-"), F.lit(""))
    out = cells.groupBy("id", "run").agg(F.first("kind").alias("kind"), F.min(F.col("pos") + F.col("base")).alias("start"), text("r").alias("ref"), text("a").alias("alt"))
    return out.select("id", "kind", "start", (F.col("start") + F.char_length("ref") - 1).alias("stop"), "ref", "alt")


def substitution_counts(primitives: DataFrame, keys: list[str]) -> DataFrame:
    """Transitions and transversions among substitutions (ref, alt)."""
    change = is_transition(F.col("ref"), F.col("alt"))
    return primitives.groupBy(*keys).agg(F.count_if(change).alias("transitions"), F.count_if(~change).alias("transversions"))
