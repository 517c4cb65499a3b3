"""Alignment strings as arrays of operations, folded with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = r"([0-9]+)([MXIDNS=])"


def operations(cigar: Column) -> Column:
    """``4M1X3M`` to an array of struct len, op, by one pattern."""
    parts = F.regexp_extract_all(cigar, F.lit(OPS), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.left(p, F.char_length(p) - 1).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def total(ops: Column, letters: str) -> Column:
    """Sum of the lengths of the given operations."""
    return F.aggregate(ops, F.lit(0), lambda n, o: n + F.when(o["op"].isin(*letters), o["len"]).otherwise(0))


#: Sums of operations by what they say of the bases.
SUMS = {"matched": "M=", "mismatched": "X", "inserted": "I", "deleted": "D", "clipped": "S", "unknown": "N"}


def sums(ops: Column) -> Column:
    """All sums of SUMS in one pass, as a struct."""
    zero = F.struct(*[F.lit(0).alias(n) for n in SUMS])
    return F.aggregate(ops, zero, lambda s, o: F.struct(*[(s[n] + F.when(o["op"].isin(*letters), o["len"]).otherwise(0)).alias(n) for n, letters in SUMS.items()]))


def graph_nodes(cigar: Column) -> Column:
    """``0[8M]1[4M1X3M]`` to an array of struct node, ops, in path order."""
    ids = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)\[([^\]]*)\]"), F.lit(1))
    inner = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)\[([^\]]*)\]"), F.lit(2))
    return F.zip_with(ids, inner, lambda n, c: F.struct(n.cast("int").alias("node"), operations(c).alias("ops")))


def is_bad_alignment(ops: Column, fraction: float = 0.8) -> Column:
    """Whether fewer than ``fraction`` of the read's bases (rounded) are not clipped."""
    return few_aligned(sums(ops), fraction)


def few_aligned(found: Column, fraction: float = 0.8) -> Column:
    """:func:`is_bad_alignment` from a struct of :func:`sums`, which should be a column of its own so that it is summed once."""
    aligned = found["matched"] + found["mismatched"] + found["inserted"]
    return aligned < F.round((aligned + found["clipped"]) * fraction)


def node_supported(ops: Column, node_length: Column, read_length: Column) -> Column:
    """A node shorter than half the read must match throughout; a longer one up to half its length may differ."""
    return _differs_little(total(ops, "XIDS"), node_length, read_length)


def node_supported_by(found: Column, node_length: Column, read_length: Column) -> Column:
    """:func:`node_supported` from a struct of :func:`sums`."""
    return _differs_little(found["mismatched"] + found["inserted"] + found["deleted"] + found["clipped"], node_length, read_length)


def _differs_little(differs: Column, node_length: Column, read_length: Column) -> Column:
    return F.when(2 * node_length < read_length, differs == 0).otherwise(2 * differs <= node_length)


def edge_supported(left: Column, left_length: Column, right: Column, right_length: Column, read_length: Column) -> Column:
    """Both nodes of a crossing have enough matched bases: a tenth of the read and one, or the whole node."""
    side = lambda ops, length: _side_supported(total(ops, "MXIS="), total(ops, "MXDN="), total(ops, "M="), length, read_length)
    return side(left, left_length) & side(right, right_length)


def edge_supported_by(left: Column, left_length: Column, right: Column, right_length: Column, read_length: Column) -> Column:
    """:func:`edge_supported` from structs of :func:`sums`."""

    def side(s: Column, length: Column) -> Column:
        both = s["matched"] + s["mismatched"]
        return _side_supported(both + s["inserted"] + s["clipped"], both + s["deleted"] + s["unknown"], s["matched"], length, read_length)

    return side(left, left_length) & side(right, right_length)


def _side_supported(query: Column, ref: Column, matched: Column, length: Column, read_length: Column) -> Column:
    need = F.floor(read_length / 10).cast("int") + 1
    return (matched >= F.least(ref, need)) & (query < 2 * ref) & (matched >= F.least(length, need))


def of_placement(read: Column, ref: Column) -> Column:
    """The alignment string of a read on a stretch of equal length: runs of equal bases (M), bases that differ (X) and Ns on either side (N), with Ns of the stretch at its ends clipped (S)."""
    n = F.least(F.char_length(read), F.char_length(ref))
    # Each part is bound before what is made of it, so that it is made once for a row and not once for a base.
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    letters = lambda s, n: F.slice(F.split(s, ""), F.lit(1), n)

    def clipped(x: Column) -> Column:
        left = x["n"] - F.char_length(F.ltrim(x["ref"], F.lit("N")))
        right = F.when(left == x["n"], F.lit(0)).otherwise(x["n"] - F.char_length(F.rtrim(x["ref"], F.lit("N"))))
        return F.struct(x["n"].alias("n"), left.alias("left"), right.alias("right"), letters(x["read"], x["n"]).alias("a"), letters(x["ref"], x["n"]).alias("b"))

    def runs(x: Column) -> Column:
        pairs = F.zip_with(x["a"], x["b"], lambda a, b: F.when((a == "N") | (b == "N"), "N").when(a == b, "M").otherwise("X"))
        return packed_runs(F.transform(pairs, lambda op, i: F.when((i < x["left"]) | (i >= x["n"] - x["right"]), "S").otherwise(op)))

    return let(let(F.struct(read.alias("read"), F.left(ref, n).alias("ref"), n.alias("n")), clipped), runs)


def packed_runs(ops: Column) -> Column:
    """Single operations to an alignment string: equal neighbours are counted."""
    done = lambda s: F.when(s["n"] == 0, s["text"]).otherwise(F.concat(s["text"], s["n"].cast("string"), s["op"]))
    step = lambda s, o: F.struct(F.when(s["op"] == o, s["n"] + 1).otherwise(1).alias("n"), o.alias("op"), F.when(s["op"] == o, s["text"]).otherwise(done(s)).alias("text"))
    return F.aggregate(ops, F.struct(F.lit(0).alias("n"), F.lit("").alias("op"), F.lit("").alias("text")), step, done)


#: Codes of operations in the low four bits: fixed values of the format.
CODES = {"M": 0, "I": 1, "D": 2, "N": 3, "S": 4, "H": 5, "P": 6, "=": 7, "X": 8}


def encoded(ops: Column) -> Column:
    """Operations as integers, length over code."""
    code = lambda op: F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), op)
    return F.transform(ops, lambda o: F.shiftleft(o["len"], 4).bitwiseOR(code(o["op"])))


def decoded(codes: Column) -> Column:
    """The alignment string of :func:`encoded` operations."""
    letter = lambda c: F.element_at(F.array(*map(F.lit, CODES)), c.bitwiseAND(15) + 1)
    return F.array_join(F.transform(codes, lambda c: F.concat(F.shiftright(c, 4).cast("string"), letter(c))), "")
