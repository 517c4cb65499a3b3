"""Shifts over chunks and variants of alignment strings, against loops of one base."""

import random
import re

from pyspark.sql import functions as F

from graphcall.functions import cigar
from graphcall.operators import alleles
from graphcall.sources import files


def loop(seq, start, end, alt, right, bound):
    """One base a step."""
    if (end >= start) == bool(alt):
        return start, end, alt
    while True:
        if right:
            if end + 1 >= len(seq) or seq[end + 1] == "N" or (bound is not None and end >= bound) or seq[end + 1] != (alt[0] if alt else seq[start]):
                return start, end, alt
            alt = alt[1:] + seq[end + 1] if alt else alt
            start, end = start + 1, end + 1
        else:
            if start == 0 or seq[start - 1] == "N" or (bound is not None and start <= bound) or seq[start - 1] != (alt[-1] if alt else seq[end]):
                return start, end, alt
            alt = seq[start - 1] + alt[:-1] if alt else alt
            start, end = start - 1, end - 1


def test_shifts(spark):
    rng = random.Random(5)
    contigs = {c: "".join(rng.choice([u * rng.randint(1, 30), rng.choice("ACGTN")]) for u in rng.choices(["A", "AC", "GTT", "ACGA"], k=40)) for c in "xyz"}
    rows, k = [], 0
    for c, s in contigs.items():
        for _ in range(120):
            start = rng.randint(0, len(s) - 6)
            kind = rng.random()
            n, alt = (rng.randint(1, 5), "") if kind < 0.45 else (0, s[max(0, start - rng.randint(1, 4)) : start] or "A") if kind < 0.9 else (2, "TG")
            rows.append((k, c, start, start + n - 1, alt, rng.choice([None, start, max(0, start - 7)]), rng.choice([None, start + n - 1, start + n + 5])))
            k += 1
    frame = spark.createDataFrame(rows, "id long, contig string, start long, end long, alt string, low long, high long")
    chunks = files.chunked(spark.createDataFrame(list(contigs.items()), "contig string, seq string"), 50)
    for right, bound in ((False, None), (False, "low"), (True, None), (True, "high")):
        got = {r.id: (r.start, r.end, r.alt) for r in alleles.shifted(frame, chunks, 50, right=right, window=4, bound=bound).collect()}
        assert got == {r[0]: loop(contigs[r[1]], r[2], r[3], r[4], right, (r[6] if right else r[5]) if bound else None) for r in rows}
    whole = frame.join(spark.createDataFrame(list(contigs.items()), "contig string, seq string"), "contig")
    for right, f in ((False, alleles.left_shifted), (True, alleles.right_shifted)):
        assert {r.id: (r.start, r.end, r.alt) for r in f(whole).collect()} == {r[0]: loop(contigs[r[1]], r[2], r[3], r[4], right, None) for r in rows}


def walk(ref, alt, text, matches):
    out, r, a = [], 0, 0
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)(\w|=)", text)):
        if op in "M=X":
            run = 0
            for _ in range(n):
                if ref[r] != alt[a]:
                    if run and matches:
                        out.append((r - run, r - 1, ".", a - run))
                    run = 0
                    out.append((r, r, alt[a], a))
                else:
                    run += 1
                r, a = r + 1, a + 1
            if run and matches:
                out.append((r - run, r - 1, ".", a - run))
        elif op == "I":
            out.append((r, r - 1, alt[a : a + n], a))
            a += n
        elif op == "D":
            out.append((r, r + n - 1, "", a))
            r += n
        elif op == "S":
            a += n
    return out


def test_variants_of_alignment_strings(spark):
    rng = random.Random(9)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    rows = []
    for k in range(150):
        ops = [(rng.randint(1, 6), rng.choice("MMM=XIDMS")) for _ in range(rng.randint(1, 7))]
        ref, alt = "", ""
        for n, op in ops:
            if op in "M=X":
                ref += (x := dna(n))
                alt += "".join(c if rng.random() < 0.6 else rng.choice("ACGT") for c in x)
            ref, alt = ref + (dna(n) if op == "D" else ""), alt + (dna(n) if op in "IS" else "")
        rows.append((k, ref, alt, "".join(f"{n}{op}" for n, op in ops)))
    frame = spark.createDataFrame(rows, "id int, ref string, alt string, text string")
    found = lambda m: alleles.cigar_variants(F.col("ref"), F.col("alt"), cigar.operations(F.col("text")), matches=m)
    for r in frame.select("id", found(False).alias("a"), found(True).alias("b"), cigar.sums(cigar.operations(F.col("text"))).alias("s")).collect():
        _, ref, alt, text = rows[r.id]
        assert [tuple(x) for x in r.a] == walk(ref, alt, text, False) and [tuple(x) for x in r.b] == walk(ref, alt, text, True)
        # Applied from the right, they give the alternative without its clipped bases.
        made = ref
        for x in reversed(r.a):
            made = made[: x.start] + x.alt + made[x.stop + 1 :]
        at, kept = 0, ""
        for n, op in re.findall(r"(\d+)(\w|=)", text):
            n = int(n)
            kept += alt[at : at + n] if op not in "SD" else ""
            at += n if op != "D" else 0
        assert made == kept
        want = {name: sum(int(n) for n, op in re.findall(r"(\d+)(\w|=)", text) if op in letters) for name, letters in cigar.SUMS.items()}
        assert r.s.asDict() == want
