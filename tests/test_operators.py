"""Operators over small tables, formats and streams."""

import hashlib
import collections
import random
from functools import lru_cache

from pyspark.sql import functions as F

from graphcall.functions import cigar, sequence
from graphcall.operators import alignment, alleles, building, graphs, haplotypes, intervals
from graphcall.sources import files
from graphcall.streaming import support


def test_regions_round_trip(spark):
    rows = spark.createDataFrame([("chr1:1,000-2000",), ("chr1:5",), ("chrX",)], "t string").select(sequence.parse_region(F.col("t")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in rows] == [("chr1", 999, 1999), ("chr1", 4, -1), ("chrX", -1, -1)]
    back = spark.createDataFrame(rows).select(sequence.format_region(F.col("chrom"), F.col("start"), F.col("end")).alias("t")).collect()
    assert [r.t for r in back] == ["chr1:1000-2000", "chr1:5", "chrX"]


def test_sequences(spark):
    row = spark.range(1).select(sequence.reverse_complement(F.lit("AACGN")).alias("r"), sequence.kmers(F.lit("ACNGTA"), 2).alias("k"), sequence.kmer_code(F.lit("ACGT")).alias("c")).first()
    assert row.r == "NCGTT" and [(w.pos, w.kmer) for w in row.k] == [(0, "AC"), (3, "GT"), (4, "TA")] and row.c == 0b00011011


def test_graph_cigar(spark):
    nodes = spark.range(1).select(cigar.graph_nodes(F.lit("0[8M]1[4M1X3M]3[8M]")).alias("n")).first().n
    assert [(n.node, [(o.len, o.op) for o in n.ops]) for n in nodes] == [(0, [(8, "M")]), (1, [(4, "M"), (1, "X"), (3, "M")]), (3, [(8, "M")])]


NODES = [(0, "A" * 11), (1, "T" * 8), (2, "G" * 8), (3, "A" * 11)]
EDGES = [(0, 1), (1, 3), (0, 2), (2, 3), (0, 3)]
READS = [
    ("AAAAAAAATTTTCTTTAAAAAAAA", 19, False), ("TTTTTTAAAGAAAATTTTTTT", 16, True), ("AAAAAGCGGGGGGAAAAAA", 14, False),
    ("AAAAGCGGGGGGAAAAAA", 13, False), ("TTTTTTCCCCCCGCTTTTT", 14, True), ("AAAAAAAAAAAAAAAAAAA", 19, False),
]


def test_graph_alignment(spark):
    rows = spark.createDataFrame([(k, s) for k, (s, _, _) in enumerate(READS)], "id long, seq string")
    got = {r.id: (r.score, r.reverse) for r in alignment.graph_scores(rows, NODES, EDGES).collect()}
    assert [got[k] for k in range(6)] == [(score, reverse) for _, score, reverse in READS]


def test_gapless(spark):
    paths = spark.createDataFrame([("p", "ACGTTGCAAGCTTACGGATCCATGCA"), ("q", "TTTTTTTTTTGGGGGGGGGG")], "path string, seq string")
    reads = spark.createDataFrame([(1, "GCAAGCTTACGGATC"), (2, "GCAAGCTTACGGTTC"), (3, "GATCCGTAAGCTTGC"), (4, "CCCCCCCCCCCCCCC")], "id long, seq string")
    got = {r.id: (r.path, r.start, r.reverse, r.mismatches, r.status) for r in alignment.gapless(reads, paths, seed=6).collect()}
    assert got == {1: ("p", 5, False, 0, "MAPPED"), 2: ("p", 5, False, 1, "MAPPED"), 3: ("p", 5, True, 0, "MAPPED")}


def test_whole_reads_by_brute_force(spark):
    from graphcall.plans import catalog
    from graphcall.plans.registry import Views

    where, q = "/root/testdata/sf0.001", catalog.queries()
    bases = {r.id: r.seq for r in Views(spark, where).bases.collect()}
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    words = collections.Counter(p[k : k + 10] for p in bases.values() for k in range(len(p) - 9))
    want, tally = set(), {}
    for read, seq in bases.items():
        given, found = back(seq) if read % 2 else seq, []
        for reverse, r in ((False, given), (True, back(given))):
            for path, p in bases.items():
                for at in range(len(p) - len(r) + 1):
                    off = [x != y for x, y in zip(r, p[at:], strict=False)]
                    seeds = any(not any(off[k : k + 10]) and set(r[k : k + 10]) <= set("ACGT") and words[r[k : k + 10]] == 1 for k in range(len(r) - 9))
                    if seeds and sum(off) <= 2:
                        found.append((read, path, at, reverse, sum(off)))
        best = [f for f in found if f[4] == min(x[4] for x in found)]
        status = "MAPPED" if len(best) == 1 else "BAD_ALIGN"
        want |= {(*f, status) for f in best}
        row = tally.setdefault(read % 50, [0] * 5)
        ok = any(f[:4] == (read, read, 0, read % 2 == 1) for f in best)
        for k, add in enumerate((1, len(best) == 1, len(best) > 1, not best, len(best) == 1 and not ok)):
            row[k] += add
    got = q["gapless_placement"](spark, where).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    assert {r.truth: list(r)[1:] for r in q["gapless_validation"](spark, where).collect()} == tally

    variants = set()
    for read, seq in bases.items():
        base, run = 0, None
        for r, a in [*zip(seq.replace("C", "-"), seq[::-1].replace("A", "-"), strict=True), ("", "")]:
            if r != a:
                run = run or [base, "", ""]
                run[1:] = run[1] + r.replace("-", ""), run[2] + a.replace("-", "")
            elif run:
                variants.add((read, run[0], run[0] + len(run[1]) - 1, run[1], run[2]))
                run = None
            base += r not in ("-", "")
    assert {tuple(r) for r in q["whole_gapped_differences"](spark, where).collect()} == variants


def test_left_shift(spark):
    rows = spark.createDataFrame([(1, "ACGTTTTA", 6, 6, ""), (2, "ACGTTTTA", 7, 6, "T"), (3, "ACACACG", 4, 5, ""), (4, "ANTTT", 4, 4, ""), (5, "ACGT", 2, 2, "A")], "id int, seq string, start int, end int, alt string")
    got = {r.id: (r.start, r.end, r.alt) for r in alleles.left_shifted(rows).collect()}
    assert got == {1: (3, 3, ""), 2: (3, 2, "T"), 3: (0, 1, ""), 4: (2, 2, ""), 5: (2, 2, "A")}


def test_shift_keeps_the_haplotype(spark):
    rows = spark.createDataFrame([(k, "ACGTTTTAGAGAGACCCA", k + 3, k + 4, "") for k in range(10)], "id int, seq string, start int, end int, alt string")
    whole = alleles.applied(F.col("seq"), F.col("start").cast("int"), F.col("end").cast("int"), F.col("alt"))
    before = {r.id: r.s for r in rows.select("id", whole.alias("s")).collect()}
    after = {r.id: r.s for r in alleles.left_shifted(rows).join(rows.select("id", "seq"), "id").select("id", whole.alias("s")).collect()}
    assert before == after


def test_overlap_join_has_no_repeats(spark):
    a = spark.createDataFrame([(k, k * 7 % 300, k * 7 % 300 + k % 90) for k in range(120)], "id int, start int, stop int")
    b = a.select(F.col("id").alias("r_id"), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"), F.lit(1).alias("g"))
    got = intervals.overlap_join(a.withColumn("g", F.lit(1)), b, ["g"], width=16).select("id", "r_id").collect()
    rows = a.collect()
    want = {(x.id, y.id) for x in rows for y in rows if x.start <= y.stop and y.start <= x.stop}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_templates(spark):
    events = [(41, 80, None, 150, "del"), (41, 80, "ACG", 150, "swap"), (41, 110, None, 30, "longdel"), (41, 110, "ACG", 30, "longswap"), (41, 40, "ACG", 150, "ins")]
    rows = spark.createDataFrame(events, "start int, end int, ins string, flank int, want string")
    assert all(r.kind == r.want for r in rows.select("want", graphs.event_type(F.col("start"), F.col("end"), F.col("ins"), F.col("flank")).alias("kind")).collect())


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:c1\tLN:10\nr1\t99\tc1\t5\t60\t4M\t=\t9\t8\tACGT\tIIII\nr1\t2147\tc1\t5\t60\t4M\t=\t9\t8\tACGT\tIIII\n")
    (tmp_path / "a.fa").write_text(">c1 first\nacgtnx\nACGT\n>c2\nTT\n")
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\nc1\t10\tv1\tACG\tA,T\t.\tPASS\tEND=12;SVTYPE=DEL\tGT\t0/1\nc1\t20\tv2\tA\t<INS>\t.\t.\tSEQ=ACG\n")
    (tmp_path / "m.tsv").write_text("#id\tpath\tdepth\tread length\tsex\na\tx\t20\t100\tMale\nb\ty\t45\t150\t\n")
    (tmp_path / "g.json").write_text('{"graph": {"target_regions": ["c1:1-10"], "nodes": [{"name": "LF", "sequence": "AC"}], "edges": [{"from": "LF", "to": "RF"}]}}')
    url = lambda n: f"file://{tmp_path}/{n}"
    sam = files.read_sam(spark, url("a.sam")).collect()
    assert len(sam) == 1 and sam[0].pos == 4 and sam[0].mate_chrom == "c1" and sam[0].is_first_mate and not sam[0].is_reverse and sam[0].is_mate_reverse
    assert {r.contig: r.seq for r in files.read_fasta(spark, url("a.fa")).collect()} == {"c1": "ACGTNNACGT", "c2": "TT"}
    assert [(r.chunk_start, r.seq) for r in files.chunked(files.read_fasta(spark, url("a.fa")).where("contig = 'c1'"), 4).collect()] == [(0, "ACGT"), (4, "NNAC"), (8, "GT")]
    vcf = {r.id: r for r in files.read_vcf(spark, url("a.vcf")).collect()}
    assert vcf["v1"].alts == ["A", "T"] and vcf["v1"].end == 12 and vcf["v1"].info["SVTYPE"] == "DEL" and vcf["v2"].end == 20
    manifest = {r.id: (r.depth_sd, r.sex, r.read_length) for r in files.read_manifest(spark, url("m.tsv")).collect()}
    assert manifest == {"a": (10.0, "m", 100), "b": (15.0, "u", 150)}
    graph = files.read_graphs(spark, url("g.json")).first()
    assert graph.nodes[0].name == "LF" and graph.edges[0]["from"] == "LF" and graph.target_regions == ["c1:1-10"]


def test_windowed_counts_as_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp_seconds(id * 600) AS ts, id % 5 AS user_id, CAST(id % 2 AS STRING) AS event_type, CAST(id AS DOUBLE) AS value FROM range(100)")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    query = support.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("windows").collect()}
    assert got == {tuple(r) for r in support.windowed_counts(rows).collect()} and len(got) > 20


def test_right_shift(spark):
    rows = spark.createDataFrame([(1, "ACGTTTTA", 3, 3, ""), (2, "ACGTTTTA", 3, 2, "T"), (3, "ACACACG", 0, 1, ""), (4, "TTTNA", 0, 0, "")], "id int, seq string, start int, end int, alt string")
    got = {r.id: (r.start, r.end, r.alt) for r in alleles.right_shifted(rows).collect()}
    assert got == {1: (6, 6, ""), 2: (7, 6, "T"), 3: (4, 5, ""), 4: (2, 2, "")}


def test_gapped_differences(spark):
    rows = spark.createDataFrame([(1, "AC-GTTA", "ACCG--T"), (2, "ACGT", "ACGT")], "id int, ref string, alt string")
    assert {(r.start, r.stop, r.ref, r.alt) for r in alleles.gapped_differences(rows).collect()} == {(2, 1, "", "C"), (3, 5, "TTA", "T")}


def best_score(ref, alt):
    """Brute force over the last column's kind: 0 pair, 1 deletion, 2 insertion."""

    @lru_cache(None)
    def at(i, j, kind):
        if i == 0 and j == 0:
            return 0 if kind == 0 else -(10**9)
        if kind == 0:
            return -(10**9) if not (i and j) else max(at(i - 1, j - 1, k) for k in range(3)) + (1 if ref[i - 1] == alt[j - 1] else -4)
        i, j = (i - 1, j) if kind == 1 else (i, j - 1)
        return -(10**9) if i < 0 or j < 0 else max(at(i, j, k) - (1 if k == kind else 6) for k in range(3))

    return max(at(len(ref), len(alt), k) for k in range(3))


def score_of(a, b):
    total, kind = 0, 0
    for x, y in zip(a, b, strict=True):
        now = 1 if y == "-" else 2 if x == "-" else 0
        total += (1 if x == y else -4) if not now else -1 if now == kind else -6
        kind = now
    return total


def test_global_alignment(spark):
    r = random.Random(3)
    pairs = [("".join(r.choices("ACG", k=r.randrange(12))), "".join(r.choices("ACG", k=r.randrange(12)))) for _ in range(300)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)] + [(300, None, "A"), (301, None, None)], "id int, ref string, alt string")
    for x in alignment.global_alignments(rows).collect():
        assert x.gapped_ref.replace("-", "") == (x.ref or "") and x.gapped_alt.replace("-", "") == (x.alt or "")
        assert x.score == best_score(x.ref or "", x.alt or "") == score_of(x.gapped_ref, x.gapped_alt)


def test_realigned(spark):
    rows = spark.createDataFrame([(1, 100, "ACGTACGTAC", "ACGTTCGTAC"), (2, 50, "ACGTACGTTTGGA", "ACGTACGGA"), (3, 7, "AC", "AC"), (4, 9, "", "GG"), (5, 20, "A", "TTA"), (6, 1, None, "C")], "id int, pos int, ref string, alt string")
    got = sorted(tuple(x) for x in alleles.realigned(rows).collect())
    assert got[0] == (1, "substitution", 104, 104, "A", "T") and {x[0] for x in got[1:-4]} == {2}
    assert got[-4:] == [(4, "insertion", 9, 8, "", "GG"), (5, "insertion", 21, 20, "", "TA"), (5, "substitution", 20, 20, "A", "T"), (6, "insertion", 1, 0, "", "C")]
    assert sum(len(x[4]) - len(x[5]) for x in got if x[0] == 2) == 4
    counts = alleles.substitution_counts(spark.createDataFrame([("A", "G"), ("C", "T"), ("A", "T")], "ref string, alt string"), []).first()
    assert tuple(counts) == (2, 1)


def test_fragment_paths(spark):
    reads = [("x", [0, 1]), ("x", [1, 3]), ("y", [0, 2, 3]), ("y", [2]), ("y", [5, 6]), ("z", [])]
    paths = haplotypes.fragment_paths(spark.createDataFrame(reads, "f string, path array<bigint>"), ["f"])
    assert sorted((x.f, x.path) for x in paths.collect()) == [("x", [0, 1, 3]), ("y", [0, 2, 3]), ("y", [5, 6])]
    sets = haplotypes.families(paths.withColumn("g", F.lit(1)), ["g"], "f").collect()
    assert sorted([(e.a, e.b) for e in x.edges] for x in sets) == [[(0, 1), (1, 3)], [(0, 2), (2, 3), (5, 6)]] and {x.n for x in sets} == {1}


def test_haplotypes(spark):
    a, b = [(0, 1), (1, 3), (3, 4), (4, 6)], [(0, 2), (2, 3), (3, 5), (5, 6)]
    crossed = [(0, 1), (1, 3), (3, 5), (5, 6)]
    rows = [(1, a), (1, b), (2, a), (2, b), (2, crossed), (3, a[:2]), (3, b[:2]), (3, a[2:]), (3, b[2:])]
    found = haplotypes.haplotypes(spark.createDataFrame(rows, "g int, edges array<struct<a: bigint, b: bigint>>"), ["g"])
    got = {g: sorted((x.group, x.path) for x in found.collect() if x.g == g) for g in (1, 2, 3)}
    assert got[1] == [(0, [0, 1, 3, 4, 6]), (0, [0, 2, 3, 5, 6])]
    apart = [(0, [0, 1, 3]), (0, [0, 2, 3]), (1, [3, 4, 6]), (1, [3, 5, 6])]
    assert got[2] == got[3] == apart


def test_linear_families(spark):
    rows = [([(0, 1), (1, 3)],), ([(0, 1), (3, 4)],), ([(0, 1), (0, 2)],), ([(0, 1), (2, 3)],)]
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], "a bigint, b bigint")
    found = spark.createDataFrame(rows, "edges array<struct<a: bigint, b: bigint>>").withColumn("g", F.lit(1))
    kept = haplotypes.linear(found, graphs.reachable(edges.withColumn("g", F.lit(1)), ["g"], 4), ["g"])
    assert sorted([(e.a, e.b) for e in x.edges] for x in kept.collect()) == [[(0, 1), (1, 3)], [(0, 1), (3, 4)]]


def test_block_ids(spark, tmp_path):
    (tmp_path / "v.vcf").write_text("##x\n")
    digests = files.file_digests(spark, f"file://{tmp_path}/v.vcf")
    assert [tuple(x) for x in digests.collect()] == [("v.vcf", hashlib.sha256(b"##x\n").hexdigest())]
    rows = spark.createDataFrame([("v.vcf", "c1", 0), ("v.vcf", "c1", 0), ("v.vcf", "c1", 4), ("v.vcf", "c2", 1)], "file string, chrom string, block int")
    got = sorted((x.chrom, x.block, x.block_id.split(":")[1]) for x in building.block_ids(rows, digests).collect())
    assert got == [("c1", 0, "1"), ("c1", 0, "1"), ("c1", 4, "2"), ("c2", 1, "3")]
