"""Steps that must hold at sizes that Spark's own estimates don't tell."""

import random
import re

import __spark_entry__
import pytest
from graphcall.operators import alignment, counting, events, matching, records, rewriting
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["called_variant_edges", "called_variant_nodes", "gapless_placement", "gapless_validation", "kmer_seed_join", "exact_path_match"])
def test_no_table_is_broadcast(spark, name):
    """Words and texts made from rows are larger than their files, so no join on them may be a broadcast."""
    assert "BroadcastHashJoin" not in plan(__spark_entry__.queries()[name](spark, SMALL))


def test_exact_finds_all_places(spark):
    paths = spark.createDataFrame([("p", "ACGTACGTTTACG"), ("q", "GGACGTACG")], "path string, seq string")
    reads = spark.createDataFrame([(1, "ACGTACG"), (2, "ACG"), (3, "GGACGTACGA"), (4, ""), (5, None), (6, "TTTAN")], "id long, seq string")
    got = {tuple(r) for r in alignment.exact(reads, paths, seed=4).collect()}
    assert got == {(1, "p", 0), (1, "q", 2), (2, "p", 0), (2, "p", 4), (2, "p", 10), (2, "q", 2), (2, "q", 6)}


def test_exact_path_match_meets_all_contigs(spark):
    """Every row stands on its own contig, and some stand on others too."""
    q = __spark_entry__.queries()["exact_path_match"](spark, "/root/testdata/sf0.1")
    assert q.count() > q.where("path = read div 40").count() == 20000


@pytest.mark.parametrize("name", ["placement_cigars", "cigar_variants", "global_alignment", "kmer_stats"])
def test_rows_are_dealt_before_costly_work(spark, name):
    """One small file is one task, however much work its rows are."""
    text = plan(__spark_entry__.queries()[name](spark, SMALL))
    assert f"RoundRobinPartitioning({spark.conf.get('spark.sql.shuffle.partitions')})" in text


def test_placement_text_is_made_once(spark):
    """Moved down, the filter made every row's alignment string again, several times."""
    text = plan(__spark_entry__.queries()["placement_cigars"](spark, SMALL))
    assert text.count("regexp_extract_all(") == 1


def test_equal_reads_are_aligned_once(spark):
    import pandas as pd

    assert alignment._distinct(pd.Series(["AC", None, "AC", "N", "G"])) == (["AC", "N", "G"], [0, 1, 0, 1, 2])


def test_scores_are_narrow_where_reads_are_short():
    filled = alignment._Filled(["ACGT"], [(0, "ACGT")], [], True)
    assert filled.score[0].dtype == "int16" and filled.best.tolist() == [4] and filled.trace(0) == (0, "0[4M]")
    long = alignment._Filled(["ACGT" * 2100], [(0, "ACGT")], [], True)
    assert long.score[0].dtype == "int32" and long.best.tolist() == [4]


def test_alignment_keeps_its_tasks(spark):
    """Adaptive execution joins small partitions, and alignment of few bytes takes long; a named number stays."""
    graph = spark.createDataFrame([(1, [(0, "ACGTTGCA")], [])], "graph_id long, nodes array<struct<id:long,seq:string>>, edges array<struct<a:long,b:long>>")
    reads = spark.createDataFrame([(1, 1, "CGTTG"), (1, 2, "CGTTG"), (1, 3, None)], "graph_id long, id long, seq string")
    found = alignment.graph_alignments(reads, graph)
    assert plan(found).count("REPARTITION_BY_NUM") == 2
    assert sorted((r.id, r.score, r.graph_cigar) for r in found.collect())[:2] == [(1, 5, "0[5M]"), (2, 5, "0[5M]")]


def test_pieces_meet_variants_by_place(spark):
    """Joined by graph alone, pieces and variants make all pairs of a graph."""
    joins = re.findall(r"Join (\[.*?\]), \[", plan(__spark_entry__.queries()["haplotype_graph_nodes"](spark, SMALL)))
    assert joins and all("," in keys for keys in joins)


def test_labels_of_pieces_under_overlapping_variants(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(12):
        own = []
        for _ in range(rng.randint(1, 9)):
            start = 200 + rng.randint(0, 60)
            who = rng.choice([None, [], ["h1"], ["h2", "h1"], ["h3", "h3"], ["h2"]])
            own.append((g, start, start + rng.choice([-1, 0, 3, 20, 45]), rng.choice(["", "AC"]), rng.choice([None, [], ["x"], ["y", "x"]]), who))
        rows += own
        cuts = sorted({x for v in own for x in (v[1], v[2] + 1)} | {min(v[1] for v in own) - 150, max(v[2] for v in own) + 151})
        for a, b in zip(cuts, cuts[1:], strict=False):
            want[g, f"ref-{a}-{b - 1}"] = sorted({x for v in own if v[1] <= a and b - 1 <= v[2] for x in v[5] or []})
        for v in own:
            want[g, f"alt-{v[1]}-{v[2]}:{v[3]}"] = sorted({x for u in own if u[1:4] == v[1:4] for x in u[4] or []})
    frame = spark.createDataFrame(rows, "g long, start long, stop long, alt string, haplotypes array<string>, ref_haplotypes array<string>")
    got = rewriting.haplotype_nodes(frame, ["g"], F.lit("c")).collect()
    assert {(r.g, r.node): r.labels for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("alleles", [False, True])
def test_haplotype_edges_compute_nodes_once(spark, alleles, monkeypatch):
    """However dear nodes are, each is made once; insertions at one place are not all met with each other."""
    made, written = spark.sparkContext.accumulator(0), {}
    seen = F.udf(lambda n: made.add(1) is None, "boolean").asNondeterministic()
    variants = [(1, 200, 199, "A" * (k + 1), [f"h{k % 3}"], []) for k in range(30)]
    frame = spark.createDataFrame(variants, "g long, start long, stop long, alt string, haplotypes array<string>, ref_haplotypes array<string>")
    nodes = rewriting.haplotype_nodes(frame, ["g"], F.lit("c")).where(seen("node"))
    real = rewriting.cut
    monkeypatch.setattr(rewriting, "cut", lambda df, name="step": written.setdefault(name, real(df, name)))
    edges = rewriting.haplotype_edges(nodes, ["g"], alleles=alleles).collect()
    assert made.value == 32
    assert written["touching-nodes"].count() == 61 and len(edges) == (88 if alleles else 34)


def test_coverage_cells_carry_no_sequence(spark):
    """A row a base that carries its node's whole sequence grows with the square of the sequence, in every shuffle."""
    text = plan(__spark_entry__.queries()["node_coverage"](spark, SMALL))
    carried = re.findall(r"Generate .*, \[([^\]]*)\], (?:true|false), \[", text)
    assert len(carried) == 2 and not any("seq#" in columns for columns in carried)


def test_coverage_over_chunks(spark):
    texts = {"a": "ACGTNacgé\n😀TT", "b": "", "c": None, "d": "G", "e": "ACGTA"}
    nodes = spark.createDataFrame(list(texts.items()), "node string, seq string")
    seen = [("a", 9, True, False, 10), ("a", 9, True, True, 20), ("a", 12, False, False, 10), ("e", 4, False, True, 30), ("e", 5, True, False, 30)]
    bases = spark.createDataFrame(seen, "node string, offset long, is_ref boolean, is_reverse boolean, qual long")
    got = {(r.node, r.offset): (r.cpos, r.base, r.ref, r.ref_fwd, r.ref_rev, r.other, round(r.wref, 3), round(r.wother_rev, 3)) for r in counting.coverage(nodes, bases, "node", width=5).collect()}
    places = [(n, k, c) for n in sorted(texts) for k, c in enumerate(texts[n] or "")]
    assert list(zip(sorted(got), places, strict=True)) == [((n, k), (n, k, c)) for n, k, c in places]
    assert all(got[n, k][:2] == (i, c) for i, (n, k, c) in enumerate(places))
    assert got["a", 9][2:] == (2, 1, 1, 0, 1.89, 0) and got["a", 12][2:] == (0, 0, 0, 1, 0, 0) and got["e", 4][2:] == (0, 0, 0, 1, 0, 0.999)


def test_pairs_of_words_are_not_shuffled(spark):
    """They grow with the square of a word's copies; only sequences may move."""
    text = plan(__spark_entry__.queries()["kmer_seed_join"](spark, SMALL))
    below = text[text.index("MapInArrow") :]
    assert text.count("Exchange") == below.count("Exchange") and "Join" not in text


@pytest.mark.parametrize(("k", "letters", "together"), [(3, 1 << 24, 1 << 19), (3, 40, 1), (17, 90, 7)])
def test_seed_pairs_by_brute_force(spark, k, letters, together):
    rng = random.Random(k + letters)
    dna = lambda n: "".join(rng.choices("ACGTN", [6, 6, 6, 6, 1], k=n))
    parts = [dna(25) for _ in range(3)]
    made = lambda name: [(name(i), rng.choice(["", "ac", "é😀"]) + dna(rng.randint(0, 6)) + rng.choice(parts)[rng.randint(0, 5) :]) for i in range(30)]
    reads = [*made(lambda i: i // 2), (None, parts[0]), (None, parts[1] + "AC"), (77, None), (78, ""), (79, "A" * 40), (80, "AC")]
    paths = [*made(lambda i: f"p{i // 2}"), (None, parts[0] + parts[0]), ("p1", None), ("a", "A" * 50)]
    words = lambda s: [(i, s[i : i + k]) for i in range(len(s or "") - k + 1) if set(s[i : i + k]) <= set("ACGT")]
    first, want = {}, {}
    for name, s in reads:
        for i, w in words(s):
            first[name, w] = min(i, first.get((name, w), i))
    for name, s in paths:
        for i, w in words(s):
            for (read, x), at in first.items():
                if x == w:
                    n, least = want.get((read, name), (0, 10**9))
                    want[read, name] = (n + 1, min(least, i - at))
    found = matching.seed_pairs(spark.createDataFrame(reads, "id long, seq string"), spark.createDataFrame(paths, "id string, seq string"), k, letters=letters, together=together)
    got = found.collect()
    assert {(r.read, r.path): (r.seeds, r.diagonal) for r in got} == want and len(got) == len(want) > 100
    assert found.dtypes == [("read", "bigint"), ("path", "string"), ("seeds", "bigint"), ("diagonal", "bigint")]
    with pytest.raises(ValueError, match="31"):
        matching.seed_pairs(found, found, 32)


def _random_parts(rng, number):
    parts = []
    for _ in range(number):
        letters = rng.choice(["ACGT", "AC", "ACGTN", "acgt"])
        dna = lambda n, of=letters: "".join(rng.choices(of, k=n))
        units = [dna(rng.choice([3, 8, 14, 20])) for _ in range(3)]
        n = rng.randint(1, 7)
        nodes = [(3 * k, rng.choice(["", dna(rng.choice([1, 2, 9, 20])), rng.choice(units), rng.choice(units).upper()[::-1].translate(BACK), units[0] + rng.choice(units)])) for k in range(n)]
        edges = [(3 * a, 3 * b) for a in range(n) for b in range(a + 1, n) if b == a + 1 or rng.random() < 0.35]
        reads = []
        for _ in range(rng.randint(1, 9)):
            way = [rng.choice(nodes)[0]]
            while after := [b for a, b in edges if a == way[-1]]:
                way.append(rng.choice(after))
            text = "".join(dict(nodes)[x] for x in way)[rng.randint(0, 9) :][: rng.choice([5, 12, 13, 30, 90])]
            if rng.random() < 0.4 and text:
                text = text[: len(text) // 2] + rng.choice(["", "N", "GA"]) + text[len(text) // 2 + rng.randint(0, 2) :]
            reads.append(text.upper()[::-1].translate(BACK) if rng.random() < 0.5 else text)
        parts.append((reads, nodes, edges))
    return parts


BACK = str.maketrans("ACGT", "TGCA")


def test_exact_reads_and_many_graphs_as_by_alignment_alone(monkeypatch):
    """Reads settled by their exact places, and graphs filled side by side in small portions, come out as each graph by full alignment."""
    rng = random.Random(21)
    for _ in range(40):
        parts = _random_parts(rng, 5)
        found = alignment.aligned_blocks(parts), alignment.aligned_blocks(parts, paths=False)
        with monkeypatch.context() as m:
            m.setattr(alignment, "EXACT_WORD", 10**6)
            assert found[0] == [alignment.aligned_block(*p) for p in parts]
            m.setattr(alignment, "BLOCK_CELLS", rng.choice([1, 2000]))
            assert found == (alignment.aligned_blocks(parts), alignment.aligned_blocks(parts, paths=False))


def test_graphs_are_filled_together(monkeypatch):
    """A step's cost is shared by all graphs of a call; reads that stand on their graph letter by letter cost no step."""
    calls, real = [], alignment._fill
    monkeypatch.setattr(alignment, "_fill", lambda made, keep: calls.append(len(made)) or real(made, keep))
    left, right = "ACGTTGCAGGTACCATGA", "TTAGCCATCAGGACTTGC"
    parts = [([left[3:] + right[:9], (left + right)[::-1].translate(BACK)], [(0, left), (1, "G" * k), (2, right)], [(0, 2), (0, 1), (1, 2)]) for k in range(1, 9)]
    for (seqs, _, _), rows in zip(parts, alignment.aligned_blocks(parts), strict=True):
        assert [r[:4] for r in rows] == [(len(seqs[0]), 2, False, True), (len(seqs[1]), 2, True, True)]
    assert not calls
    alignment.aligned_blocks([([left[:9] + "A" + left[10:] + right], nodes, edges) for _, nodes, edges in parts])
    assert calls == [8, 8]


def test_different_sequences_are_judged_once(spark, monkeypatch):
    """Equal reads of a graph support the same, however many samples and fragments have them."""
    asked, real = [], alignment.graph_alignments
    monkeypatch.setattr(alignment, "graph_alignments", lambda reads, graphs: asked.append(reads.count()) or real(reads, graphs))
    parts = ["ACGTTGCAGGTACCATGATT", "GGCCAATTCG", "TTAGCCATCAGGACTTGCAA"]
    described = spark.createDataFrame([(1, [(k, n, s) for k, (n, s) in enumerate(zip(("LF", "INS", "RF"), parts, strict=True))], [(0, 2, "LF_RF", ["REF"]), (0, 1, "LF_INS", ["INS"]), (1, 2, "INS_RF", ["INS"])])],
                                      "graph_id long, nodes array<struct<id:long,name:string,seq:string>>, edges array<struct<a:long,b:long,name:string,labels:array<string>>>")
    ref, ins = parts[0][4:] + parts[2][:16], parts[0][8:] + parts[1] + parts[2][:12]
    rows = [(1, s, f"f{k}", text) for s in ("x", "y") for k in range(20) for text in (ref, ins[::-1].translate(BACK)) if k % 2 or text == ref] + [(1, "x", "n", None), (1, "x", "e", ""), (9, "x", "f", ref)]
    reads = spark.createDataFrame(rows, "graph_id long, sample_id string, fragment_id string, seq string")
    got = {(r.sample_id, r.element): (r.fragments, r.reads, r.fwd, r.rev) for r in events.count_reads(reads, described, ["sample_id", "graph_id"]).collect() if r.kind == "edge"}
    assert got == {(s, e): n for s in "xy" for e, n in {"LF_RF": (20, 30, 20, 10), "LF_INS": (10, 20, 10, 10), "INS_RF": (10, 20, 10, 10)}.items()}
    assert asked == [5]


def test_alignment_texts_are_read_once(spark):
    """Moved down, the filter of reads that don't map read every text again, more than twenty times."""
    aligned = spark.createDataFrame([(1, "f", "ACGT", False, True, "0[4M]")], "graph_id long, fragment_id string, seq string, reverse boolean, is_unique boolean, graph_cigar string")
    described = spark.createDataFrame([(1, [(0, "LF", "ACGT")], [])], "graph_id long, nodes array<struct<id:long,name:string,seq:string>>, edges array<struct<a:long,b:long,name:string,labels:array<string>>>")
    found = events.support_counts(events.read_supports(aligned, described), ["graph_id"])
    assert plan(found).count("regexp_extract_all(") == 3
    assert [(r.kind, r.element, r.fragments) for r in found.collect()] == [("node", "LF", 1)]


def test_calls_are_dealt(spark, monkeypatch):
    """Few bytes of counts are one task for adaptive execution, however long their likelihoods take."""
    seen, real = {}, records.cut
    monkeypatch.setattr(records, "cut", lambda df, name="step": seen.setdefault(name, plan(df)) and real(df, name))
    counts = spark.createDataFrame([(1, "x", "LF_", 1, [9, 8])], "graph_id long, sample_id string, breakpoint string, n_alts int, counts array<long>")
    samples = spark.createDataFrame([("x", 40.0, 15.0, 60.0)], "sample_id string, depth double, depth_sd double, read_length double")
    none = spark.createDataFrame([], "sample_id string, graph_id long, element string, fwd long, rev long")
    assert [r["gt"] for r in records.calls_of(counts, samples, none).collect()] == [["REF", "ALT1"]]
    assert "RoundRobinPartitioning" in seen["breakpoint-calls"]
