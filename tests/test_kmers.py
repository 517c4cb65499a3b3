"""K-mers of graphs against all paths, the length that tells nodes and edges apart, and the filter of reads."""

import collections
import random

from pyspark.sql import functions as F

from graphcall.operators import alignment, events, kmers


def every_kmer(nodes, edges, k):
    out = []

    def grow(start, off, text, path):
        if len(text) == k:
            if set(text) <= set("ACGT"):
                out.append((text, start, off, tuple(path)))
            return
        for a, b in sorted(set(edges)):
            if a == path[-1]:
                grow(start, off, text + nodes[b][: k - len(text)], [*path, b])

    for n, s in nodes.items():
        for off in range(len(s)):
            grow(n, off, s[off : off + k], [n])
    return out


def counts_of(nodes, edges, k):
    found = every_kmer(nodes, edges, k)
    times = collections.Counter(x[0] for x in found)
    n = {("node", a, None): 0 for a in nodes} | {("edge", a, b): 0 for a, b in edges}
    for text, _, _, path in found:
        if times[text] == 1:
            for a in set(path):
                n["node", a, None] += 1
            for e in set(zip(path, path[1:], strict=False)):
                n[("edge", *e)] += 1
    return n


def graphs_of(rng, count, sizes=(0, 2, 6, 15)):
    out = {}
    for g in range(count):
        n = rng.randint(2, 5)
        nodes = {k: "".join(rng.choices("ACGT", k=rng.choice(sizes))) for k in range(n)}
        nodes[0] += "ACN" if 0 in sizes else ""
        out[g] = nodes, sorted({(a, b) for a in range(n) for b in range(a + 1, n) if b == a + 1 or rng.random() < 0.4})
    return out


def test_kmers_and_lengths(spark):
    graphs = graphs_of(random.Random(5), 12)
    nodes = spark.createDataFrame([(g, k, s) for g, (n, _) in graphs.items() for k, s in n.items()], "graph_id long, node long, seq string")
    edges = spark.createDataFrame([(g, a, b) for g, (_, e) in graphs.items() for a, b in e], "graph_id long, a long, b long")
    sizes = spark.createDataFrame([(g, k) for g in graphs for k in (2, 5)], "graph_id long, k int")
    found = kmers.graph_kmers(nodes, edges, sizes)
    assert collections.Counter((r.graph_id, r.k, r.kmer, r.start, r.offset, tuple(r.path)) for r in found.collect()) == collections.Counter((g, k, *x) for g, (n, e) in graphs.items() for k in (2, 5) for x in every_kmer(n, e, k))
    got = {(r.graph_id, r.k, r.kind, r.a, r.b): r.n for r in kmers.coverage(kmers.unique_kmers(found), nodes, edges, sizes).collect()}
    assert got == {(g, k, *e): n for g, (x, y) in graphs.items() for k in (2, 5) for e, n in counts_of(x, y, k).items()}
    graphs = graphs_of(random.Random(6), 14, (5, 9, 14))
    nodes = spark.createDataFrame([(g, k, s) for g, (n, _) in graphs.items() for k, s in n.items()], "graph_id long, node long, seq string")
    edges = spark.createDataFrame([(g, a, b) for g, (_, e) in graphs.items() for a, b in e], "graph_id long, a long, b long")
    want = {g: next((k for k in range(2, 9) if min(counts_of(n, e, k).values()) >= 2), None) for g, (n, e) in graphs.items()}
    got = {r.graph_id: r.k for r in kmers.covering_length(nodes, edges, 2, shortest=2, longest=8).collect()}
    assert got == want
    assert len(set(want.values())) > 2


def test_reads_that_miss_a_node(spark):
    parts = {0: "ACGTTGCAAGGC", 1: "TTACCGATAGCA", 2: "GGATTCCAGTAC", 3: "CATGACCTTGAA"}
    nodes = spark.createDataFrame([("g", k, s) for k, s in parts.items()], "graph_id string, node long, seq string")
    edges = spark.createDataFrame([("g", *e) for e in ((0, 1), (1, 3), (0, 2), (2, 3))], "graph_id string, a long, b long")
    unique = kmers.unique_kmers(kmers.graph_kmers(nodes, edges, spark.createDataFrame([("g", 8)], "graph_id string, k int")))
    ref = parts[0] + parts[1] + parts[3]
    wrong = parts[0] + "".join("ACGT"["ACGT".index(c) - 1] if k % 3 == 0 or k == 11 else c for k, c in enumerate(parts[1])) + parts[3]
    rows = [
        (1, ref, "0[12M]1[12M]3[12M]"), (2, wrong, "0[12M]1[12M]3[12M]"), (3, "TTTT" + ref[:14], "0[4S12M]1[2M]"), (4, ref, ""), (5, "ACGTT", "0[1S4M]"), (6, "ACGTTGCAAG", "0[2S6M2S]"),
        (7, "AAAAAAAAAAAA", "2[12M]"), (8, parts[2] + "CCCCCCCCCCCC", "2[12M]3[12S]"),
    ]
    got = {r.read: r.reason for r in kmers.filter_reasons(spark.createDataFrame([("g", *r) for r in rows] + [("other", 9, ref, "0[36M]")], "graph_id string, read long, seq string, graph_cigar string"), unique).collect()}
    assert got == {1: None, 2: "kmer_uncov_1", 3: None, 4: "kmer_nomapping", 5: "kmer_tooshort", 6: "kmer_tooshort", 7: "kmer_uncov_2", 8: "kmer_uncov_3", 9: None}


def test_third_rule_of_supports(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choices("ACGT", k=n)) for n in (40, 12, 40)]
    described = spark.createDataFrame([("g", [(k, n, s) for k, (n, s) in enumerate(zip(("LF", "MID", "RF"), parts, strict=True))], [(0, 1, "LF_MID", ["REF"]), (1, 2, "MID_RF", ["REF"]), (0, 2, "LF_RF", ["DEL"])])],
                                      "graph_id string, nodes array<struct<id:long,name:string,seq:string>>, edges array<struct<a:long,b:long,name:string,labels:array<string>>>")
    whole = "".join(parts)
    other = "".join("ACGT"["ACGT".index(c) - 1] if k in (40, 46, 51) else c for k, c in enumerate(whole))
    back = whole[20:75][::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([("g", "a", whole[20:75]), ("g", "b", other[5:90]), ("g", "c", back)], "graph_id string, fragment_id string, seq string")
    aligned = alignment.graph_alignments(reads, described.select("graph_id", "nodes", "edges"))
    plain = {r.fragment_id: r for r in events.read_supports(aligned, described).collect()}
    assert {k: r.status for k, r in plain.items()} == {k: "MAPPED" for k in "abc"}
    for k in (9, -3):
        got = {r.fragment_id: (r.status, r.reason, r.sequences_supported) for r in events.read_supports(aligned, described, kmer=k).collect()}
        assert got["a"] == got["c"] == ("MAPPED", None, ["REF"]) and (got["b"] == ("BAD_ALIGN", "kmer_uncov_1", []) if k == 9 else True)
    nodes, edges = events.described_tables(described)
    assert kmers.covering_length(nodes, edges, 3).first().k == 10 and F is not None
