"""Events to graphs to alignments to counts, against known values."""

from pyspark.sql import functions as F

from graphcall.operators import alignment, events
from graphcall.sources import files

NODES = [(0, "A" * 11), (1, "T" * 8), (2, "G" * 8), (3, "A" * 11)]
EDGES = [(0, 1), (1, 3), (0, 2), (2, 3), (0, 3)]


def test_toy_graph():
    want = [
        ("AAAAAAAATTTTCTTTAAAAAAAA", "0[8M]1[4M1X3M]3[8M]", 3, 19, False), ("TTTTTTAAAGAAAATTTTTTT", "0[7M]1[4M1X3M]3[6M]", 4, 16, True), ("AAAAAGCGGGGGGAAAAAA", "0[5M]2[1M1X6M]3[6M]", 6, 14, False),
        ("AAAAGCGGGGGGAAAAAA", "0[4M]2[1M1X6M]3[6M]", 7, 13, False), ("TTTTTTCCCCCCGCTTTTT", "0[5M]2[1M1X6M]3[6M]", 6, 14, True), ("A" * 19, "0[11M]3[8M]", 0, 19, False),
    ]
    got = alignment.aligned_block([w[0] for w in want], NODES, EDGES)
    assert [(g[5], g[4], g[0], g[2]) for g in got] == [w[1:] for w in want] and all(g[3] for g in got)
    # Eleven As end in two nodes forwards and reach eight in one node backwards: the unique strand wins.
    assert alignment.aligned_block(["A" * 11], NODES, EDGES)[0][:4] == (8, 1, True, True)
    assert [x[0] for x in alignment.aligned_block(["", "NNN", "A"], NODES, EDGES)] == [0, 0, 1]


def test_event_counts(spark):
    contig = "A" * 40 + "C" * 40 + "G" * 80 + "C" * 120 + "G" * 120 + "C" * 40
    chunks = files.chunked(spark.createDataFrame([("chr", contig)], "contig string, seq string"), 64)
    rows = [("del", "chr", 41, 80, None, None), ("swap", "chr", 41, 80, "TTTTTTTT", None), ("longdel", "chr", 41, 110, None, 30), ("longswap", "chr", 41, 110, "TTTTTTTT", 30), ("ins", "chr", 41, 40, "TTTTTTTT", None)]
    described = events.event_graphs(spark.createDataFrame(rows, "graph_id string, chrom string, start long, end long, ins string, flank int"), chunks, 64)
    graphs = {r.graph_id: r for r in described.collect()}
    assert all(r.kind == r.graph_id for r in graphs.values())
    assert {n.name: n.seq for n in graphs["del"].nodes} == {"LF": contig[:40], "MID": contig[40:80], "RF": contig[80:231]}
    assert {n.name: len(n.seq) for n in graphs["longdel"].nodes} == {"source": 10, "LF": 31, "MID_L": 30, "MID_R": 30, "RF": 31, "sink": 10}
    assert {(e.name, *e.labels) for e in graphs["swap"].edges} == {("LF_RF", "DEL"), ("LF_MID", "REF"), ("MID_RF", "REF"), ("LF_INS", "INS"), ("INS_RF", "INS")}
    seqs = ["A" * 36 + "G" * 14, "A" * 40 + "G" * 10, "A" * 36 + "C" * 14, "A" * 40 + "C" * 10, "A" * 32 + "T" * 8 + "G" * 10, "A" * 32 + "T" * 8 + "C" * 10]
    reads = spark.createDataFrame([(g[0], f"fragment{k}", s) for g in rows for k, s in enumerate(seqs) if not g[0].startswith("long")], "graph_id string, fragment_id string, seq string")
    got = {}
    for r in events.count_reads(reads, described, ["graph_id"]).collect():
        assert r.fragments == r.reads == r.fwd + r.rev
        got.setdefault(r.graph_id, {}).setdefault(r.kind, {})[r.element] = r.fragments
    assert got["del"] == {"edge": {"LF_MID": 2, "LF_RF": 2}, "node": {"LF": 4, "MID": 2, "RF": 2}, "sequence": {"DEL": 2, "REF": 2}}
    assert got["swap"] == {"edge": {"LF_INS": 1, "INS_RF": 1, "LF_MID": 2, "LF_RF": 2}, "node": {"LF": 6, "INS": 1, "MID": 2, "RF": 3}, "sequence": {"DEL": 2, "INS": 1, "REF": 2}}
    assert got["ins"] == {"edge": {"LF_INS": 1, "INS_RF": 1, "LF_RF": 2}, "node": {"LF": 4, "INS": 1, "RF": 3}, "sequence": {"INS": 1, "REF": 2}}
    plain = described.select("graph_id", F.col("nodes"), F.col("edges"))
    supports = events.read_supports(alignment.graph_alignments(reads, plain), described)
    stats = {(r.graph_id, r.kind, r.element): r for r in events.alignment_statistics(supports, described, ["graph_id"]).collect()}
    mid = stats["del", "node", "MID"]
    assert (mid.fwd, mid.rev, mid.mismatch_rate, mid.length) == (2, 0, 0.0, 40) and mid.match_base_depth == (14 + 10) / 40
    assert stats["swap", "sequence", "INS"].avg_score == 50 and stats["swap", "sequence", "INS"].length == 8
    assert {r.kind for r in events.select_outputs(events.count_reads(reads, described, ["graph_id"]), {"edge_read_counts"}).collect()} == {"edge"}
