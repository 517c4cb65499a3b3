"""Alignment to graphs and paths against brute force over all paths, and the cascade of stages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphcall.operators import alignment
from graphcall.plans.registry import Views

OPEN, EXTEND = alignment.GAP_OPEN, alignment.GAP_EXTEND


def ways(nodes, edges):
    after = {n: [b for a, b in edges if a == n] for n, _ in nodes}
    heads = [n for n, _ in nodes if all(b != n for _, b in edges)]
    done, open_ = [], [[h] for h in heads]
    while open_:
        w = open_.pop()
        open_ += [[*w, b] for b in after[w[-1]]]
        if not after[w[-1]]:
            done.append(w)
    return done


def best_local(read, seq):
    """Best local score with affine gaps, cell by cell."""
    low, best = -(10**9), 0
    h, e = [0] * (len(read) + 1), [low] * (len(read) + 1)
    for base in seq:
        new, f = [0] * (len(read) + 1), low
        for j in range(len(read) + 1):
            e[j] = max(e[j] + EXTEND, h[j] + OPEN)
            f = max(f + EXTEND, new[j - 1] + OPEN) if j else low
            pair = h[j - 1] + (0 if "N" in (read[j - 1], base) else 1 if read[j - 1] == base else -4) if j else low
            new[j] = max(0, e[j], f, pair)
        h = new
        best = max(best, max(h))
    return best


def score_of(cigar, begin, read, nodes, edges):
    """The score of an alignment's text, checked letter by letter against its nodes and edges."""
    seq, at, total, path = dict(nodes), 0, 0, []
    parts = re.findall(r"(\d+)\[([^\]]*)\]", cigar)
    last = None
    for k, (node, text) in enumerate(parts):
        node, place = int(node), begin if k == 0 else 0
        path.append(node)
        for n, op in re.findall(r"(\d+)(\w)", text):
            n = int(n)
            if op in "ID":
                total += n * EXTEND if last == op else OPEN + (n - 1) * EXTEND
            for _ in range(n):
                if op in "MXN":
                    x, y = read[at], seq[node][place]
                    assert op == ("N" if "N" in (x, y) else "M" if x == y else "X")
                    total += {"N": 0, "M": 1, "X": -4}[op]
                at, place = at + (op != "D"), place + (op in "MXND")
            last = op
        assert place <= len(seq[node]) and (k == len(parts) - 1 or place == len(seq[node]))
    assert at == len(read)

    def linked(a, b):
        return any(y == b or (not seq[y] and linked(y, b)) for x, y in edges if x == a)

    assert all(linked(a, b) for a, b in zip(path, path[1:], strict=False))
    return total


def random_graph(rng):
    n = rng.randint(1, 6)
    nodes = [(k, "".join(rng.choices("ACGTN", [5, 5, 5, 5, 1], k=rng.choice([0, 0, 1, 2, 5, 9])))) for k in range(n)]
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if b == a + 1 or rng.random() < 0.4]
    return nodes, edges


def test_graphs_by_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        nodes, edges = random_graph(rng)
        seqs = ["".join(dict(nodes)[n] for n in w) for w in ways(nodes, edges)]
        reads = []
        for _ in range(6):
            s = list(rng.choice(seqs))
            for _ in range(rng.randint(0, 3)):
                if s:
                    at = rng.randrange(len(s))
                    s[at : at + rng.randint(0, 2)] = rng.choices("ACGT", k=rng.randint(0, 2))
            reads.append("".join(s) or "A")
        back = [r[::-1].translate(str.maketrans("ACGT", "TGCA")) for r in reads]
        for k, found in enumerate(alignment.aligned_block(reads, nodes, edges)):
            score, _, reverse, _, begin, cigar = found
            want = [max(best_local(r, s) for s in seqs) for r in (reads[k], back[k])]
            assert score == want[reverse] and (not score or score_of(cigar, begin, (back if reverse else reads)[k], nodes, edges) == score)


def test_empty_node_on_the_way():
    nodes, edges = [(0, "ACGTACGT"), (1, ""), (2, "TTGCATGC")], [(0, 1), (1, 2)]
    assert alignment.aligned_block(["ACGTACGTTTGCATGC"], nodes, edges)[0] == (16, 2, False, True, 0, "0[8M]2[8M]")


def test_paths_by_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        nodes, edges = random_graph(rng)
        named = [(f"p{k}", [(n, dict(nodes)[n]) for n in w]) for k, w in enumerate(ways(nodes, edges))]
        reads = ["".join(rng.choices("ACGT", k=rng.randint(1, 14))) for _ in range(5)] + ["".join(s for _, s in named[0][1]) or "A"]
        turned = [r[::-1].translate(str.maketrans("ACGT", "TGCA")) for r in reads]
        for k, (score, reverse, status, path, ends, begin, cigar) in enumerate(alignment.paired_block(reads, named)):
            each = {(p, t): best_local(r, "".join(s for _, s in w)) for p, w in named for t, r in ((False, reads[k]), (True, turned[k]))}
            assert score == max(each.values())
            if not score:
                assert status == "UNMAPPED"
                continue
            assert each[path, reverse] == score and ends >= 1 and score_of(cigar, begin, (turned if reverse else reads)[k], nodes, edges) == score
            if sum(v == score for v in each.values()) == 1:
                assert status == "MAPPED"


def test_pairwise_ties_and_shared_nodes():
    left, right = (0, "ACGTTGCAGG"), (3, "TTAGCCATCA")
    paths = [("a", [left, (1, "GGGG"), right]), ("b", [left, (2, "CCTC"), right])]
    # Inside a node that both share the places are one; words that both middles hold are two.
    assert alignment.paired_block(["ACGTTGCA"], paths)[0][:5] == (8, False, "MAPPED", "a", 1)
    tie = [("a", [(1, "ACCTGAC")]), ("b", [(2, "TTACCTGACTT")])]
    assert alignment.paired_block(["ACCTGAC"], tie)[0][1:5] == (False, "BAD_ALIGN", "a", 2)
    assert alignment.paired_block(["ACCTGACT"], tie)[0][2:4] == ("MAPPED", "b")


def test_cascade_takes_the_first_stage_that_maps(spark):
    rng = random.Random(1)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    parts = [dna(30), dna(12), dna(12), dna(30)]
    graph = spark.createDataFrame([("g", [(k, s) for k, s in enumerate(parts)], [(0, 1), (1, 3), (0, 2), (2, 3), (0, 3)])], "graph_id string, nodes array<struct<id:long,seq:string>>, edges array<struct<a:long,b:long>>")
    paths = spark.createDataFrame([("g", "REF", [0, 1, 3]), ("g", "ALT", [0, 2, 3]), ("g", "DEL", [0, 3])], "graph_id string, path string, nodes array<long>")
    ref, gone = parts[0] + parts[1] + parts[3], parts[0] + parts[3]
    other = lambda c: "ACGT"["ACGT".index(c) - 1]
    reads = {1: ref[10:60], 2: ref[10:35] + other(ref[35]) + ref[36:60], 3: gone[5:50], 4: ref[10:40] + ref[44:66], 5: "".join(map(other, ref[:9])), 6: parts[0][3:27]}
    reads[7] = reads[2][::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = spark.createDataFrame([("g", k, s) for k, s in reads.items()] + [("none", 1, ref)], "graph_id string, id long, seq string")
    got = {(r.graph_id, r.id): (r.stage, r.score, r.reverse, r.status) for r in alignment.cascade(rows, graph, paths, seed=10).collect()}
    assert got["g", 1] == ("path", 50, False, "MAPPED") and got["g", 2] == ("kmer", 45, False, "MAPPED") and got["g", 7] == ("kmer", 45, True, "MAPPED")
    assert got["g", 3] == ("path", 45, False, "MAPPED") and got["g", 4][0] == "pairwise" and got["g", 4][1] == 52 + OPEN + 3 * EXTEND and got["g", 4][3] == "MAPPED"
    # In a node that all paths share no word stands once, but the next stage finds one place on the graph.
    assert got["g", 6] == ("pairwise", 24, False, "MAPPED") and ("none", 1) not in got and set(got) == {("g", k) for k in reads}
    only = {r.id: r.stage for r in alignment.cascade(rows, graph, paths, seed=10, stages=("path", "graph")).collect()}
    assert only[1] == "path" and only[2] == only[4] == "graph"
    with pytest.raises(ValueError, match="stages"):
        alignment.cascade(rows, graph, paths, stages=("other",))


def test_no_sequence_goes_through_the_seed_join(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    reads = v.bases.select("id", "seq")
    text = alignment.gapless(reads, v.bases.select(F.col("id").alias("path"), "seq"), seed=10)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in text.splitlines() if "Join" in x and "kmer" in x]
    assert joins and all("seq" not in x for x in joins)


def test_graphs_meet_their_reads_in_groups(spark, monkeypatch):
    monkeypatch.setattr(alignment, "READS_TOGETHER", 7)
    graph = spark.createDataFrame([(1, [(0, "ACGTTGCA")], [])], "graph_id long, nodes array<struct<id:long,seq:string>>, edges array<struct<a:long,b:long>>")
    rows = spark.range(100).select(F.lit(1).cast("long").alias("graph_id"), F.col("id").alias("read"), F.lit("CGTTG").alias("seq"))
    got = alignment.graph_alignments(rows, graph).collect()
    assert sorted(r.read for r in got) == list(range(100)) and {(r.score, r.graph_pos, r.graph_cigar) for r in got} == {(5, 1, "0[5M]")}


BACK = str.maketrans("ACGT", "TGCA")


def test_cascade_of_a_whole_table(spark):
    from graphcall.plans.graph_queries import _contig_graphs

    reads, described, paths = _contig_graphs(Views(spark, "/root/testdata/sf0.001"))
    graphs = {r.graph_id: {n.id: n.seq for n in r.nodes} for r in described.collect()}
    lines = {}
    for r in paths.collect():
        lines.setdefault(r.graph_id, {})[r.path] = r.nodes
    got = {(r.graph_id, r.id): r for r in alignment.cascade(reads, described, paths, seed=12).collect()}
    rows = [r for r in reads.collect() if r.graph_id in graphs]
    assert len(got) == len(rows) > 300
    stages = set()
    for r in rows:
        seqs = {p: [(n, graphs[r.graph_id][n]) for n in w] for p, w in lines[r.graph_id].items()}
        whole = {p: "".join(s for _, s in w) for p, w in seqs.items()}
        words = {}
        for s in whole.values():
            for k in range(len(s) - 11):
                words[s[k : k + 12]] = words.get(s[k : k + 12], 0) + 1
        found = []
        for turn, read in ((False, r.seq), (True, r.seq[::-1].translate(BACK))):
            for p, s in whole.items():
                for at in range(len(s) - len(read) + 1):
                    off = [x != y for x, y in zip(read, s[at:], strict=False)]
                    if sum(off) <= 2 and any(not any(off[k : k + 12]) and words[read[k : k + 12]] == 1 for k in range(len(read) - 11)):
                        place, spot = 0, []
                        for n, bases in seqs[p]:
                            if place + len(bases) > at and place < at + len(read):
                                spot.append((n, max(0, at - place)) if not spot else n)
                            place += len(bases)
                        found.append((sum(off), tuple(spot), turn))
        own = got[r.graph_id, r.id]
        best = [f for f in found if f[0] == min(x[0] for x in found)]
        if len({f[1] for f in best}) == 1:
            assert (own.stage, own.score, own.status) == ("kmer" if best[0][0] else "path", len(r.seq) - 5 * best[0][0], "MAPPED")
        else:
            ways_ = [max(best_local(read, s) for s in whole.values()) for read in (r.seq, r.seq[::-1].translate(BACK))]
            # On the graph a strand with one place goes before a better one with several.
            assert own.score == (max(ways_) if own.stage == "pairwise" else ways_[own.reverse]) and own.stage in ("pairwise", "graph"), r
        stages.add(own.stage)
    assert stages == set(alignment.STAGES)


def test_event_counts_of_a_whole_table(spark):
    """Alignments of the query's reads, judged read by read."""
    import collections

    from graphcall.plans import catalog
    from graphcall.plans.graph_queries import _contig_events

    where = "/root/testdata/sf0.001"
    described, reads = _contig_events(Views(spark, where))
    graphs = {r.graph_id: r for r in described.collect()}
    by = {}
    for r in reads.collect():
        by.setdefault(r.graph_id, []).append(r)
    frags = collections.defaultdict(lambda: [0, 0, set(), set(), set()])
    for g, rows in by.items():
        if g not in graphs:
            continue
        nodes, edges = graphs[g].nodes, graphs[g].edges
        aligned = alignment.aligned_block([r.seq for r in rows], [(n.id, n.seq) for n in nodes], [(e.a, e.b) for e in edges])
        for r, (_, _, reverse, unique, _, text) in zip(rows, aligned, strict=True):
            parts = [(int(n), [(int(c), op) for c, op in re.findall(r"(\d+)(\w)", x)]) for n, x in re.findall(r"(\d+)\[([^\]]*)\]", text)]
            of = lambda ops, letters: sum(c for c, op in ops if op in letters)
            every = [o for _, ops in parts for o in ops]
            query = of(every, "MXIS")
            # Halves go away from zero.
            if not unique or not parts or query - of(every, "S") < int(0.8 * query + 0.5):
                continue
            size, name = len(r.seq), {n.id: n.name for n in nodes}
            length = {n.id: len(n.seq) for n in nodes}
            frag = frags[g, r.fragment_id]
            frag[1 if reverse else 0] += 1
            for n, ops in parts:
                differ = of(ops, "XIDS")
                if differ == 0 if 2 * length[n] < size else 2 * differ <= length[n]:
                    frag[2].add(name[n])
            need, labels, all_labels = size // 10 + 1, set(), []
            for (a, x), (b, y) in zip(parts, parts[1:], strict=False):
                own = {s for e in edges if (e.a, e.b) == (a, b) for s in e.labels}
                all_labels.append(own)
                good = [of(o, "M") >= min(of(o, "MXDN"), need) and of(o, "MXIS") < 2 * of(o, "MXDN") and of(o, "M") >= min(length[n], need) for n, o in ((a, x), (b, y))]
                if all(good):
                    frag[3].add(f"{name[a]}_{name[b]}")
                    labels |= own
            frag[4] |= {s for s in labels if all(s in own for own in all_labels)}
    want = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (g, _), (fwd, rev, n, e, s) in frags.items():
        for kind, names in (("node", n), ("edge", e), ("sequence", {",".join(sorted(s))} if s else ())):
            for x in names:
                row = want[graphs[g].kind, kind, x]
                for k, v in enumerate((1, fwd + rev, fwd, rev)):
                    row[k] += v
    got = {(r.event, r.kind, r.element): [r.fragments, r.reads, r.fwd, r.rev] for r in catalog.queries()["event_support_counts"](spark, where).collect()}
    assert got == dict(want) and len(got) > 10
