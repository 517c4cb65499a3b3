"""Graphs made from graphs, against plain walks through one graph at a time."""

import random

import pytest
from pyspark.sql import functions as F

from graphcall.operators import rewriting

NODES = "g long, node string, chrom string, start long, stop long, is_ref boolean, seq string, labels array<string>"
EDGES = "g long, a string, b string, labels array<string>"


def test_chains_are_merged_whole(spark):
    rng = random.Random(3)
    nodes, edges, want, want_edges = [], [], {}, set()
    for g in range(12):
        kinds = [rng.random() < 0.6 for _ in range(30)]
        labels = [rng.choice("xy") for _ in range(30)]
        gaps = {k for k in range(30) if rng.random() < 0.1}
        pairs = {(k, k + 1) for k in range(29)} | {(k, k + 2) for k in range(28) if rng.random() < 0.15}
        at = 0
        for k in range(30):
            at += 5 * (k in gaps)
            nodes.append((g, f"n{k:02}", "c", at, at + 2, kinds[k], None if kinds[k] else "ACGT"[k % 4] * 3, [labels[k]]))
            at += 3
        edges += [(g, f"n{a:02}", f"n{b:02}", ["e"]) for a, b in pairs]
        on = {a: b for a, b in pairs if sum(x == a for x, _ in pairs) == 1 and sum(y == b for _, y in pairs) == 1 and b == a + 1 and b not in gaps and kinds[a] == kinds[b] and labels[a] == labels[b]}
        own = [r for r in nodes if r[0] == g]
        head = {}
        for k in range(30):
            if k not in on.values():
                chain = [k]
                while chain[-1] in on:
                    chain.append(on[chain[-1]])
                head |= dict.fromkeys(chain, k)
                want[g, f"n{k:02}"] = own[k][3], own[chain[-1]][4], None if kinds[k] else "".join(own[c][6] for c in chain), len(chain)
        want_edges |= {(g, f"n{head[a]:02}", f"n{head[b]:02}") for a, b in pairs if head[a] != head[b]}
    out_nodes, out_edges = rewriting.merged(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), ["g"])
    assert {(r.g, r.node): (r.start, r.stop, r.seq, r.n_merged) for r in out_nodes.collect()} == want and max(w[3] for w in want.values()) >= 4
    assert {(r.g, r.a, r.b) for r in out_edges.collect()} == want_edges


def test_a_cycle_of_nodes_raises(spark):
    nodes = spark.createDataFrame([(1, x, "c", 0, 0, True, None, []) for x in "abc"], NODES)
    ring = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a")], "g long, a string, b string")
    with pytest.raises(ValueError, match="cycle"):
        rewriting.chain_places(nodes, ring, ["g"], guard=8)
    with pytest.raises(Exception, match="cycle"):
        rewriting.depth_first_order(nodes.select("g", "node"), ring, ["g"]).collect()


def test_depth_first_order(spark):
    rng = random.Random(8)
    nodes, edges, want = [], [], set()
    for g in range(8):
        n = rng.randint(1, 9)
        names = [f"{rng.randint(0, 99):02}-{k}" for k in range(n)]
        pairs = [(names[a], names[b]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        nodes += [(g, x) for x in names]
        edges += [(g, *p) for p in pairs]
        left, seen = [], set()

        def visit(x, pairs=pairs, left=left, seen=seen):
            seen.add(x)
            for y in sorted(b for a, b in pairs if a == x):
                if y not in seen:
                    visit(y)
            left.insert(0, x)

        for x in sorted(names):
            if x not in seen:
                visit(x)
        want |= {(g, x, k) for k, x in enumerate(left)}
    got = rewriting.depth_first_order(spark.createDataFrame(nodes, "g long, node string"), spark.createDataFrame(edges, "g long, a string, b string"), ["g"])
    assert {tuple(r) for r in got.collect()} == want


def test_variants_become_nodes(spark):
    nodes = spark.createDataFrame([(1, "L", "c", 10, 19, True, None, ["R"]), (1, "X", "c", 20, 25, False, "ACGTAC", ["A"]), (1, "Z", "c", 26, 30, True, None, ["R"])], NODES)
    edges = spark.createDataFrame([(1, "L", "X", ["A"]), (1, "X", "Z", ["A"]), (1, "L", "Z", [])], EDGES)
    variants = spark.createDataFrame([(1, "X", 2, 3, ""), (1, "X", 0, -1, "GG"), (1, "X", 5, 5, "T"), (1, "X", 2, 3, ""), (1, "L", 4, 3, "C")], "g long, node string, start long, stop long, alt string")
    out_nodes, out_edges = rewriting.with_variants(nodes, edges, variants, ["g"])
    got = {r.node: (r.start, r.stop, r.seq, r.labels) for r in out_nodes.collect()}
    assert got == {
        "Z": (26, 30, None, ["R"]), "L.0": (10, 13, None, ["R"]), "L.1": (14, 19, None, ["R"]), "L:4-3:C": (14, 13, "C", []),
        "X.0": (20, 19, "", ["A"]), "X.1": (20, 21, "AC", ["A"]), "X.2": (22, 23, "GT", ["A"]), "X.3": (24, 24, "A", ["A"]), "X.4": (25, 25, "C", ["A"]), "X.5": (26, 25, "", ["A"]),
        "X:2-3:": (22, 23, "", []), "X:0--1:GG": (20, 19, "GG", []), "X:5-5:T": (25, 25, "T", []),
    }
    pairs = {(r.a, r.b): r.labels for r in out_edges.collect()}
    lines = {(f"X.{k}", f"X.{k + 1}") for k in range(5)} | {("L.0", "L.1"), ("L.1", "X.0"), ("X.5", "Z"), ("L.1", "Z")}
    assert set(pairs) == lines | {("X.1", "X:2-3:"), ("X:2-3:", "X.3"), ("X.0", "X:0--1:GG"), ("X:0--1:GG", "X.1"), ("X.3", "X:5-5:T"), ("X:5-5:T", "X.5"), ("L.0", "L:4-3:C"), ("L:4-3:C", "L.1")}
    assert pairs["L.1", "X.0"] == ["A"] and pairs["X.5", "Z"] == ["A"] and pairs["X.0", "X.1"] == []
    for bad in ((1, "X", 3, 1, "A"), (1, "X", 3, 2, ""), (1, "X", 3, 6, "")):
        with pytest.raises(Exception, match="fit its node"):
            rewriting.with_variants(nodes, edges, spark.createDataFrame([bad], variants.schema), ["g"])[0].collect()


def one_graph(nodes, alleles):
    """Edges with labels of one graph, node by node and haplotype by haplotype. nodes: name to (start, stop, is_ref, labels)."""
    edges = {}

    def add(a, b, label=None):
        edges.setdefault((a, b), set()).update([label] if label else [])

    order = lambda names: sorted(names, key=lambda n: (nodes[n][0], nodes[n][1], n))
    touch = lambda a, b: a != b and nodes[a][1] + 1 == nodes[b][0]
    ref, alt = [n for n in nodes if nodes[n][2]], order(n for n in nodes if not nodes[n][2])
    for a in ref:
        for b in ref:
            if touch(a, b):
                add(a, b)
    labels = sorted({x for n in nodes.values() for x in n[3]})
    walks = {x: order(n for n in nodes if x in nodes[n][3]) for x in labels}
    for x, walk in walks.items():
        for a, b in zip(walk, walk[1:], strict=False):
            if nodes[a][1] + 1 == nodes[b][0]:
                add(a, b, x)
    lone_in = [n for n in alt if not any(b == n for _, b in edges)]
    lone_out = [n for n in alt if not any(a == n for a, _ in edges)]
    empty = lambda n: nodes[n][1] < nodes[n][0]
    for n in alt:
        for r in ref:
            if touch(r, n) and (alleles or n in lone_in):
                add(r, n)
            if touch(n, r) and (alleles or n in lone_out):
                add(n, r)
        if alleles:
            for m in alt:
                if touch(n, m) and not (empty(n) and empty(m)):
                    add(n, m)
    for x, walk in walks.items():
        for n in walk:
            into, out = [e for e in edges if e[1] == n], [e for e in edges if e[0] == n]
            if not any(x in edges[e] for e in into):
                for e in into:
                    edges[e].add(x)
            if not any(x in edges[e] for e in out):
                for e in out:
                    edges[e].add(x)
    return {e: sorted(s) for e, s in edges.items()}


@pytest.mark.parametrize("alleles", [False, True])
def test_haplotype_graphs(spark, alleles):
    rng = random.Random(11)
    rows, want = [], {}
    for g in range(25):
        variants = []
        for _ in range(rng.randint(1, 4)):
            start = 200 + 6 * rng.randint(0, 4)
            n = rng.choice([0, 1, 6])
            variants.append((g, start, start + n - 1, rng.choice(["", "ACG", "T"]) if n else "GGA", [f"h{k}" for k in range(3) if rng.random() < 0.4], [f"h{k}" for k in range(3, 5) if rng.random() < 0.6]))
        rows += variants
        low, high = min(v[1] for v in variants) - 150, max(v[2] for v in variants) + 151
        cuts = sorted({low, high} | {v[1] for v in variants} | {v[2] + 1 for v in variants})
        nodes = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            nodes[f"ref-{a}-{b - 1}"] = a, b - 1, True, {x for v in variants if v[1] <= a and b - 1 <= v[2] for x in v[5]}
        for v in variants:
            nodes.setdefault(f"alt-{v[1]}-{v[2]}:{v[3]}", (v[1], v[2], False, set()))[3].update(v[4])
        want |= {(g, *e): s for e, s in one_graph(nodes, alleles).items()}
    frame = spark.createDataFrame(rows, "g long, start long, stop long, alt string, haplotypes array<string>, ref_haplotypes array<string>")
    got = rewriting.haplotype_edges(rewriting.haplotype_nodes(frame, ["g"], F.lit("c")), ["g"], alleles=alleles).collect()
    assert {(r.g, r.a, r.b): r.labels for r in got} == want and len(got) == len(want)
