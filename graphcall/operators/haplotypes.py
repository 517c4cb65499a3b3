"""Paths of fragments, and haplotypes from the edges that fragments have together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlap(a: Column, b: Column) -> Column:
    """The most nodes that end path ``a`` and begin path ``b``; 0 if there are none."""
    sizes = F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)))
    return F.coalesce(F.array_max(F.filter(sizes, lambda n: F.slice(a, F.size(a) - n + 1, n) == F.slice(b, 1, n))), F.lit(0))


def _holds(a: Column, b: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(a) - F.size(b) + 1, F.lit(1)))
    return F.exists(starts, lambda k: F.slice(a, k, F.size(b)) == b)


def merged_paths(paths: Column) -> Column:
    """Paths (arrays of nodes) in their order, each merged into the one before it where they overlap."""

    def add(done: Column, path: Column) -> Column:
        last = F.element_at(done, -1)
        shared = overlap(last, path)
        longer = F.concat(last, F.slice(path, shared + 1, F.size(path)))
        before = F.slice(done, 1, F.size(done) - 1)
        return F.when(_holds(last, path), done).when(shared > 0, F.concat(before, F.array(longer))).otherwise(F.concat(done, F.array(path)))

    ordered = F.array_sort(F.array_distinct(paths))
    return F.aggregate(F.slice(ordered, 2, F.size(ordered)), F.slice(ordered, 1, 1), add)


def fragment_paths(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Reads (keys, path: array of nodes) to the merged paths of each fragment; reads without nodes count for nothing."""
    found = reads.where(F.size("path") > 0).groupBy(*keys).agg(F.collect_set("path").alias("paths"))
    return found.select(*keys, F.explode(merged_paths(F.col("paths"))).alias("path"))


def families(paths: DataFrame, groups: list[str], fragment: str) -> DataFrame:
    """Paths of fragments to the sets of edges that fragments have, with the number of these fragments."""
    size = F.size("path")
    edges = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda k: F.struct(F.get("path", k - 1).alias("a"), F.get("path", k).alias("b")))
    own = paths.where(size > 1).groupBy(*groups, fragment).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(edges)))).alias("edges"))
    return own.groupBy(*groups, "edges").agg(F.count("*").alias("n"))


def linear(found: DataFrame, reach: DataFrame, keys: list[str]) -> DataFrame:
    """Families (keys, edges, ...) that can lie on one path: each edge begins where the one before it ends, or at a node reached from there.

    ``reach`` (keys, a, b) has the pairs of nodes with a path between them.
    """
    steps = F.transform(F.slice("edges", 2, F.size("edges")), lambda e, k: F.struct(F.get("edges", k)["b"].alias("a"), e["a"].alias("b")))
    gaps = found.select(*keys, "edges", F.explode(F.filter(steps, lambda s: s["a"] != s["b"])).alias("s")).select(*keys, "edges", "s.a", "s.b")
    return found.join(gaps.join(reach, [*keys, "a", "b"], "left_anti").select(*keys, "edges").distinct(), [*keys, "edges"], "left_anti")


def _segments(edges: set[tuple[int, int]]) -> list[tuple[int, ...]]:
    """Stretches without a branch, between nodes where edges fork, meet, begin or end."""
    after: dict[int, list[int]] = {}
    n_in: dict[int, int] = {}
    for a, b in sorted(edges):
        after.setdefault(a, []).append(b)
        n_in[b] = n_in.get(b, 0) + 1
    plain = {x for x in after if len(after[x]) == 1 and n_in.get(x) == 1}
    found = []
    for a in sorted(set(after) - plain):
        for b in after[a]:
            path = [a, b]
            while path[-1] in plain:
                path += after[path[-1]]
            found.append(tuple(path))
    return found


def phased(sets: list[set[tuple[int, int]]]) -> list[list[tuple[int, ...]]]:
    """Groups of alternative paths through a graph whose nodes are numbered in topological order.

    Neighbouring groups are joined where all their paths meet in one node, every path on the left
    goes on in a way that some family holds whole, and that way is the only one unless a side is single.
    """
    groups: list[list[tuple[int, ...]]] = []
    end = None
    for path in _segments(set().union(*sets)):
        if end is None or path[0] >= end:
            groups.append([])
            end = path[-1]
        groups[-1].append(path)
        end = max(end, path[-1])
    held = lambda path: any(s.issuperset(zip(path, path[1:])) for s in sets)  # noqa: E731, B905
    k = 0
    while k + 1 < len(groups):
        left, right = groups[k : k + 2]
        meet = len({a[-1] for a in left} | {b[0] for b in right}) == 1
        ways = [[a + b[1:] for b in right if held(a + b[1:])] for a in left] if meet else [[]]
        if all(ways) and (len(left) == 1 or len(right) == 1 or max(map(len, ways)) == 1):
            groups[k : k + 2] = [sum(ways, [])]
            k = 0
        else:
            k += 1
    return groups


def haplotypes(found: DataFrame, keys: list[str]) -> DataFrame:
    """Families (keys, edges) to paths (keys, group, path) of each graph and sample.

    A group's rows are its distinct edge sets, which reads long since merged; their number depends on
    the graph, not on the depth. Graphs and samples are dealt out by their keys.
    """
    out = T.StructType([*found.select(*keys).schema, *T.StructType.fromDDL("`group` int, path array<long>")])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        groups = phased([{(e["a"], e["b"]) for e in edges} for edges in rows["edges"]])
        made = [(*key, k, list(p)) for k, paths in enumerate(groups) for p in paths]
        return pd.DataFrame(made, columns=out.names)

    return found.groupBy(*keys).applyInPandas(run, out)
