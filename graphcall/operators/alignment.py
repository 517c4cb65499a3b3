"""Reads to graphs: exact and gapless matches as joins, local alignment to paths and to small graphs in numpy batches."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphcall.functions import sequence
from graphcall.operators.storage import cut, shuffled

MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 1, -4, -6, -1
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def both_strands(reads: DataFrame) -> DataFrame:
    """``reads`` (seq and others) and their reverse complements (reverse = true)."""
    rest = [c for c in reads.columns if c != "seq"]
    return reads.select(*rest, "seq", F.lit(False).alias("reverse")).unionByName(reads.select(*rest, sequence.reverse_complement(F.col("seq")).alias("seq"), F.lit(True).alias("reverse")))


def mismatches(a: Column, b: Column) -> Column:
    """Places where two strings of one length differ."""
    split = lambda s: F.split(s, "")
    return F.size(F.filter(F.zip_with(split(a), split(b), lambda x, y: x != y), lambda d: d))


def exact(reads: DataFrame, paths: DataFrame, *, keys: tuple[str, ...] = (), seed: int = 16) -> DataFrame:
    """Every place at which a read (keys, id, seq) stands letter by letter on a path (keys, path, seq) of its keys, forward: keys, id, path, start.

    A read is looked for by its first ``seed`` letters, by all of them if it is shorter; the paths' words of these lengths, at most ``seed`` of
    them, are the other side of the join, which carries ids and places only. What it finds is compared in whole. A read without letters is nowhere.
    """
    keys = list(keys)
    size = F.least(F.char_length("seq"), F.lit(seed))
    heads = reads.where("seq <> ''").select(*keys, "id", size.alias("k"), F.left("seq", size).alias("word"))
    sizes = reads.where("seq <> ''").select(size.alias("k")).distinct()
    places = paths.crossJoin(F.broadcast(sizes)).where(F.char_length("seq") >= F.col("k")).select(*keys, "path", "seq", "k", F.explode(F.sequence(F.lit(1), F.char_length("seq") - F.col("k") + 1)).alias("at"))
    index = places.select(*keys, "path", "k", (F.col("at") - 1).alias("start"), F.substring(F.col("seq"), F.col("at"), F.col("k")).alias("word"))
    hits = shuffled(heads).join(shuffled(index), [*keys, "k", "word"]).select(*keys, "id", "path", "start")
    found = hits.join(shuffled(reads.select(*keys, "id", "seq")), [*keys, "id"]).join(shuffled(paths.select(*keys, "path", F.col("seq").alias("whole"))), [*keys, "path"])
    return found.where(F.substring(F.col("whole"), F.col("start") + 1, F.char_length("seq")) == F.col("seq")).select(*keys, "id", "path", "start")


def gapless(reads: DataFrame, paths: DataFrame, *, keys: tuple[str, ...] = (), seed: int = 16, most: int = 2, unique: bool = True) -> DataFrame:
    """Best full-length placements of reads (keys, id, seq) on the paths (keys, path, seq) of their keys, both strands, up to ``most`` mismatches.

    Words of ``seed`` bases that stand at one place of all paths of their keys are seeds (with ``unique`` unset, all words are); a
    frequent word would pair everything with everything, so it leads nowhere and its reads are left to other stages. The
    join on words carries ids and places only; sequences are fetched for the distinct diagonals that come out of it.
    ``status`` is MAPPED for one best placement and BAD_ALIGN for several. Where paths have ``nodes`` (array of struct node,
    length), placements over the same nodes at the same offset are one, as paths of a graph share nodes.
    """
    keys, strands = list(keys), both_strands(reads.select(*keys, "id", "seq"))
    words = lambda d, own: d.select(*keys, *own, F.explode(sequence.kmers(F.col("seq"), seed)).alias("w")).select(*keys, *own, F.col("w.pos").alias("pos"), "w.kmer")
    index = words(paths, ["path"]).withColumnRenamed("pos", "path_pos")
    if unique:
        index = index.groupBy(*keys, "kmer").agg(F.count("*").alias("n"), F.min(F.struct("path", "path_pos")).alias("at")).where("n = 1").select(*keys, "kmer", "at.path", "at.path_pos")
    hits = words(strands, ["id", "reverse"]).join(shuffled(index), [*keys, "kmer"]).select(*keys, "id", "reverse", "path", (F.col("path_pos") - F.col("pos")).alias("start"))
    whole = paths.select(*keys, "path", F.col("seq").alias("whole"), *(["nodes"] if "nodes" in paths.columns else []))
    found = hits.where("start >= 0").distinct().join(shuffled(strands), [*keys, "id", "reverse"]).join(shuffled(whole), [*keys, "path"])
    n = F.char_length("seq")
    found = found.where(F.col("start") + n <= F.char_length("whole")).withColumn("mismatches", mismatches(F.col("seq"), F.substring(F.col("whole"), F.col("start") + 1, n)))
    spot = graph_spot(F.col("nodes"), F.col("start"), n) if "nodes" in paths.columns else F.concat_ws(":", "path", F.col("start").cast("string"))
    found = found.where(F.col("mismatches") <= most).select(*keys, "id", "path", "start", "reverse", "mismatches", n.alias("n"), spot.alias("spot"))
    best = found.join(shuffled(found.groupBy(*keys, "id").agg(F.min("mismatches").alias("mismatches"))), [*keys, "id", "mismatches"])
    best = best.join(shuffled(best.groupBy(*keys, "id").agg(F.count_distinct("spot").alias("spots"))), [*keys, "id"])
    status = F.when(F.col("spots") == 1, "MAPPED").otherwise("BAD_ALIGN")
    return best.select(*keys, "id", "path", "start", "reverse", "mismatches", "n", "spot", status.alias("status"))


def graph_spot(nodes: Column, start: Column, length: Column) -> Column:
    """Where a stretch of a path (array of struct node, length) lies on its graph: the offset in its first node and the nodes, as text."""
    inside = lambda s, n: (s["at"] + n["length"] > start) & (s["at"] < start + length)
    text = lambda s, n: F.concat(F.when(s["text"] == "", (start - s["at"]).cast("string")).otherwise(s["text"]), F.lit(":"), n["node"].cast("string"))
    step = lambda s, n: F.struct((s["at"] + n["length"]).cast("long").alias("at"), F.when(inside(s, n), text(s, n)).otherwise(s["text"]).alias("text"))
    return F.aggregate(nodes, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")), step)["text"]


def path_sequences(paths: DataFrame, graphs: DataFrame) -> DataFrame:
    """Paths (graph_id, path, nodes: ids in order) with their bases: graph_id, path, seq and nodes as an array of struct node, length.

    A graph is looked at as a whole, in its row; ``graphs`` as in :func:`graph_alignments`.
    """
    rows = paths.select("graph_id", "path", F.col("nodes").alias("way")).join(graphs.select("graph_id", "nodes"), "graph_id")
    own = F.transform("way", lambda w: F.get(F.filter("nodes", lambda n: n["id"] == w), F.lit(0)))
    spans = F.transform(own, lambda n: F.struct(n["id"].alias("node"), F.char_length(n["seq"]).alias("length")))
    return rows.select("graph_id", "path", F.array_join(F.transform(own, lambda n: n["seq"]), "").alias("seq"), spans.alias("nodes"))


STAGES = ("path", "kmer", "pairwise", "graph")


def cascade(reads: DataFrame, graphs: DataFrame, paths: DataFrame, *, seed: int = 16, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Reads (graph_id, id, seq) by the first stage that maps them: graph_id, id, stage, score, reverse, status.

    ``graphs`` as in :func:`graph_alignments`, ``paths`` as in :func:`path_sequences`. Exact and gapless placement are joins; what they
    leave is aligned to each path by itself, and what has no or several best places there to the graph. A read that
    the last stage doesn't map either keeps that stage's status. Each stage's reads are settled in the shared folder.
    """
    if unknown := set(stages) - set(STAGES):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    left, done, columns = reads.select("graph_id", "id", "seq"), [], ["graph_id", "id", "stage", "score", "reverse", "status"]
    if {"path", "kmer"} & set(stages):
        found = gapless(left, path_sequences(paths, graphs), keys=("graph_id",), seed=seed, most=2 if "kmer" in stages else 0).where("status = 'MAPPED'")
        found = found.groupBy("graph_id", "id").agg(F.min("reverse").alias("reverse"), F.min("mismatches").alias("mismatches"), F.min("n").alias("n"))
        found = found.withColumns({"stage": F.when(F.col("mismatches") == 0, "path").otherwise("kmer"), "score": (F.col("n") - 5 * F.col("mismatches")).cast("long"), "status": F.lit("MAPPED")})
        done.append(cut(found.where(F.col("stage").isin(*stages)).select(*columns)))
        left = left.join(done[-1].select("graph_id", "id"), ["graph_id", "id"], "left_anti")
    late = [s for s in ("pairwise", "graph") if s in stages]
    for stage in late:
        rows = path_alignments(left, graphs, paths) if stage == "pairwise" else graph_alignments(left, graphs).withColumn("status", F.when(F.col("is_unique"), "MAPPED").otherwise("BAD_ALIGN"))
        rows = cut(rows.select("graph_id", "id", F.lit(stage).alias("stage"), "score", "reverse", "status"))
        done.append(rows if stage == late[-1] else rows.where("status = 'MAPPED'"))
        left = left.join(rows.where("status <> 'MAPPED'").select("graph_id", "id"), ["graph_id", "id"])
    return reduce(DataFrame.unionByName, done)


#: Cells (reads x bases x positions) that one block of reads may hold for its traces.
BLOCK_CELLS = 30_000_000
_LETTER = np.full(256, 4, np.int8)
_LETTER[[ord(c) for c in "ACGT"]] = range(4)


class _Filled:
    """Local alignment scores of a block of reads on a graph in topological order.

    Columns of the dynamic program are graph positions; a read's bases and the reads are vector axes, the reads innermost, so that a
    running maximum over bases is one over whole rows. Numbers are 16 bits wide where the reads' length allows.
    Gaps in the read close with a running maximum, so no loop runs over bases. A base that is
    none of ACGT, on either side, neither matches nor differs. A gap costs its opening for the first base.
    Nodes without bases are passed through and are no part of an alignment's text.
    """

    def __init__(self, seqs: list[str], nodes: list[tuple[int, str]], edges: list[tuple[int, int]], keep: bool):
        self._describe(seqs, nodes, edges)
        _fill([self], keep)

    @classmethod
    def several(cls, parts: list[tuple], keep: bool) -> list[_Filled]:
        """Reads, nodes and edges of many graphs, filled in one go."""
        made = [cls.__new__(cls) for _ in parts]
        for f, (seqs, nodes, edges) in zip(made, parts, strict=True):
            f._describe(seqs, nodes, edges)
        if made:
            _fill(made, keep)
        return made

    def _describe(self, seqs: list[str], nodes: list[tuple[int, str]], edges: list[tuple[int, int]]) -> None:
        self.seqs, self.nodes = seqs, [(n, s.upper()) for n, s in nodes]
        self.into: dict[int, list[int]] = {}
        for a, b in edges:
            self.into.setdefault(b, []).append(a)
        n = len(seqs)
        self.best, self.node, self.at = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        self.ends = np.zeros(n, np.int64)  # nodes that the best score ends in
        self.score: dict[int, np.ndarray] = {}  # of a node: position, read, base
        self.gap: dict[int, np.ndarray] = {}
        self.tops: list[np.ndarray] = []  # of each position, the best score that ends there
        self.columns: list[tuple[int, int]] = []
        self.every: np.ndarray | None = None

    def places(self, row: int) -> list[tuple[int, int]]:
        """(node, position) of all columns that reach the best score of a read; needs kept scores."""
        if self.every is None:
            self.every = np.stack(self.tops, axis=1)
        return [self.columns[k] for k in np.flatnonzero(self.every[row] == self.best[row]).tolist()]

    def trace(self, row: int) -> tuple[int, str]:
        """Where the best alignment of a read begins in its first node, and its graph CIGAR such as 0[8M]1[4M1X3M]3[8M].

        It ends at the first place that has the best score. Going back, a pair of bases goes before
        a deletion, a deletion before an insertion, and predecessors are asked in their order.
        """
        if not self.best[row]:
            return 0, ""
        seq = dict(self.nodes)
        letters = {name: _LETTER[np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)] for name, bases in self.nodes}
        length = int((self.read[row] != 5).sum())
        node, k = int(self.node[row]), int(self.at[row])
        j = int(self.score[node][k][row].argmax())
        ops: list[tuple[int, str]] = [(node, "S")] * (length - j)
        deleting, begin = False, k

        def before(name: int, k: int) -> list[tuple[int, int]]:
            """(node, position) of the columns before a position, past nodes without bases; none before a source."""
            if k:
                return [(name, k - 1)]
            out, ask = [], list(reversed(self.into.get(name, [])))
            while ask:
                a = ask.pop()
                if (table := self.score.get(a)) is not None:
                    out.append((a, len(table) - 1))
                else:
                    ask += reversed(self.into.get(a, []))
            return out

        while True:
            here, begin = int((self.gap if deleting else self.score)[node][k][row, j]), k
            back = before(node, k)
            if deleting:
                ops.append((node, "D"))
                opened = next(((a, p) for a, p in back if self.score[a][p][row, j] + GAP_OPEN == here), None)
                deleting = opened is None
                node, k = opened or next((a, p) for a, p in back if self.gap[a][p][row, j] + GAP_EXTEND == here)
                continue
            if here == 0:
                break
            if (m := min(k, j)) > 3:
                # Pairs of bases along a diagonal inside the node, all at once.
                back_off = np.arange(m + 1)
                along = self.score[node][k - back_off, row, j - back_off]
                xs, ys = self.read[row, j - 1 - back_off[:-1]], letters[node][k - back_off[:-1]]
                unknown = (xs == 4) | (ys == 4)
                steady = along[1:] + np.where(unknown, 0, np.where(xs == ys, MATCH, MISMATCH)) == along[:-1]
                steady &= along[1:] > 0
                if run := m if steady.all() else int(steady.argmin()):
                    ops += [(node, "N" if u else "M" if e else "X") for u, e in zip(unknown[:run].tolist(), (xs == ys)[:run].tolist(), strict=True)]
                    j, k = j - run, k - run
                    continue
            x, y = (self.read[row, j - 1] if j else 5), _LETTER[ord(seq[node][k])]
            pair = 0 if x == 4 or y == 4 else MATCH if x == y else MISMATCH
            came = next(((a, p) for a, p in back if j and self.score[a][p][row, j - 1] + pair == here), None)
            if j and (came or here == pair):
                ops.append((node, "N" if 4 in (x, y) else "M" if x == y else "X"))
                j -= 1
                if not came or self.score[came[0]][came[1]][row, j] == 0:
                    break
                node, k = came
            elif self.gap[node][k][row, j] == here:
                deleting = True
            else:
                n = next(n for n in range(1, j + 1) if self.score[node][k][row, j - n] + GAP_OPEN + (n - 1) * GAP_EXTEND == here)
                ops += [(node, "I")] * n
                j -= n
        ops += [(node, "S")] * j
        ops.reverse()
        text = []
        for name, group in itertools.groupby(ops, lambda o: o[0]):
            text.append(f"{name}[" + "".join(f"{len(list(g))}{op}" for op, g in itertools.groupby(o[1] for o in group)) + "]")
        return begin, "".join(text)


def _fill(made: list[_Filled], keep: bool) -> None:
    """Fills graphs side by side: step t takes the t-th position of each, so a step's cost is shared by all of them.

    The longest graphs come first, so those that go on are always the first columns. Where a node of a graph begins, the graph's own columns are set to
    the best of what its predecessors ended with.
    """
    made = sorted(made, key=lambda f: -sum(len(s) for _, s in f.nodes))
    sizes, counts = [sum(len(s) for _, s in f.nodes) for f in made], [len(f.seqs) for f in made]
    n, positions, longest = sum(counts), max(sizes), max((len(s) for f in made for s in f.seqs), default=0)
    kind, low = (np.int16, -(10**4)) if longest < 8000 else (np.int32, -(10**6))
    every, base = np.full((n, longest), 5, np.int8), np.full((positions, n), 4, np.int8)  # 5 is behind a read's end
    columns, begins, at = [], [[] for _ in range(positions + 1)], 0
    for f, count in zip(made, counts, strict=True):
        own = slice(at, at + count)
        columns.append(own)
        for k, s in enumerate(f.seqs, at):
            every[k, : len(s)] = _LETTER[np.frombuffer(s.upper().encode("latin-1", "replace"), np.uint8)]
        f.read, at, place = every[own], at + count, 0
        for k, (_, bases) in enumerate(f.nodes):
            if bases:
                base[place : place + len(bases), own] = _LETTER[np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)][:, None]
                begins[place].append((f, own, k))
                place += len(bases)
        begins[place].append((f, own, len(f.nodes)))
    read = np.ascontiguousarray(every.T)
    # Of reads: 0 for a base that neither matches nor differs; what keeps the places behind a read's end below its score.
    known, behind = (read != 4).view(np.int8), (read == 5).view(np.int8) * np.int8(MISMATCH)
    plain = not (read == 4).any() and not any(c not in "ACGT" for f in made for _, s in f.nodes for c in set(s))
    step = (np.arange(longest + 1) * -GAP_EXTEND).astype(kind)[:, None]
    opened = step - kind(GAP_OPEN)
    h, gap = np.zeros((longest + 1, n), kind), np.full((longest + 1, n), low, kind)
    top, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if keep:
        scores, gaps, tops = np.empty((positions, longest + 1, n), kind), np.empty((positions, longest + 1, n), kind), np.empty((positions, n), kind)
    last: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    open_: dict[int, int] = {}  # node that each graph is in, as its number
    for t in range(positions + 1):
        for f, own, k in begins[t]:
            before = open_.get(id(f), -1)
            if before >= 0:
                name, bases = f.nodes[before]
                last[id(f), name] = h[:, own].copy(), gap[:, own].copy()
                reached = top[own]
                f.ends = np.where(reached > f.best, 1, f.ends + ((reached == f.best) & (reached > 0)))
                f.node, f.at = np.where(reached > f.best, name, f.node), np.where(reached > f.best, place[own] - (t - len(bases)), f.at)
                f.best = np.maximum(f.best, reached)
            for name, _ in f.nodes[before + 1 : k + 1]:
                # Nodes without bases hand on what they get.
                state = [last[id(f), a] for a in f.into.get(name, [])]
                last[id(f), name] = reduce(np.maximum, [x[0] for x in state], np.zeros((longest + 1, own.stop - own.start), kind)), reduce(np.maximum, [x[1] for x in state], np.full((longest + 1, own.stop - own.start), low, kind))
            open_[id(f)] = k
            if k < len(f.nodes):
                h[:, own], gap[:, own] = last[id(f), f.nodes[k][0]]
                top[own], place[own] = 0, t
        while sizes and sizes[-1] <= t:
            sizes.pop()
        if not sizes:
            break
        if h.shape[1] > (active := columns[len(sizes) - 1].stop):
            h, gap = h[:, :active], gap[:, :active]
            read, known, behind = (np.ascontiguousarray(x[:, :active]) for x in (read, known, behind))
        here = base[t, :active]
        pair = (read == here).view(np.int8)
        pair *= np.int8(MATCH - MISMATCH)
        pair += np.int8(MISMATCH)
        if not plain:
            pair *= known
            pair *= (here != 4).view(np.int8)
            pair += behind
        gap = np.maximum(gap + GAP_EXTEND, h + GAP_OPEN)
        new = np.maximum(gap, 0)
        np.maximum(new[1:], h[:-1] + pair, out=new[1:])
        # The running maximum over bases, by doubling.
        carried, far = new + step, 1
        spare = np.empty_like(carried)
        while far <= longest:
            np.maximum(carried[far:], carried[:-far], out=spare[far:])
            spare[:far] = carried[:far]
            carried, spare, far = spare, carried, 2 * far
        carried -= opened
        np.maximum(new[1:], carried[:-1], out=new[1:])
        h = new
        best = h.max(axis=0)
        if keep:
            scores[t, :, :active], gaps[t, :, :active], tops[t, :active] = h, gap, best
        better = best > top[:active]
        place[:active][better] = t
        top[:active] = np.maximum(top[:active], best)
    for f, own in zip(made, columns, strict=True):
        place_ = 0
        for name, bases in f.nodes if keep else []:
            if bases:
                span = slice(place_, place_ + len(bases))
                f.score[name], f.gap[name] = scores[span, :, own].transpose(0, 2, 1), gaps[span, :, own].transpose(0, 2, 1)
                f.tops += list(tops[span, own])
                f.columns += [(name, k) for k in range(len(bases))]
                place_ += len(bases)


#: Letters of the words by which reads that stand letter by letter on a graph are found.
EXACT_WORD = 12
#: Ways of one read, and words a position, up to which exact places are followed; beyond them reads go on to alignment.
EXACT_WAYS = 8
_NO_BASE = re.compile("[^ACGT]").search


class _Exact:
    """Where reads stand letter by letter on a graph."""

    def __init__(self, nodes: list[tuple[int, str]], edges: list[tuple[int, int]]):
        self.seq, self.order = {n: s.upper() for n, s in nodes}, {n: k for k, (n, _) in enumerate(nodes)}
        self.after: dict[int, list[int]] = {}
        for a, b in edges:
            self.after.setdefault(a, []).append(b)
        self.words: dict[str, set[tuple[int, int]]] = {}
        made, most = 0, EXACT_WAYS * sum(map(len, self.seq.values()))
        for n, s in self.seq.items():
            for k in range(len(s)):
                grow = [(s[k : k + EXACT_WORD], n)]
                while grow and made <= most:
                    word, end = grow.pop()
                    made += 1
                    if len(word) == EXACT_WORD:
                        self.words.setdefault(word, set()).add((n, k))
                    else:
                        grow += [(word + self.seq[b][: EXACT_WORD - len(word)], b) for b in self.after.get(end, [])]
        if made > most:
            self.words = {}

    def ways(self, read: str) -> list[tuple[list[int], int, int]] | None:
        """All ways (nodes with bases, first and last position in the first and the last of them) of a read of ACGT; None if they are too many."""
        out: list[tuple[list[int], int, int]] = []
        for n, k in self.words.get(read[:EXACT_WORD], ()):
            open_ = [([n], k, 0)]
            while open_:
                way, begin, done = open_.pop()
                bases = self.seq[way[-1]]
                size = min(len(bases) - begin, len(read) - done)
                if not bases.startswith(read[done : done + size], begin):
                    continue
                if done + size == len(read):
                    out.append(([x for x in way if self.seq[x]], k, begin + size - 1))
                else:
                    open_ += [([*way, b], 0, done + size) for b in self.after.get(way[-1], [])]
                if len(out) + len(open_) > EXACT_WAYS:
                    return None
        return out

    def row(self, read: str, back: str) -> tuple | None:
        """What :func:`aligned_block` gives for a read by its exact places alone; None if they don't settle it.

        A score of one a base can't be beaten. A strand that has it in one place is taken if the other hasn't, or isn't unique.
        """
        if len(read) < EXACT_WORD or _NO_BASE(read) or (f := self.ways(read)) is None or (b := self.ways(back)) is None:
            return None
        once = [len({w[0][0] for w in own}) == 1 == len({w[0][-1] for w in own}) for own in (f, b)]
        if f and (once[0] or (b and not once[1])):
            turn = False
        elif b and once[1]:
            turn = True
        else:
            return None
        own = b if turn else f
        node, at = min(((w[0][-1], w[2]) for w in own), key=lambda e: (self.order[e[0]], e[1]))
        ends = [w for w in own if (w[0][-1], w[2]) == (node, at)]
        if len(ends) > 1:
            return None
        way, begin, _ = ends[0]
        sizes = [len(self.seq[n]) for n in way]
        sizes[-1] = at + 1
        sizes[0] -= begin
        return len(read), node, turn, once[turn], begin, "".join(f"{n}[{size}M]" for n, size in zip(way, sizes, strict=True))


def aligned_block(seqs: list[str], nodes: list[tuple[int, str]], edges: list[tuple[int, int]], *, paths: bool = True) -> list[tuple]:
    """Best alignment of each read on one graph: score, end node, reverse, unique, position, graph CIGAR.

    A strand is unique if its best score ends in one node only, and so on the graph and read turned around.
    A unique strand goes before one that isn't, then the better score, then forward.
    """
    return aligned_blocks([(seqs, nodes, edges)], paths=paths)[0]


def aligned_blocks(parts: list[tuple], *, paths: bool = True) -> list[list[tuple]]:
    """:func:`aligned_block` for reads, nodes and edges of many graphs.

    Reads that stand on their graph letter by letter are settled by that where it is certain; the others are aligned, those of many graphs at once.
    """
    out: list[list] = []
    left: list[tuple[int, int, str, str]] = []
    for p, (seqs, nodes, edges) in enumerate(parts):
        index = _Exact(nodes, edges)
        own: list = []
        for k, s in enumerate(seqs):
            read = s.upper()
            back = read[::-1].translate(_COMPLEMENT)
            own.append(index.row(read, back))
            if own[-1] is None:
                left.append((p, k, read, back))
            elif not paths:
                own[-1] = (*own[-1][:4], 0, "")
        out.append(own)
    sizes = [sum(len(s) for _, s in nodes) for _, nodes, _ in parts]
    left.sort(key=lambda x: (-sizes[x[0]], x[0]))
    for group in _portions(left, sizes):
        for (p, k, _, _), row in zip(group, _aligned(group, parts, paths), strict=True):
            out[p][k] = row if paths else (*row[:4], 0, "")
    return out


def _portions(left: list[tuple[int, int, str, str]], sizes: list[int]) -> Iterator[list]:
    """Runs of reads, whose both strands make bounded cells, one read at least."""
    group, longest, positions = [], 0, 0
    for row in left:
        longest_, positions_ = max(longest, len(row[2])), max(positions, sizes[row[0]])
        if group and 2 * (len(group) + 1) * (longest_ + 1) * max(positions_, 1) > BLOCK_CELLS:
            yield group
            group, longest_, positions_ = [], len(row[2]), sizes[row[0]]
        group.append(row)
        longest, positions = longest_, positions_
    if group:
        yield group


def _by_part(group: list[tuple], rows: list[int]) -> list[tuple[int, list[int]]]:
    return [(p, list(g)) for p, g in itertools.groupby(rows, lambda i: group[i][0])]


def _aligned(group: list[tuple], parts: list[tuple], paths: bool) -> list[tuple]:
    """Alignments of reads (part, number, read, its reverse complement; in order of parts), both strands in one go."""
    mine = _by_part(group, range(len(group)))
    filled = _Filled.several([([group[i][2] for i in rows] + [group[i][3] for i in rows], *parts[p][1:]) for p, rows in mine], paths)
    at = {i: (f, k, k + len(rows)) for f, (_, rows) in zip(filled, mine, strict=True) for k, i in enumerate(rows)}
    better = [bool(f.best[b] > f.best[a]) for f, a, b in at.values()]

    def once(rows: list[int], turn: list[bool]) -> dict[int, bool]:
        """Whether a strand's best score begins and ends in one node."""
        few = [i for i in rows if at[i][0].ends[at[i][1 + turn[i]]] <= 1]
        asked = _by_part(group, few)
        back = _Filled.several([([group[i][2 + turn[i]][::-1] for i in own], [(n, s[::-1]) for n, s in reversed(parts[p][1])], [(b, a) for a, b in parts[p][2]]) for p, own in asked], False)
        found = {i: bool(f.ends[k] <= 1) for f, (_, own) in zip(back, asked, strict=True) for k, i in enumerate(own)}
        return {i: found.get(i, False) for i in rows}

    # The better strand is taken if it is unique, so the other one is asked only if it isn't.
    unique = once(list(range(len(group))), better)
    rest = [i for i, u in unique.items() if not u]
    turn = list(better)
    for i, u in once(rest, [not b for b in better]).items():
        if u:
            turn[i], unique[i] = not better[i], True
    out = []
    for i, (f, a, b) in at.items():
        k = b if turn[i] else a
        out.append((int(f.best[k]), int(f.node[k]), turn[i], unique[i], *(f.trace(k) if paths else (0, ""))))
    return out


def _blocks(seqs: list[str], positions: int) -> Iterator[tuple[int, int]]:
    """Runs of reads of bounded cells, one read at least."""
    at = 0
    while at < len(seqs):
        end, longest = at, 0
        while end < len(seqs) and (end == at or (end + 1 - at) * (max(longest, len(seqs[end])) + 1) * max(positions, 1) <= BLOCK_CELLS):
            longest = max(longest, len(seqs[end]))
            end += 1
        yield at, end
        at = end


def graph_scores(reads: DataFrame, nodes: list[tuple[int, str]], edges: list[tuple[int, int]]) -> DataFrame:
    """Best strand of each read (id, seq) on one small graph: score, end_node, reverse, is_unique."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            seqs = [s or "N" for s in rows["seq"]]
            found = aligned_block(seqs, nodes, edges, paths=False)
            if found:
                yield pd.DataFrame({"id": rows["id"], **{n: [f[k] for f in found] for k, n in enumerate(("score", "end_node", "reverse", "is_unique"))}})

    return reads.select(F.col("id").cast("long"), "seq").mapInPandas(run, "id long, score long, end_node long, reverse boolean, is_unique boolean")


ALIGNED = "score long, end_node long, reverse boolean, is_unique boolean, graph_pos int, graph_cigar string"


#: Reads that are aligned to a graph in one call.
READS_TOGETHER = 4096


def by_graph(reads: DataFrame, graphs: DataFrame, align: Callable[[list[tuple[pd.DataFrame, pd.DataFrame]]], dict[str, list]], added: str) -> DataFrame:
    """``reads`` (graph_id, ...) with new columns that ``align`` gives for pairs of some reads of a graph and the graph's row.

    A graph's reads are dealt to groups of about READS_TOGETHER, so a graph that holds most of them is many tasks, and a
    graph goes once to each of its groups, not to each read. Groups of few reads are bundled up to that number, so that what a call costs
    is shared by many small graphs. Reads of a graph that isn't there are left out.
    """
    names, own_names = [c.split()[0] for c in added.split(", ")], ("_group", "_bundle", "_number")
    whole = cut(reads.drop(*names, *own_names), "reads")  # counted, then dealt
    out = T.StructType([*whole.schema, *T.StructType.fromDDL(added)])
    tasks = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = whole.groupBy("graph_id").agg(F.count("*").alias("_reads"), F.ceil(F.count("*") / READS_TOGETHER).cast("int").alias("_groups"))
    sizes = cut(sizes.withColumn("_number", F.monotonically_increasing_id()), "read-groups")
    bundles = max(-(-(sizes.agg(F.sum("_reads")).first()[0] or 0) // READS_TOGETHER), 8 * tasks)
    sizes = sizes.drop("_reads")
    bundle = F.pmod(F.xxhash64("_number", "_group"), F.lit(bundles)).cast("int")
    told = [f.name for f in whole.schema if not isinstance(f.dataType, T.MapType)]
    dealt = whole.join(sizes, "graph_id").withColumn("_group", F.pmod(F.xxhash64(*told), F.col("_groups")).cast("int")).withColumn("_bundle", bundle).drop("_groups", "_group")
    graphs = graphs.join(sizes, "graph_id").withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).withColumn("_bundle", bundle).withColumnRenamed("_number", "_graph").drop("_groups", "_group")

    def run(own: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        rows = graph.drop_duplicates("_graph").set_index("_graph")
        pairs = [(some, rows.loc[[n]]) for n, some in own.groupby("_number") if n in rows.index]
        if not pairs:
            return pd.DataFrame(columns=out.names)
        return pd.concat([some for some, _ in pairs]).assign(**align(pairs))[out.names]

    # A number of tasks is named, as adaptive execution would put many graphs of few bytes into one task, however long they take.
    dealt, graphs = dealt.repartition(tasks, "_bundle"), graphs.repartition(tasks, "_bundle")
    return dealt.groupBy("_bundle").cogroup(graphs.groupBy("_bundle")).applyInPandas(run, out)


def _distinct(seqs: pd.Series) -> tuple[list[str], list[int]]:
    """Different sequences, null as one N, and where each row's is among them: equal reads of a graph are aligned once."""
    at: dict[str, int] = {}
    places = [at.setdefault(s or "N", len(at)) for s in seqs]
    return list(at), places


def _parts(graph: pd.DataFrame) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    nodes, edges = graph["nodes"].iloc[0], graph["edges"].iloc[0]
    return [(int(n["id"]), n["seq"] or "") for n in nodes], [(int(e["a"]), int(e["b"])) for e in edges]


def graph_alignments(reads: DataFrame, graphs: DataFrame) -> DataFrame:
    """``reads`` (graph_id, seq, ...) with the columns of ALIGNED: their best alignment to their graph.

    ``graphs`` has graph_id, nodes (array of struct id, seq in topological order) and edges (array of struct a, b); null
    sequences of reads count as one N.
    """

    def align(pairs: list[tuple[pd.DataFrame, pd.DataFrame]]) -> dict[str, list]:
        seqs = [_distinct(own["seq"]) for own, _ in pairs]
        blocks = aligned_blocks([(some, *_parts(graph)) for (some, _), (_, graph) in zip(seqs, pairs, strict=True)])
        found = [block[p] for block, (_, places) in zip(blocks, seqs, strict=True) for p in places]
        return {c.split()[0]: [f[k] for f in found] for k, c in enumerate(ALIGNED.split(", "))}

    return by_graph(reads, graphs.select("graph_id", "nodes", "edges"), align, ALIGNED)


PAIRED = "score long, reverse boolean, status string, path string, ends int, graph_pos int, graph_cigar string"


def paired_block(seqs: list[str], paths: list[tuple[str, list[tuple[int, str]]]]) -> list[tuple]:
    """Best local alignment of each read to any of some linear paths (name, nodes in order), by strand: the columns of PAIRED.

    Each path and strand has one candidate, that with the first place of its best score. Of those with the best score in all, the first
    by path, forward before reverse, is taken; if others differ from it on the graph, the read is BAD_ALIGN. ``ends`` counts the
    places of the graph, over paths and strands, in which the best score ends. A read of which nothing aligns is UNMAPPED.
    """
    back = [s.upper()[::-1].translate(_COMPLEMENT) for s in seqs]
    tried = []
    for name, nodes in paths:
        chain = [(a[0], b[0]) for a, b in zip(nodes, nodes[1:], strict=False)]
        tried += [(name, turn, _Filled(strand, nodes, chain, True)) for turn, strand in ((False, seqs), (True, back))]
    out = []
    for k in range(len(seqs)):
        best = max((int(f.best[k]) for _, _, f in tried), default=0)
        if not best:
            out.append((0, False, "UNMAPPED", None, 0, 0, ""))
            continue
        own = [(name, turn, f.trace(k), f) for name, turn, f in tried if int(f.best[k]) == best]
        name, turn, (begin, text), _ = own[0]
        ends = {(turn_, *place) for _, turn_, _, f in own for place in f.places(k)}
        out.append((best, turn, "BAD_ALIGN" if any(t != (begin, text) for _, _, t, _ in own) else "MAPPED", name, len(ends), begin, text))
    return out


def path_alignments(reads: DataFrame, graphs: DataFrame, paths: DataFrame) -> DataFrame:
    """``reads`` (graph_id, seq, ...) with the columns of PAIRED: local alignment with affine gaps to each path of their graph by itself.

    ``graphs`` as in :func:`graph_alignments`, ``paths`` has graph_id, path and nodes (ids in order); paths are tried in order of their names.
    """
    ways = paths.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(F.col("path").cast("string").alias("path"), F.col("nodes").alias("way")))).alias("ways"))

    def one(own: pd.DataFrame, graph: pd.DataFrame) -> list[tuple]:
        seq = {int(n["id"]): n["seq"] or "" for n in graph["nodes"].iloc[0]}
        named = [(w["path"], [(int(n), seq[int(n)]) for n in w["way"]]) for w in graph["ways"].iloc[0]]
        seqs, places = _distinct(own["seq"])
        size = sum(len(s) for _, nodes in named for _, s in nodes)
        found = [f for a, b in _blocks(seqs, 2 * size) for f in paired_block(seqs[a:b], named)]
        return [found[p] for p in places]

    def align(pairs: list[tuple[pd.DataFrame, pd.DataFrame]]) -> dict[str, list]:
        found = [f for pair in pairs for f in one(*pair)]
        return {c.split()[0]: [f[k] for f in found] for k, c in enumerate(PAIRED.split(", "))}

    return by_graph(reads, graphs.select("graph_id", "nodes").join(ways, "graph_id"), align, PAIRED)


def _global(ref: str, alt: str, match: int, mismatch: int, gap_open: int, gap_extend: int) -> tuple[int, str, str]:
    """Score of the best end-to-end alignment of two strings, and both with ``-`` where the other has bases.

    One vector step for each base of ``ref``; three bytes are kept for each pair of bases. Of equal
    scores a pair of bases goes before a deletion, a deletion before an insertion.
    """
    n, m, low = len(ref), len(alt), -(10**9)
    bases = np.array([ord(c) for c in alt], np.int64)
    step = np.arange(m + 1) * -gap_extend
    h, down = gap_open - step, np.full(m + 1, low)
    h[0] = 0
    way, longer_down, longer_across = np.ones((n, m + 1), np.uint8), np.zeros((n, m + 1), bool), np.zeros((n, m + 1), bool)
    for i, base in enumerate(ref):
        longer_down[i] = down > h + gap_open
        down = np.maximum(down, h + gap_open) + gap_extend
        pair = np.append(low, h[:-1] + np.where(bases == ord(base), match, mismatch))
        best = np.maximum(pair, down)
        across = np.append(low, np.maximum.accumulate(best + step)[:-1] - step[1:] + gap_open)
        h = np.maximum(best, across)
        longer_across[i, 1:] = across[:-1] > h[:-1] + gap_open
        way[i] = np.where(h == pair, 0, np.where(h == down, 1, 2))
    i, j, state, columns = n, m, 0, []
    while i or j:
        now = state or (int(way[i - 1, j]) if i else 2)
        if now == 2:
            columns.append(("-", alt[j - 1]))
            state = 2 if not i or longer_across[i - 1, j] else 0
            j -= 1
        elif now == 1:
            columns.append((ref[i - 1], "-"))
            state = 1 if longer_down[i - 1, j] else 0
            i -= 1
        else:
            columns.append((ref[i - 1], alt[j - 1]))
            i, j = i - 1, j - 1
    columns.reverse()
    return int(h[m]), "".join(c[0] for c in columns), "".join(c[1] for c in columns)


def global_alignments(rows: DataFrame, *, match: int = 1, mismatch: int = -4, gap_open: int = -5, gap_extend: int = -1) -> DataFrame:
    """``rows`` (ref, alt, ...) with score, gapped_ref and gapped_alt of their end-to-end alignment; null counts as empty.

    Each row stands by itself, so nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [_global(r or "", a or "", match, mismatch, gap_open, gap_extend) for r, a in zip(part["ref"], part["alt"], strict=True)]
            yield part.assign(score=[f[0] for f in found], gapped_ref=[f[1] for f in found], gapped_alt=[f[2] for f in found])

    rows = rows.drop("score", "gapped_ref", "gapped_alt")
    return rows.mapInPandas(run, T.StructType([*rows.schema, *T.StructType.fromDDL("score long, gapped_ref string, gapped_alt string")]))
