"""Best-fit packing of token pieces into sequences of a fixed capacity.

A configuration is a multiset of piece lengths that fits a sequence. The least number of
sequences is the configuration linear program over the histogram of lengths: cover every
length's count by configurations. Multiplicative weights solve it: lengths (in classes of
some tokens, and each by itself, so that what fits exactly is seen) carry a weight that decays as
they are covered, and a knapsack dynamic program prices the best configuration under these
weights. The fractional solution is rounded down, exact lengths fill its classes, and best fit
places what is left, into the gaps first. Of these plans and that of plain best fit, the one with the
fewest sequences is taken.

All of this works on the histogram, at most ``capacity`` numbers whatever the corpus, so the plan
is made on the driver. Pieces are ranked within their length and look their place up by rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphcall.llm.shared import giving_back, partitions, stored
from graphcall.llm.wordbpe import encoded, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole document with its end id; only longer ones are cut.

    Null and empty texts are the end id alone; repeated rows give repeated pieces; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(tokenizer_path), 4 * capacity
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            docs = batch.column(0).to_pylist()
            for first, found in encoded(encode, batch.column(1), end_id):
                for doc, ids in zip(docs[first:], found, strict=False):
                    for n, at in enumerate(range(0, len(ids), size)):
                        part = ids[at : at + size]
                        for column, value in zip(rows, (doc, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(giving_back(run), PIECES)


def _knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every capacity up to this one: the most valuable multiset's worth, and a size it holds (0: a token stays empty).

    value[s]: of one item of size s, -inf where there is none.
    """
    top = int(np.flatnonzero(np.isfinite(value)).max(initial=0))
    back, took, room = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), np.empty(top)  # back[capacity - c]: of capacity c
    value = value[1 : top + 1].copy()
    for c in range(1, capacity + 1):
        at = capacity - c
        n = min(c, top)
        gain = np.add(value[:n], back[at + 1 : at + 1 + n], out=room[:n])
        k = gain.argmax() if n else 0
        if n and gain[k] > back[at + 1]:
            back[at], took[c] = gain[k], k + 1
        else:
            back[at] = back[at + 1]
    return back[::-1], took


def _multiset(took: list[int], capacity: int) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    while capacity > 0:
        if size := took[capacity]:
            out[size] += 1
        capacity -= size or 1
    return out


def configuration_lp(demand: dict[int, int], capacity: int, rate: float = 0.5, step: float = 0.1) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional uses of configurations ((size, times), ...) that cover ``demand``, by multiplicative weights.

    A size's weight starts as its share of all tokens, so that its price per item is its length (the
    dual solution of a packing without waste), and decays exponentially as it is covered. Each round
    prices all configurations in one table and uses the best one until one of its sizes is covered by ``step`` of its
    demand more, then for each size, least covered first, the best one that holds it, if that is worth as much but for
    what a step takes off a weight, and none of its sizes has had its step. Sizes that are covered drop out.
    Every round gives a size its step, so all are covered after at most one round a size and step.
    """
    sizes = np.array(sorted(demand), np.int64)
    if not len(sizes):
        return {}
    need = np.array([demand[int(s)] for s in sizes], float)
    place = {int(s): k for k, s in enumerate(sizes)}
    cover, used = np.zeros(len(sizes)), defaultdict(float)
    while len(open_ := np.flatnonzero(cover < 1 - 1e-9)):
        value = np.full(capacity + 1, -np.inf)
        value[sizes[open_]] = sizes[open_] * np.exp(-rate * (cover[open_] - cover[open_].min()))
        best, took = _knapsack(value, capacity)
        held = value[sizes[open_]] + best[capacity - sizes[open_]]
        near = open_[held >= best[capacity] * np.exp(-rate * step)]
        upto, steps = np.minimum(cover + step, 1), took.tolist()
        for k in (None, *near[np.argsort(cover[near], kind="stable")].tolist()):
            if k is not None and upto[k] - cover[k] <= 1e-9:
                continue
            config = _multiset(steps, capacity - (int(sizes[k]) if k is not None else 0))
            if k is not None:
                config[int(sizes[k])] += 1
            at, times = np.array([place[s] for s in config]), np.array(list(config.values()), float)
            uses = float((need[at] * (upto[at] - cover[at]) / times).min())
            if k is None or uses > 1e-9:
                used[tuple(sorted(config.items(), reverse=True))] += uses
                cover[at] += uses * times / need[at]
    return dict(used)


def packing_plan(histogram: dict[int, int], capacity: int, *, grains: tuple[int, ...] = (4, 1)) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences: (how many, [(length, times), ...]) that use each length exactly as often as it occurs.

    The plan with the fewest sequences: by the linear program, at each of ``grains`` until one needs no more than the lower
    bound, or plain best fit's. Coarse classes are soon covered whatever the histogram, but lose configurations that fit exactly.
    """
    least = sequences_lower_bound(histogram, capacity)
    plans: list = []
    for grain in grains:
        plans.append(_lp_plan(histogram, capacity, grain))
        if sum(n for n, _ in plans[-1]) == least:
            return plans[-1]
    plans.append(_best_fit([(length, n) for length, n in sorted(histogram.items(), reverse=True) if n], [], capacity))
    return min(plans, key=lambda plan: sum(n for n, _ in plan))


def _lp_plan(histogram: dict[int, int], capacity: int, grain: int) -> list[tuple[int, list[tuple[int, int]]]]:
    units = capacity // grain
    classes: dict[int, list[list[int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        classes[-(-length // grain)].append([length, histogram[length]])
    left = {c: sum(n for _, n in runs) for c, runs in classes.items()}
    groups: list[tuple[int, list[tuple[int, int]]]] = []

    def take(c: int, n: int) -> list[tuple[int, int]]:
        """n pieces of class c, longest first, as runs of equal lengths."""
        out, runs = [], classes[c]
        while n:
            got = min(n, runs[0][1])
            out.append((runs[0][0], got))
            runs[0][1] -= got
            n -= got
            if not runs[0][1]:
                runs.pop(0)
        return out

    used = configuration_lp({c: n for c, n in left.items() if c <= units}, units)
    for config, x in sorted(used.items(), key=lambda item: -item[1]):
        times = min(int(x + 1e-9), *(left[c] // a for c, a in config))
        if times < 1:
            continue
        slots = []
        for c, a in config:
            left[c] -= a * times
            slots += [take(c, times) for _ in range(a)]
        # Cut at every change of a slot's length: each stretch is a group of equal sequences.
        while times:
            n = min(s[0][1] for s in slots)
            count: dict[int, int] = defaultdict(int)
            for s in slots:
                count[s[0][0]] += 1
                s[0] = (s[0][0], s[0][1] - n)
                if not s[0][1]:
                    s.pop(0)
            groups.append((n, sorted(count.items(), reverse=True)))
            times -= n
    return _best_fit([(length, n) for c in sorted(classes, reverse=True) for length, n in classes[c] if n], groups, capacity)


def _best_fit(pieces: list[tuple[int, int]], groups: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, on counts: into the smallest gap that holds a piece, else a new sequence."""
    gaps: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    for n, items in groups:
        gaps[capacity - sum(length * a for length, a in items)].append((n, items))
    filled = np.array([bool(g) for g in gaps])
    for length, count in pieces:
        while count:
            at = np.flatnonzero(filled[length:])
            if len(at):
                gap = length + int(at[0])
                n, items = gaps[gap].pop()
                filled[gap] = bool(gaps[gap])
            else:
                gap, n, items = capacity, -(-count // (capacity // length)), []
            per = min(gap // length, count)
            several = min(n, count // per)
            if several < n and gap != capacity:
                gaps[gap].append((n - several, items))
                filled[gap] = True
            rest = gap - per * length
            gaps[rest].append((several, [*items, (length, per)]))
            filled[rest] = True
            count -= several * per
    return [g for held in gaps for g in held]


def sequences_lower_bound(histogram: dict[int, int], capacity: int) -> int:
    return max(-(-sum(s * n for s, n in histogram.items()) // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (columns of PIECES) with ``sequence_id`` and ``offset``; written once to the shared folder.

    Ranks within a length are taken in slices of the corpus (a running count over slices, then a
    row number within each), so no length, however common, lands in one task, not even if its rows
    share one id or repeat: a row's slice follows from its columns and its place in the table. Ties are broken by
    the piece's columns; equal rows are interchangeable. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    slices = max(8, partitions(spark))
    rows = stored(pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(slices))), "pieces")
    counts = stored(rows.groupBy("length", "slice").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = packing_plan(histogram, capacity)

    cuts: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # of a length: first rank, how many sequences, first sequence, offset
    seen: dict[int, int] = defaultdict(int)
    base = 0
    for n, items in plan:
        offset = 0
        for length, times in items:
            cuts[length].append((seen[length], n, base, offset))
            seen[length] += n * times
            offset += length * times
        base += n
    flat = np.array([(length << 48 | first, first, n, start, offset, length) for length in sorted(cuts) for first, n, start, offset in cuts[length]], np.int64).reshape(-1, 6)

    slice_sizes = counts.withColumn("earlier", F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    # Both sides are dealt by length and slice already; a merge sends nothing to the driver, however many slices there are.
    ranked = rows.withColumn("row", F.row_number().over(order) - 1).join(slice_sizes.hint("merge"), ["length", "slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("row") + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(_places(flat), f"{PIECES}, sequence_id long, offset long")


def _places(flat: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            own = flat[np.searchsorted(flat[:, 0], length << 48 | rank, side="right") - 1]
            slot, which = np.divmod(rank - own[:, 1], own[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(own[:, 3] + which), pa.array(own[:, 4] + slot * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, **names: str) -> DataFrame:
    """Encodes, cuts and packs whole documents; one row for each piece. A text is encoded in one piece of a worker's memory."""
    return pack(token_pieces(docs, tokenizer_path, end_id, capacity, **names), capacity)
