"""Removal of word sequences that occur more than once, by a compressed FM-index for each shard.

A window is ``size`` consecutive words. Every window has an anchor, the ``anchor`` words in it with the least hash (the first such
place), which follows from its words alone. Neighbouring windows mostly share their anchor's place; such a run of windows is a unit, the
words that they cover. Equal windows have equal anchors, so units are dealt to shards by their anchor, and a window is looked for in
one shard only, whatever the size of the corpus. Anchors that occur once in the whole corpus can't lie in a repeated
window, and their units are left out before any words move.

A shard's units become an FM-index (:mod:`fm_index`): each different one once, with its number of copies as weight. Then they are streamed
through it, and intervals whose matching statistics reach ``size`` are reported. An anchor that very many different units share (a
passage that is common in all kinds of surroundings) is dealt by single windows instead, so it spreads over shards too.

Texts that repeat take part once, with their number as weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcall.llm.fm_index import FMIndex, repeated_windows
from graphcall.llm.shared import giving_back, stored

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of texts that are anchored together (a single text may have more); different words, and units, that a task remembers; longer words (in bytes) are not kept.
TOGETHER, CACHED, LONGEST_WORD = 500_000, 200_000, 128


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)), 1, 16)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * MIX
    out ^= out >> np.uint64(29)
    out += b
    out *= MIX
    out ^= out >> np.uint64(32)
    return out


def _run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words, from hashes of runs of half the length."""
    if size == 1:
        return words
    half = _run_hashes(words, size // 2)
    out = _mixed(half[: len(half) - size // 2], half[size // 2 :])
    return _mixed(out[: len(words) - size + 1], words[size - 1 :]) if size % 2 else out


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of every ``width`` consecutive values, the first one of equal ones."""
    place, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        span += step
    return place


class Anchors:
    """Units of texts: for each text its number of words, and its units' first words, anchors and hashes."""

    def __init__(self, size: int, anchor: int):
        self.size, self.anchor = size, anchor
        self.known: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) >= CACHED:
                known.clear()
            for w in words:
                if len(w) <= LONGEST_WORD and w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter((known[w] if w in known else xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))

    def units(self, texts: list[list[bytes]]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        size, counts = self.size, np.array([len(t) for t in texts], np.int64)
        none = np.zeros(0, np.int64)
        if not len(counts) or counts.max() < size:
            return [(int(n), none, none, none) for n in counts]
        words = np.concatenate([self._hashes(t) for t in texts])
        least = _run_hashes(words, self.anchor)
        at = _first_least(least, size - self.anchor + 1)  # for each window
        whole = _run_hashes(words, size)
        first = np.cumsum(counts) - counts
        windows = np.maximum(counts - size + 1, 0)
        text_of = np.repeat(np.arange(len(counts)), windows)
        start = np.arange(len(text_of)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(first, windows)
        at = at[start]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text_of[1:] != text_of[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(at)) - 1
        hashes = _mixed(_mixed(whole[start[begin]], whole[start[last]]), (last - begin).astype(np.uint64))
        cut = np.searchsorted(text_of[begin], np.arange(len(counts) + 1))
        own, anchors, hashes = start[begin] - first[text_of[begin]], least[at[begin]].view(np.int64), hashes.view(np.int64)
        return [(int(n), own[a:b], anchors[a:b], hashes[a:b]) for n, a, b in zip(counts, cut[:-1], cut[1:], strict=True)]


def _anchored(size: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(size, anchor)

        def out(keys: list, texts: list) -> pa.RecordBatch:
            found = anchors.units(texts)
            lists = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([f[0] for f in found], pa.int64()), *lists], ["key", "n_words", "starts", "anchors", "hashes"])

        for batch in batches:
            keys, texts, total = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                keys.append(key)
                texts.append((text.as_py() or b"").split())
                total += len(texts[-1])
                if total >= TOGETHER:
                    yield out(keys, texts)
                    keys, texts, total = [], [], 0
            if keys:
                yield out(keys, texts)

    return run


PLACED = "unit binary, anchor long, key binary, start int, copies long, words string, n_words int"


def _placed(size: int):
    """Units of texts (key, text, copies, units (start, windows, anchor, common)) by name, with their words the first two times that a task meets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        names = ["unit", "anchor", "key", "start", "copies", "words", "n_words"]
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32())

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]
            columns[5] = columns[5].cast(pa.string())
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            rows: list[list] = [[] for _ in names]
            size_of = 0
            for key, text, copies, units in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = text.as_py().split()
                for u in units.as_py():
                    first, windows = u["start"], u["windows"]
                    # A common anchor's windows go one by one, each by its own name in place of the anchor.
                    for start, upto in ((k, k + size) for k in range(first, first + windows)) if u["common"] else ((first, first + windows - 1 + size),):
                        part = b" ".join(words[start:upto])
                        name = xxhash.xxh3_128_digest(part)
                        times = seen.get(name, 0)
                        if len(seen) >= CACHED:
                            seen.clear()
                        seen[name] = min(2, times + copies)
                        anchor = int.from_bytes(name[:8], "big", signed=True) if u["common"] else u["anchor"]
                        for column, value in zip(rows, (name, anchor, key, start, copies, part if times < 2 else None, upto - start if times < 2 else 0), strict=True):
                            column.append(value)
                        size_of += len(part) if times < 2 else 64
                if size_of > 4 * 2**20:
                    yield batch_of(rows)
                    rows, size_of = [[] for _ in names], 0
            yield batch_of(rows)

    return run


def _searched(size: int):
    """The interval of repeated words of each unit of a shard, which has at least one repeated window."""

    def run(table: pa.Table) -> pa.Table:
        names = table["unit"].combine_chunks().dictionary_encode()
        of = names.indices.to_numpy()
        weights = np.bincount(of, table["copies"].to_numpy()).astype(np.int64)
        _, first = np.unique(of, return_index=True)
        lists = pc.split_pattern(table["words"].combine_chunks().take(pa.array(first)), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        kinds = len(flat.dictionary) + 1
        flat = flat.indices.to_numpy().astype(np.int64) + 1
        found = repeated_windows(FMIndex(flat, starts, weights, kinds), flat, starts, size)
        at = np.flatnonzero(found)
        own = np.searchsorted(starts, at, side="right") - 1
        units, low = np.unique(own, return_index=True)
        high = np.append(low[1:], len(own)) - 1
        # Windows of a unit hold its anchor, so the words that they cover are one interval.
        a, b = at[low] - starts[units], at[high] - starts[units] + size
        return pa.table({"unit": names.dictionary.take(pa.array(units)), "a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32))})

    return run


def _without(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            n_words, removed, intervals, kept = [], [], [], []
            for text, cuts in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                merged: list[list[int]] = []
                for cut in sorted((c["a"], c["b"]) for c in cuts or ()):
                    if merged and cut[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], cut[1])
                    else:
                        merged.append(list(cut))
                gone = sum(b - a for a, b in merged)
                n_words.append(len(words))
                removed.append(gone)
                intervals.append([{"start": a, "end": b} for a, b in merged])
                if gone:
                    edges = [0, *(x for m in merged for x in m), len(words)]
                    words = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                kept.append(b" ".join(words))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(intervals, kind), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "intervals", "kept_text"])

    return run


def repeated_intervals(docs: DataFrame, *, text_col: str = "text", size: int = 35, anchor: int = 8, shard_words: int = 1_000_000, common: int = 16_384) -> DataFrame:
    """(key, a, b): for texts, by :func:`text_key`, intervals of words that repeated windows cover; they may overlap.

    ``shard_words`` is about the size of an index. The windows of anchors that over ``common`` different units have are
    dealt one by one.
    """
    if not 0 < anchor <= size:
        raise ValueError("an anchor has at least a word and at most a window's words")
    own = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    signed = stored(own.mapInArrow(giving_back(_anchored(size, anchor)), "key binary, n_words long, starts array<int>, anchors array<long>, hashes array<long>").where(F.size("starts") > 0), "anchors")
    # A copy is one row of a group; each task sends a text's units once.
    texts = signed.groupBy("key").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("starts").alias("starts"), F.first("anchors").alias("anchors"), F.first("hashes").alias("hashes"))
    texts = stored(texts, "anchored-texts")
    next_start = F.coalesce(F.get("starts", F.col("k") + 1), (F.col("n_words") - size + 1).cast("int"))
    rows = texts.select("key", "copies", "n_words", "starts", "anchors", "hashes", F.posexplode("starts").alias("k", "start"))
    rows = rows.select("key", "copies", "start", (next_start - F.col("start")).alias("windows"), F.get("anchors", F.col("k")).alias("anchor"), F.get("hashes", F.col("k")).alias("hash"))

    # Equal units are counted before their anchors are, so a text of one repeated word is a row here.
    found = rows.groupBy("anchor", "hash").agg(F.sum("copies").alias("copies"))
    found = found.groupBy("anchor").agg(F.sum("copies").alias("total"), F.count("*").alias("different")).where("total > 1")
    found = stored(found.select("anchor", (F.col("different") > common).alias("common")), "repeated-anchors")

    # An anchor that very many units have is a skewed key of this join, which adaptive execution splits.
    units = rows.select("key", "copies", "start", "windows", "anchor").join(found, "anchor")
    units = stored(units.groupBy("key").agg(F.max("copies").alias("copies"), F.collect_list(F.struct("start", "windows", "anchor", "common")).alias("units")), "text-units")
    whole = own.dropDuplicates(["key"]).join(units, "key").select("key", "text", "copies", "units")
    placed = stored(whole.mapInArrow(giving_back(_placed(size)), PLACED), "placed-units")

    shards = max(1, math.ceil((placed.agg(F.sum("n_words")).first()[0] or 0) / shard_words))
    dealt = placed.where("words IS NOT NULL").select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "unit", "copies", "words")
    hits = stored(dealt.groupBy("shard").applyInArrow(_searched(size), "unit binary, a int, b int"), "repeated-units")
    # So is a unit that very many texts have.
    return placed.select("unit", "key", "start").join(hits, "unit").select("key", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 35, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, intervals (of removed words), kept_text (the others, joined by a space).

    A word goes if a window that covers it occurs anywhere else, in the same text too; windows are judged on the texts as
    they came. Words are what white space (space, tab, newline, vertical tab, form feed, return) separates, unchanged. Null and empty
    texts have no words, and texts of fewer words than a window lose none. Rows that share an id, or have none, are texts
    of their own, and rows with equal texts lose all windows. Other columns are ignored, also those
    named as the new ones; an empty table gives no rows. A very long text takes several times its bytes of a worker.
    Words are compared as they are; only anchors, units' and texts' names are hashes (64 bits to find candidates, 128 for names).
    """
    cuts = repeated_intervals(docs, text_col=text_col, size=size, **options)
    cuts = stored(cuts.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("cuts")), "cuts")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("key"))
    rows = rows.join(cuts, "key", "left").select("doc_id", "text", "cuts")
    return rows.mapInArrow(_without(size), "doc_id long, n_words long, n_removed long, intervals array<struct<start:int,end:int>>, kept_text string")
