"""Substring deduplication and its index against brute force, over nulls, long and repeated texts, common passages, an empty table and clashing columns."""

import collections
import random

import numpy as np
import pytest

from graphcall.llm import substring_dedup
from graphcall.llm.fm_index import FMIndex, WaveletMatrix, repeated_windows, suffix_order

SCHEMA = "doc_id long, text string, key string, n_words long, kept_text string, starts string"


def brute(rows, size):
    texts = [[w for w in __import__("re").findall("[^\x20\x09-\x0d]+", t or "")] for _, t, *_ in rows]
    times = collections.Counter(tuple(t[k : k + size]) for t in texts for k in range(len(t) - size + 1))
    out = []
    for (doc, *_), t in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(t) - size + 1):
            if times[tuple(t[k : k + size])] > 1:
                gone.update(range(k, k + size))
        out.append((doc, len(t), len(gone), " ".join(w for k, w in enumerate(t) if k not in gone)))
    return collections.Counter(out)


def corpus(size, n, rng):
    words = [f"w{k}" for k in range(60)] + ["É", "<P>", "\x85", "a\xa0b"]
    passage = [rng.choices(words, k=3 * size) for _ in range(3)]
    rows = []
    for k in range(n):
        t = rng.choices(words, k=rng.randint(0, 4 * size))
        for _ in range(rng.randint(0, 2)):
            p, at = rng.choice(passage), rng.randint(0, len(t))
            a = rng.randint(0, 2 * size)
            t[at:at] = p[a : a + rng.randint(1, 2 * size)]
        rows.append((rng.choice([k, None, k % 5]), rng.choice([" ", "\n", "\t  \r"]).join(t), "k", 1, "t", "s"))
    rows += [(1000 + k, t, "k", 1, "t", "s") for k, t in enumerate([None, "", " \n", "one", "same " * (5 * size), "ab ba " * (2 * size), " ".join(passage[0]), " ".join(passage[0]), "x" * 5000, "y " * 20000])]
    return rows + rows[:3] + [rows[0]] * 4


@pytest.mark.parametrize(("size", "options"), [(35, {}), (6, {"anchor": 2}), (6, {"anchor": 2, "shard_words": 200, "common": 3}), (5, {"anchor": 5, "common": 1}), (1, {"anchor": 1})])
def test_without_repeats(spark, size, options):
    rows = corpus(size, 60, random.Random(size))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = substring_dedup.without_repeats(docs, size=size, **options).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute(rows, size)
    for r in got:
        assert sum(i.end - i.start for i in r.intervals) == r.n_removed and all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:], strict=False))
    if size == 6:
        assert 0 < sum(r.n_removed for r in got) < sum(r.n_words for r in got)


def test_empty_table_and_arguments(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.without_repeats(empty).count() == 0
    with pytest.raises(ValueError, match="anchor"):
        substring_dedup.repeated_intervals(empty, size=5, anchor=6)


def test_index():
    rng = np.random.default_rng(1)
    for kinds, n, longest in ((2, 1, 1), (2, 30, 9), (4, 200, 12), (50, 300, 40), (1000, 50, 20)):
        sizes = rng.integers(1, longest + 1, n)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = rng.integers(1, kinds, starts[-1])
        weights = rng.integers(1, 3, n)
        index = FMIndex(flat, starts, weights, kinds)
        lists = [flat[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]
        for size in (1, 2, 3, 7):
            times = collections.Counter()
            for x, w in zip(lists, weights, strict=True):
                for k in range(len(x) - size + 1):
                    times[tuple(x[k : k + size])] += int(w)
            for pattern in [*list(times)[:40], tuple(rng.integers(1, kinds, size).tolist())]:
                word = np.array(pattern[-1:])
                low, high = index.first[word], index.first[word + 1]
                for w in pattern[-2::-1]:
                    low, high = index.extend(low, high, np.array([w]))
                assert int(index.weight[high[0]] - index.weight[low[0]]) == times[pattern]
            want = [k + size <= len(x) and times[tuple(x[k : k + size])] > 1 for x in lists for k in range(len(x))]
            assert repeated_windows(index, flat, starts, size).tolist() == want


def test_suffix_order_and_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n in (1, 2, 17, 300):
        text = np.concatenate([rng.integers(1, 4, n), [0]])
        assert suffix_order(text).tolist() == sorted(range(n + 1), key=lambda k: text[k:].tolist())
        symbols = rng.integers(0, 9, n)
        matrix = WaveletMatrix(symbols, 9)
        for s in range(9):
            at = np.arange(n + 1)
            count = matrix.down(at, np.full(n + 1, s)) - matrix.down(np.zeros(1, np.int64), np.array([s]))
            assert count.tolist() == [int((symbols[:k] == s).sum()) for k in at]
