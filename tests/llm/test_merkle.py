"""The Merkle manifest against a plain recursion, over nulls, repeated rows, ties, an empty table and clashing columns."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphcall.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node string, place long, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def grow(nodes, fanout):
    """All levels of a tree, from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def climb(levels, at, node, fanout):
    siblings = ""
    for level in levels[:-1]:
        first = at - at % fanout
        run = level[first : first + fanout]
        siblings += "".join(run[: at - first] + run[at - first + 1 :])
        node = h(*run[: at - first], node, *run[at - first + 1 :])
        at //= fanout
    return node, siblings


def brute(rows, fanout, tampered):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = grow([leaf_of(r) for r in groups[s]], fanout)
    top = grow([trees[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(groups[s]):
            sub, one = climb(trees[s], at, leaf_of(tampered(r)), fanout)
            folded, two = climb(top, k, sub, fanout)
            out.append((r[0], r[1], leaf_of(r), trees[s][-1][0], top[-1][0], h(one + two), folded, folded == top[-1][0]))
    return collections.Counter(out)


def make(sizes, rng):
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            doc += rng.randint(1, 3)
            text = rng.choice([None, "", "plain lower", "Some TEXT", "Ünï ÇÖDÉ", "x:1-" * rng.randint(1, 50)])
            rows.append((rng.choice([doc] * 20 + [None, doc - 1]), source, rng.choice(["en", None, ""]), rng.choice([None, 5, -1]), text, "t", "n", 1, "p"))
    return rows


@pytest.mark.parametrize(("fanout", "levels", "sizes"), [(16, 2, {"a": 300, None: 17, "": 1, "é": 16, "z": 257, "b": 2}), (2, 2, {"a": 37, "b": 4, "c": 5, None: 1, **{f"s{k}": 1 + k % 3 for k in range(40)}}), (3, 1, {"only": 28}), (16, 2, {"one": 1})])
def test_manifest(spark, fanout, levels, sizes):
    rng = random.Random(str(sizes))
    rows = make(sizes, rng)
    rows += [rows[0]] * 5
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lower = lambda r: (*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]), *r[5:])
    tampered = lambda r: lower(r) if r[0] is not None and __import__("zlib").crc32(str(r[0]).encode()) % 5 == 0 else r
    got = merkle.manifest(docs, fanout=fanout, levels=levels, **merkle.lower_cased(docs)).collect()
    assert collections.Counter(map(tuple, got)) == brute(rows, fanout, tampered)
    if len(rows) > 100:
        assert {r.verified for r in got} == {True, False}


def test_without_tampering_all_verify(spark):
    docs = spark.createDataFrame(make({"a": 40, None: 3}, random.Random(1)), SCHEMA)
    assert merkle.manifest(docs).where(~F.col("verified")).count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty, **merkle.lower_cased(empty)).count() == 0
