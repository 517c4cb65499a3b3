"""Rows that repeat very often, spans and words of any length, thresholds of any height."""

import collections
import random
import re
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphcall.llm import exact_dedup, jaccard_join, packing, pii, sharding, shared, token_files

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_each_copy(spark, chunk):
    rows = shared.stored(spark.createDataFrame([("a", 10, 5), ("b", 1, 1), ("c", 0, 1), ("d", None, 1), ("a", 3, 100), (None, 7, 0)], "k string, n long, first long"), "test")
    got = shared.each_copy(rows, "n", "i", chunk=chunk).collect()
    assert sorted((r.k or "", r.n, r.i) for r in got) == sorted([("a", 10, i) for i in range(1, 11)] + [("b", 1, 1)] + [("a", 3, i) for i in range(1, 4)] + [("", 7, i) for i in range(1, 8)])
    got = shared.each_copy(rows, "n", "i", start=F.col("first"), chunk=chunk).where("k = 'a'").collect()
    assert sorted(r.i for r in got) == [*range(5, 15), *range(100, 103)]


def test_a_row_many_times(spark, tmp_path):
    rows = [(None, "the same text in very many rows", "s")] * 700 + [(5, "", None)] * 300 + [(k, f"text {k}", "t") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = exact_dedup.duplicate_decisions(docs).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 22 and {r.group_size for r in got} == {700, 300, 1}
    assert sharding.shard_rows(docs, 2000).count() == len(rows)
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 2000)
    read = spark.read.parquet(f"file://{tmp_path}/shards")
    assert collections.Counter((r.doc_id, r.text, r.source) for r in read.collect()) == collections.Counter(rows)
    got = packing.pack_documents(docs, WORD, 0, 64).collect()
    assert len(got) == len(rows) and len({(r.sequence_id, r.offset) for r in got}) == len(rows)
    got = token_files.read_token_files(spark, token_files.write_token_files(docs.repartition(8), WORD, 2, segment_ids=500)).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)


@pytest.mark.parametrize("threshold", [0.01, 0.03, 0.2, 0.5, 0.8, 0.95, 1])
def test_bands_reach_their_recall(threshold):
    bands, rows = jaccard_join.band_counts(threshold, 0.999)
    assert 1 - (1 - threshold**rows) ** bands >= 0.999 - 1e-9
    with pytest.raises(ValueError, match="threshold"):
        jaccard_join.band_counts(0, 0.9)


def test_links_at_a_low_threshold(spark):
    rng = random.Random(4)
    shared_words = [f"s{k}" for k in range(12)]
    rows = [(k, " ".join([*shared_words[: rng.randint(6, 12)], *(f"u{k}x{i}" for i in range(40))])) for k in range(12)]
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    want = {k: sum(j != k and len(sets[k] & sets[j]) >= 0.03 * len(sets[k] | sets[j]) for j in sets) for k in sets}
    got = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), size=5, threshold=0.03)
    assert {r.doc_id: r.n_links for r in got.collect()} == want


OLD = re.compile(r"\S+ ?(?:@|[\[(]at[\])]| at ) ?\S+(?:\.|[\[(]dot[\])]| dot )\S*|\S+ [\[(]?at[\])]? \S+ [\[(]?dot[\])]? \S+", re.I)


def test_addresses_of_any_form_and_length():
    rng = random.Random(6)
    parts = ["a", "b.c", "@", " ", "at", "[at]", "(AT)", " at ", "dot", "[dot]", " dot ", ".", "x9"]
    for _ in range(20000):
        text = " ".join("".join(rng.choices(parts, k=rng.randint(1, 6))).split())
        assert pii.address_like(text) == bool(OLD.fullmatch(text)), text
    began = time.monotonic()
    assert not pii.address_like("a@" * 200_000) and pii.address_like("a" * 10**6 + "@" + "b." * 10**5) and not pii.address_like("a " * 10**6)
    assert time.monotonic() - began < 5


def test_long_spans_and_words_are_personal_data_too():
    name = "n7" * 150
    tagger = pii.Tagger(pii.trained_model())
    for text in (f"Please write to {name} [at] mail8 [dot] example [dot] com today.", f"Please write to {name} at host9 dot com today."):
        start = text.index(name)
        spans = [(start, 0, start + len(name) + 30)]
        end = text.index("com") + 3
        assert pii.added_spans(text, [], [(start, 0, end)]) == ([(start, 0, end)] if OLD.fullmatch(text[start:end]) else [])
        assert spans[0][2] - start > 256
    short, long = (pii.word_class(f"{'a1' * n}@mail.example.com") for n in (3, 300))
    assert "mail" in short and "mail" in long
    assert pii.word_class("9" * 300)[1] == "digits=20" and tagger.spans(["9" * 300 + " plain"]) is not None


@pytest.mark.parametrize("kind", ["near-equal", "mixed", "few in common"])
def test_blocks_of_a_cluster(kind):
    """Counts of shared values by either way, links and where they lead, against sets."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    for one in (True, False):
        sets = []
        for k in range(90):
            own = base.copy()
            if kind == "near-equal":
                own[rng.integers(0, 60, rng.integers(0, 8))] = rng.integers(0, 2**63, 1, dtype=np.uint64)
            elif kind == "mixed":
                own = np.concatenate([rng.choice(base, rng.integers(1, 60), replace=False), rng.integers(0, 50, rng.integers(0, 40), dtype=np.uint64)])
            else:
                own = rng.integers(0, 4000, 12, dtype=np.uint64)
            sets.append(np.unique(own))
        copies = rng.integers(1, 4, 90)
        block = np.zeros(90, int) if one else np.arange(90) % 2
        frame = pd.DataFrame({"cluster": 0, "i": 0, "j": 0 if one else 1, "block": block, "key": [k.to_bytes(2, "big") for k in range(90)], "copies": copies, "shingles": [s.tobytes() for s in sets]})
        got = jaccard_join._block(0.8)(frame).set_index("key")
        as_sets = [set(s.tolist()) for s in sets]
        near = {(a, b) for a in range(90) for b in range(90) if a != b and (one or block[a] != block[b]) and len(as_sets[a] & as_sets[b]) >= 0.8 * len(as_sets[a] | as_sets[b]) - 1e-9}
        label = list(range(90))
        for _ in range(90):
            for a, b in near:
                label[a] = label[b] = min(label[a], label[b])
        roots = collections.defaultdict(set)
        for k in range(90):
            name = k.to_bytes(2, "big")
            assert got.loc[name, "links"] == sum(copies[b] for a, b in near if a == k)
            roots[label[k]].add(got.loc[name, "root"])
        assert all(len(r) == 1 for r in roots.values()) and len({next(iter(r)) for r in roots.values()}) == len(roots)
