"""Fill-in-middle against brute force, over nulls, empty and long texts, marks, repeats, an empty table and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphcall.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, output string"
TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\nc", "a\nb\nc\n", "Ünï\ncödé \U0001f642\n日本\n語", "\r\n\x0b\n\x85\n", "has <P> inside\nand more", "<S>", "<M>\n", "ends with <\nS>\n<\nM", "<S\n><P\n",
    "line of text\n" * 5000, "x" * 100000, "é\n" * 3000, " \t\n ",
]


def cut(doc, text, seed, rate, spm_rate):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("buffer", "rate", "spm_rate"), [(fim.BUFFER, 100, 50), (20, 60, 30), (1, 100, 100)])
def test_fill_in_middle(spark, buffer, rate, spm_rate):
    rows = [(k * 13, t, 1, "f", "o") for k, t in enumerate(TEXTS * 4)]
    rows += [(None, "a\nb\nc\nd", 1, "f", "o"), (None, None, 1, "f", "o"), rows[6], rows[6], (rows[6][0], "another\ntext of that id", 1, "f", "o"), (-5, "minus\nfive\n", 1, "f", "o")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = fim.fill_in_middle(docs, seed=7, rate=rate, spm_rate=spm_rate, buffer=buffer).withColumn("again", fim.restored(F.col("form"), F.col("output"))).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter(cut(r[0], r[1], 7, rate, spm_rate) for r in rows)
    assert collections.Counter((r.doc_id, r.again) for r in got) == collections.Counter((r[0], r[1] or "") for r in rows)


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rank_and_select():
    rng = random.Random(3)
    for size in (0, 1, 63, 64, 65, 1000, 4096):
        for share in (0, 0.01, 0.5, 1):
            bits = np.array([rng.random() < share for _ in range(size)], bool)
            vector = fim.BitVector(bits)
            assert vector.rank(np.arange(size + 1)).tolist() == [int(bits[:k].sum()) for k in range(size + 1)]
            ones = np.flatnonzero(bits)
            assert vector.select(np.arange(len(ones))).tolist() == ones.tolist()
