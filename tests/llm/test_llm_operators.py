"""Every dealt operator against brute force, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import re
import zlib
from array import array

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphcall.llm import chat, exact_dedup, jaccard_join, line_dedup, packing, pii, quality, sharding, token_files, tree_bpe

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, hash string, n long, kept string, shard string, key string, _hash string"

PROSE = "The quick brown fox jumps over the lazy dog near the river bank while seven old men watch it from the bridge above. "
TEXTS = [
    None, "", " \n\t", "one", PROSE * 4, PROSE * 4, (PROSE * 4).upper(), PROSE * 4 + "Changed at the end.", "Ünï çödé ÉİΣΑΣ straße it's don't 12 345 \U0001f642 日本語",
    "a\nb\nThe same long line here\nb", "  THE SAME long line here\t\nother", "The same long line here", "x" * 30000, "word " * 9000, "mail a.b@c.de or +1 (988) 555-2485 and 4111 1111 1111 1111 at 10.0.0.1", "\x1c\x1d \x85\xa0<|endoftext|> \\### </turn>",
]


def rows_of(texts=TEXTS):
    out = [(k, t, "h", 1, "k", "s", "y", "z") for k, t in enumerate(texts)]
    return [*out, (None, PROSE * 4, "h", 1, "k", "s", "y", "z"), (None, None, "h", 1, "k", "s", "y", "z"), out[4], out[4], (3, "another text with the same id", "h", 1, "k", "s", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return collections.Counter(rows)


def given():
    return [(r[0], r[1] or "") for r in rows_of()]


def test_token_files(spark, docs, empty):
    path = token_files.write_token_files(docs, WORD, 2, segment_ids=500)
    got = token_files.read_token_files(spark, path).collect()
    t = Tokenizer.from_file(WORD)
    ids = lambda x: array("I", [*t.encode(x, add_special_tokens=False).ids, 2]).tobytes()
    want = counted((i, len(ids(x)) // 4, zlib.crc32(ids(x)), ids(x)) for i, x in given())
    assert counted((r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got) == want
    at, before = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (before is None or r.doc_id >= before)
        at, before = at + r.n_tokens, r.doc_id
    path = token_files.write_token_files(empty, WORD, 2)
    assert token_files.read_token_files(spark, path).count() == 0


def test_segment_round_trip():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        for high in (1, 2, 50000, 2**32):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            ids[3:9] = 2**32 - 1
            docs, lengths, out = token_files.decode_segment(token_files.encode_segment([None, 7], [n, 0], ids))
            assert docs == [None, 7] and list(lengths) == [n, 0] and (out == ids).all()


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, empty, weak):
    # A hash of four values makes nearly all chunks clash, and only their texts tell them apart.
    options = {"chunk_hash": lambda c: F.pmod(F.xxhash64(c), F.lit(4))} if weak else {}
    lower = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    groups = collections.defaultdict(list)
    for i, x in given():
        groups[lower(x)].append(i)
    got = exact_dedup.duplicate_decisions(docs, **options).collect()
    assert counted((r.doc_id, r.text_sha256) for r in got) == counted((i, hashlib.sha256(lower(x).encode()).hexdigest()) for i, x in given())
    by = {hashlib.sha256(x.encode()).hexdigest(): ids for x, ids in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = counted(r.text_sha256 for r in got if r.kept)
    assert kept == counted(list(by)) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.without_duplicates(docs).count() == len(by)
    assert exact_dedup.duplicate_decisions(empty).count() == 0


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(docs, empty, batches, fanout):
    ws = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(ws))
    owner = {}
    low = lambda i: -(2**63) if i is None else i
    for i, x in given():
        for k in map(key, x.split("\n")):
            if len(k) >= 10:
                owner[k] = min(owner.get(k, 2**63), low(i))
    want = []
    for i, x in given():
        lines = x.split("\n")
        stay = [y for y in lines if owner.get(key(y), low(i)) == low(i)]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    got = line_dedup.line_decisions(docs, batches=batches, fanout=fanout).collect()
    assert counted((r.doc_id, len(r._lines), len(r._dropped), r._kept_text) for r in got) == counted(want)
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns
    assert line_dedup.line_decisions(empty).count() == 0


def test_packing(docs, empty):
    t = Tokenizer.from_file(WORD)
    want = []
    for i, x in given():
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        want += [(i, n, at, len(ids[at : at + 256]), zlib.crc32(array("I", ids[at : at + 256]).tobytes())) for n, at in enumerate(range(0, len(ids), 256))]
    got = packing.pack_documents(docs, WORD, 0, 256).collect()
    assert counted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == counted(want)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty, WORD, 0).count() == 0


def test_packing_plan_is_close_to_the_bound():
    import numpy as np

    rng = np.random.default_rng(3)
    for lengths in (rng.integers(300, 1100, 6000), np.clip(rng.lognormal(6, 1, 20000), 1, 2048).astype(int), np.full(999, 683), np.array([2048, 1])):
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = packing.packing_plan(histogram, 2048)
        used = collections.Counter()
        for n, items in plan:
            assert n > 0 and sum(length * a for length, a in items) <= 2048
            for length, a in items:
                used[length] += n * a
        assert used == histogram
        floor = packing.sequences_lower_bound(histogram, 2048)
        assert sum(n for n, _ in plan) <= max(floor * 1.02 + 2, -(-len(lengths) // (2048 // min(lengths))) if len(histogram) == 1 else 0)


@pytest.mark.parametrize(
    "histogram, least",
    [({682: 300}, 100), ({681: 300}, 100), ({409: 500}, 100), ({341: 600}, 100), ({1023: 50, 1025: 50}, 50), ({1: 4096}, 2), ({1: 100, 1948: 1}, 1), ({1: 4, 2044: 1, 682: 3, 2: 1}, 2)],
)
def test_packing_plan_sees_what_fits_exactly(histogram, least):
    plan = packing.packing_plan(histogram, 2048)
    used = collections.Counter()
    for n, items in plan:
        assert sum(length * a for length, a in items) <= 2048
        for length, a in items:
            used[length] += n * a
    assert used == histogram and sum(n for n, _ in plan) == least


def test_tree_bpe(docs, empty):
    ranks = tree_bpe.load_ranks(BYTE)
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, x in given():
        raw = array("I", t.encode_ordinary(x)).tobytes()
        want.append((i, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    got = tree_bpe.round_trip(docs, BYTE, public_tokenizers.PATTERN).collect()
    assert counted(map(tuple, got)) == counted(want)
    assert tree_bpe.round_trip(empty, BYTE, public_tokenizers.PATTERN).count() == 0
    ids = tree_bpe.encoded(docs, BYTE, public_tokenizers.PATTERN)
    assert counted(bytes(r.raw).decode() for r in tree_bpe.decoded(ids, BYTE, public_tokenizers.PATTERN).collect()) == counted(x for _, x in given())


@pytest.mark.parametrize("options", [{}, {"leaf": 2, "text_leaf": 7}, {"leaf": 1, "text_leaf": 1, "longest": 3}, {"text_leaf": 40, "cached": 50, "cached_matches": 50}])
def test_tree_bpe_seams(options):
    import random

    ranks, rng = tree_bpe.load_ranks(BYTE), random.Random(3)
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = tree_bpe.TreeBpe(ranks, public_tokenizers.PATTERN, **options)
    assert bpe.by_words
    letters = "ab'stdlE é÷ß \n\x0b1!<|>endoftext́日\x85  ''"
    for x in ["".join(rng.choice(letters) for _ in range(rng.randint(1, 900))) for _ in range(150)] + [" " * 999 + "x", "it's   we'll\n\n x", "ab" * 900]:
        assert list(memoryview(bpe.encode(x)).cast("I")) == t.encode_ordinary(x)


def test_tree_bpe_results_come_through_joins(spark):
    bpe = tree_bpe.TreeBpe(tree_bpe.load_ranks(BYTE), public_tokenizers.PATTERN)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        bpe.encode(r.text)
    assert bpe.joined_chars > 0.95 * (bpe.joined_chars + bpe.leaf_chars)
    assert bpe.joined_bytes > 0.95 * (bpe.joined_bytes + bpe.leaf_bytes)


def test_tree_bpe_on_hard_matches():
    ranks = tree_bpe.load_ranks(BYTE)
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = tree_bpe.TreeBpe(ranks, public_tokenizers.PATTERN, leaf=2)
    for x in ("a" * 3001, "ab" * 900, "thing" * 700, "-" * 2000, " " * 999 + "x", "日" * 600, "a  \n b", "it's   we'll\n\n x", "\x1c\x1d a"):
        assert list(memoryview(bpe.encode(x)).cast("I")) == t.encode_ordinary(x)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", pii.card_ok),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", pii.phone_ok),
}
HARD = ["a@b@c.d x@y.zz@q.r+1@..b.c 1.2.3.4.5.6.7 300.1.2.3 0001.2.3.4 +1(2)3456789 -+12 3 4 5 6 7 8 9 0 1@x", "4111-1111 11111111 4111 1111 1111 1111 9", "@@a.b a@b a@b. a@b.c-", "1" * 3000, "@" * 500 + "a" * 500 + "@b.c"]


def test_pii(spark, docs, empty):
    own = docs.unionByName(spark.createDataFrame([(100 + k, t, "h", 1, "k", "s", "y", "z") for k, t in enumerate(HARD)], SCHEMA))
    want = []
    for i, x in given() + [(100 + k, t) for k, t in enumerate(HARD)]:
        spans = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE.values()) for m in re.finditer(p, x) if ok(m.group())]
        base = pii.listed(spans)
        want.append((i, *(sum(k == n for _, n, _ in spans) for k in range(4)), hashlib.sha256(base.encode()).hexdigest()))
    got = pii.scanned(own).collect()
    assert counted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == counted(want)
    row = next(r for r in got if r.doc_id == 14)
    assert "a.b@c.de" not in row.redacted_text and "[CARD]" in row.redacted_text and row.hash == "h"
    assert pii.scanned(empty).count() == 0
    assert pii.without_personal_data(docs).columns == docs.columns


def test_crf_on_held_out_rows():
    tagger = pii.Tagger(pii.trained_model())
    hits = total = wrong = 0
    for words, labels in pii.labelled_table(300, seed=99):
        text = " ".join(words)
        places, want, k = [m.span() for m in re.finditer(r"\S+", text)], set(), 0
        for k, label in enumerate(labels):
            if label[0] == "B":
                end = k
                while end + 1 < len(labels) and labels[end + 1] == "I" + label[1:]:
                    end += 1
                want.add((places[k][0], pii.KINDS.index(label[2:]), places[end][1]))
        found = set(tagger.spans([text])[0])
        hits, total, wrong = hits + len(found & want), total + len(want), wrong + len(found - want)
    assert hits >= 0.9 * total and wrong <= 0.1 * total


def test_crf_skips_only_what_is_certain():
    sure, whole = pii.Tagger(pii.trained_model()), pii.Tagger(pii.trained_model())
    assert sure.margin is not None
    whole.margin = None
    rows = pii.labelled_table(120, seed=5)
    texts = [" ".join(w) for w, _ in rows] + ["plain " * k + " ".join(rows[k][0]) + " word" * 90 + " at " + " ".join(rows[k + 1][0]) for k in range(60)] + ["", "one", "two words", "w " * 500]
    assert sure.spans(texts) == whole.spans(texts)


@pytest.mark.parametrize("cached", [1, 8, 50])
def test_crf_goes_on_beyond_its_classes(cached):
    whole, small = pii.Tagger(pii.trained_model()), pii.Tagger(pii.trained_model(), cached=cached)
    texts = [" ".join(w) for w, _ in pii.labelled_table(60, seed=8)]
    texts += [" ".join(hashlib.md5(f"{k} {n}".encode()).hexdigest() for n in range(20)) + " call (988) 555-2485 now" for k in range(10)] + ["", "plain words"]
    assert small.spans(texts) == whole.spans(texts) and any(whole.spans(texts))
    assert small.spans(texts[::-1]) == whole.spans(texts)[::-1]
    assert len(whole.classes) > 50 and len(small.classes) < len(whole.classes)


def test_quality(docs, empty):
    def repeated(words):
        n = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        return len({k + d for k in range(len(words) - 2) if n[tuple(words[k : k + 3])] > 1 for d in range(3)})

    want = []
    for i, x in given():
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        rep = repeated(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), rep, len(words) < 50 or 100 * rep > 50 * len(words)))
    got = quality.judged(docs).collect()
    assert counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == counted(want)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judged(empty).count() == 0


def test_quality_lines():
    good = " ".join(f"w{k} x{k % 7}y{k}." for k in range(80))
    assert quality.line_verdict(good)[0]
    menu = "home | news | about | contact | search | login"
    assert quality.line_fails(menu) and quality.line_fails("Released under the MIT License.") and not quality.line_fails("Ti.")
    kept, n, lost, clean = quality.line_verdict(f"{good}\n{menu}")
    assert kept and n == 1 and lost == len(menu) and clean == good
    assert not quality.line_verdict("\n".join([menu] * 9 + ["fine."]))[0]


def test_quality_keeps_wrapped_prose():
    words = "the old men of the village who had seen many winters watched the slow river carry its ice down to the sea".split()
    sentences = [f"{' '.join(words[k % 5 :] + words[: k % 5])} {'again ' * (k % 3)}{mark}" for k in range(8) for mark in ("today.",)]
    flat = " ".join(sentences).split()
    wrapped = "\n".join(" ".join(flat[k : k + 12]) for k in range(0, len(flat), 12))
    assert any(quality.line_fails(x) for x in wrapped.split("\n"))
    assert quality.line_verdict(wrapped) == (True, 0, 0, wrapped)
    hindi = "भारत एक बहुत बड़ा देश है और यहाँ के लोग कई भाषाएँ बोलते हैं"
    for line in (hindi + "।", "یہ ایک بہت بڑا ملک ہے اور یہاں کے لوگ کئی زبانیں بولتے ہیں۔", "սա մի շատ մեծ երկիր է և այստեղ մարդիկ խոսում են շատ լեզուներով։"):
        assert not quality.line_fails(line)
    assert quality.line_verdict("\n".join([hindi, hindi + "।"] * 3))[1] == 0
    # A block without any mark still fails, beside prose and beside a notice that has one.
    block = " ".join(words)
    assert quality.line_verdict(f"{wrapped}\n\n{block}\n{block}")[1:3] == (2, 2 * len(block))
    assert quality.line_verdict(f"{wrapped}\n \n{block}\nAll rights reserved.")[1] == 2


def test_chat(spark, empty):
    texts = ["\\### Assistant: </turn> ok", None, "", "a<b>\\l\\\\g<turn user>\n", "\\", "<", "x" * 20000, "\\\\l"]
    rows = [(1, k, ["user", "assistant", None, "sys<>\n\\"][k % 4], t) for k, t in enumerate(texts)] + [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, None, "user", "n")]
    part = F.struct(F.lit("text").alias("kind"), "text", F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("size"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.array(part)).withColumn("formatted", F.lit("clash"))
    out = chat.formatted(frame)
    out = out.select("conv_id", chat.turns_read(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("said"))
    got = {r.conv_id: r for r in out.collect()}
    for conv in (1, 2, None):
        want = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[1], r[2]) for r in want]
        assert got[conv].said == "".join(r[2] for r in want if r[1] == "assistant")
    assert chat.formatted(frame.limit(0)).count() == 0


def test_chat_attachments(spark):
    kinds = "array<struct<kind:string,text:string,ref:string,size:bigint>>"
    rows = [(1, 0, "user", [("text", "see <this>", None, None), ("image", None, "s3://b/i.png", 1569), ("text", " and ", None, None), ("audio", None, "a.wav", 81)]), (1, 1, "assistant", [("text", "ok", None, None), ("document", None, "d.pdf", 2)]), (2, 0, "user", [])]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {kinds}")).collect()}
    assert got[1].formatted == "<turn user>\nsee \\lthis\\g<image 1> and <audio 2></turn>\n<turn assistant>\nok<document 3></turn>\n"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(1, "image", "s3://b/i.png", 3), (2, "audio", "a.wav", 3), (3, "document", "d.pdf", 600)]
    assert all(got[1].formatted[a.place :].startswith(f"<{a.kind} {a.number}>") for a in got[1].attachments) and got[1].n_tokens_attached == 606
    assert [got[1].formatted[m.start : m.start + m.length] for m in got[1].mask] == ["ok"]
    assert got[2].formatted == "<turn user>\n</turn>\n"


def brute_links(texts):
    sets = []
    for x in texts:
        w = tuple(x.lower().encode().split())
        sets.append(frozenset(w[k : k + 5] for k in range(max(1, len(w) - 4))) if w else frozenset())
    links = [[j for j, b in enumerate(sets) if j != i and (a == b or (a and b and len(a & b) >= 0.8 * len(a | b)))] for i, a in enumerate(sets)]
    group = list(range(len(sets)))
    for _ in sets:
        for i, own in enumerate(links):
            for j in own:
                group[i] = group[j] = min(group[i], group[j])
    return links, group


@pytest.mark.parametrize("small", [16, 2])
def test_jaccard_join(spark, docs, empty, small):
    near = ["".join(f"w{k}q{k * 7 % 11} " for k in range(60)) + " ".join(f"z{v}{k}" for k in range(v % 4)) for v in range(40)]
    texts = [*near, *["alone " + " ".join(f"u{v}n{k}" for k in range(30)) for v in range(5)], "", "two words", "Two Words"]
    frame = spark.createDataFrame([(i, x, "h") for i, x in enumerate(texts)], "doc_id long, text string, n string")
    links, group = brute_links(texts)
    got = {r.doc_id: r for r in jaccard_join.jaccard_links(frame, small=small).collect()}
    assert [got[i].n_links for i in range(len(texts))] == [len(x) for x in links]
    assert [got[i].class_id for i in range(len(texts))] == group
    if small == 16:
        rows = jaccard_join.jaccard_links(docs).collect()
        assert counted(r.doc_id for r in rows) == counted(i for i, _ in given())
        assert jaccard_join.jaccard_links(empty).count() == 0
        assert jaccard_join.one_of_each_group(frame).count() == len(set(group))


def test_jaccard_blocks_and_chains(spark, monkeypatch):
    # Clusters over several blocks, and chains whose ends are not similar, of many sizes, against brute force.
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    texts = [" ".join(f"c{k}" for k in range(v * 4, v * 4 + 60 + 3 * (v % 9))) for v in range(40)]
    links, group = brute_links(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_join.jaccard_links(frame, small=1).collect()}
    assert [got[i].n_links for i in range(40)] == [len(x) for x in links]
    assert [got[i].class_id for i in range(40)] == group


def test_one_row_of_each_group(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(200))
    near = text(0) + " changed"
    rows = [(1, near, "a"), (3, text(0), "b"), (3, text(1), "c"), (None, text(2), "d"), (None, text(3), "e"), (None, text(3), "e"), (None, text(0), "f"), (4, text(2), "g"), *[(9, text(k), "h") for k in range(4, 12)], (9, text(4).upper(), "i"), (5, None, "j"), (5, "", "j")]
    got = counted(map(tuple, jaccard_join.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()))
    free = [r for r in got.elements() if r[0] == 9 and r[1].lower() == text(4)]
    assert len(free) == 1
    blank = [r for r in got.elements() if not r[1]]
    assert len(blank) == 1
    assert got - counted(free) - counted(blank) == counted([rows[0], rows[2], rows[4], rows[7], *rows[9:16]])


def test_recall_against_brute_force(spark):
    """All links between different texts of the documents, against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    links, group = brute_links([r.text or "" for r in rows])
    got = {r.doc_id: r for r in jaccard_join.jaccard_links(docs).collect()}
    assert sum(got[r.doc_id].n_links for r in rows) == sum(map(len, links)) > 0
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert all(got[r.doc_id].class_id == least[g] for r, g in zip(rows, group, strict=True))


def test_band_counts_reach_the_recall():
    bands, rows = jaccard_join.band_counts(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 160


@pytest.mark.parametrize("limit", [200, 2000, 40000, 10**9])
def test_sharding(spark, docs, empty, limit):
    more = spark.createDataFrame([(1000 + k, "t" * (k % 50), "h", 1, "k", "s", "y", "z") for k in range(600)] + [(7777, "same row", "h", 1, "k", "s", "y", "z")] * 400, SCHEMA)
    rows = docs.unionByName(more)
    got = sharding.shard_rows(rows, limit).collect()
    assert counted(r.doc_id for r in got) == counted(r.doc_id for r in rows.select("doc_id").collect())
    size, n = collections.Counter(), collections.Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        n[r.shard] += 1
        assert len(r.shard) == r.depth and format(r.hash, "060b").startswith(r.shard)
    for r in got:
        assert r.shard_bytes == size[r.shard] and r.shard_rows == n[r.shard]
    for s in size:
        assert size[s] <= limit or n[s] == 1
        if s:  # only a bucket that was too large has been split
            assert sum(b for t, b in size.items() if t.startswith(s[:-1])) > limit
    assert sharding.shard_rows(empty, limit).count() == 0


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, f"file://{tmp_path}/out", 20000)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert counted((r.doc_id, r.text) for r in back.collect()) == counted((r.doc_id, r.text) for r in docs.collect())
    # Copies that differ in other columns keep these.
    rows = [(1, "same", f"s{k % 90}") for k in range(300)] + [(2, None, None)] * 3
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), f"file://{tmp_path}/copies", 500)
    back = spark.read.parquet(f"file://{tmp_path}/copies")
    assert counted((r.doc_id, r.text, r.source) for r in back.collect()) == counted(rows) and back.select("shard").distinct().count() > 5


def test_pii_on_hostile_texts():
    import time

    began = time.monotonic()
    zeros = "0" * 10_000 + ".1.2.3 and 1.1.1." + "0" * 9_000 + "7"
    assert [(k, b - a) for a, k, b in pii.base_spans(zeros)] == [(1, 10_006), (1, 9_007)]
    tagger = pii.Tagger(pii.trained_model())
    digests = " ".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(50_000))
    assert len(tagger.spans([digests])) == 1
    lines = "\n".join(f"call (988) 555-{k % 9000 + 1000} at 10.0.0.{k % 250} now" for k in range(20_000))
    base = pii.base_spans(lines)
    added = pii.added_spans(lines, base, tagger.spans([lines])[0])
    assert len(base) == 20_000 and len(added) >= 19_000
    spans = sorted(base + added)
    assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    before = len(tagger.words)
    tagger.spans(["A1" * 200_000])
    assert len(tagger.words) == before
    assert time.monotonic() - began < 60


def test_quality_on_runs_of_marks():
    import time

    began = time.monotonic()
    assert quality.line_verdict("a b c d e f g h i j k " + "#" * 100_000 + "x")[1] == 1
    assert time.monotonic() - began < 5
    for x in ("##", "a## b", "a##b ##", "#a ### ", "!?! x ** y", "a #", "##\n", "#" * 9 + "x"):
        assert quality.DOUBLED.findall(x) == re.findall(r"[!?*#$%&]{2,}(?=\s|$)", x)
