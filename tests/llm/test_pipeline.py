"""The corpus pipeline: each stage keeps what it should, over a small table with planted cases."""

import random

import corpus_pipeline


def test_pipeline(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(" ".join(rng.choices(vocabulary, k=9)) + "." for _ in range(n))

    clean = [prose(20) for _ in range(12)]
    shared = "A line that two documents hold in common."
    rows = [
        *clean, clean[0], clean[1] + " One more sentence at the end.", " ".join("ab%%% cd*** ef$$$ gh&&&" for _ in range(40)), prose(15) + "\n" + shared, prose(15) + "\n" + shared,
        prose(12) + " Write to someone.42@mail8.example.com or call +1 (988) 555-2485 today.", None, "", "too short",
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        seen[name] = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            docs = corpus_pipeline.stored(out, "test")
    ids = {name: sorted(r.doc_id for r in found) for name, found in seen.items()}
    assert ids["quality rules"] == [*range(14), 15, 16, 17] and ids["line dedup"] == ids["quality rules"]
    texts = {r.doc_id: r.text for r in seen["line dedup"]}
    assert shared in texts[15] and shared not in texts[16]
    # Document 12 repeats document 0 and has no lines left: it is the one document without words.
    assert texts[12] == "" and ids["n-gram Jaccard join"] == [*range(13), 15, 16, 17]
    text = next(r.text for r in seen["PII"] if r.doc_id == 17)
    assert "[EMAIL]" in text and "[PHONE]" in text and "example.com" not in text
    assert {r.doc_id for r in seen["best-fit packing"]} == set(ids["PII"])


def test_pipeline_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_rows_without_ids_and_other_columns(spark):
    """Null and repeated ids, rows that repeat, very long texts, and columns named as those that stages make."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]

    def prose(n):
        return " ".join(" ".join(rng.choices(vocabulary, k=9)) + "." for _ in range(n))

    one, two, three, four, huge = prose(15), prose(15), prose(16), prose(15), prose(9000)
    rows = [(None, one), (None, two), (7, three), (7, four), (7, three), (8, huge), (None, None), (9, None), (10, prose(14) + " Call +1 (988) 555-2485 now.")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, clean_text string, _dropped string, key string, spans string, _row int"
    docs = spark.createDataFrame([(i, t, "en", "s", -1, False, "c", "d", "k", "p", n) for n, (i, t) in enumerate(rows)], schema)
    given = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == given, stage
        docs = corpus_pipeline.stored(out, "test")
    got = docs.collect()
    # Rows 0 to 5 and 8 pass; row 4 repeats row 2.
    assert sorted(r._row for r in got) in ([0, 1, 2, 3, 5, 8], [0, 1, 3, 4, 5, 8])
    assert all(r.n_chars == len(r.text) and (r.kept, r.clean_text, r._dropped, r.key, r.spans) == (False, "c", "d", "k", "p") for r in got)
    texts = {r._row: r.text for r in got}
    assert texts[0] == one and texts[3] == four and texts[5] == huge and "[PHONE]" in texts[8]
    packed = corpus_pipeline.packed(spark, docs, "").collect()
    assert sum(r.doc_id is None for r in packed) == 2 and len({r.piece for r in packed if r.doc_id == 8}) > 10
