"""Streams, documents, checks of graphs, and entry points."""

import json

import pytest
from pyspark.sql import functions as F

from graphcall import api
from graphcall.functions import cigar
from graphcall.operators import genotyping, graphs, intervals, matching, vcf
from graphcall.sources import files
from graphcall.streaming import support


def streamed(spark, rows, path, made, mode, name):
    """What a query over rows that arrive in three files ends with."""
    rows.repartition(3).write.parquet(f"file://{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}/in")
    query = made(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_distinct_fragments_as_a_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts", "value")
    twice = rows.unionByName(rows.where("event_id % 3 = 0"))
    got = streamed(spark, twice, tmp_path, lambda d: support.distinct_fragments(d, late="3650 days"), "append", "fragments_seen")
    assert got.count() == rows.count() and got.select("event_id").distinct().count() == rows.count()


def test_sessions_as_a_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts")
    want = {}
    by = {}
    for r in rows.collect():
        by.setdefault(r.user_id, []).append(r.ts)
    for user, times in by.items():
        times.sort()
        groups = [[times[0]]]
        for t in times[1:]:
            if (t - groups[-1][-1]).total_seconds() >= 1800:
                groups.append([])
            groups[-1].append(t)
        want |= {(user, g[0]): len(g) for g in groups}
    plain = {(r.user_id, r.session_start): r.n for r in support.sessions(rows).collect()}
    assert plain == want
    got = streamed(spark, rows, tmp_path, lambda d: support.sessions(d, late="3650 days"), "complete", "sessions_seen")
    assert {(r.user_id, r.session_start): r.n for r in got.collect()} == want


def test_documents_have_five_digits(spark, tmp_path):
    rows = [(123456.789, [0.000123456789, 2.0], {"a": -98765.4321}, (1 / 3, "x"), 7, None), (0.0, [], {}, None, 1, 1e-9)]
    frame = spark.createDataFrame(rows, "a double, b array<double>, c map<string,double>, d struct<e:double,f:string>, g long, h double")
    got = [json.loads(r.value) for r in files.documents(frame).collect()]
    assert got[0] == {"a": 123460.0, "b": [0.00012346, 2.0], "c": {"a": -98765.0}, "d": {"e": 0.33333, "f": "x"}, "g": 7}
    assert got[1]["a"] == 0 and got[1]["h"] == pytest.approx(1e-9)
    files.write_documents(frame, f"file://{tmp_path}/docs")
    assert spark.read.text(f"file://{tmp_path}/docs").count() == 2
    for odd in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="is no number"):
            files.documents(spark.createDataFrame([(odd,)], "a double")).collect()


def test_graph_documents_are_checked(spark, tmp_path):
    good = {"ID": "g", "target_regions": ["c:1-9"], "max_reads": 5, "sequencenames": ["REF", "ALT"], "nodes": [{"name": "a", "reference": "c:1-4"}, {"name": "b", "sequence": "ACGTA"}], "edges": [{"from": "a", "to": "b"}]}
    cases = {
        "good": good, "twice": good | {"nodes": [*good["nodes"], {"name": "a", "sequence": "A"}]}, "bare": good | {"nodes": [*good["nodes"], {"name": "c"}]},
        "lost": good | {"edges": [{"from": "a", "to": "z"}]}, "self": good | {"edges": [{"from": "a", "to": "a"}]}, "nowhere": {k: v for k, v in good.items() if k != "target_regions"},
    }
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(text))
        found = files.read_graphs(spark, f"{tmp_path}/{name}.json")
        if name == "good":
            row = files.checked_graphs(found).first()
            assert row.longest_alt_insertion == 5 and row.max_reads == 5
        else:
            with pytest.raises(Exception, match=r"twice|neither|nowhere|no target"):
                files.checked_graphs(found).collect()
    row = files.checked_graphs(files.read_graphs(spark, f"{tmp_path}/nowhere.json"), regions=["d:5-6"], most=99).first()
    assert row.target_regions == ["d:5-6"] and row.max_reads == 99
    by_id, by_name = files.by_id_and_sequence(files.read_graphs(spark, f"{tmp_path}/good.json"))
    assert [tuple(r) for r in by_id.collect()] == [("g", "g")] and sorted(r.key for r in by_name.collect()) == ["ALT", "REF"]


def test_united_graphs(spark):
    nodes = lambda *n: spark.createDataFrame([(1, x) for x in n], "g int, node string")
    edges = lambda *e: spark.createDataFrame([(1, *x) for x in e], "g int, a string, b string, labels array<string>")
    got = graphs.united({"nodes": nodes("a", "b"), "edges": edges(("a", "b", ["x"]))}, {"nodes": nodes("b", "c"), "edges": edges(("a", "b", ["y", "x"]), ("b", "c", [])), "paths": nodes("p")})
    assert sorted(r.node for r in got["nodes"].collect()) == ["a", "b", "c"] and got["paths"].count() == 1
    assert {(r.a, r.b): r.labels for r in got["edges"].collect()} == {("a", "b"): ["x", "y"], ("b", "c"): []}


def test_mates_are_looked_up(spark):
    kinds = "s int, fragment_id string, is_first_mate boolean, chrom string, pos long, len long, mate_chrom string, mate_pos long"
    rows = [(1, "f1", True, "a", 100, 50, "b", 700), (1, "f1", False, "b", 700, 50, "a", 100), (1, "f2", True, "a", 200, 50, "a", 900), (1, "f2", False, "a", 900, 50, "a", 200), (1, "f3", True, "a", 300, 50, "a", 5300), (1, "f3", False, "a", 5300, 50, "a", 300)]
    reads = spark.createDataFrame(rows, kinds)
    chosen = reads.where("is_first_mate").withColumn("longest", F.lit(30))
    found = lambda **o: sorted((r.fragment_id, r.pos) for r in matching.recovered_mates(reads, chosen, ["s"], **o).collect())
    assert found() == found(longest="longest") == [("f1", 700), ("f3", 5300)] and found(most=3) == []
    short = chosen.withColumn("longest", F.lit(20))
    assert matching.recovered_mates(reads, short, ["s"], longest="longest").count() == 0


def test_record_blocks(spark):
    rows = [("c1", 10, 20, 1, "a"), ("c1", 22, 22, 2, "a"), ("c1", 40, 30, 3, None), ("c1", 41, 50, 4, None), ("c2", 45, 60, 5, "b"), ("c2", 60, 61, 6, "a")]
    frame = spark.createDataFrame(rows, "chrom string, start long, stop long, id int, name string")
    got = {m: [r.block for r in intervals.split_records(frame, m, gap=5).orderBy("id").collect()] for m in ("full", "lines", "by_id", "superloci")}
    assert got == {"full": [0] * 6, "lines": [1, 2, 3, 4, 5, 6], "by_id": [1, 1, 2, 3, 4, 5], "superloci": [1, 1, 2, 2, 3, 3]}
    with pytest.raises(ValueError, match="mode"):
        intervals.split_records(frame, "other")


def test_entry_points(spark):
    graph = spark.createDataFrame([("g", [(0, "ACG"), (1, "T"), (2, "GGA")])], "graph_id string, nodes array<struct<id:long,seq:string>>")
    paths = spark.createDataFrame([("g", "REF", [0, 1, 2]), ("g", "DEL", [0, 2])], "graph_id string, path string, nodes array<long>")
    assert sorted(r.text for r in api.path_fasta(paths, graph).collect()) == [">DEL 0[3M]2[3M]\nACGGGA", ">REF 0[3M]1[1M]2[3M]\nACGTGGA"]
    slices = spark.createDataFrame([(1, 0, 100, 50), (1, 100, 100, 30), (1, 150, 0, 9)], "contig int, start long, span long, bytes long")
    got = {(r.contig, r.bin): (r.bytes, r.slices) for r in api.index_bins(slices, 150).collect()}
    assert got == {(1, 0): (65.0, 2), (1, 1): (15.0, 1)}
    variants = spark.createDataFrame([("v1", "c", 1000, 1004, "", ["h1"], ["h2"]), ("v2", "c", 1010, 1009, "ACG", ["h2"], [])], "id string, chrom string, start long, stop long, alt string, haplotypes array<string>, ref_haplotypes array<string>")
    nodes, edges = api.variant_graphs(variants, mode="haplotypes")
    assert {r.node for r in nodes.collect()} >= {"alt-1000-1004:", "alt-1010-1009:ACG", "ref-1000-1004"} and edges.where("array_contains(labels, 'h2')").count() > 0
    assert api.variant_graphs(variants, mode="alleles")[1].count() >= edges.count()
    with pytest.raises(ValueError, match="mode"):
        api.variant_graphs(variants, mode="other")


def test_alignment_strings_of_placements(spark):
    rows = [("ACGT", "ACGT", "4M"), ("ACGT", "NCGA", "1S2M1X"), ("ANGT", "ACGN", "1M1N1M1S"), ("AC", "NN", "2S"), ("", "", "")]
    frame = spark.createDataFrame(rows, "read string, ref string, want string")
    got = frame.withColumn("got", cigar.of_placement(F.col("read"), F.col("ref")))
    assert all(r.got == r.want for r in got.collect())
    codes = got.where("got <> ''").select("got", cigar.encoded(cigar.operations(F.col("got"))).alias("c")).withColumn("back", cigar.decoded(F.col("c")))
    assert all(r.got == r.back for r in codes.collect()) and {r.got: r.c for r in codes.collect()}["1S2M1X"] == [20, 32, 24]


def test_records_find_their_graphs(spark):
    rows = [("r1", {"GRAPH_ID": "g1"}, "n2"), ("r2", {"GRAPH_ID": "none"}, "n2"), ("r3", {}, "n1"), ("r4", {}, "n9"), ("r5", {}, None)]
    by_id = spark.createDataFrame([("g1", "g1"), ("g2", "g2")], "key string, target string")
    by_name = spark.createDataFrame([("n1", "g1"), ("n1", "g2"), ("n2", "g2")], "key string, target string")
    found = vcf.matched(spark.createDataFrame(rows, "record string, info map<string,string>, id string"), by_id, by_name)
    got = {r.record: (r.matches, r.target, r.targets) for r in found.collect()}
    assert got == {"r1": (1, "g1", ["g1"]), "r2": (1, "g2", ["g2"]), "r3": (2, None, ["g1", "g2"]), "r4": (0, None, []), "r5": (0, None, [])}


def test_poisson_depth(spark):
    rows = spark.createDataFrame([(k, [n, 0], 40.0, 1000.0, 100.0, 2) for k, n in enumerate((34, 60, 12))], "k int, counts array<long>, depth double, depth_sd double, read_length double, ploidy int")
    strict = {r.k: r.filters for r in genotyping.called(rows, poisson=True).collect()}
    assert "BP_DEPTH" not in strict[0] and "BP_DEPTH" in strict[1] and "BP_DEPTH" in strict[2]
    assert not any("BP_DEPTH" in r.filters for r in genotyping.called(rows).collect())
