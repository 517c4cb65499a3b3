"""Annotated records, documents, paths that cover edges, and running values over slices."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphcall.operators import genotyping, graphs, intervals, ordered, robust, vcf


def test_genotypes_of_any_ploidy(spark):
    got = spark.range(1).select(*[genotyping.genotypes_of(F.lit(3), p).alias(f"p{p}") for p in (1, 2, 3)]).first()
    assert got.p1 == [[0], [1], [2]] and got.p2 == [[0, 0], [0, 1], [1, 1], [0, 2], [1, 2], [2, 2]]
    assert got.p3 == [[0, 0, 0], [0, 0, 1], [0, 1, 1], [1, 1, 1], [0, 0, 2], [0, 1, 2], [1, 1, 2], [0, 2, 2], [1, 2, 2], [2, 2, 2]]


def test_annotated_file(spark, tmp_path):
    kinds = "record string, sample string, n_alts int, allele_map map<string,int>, gt array<string>, filters array<string>, num_reads long, alleles map<string,struct<fwd:bigint,rev:bigint>>, gl map<string,double>"
    names = {"REF": 0, "A1": 1}
    deep = {"REF": (3, 2), "A1": (1, 4)}
    calls = [
        ("v1", "s1", 1, names, ["A1", "REF"], [], 10, deep, {"REF/REF": -20.0, "REF/A1": -2.04, "A1/A1": -1e9}), ("v1", "s2", 1, names, None, ["BP_NO_GT"], None, {}, {}),
        ("v2", "s1", 1, names, ["REF", "A9"], ["GQ"], 4, deep, {}), ("v2", "s2", 1, names, ["A1", "A1"], ["BP_DEPTH", "GQ"], 4, deep, {"REF/REF": -9.0, "REF/A1": -3.0, "A1/A1": -1.0}),
    ]
    fields = vcf.sample_fields(spark.createDataFrame(calls, kinds))
    got = {(r.record, r.sample): (r.GT, r.FT, r.DP, r.AD, r.ADF, r.ADR, r.PL) for r in fields.collect()}
    assert got["v1", "s1"] == ("0/1", "", "10", "5,5", "3,1", "2,4", "180,0,32748")
    assert got["v1", "s2"] == (".", "BP_NO_GT,UNMATCHED", "0", "0,0", "0,0", "0,0", ".")
    assert got["v2", "s1"][:2] == (".", "GQ,UNMATCHED") and got["v2", "s2"][0] == "1/1" and got["v2", "s2"][6] == "80,20,0"
    records = [(f"v{k}", "c1", 100 - k, f"v{k}", "A", ["T"], None, f, "END=5;GRAPH_ID=old;GRAPH_IDS=x" if k == 1 else ".", {"s1": "0/0"}) for k, f in ((1, "PASS"), (2, "LOW"), (3, "."), (4, "."))]
    records = spark.createDataFrame(records, "record string, chrom string, pos long, id string, ref string, alts array<string>, qual string, filter string, info_text string, old_gt map<string,string>")
    found = spark.createDataFrame([("v1", 1, "g1", ["g1"]), ("v2", 1, "g2", ["g2"]), ("v3", 2, None, ["g4", "g3"])], "record string, matches long, target string, targets array<string>")
    vcf.write_vcf(vcf.annotated(records, found, fields, ["s1", "s2"]), f"file://{tmp_path}/out", ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Own">'], ["s1", "s2"])
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[0] == "##fileformat=VCFv4.2" and sum(x.startswith("##FORMAT=<ID=GT,") for x in lines) == 1 and sum(x.startswith("##FILTER") for x in lines) == 8
    body = [x.split("\t") for x in lines if not x.startswith("##")]
    assert body[0][9:] == ["s1", "s2"] and [x[1] for x in body[1:]] == ["96", "97", "98", "99"]
    rows = {x[2]: x for x in body[1:]}
    assert rows["v1"][6:8] == ["PASS", "END=5;GRAPH_IDS=x;GRAPH_ID=g1"] and rows["v1"][9] == "0/1:0/0::10:5,5:3,1:2,4:180,0,32748"
    assert rows["v2"][6] == "LOW" and rows["v3"][6:8] == ["MULTIMATCHED", "GRAPH_ID=MULTIPLE:g3,g4"] and rows["v4"][6:8] == ["UNMATCHED", "GRAPH_ID=UNMATCHED"]
    assert rows["v4"][9:] == [".:0/0:.:.:.,.:.,.:.,.:.", ".:.:.:.:.,.:.,.:.,.:."]


def test_flaws_headers_and_haplotypes(spark):
    rows = [("A", "<INS>", 500, 500, None), ("A", "<INS>", 500, 500, "AQ"), ("A", "<DEL>", 500, 500, None), ("A", "<DEL>", 500, 510, None), ("AC", "T", 500, 501, None), ("A", "R", 500, 500, None), ("A", "T", 90, 90, None), ("A", "T", 500, 500, None)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, ref string, alt string, pos long, end long, ins string")
    got = [r.f for r in frame.orderBy("k").select(vcf.flaw(F.col("ref"), F.col("alt"), F.col("pos"), F.col("end"), F.col("ins"), 100).alias("f")).collect()]
    assert got == ["no insertion", "insertion letters", "no end", None, "padding base", "allele letters", "start", None]
    own = spark.createDataFrame([("c1", 10), ("c2", 20)], "contig string, length long")
    assert vcf.header_contigs(own, own).count() == 2
    for bad in (own.where("contig = 'c1'"), own.withColumn("length", F.col("length") + 1)):
        with pytest.raises(Exception, match="contig"):
            vcf.header_contigs(own, bad).collect()
    part = lambda rows: spark.createDataFrame(rows, "g int, haplotypes array<string>")
    got = vcf.haplotypes(part([(1, ["a", None]), (2, ["b"])]), part([(1, ["a", "r"])]), ["g"]).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (1, "r"), (2, "b")]


def test_documents(spark):
    points = [(g, s, f"bp{k}", "REF/ALT", {"REF/ALT": -1.0}, 30, ["GQ"] * k, 9, {"LF_RF": 4}, {"REF": 4}) for g in ("g1", "g2") for s in ("s2", "s1")[: 1 + (g == "g1")] for k in (1, 0)]
    points = spark.createDataFrame(points, "graph_id string, sample string, breakpoint string, gt string, gl map<string,double>, gq int, filters array<string>, num_reads long, edges map<string,int>, alleles map<string,int>")
    combined = points.groupBy("graph_id", "sample").agg(F.first("gt").alias("gt"), F.min("gq").alias("gq"), F.array().cast("array<string>").alias("filters"), F.sum("num_reads").alias("num_reads"))
    population = spark.createDataFrame([("g1", 0.5), ("g2", 0.5)], "graph_id string, call_rate double")
    got = {r.graph_id: json.loads(r.document) for r in vcf.genotype_documents(points, combined, population).collect()}
    assert list(got["g1"]["samples"]) == ["s1", "s2"] and list(got["g1"]["samples"]["s1"]["breakpoints"]) == ["bp0", "bp1"]
    assert got["g1"]["population"] == {"call_rate": 0.5} and "population" not in got["g2"]
    assert got["g1"]["samples"]["s1"]["breakpoints"]["bp1"]["counts"]["edges"] == {"LF_RF": 4} and got["g1"]["samples"]["s1"]["gt"]["num_reads"] == 18


def test_covering_paths(spark):
    rng = random.Random(4)
    for n in (4, 9):
        edges = sorted({(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5 or b == a + 1})
        rows = graphs.covering_paths(spark.createDataFrame([(1, a, b) for a, b in edges], "g int, a long, b long"), ["g"]).collect()
        steps = [s for r in rows for s in zip(r.path, r.path[1:], strict=False)]
        assert set(steps) == set(edges) and len(rows) <= len(edges)
    labelled = spark.createDataFrame([(1, 0, 1, ["REF"]), (1, 1, 3, ["REF"]), (1, 0, 2, ["ALT"]), (1, 2, 3, ["ALT"])], "g int, a long, b long, labels array<string>")
    assert [r.path for r in graphs.covering_paths(labelled, ["g"], "ALT").collect()] == [[0, 2, 3]]


def test_running_values_over_slices(spark):
    # Small slices would be put together again, and nothing carried.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check_running_values(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _check_running_values(spark):
    rng = random.Random(9)
    rows = [(k, None if k % 17 == 0 else "big" if k % 10 else f"c{k % 3}", rng.randint(0, 3000), 0, rng.choice(["x", "y", None])) for k in range(3000)]
    rows = spark.createDataFrame([(k, c, a, a + rng.randint(0, 4), v) for k, c, a, _, v in rows], "id int, chrom string, start int, stop int, kind string")
    order = Window.partitionBy("chrom").orderBy("start", "stop", "id")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    plain = rows.withColumn("f", (before.isNull() | (F.col("start") > before + 2)).cast("int")).withColumn("island", F.sum("f").over(order)).drop("f")
    got = intervals.islands(rows, ["chrom"], slack=2)
    assert got.select(*plain.columns).exceptAll(plain).count() == 0 and got.count() == 3000
    by = Window.partitionBy("chrom").orderBy("start", "id")
    fresh = F.when(F.row_number().over(by) == 1, 1).otherwise((~F.col("kind").eqNullSafe(F.lag("kind").over(by))).cast("int"))
    plain = rows.withColumn("f", fresh).withColumn("run", F.sum("f").over(by)).drop("f")
    assert intervals.runs(rows, ["chrom"], ["start", "id"], "kind").select(*plain.columns).exceptAll(plain).count() == 0
    plain = rows.withColumns({"a": F.lead("stop").over(by), "b": F.sum("stop").over(by)})
    cut = ordered.running(ordered.sliced(rows, ["chrom"], ["start", "id"]), ["chrom"], ["start", "id"], leads={"a": F.col("stop")}, sums={"b": F.col("stop")})
    assert cut.select("_slice").distinct().count() > 1
    assert cut.select(*plain.columns).exceptAll(plain).count() == 0
    want = {r.chrom: r.m for r in rows.groupBy("chrom").agg(F.median("start").alias("m")).collect()}
    assert {r.chrom: r["median"] for r in robust.medians(rows.where("chrom IS NOT NULL"), ["chrom"], "start").collect()} == {k: v for k, v in want.items() if k is not None}
