"""The calls of the interface, end to end over small tables."""

from pyspark.sql import functions as F

from graphcall import api


def test_reads_to_calls(spark):
    supports = []
    for sample, (ref, alt) in enumerate([(20, 0), (20, 20), (0, 20)]):
        for element, n in (("REF", ref), ("ALT", alt)):
            supports += [(sample, 1, f"{sample}{element}{k}", k % 2 == 0, element) for k in range(n)]
    rows = spark.createDataFrame(supports, "sample_id int, graph_id int, fragment_id string, is_reverse boolean, element string")
    counts = api.count_support(rows).groupBy("sample_id", "graph_id").pivot("element", ["REF", "ALT"]).agg(F.first("fragments")).na.fill(0)
    counts = counts.select("sample_id", "graph_id", F.lit("bp").alias("breakpoint"), F.array("REF", "ALT").alias("counts"))
    samples = spark.createDataFrame([(k, 40.0, 14.0, 100.0) for k in range(3)], "sample_id int, depth double, depth_sd double, read_length double")
    calls = api.genotype(counts, samples)
    assert {r.sample_id: r.gt for r in calls.collect()} == {0: [0, 0], 1: [0, 1], 2: [1, 1]}


def test_select_reads(spark):
    reads = spark.createDataFrame([(1, "c1", k * 100, 50, f"f{k}", True) for k in range(100)], "sample_id int, chrom string, pos long, len long, fragment_id string, is_first_mate boolean")
    regions = spark.createDataFrame([(7, "c1", 3000, 3100)], "graph_id int, chrom string, start long, stop long")
    assert {r.pos for r in api.select_reads(reads, regions).collect()} == {k * 100 for k in range(100) if k * 100 <= 4099 and k * 100 + 50 >= 2001}
    assert api.select_reads(reads, regions, most=5).count() == 5


def test_variant_graph(spark):
    variants = spark.createDataFrame([("v1", "c", 1000, 1004, ""), ("v2", "c", 1010, 1009, "ACG"), ("v3", "c", 1020, 1020, "T")], "id string, chrom string, start long, stop long, alt string")
    nodes, edges = api.variant_graphs(variants)
    assert [(r.start, r.stop) for r in nodes.where("kind = 'ref'").orderBy("start").collect()] == [(850, 999), (1000, 1004), (1005, 1009), (1010, 1019), (1020, 1020), (1021, 1170)]
    alt = {(r.a, r.b) for r in edges.where("label = 'ALT'").collect()}
    assert alt == {("ref-850-999", "ref-1005-1009"), ("ref-1005-1009", "1010-1009:ACG"), ("1010-1009:ACG", "ref-1010-1019"), ("ref-1010-1019", "1020-1020:T"), ("1020-1020:T", "ref-1021-1170")}
    assert edges.where("label = 'REF'").count() == 5
