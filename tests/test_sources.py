"""Manifests with files of depths, event numbers, writers."""

import json

import pytest
from pyspark.sql import functions as F

from graphcall.sources import files


def test_manifest_with_depth_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text(json.dumps({"read_length": 150, "autosome": {"depth": 31.5}, "contigs": []}))
    (tmp_path / "b.json").write_text(json.dumps({"read_length": 100, "depth": 20, "depth_variance": 16}))
    head = "id\tpath\told depths\tdepth\tread length\tsex\n"
    (tmp_path / "m.txt").write_text(head + f"A\ta.bam\tsub/a.json\t\t\tmale\nB\tb.bam\t{tmp_path}/b.json\t\t\tF\nC\tc.bam\t\t40\t125\t\n")
    names = {"old_depths": "depth_path"}
    got = {r.id: r for r in files.read_manifest(spark, f"{tmp_path}/m.txt", names=names).collect()}
    assert [(got[k].depth, got[k].read_length, got[k].sex) for k in "ABC"] == [(31.5, 150, "m"), (20.0, 100, "f"), (40.0, 125, "u")]
    assert got["B"].depth_sd == 4 and got["C"].depth_sd == pytest.approx(200**0.5)
    for line in ("A\ta.bam\tsub/a.json\t9\t\tm\n", "A\ta.bam\tsub/none.json\t\t\tm\n"):
        (tmp_path / "bad.txt").write_text(head + line)
        with pytest.raises(Exception):  # noqa: B017
            files.read_manifest(spark, f"{tmp_path}/bad.txt", names=names).collect()
    with pytest.raises(ValueError, match="unknown columns"):
        files.read_manifest(spark, f"{tmp_path}/m.txt")


def test_events_are_numbered_over_the_whole_list(spark):
    rows = [(None if k % 5 else f"own{k}", None, f"c{k % 3}", k * 7 % 50, k, None, None) for k in range(40)]
    events = spark.createDataFrame(rows, files.EVENTS.replace("desc STRING", "desc STRING")).repartition(4)
    order = sorted(rows, key=lambda r: (r[2], r[3], r[4]))
    got = {(r.chrom, r.start, r.end): r.ID for r in files.event_ids(events, "list").collect()}
    assert got == {(r[2], r[3], r[4]): r[0] or f"list:{k}" for k, r in enumerate(order)}


def test_a_graph_has_one_file(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 4).alias("graph_id"), F.col("id").alias("v")).repartition(5)
    files.write_by_graph(rows, f"file://{tmp_path}/out")
    assert sorted(len(list(p.glob("*.json.gz"))) for p in (tmp_path / "out").glob("graph_id=*")) == [1, 1, 1, 1]
    assert spark.read.json(f"file://{tmp_path}/out").count() == 40
