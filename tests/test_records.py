"""Variant files to annotated files, from text to text, and the depth of contigs."""

import random

from pyspark.sql import functions as F

from graphcall import api
from graphcall.operators import msa, records, vcf
from graphcall.sources import files


def test_files_to_an_annotated_file(spark, tmp_path):
    rng = random.Random(12)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    contig = dna(6000)
    (tmp_path / "ref.fa").write_text(">chr1 test\n" + "\n".join(contig[k : k + 70] for k in range(0, 6000, 70)) + "\n")
    ins = dna(60)
    at = {"del": (1000, contig[999:1060], contig[999]), "ins": (2000, contig[1999], contig[1999] + ins), "swap": (3000, contig[2999:3030], contig[2999] + ins[:25]), "gone": (4000, contig[3999], "<DEL>"), "two": (5000, contig[4999:5040], f"{contig[4999]},{contig[4999]}{ins[:30]}")}
    truth = {"s1": {"del": (1, 1), "ins": (0, 1), "swap": (0, 0), "gone": (0, 1), "two": (1, 2)}, "s2": {"del": (0, 1), "ins": (1, 1), "swap": (1, 1), "gone": (0, 0), "two": (0, 2)}}
    end = {"gone": 4900}
    lines = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">', '##INFO=<ID=END,Number=1,Type=Integer,Description="x">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"]
    lines += [f"chr1\t{p}\t{n}\t{r}\t{a}\t.\tPASS\t{'END=4900' if n in end else '.'}\tDP:GT\t9:0/0\t9:./." for n, (p, r, a) in at.items()]
    (tmp_path / "in.vcf").write_text("\n".join(lines) + "\n")

    sam, n = {"s1": [], "s2": []}, 0
    for s, calls in truth.items():
        for copy in range(2):
            whole, last = "", 0
            for name, (p, r, a) in at.items():
                stop = end.get(name, p + len(r) - 1)
                k = calls[name][copy]
                whole += contig[last:p] + ("" if a == "<DEL>" and k else contig[p:stop] if not k else a.split(",")[k - 1][1:])
                last = stop
            whole += contig[last:]
            for start in range(0, len(whole) - 100, 5):  # twenty reads over each place of each copy
                seq = whole[start : start + 100]
                back = rng.random() < 0.5
                place = min(start, 5900) if copy else start
                sam[s].append((f"f{n}", place, seq, back))
                n += 1
    # Reads are placed by where their first bases lie on the reference.
    index = {}
    for k in range(len(contig) - 24):
        index.setdefault(contig[k : k + 25], k)
    for s, rows in sam.items():
        out = ["@HD\tVN:1.6"]
        for name, _, seq, back in rows:
            pos = next((index[seq[k : k + 25]] - k for k in range(0, 76, 5) if seq[k : k + 25] in index), 0)
            out.append("\t".join([name, "16" if back else "0", "chr1", str(max(pos, 0) + 1), "60", "100M", "*", "0", "0", seq, "I" * 100]))
        (tmp_path / f"{s}.sam").write_text("\n".join(out) + "\n")
    (tmp_path / "manifest.txt").write_text("id\tpath\tdepth\tread length\n" + "".join(f"{s}\t{tmp_path}/{s}.sam\t40\t100\n" for s in sam))

    manifest = files.read_manifest(spark, f"{tmp_path}/manifest.txt")
    reads = None
    for r in manifest.collect():
        own = files.read_sam(spark, r.path).withColumn("sample_id", F.lit(r.id))
        reads = own if reads is None else reads.unionByName(own)
    reads = reads.select("sample_id", "fragment_id", "chrom", "pos", F.char_length("bases").cast("long").alias("len"), "mate_chrom", "mate_pos", "is_first_mate", F.col("bases").alias("seq"))
    given, names = files.read_vcf_header(spark, f"{tmp_path}/in.vcf")
    rows = files.read_vcf(spark, f"{tmp_path}/in.vcf").withColumn("graph_id", F.col("id")).withColumn("old_gt", files.old_genotypes(names))
    chunks = files.chunked(files.read_fasta(spark, f"{tmp_path}/ref.fa"), 512)
    variants = rows.select("graph_id", "chrom", "pos", "end", "ref", "alts", F.element_at("info", F.lit("SEQ")).alias("inserted"))
    samples = manifest.select(F.col("id").alias("sample_id"), "depth", "depth_sd", "read_length")
    calls = api.genotype_records(variants, reads, samples, chunks, names, chunk_size=512)
    got = {(r.graph_id, r.sample_id): r for r in calls.collect()}
    name = ["REF", "ALT1", "ALT2"]
    for s, wanted in truth.items():
        for v, gt in wanted.items():
            assert sorted(got[v, s].gt) == sorted(name[k] for k in gt), (v, s)
    out = api.genotype_vcf(rows, calls, names)
    vcf.write_vcf(out, f"file://{tmp_path}/out", given, names)
    text = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert text[0] == "##fileformat=VCFv4.2" and any(x.startswith("##FORMAT=<ID=OLD_GT,") for x in text)
    body = {x.split("\t")[2]: x.split("\t") for x in text if not x.startswith("#")}
    assert list(body) == list(at)
    for v in at:
        for k, s in enumerate(("s1", "s2")):
            cell = body[v][9 + k].split(":")
            assert cell[0] == "/".join(map(str, sorted(truth[s][v]))) and cell[1] == ("0/0", "./.")[k] and len(cell[4].split(",")) == len(at[v][2].split(",")) + 1
    assert body["gone"][7] == "END=4900;GRAPH_ID=gone" and body["del"][7] == "GRAPH_ID=del"


def test_record_graphs(spark):
    contig = "".join(random.Random(2).choices("ACGT", k=400))
    chunks = files.chunked(spark.createDataFrame([("c", contig)], "contig string, seq string"), 64)
    rows = [("snp", 100, 100, contig[99], ["T" if contig[99] != "T" else "G"], None), ("dup", 100, 110, contig[99], ["<DUP>", "<INV>"], None), ("ins", 100, 100, contig[99], ["<INS>"], "GATTACA"), ("long", 100, 200, contig[99], ["<DEL>"], None), ("multi", 100, 102, contig[99:102], [contig[99], contig[99:101] + "GG"], None)]
    frame = spark.createDataFrame([(n, "c", p, e, r, a, i) for n, p, e, r, a, i in rows], "graph_id string, chrom string, pos long, end long, ref string, alts array<string>, inserted string")
    got = {r.graph_id: r for r in records.record_graphs(frame, chunks, 64, flank=20).collect()}
    seqs = {g: {n.name: n.seq for n in r.nodes} for g, r in got.items()}
    mid, comp = contig[100:110], str.maketrans("ACGT", "TGCA")
    assert seqs["snp"] == {"LF": contig[79:99], "REF": contig[99], "ALT1": rows[0][4][0], "RF": contig[100:120]}
    assert seqs["dup"] == {"LF": contig[80:100], "REF": mid, "ALT1": mid * 2, "ALT2": mid[::-1].translate(comp), "RF": contig[110:130]}
    assert seqs["ins"] == {"LF": contig[80:100], "ALT1": "GATTACA", "RF": contig[100:120]}
    assert seqs["long"] == {"LF": contig[80:100], "REF_L": contig[100:120], "REF_R": contig[180:200], "RF": contig[200:220]}
    assert seqs["multi"]["REF"] == contig[100:102] and seqs["multi"]["ALT2"] == contig[100] + "GG" and "ALT1" not in seqs["multi"]
    edges = {g: {e.name: e.labels for e in r.edges} for g, r in got.items()}
    assert edges["long"] == {"LF_REF_L": ["REF"], "REF_R_RF": ["REF"], "LF_RF": ["ALT1"]} and edges["ins"]["LF_RF"] == ["REF"] and edges["multi"]["LF_RF"] == ["ALT1"]
    points = {(r.graph_id, r.breakpoint, r.allele): (r.canonical, r.edges) for r in records.breakpoints(records.record_graphs(frame, chunks, 64, flank=20)).collect()}
    assert points["multi", "LF_", "ALT2"] == ("ALT2", ["LF_ALT2"]) and points["long", "_RF", "REF"] == ("REF", ["REF_R_RF"]) and ("ins", "ALT1_", "ALT1") not in points


def test_sampled_depth(spark):
    rng = random.Random(4)
    reads = [("even", p, 50) for p in range(0, 40000, 5)] + [("rough", rng.randint(0, 39000), rng.choice([40, 60])) for _ in range(4000)] + [("short", 10, 30)]
    frame = spark.createDataFrame(reads, "contig string, pos long, len long")
    contigs = spark.createDataFrame([("even", 40000), ("rough", 40000), ("short", 100), ("none", 500)], "contig string, length long")
    got = {r.contig: r for r in api.estimate_depth(frame, contigs, stretch=300, longest=2000).collect()}
    assert (got["even"].depth_median, got["even"].read_length, got["even"].read_length_unique, got["even"].converged) == (10, 50, True, True) and got["even"].rounds == 2
    assert 3 <= got["rough"].depth_median <= 6 and not got["rough"].read_length_unique
    assert (got["short"].rounds, got["short"].converged, got["short"].read_count) == (1, True, 1) and got["short"].depth_median == 0
    # All places of all pieces: a whole look equals counting.
    got = {r.contig: r for r in api.estimate_depth(frame, contigs, stretch=2000, longest=2000).collect()}
    assert got["even"].read_count == 8000 + 31 * 9 and got["none"].read_count == 0
    depth = [0] * 40000
    for c, p, n in reads:
        if c == "rough":
            for k in range(p, min(p + n, 40000)):
                depth[k] += 1
    assert abs(got["rough"].depth_median - sorted(depth)[20000]) <= 1


def test_alignment_to_records(spark, tmp_path):
    rows = [("ref", 0, "AC-GTACGTA"), ("a", 1, "ACTGTACGTA"), ("b", 2, "A--GTTCGTA"), ("c", 3, "-C-GTACGTA"), ("d", 4, "ACTGTTCGTA"), ("e", 5, "AC-GT--GTA"), ("f", 6, "GC-GTACGTA")]
    found = msa.sites(spark.createDataFrame([(1, *r) for r in rows], "g int, name string, number int, seq string"), ["g"])
    got = sorted((r.start, r.ref, r.alts, r.calls) for r in found.collect())
    assert got == [(0, "A", ["G"], {"f": 1}), (0, "AC", ["A"], {"b": 1}), (0, "AC", ["C"], {"c": 1}), (1, "C", ["CT"], {"a": 1, "d": 1}), (3, "TAC", ["T"], {"e": 1}), (4, "A", ["T"], {"b": 1, "d": 1})]
    vcf.write_vcf(msa.site_records(found, ["a", "b", "d"], chrom="chr", start=100), f"file://{tmp_path}/msa", [], ["a", "b", "d"])
    text = [x for p in sorted((tmp_path / "msa").glob("part-*")) for x in p.read_text().splitlines()]
    body = [x.split("\t") for x in text if not x.startswith("#")]
    assert [(x[1], x[3], x[4], x[9:]) for x in body if x[1] == "101"] == [("101", "C", "CT", ["1", ".", "1"])] and len(body) == 6
    # Sites applied to the reference give each sequence back.
    for name, _, seq in rows[1:]:
        ref = rows[0][2].replace("-", "")
        for start, r, alts, calls in reversed(got):
            if name in calls:
                assert ref[start : start + len(r)] == r
                ref = ref[:start] + alts[calls[name] - 1] + ref[start + len(r) :]
        assert ref == seq.replace("-", "")
