"""Views, targets and containers."""

import zipfile

from pyspark.sql import functions as F

from sparkloom.operators import targets, views
from sparkloom.sources import containers


def test_views(spark):
    a = spark.createDataFrame([(1, "r1", "c", 0, 50, 60), (2, "r2", "c", 40, 90, 60), (3, "r3", "c", 500, 600, 60), (4, "r4", "c", 10, 20, 1)], "alignment_id long, read_id string, ref_name string, ref_start long, ref_end long, mapq int")
    b = spark.createDataFrame([(1, 1, 30, 50), (1, 0, 0, 20)], "alignment_id long, block_index int, ref_start long, ref_end long")
    s = spark.createDataFrame([("r1", 7)], "read_id string, sample_id int")
    got = {r["alignment_id"]: r for r in views.read_pileup(a, b, "c", 0, 100, min_mapq=5, samples=s).collect()}
    assert set(got) == {1, 2} and [tuple(x) for x in got[1]["blocks"]] == [(0, 20), (30, 50)] and [tuple(x) for x in got[2]["blocks"]] == [(40, 90)]
    assert (got[1]["row"], got[2]["row"], got[1]["sample_id"], got[2]["sample_id"]) == (0, 1, 7, None)
    assert views.mode(a, "ref_start", "ref_end", 0, 1000, 100) == "vector" and views.mode(a, "ref_start", "ref_end", 0, 100000, 10) == "raster"
    seq = spark.createDataFrame([(1, "ACGTACGT")], "contig_id int, sequence string")
    assert [(r["pos"], r["base"]) for r in views.reference_bases(seq, 1, 2, 5).collect()] == [(2, "G"), (3, "T"), (4, "A")]
    i = spark.createDataFrame([(1, 1, 10, 90, "+", "x", 3, True), (1, 1, 11, 90, "+", "x", 9, False), (2, 1, -5, 500, "+", "x", 1, None), (3, 1, 300, 400, "+", "x", 1, True)], "intron_id int, contig_id int, donor_pos long, acceptor_pos long, strand string, motif string, read_count long, is_intron_seed boolean")
    assert [(r["intron_id"], r["support"], r["donor_pos"]) for r in views.splice_junctions(i, 1, 0, 100).collect()] == [(1, 12, 10), (2, 1, -5)]


def test_targets(spark):
    pre = spark.createDataFrame([(1, 10, 500.0, 2), (2, 99, 600.0, 3)], "precursor_id long, peptide_id long, precursor_mz double, charge int")
    pep = spark.createDataFrame([(10, "AAK")], "peptide_id long, modified_sequence string")
    assert sorted((r["target_id"], r["modified_sequence"]) for r in targets.targets_from_library(pre, pep).collect()) == [(1, "AAK"), (2, None)]
    t = spark.createDataFrame([(1, "b", 5, 100.0, 100.01, 1.0)], "target_id int, ion string, scan int, ion_mz double, mz double, intensity double")
    p = spark.createDataFrame([(5, 100.012, 7.0), (5, 100.5, 1.0), (6, 100.01, 2.0)], "scan int, mz double, intensity double")
    assert targets.exact_errors(t, p).first()["intensity"] == 7.0
    counts = spark.createDataFrame([("P1", "MA", 5.0), ("P1", "MA", 7.0), ("P2", "MA", 9.0), ("P3", "MC", 9.0), ("P4", "MD", 0.1)], "protein_id string, sequence string, tpm double")
    ref = spark.createDataFrame([("R", "R gene", "MC")], "record string, header string, sequence string")
    novel = targets.novel_sequences(counts, ref, least_tpm=1.0)
    assert [(r["protein_id"], r["sequence"]) for r in novel.collect()] == [("P1", "MA")]
    hits = spark.createDataFrame([("P1", "R", 1e-9, "reference")], "query string, target string, evalue double, aligned_to string")
    both = targets.combined_sequences(ref, novel, hits, spark.createDataFrame([("R", "G1")], "protein_id string, gene string"))
    assert {r["header"] for r in both.collect()} == {"R gene", "P1 GN=G1"}
    n, e = targets.library_network(spark.createDataFrame([(1, 10), (1, 10)], "protein_id long, peptide_id long"), pre, tier="precursor")
    assert e.count() == 3 and n.count() == 5


def test_containers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "1")
        z.writestr("two.txt", "22")
    assert {(r["name"], bytes(r["content"])) for r in containers.members(spark, str(tmp_path / "a.zip")).collect()} == {("x/one.txt", b"1"), ("two.txt", b"22")}
    df = spark.createDataFrame([(1, [1.0, 2.0], [5.0, 6.0])], "k int, mz array<double>, i array<double>")
    rows = containers.arrays_to_rows(df.withColumnRenamed("i", "v"), "k", "mz", "v")
    assert rows.count() == 2 and containers.rows_to_arrays(rows, "k", "i", "mz", "v").first()["v"] == [5.0, 6.0]
    t = spark.createDataFrame([(2.0, 5.0, "a"), (1.0, 4.0, "a"), (1.0, 9.0, "b")], "time_s double, intensity double, channel_id string")
    assert containers.channel_trace(t, "a").first()["intensity"] == [4.0, 5.0]
    assert containers.check_lengths(df, "mz", 2).select(F.size("mz")).first()[0] == 2
