"""Readers, writers, bundles and streams on small files."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.sources import readers, sinks, sqlite
from sparkloom.streaming import ingest


def write(path, text):
    path.write_text(text)
    return str(path)


def test_schemas(spark):
    df = spark.createDataFrame([(1, "c", 5, "x")], "contig_id int, name string, length int, extra string")
    assert schemas.conform(df, "contigs").dtypes == [("contig_id", "bigint"), ("name", "string"), ("length", "bigint")]
    with pytest.raises(ValueError):
        schemas.conform(df.drop("name"), "contigs")
    with pytest.raises(ValueError):
        schemas.register_schema("contigs", "a INT")
    assert schemas.conform(df.withColumn("start", F.lit(1)).withColumn("end", F.lit(2)).withColumn("sample_id", F.lit(1)).withColumn("depth", F.lit(3)), "coverage").columns[0] == "contig_id"
    assert schemas.metadata_of(schemas.with_metadata(df, "name", {"unit": "s"}), "name") == {"unit": "s"}


def test_fasta_gff_bed(spark, tmp_path):
    fa = write(tmp_path / "g.fasta", ">chr2 second\nACGT\nAC\n>chr1\nGGGG\n>empty\n")
    g = readers.find_reader(fa)(spark, fa)
    assert {(r["record"], r["sequence"]) for r in g.collect()} == {("chr2", "ACGTAC"), ("chr1", "GGGG"), ("empty", "")}
    genome = readers.read_genome(spark, fa)
    assert {(r["name"], r["contig_id"], r["length"]) for r in genome.primary.collect()} == {("chr1", 0, 4), ("chr2", 1, 6), ("empty", 2, 0)}
    gff = write(tmp_path / "a.gff3", "##gff-version 3\nchr1\tx\tgene\t1\t100\t.\t+\t.\tID=g1;Name=G\nchr1\tx\tmRNA\t1\t90\t5.5\t+\t0\tID=t1;Parent=g1\n")
    f = {r["type"]: r for r in readers.read_gff3(spark, gff, genome.primary).collect()}
    assert (f["gene"]["start"], f["gene"]["end"], f["mRNA"]["parent_id"], f["mRNA"]["score"]) == (0, 100, f["gene"]["feature_id"], 5.5)
    sinks.write_gff3(readers.read_gff3(spark, gff, genome.primary), genome.primary, str(tmp_path / "out"))
    assert any(r["value"].startswith("chr1\tx\tgene\t1\t100\t.\t+") for r in spark.read.text(str(tmp_path / "out")).collect())
    bed = write(tmp_path / "a.bed", "track name=x\nchr1\t5\t10\nchr2\t0\t7\tn\t3\t-\t1\t2\t0\t1\t2\t3\n")
    b = readers.read_bed(spark, bed).orderBy("feature_id").collect()
    assert [(r["start"], r["end"], r["strand"]) for r in b] == [(5, 10, "."), (0, 7, "-")] and "thickStart" in b[1]["attributes_json"]
    with pytest.raises(ValueError):
        readers.find_reader("x.unknown")


def test_sam(spark, tmp_path):
    sam = write(tmp_path / "a.sam", "@HD\tVN:1.6\nr1\t0\tchr1\t101\t60\t5M10N5M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tqs:f:12.5\tch:i:7\tcs:Z::5~gt10ag:5\nr1\t256\tchr1\t501\t0\t10M\t*\t0\t0\t*\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    r = {x["read_id"]: x for x in readers.read_sam(spark, sam, acquisition_id=3).collect()}
    assert r["r1"]["mean_quality"] == 12.5 and r["r1"]["channel"] == 7 and r["r2"]["mean_quality"] == pytest.approx(40)
    a = readers.read_sam_alignments(spark, sam)
    got = a.primary.orderBy("ref_start").collect()
    assert [(x["ref_start"], x["ref_end"], x["is_secondary"]) for x in got] == [(100, 120, False), (500, 510, True)]
    assert [(x["alignment_id"], x["tag"], x["value"]) for x in a.companions["tags"].collect()] == [(got[0]["alignment_id"], "cs", ":5~gt10ag:5")]


def test_tables(spark, tmp_path):
    hits = write(tmp_path / "h.tsv", "q\tt\t1e-5\t1\t10\t1\t10\t10M\n")
    assert readers.read_hits(spark, hits, aligned_to="reference").first()["evalue"] == 1e-5
    counts = write(tmp_path / "c.tsv", "\tprotein_id\tsequence\ts1\ts2\n0\tP0\tMA\t3.0\t0\n")
    assert sorted((r["sample"], r["count"]) for r in readers.read_counts(spark, counts).collect()) == [("s1", 3), ("s2", 0)]
    (tmp_path / "mq").mkdir()
    write(tmp_path / "mq" / "msms.txt", "id\tRaw file\tScan number\tCharge\tModified sequence\tScore\tPEP\tRetention time\tReverse\n1\trun\t7\t2\t_AM(Oxidation (M))K_\t99\t0.01\t2.5\t\n2\trun\t8\t2\t_AAK_\t9\t0.5\t3\t+\n")
    m = readers.read_maxquant(spark, str(tmp_path / "mq")).orderBy("psm_id").collect()
    assert (m[0]["modified_sequence"], m[0]["rt"], m[1]["is_decoy"]) == ("AM[UNIMOD:35]K", 150.0, True)
    msp = write(tmp_path / "l.msp", 'Name: AAK/2\nMW: 300.1\nComment: Spec=Raw Mods=0\nNum peaks: 2\n100.5\t10\t"y1"\n200.25 20\n\nName: CCK/1\nMW: 1\nComment: a=1\nNum peaks: 1\n50 1 "?"\n')
    lib = readers.read_msp(spark, msp)
    assert {(r["name"], r["mw"]) for r in lib.primary.collect()} == {("AAK/2", 300.1), ("CCK/1", 1.0)}
    assert {(r["name"], r["mz"], r["annotation"]) for r in lib.companions["peaks"].collect()} == {("AAK/2", 100.5, "y1"), ("AAK/2", 200.25, None), ("CCK/1", 50.0, "?")}


def test_taxonomy(spark, tmp_path):
    write(tmp_path / "nodes.dmp", "1\t|\t1\t|\tno rank\t|\t\t|\t8\t|\t0\t|\t1\t|\t0\t|\t0\t|\n9606\t|\t1\t|\tspecies\t|\tHS\t|\t5\t|\t1\t|\t1\t|\t1\t|\t2\t|\n")
    write(tmp_path / "names.dmp", "1\t|\troot\t|\t\t|\tscientific name\t|\n9606\t|\tHomo sapiens\t|\t\t|\tscientific name\t|\n9606\t|\thuman\t|\t\t|\tgenbank common name\t|\n")
    write(tmp_path / "merged.dmp", "12\t|\t9606\t|\n")
    d = readers.read_taxdump(spark, str(tmp_path))
    from sparkloom.operators.relational import lookup_taxid

    asked = spark.createDataFrame([("HUMAN",), ("12",), ("9606",), ("5",), ("x",)], "query string")
    assert dict(map(tuple, lookup_taxid(d["names"], d["merged"], asked).collect())) == {"HUMAN": 9606, "12": 9606, "9606": 9606, "5": None, "x": None}


def test_sqlite(spark, tmp_path):
    mz, n = sqlite.encode_of([100.5, 200.25])
    inten, k = sqlite.encode_of([1.0, 2.0], "f4")
    assert (n, k) == (16, 8) and sqlite.decode_of(mz) == [100.5, 200.25]
    with pytest.raises(ValueError):
        sqlite.decode_of(mz, length=5)
    path = str(tmp_path / "lib.dlib")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE entries (PeptideModSeq TEXT, MassArray BLOB, IntensityArray BLOB, CorrelationArray BLOB, Score REAL)")
        c.executemany("INSERT INTO entries VALUES (?, ?, ?, NULL, 0.5)", [(f"P{i}", mz, inten) for i in range(40)] + [("bad", b"xx", None)])
    lib = sqlite.read_library(spark, path)["entries"]
    rows = {r["PeptideModSeq"]: r for r in lib.collect()}
    assert len(rows) == 41 and rows["P3"]["mz"] == [100.5, 200.25] and rows["P3"]["intensity"] == [1.0, 2.0] and rows["bad"]["mz"] is None
    assert sqlite.write_table(lib.select("PeptideModSeq", "MassArray"), str(tmp_path / "o.dlib"), "entries") == 41
    assert sqlite.read_table(spark, str(tmp_path / "o.dlib"), "entries").count() == 41
    back = spark.createDataFrame([([1.5, 2.5],)], "v array<double>").select(sqlite.decompress_mz(sqlite.compress("v")["blob"])).first()[0]
    assert back == [1.5, 2.5]


def test_bundles_and_indexes(spark, tmp_path):
    contigs, seq = spark.createDataFrame([(1, "a", 4)], "contig_id long, name string, length long"), spark.createDataFrame([(1, "ACGT")], "contig_id long, sequence string")
    sinks.save_bundle({"contigs": contigs, "sequences": seq}, str(tmp_path / "b"), "genome", metadata={"v": 1})
    tables, meta = sinks.load_bundle(spark, str(tmp_path / "b"), "genome")
    assert meta == {"v": 1} and tables["sequences"].first()["sequence"] == "ACGT"
    with pytest.raises(ValueError):
        sinks.save_bundle({"contigs": contigs, "sequences": seq.withColumn("contig_id", F.lit(9))}, str(tmp_path / "c"), "genome")
    peaks = spark.createDataFrame([(1, 0, 500.0, 1.0, 9.0), (2, 3, 100.0, 2.0, 1.0)], "level int, window_id int, mz double, rt double, intensity double")
    sinks.write_peak_index(peaks, str(tmp_path / "p"))
    hit = sinks.read_peak_index(spark, str(tmp_path / "p"), 1, 400.0, 600.0)
    assert hit.count() == 1
    assert sinks.arrow_stream(peaks)[:4] == b"\xff\xff\xff\xff"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("a", "2026-01-01 00:00:01", 1.0), ("a", "2026-01-01 00:00:09", 2.0), ("b", "2026-01-01 00:01:00", 3.0)], "k string, t string, v double").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(src)
    stream = ingest.read_stream(spark, src, df.schema)
    agg = ingest.tumbling(stream, "t", "10 seconds", ["k"], "v", late="1 minute")
    q = agg.writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["n"], r["total"]) for r in spark.table("bins").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}
    assert {(r["k"], r["n"]) for r in ingest.sessions(df, "t", "5 seconds", ["k"]).collect()} == {("a", 1), ("b", 1)}
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    split = lambda b: {"all": b, "big": b.where("v > 1.5")}
    ingest.ingest(stream, out, cp, transform=split)
    ingest.ingest(ingest.read_stream(spark, src, df.schema), out, cp, transform=split)  # nothing new
    assert spark.read.parquet(f"{out}/all").count() == 3 and spark.read.parquet(f"{out}/big").count() == 2
    num = spark.createDataFrame([("a", 1.0), ("a", 11.0), ("a", 2.0)], "k string, s double")
    num.coalesce(1).write.parquet(str(tmp_path / "n"))
    g = ingest.group_in_order(ingest.read_stream(spark, str(tmp_path / "n"), num.schema), "k", "s", 10.0)
    q = g.writeStream.format("memory").queryName("groups").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["bin"], r["group_no"]) for r in spark.table("groups").collect()) == [(0, 0), (0, 2), (1, 1)]
