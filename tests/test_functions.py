"""Sequence, CIGAR, notation, chemistry, vector, statistics and geometry functions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import chem, cigar, notation, reads, sequence, stats, structure, vectors


def one(spark, value, *columns, kind="string"):
    df = spark.createDataFrame([(value,)], f"s {kind}")
    r = df.select(*columns).first()
    return r[0] if len(columns) == 1 else tuple(r)


def test_sequences(spark):
    assert one(spark, "ATCGRN", sequence.reverse_complement("s"), sequence.complement("s")) == ("NYCGAT", "TAGCYN")
    assert one(spark, "au gc\n", sequence.normalize("s")) == "ATGC"
    assert [one(spark, s, sequence.identify_alphabet("s")) for s in ("ACGT", "ACGU", "ACGN", "PEPTIDE", "12")] == ["dna", "rna", "dna_iupac", "protein", None]
    assert one(spark, "ACGTA", sequence.kmers("s", 3), sequence.windows("s", 2, 2)) == (["ACG", "CGT", "GTA"], ["AC", "GT"])
    assert one(spark, "AC", sequence.kmers("s", 3)) == []
    assert one(spark, "GCSN", sequence.gc_fraction("s")) == pytest.approx(3.5 / 4) and one(spark, "", sequence.gc_fraction("s")) == 0
    assert one(spark, "GGGNAC", sequence.hamming("s", F.lit("GGGAAC"))) == 1
    for bad in (sequence.hamming("s", F.lit("A")), sequence.gc_fraction("s"), sequence.validate("s", "dna")):
        with pytest.raises(Exception):
            one(spark, "XJ!", bad)
    assert [sequence.translate_text(c) for c in ("CTN", "AAY", "AAR", "RAY", "SAR", "TAR", "NNN")] == ["L", "N", "K", "B", "Z", "*", "X"]
    assert one(spark, "ATGGCATCAGCATCAGCAGCATAA", sequence.translate("s"), sequence.translate("s", to_stop=True)) == ("MASASAA*", "MASASAA")
    assert sequence.translate_text("AATGGCATCA", frame=1) == "MAS"
    assert sequence.orfs_of("CCATGGCATAACC", min_length=1) == [("+", 2, 11, "MA")]
    assert one(spark, "CCATGGCATAACC", sequence.best_orf("s", min_length=1))["protein"] == "MA"


def test_digestion(spark):
    assert sequence.cleave_sites_of("PEPKPMAGE") == [0, 9]
    assert [p for *_, p in sequence.digest_of("PEPTIDEKMASTERPRVTEINR", min_length=3)] == ["PEPTIDEK", "MASTERPR", "VTEINR"]
    assert [p for *_, p in sequence.digest_of("AKGKAK", min_length=2)] == ["AK", "GK"]
    assert [p for *_, p in sequence.digest_of("MAKGR", missed=1, excise_met=True)] == ["MAK", "MAKGR", "AK", "AKGR", "GR"]
    assert one(spark, "MAKRPEPKTIDER", sequence.tryptic_peptides("s")) == ["MAK", "RPEPK", "TIDER"]
    assert [x["peptide"] for x in one(spark, "MAKGR", sequence.digest("s"))] == ["MAK", "GR"]


def test_search(spark):
    assert sequence.locate_of("ACGT", "TTTACTTT")[0] == 1 and sequence.locate_of("ACT", "TTTACTTT") == (0, 3, 6)
    assert one(spark, "GGACTGG", sequence.locate("ACT", "s", 0))["start"] == 2 and one(spark, "GGG", sequence.locate("ACT", "s", 1))["distance"] is None
    assert one(spark, "AACC", sequence.best_barcode("s", {"b1": "AACG", "b2": "TTTT"}, 2)).asDict() == {"barcode": "b1", "distance": 1, "delta": 3}
    assert one(spark, "AACC", sequence.best_barcode("s", {"b1": "TTTT"}, 2)) is None
    assert one(spark, "AAAA", sequence.edit_distance("s", F.lit("TTTT"), 2)) is None
    assert sequence.poly_a_of("C" * 10 + "A" * 20 + "G" + "A" * 12 + "C") == (10, 43) and sequence.poly_a_of("ACGT") is None
    assert one(spark, "!I", sequence.decode_phred("s")) == [0, 40] and one(spark, "II", sequence.mean_quality("s")) == pytest.approx(40)
    status = lambda a, b, c: sequence.read_status(F.lit(a), F.lit(b), F.lit(c))
    assert one(spark, "", status(True, True, True), status(False, True, True), status(True, True, False), status(True, False, False), status(False, True, False)) == ("Complete", "3' Only", "Missing Barcode", "5' Only", "Unknown")
    pick = one(spark, "", sequence.pick_orientation(F.lit("Complete"), F.lit("Complete")), sequence.pick_orientation(F.lit("Unknown"), F.lit("5' Only")))
    assert [tuple(p) for p in pick] == [("+", True), ("-", False)]


def test_cigar(spark):
    assert [b[:5] for b in cigar.cigar_blocks_of("10S50M100N20M2I5D3M", 100)] == [(0, 100, 150, 10, 60), (1, 250, 278, 60, 85)]
    assert [b[1:3] for b in cigar.cigar_blocks_of("10M30D10M", 0)] == [(0, 10), (40, 50)]
    cs = cigar.cs_blocks_of("=ACGT*ag:5~gt100ag:3+ac-g", 10)
    assert [b[1:3] for b in cs] == [(10, 20), (120, 124)] and cs[0][5:7] == (9, 1)
    assert cigar.cs_mismatches_of("=ACGT*ag:5~gt100ag:3*ca", 10) == [14, 123]
    al = spark.createDataFrame([(1, 100, "10M100N10M", None), (2, 0, None, ":5*ag:4"), (3, 7, None, None)], "alignment_id long, ref_start long, cigar string, cs string")
    assert [(r["alignment_id"], r["ref_start"], r["ref_end"]) for r in cigar.alignment_blocks(al).orderBy("alignment_id", "ref_start").collect()] == [(1, 100, 110), (1, 210, 220), (2, 0, 10)]
    j = al.where("alignment_id = 1").select(cigar.block_junctions(cigar.cigar_blocks("cigar", "ref_start")).alias("j")).first()["j"]
    assert [(x["donor_pos"], x["acceptor_pos"]) for x in j] == [(110, 210)]
    assert one(spark, "5S10M2D3M", cigar.query_start("s"), cigar.reference_length("s")) == (5, 15)


def test_notation(spark):
    for t in ("PEPTIDE", "[Acetyl]-AC[UNIMOD:4]K/2", "AK-[Amidated]", "EM[Oxidation][+1.5]K"):
        assert notation.format_proforma_of(notation.parse_proforma_of(t)) == t
    p = notation.parse_proforma_of("[Acetyl]-AC[UNIMOD:4]K/2")
    assert (p["sequence"], p["mods"], p["charge"]) == ("ACK", [(0, "Acetyl"), (2, "UNIMOD:4")], 2)
    with pytest.raises(ValueError):
        notation.parse_proforma_of("PE1TIDE")
    assert notation.modseq_to_proforma_of("S[+79.966331]K[+999.5]") == "S[UNIMOD:21]K[+999.500000]"
    assert notation.proforma_to_modseq_of("AC[UNIMOD:4]K") == "AC[+57.021464]K"
    assert notation.maxquant_to_proforma_of("_(Acetyl (Protein N-term))AM(Oxidation (M))C_", {"C": "UNIMOD:4"}) == "[UNIMOD:1]-AM[UNIMOD:35]C[UNIMOD:4]"
    for t in ("y5-H2O^2/1.2ppm*0.9", "b3", "p^2", "IK", "m2:5", "?", "y4+i", "y4+2i/0.01"):
        assert notation.format_mzpaf_of(notation.parse_mzpaf_of(t)) == t
    assert one(spark, "b12", notation.mzpaf("s"))["position"] == 12 and one(spark, "nonsense", notation.mzpaf("s"))["kind"] is None
    assert one(spark, "x", notation.render_mzpaf(F.lit("y"), F.lit(3), F.lit(2), F.lit("NH3"))) == "y3-NH3^2"
    u = one(spark, "mzspec:PXD000561:run:1:scan:17555:VLHPL/2", notation.usi("s"))
    assert (u["collection"], u["run"], u["index"], u["interpretation"]) == ("PXD000561", "run:1", "17555", "VLHPL/2")
    assert one(spark, "usi?", notation.usi("s")) is None
    assert one(spark, 'Spec=Consensus Mods=1/2,C,Carbamidomethyl Fullname="R.AC K.D" a=1 a=2', notation.comment_fields("s")) == {"Spec": "Consensus", "Mods": "1/2,C,Carbamidomethyl", "Fullname": "R.AC K.D", "a": "2"}
    assert [tuple(x) for x in one(spark, "1/2,C,Carbamidomethyl", notation.mods_field("s"))] == [(2, "C", "Carbamidomethyl")]
    f = one(spark, "FTMS + c NSI d Full ms2 593.92@hcd30.00 [110.00-1195.00]", notation.scan_filter("s"))
    assert (f["analyzer"], f["polarity"], f["level"], f["precursor_mz"], f["activation"], f["energy"], f["high_mz"]) == ("FTMS", "+", 2, 593.92, "hcd", 30.0, 1195.0)
    assert one(spark, "sp|P1|X GN=ABC PE=1", notation.gene_of_header("s")) == "ABC" and one(spark, "none", notation.gene_of_header("s")) is None


def test_chemistry(spark):
    assert chem.parse_formula_of("C6H12O6") == {"C": 6, "H": 12, "O": 6} and chem.hill({"O": 1, "H": 2}) == "H2O"
    assert chem.mass_of(chem.parse_formula_of("C6H12O6")) == pytest.approx(180.06339, abs=1e-4)
    assert one(spark, "C6H12O6", chem.parse_formula("s")) == {"C": 6, "H": 12, "O": 6}
    assert one(spark, "C6H12O6", chem.formula_mass(chem.parse_formula("s"))) == pytest.approx(180.06339, abs=1e-4)
    assert one(spark, "PEPTIDE", chem.peptide_mass("s")) == pytest.approx(799.35996, abs=1e-4) == chem.mass_of(chem.peptide_composition("PEPTIDE"))
    assert one(spark, "PEPXIDE1", chem.peptide_mass("s")) is None
    assert one(spark, "PEPTIDE", chem.mz(chem.peptide_mass("s"), 2)) == pytest.approx(400.68726, abs=1e-4)
    ladder = {(f[0], f[1]): f[4] for f in chem.fragments_of("PEPTIDE")}
    assert ladder["b", 2] == pytest.approx(227.1026, abs=1e-3) and ladder["y", 1] == pytest.approx(148.0604, abs=1e-3)
    by = {(x["ion"], x["position"]): x["mz"] for x in one(spark, "PEPTIDE", chem.by_ladder("s"))}
    assert by == pytest.approx(ladder)
    rows = chem.ladder_rows(spark.createDataFrame([(1, "PEPTIDE"), (2, "A"), (3, "")], "k int, s string"), "k", "s").collect()
    assert {(x["ion"], x["position"]): x["mz"] for x in rows} == pytest.approx(ladder) and {x["k"] for x in rows} == {1}
    lost = {(f[0], f[1], f[3]) for f in chem.fragments_of("AGSK", losses=("H2O", "H3PO4"))}
    assert ("b", 3, "H2O") in lost and ("b", 1, "H2O") not in lost and not any(x[2] == "H3PO4" for x in lost)
    assert chem.find_modifications(15.9949) == ["UNIMOD:35"]
    glucose = chem.parse_formula_of("C6H12O6")
    p = chem.isotope_pattern(glucose, 4)
    assert p.sum() == pytest.approx(1) and p[1] / p[0] == pytest.approx(0.0691, abs=2e-3)
    exact = chem.exact_envelope(glucose, 1.0, 4)
    assert [s for _, s in exact] == pytest.approx(list(p), abs=2e-4)
    assert chem.isotopologues(glucose)[0][0] == pytest.approx(180.06339, abs=1e-4)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.0], [1.0, 2.0, 0.0], [2.0, 0.0, 1.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>, c array<double>, z array<double>")
    got = df.select(*[vectors.compare("a", y, m).alias(f"{m}_{y}") for m in vectors.METRICS for y in ("b", "c")], vectors.cosine("a", "z").alias("zero")).first()
    a, c = np.array([1.0, 2, 0]), np.array([2.0, 0, 1])
    assert got["cosine_b"] == pytest.approx(1) and got["cosine_c"] == pytest.approx(a @ c / np.linalg.norm(a) / np.linalg.norm(c))
    assert got["pearson_c"] == pytest.approx(np.corrcoef(a, c)[0, 1]) and got["spectral_angle_b"] == pytest.approx(1)
    assert got["entropy_b"] == pytest.approx(1) and 0 <= got["entropy_c"] < 1 and got["kld_b"] == pytest.approx(0, abs=1e-6) and got["zero"] == 0
    assert df.select(vectors.l1_normalize("a")).first()[0] == pytest.approx([1 / 3, 2 / 3, 0])


def test_statistics(spark):
    assert stats.normal_logpdf(1.0, 0.0, 2.0) == pytest.approx(-1.737086, abs=1e-5)
    assert float(stats.student_t_logpdf(0.0, 1.0, 0.0, 1.0)) == pytest.approx(-math.log(math.pi))
    assert float(stats.poisson_logpmf(3.0, 2.0)) == pytest.approx(math.log(8 * math.exp(-2) / 6))
    assert float(stats.beta_logpdf(0.3, 1.0, 1.0)) == pytest.approx(0) and stats.dirichlet_multinomial_logpmf([1, 2], [1, 1]) == pytest.approx(math.log(0.25))
    t = np.linspace(0, 30, 400)
    assert np.trapezoid(stats.emg_peak(t, 10, 8, 1, 2), t) == pytest.approx(10, rel=1e-3)
    x, v = stats.minimize(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, [(-5, 5), (-5, 5)])
    assert x == pytest.approx([1, -2], abs=1e-3)
    assert stats.laplace_covariance(lambda p: 0.5 * (p[0] / 2) ** 2, [0.0])[0, 0] == pytest.approx(4, rel=1e-3)
    xs = np.linspace(0, 10, 40)
    rows = [(k, float(x), float(y)) for k, mu in ((1, 4.0), (2, 6.0)) for x, y in zip(xs, stats.gaussian_peak(xs, 5.0, mu, 0.8))] + [(3, 1.0, 1.0)]
    fit = {r["k"]: r for r in stats.fit_groups(spark.createDataFrame(rows, "k int, x double, y double"), "k", "x", "y", "gaussian", {"area": (0, 20), "mu": (0, 10), "sigma": (0.2, 3)}).collect()}
    assert fit[1]["mu"] == pytest.approx(4, abs=1e-2) and fit[2]["mu"] == pytest.approx(6, abs=1e-2) and fit[3]["mu"] is None
    d = spark.createDataFrame([([1, 2], [1.0, 1.0])], "x array<int>, a array<double>").select(stats.log_density("dirichlet_multinomial", "x", F.col("a"))).first()[0]
    assert d == pytest.approx(math.log(0.25))
    tiers = stats.parameter_tiers(spark.createDataFrame([("g", 1.0), ("h", 2.0)], "name string, value double"), spark.createDataFrame([(7, "g", 5.0)], "e int, name string, value double"), "e")
    assert sorted(map(tuple, tiers.collect())) == [(7, "g", 5.0), (7, "h", 2.0)]
    cells = spark.createDataFrame([(1, 0.5, 1.0, 50.0, 1.0, 1.0), (1, 0.5, 1.0, 50.0, 1.0, 1.0)], "t int, shape double, share double, intensity double, injection_s double, gain double")
    assert stats.estimate_counts(cells, "t").first()["n"] == pytest.approx(100)


def test_structure(spark):
    atoms = spark.createDataFrame([(0, "C"), (1, "C"), (2, "O"), (3, "X")], "atom_id int, element string")
    coords = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.5, 0.0, 0.0), (0, 2, 9.0, 0.0, 0.0), (0, 3, 0.1, 0.0, 0.0)], "frame_id int, atom_id int, x double, y double, z double")
    assert [(r["i"], r["j"]) for r in structure.infer_bonds(atoms, coords).collect()] == [(0, 1)]
    two = coords.where("atom_id < 2")
    assert structure.centroid(two).first()["x"] == 0.75 and structure.radius_of_gyration(two).first()["rg"] == pytest.approx(0.75)
    turned = structure.rotate(two, [[0, -1, 0], [1, 0, 0], [0, 0, 1]]).orderBy("atom_id").collect()
    assert (turned[1]["x"], turned[1]["y"]) == pytest.approx((0, 1.5))
    assert structure.principal_axes(two).first()["moments"] == pytest.approx([0, 1.125, 1.125])
    assert structure.mass_centroid(two, atoms).first()["x"] == pytest.approx(0.75)


def test_traces_are_fitted_at_once_and_apart(spark, monkeypatch):
    rng = np.random.default_rng(5)
    t = [np.sort(rng.choice(24, rng.integers(4, 25), replace=False)).astype(float) for _ in range(30)]
    traces = [(x, stats.gaussian_peak(x, 20 + k, 8 + k % 6, 2.0) + rng.random(len(x))) for k, x in enumerate(t)]
    limits, calls, shape = [(0, 500), (0, 24), (1, 30)], [], stats.gaussian_peak
    monkeypatch.setitem(stats.CURVES, "gaussian", (lambda *a: calls.append(1) or shape(*a), ("area", "mu", "sigma")))
    at_once = stats.fit_traces(traces, "gaussian", limits)
    assert len(calls) < 4000 + 100 * len(traces)  # one by one, each takes thousands
    for trace, (best, sse) in zip(traces, at_once):
        alone, value = stats.fit_traces([trace], "gaussian", limits)[0]
        assert np.array_equal(best, alone) and sse == value
    best, sse = stats.minimize(lambda p: ((shape(traces[0][0], *p) - traces[0][1]) ** 2).sum(), limits)
    assert at_once[0][1] == pytest.approx(sse) and at_once[0][0] == pytest.approx(best, rel=1e-4)
    rows = [(k, x, y) for k, trace in enumerate(traces) for x, y in zip(*map(np.ndarray.tolist, trace))] + [(0, None, 1.0), (98, 1.0, float("inf")), (98, 2.0, 3.0), (99, None, None), (None, 1.0, 2.0)]
    got = stats.fit_groups(spark.createDataFrame(rows, "k int, x double, y double"), "k", "x", "y", "gaussian", dict(zip(("area", "mu", "sigma"), limits))).withColumn("task", F.spark_partition_id()).collect()
    fit = {r["k"]: r for r in got}
    assert len(got) == 33 and [fit[k]["n"] for k in (0, 98, 99, None)] == [len(t[0]), 1, 0, 1] and all(fit[k]["sse"] is fit[k]["mu"] is None for k in (98, 99, None))
    assert all(fit[k]["sse"] == pytest.approx(sse) for k, (_, sse) in enumerate(at_once)) and len({r["task"] for r in got}) > 1


def test_reads(spark):
    body = "ATG" + "GCA" * 50 + "TAG"
    read = "GATTACAGATTACA" + body + "A" * 20 + "CCCCTTTT" + "GTGTGTGTCAGTCA"
    df = spark.createDataFrame([("r1", read), ("r2", read[::-1].translate(str.maketrans("ACGT", "TGCA"))), ("r3", "ACGT" * 30), ("r4", None)], "read_id string, sequence string")
    d = reads.demultiplex(df, adapter5="GATTACAGATTACA", primer3="GTGTGTGTCAGTCA", barcodes={"b1": "CCCCTTTT", "b2": "GGGGAAAA"})
    got = {r["read_id"]: r for r in d.collect()}
    assert (got["r1"]["status"], got["r1"]["strand"], got["r1"]["barcode"]) == ("Complete", "+", "b1")
    assert (got["r2"]["status"], got["r2"]["strand"], got["r2"]["barcode"]) == ("Complete", "-", "b1") and got["r3"]["status"] == "Unknown" and "r4" not in got
    assert {r["protein"] for r in reads.predict_orfs(d).collect()} == {"M" + "A" * 50}
    classify = reads.classify_peptide_of
    assert classify("PEPTK", "AAPEPTKAA", None, 1, 1, None) == "non_reference"
    assert classify("PEPTK", "AAPEPTKAA", "AAPEQTKAA", 1, 1, "9M") == "snp"
    assert classify("PEPTK", "AAPEPTKAA", "AAPETKAA", 1, 1, "4M1I4M") == "insertion"
    assert classify("PEPTK", "AAPEPTKAA", "AAPEPTKAA", 4, 4, "6M") == "n_term_deviation"
    assert classify("XXX", "AAPEPTKAA", "AAPEPTKAA", 1, 1, "9M") == "unknown"
    rows = spark.createDataFrame([("p", "snp", 1.0, "x"), ("p", "complex", 9.0, "y"), ("q", "unknown", 1.0, "a"), ("q", "unknown", 3.0, "b")], "peptide string, class string, abundance double, protein_id string")
    assert {(r["peptide"], r["protein_id"]) for r in reads.prefer_class(rows).collect()} == {("p", "x"), ("q", "b")}


def test_places_are_those_of_the_whole_programme():
    rng = random.Random(8)
    for _ in range(1500):
        q = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90)))
        assert sequence.locate_of(q, text) == sequence._aligned(q, text, "infix")
    assert sequence.locate_of("", "ACGT") == (0, 0, 0) and sequence.locate_of("ACG", "") == (3, 0, 0)


def test_adapter_lies_anywhere_before_poly_a(spark):
    adapter, primer = "GATTACAGATTACA", "GTGTGTGTCAGTCA"
    body = "CGT" * 50
    reads_ = [(1, "CCT" * 60 + adapter + body + "A" * 30 + "CCCCTTTT" + primer), (2, body + adapter + "CGT" * 10), (3, body + "A" * 30 + "CCCCTTTT" + primer), (4, "A" * 400), (5, ""), (6, None)]
    d = {r["read_id"]: r for r in reads.demultiplex(spark.createDataFrame(reads_, "read_id long, sequence string"), adapter5=adapter, primer3=primer, barcodes={"b1": "CCCCTTTT", "b2": "GGGGAAAA"}).collect()}
    assert (d[1]["status"], d[1]["start"], d[1]["transcript"]) == ("Complete", 194, body)
    assert d[2]["status"] == "5' Only" and d[3]["status"] == "3' Only" and d[3]["start"] == 0 and d[4]["status"] == d[5]["status"] == "Unknown" and 6 not in d


def test_places_of_many_texts_at_once(monkeypatch):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    alone, calls = sequence._aligned, []
    monkeypatch.setattr(sequence, "_aligned", lambda *a: calls.append(1) or alone(*a))
    for m, piece in [(1, 3), (4, 1), (9, 16), (16, 512), (32, 40), (33, 40), (64, 512), (65, 512)]:
        monkeypatch.setattr(sequence, "_PIECE", piece)
        query = text(m)
        near = lambda: "".join(rng.choice(["", c, c, c, c, c, c, c + "T", "G", "\u00e9\u8a9e?"]) for c in query)
        texts = ["", query, *[text(rng.randint(0, 90)) + rng.choice([near(), ""]) + text(rng.randint(0, 90)) for _ in range(60)]]
        d, start, end = sequence.places_of(query, texts, m // 2)
        assert m > 64 or not calls  # nothing is aligned text by text
        for x, *got in zip(texts, d.tolist(), start.tolist(), end.tolist()):
            distance, first, stop = alone(query, x, "infix")
            assert got == [distance, first if distance <= m // 2 else -1, stop]
    assert [x.tolist() for x in sequence.places_of("", ["ACGT", ""], 1)] == [[0, 0]] * 3 and [len(x) for x in sequence.places_of("ACG", [], 1)] == [0] * 3


def test_poly_a_is_that_of_all_windows():
    rng = random.Random(10)
    for _ in range(500):
        s, query, edge = "".join(rng.choice("AAAAAC") for _ in range(rng.randint(0, 80))), rng.randint(1, 6), rng.randint(0, 5)
        runs = []
        for i in range(len(s) - query + 1):
            if s[i : i + query] == "A" * query:
                if runs and i <= runs[-1][1] + 1 + edge:
                    runs[-1][1] = i + query
                else:
                    runs.append([i, i + query])
        good = [tuple(r) for r in runs if 8 <= r[1] - r[0] <= 40]
        assert sequence.poly_a_of(s, query, 8, 40, edge) == (good[-1] if good else None)
