"""Operators on small cases with known results, and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aggregates, clustering, consensus, coverage, graph, integrity, intervals, nearest, relational, windows


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(2)
    make = lambda n, span: [(rng.choice("ab"), i, s, s + rng.randint(-1, span)) for i, s in enumerate(rng.randint(-50, 5000) for _ in range(n))]
    a, b = make(150, 40) + make(20, 3000), make(150, 300)
    x = spark.createDataFrame(a, "k string, i int, s long, e long")
    y = spark.createDataFrame(b, "k string, j int, t long, f long")
    got = rows(intervals.interval_join(x, y, "k", "s", "e", "t", "f"), "i", "s", "j", "t")
    assert got == sorted(((i, s, j, t) for k, i, s, e in a for kk, j, t, f in b if k == kk and s < e and t < f and t < e and f > s), key=str)
    assert intervals.interval_join(x.limit(0), y, "k", "s", "e", "t", "f").count() == 0


def test_short_intervals_do_not_meet_in_bins_of_a_long_one(spark, monkeypatch):
    rng = random.Random(4)
    make = lambda n: [("a", i, s, s + rng.randint(20, 60)) for i, s in enumerate(rng.randint(0, 200_000) for _ in range(n))]
    a, b, long = make(800), make(800), [("a", 9000, 0, 250_000)]
    count = lambda a, b: intervals.interval_join(spark.createDataFrame(a, "k string, i int, s long, e long"), spark.createDataFrame(b, "k string, j int, t long, f long"), "k", "s", "e", "t", "f").count()
    true = count(a, b)
    assert count(a + long, b) == true + 800 and count(a, b + long) == true + 800
    monkeypatch.setattr(intervals, "overlaps", lambda *_: F.lit(True))  # all pairs that meet in a bin
    tested = count(a, b)
    assert tested <= 20 * true and max(count(a + long, b), count(a, b + long)) == tested + 800


def test_best_overlap(spark):
    a = spark.createDataFrame([(1, 1, 100, 200, "+")], "c int, i int, s long, e long, st string")
    g = spark.createDataFrame([(1, 100, 50, 250, "+"), (1, 200, 180, 300, "+")], "c int, g int, t long, f long, gs string")
    best = lambda a, g, **kw: rows(intervals.best_overlap(a, g, "c", "i", "s", "e", "g", "t", "f", left_strand="st", right_strand="gs", **kw), "g", "fraction")
    assert best(a, g) == [(100, 1.0)]
    short = spark.createDataFrame([(1, 1, 0, 100, "+")], a.schema)
    late = spark.createDataFrame([(1, 7, 90, 200, "+")], g.schema)
    assert best(short, late) == [] and best(short, late, min_fraction=0.05) == [(7, 0.1)]
    minus = spark.createDataFrame([(1, 1, 100, 200, "-")], a.schema)
    assert best(minus, g.where("g = 100")) == [] and best(minus, g.where("g = 100"), allow_antisense=True) == [(100, 1.0)]
    assert best(minus, g.where("g = 100").withColumn("gs", F.lit("."))) == [(100, 1.0)]


def test_windows(spark):
    w = spark.createDataFrame([("w1", 0.0, 10.0), ("w2", 10.0, 20.0), ("w3", 5.0, 15.0)], "w string, lo double, hi double")
    v = spark.createDataFrame([(1.0,), (10.0,), (20.0,), (None,)], "v double")
    assert rows(intervals.assign_window(v, "v", w, "lo", "hi", "w")) == sorted([(1.0, "w1"), (10.0, "w3"), (20.0, None), (None, None)], key=str)
    m = intervals.merge_windows(spark.createDataFrame([(1.01, 2.0), (1.03, 2.04), (5.0, 6.0)], "a double, b double"), "a", "b")
    assert rows(m.select(F.round("lo", 3), F.round("hi", 3), "n")) == [(1.02, 2.02, 2), (5.0, 6.0, 1)]


def test_nearest(spark):
    axis = spark.createDataFrame([(0, 100.0), (1, 200.0), (2, 300.0006), (3, 400.0)], "i int, v double")
    q = spark.createDataFrame([(1, 300.0), (2, 305.0), (3, None), (4, float("nan"))], "q int, m double")
    got = nearest.nearest(q, axis, "q", "m", "v", "i", 10.0)
    assert rows(got.select("q", "i", F.round("delta", 4))) == [(1, 2, -0.0006)]
    tie = nearest.nearest(spark.createDataFrame([(1, 101.0)], q.schema), spark.createDataFrame([(0, 100.0), (1, 102.0)], axis.schema), "q", "m", "v", "i", 50000.0)
    assert rows(tie, "i") == [(0,)]
    near = spark.createDataFrame([(0, 100.0), (1, 100.001), (2, 100.002), (3, 200.0)], axis.schema)
    assert rows(nearest.window_counts(spark.createDataFrame([(1, 100.001), (2, 500.0)], q.schema), near, "q", "m", "v", 20.0)) == [(1, 3), (2, 0)]
    da = spark.createDataFrame([(0, 200.0), (1, 200.02)], axis.schema)
    assert rows(nearest.nearest(spark.createDataFrame([(1, 200.005), (2, 200.5)], q.schema), da, "q", "m", "v", "i", 0.01, "Da"), "q", "i") == [(1, 0)]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(4)
    a, q = sorted(rng.uniform(100, 120) for _ in range(300)), [rng.uniform(99, 121) for _ in range(200)]
    got = rows(nearest.all_within(spark.createDataFrame(list(enumerate(q)), "q int, m double"), spark.createDataFrame(list(enumerate(a)), "i int, v double"), "m", "v", 400.0), "q", "i")
    assert got == sorted(((k, i) for k, x in enumerate(q) for i, v in enumerate(a) if abs(x - v) <= x * 400 * 1e-6), key=str)


def test_traces(spark):
    peaks = spark.createDataFrame([(1, 500.0, 10.0), (1, 500.003, 99.0), (2, 500.001, 7.0), (3, 500.0, 5.0)], "scan int, mz double, intensity double")
    scans = spark.createDataFrame([(1, 2, 10.0, 490.0, 510.0), (2, 2, 20.0, None, None), (3, 2, 30.0, 600.0, 700.0)], "scan int, level int, rt double, isolation_lower double, isolation_upper double")
    t = spark.createDataFrame([(1, "b2", 500.0005, 2, 505.0, None, 25.0)], "target_id int, ion string, ion_mz double, level int, precursor_mz double, rt_start double, rt_end double")
    assert rows(nearest.extract_traces(peaks, scans, t, 10.0), "scan", "mz", "intensity") == [(1, 500.0, 10.0), (2, 500.001, 7.0)]


def test_shared_ions_and_match_list(spark):
    df = spark.createDataFrame([([100.0, 200.0, 300.0], [100.0005, 250.0, 300.0])], "a array<double>, b array<double>")
    assert df.select(nearest.shared_ions("a", "b", 10.0)).first()[0] == 2
    q = spark.createDataFrame([(1, 100.0), (2, 200.0)], "q int, m double")
    axis = spark.createDataFrame([(1, 99.999), (2, 100.0005), (3, 199.9981), (4, 200.0019)], "i int, v double")
    assert rows(nearest.match_list(q, axis, "q", "m", "v", "i", 20.0), "q", "i") == [(1, 1), (1, 2), (2, 3), (2, 4)]
    assert rows(nearest.match_list(q, axis, "q", "m", "v", "i", 10.0), "q", "i")[0] == (1, 2)


@pytest.mark.parametrize("tile", [None, 64])
@pytest.mark.parametrize(("blocks", "expected"), [
    ([(100, 200)], [(100, 200, 1)]),
    ([(100, 200), (150, 250)], [(100, 150, 1), (150, 200, 2), (200, 250, 1)]),
    ([(100, 200), (500, 600)], [(100, 200, 1), (500, 600, 1)]),
    ([(100, 200), (200, 300)], [(100, 300, 1)]),
    ([(5, 5), (9, 3)], []),
])
def test_coverage(spark, blocks, expected, tile):
    df = spark.createDataFrame([(1, a, b) for a, b in blocks], "c int, s long, e long")
    assert rows(coverage.rle_coverage(df, "c", "s", "e", tile=tile), "start", "end", "depth") == sorted(expected, key=str)


def test_segments(spark):
    seg = spark.createDataFrame([(1, 0, 100), (1, 200, 300)], "c int, s long, e long")
    cuts = spark.createDataFrame([(1, 0), (1, 40), (1, 150), (1, 250), (1, 250), (2, 5)], "c int, p long")
    assert rows(coverage.cut_segments(seg, "c", "s", "e", cuts, "p")) == sorted([(1, 0, 40), (1, 40, 100), (1, 200, 250), (1, 250, 300)], key=str)
    cov = spark.createDataFrame([(1, 0, 300, 5)], "contig_id int, start long, end long, depth int")
    introns = spark.createDataFrame([(1, 100, 200, 2), (1, 100, 200, 2), (1, 20, 30, 1)], "contig_id int, donor_pos long, acceptor_pos long, read_count long")
    assert rows(coverage.derive_exons(cov, introns), "start", "end") == [(0, 100), (200, 300)]


@pytest.mark.parametrize(("junctions", "clusters"), [
    ([(1239, 5670, 100, "GT-AG", "+"), (1240, 5670, 5, "other", "+")], 1),
    ([(1234, 5670, 50, "GT-AG", "+"), (1238, 5670, 50, "GT-AG", "+")], 1),
    ([(1234, 5670, 100, "GT-AG", "+"), (1300, 5670, 80, "GT-AG", "+")], 2),
    ([(1234, 5670, 100, "GT-AG", "+"), (1234, 5670, 80, "GT-AG", "-")], 2),
])
def test_junction_clusters(spark, junctions, clusters):
    df = spark.createDataFrame([(1, s, d, a, n, m) for d, a, n, m, s in junctions], "contig_id long, strand string, donor_pos long, acceptor_pos long, read_count long, motif string")
    got = clustering.cluster_junctions(df).collect()
    assert {r["cluster_id"] for r in got} == set(range(clusters))
    assert max(got, key=lambda r: (r["read_count"], -r["donor_pos"]))["is_seed"] and sum(r["is_seed"] for r in got) == clusters


def test_junctions_and_fingerprints(spark):
    blocks = spark.createDataFrame([(1, 0, 50, 100), (1, 1, 500, 600), (2, 0, 40, 100), (2, 1, 500, 700), (3, 0, 10, 20), (4, 0, 5, 9), (4, 1, 30, 60)], "alignment_id long, block_index int, ref_start long, ref_end long")
    al = spark.createDataFrame([(i, 1, "+") for i in (1, 2, 3, 4)], "alignment_id long, contig_id long, strand string")
    j = clustering.junctions(blocks, al)
    seq = "A" * 100 + "GT" + "A" * 396 + "AG" + "C" * 200
    agg = clustering.aggregate_junctions(j, spark.createDataFrame([(1, seq)], "contig_id long, sequence string"))
    assert rows(agg, "donor_pos", "acceptor_pos", "read_count", "motif") == [(100, 500, 2, "GT-AG"), (9, 30, 1, "other")]
    introns = spark.createDataFrame([(77, 1, "+", 100, 500)], "intron_id long, contig_id long, strand string, donor_pos long, acceptor_pos long")
    f = clustering.read_fingerprints(blocks, al, introns)
    assert rows(f, "alignment_id", "intron_ids", "n_blocks") == [(1, [77], 2), (2, [77], 2), (3, [], 1)]
    assert len({r["fingerprint_hash"] for r in f.collect()}) == 2


def test_units_packing_representatives(spark):
    u = clustering.split_by_span(spark.createDataFrame([("a", 0.0), ("a", 4.0), ("a", 6.0), ("a", 11.5), ("b", 1.0), ("b", None)], "k string, t double"), "k", "t", 5.0)
    assert rows(u) == sorted([("a", 0.0, 0), ("a", 4.0, 0), ("a", 6.0, 1), ("a", 11.5, 2), ("b", 1.0, 0)], key=str)
    p = clustering.pack_rows(spark.createDataFrame([(1, 0, 10), (1, 5, 8), (1, 8, 20), (1, 10, 12)], "c int, s long, e long"), "c", "s", "e")
    assert rows(p, "s", "row") == [(0, 0), (10, 0), (5, 1), (8, 1)]
    rng = random.Random(5)
    spans = [(i, rng.choice("ab"), s, s + rng.randint(0, 40)) for i, s in enumerate(rng.randint(0, 3000) for _ in range(300))]
    got = {r["i"]: r["row"] for r in clustering.pack_rows(spark.createDataFrame(spans, "i int, c string, s long, e long").repartition(3), "c", "s", "e").collect()}
    ends: dict = {}
    for i, c, s, e in sorted(((i, c, s, e) for i, c, s, e in spans if s < e), key=lambda x: (x[1], x[2], x[3], x[0])):
        own = ends.setdefault(c, [])
        row = next((k for k, end in enumerate(own) if end <= s), len(own))
        own[row : row + 1] = [e]
        assert got.pop(i) == row
    assert not got
    m = spark.createDataFrame([("c", "AA", 1.0, "r3"), ("c", "AA", 2.0, "r2"), ("c", "TT", 9.0, "r1")], "k string, s string, q double, r string")
    assert rows(clustering.representatives(m, "k", "s", "q", "r"), "r", "n_same", "n_unique") == [("r2", 2, 2)]
    star = clustering.restrict_to_star(spark.createDataFrame([(1, "x", 100.0), (1, "y", 100.001), (1, "z", 100.0019)], "k int, i string, m double"), "k", "i", "m", 15.0)
    assert rows(star, "i", "star") == [("x", "x"), ("y", "x"), ("z", "z")]


def test_consensus(spark):
    ref = spark.createDataFrame([(1, i, b) for i, b in enumerate("ACGTA")], "k int, pos int, base string")
    votes = spark.createDataFrame([(1, 0, "T", 5), (1, 1, "C", 2), (1, 2, "-", 9), (1, 3, "G", 3), (1, 3, "T", 3), (1, 4, "N", 9)], "k int, pos int, base string, weight int")
    assert rows(consensus.sequence_consensus(votes, ref, "k")) == [(1, "TCG")]
    s = spark.createDataFrame([(1, "a", 1, 3.0), (1, "a", 2, 1.0), (1, "b", 1, 1.0)], "k int, replicate string, channel int, intensity double")
    c = consensus.spectrum_consensus(s, "k")
    assert rows(c.select("channel", "intensity", F.round("proportion", 3), F.round("spread", 4))) == [(1, 4.0, 0.8, 0.125), (2, 1.0, 0.2, 0.125)]
    assert consensus.replicate_deviance(s, c, "k").count() == 2


def test_relational(spark):
    df = spark.createDataFrame([(1, 10, True), (2, 5, True), (3, None, True), (4, 20, False)], "i int, v int, p boolean")
    preds = {"p": F.col("p"), "v": F.col("v") >= 6}
    assert rows(relational.filter_audit(df, preds), "stage", "kept", "dropped") == [("p", 3, 1), ("v", 1, 2)]
    assert rows(relational.filter_chain(df, preds), "i") == [(1,)]
    assert relational.filter_audit(df, {}).count() == 0
    hits = spark.createDataFrame([("q", "b", 1.0, "swissprot"), ("q", "a", 1.0, "reference"), ("r", "c", 2.0, None)], "query string, target string, evalue double, aligned_to string")
    assert rows(relational.best_hits(hits), "query", "target") == [("q", "a"), ("r", "c")]
    seg = spark.createDataFrame([("r1", 0, "barcode", 5), ("r1", 3, "barcode", 6), ("r2", 0, "adapter", 1)], "read_id string, segment_index int, kind string, barcode_id int")
    edges = spark.createDataFrame([(1, 6, 30), (1, 6, 20), (2, 6, 10), (1, None, 9)], "acquisition_id int, barcode_id int, sample_id int")
    reads = spark.createDataFrame([("r1",), ("r2",)], "read_id string")
    assert rows(relational.resolve_samples(reads, seg, edges, 1), "read_id", "sample_id") == [("r1", 20), ("r2", None)]
    assert rows(relational.samples_for(edges, 1, None)) == [(9,)]
    assert rows(relational.dense_ids(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "k string"), "k", "n")) == sorted([("b", 2), ("a", 1), ("b", 2), (None, 0)], key=str)
    parents = spark.createDataFrame([(1, "+"), (2, "-")], "t int, st string")
    kids = spark.createDataFrame([(1, 5, "GG"), (1, 1, "AC"), (2, 1, "AC"), (2, 9, "GT")], "t int, s int, x string")
    assert rows(relational.join_children_text(parents, kids, "t", "s", "x", "st", "seq"), "t", "seq") == [(1, "ACGG"), (2, "ACGT")]
    atoms = spark.createDataFrame([(0, "N", "ALA"), (1, "CB", "ALA"), (2, "O", "HOH")], "atom_id int, name string, res_name string")
    assert rows(atoms.where(relational.select_sidechain()), "atom_id") == [(1,)]
    bonds = spark.createDataFrame([(0, 1), (1, 2)], "i int, j int")
    kept, b = relational.induced_topology(atoms, bonds, atoms.where("atom_id > 0"))
    assert rows(b, "i", "j") == [(0, 1)]


def test_acquisition_order(spark):
    a = spark.createDataFrame([(10, "A", "2026-06-02T00:00:00Z"), (11, "A", "2026-06-01T23:00:00-02:00"), (12, "B", "2026-06-01T00:00:00Z"), (13, "B", "2026-06-01T00:00:00Z"), (14, "A", None), (15, None, "2026-06-01T00:00:00Z")], "acquisition_id long, instrument_serial string, acquisition_datetime string")
    got = dict(rows(windows.acquisition_order(a), "acquisition_id", "acquisition_order"))
    assert got == {10: 1, 11: 2, 14: 3, 12: 1, 13: 2, 15: None}


def test_aggregates(spark):
    c = spark.createDataFrame([("P0", "s1", 3, 120), ("P0", "s2", 1, 120), ("P1", "s1", 7, 50), ("P1", "s2", 9, 50)], "p string, s string, count long, len int")
    assert [round(r["tpm"]) for r in aggregates.per_million(c, "s").orderBy("p", "s").collect()] == [300000, 100000, 700000, 900000]
    assert rows(aggregates.per_million(c, "s", length="len", min_length=100), "p", "tpm") == [("P0", 1e6), ("P0", 1e6)]
    m = aggregates.count_matrix(c, "p", "s", "count", ["s1", "s3"], features=spark.createDataFrame([("P0",), ("P9",)], "p string"))
    assert rows(m) == [("P0", 3, 0), ("P9", 0, 0)]
    lab = aggregates.ranked_labels(c, "p", "s", "count", least=5)
    assert {(r["p"], r["label"]) for r in lab.collect()} == {("P1", "P0")}
    psi = aggregates.inclusion_ratio(spark.createDataFrame([(1, "i"), (1, "e"), (2, "x")], "k int, v string"), "k", F.col("v") == "i", F.col("v") == "e")
    assert rows(psi) == [(1, 1, 1, 0, 0.5), (2, 0, 0, 1, None)]
    blocks = spark.createDataFrame([(1, 2, 0, 0, 1), (1, 3, None, 0, 0)], "alignment_id int, n_match int, n_mismatch int, n_insert int, n_delete int")
    assert rows(aggregates.alignment_metrics(blocks)) == [(1, 5, 0, 0, 1, False)]


def test_graph(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(60)] + [(500, i) for i in range(501, 560)]
    find = {}
    def root(x):
        while find.setdefault(x, x) != x:
            x = find[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        find[y] = x
    n, e = graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(999,)], "node long"))
    got = dict(rows(graph.connected_components(n, e)))
    assert got == {x: root(x) for x in [*find, 999]}
    assert graph.component_sizes(graph.connected_components(n, e)).first()["size"] == 61
    small = spark.createDataFrame([(1, 2), (2, 1), (2, 2), (2, 3)], "src long, dst long")
    assert rows(graph.degrees(spark.createDataFrame([(1,), (2,), (9,)], "node long"), small)) == [(1, 1), (2, 3), (9, 0)]
    assert rows(graph.neighbors(small, 2)) == [(1,), (2,), (3,)]
    none = graph.connected_components(n.limit(0), e.limit(0))
    assert none.count() == 0


def test_tree(spark):
    t = spark.createDataFrame([("root", None), ("euk", "root"), ("met", "euk"), ("homo", "met"), ("plant", "euk")], "node string, parent string")
    homo = t.where("node = 'homo'")
    assert rows(graph.ancestors(t, homo), "ancestor", "distance") == [("euk", 2), ("met", 1), ("root", 3)]
    assert graph.lineage(t, homo).first()["path"] == ["root", "euk", "met", "homo"]
    assert dict(rows(graph.depths(t)))["homo"] == 3
    pairs = spark.createDataFrame([("homo", "plant"), ("homo", "met")], "a string, b string")
    assert rows(graph.lowest_common_ancestor(t, pairs), "b", "lca") == [("met", "met"), ("plant", "euk")]
    assert rows(graph.subtree(t, "met"), "node", "parent") == [("homo", "met"), ("met", None)]
    assert rows(graph.descendants(t, t.where("node = 'euk'"), max_depth=1), "descendant") == [("met",), ("plant",)]


def test_collisions(spark):
    schema = "entry_id string, window_id int, rt double, score double, mz_list array<double>"
    ions = [100.0, 200.0, 300.0, 400.0]
    near = spark.createDataFrame([("a", 1, 1000.0, 0.01, ions), ("b", 1, 1002.0, 0.1, ions)], schema)
    assert rows(graph.collision_losers(near), "entry_id", "winner") == [("b", "a")]
    far = spark.createDataFrame([("a", 1, 1000.0, 0.01, ions), ("b", 1, 1010.0, 0.1, ions), ("c", 1, 1005.0, None, ions)], schema)
    assert graph.collision_losers(far).count() == 0


def test_genes(spark):
    ex = spark.createDataFrame([(1, 1, 0, 100), (2, 1, 200, 300), (3, 1, 500, 600)], "exon_id long, contig_id long, start long, end long")
    i = spark.createDataFrame([(1, 100, 200, 5)], "contig_id long, donor_pos long, acceptor_pos long, read_count long")
    assert rows(graph.roll_up_genes(ex, i), "exon_id", "gene_id", "gene_start", "gene_end") == [(1, 1, 0, 300), (2, 1, 0, 300), (3, 3, 500, 600)]


def test_integrity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    b = spark.createDataFrame([(1, 2), (2, 9), (3, None)], "id int, ref int")
    v = integrity.validate({"a": a, "b": b}, {"a": "id", "b": "id"}, [("b", "ref", "a", "id")])
    assert [r["n"] for r in v.collect()] == [1, 0, 1]
    with pytest.raises(ValueError):
        integrity.require_valid(v)
    assert rows(integrity.missing_parents(b, "ref", a, "id", nullable=False), "ref") == [(9,), (None,)]
    ids = integrity.assign_ids({"b": (b.drop("ref"), "id", "n")})
    assert rows(ids["b"]) == [(1, 0), (2, 1), (3, 2)]
