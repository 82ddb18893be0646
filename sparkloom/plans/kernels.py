"""Queries over the functions and smaller operators, each with the same in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import chem, cigar, reads, sequence, stats, structure, vectors
from sparkloom.operators import aggregates, clustering, graph, relational, targets
from sparkloom.plans.reference import Tables, _network, _pairs, _tree, _TREE, _VEC, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a query that takes the tables, with the same in SQL."""
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        SQL[name] = sql
        return f

    return add


# --- alignments and their strings --------------------------------------------------------------------------------

@query("alignment_filter", """
SELECT DISTINCT read_id FROM read_fingerprints WHERE NOT (n_blocks > 6) AND NOT (strand = '?') AND span_end - span_start >= 500 AND (fingerprint_hash % 60 + 60) % 60 >= 20 AND n_blocks / 8.0 >= 0.25""")
def _(t):
    a = t.read_fingerprints.select("read_id", (F.col("n_blocks") > 6).alias("is_secondary"), (F.col("strand") == "?").alias("is_supplementary"), (F.col("span_end") - F.col("span_start")).alias("read_length"), F.pmod("fingerprint_hash", F.lit(60)).alias("mapq"), (F.col("n_blocks") / 8.0).alias("aligned_fraction"))
    return relational.filter_chain(a, relational.alignment_predicates(min_length=500, min_mapq=20, min_aligned_fraction=0.25)).select("read_id").distinct()


#: An alignment over each intron: 5 clipped bases, a first block with an insertion and a short deletion, the intron, a second block.
_JUNCTION = "SELECT DISTINCT intron_id AS id, donor_pos AS d, acceptor_pos AS a, 20 + donor_pos % 50 AS x, 30 + acceptor_pos % 40 AS y FROM introns WHERE acceptor_pos - donor_pos >= 25 AND donor_pos > 1000"


def _alignments(t):
    d, a = F.col("donor_pos"), F.col("acceptor_pos")
    j = t.introns.where((a - d >= 25) & (d > 1000)).select(F.col("intron_id").alias("id"), d.alias("d"), a.alias("a"), (20 + d % 50).alias("x"), (30 + a % 40).alias("y")).distinct()
    s = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n = lambda c: F.col(c).cast("string")
    gap = (F.col("a") - F.col("d")).cast("string")
    start = F.col("d") - F.col("x") - 7
    j = j.withColumn("cigar", s("5S", n("x"), "M3I2D5=", gap, "N", n("y"), "M4S")).withColumn("cs", s(":", n("x"), "+acg-tt=ACGTA~gt", gap, "ag:", (F.col("y") - 1).cast("string"), "*ga"))
    return j.withColumn("ref_start", start).withColumn("alignment_id", F.concat_ws(":", "id", "d", "a"))


@query("cigar_blocks", f"WITH j AS ({_JUNCTION}) SELECT concat_ws(':', id, d, a) AS alignment_id, 0 AS block_index, d - x - 7 AS ref_start, d AS ref_end, 5 AS query_start, x + 13 AS query_end, x + 5 AS n_match, 3 AS n_insert, 2 AS n_delete FROM j UNION ALL SELECT concat_ws(':', id, d, a), 1, a, a + y, x + 13, x + y + 13, y, 0, 0 FROM j")
def _(t):
    b = cigar.alignment_blocks(_alignments(t).drop("cs"))
    return b.select("alignment_id", "block_index", "ref_start", "ref_end", "query_start", "query_end", "n_match", "n_insert", "n_delete")


@query("cs_blocks", f"WITH j AS ({_JUNCTION}) SELECT concat_ws(':', id, d, a) AS alignment_id, 0 AS block_index, d - x - 7 AS ref_start, d AS ref_end, x + 5 AS n_match, 0 AS n_mismatch, 3 AS n_insert, 2 AS n_delete FROM j UNION ALL SELECT concat_ws(':', id, d, a), 1, a, a + y, y - 1, 1, 0, 0 FROM j")
def _(t):
    return cigar.alignment_blocks(_alignments(t)).select("alignment_id", "block_index", "ref_start", "ref_end", "n_match", "n_mismatch", "n_insert", "n_delete")


@query("cs_mismatches", f"WITH j AS ({_JUNCTION}) SELECT concat_ws(':', id, d, a) AS alignment_id, a + y - 1 AS position FROM j")
def _(t):
    return _alignments(t).select("alignment_id", F.explode(cigar.cs_mismatches("cs", "ref_start")).alias("position"))


@query("block_junctions", f"WITH j AS ({_JUNCTION}) SELECT concat_ws(':', id, d, a) AS alignment_id, d AS donor_pos, a AS acceptor_pos, 5 AS clipped, a + y - (d - x - 7) AS covered FROM j")
def _(t):
    j = _alignments(t)
    pairs = cigar.block_junctions(cigar.cigar_blocks("cigar", "ref_start"))
    return j.select("alignment_id", F.inline(pairs), cigar.query_start("cigar").alias("clipped"), cigar.reference_length("cigar").alias("covered"))


@query("alignment_metrics", f"WITH j AS ({_JUNCTION}) SELECT concat_ws(':', id, d, a) AS alignment_id, x + y + 4 AS n_match, 1 AS n_mismatch, 3 AS n_insert, 2 AS n_delete, true AS complete FROM j")
def _(t):
    return aggregates.alignment_metrics(cigar.alignment_blocks(_alignments(t)))


_BLOCKS = "SELECT l_orderkey AS alignment_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS block_index, l_linenumber * 1000 + l_partkey % 10 * 10 AS ref_start, l_linenumber * 1000 + l_partkey % 10 * 10 + 200 AS ref_end FROM lineitem"


def _blocks(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    start = F.col("l_linenumber").cast("long") * 1000 + F.col("l_partkey") % 10 * 10
    return t.lineitem.select(F.col("l_orderkey").alias("alignment_id"), (F.row_number().over(w) - 1).alias("block_index"), start.alias("ref_start"), (start + 200).alias("ref_end"))


@query("aggregate_junctions", f"""
WITH b AS ({_BLOCKS}), j AS (SELECT alignment_id, ref_end AS donor_pos, lead(ref_start) OVER (PARTITION BY alignment_id ORDER BY block_index) AS acceptor_pos FROM b),
k AS (SELECT o_custkey % 5 AS contig_id, CASE WHEN o_orderstatus = 'O' THEN '+' ELSE '-' END AS strand, donor_pos, acceptor_pos FROM j JOIN orders ON alignment_id = o_orderkey WHERE acceptor_pos IS NOT NULL)
SELECT contig_id, strand, donor_pos, acceptor_pos, count(*) AS read_count, donor_pos % 3 = 0 AND acceptor_pos % 2 = 0 AS annotated FROM k GROUP BY ALL""")
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("alignment_id"), (F.col("o_custkey") % 5).alias("contig_id"), F.when(F.col("o_orderstatus") == "O", "+").otherwise("-").alias("strand"))
    found = clustering.junctions(_blocks(t), a)
    known = found.where("donor_pos % 3 = 0 AND acceptor_pos % 2 = 0").select("contig_id", "donor_pos", "acceptor_pos")
    return clustering.aggregate_junctions(found, annotated=known)


@query("splice_sites", f"""
WITH b AS ({_BLOCKS}), n AS (SELECT alignment_id % 7 AS contig_id, ref_end AS d, lead(ref_start) OVER (PARTITION BY alignment_id ORDER BY ref_start) AS a FROM b)
SELECT DISTINCT 'donor' AS site, contig_id, d AS pos FROM n WHERE a IS NOT NULL UNION ALL SELECT DISTINCT 'acceptor', contig_id, a FROM n WHERE a IS NOT NULL""")
def _(t):
    exons = _blocks(t).select((F.col("alignment_id") % 7).alias("contig_id"), F.col("alignment_id").alias("parent_id"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))
    donors, acceptors = clustering.annotation_splice_sites(exons)
    return donors.select(F.lit("donor").alias("site"), "contig_id", "pos").unionByName(acceptors.select(F.lit("acceptor").alias("site"), "contig_id", "pos"))


@query("exon_psi", """
WITH s AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS exon_id, CASE WHEN l_linenumber <= 3 THEN l_linenumber ELSE -1 END AS sample_id, CASE WHEN l_quantity > 25 THEN 'spanning' ELSE 'partial' END AS role, l_partkey FROM lineitem),
p AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS exon_id FROM lineitem WHERE l_returnflag = 'R'),
j AS (SELECT s.*, p.a IS NOT NULL AS inside FROM s LEFT JOIN p ON s.a = p.a AND s.exon_id = p.exon_id)
SELECT exon_id, sample_id, count(*) FILTER (inside) AS inclusion, count(*) FILTER (NOT inside AND role = 'spanning') AS exclusion, count(*) FILTER (NOT inside AND role <> 'spanning') AS ambiguous, CAST(count(*) FILTER (inside) / nullif(count(*) FILTER (inside OR role = 'spanning'), 0) AS FLOAT) AS psi FROM j GROUP BY ALL""")
def _(t):
    s = t.lineitem.select(F.col("l_orderkey").alias("alignment_id"), F.col("l_suppkey").alias("exon_id"), F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")).alias("sample_id"), F.when(F.col("l_quantity") > 25, "spanning").otherwise("partial").alias("role"), "l_partkey").distinct()
    p = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("alignment_id"), F.col("l_suppkey").alias("exon_id"))
    return aggregates.exon_psi(p, s)


# --- reads -------------------------------------------------------------------------------------------------------

@query("read_statuses", """
WITH f AS (SELECT event_id, event_type = 'view' OR value > 40 AS a, value > 15 AS b, event_type <> 'error' AS c, user_id % 3 = 0 AS d FROM events),
s AS (SELECT event_id, CASE WHEN a AND b AND c THEN 'Complete' WHEN b AND c THEN '3'' Only' WHEN a AND b THEN 'Missing Barcode' WHEN a THEN '5'' Only' ELSE 'Unknown' END AS f, CASE WHEN d AND b AND c THEN 'Complete' WHEN b AND c THEN '3'' Only' WHEN d AND b THEN 'Missing Barcode' WHEN d THEN '5'' Only' ELSE 'Unknown' END AS r FROM (SELECT event_id, coalesce(a, false) AS a, coalesce(b, false) AS b, coalesce(c, false) AS c, coalesce(d, false) AS d FROM f))
SELECT event_id, f AS forward, r AS reverse, CASE WHEN r = 'Unknown' THEN '+' WHEN f = 'Unknown' THEN '-' WHEN f = 'Complete' AND r <> 'Complete' THEN '+' WHEN r = 'Complete' AND f <> 'Complete' THEN '-' ELSE '+' END AS strand, r <> 'Unknown' AND f <> 'Unknown' AND (f = 'Complete') = (r = 'Complete') AS complex FROM s""")
def _(t):
    a, b, c, d = (F.col("event_type") == "view") | (F.col("value") > 40), F.col("value") > 15, F.col("event_type") != "error", F.col("user_id") % 3 == 0
    s = t.events.select("event_id", sequence.read_status(a, b, c).alias("forward"), sequence.read_status(d, b, c).alias("reverse"))
    o = sequence.pick_orientation(F.col("forward"), F.col("reverse"))
    return s.select("event_id", "forward", "reverse", o["strand"].alias("strand"), o["complex"].alias("complex"))


_ADAPTER, _PRIMER = "GATTACAGATTACAGG", "GTGTGTGTCAGTCACC"
_BARCODES = {"b1": "CCCCTTTTCCTT", "b2": "GGGGAAAAGGCC", "b3": "ATATCGCGATCG"}


@query("demultiplexed", f"""
SELECT p_partkey AS read_id, CASE WHEN p_partkey % 4 = 3 THEN 'Unknown' WHEN p_partkey % 4 = 2 THEN '3'' Only' ELSE 'Complete' END AS status, CASE WHEN p_partkey % 4 < 3 THEN 'b' || CAST(p_partkey % 3 + 1 AS VARCHAR) END AS barcode,
CASE WHEN p_partkey % 4 = 1 THEN '-' ELSE '+' END AS strand, CAST(CASE WHEN p_partkey % 4 = 3 THEN 300 WHEN p_partkey % 4 = 2 THEN 120 + p_size * 3 ELSE 136 + p_size * 3 END AS INTEGER) AS "end" FROM part""")
def _(t):
    # body of CGT and size repeats, behind it poly-A, barcode and primer; the adapter stands after up to 150 other bases
    body = F.concat(F.repeat(F.lit("CGT"), 40), F.repeat(F.lit("CTC"), F.col("p_size")))
    code = F.element_at(F.array(*[F.lit(b) for b in _BARCODES.values()]), (F.col("p_partkey") % 3 + 1).cast("int"))
    behind = F.concat(F.repeat(F.lit("A"), 30), code, F.lit(_PRIMER))
    whole = F.concat(F.lit(_ADAPTER), body, behind)
    kind = F.col("p_partkey") % 4
    seq = F.when(kind == 0, whole).when(kind == 1, sequence.reverse_complement(whole)).when(kind == 2, F.concat(body, behind)).otherwise(F.repeat(F.lit("CCT"), 100))
    d = reads.demultiplex(t.part.select(F.col("p_partkey").alias("read_id"), seq.alias("sequence")), adapter5=_ADAPTER, primer3=_PRIMER, barcodes=_BARCODES)
    return d.select("read_id", "status", "barcode", "strand", "end")


@query("best_barcodes", """
WITH d AS (SELECT n_name, x.n, levenshtein(upper(left(n_name, 8)), x.b) AS d FROM nation, (VALUES ('a', 'NATION_1'), ('b', 'NATION_2'), ('c', 'NATIONAL')) x(n, b)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY d, n) AS k, lead(d) OVER (PARTITION BY n_name ORDER BY d, n) AS nx FROM d)
SELECT n_name, CASE WHEN d <= 2 THEN n END AS barcode, CAST(CASE WHEN d <= 2 THEN d END AS INTEGER) AS distance, CAST(CASE WHEN d <= 2 THEN nx - d END AS INTEGER) AS delta FROM k WHERE k = 1""")
def _(t):
    b = sequence.best_barcode(F.upper(F.substring("n_name", 1, 8)), {"a": "NATION_1", "b": "NATION_2", "c": "NATIONAL"}, 2)
    return t.nation.select("n_name", b["barcode"].alias("barcode"), b["distance"].alias("distance"), b["delta"].alias("delta"))


@query("kmer_runs", """SELECT p_partkey, CAST(len(x) AS INTEGER) AS runs, x[1] AS first_run FROM (SELECT p_partkey, regexp_extract_all(repeat('AC', p_size % 6) || 'GG' || repeat('AC', p_size % 4), '((?:AC){2,})', 1) AS x FROM part)""")
def _(t):
    s = F.concat(F.repeat(F.lit("AC"), F.col("p_size") % 6), F.lit("GG"), F.repeat(F.lit("AC"), F.col("p_size") % 4))
    x = t.part.select("p_partkey", sequence.kmer_runs(s, "AC").alias("x"))
    return x.select("p_partkey", F.size("x").alias("runs"), F.try_element_at("x", F.lit(1)).alias("first_run"))


@query("located_texts", "SELECT p_partkey, CAST(0 AS INTEGER) AS distance, CAST(p_size AS INTEGER) AS start, CAST(p_size + 8 AS INTEGER) AS \"end\" FROM part")
def _(t):
    s = F.concat(F.repeat(F.lit("C"), F.col("p_size")), F.lit("GATTAGAT"), F.lit("TTTT"))
    x = t.part.select("p_partkey", sequence.locate("GATTAGAT", s, 1).alias("l"))
    return x.select("p_partkey", F.col("l.distance").alias("distance"), F.col("l.start").alias("start"), F.col("l.end").alias("end"))


@query("decoded_quality", "SELECT p_partkey, list_sum(list_transform(string_split(p_name, ''), lambda c: ascii(c) - 33))::BIGINT AS total, CAST(len(p_name) AS INTEGER) AS n FROM part")
def _(t):
    q = sequence.decode_phred("p_name")
    return t.part.select("p_partkey", F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(q).alias("n"))


@query("read_samples", """
WITH s AS (SELECT user_id AS read_id, event_id AS i, event_type, user_id % 4 + event_id % 3 AS b FROM events), last AS (SELECT read_id, arg_max(b, i) AS barcode_id FROM s WHERE event_type = 'click' GROUP BY 1),
e AS (SELECT n_nationkey % 4 AS acq, n_nationkey % 6 AS barcode_id, min(n_nationkey) AS sample_id FROM nation GROUP BY 1, 2 HAVING n_nationkey % 4 = 1)
SELECT DISTINCT s.read_id, last.barcode_id, e.sample_id FROM s LEFT JOIN last USING (read_id) LEFT JOIN e ON e.barcode_id = last.barcode_id""")
def _(t):
    s = t.events.select(F.col("user_id").alias("read_id"), F.col("event_id").alias("segment_index"), F.when(F.col("event_type") == "click", "barcode").otherwise("other").alias("kind"), (F.col("user_id") % 4 + F.col("event_id") % 3).alias("barcode_id"))
    e = t.nation.select((F.col("n_nationkey") % 4).alias("acquisition_id"), (F.col("n_nationkey") % 6).cast("long").alias("barcode_id"), F.col("n_nationkey").alias("sample_id"))
    return relational.resolve_samples(s.select("read_id").distinct(), s, e, 1).select("read_id", "barcode_id", "sample_id")


@query("preferred_classes", """
WITH c AS (SELECT l_partkey AS peptide, CASE l_linenumber WHEN 1 THEN 'snp' WHEN 2 THEN 'insertion' WHEN 3 THEN 'deletion' WHEN 4 THEN 'complex' ELSE 'unknown' END AS class, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 9 END AS r, l_quantity AS abundance, CAST(l_orderkey AS VARCHAR) AS protein_id FROM lineitem)
SELECT peptide, class, protein_id FROM (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY r, abundance DESC, protein_id) AS k FROM c) WHERE k = 1""")
def _(t):
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "snp").when(n == 2, "insertion").when(n == 3, "deletion").when(n == 4, "complex").otherwise("unknown")
    c = t.lineitem.select(F.col("l_partkey").alias("peptide"), kind.alias("class"), F.col("l_quantity").alias("abundance"), F.col("l_orderkey").cast("string").alias("protein_id"))
    return reads.prefer_class(c).select("peptide", "class", "protein_id")


@query("peptide_classes", """
SELECT p, CASE WHEN length(p) < 9 THEN 'non_reference' WHEN length(p) % 3 = 0 THEN 'snp' WHEN length(p) % 3 = 1 THEN 'insertion' ELSE 'deletion' END AS class FROM (SELECT DISTINCT upper(trim(PeptideSeq)) AS p FROM entries WHERE trim(PeptideSeq) <> '')""")
def _(t):
    from sparkloom.columns import peptide_key

    s = t.entries.select(peptide_key("PeptideSeq").alias("p")).distinct().dropna()
    n, p = F.length("p"), F.col("p")
    third = F.substring("p", 3, 1)
    other = F.when(third == "W", "G").otherwise("W")
    head, tail = F.substring("p", 1, 2), F.expr("substring(p, 4)")
    reference = F.when(n % 3 == 0, F.concat(head, other, tail)).when(n % 3 == 1, F.concat(head, tail)).otherwise(F.concat(head, F.lit("W"), third, tail))
    num = lambda x: x.cast("string")
    edit = F.when(n % 3 == 0, F.concat(num(n), F.lit("M"))).when(n % 3 == 1, F.concat(F.lit("2M1I"), num(n - 3), F.lit("M"))).otherwise(F.concat(F.lit("2M1D"), num(n - 2), F.lit("M")))
    rows = s.select("p", p.alias("peptide"), p.alias("protein_seq"), F.when(n >= 9, reference).alias("reference_seq"), F.lit(1).alias("qstart"), F.lit(1).alias("tstart"), edit.alias("cigar"))
    return reads.classify_peptides(rows).select("p", "class")


# --- atoms -------------------------------------------------------------------------------------------------------

_NAMES = ["N", "CA", "C", "O", "CB", "SG", "OXT"]
_ELEMENTS = ["N", "C", "C", "O", "C", "S", "O"]
_RES = [*relational.RESIDUES, "HOH", "LIG"]
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_ATOMS = f"WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS atom_id, l_returnflag AS chain_id, l_partkey % 90 AS res_seq, {_LIST(_RES)}[l_suppkey % 22 + 1] AS res_name, {_LIST(_NAMES)}[(l_linenumber - 1) % 7 + 1] AS name, {_LIST(_ELEMENTS)}[(l_linenumber - 1) % 7 + 1] AS element, l_linestatus = 'O' AS is_hetatm, l_suppkey % 40 AS frame_id, l_partkey * 7 % 97 / 4.0 AS x, l_orderkey % 89 / 5.0 AS y, l_quantity / 3.0 AS z FROM lineitem) "


def _atoms(t):
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    n = (F.col("l_linenumber") - 1) % 7
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("atom_id"), F.col("l_returnflag").alias("chain_id"), (F.col("l_partkey") % 90).alias("res_seq"), pick(_RES, F.col("l_suppkey") % 22).alias("res_name"), pick(_NAMES, n).alias("name"), pick(_ELEMENTS, n).alias("element"), (F.col("l_linestatus") == "O").alias("is_hetatm"), (F.col("l_suppkey") % 40).alias("frame_id"), (F.col("l_partkey") * 7 % 97 / 4.0).alias("x"), (F.col("l_orderkey") % 89 / 5.0).alias("y"), (F.col("l_quantity") / 3.0).cast("double").alias("z"))


_PROTEIN = "res_name NOT IN ('HOH', 'LIG')"
_BACK = "name IN ('N', 'CA', 'C', 'O')"


@query("atom_selections", _ATOMS + f"SELECT frame_id, count(*) FILTER (chain_id = 'A') AS chain, count(*) FILTER (res_seq BETWEEN 10 AND 40 AND chain_id = 'R') AS residues, count(*) FILTER (res_name IN ('GLY', 'PRO')) AS resname, count(*) FILTER (name IN ('CA', 'CB')) AS names, count(*) FILTER ({_BACK}) AS backbone, count(*) FILTER ({_PROTEIN}) AS protein, count(*) FILTER ({_PROTEIN} AND NOT {_BACK}) AS sidechain, count(*) FILTER (res_name = 'HOH') AS water, count(*) FILTER (is_hetatm) AS hetatm, count(*) FILTER (element = 'S') AS sulphur FROM a GROUP BY frame_id")
def _(t):
    s = relational
    kinds = {"chain": s.select_chain("A"), "residues": s.select_residues(10, 40, "R"), "resname": s.select_resname("GLY", "PRO"), "names": s.select_atom_names("CA", "CB"), "backbone": s.select_backbone(), "protein": s.select_protein(), "sidechain": s.select_sidechain(), "water": s.select_water(), "hetatm": s.select_hetatm(), "sulphur": s.select_element("S")}
    return _atoms(t).groupBy("frame_id").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])


@query("frame_subset", _ATOMS + f"SELECT atom_id, frame_id, count(*) AS n FROM a WHERE frame_id IN (3, 5, 8) AND atom_id IN (SELECT atom_id FROM a WHERE {_BACK} AND {_PROTEIN}) GROUP BY ALL")
def _(t):
    a = _atoms(t)
    _, coords = relational.subset_frames(a.select("atom_id", "name", "res_name"), a.select("atom_id", "frame_id", "x"), relational.select_backbone() & relational.select_protein(), [3, 5, 8])
    return coords.groupBy("atom_id", "frame_id").agg(F.count(F.lit(1)).alias("n"))


@query("induced_bonds", _ATOMS + ", d AS (SELECT DISTINCT atom_id, name FROM a), k AS (SELECT atom_id, name, row_number() OVER (ORDER BY atom_id) - 1 AS new_id FROM (SELECT atom_id, min(name) AS name FROM d GROUP BY 1) WHERE name <> 'OXT'), b AS (SELECT DISTINCT atom_id AS i, atom_id + 1 AS j FROM a) SELECT p.new_id AS i, q.new_id AS j FROM b JOIN k p ON p.atom_id = b.i JOIN k q ON q.atom_id = b.j")
def _(t):
    a = _atoms(t).groupBy("atom_id").agg(F.min("name").alias("name"))
    b = a.select(F.col("atom_id").alias("i"), (F.col("atom_id") + 1).alias("j"))
    return relational.induced_topology(a, b, a.where("name <> 'OXT'"))[1].select("i", "j")


@query("residue_groups", _ATOMS + "SELECT chain_id, res_seq, frame_id AS ins_code, min(res_name) AS res_name, min(atom_id) AS first_atom, count(*) AS n_atoms FROM a GROUP BY ALL")
def _(t):
    return structure.residue_groups(_atoms(t).withColumnRenamed("frame_id", "ins_code"))


@query("chain_order", _ATOMS + "SELECT chain_id, min(atom_id) AS first_atom FROM a GROUP BY 1")
def _(t):
    return structure.chain_ids(_atoms(t))


_MASSES = "CASE element " + " ".join(f"WHEN '{e}' THEN {chem.mass_of({e: 1}, average=True)!r}::DOUBLE" for e in dict.fromkeys(_ELEMENTS)) + " END"


@query("frame_geometry", _ATOMS + f""", m AS (SELECT *, {_MASSES} AS w FROM a)
SELECT frame_id, round(avg(x), 6) AS cx, round(sum(w * y) / sum(w), 6) AS my, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rg, round(2 * count(*) * (var_pop(x) + var_pop(y) + var_pop(z)), 2) AS inertia, round(avg(-y) + 1, 6) AS turned FROM m GROUP BY frame_id""")
def _(t):
    a = _atoms(t)
    coords = a.select("atom_id", "frame_id", "x", "y", "z")
    one = structure.centroid(coords).select("frame_id", r("x", 6).alias("cx"))
    # an atom number may stand there twice: weights come from its own row
    mass = F.create_map(*[F.lit(v) for e in dict.fromkeys(_ELEMENTS) for v in (e, chem.mass_of({e: 1}, average=True))])
    two = structure.centroid(a, F.element_at(mass, F.col("element"))).select("frame_id", r("y", 6).alias("my"))
    three = structure.radius_of_gyration(coords).select("frame_id", r("rg", 6).alias("rg"))
    axes = structure.principal_axes(coords).select("frame_id", r(F.aggregate("moments", F.lit(0.0), lambda s, v: s + v), 2).alias("inertia"))
    turned = structure.centroid(structure.translate(structure.rotate(coords, [[0, -1, 0], [1, 0, 0], [0, 0, 1]]), 1, 0, 0)).select("frame_id", r("x", 6).alias("turned"))
    return one.join(two, "frame_id").join(three, "frame_id").join(axes, "frame_id").join(turned, "frame_id")


_RADII = "CASE element " + " ".join(f"WHEN '{e}' THEN {structure.RADII[e]!r}::DOUBLE" for e in dict.fromkeys(_ELEMENTS) if e in structure.RADII) + " END"


@query("inferred_bonds", f"""
WITH a AS (SELECT p_partkey AS atom_id, {_LIST(_ELEMENTS)}[p_partkey % 7 + 1] AS element, p_partkey % 50 AS frame_id, p_partkey * 13 % 101 / 8.0 AS x, p_partkey * 29 % 103 / 8.0 AS y, p_partkey * 31 % 107 / 8.0 AS z FROM part), q AS (SELECT *, {_RADII} AS r FROM a)
SELECT p.frame_id, p.atom_id AS i, q.atom_id AS j FROM q AS p JOIN q ON p.frame_id = q.frame_id AND p.atom_id < q.atom_id WHERE sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) <= p.r + q.r + 0.45""")
def _(t):
    k = F.col("p_partkey")
    a = t.part.select(k.alias("atom_id"), F.element_at(F.array(*[F.lit(e) for e in _ELEMENTS]), (k % 7 + 1).cast("int")).alias("element"), (k % 50).alias("frame_id"), (k * 13 % 101 / 8.0).alias("x"), (k * 29 % 103 / 8.0).alias("y"), (k * 31 % 107 / 8.0).alias("z"))
    return structure.infer_bonds(a.select("atom_id", "element"), a.select("atom_id", "frame_id", "x", "y", "z")).select("frame_id", "i", "j")


# --- densities ---------------------------------------------------------------------------------------------------

_lg = math.lgamma
_U = "(o_orderkey * 37 % 997 + 0.5) / 998.0"


@query("log_densities", f"""
WITH u AS (SELECT o_orderkey, {_U} AS u, o_orderkey % 97 / 10.0 + 0.1 AS v FROM orders)
SELECT o_orderkey, round(({_lg(2.5)!r} - {_lg(2.0)!r} - 0.5 * ln(4 * pi()) - ln(1.5) - 2.5 * ln(1 + pow((v - 3) / 1.5, 2) / 4))::DOUBLE, 6) AS student_t, round((ln(1.7) - ln(2 * 2.0) - {_lg(1 / 1.7)!r} - pow(abs(v - 3) / 2.0, 1.7))::DOUBLE, 6) AS generalized, round((1.5 * ln(u) + 2 * ln(1 - u) + {_lg(5.5)!r} - {_lg(2.5)!r} - {_lg(3.0)!r})::DOUBLE, 6) AS beta, round((2.2 * ln(0.7) + 1.2 * ln(v) - 0.7 * v - {_lg(2.2)!r})::DOUBLE, 6) AS gamma, round((-0.5 * pow((ln(v) - 1) / 0.8, 2) - ln(0.8) - {0.5 * math.log(2 * math.pi)!r} - ln(v))::DOUBLE, 6) AS lognormal FROM u""")
def _(t):
    u = t.orders.select("o_orderkey", ((F.col("o_orderkey") * 37 % 997 + 0.5) / 998.0).alias("u"), (F.col("o_orderkey") % 97 / 10.0 + 0.1).alias("v"))
    d = stats.log_density
    return u.select("o_orderkey", r(d("student_t", "v", 4.0, 3.0, 1.5), 6).alias("student_t"), r(d("generalized_normal", "v", 3.0, 2.0, 1.7), 6).alias("generalized"), r(d("beta", "u", 2.5, 3.0), 6).alias("beta"), r(d("gamma", "v", 2.2, 0.7), 6).alias("gamma"), r(d("lognormal", "v", 1.0, 0.8), 6).alias("lognormal"))


_COUNTS = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 40)) AS k, list_transform(embedding, lambda x: abs(x::DOUBLE) + 0.01) AS a FROM embeddings), p AS (SELECT vec_id, k, a, list_transform(a, lambda x: x / list_sum(a)) AS p FROM v) "


@query("array_densities", _COUNTS + """
SELECT vec_id, round(lgamma(list_sum(k) + 1) - list_sum(list_transform(k, lambda x: lgamma(x + 1))) + list_sum(list_transform(list_zip(k, p), lambda t: t[1] * ln(t[2]))), 3) AS multinomial,
round(lgamma(list_sum(a)) - list_sum(list_transform(a, lambda x: lgamma(x))) + list_sum(list_transform(list_zip(a, p), lambda t: (t[1] - 1) * ln(t[2]))), 3) AS dirichlet,
round(lgamma(list_sum(k) + 1) + lgamma(list_sum(a)) - lgamma(list_sum(k) + list_sum(a)) + list_sum(list_transform(list_zip(k, a), lambda t: lgamma(t[1] + t[2]) - lgamma(t[2]) - lgamma(t[1] + 1))), 3) AS compound FROM p""")
def _(t):
    e = F.col("embedding").cast("array<double>")
    v = t.embeddings.select("vec_id", F.transform(e, lambda x: F.floor(F.abs(x) * 40).cast("double")).alias("k"), F.transform(e, lambda x: F.abs(x) + 0.01).alias("a"))
    v = v.withColumn("p", vectors.l1_normalize("a"))
    d = stats.log_density
    return v.select("vec_id", r(d("multinomial", "k", F.col("p")), 3).alias("multinomial"), r(d("dirichlet", "p", F.col("a")), 3).alias("dirichlet"), r(d("dirichlet_multinomial", "k", F.col("a")), 3).alias("compound"))


@query("count_deviance", _VEC + """
, a AS (SELECT vec_id, e AS signed, c AS centre, list_transform(e, lambda x: abs(x)) AS e, list_transform(c, lambda x: abs(x) + 0.001) AS c FROM v), n AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p, list_transform(c, lambda x: x / list_sum(c)) AS q FROM a)
SELECT vec_id, round(list_cosine_similarity(signed, centre), 4) AS dot, round(2 * list_sum(list_transform(list_zip(e, p, q), lambda t: CASE WHEN t[2] > 0 THEN t[1] * ln(t[2] / t[3]) ELSE 0 END)), 3) AS deviance, round(list_aggregate(p, 'max'), 5) AS top FROM n""")
def _(t):
    p = _pairs(t)
    a = p.select("vec_id", F.col("e").alias("signed"), F.col("c").alias("centre"), F.transform("e", F.abs).alias("e"), F.transform("c", lambda x: F.abs(x) + 0.001).alias("c"))
    return a.select("vec_id", r(vectors.compare("signed", "centre", "normalized_dot")).alias("dot"), r(vectors.compare("e", "c", "deviance", pseudocount=0.0), 3).alias("deviance"), r(F.array_max(vectors.l1_normalize("e")), 5).alias("top"))


# --- chemistry ---------------------------------------------------------------------------------------------------

_C, _H, _O = (chem.mass_of({e: 1}) for e in "CHO")


@query("formula_masses", f"SELECT p_partkey, round((p_size * {_C!r} + (2 * p_size + 2) * {_H!r} + (p_partkey % 5 + 1) * {_O!r})::DOUBLE, 5) AS mass, round((10 * (500 + p_size) * 1e-6)::DOUBLE, 9) AS da, round((p_size * 0.001 / 500 * 1e6)::DOUBLE, 6) AS ppm FROM part")
def _(t):
    n = F.col("p_size")
    f = F.concat(F.lit("C"), n.cast("string"), F.lit("H"), (2 * n + 2).cast("string"), F.lit("O"), (F.col("p_partkey") % 5 + 1).cast("string"))
    return t.part.select("p_partkey", r(chem.formula_mass(chem.parse_formula(f)), 5).alias("mass"), r(chem.ppm_to_da(F.lit(10.0), 500.0 + n), 9).alias("da"), r(chem.da_to_ppm(n * 0.001, F.lit(500.0)), 6).alias("ppm"))


# --- networks ----------------------------------------------------------------------------------------------------

_EDGES = "WITH e AS (SELECT DISTINCT upper(trim(PeptideSeq)) AS src, ProteinAccession AS dst FROM peptidetoprotein WHERE trim(PeptideSeq) <> '') "


@query("edge_lookup", _EDGES + ", k AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT src, 'CST0000000' FROM e) SELECT k.src, k.dst, EXISTS (SELECT 1 FROM e WHERE (e.src = k.src AND e.dst = k.dst) OR (e.src = k.dst AND e.dst = k.src)) AS has_edge FROM k")
def _(t):
    _, e = _network(t)
    pairs = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(e.select("src", F.lit("CST0000000").alias("dst"))).distinct()
    return graph.has_edge(e, pairs)


@query("node_neighbors", _EDGES + "SELECT DISTINCT src AS node FROM e WHERE dst = 'CST0000000' UNION SELECT dst FROM e WHERE src = 'CST0000000'")
def _(t):
    return graph.neighbors(_network(t)[1], "CST0000000")


# --- traces ------------------------------------------------------------------------------------------------------

@query("channel_counts", "SELECT spectrum_index, round(sum(CASE WHEN x IS NULL THEN 0 ELSE x END), 3) AS total FROM (SELECT DISTINCT spectrum_index, precursor_name, fraction, ion_injection_time, isolation_window_lower, unnest(intensity_list)::DOUBLE AS x FROM dia_spectra) GROUP BY 1")
def _(t):
    x = t.dia_spectra.select("spectrum_index", "precursor_name", "fraction", "ion_injection_time", "isolation_window_lower", F.explode("intensity_list").alias("x")).distinct()
    return x.groupBy("spectrum_index").agg(r(F.sum(F.coalesce(F.col("x").cast("double"), F.lit(0.0))), 3).alias("total"))


@query("exact_errors", """
WITH t AS (SELECT DISTINCT l_orderkey AS scan, l_partkey AS target_id, l_linenumber AS ion, l_quantity AS mz FROM lineitem), p AS (SELECT l_orderkey AS scan, l_quantity + l_linenumber / 100.0 AS mz, l_extendedprice AS intensity FROM lineitem),
k AS (SELECT t.target_id, t.ion, t.scan, p.mz, row_number() OVER (PARTITION BY t.target_id, t.ion, t.scan ORDER BY abs(p.mz - t.mz), p.mz) AS k FROM t JOIN p USING (scan))
SELECT target_id, ion, scan, round(mz, 4) AS mz, round((mz - 50) / 50 * 1e6, 2) AS mz_error_ppm FROM k WHERE k = 1""")
def _(t):
    q = F.col("l_quantity").cast("double")
    traces = t.lineitem.select(F.col("l_orderkey").alias("scan"), F.col("l_partkey").alias("target_id"), F.col("l_linenumber").alias("ion"), q.alias("mz"), F.lit(0.0).alias("intensity"), F.lit(50.0).alias("ion_mz")).distinct()
    peaks = t.lineitem.select(F.col("l_orderkey").alias("scan"), (q + F.col("l_linenumber") / 100.0).alias("mz"), F.col("l_extendedprice").cast("double").alias("intensity"))
    return targets.exact_errors(traces, peaks).select("target_id", "ion", "scan", r("mz").alias("mz"), r("mz_error_ppm", 2).alias("mz_error_ppm"))


@query("residuals", """
WITH o AS (SELECT l_orderkey, sum(l_extendedprice) AS i FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey, o_totalprice AS i FROM orders WHERE o_orderkey % 3 <> 0)
SELECT l_orderkey, round(o.i - coalesce(p.i, 0), 2) AS residual FROM o LEFT JOIN p ON l_orderkey = o_orderkey""")
def _(t):
    o = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("intensity"))
    p = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("intensity"))
    return stats.residual(o, p, "l_orderkey").select("l_orderkey", r("residual", 2).alias("residual"))


@query("region_peaks", "SELECT l_orderkey AS scan, l_quantity AS mz, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 AND (l_orderkey, l_quantity) NOT IN (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL")
def _(t):
    trace = t.lineitem.select(F.col("l_orderkey").alias("scan"), F.col("l_quantity").alias("mz"), "l_returnflag")
    return targets.region_peaks(trace, trace.where("l_returnflag = 'R'"), 10, 40).groupBy("scan", "mz").agg(F.count(F.lit(1)).alias("n"))


@query("novel_sequences", """
WITH c AS (SELECT 'p' || l_partkey AS protein_id, p_name AS sequence, l_quantity AS tpm FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT protein_id, sequence, avg(tpm) AS avg_tpm FROM c GROUP BY ALL HAVING avg(tpm) >= 20)
SELECT sequence, min(protein_id) AS protein_id FROM m WHERE sequence NOT IN (SELECT p_name FROM part WHERE p_name < 'm') GROUP BY 1""")
def _(t):
    c = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("protein_id"), F.col("p_name").alias("sequence"), F.col("l_quantity").alias("tpm"))
    return targets.novel_sequences(c, t.part.where("p_name < 'm'").select(F.col("p_name").alias("sequence")), least_tpm=20).select("sequence", "protein_id")


@query("library_network", "SELECT DISTINCT 'protein:' || ProteinAccession AS src, 'peptide:' || PeptideSeq AS dst FROM peptidetoprotein WHERE PeptideSeq IS NOT NULL AND ProteinAccession IS NOT NULL UNION SELECT 'peptide:' || PeptideSeq, 'precursor:' || PeptideModSeq FROM entries WHERE PeptideSeq IS NOT NULL AND PeptideModSeq IS NOT NULL")
def _(t):
    links = t.peptidetoprotein.dropna(subset=["PeptideSeq", "ProteinAccession"]).select(F.col("ProteinAccession").alias("protein_id"), F.col("PeptideSeq").alias("peptide_id"))
    own = t.entries.dropna(subset=["PeptideSeq", "PeptideModSeq"]).select(F.col("PeptideSeq").alias("peptide_id"), F.col("PeptideModSeq").alias("precursor_id"))
    return targets.library_network(links, own, tier="precursor")[1]
