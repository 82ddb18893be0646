"""Queries over the test tables for the engine's operators, with the same in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import chem, notation, sequence, stats, vectors
from sparkloom.functions.reads import nearest_in_panel
from sparkloom.operators import aggregates, clustering, consensus, coverage, graph, integrity, intervals, nearest, relational
from sparkloom.sources import sqlite
from sparkloom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query that takes the tables."""
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add


def r(c, digits: int = 4):
    return F.round(c, digits)


# --- filters and lookups -----------------------------------------------------------------------------------------

@query("filter_audit", """
WITH f AS (SELECT l_quantity >= 10 AS a, l_discount <= 0.08 AS b, l_returnflag <> 'R' AS c FROM lineitem)
SELECT 1 AS step, 'min_quantity' AS stage, count(*) FILTER (a) AS kept, count(*) - count(*) FILTER (a) AS dropped FROM f
UNION ALL SELECT 2, 'max_discount', count(*) FILTER (a AND b), count(*) FILTER (a) - count(*) FILTER (a AND b) FROM f
UNION ALL SELECT 3, 'not_returned', count(*) FILTER (a AND b AND c), count(*) FILTER (a AND b) - count(*) FILTER (a AND b AND c) FROM f""")
def _(t):
    return relational.filter_audit(t.lineitem, {"min_quantity": F.col("l_quantity") >= 10, "max_discount": F.col("l_discount") <= 0.08, "not_returned": F.col("l_returnflag") != "R"})


@query("trusted_seeds", """
SELECT intron_id, contig_id, donor_pos, acceptor_pos, read_count FROM introns WHERE is_intron_seed AND intron_id IN (SELECT intron_id FROM introns GROUP BY 1 HAVING sum(read_count) >= 20)""")
def _(t):
    return relational.trusted_rows(t.introns, "intron_id", "read_count", 20, F.col("is_intron_seed")).select("intron_id", "contig_id", "donor_pos", "acceptor_pos", "read_count")


@query("viewport_scan", "SELECT cluster_id, contig_id, span_start, span_end, n_reads FROM cluster_pileup WHERE span_end > 100000 AND span_start < 400000 AND mode = 'genome-guided'")
def _(t):
    return intervals.viewport(t.cluster_pileup, "span_start", "span_end", 100_000, 400_000, where=F.col("mode") == "genome-guided").select("cluster_id", "contig_id", "span_start", "span_end", "n_reads")


@query("viewport_longest", "SELECT DISTINCT cluster_id, span_start, span_end FROM cluster_pileup WHERE span_end > 0 AND span_start < 2000000 ORDER BY span_end - span_start DESC, span_start, cluster_id LIMIT 50")
def _(t):
    rows = t.cluster_pileup.select("cluster_id", "span_start", "span_end").distinct()
    return intervals.viewport(rows, "span_start", "span_end", 0, 2_000_000, limit=50, order=[F.desc(F.col("span_end") - F.col("span_start")), F.asc("span_start"), F.asc("cluster_id")])


@query("junction_viewport", """
WITH s AS (SELECT intron_id, CAST(sum(read_count) AS BIGINT) AS support FROM introns WHERE (donor_pos BETWEEN 0 AND 1500000) OR (acceptor_pos BETWEEN 0 AND 1500000) OR (donor_pos < 0 AND acceptor_pos > 1500000) GROUP BY 1)
SELECT intron_id, support FROM s ORDER BY support DESC, intron_id LIMIT 100""")
def _(t):
    d, a = F.col("donor_pos"), F.col("acceptor_pos")
    inside = d.between(0, 1_500_000) | a.between(0, 1_500_000) | ((d < 0) & (a > 1_500_000))
    return t.introns.where(inside).groupBy("intron_id").agg(F.sum("read_count").alias("support")).orderBy(F.desc("support"), "intron_id").limit(100)


@query("viewport_count", "SELECT count(*) AS n FROM cluster_pileup WHERE contig_id = 1003 AND span_end > 0 AND span_start < 1000000")
def _(t):
    return intervals.viewport(t.cluster_pileup, "span_start", "span_end", 0, 1_000_000, where=F.col("contig_id") == 1003).agg(F.count(F.lit(1)).alias("n"))


@query("search_substring", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') ORDER BY p_name, p_partkey LIMIT 40")
def _(t):
    return relational.search_text(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"], "Ring", limit=40, order=[F.asc("p_name"), F.asc("p_partkey")])


@query("best_by_precedence", """
SELECT c_nationkey, c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_custkey) AS k FROM customer) WHERE k = 1""")
def _(t):
    return relational.first_by_precedence(t.customer, "c_nationkey", "c_mktsegment", ["MACHINERY", "BUILDING"], F.asc("c_custkey")).select("c_nationkey", "c_custkey", "c_mktsegment")


@query("cascade_subset", """
SELECT count(*) AS n_lines, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE')))""")
def _(t):
    kept = relational.cascade(t.region.where("r_name = 'EUROPE'"), [(t.nation, "n_regionkey", "r_regionkey"), (t.supplier, "s_nationkey", "n_nationkey"), (t.lineitem, "l_suppkey", "s_suppkey")])
    return kept[-1].agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_linenumber").alias("s"))


@query("name_lookup", """
SELECT q AS query, CASE WHEN try_cast(q AS BIGINT) IS NOT NULL THEN (SELECT n_nationkey FROM nation WHERE n_nationkey = try_cast(q AS BIGINT)) ELSE (SELECT min(n_nationkey) FROM nation WHERE lower(n_name) = lower(q)) END AS taxid
FROM (VALUES ('3'), ('999'), ('nation_4'), ('NATION_7'), ('nobody')) v(q)""")
def _(t):
    names = t.nation.select(F.col("n_nationkey").alias("taxid"), F.col("n_name").alias("name"))
    merged = t.spark.createDataFrame([], "old_taxid long, new_taxid long")
    asked = t.spark.createDataFrame([("3",), ("999",), ("nation_4",), ("NATION_7",), ("nobody",)], "query string")
    return relational.lookup_taxid(names, merged, asked).withColumn("taxid", F.col("taxid").cast("int"))


# --- interval joins ----------------------------------------------------------------------------------------------

_SPANS = "WITH a AS (SELECT DISTINCT read_id, contig_id, strand, span_start, span_end FROM read_fingerprints WHERE span_end > span_start), g AS (SELECT intron_id, contig_id, strand AS g_strand, min(donor_pos) AS g_start, max(acceptor_pos) AS g_end FROM introns GROUP BY ALL HAVING max(acceptor_pos) > min(donor_pos)), "


def _spans(t):
    a = t.read_fingerprints.select("read_id", "contig_id", "strand", "span_start", "span_end").distinct()
    g = t.introns.groupBy("intron_id", "contig_id", F.col("strand").alias("g_strand")).agg(F.min("donor_pos").alias("g_start"), F.max("acceptor_pos").alias("g_end"))
    return a, g


@query("interval_best_overlap", _SPANS + """
j AS (SELECT *, least(span_end, g_end) - greatest(span_start, g_start) AS overlap FROM a JOIN g ON a.contig_id = g.contig_id AND (g_strand = '.' OR g_strand = strand) AND g_start < span_end AND g_end > span_start),
k AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY overlap DESC, g_start, intron_id) AS k FROM j)
SELECT read_id, intron_id, overlap, overlap / (span_end - span_start) AS fraction FROM k WHERE k = 1 AND overlap / (span_end - span_start) >= 0.5""")
def _(t):
    a, g = _spans(t)
    return intervals.best_overlap(a, g, "contig_id", "read_id", "span_start", "span_end", "intron_id", "g_start", "g_end", left_strand="strand", right_strand="g_strand")


@query("interval_fractions", _SPANS + """
j AS (SELECT *, least(span_end, g_end) - greatest(span_start, g_start) AS overlap FROM a JOIN g ON a.contig_id = g.contig_id AND g_start < span_end AND g_end > span_start)
SELECT read_id, intron_id, g_strand, overlap, overlap / (span_end - span_start) AS left_fraction, overlap / (g_end - g_start) AS right_fraction FROM j""")
def _(t):
    a, g = _spans(t)
    j = intervals.assign_overlaps(a, g, "contig_id", "span_start", "span_end", "g_start", "g_end")
    return j.select("read_id", "intron_id", "g_strand", "overlap", "left_fraction", "right_fraction")


@query("interval_span_roles", _SPANS + """
j AS (SELECT CASE WHEN span_start <= g_start AND span_end >= g_end THEN 'spanning' ELSE 'partial' END AS role FROM a JOIN g ON a.contig_id = g.contig_id AND g_start < span_end AND g_end > span_start)
SELECT role, count(*) AS n FROM j GROUP BY role""")
def _(t):
    a, g = _spans(t)
    return intervals.classify_span(a, g, "contig_id", "span_start", "span_end", "g_start", "g_end").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("overlaps_per_item", _SPANS + """
j AS (SELECT a.read_id, count(g.intron_id) AS n FROM a LEFT JOIN g ON a.contig_id = g.contig_id AND g_start < span_end AND g_end > span_start GROUP BY a.read_id)
SELECT n AS n_partners, count(*) AS n_items FROM j GROUP BY n""")
def _(t):
    a, g = _spans(t)
    a = a.where("span_end > span_start")
    return aggregates.overlaps_per_item(intervals.interval_join(a, g, "contig_id", "span_start", "span_end", "g_start", "g_end"), a, "read_id")


@query("isolation_windows", """
WITH w AS (SELECT DISTINCT isolation_window_lower AS lo, isolation_window_upper AS hi FROM dia_spectra WHERE isolation_window_lower IS NOT NULL AND isolation_window_upper IS NOT NULL),
m AS (SELECT avg(lo) AS lo, avg(hi) AS hi FROM w GROUP BY round(lo, 1), round(hi, 1))
SELECT round(lo, 3) AS lo, round(hi, 3) AS hi, (SELECT count(DISTINCT PrecursorMz) FROM entries WHERE PrecursorMz >= m.lo AND PrecursorMz < m.hi AND NOT EXISTS (SELECT 1 FROM m AS q WHERE (q.lo, q.hi) < (m.lo, m.hi) AND PrecursorMz >= q.lo AND PrecursorMz < q.hi)) AS n FROM m""")
def _(t):
    w = t.dia_spectra.select(F.col("isolation_window_lower").alias("a"), F.col("isolation_window_upper").alias("b")).dropna().distinct()
    m = intervals.merge_windows(w, "a", "b").select("lo", "hi", F.concat_ws("-", r("lo", 3), r("hi", 3)).alias("window"))
    found = intervals.assign_window(t.entries.select("PrecursorMz").distinct(), "PrecursorMz", m, "lo", "hi", "window").groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    return m.join(found, "window", "left").select(r("lo", 3).alias("lo"), r("hi", 3).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


# --- nearest and tolerance joins ---------------------------------------------------------------------------------

_AXIS = "WITH q AS (SELECT DISTINCT PrecursorMz AS mz FROM entries), p AS (SELECT DISTINCT unnest(mz_list) AS peak FROM dia_precursor), "


def _axis(t):
    return t.entries.select(F.col("PrecursorMz").alias("mz")).distinct(), t.dia_precursor.select(F.explode("mz_list").alias("peak")).distinct().withColumn("peak_id", F.col("peak"))


@query("nearest_within_ppm", _AXIS + """
k AS (SELECT mz, peak, row_number() OVER (PARTITION BY mz ORDER BY abs(mz - peak), peak) AS k FROM q JOIN p ON abs(mz - peak) <= mz * 2000 * 1e-6)
SELECT round(mz, 5) AS mz, round(peak, 5) AS peak, round(mz - peak, 5) AS delta FROM k WHERE k = 1""")
def _(t):
    q, p = _axis(t)
    n = nearest.nearest(q, p, "mz", "mz", "peak", "peak_id", 2000.0)
    return n.select(r("mz", 5).alias("mz"), r("peak", 5).alias("peak"), r("delta", 5).alias("delta"))


@query("all_within_da", _AXIS + "c AS (SELECT mz, peak FROM q JOIN p ON abs(mz - peak) <= 0.5) SELECT round(mz, 5) AS mz, count(*) AS n, round(min(peak), 5) AS lowest FROM c GROUP BY mz")
def _(t):
    q, p = _axis(t)
    return nearest.all_within(q, p, "mz", "peak", 0.5, "Da").groupBy("mz").agg(F.count(F.lit(1)).alias("n"), F.min("peak").alias("lowest")).select(r("mz", 5).alias("mz"), "n", r("lowest", 5).alias("lowest"))


@query("window_counts", _AXIS + "c AS (SELECT mz, count(peak) AS n FROM q LEFT JOIN p ON abs(mz - peak) <= mz * 1000 * 1e-6 GROUP BY mz) SELECT n, count(*) AS n_queries FROM c GROUP BY n")
def _(t):
    q, p = _axis(t)
    return nearest.window_counts(q, p, "mz", "mz", "peak", 1000.0).groupBy("n").agg(F.count(F.lit(1)).alias("n_queries"))


@query("match_list", _AXIS + """
c AS (SELECT mz, peak, abs(mz - peak) AS d, max(peak) OVER (PARTITION BY mz) - min(peak) OVER (PARTITION BY mz) <= mz * 1500 * 1e-6 AS few, row_number() OVER (PARTITION BY mz ORDER BY abs(mz - peak), peak) AS k FROM q JOIN p ON abs(mz - peak) <= mz * 1500 * 1e-6)
SELECT round(mz, 5) AS mz, round(peak, 5) AS peak FROM c WHERE few OR k = 1""")
def _(t):
    q, p = _axis(t)
    return nearest.match_list(q, p, "mz", "mz", "peak", "peak_id", 1500.0).select(r("mz", 5).alias("mz"), r("peak", 5).alias("peak"))


@query("extract_traces", """
WITH s AS (SELECT DISTINCT spectrum_index AS scan, scan_start_time_s AS rt, mz_list, intensity_list FROM dia_precursor),
p AS (SELECT DISTINCT scan, rt, unnest(mz_list) AS mz, unnest(intensity_list) AS intensity FROM s),
g AS (SELECT PeptideModSeq AS target_id, PrecursorCharge AS ion, min(PrecursorMz) AS ion_mz, min(RTInSeconds) - 600 AS lo, max(RTInSeconds) + 600 AS hi FROM entries GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY target_id, ion, scan ORDER BY abs(ion_mz - mz), mz, intensity DESC) AS k FROM g JOIN p ON abs(ion_mz - mz) <= ion_mz * 500 * 1e-6 AND rt >= lo AND rt <= hi)
SELECT target_id, ion, scan, round(mz, 4) AS mz, round(intensity, 1) AS intensity, round((mz - ion_mz) / ion_mz * 1e6, 3) AS mz_error_ppm FROM k WHERE k = 1""")
def _(t):
    s = t.dia_precursor.select(F.col("spectrum_index").alias("scan"), F.col("scan_start_time_s").alias("rt"), "mz_list", "intensity_list").distinct()
    peaks = s.select("scan", F.inline(F.arrays_zip(F.col("mz_list").alias("mz"), F.col("intensity_list").cast("array<double>").alias("intensity")))).distinct()
    none = F.lit(None).cast("double")
    scans = s.select("scan", F.lit(1).alias("level"), "rt", none.alias("isolation_lower"), none.alias("isolation_upper")).distinct()
    g = t.entries.groupBy(F.col("PeptideModSeq").alias("target_id"), F.col("PrecursorCharge").alias("ion")).agg(F.min("PrecursorMz").alias("ion_mz"), (F.min("RTInSeconds") - 600).alias("rt_start"), (F.max("RTInSeconds") + 600).alias("rt_end"))
    x = nearest.extract_traces(peaks, scans, g.withColumn("level", F.lit(1)).withColumn("precursor_mz", F.col("ion_mz")), 500.0)
    return x.select("target_id", "ion", "scan", r("mz").alias("mz"), r("intensity", 1).alias("intensity"), r("mz_error_ppm", 3).alias("mz_error_ppm"))


@query("shared_ions", """
WITH s AS (SELECT DISTINCT ON (spectrum_index) spectrum_index, fraction, isolation_window_lower AS w, mz_list FROM dia_spectra WHERE mz_list IS NOT NULL AND fraction IS NOT NULL AND isolation_window_lower IS NOT NULL),
p AS (SELECT spectrum_index AS b, mz_list AS mb, lag(spectrum_index) OVER (PARTITION BY fraction, w ORDER BY spectrum_index) AS a, lag(mz_list) OVER (PARTITION BY fraction, w ORDER BY spectrum_index) AS ma FROM s)
SELECT a, b, CAST(len(list_filter(ma, lambda x: len(list_filter(mb, lambda y: abs(x - y) < y * 5000 * 1e-6)) > 0)) AS INTEGER) AS shared FROM p WHERE a IS NOT NULL""")
def _(t):
    from pyspark.sql import Window

    s = t.dia_spectra.select("spectrum_index", "fraction", F.col("isolation_window_lower").alias("w"), "mz_list").dropna().dropDuplicates(["spectrum_index"])
    w = Window.partitionBy("fraction", "w").orderBy("spectrum_index")
    p = s.withColumn("a", F.lag("spectrum_index").over(w)).withColumn("ma", F.lag("mz_list").over(w)).where("a IS NOT NULL")
    return p.select("a", F.col("spectrum_index").alias("b"), nearest.shared_ions("ma", "mz_list", 5000.0).alias("shared"))


# --- joins and choices -------------------------------------------------------------------------------------------

@query("agreement_dedupe", "SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1 HAVING min(o_orderstatus) = max(o_orderstatus)")
def _(t):
    return relational.agreeing(t.orders, "o_custkey", "o_orderstatus")


@query("argmin_per_group", "SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def _(t):
    return relational.argmin_per_group(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"), "l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey").drop("l_suppkey")


@query("best_hit_per_query", """
SELECT "query", target, evalue, aligned_to FROM (SELECT l_partkey AS "query", CAST(l_suppkey AS VARCHAR) AS target, l_tax AS evalue, CASE WHEN l_linestatus = 'O' THEN 'reference' ELSE 'swissprot' END AS aligned_to,
row_number() OVER (PARTITION BY l_partkey ORDER BY l_tax, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, CAST(l_suppkey AS VARCHAR)) AS k FROM lineitem) WHERE k = 1""")
def _(t):
    hits = t.lineitem.select(F.col("l_partkey").alias("query"), F.col("l_suppkey").cast("string").alias("target"), F.col("l_tax").alias("evalue"), F.when(F.col("l_linestatus") == "O", "reference").otherwise("swissprot").alias("aligned_to"))
    return relational.best_hits(hits)


@query("significant_semi_join", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING min(l_discount) <= 0.0)")
def _(t):
    return relational.significant(t.part.select("p_partkey", "p_name"), t.lineitem, "p_partkey", "l_partkey", "l_discount", 0.0)


@query("anti_join_losers", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    return t.orders.select("o_orderkey").join(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("scan_status", """
WITH s AS (SELECT spectrum_index AS scan, min(fraction) AS level, min(scan_start_time_s) AS rt FROM dia_spectra GROUP BY 1),
e AS (SELECT DISTINCT spectrum_index + (fraction % 3) AS scan, scan_start_time_s AS rt FROM dia_spectra)
SELECT CASE WHEN e.scan IS NULL THEN 'no_scan_number' WHEN s.level IS NULL THEN 'scan_not_found' WHEN s.level <> 10 THEN 'wrong_level' WHEN e.rt IS NULL OR s.rt IS NULL THEN 'rt_missing' WHEN abs(e.rt - s.rt) > 5 THEN 'rt_mismatch' ELSE 'ok' END AS status, count(*) AS n
FROM e LEFT JOIN s ON e.scan = s.scan GROUP BY 1""")
def _(t):
    s = t.dia_spectra.groupBy(F.col("spectrum_index").alias("scan")).agg(F.min("fraction").alias("level"), F.min("scan_start_time_s").alias("rt"))
    e = t.dia_spectra.select((F.col("spectrum_index") + F.col("fraction") % 3).alias("scan"), F.col("scan_start_time_s").alias("rt")).distinct()
    return relational.scan_status(e, s, "scan", level=10, rt_tolerance=5.0).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("novel_set", """
SELECT DISTINCT upper(trim(PeptideSeq)) AS peptide FROM peptidetoprotein WHERE isDecoy AND trim(PeptideSeq) <> '' AND upper(trim(PeptideSeq)) NOT IN (SELECT upper(trim(PeptideSeq)) FROM peptidetoprotein WHERE NOT isDecoy AND trim(PeptideSeq) <> '')
AND upper(trim(PeptideSeq)) IN (SELECT upper(trim(PeptideSeq)) FROM entries)""")
def _(t):
    from sparkloom.columns import peptide_key

    key = lambda d: d.select(peptide_key("PeptideSeq").alias("peptide")).where("peptide IS NOT NULL")
    return relational.novel_items(key(t.peptidetoprotein.where("isDecoy")), key(t.peptidetoprotein.where("NOT isDecoy")), key(t.entries), "peptide")


@query("dedupe_exact", "SELECT min(doc_id) AS doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL GROUP BY text")
def _(t):
    d = relational.dedupe_first(t.documents.select("doc_id", "text").where("text IS NOT NULL"), "text", "doc_id")
    return d.select("doc_id", F.length("text").cast("long").alias("n"))


@query("union_prefer_left", """
SELECT PeptideModSeq, 'library' AS origin FROM (SELECT DISTINCT PeptideModSeq FROM entries WHERE Score > 0.5) UNION ALL
SELECT DISTINCT PeptideModSeq, 'times' FROM retentiontimes WHERE PeptideModSeq IS NOT NULL AND PeptideModSeq NOT IN (SELECT PeptideModSeq FROM entries WHERE Score > 0.5)""")
def _(t):
    a = t.entries.where("Score > 0.5").select("PeptideModSeq").distinct().withColumn("origin", F.lit("library"))
    b = t.retentiontimes.where("PeptideModSeq IS NOT NULL").select("PeptideModSeq").distinct().withColumn("origin", F.lit("times"))
    return relational.union_prefer_left(a, b, "PeptideModSeq")


@query("nest_children", """
SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN '0' ELSE string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) END AS lines
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def _(t):
    default = F.array(F.struct(F.lit(None).cast("int").alias("l_linenumber"), F.lit(None).cast("long").alias("l_partkey"), F.lit(None).cast("long").alias("l_suppkey")))
    n = relational.nest_children(t.orders.select("o_orderkey"), t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey").withColumn("i", F.struct("l_linenumber", "l_partkey", "l_suppkey")), "o_orderkey", "i", ["l_linenumber", "l_partkey", "l_suppkey"], "lines", default)
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return n.select("o_orderkey", F.when(F.col("lines")[0]["l_linenumber"].isNull(), "0").otherwise(text).alias("lines"))


@query("surrogate_ids", "SELECT PeptideModSeq, dense_rank() OVER (ORDER BY PeptideModSeq) - 1 AS id FROM (SELECT DISTINCT PeptideModSeq FROM entries)")
def _(t):
    return relational.dense_ids(t.entries.select("PeptideModSeq").distinct(), "PeptideModSeq", "id")


# --- aggregates --------------------------------------------------------------------------------------------------

@query("counts_tpm", """
WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS count FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, count, round(count * 1e6 / sum(count) OVER (PARTITION BY l_returnflag), 4) AS tpm FROM c""")
def _(t):
    return aggregates.counts_per_feature(t.lineitem, "l_suppkey", "l_returnflag").withColumn("tpm", r("tpm"))


@query("tpm_length_filter", """
WITH c AS (SELECT p_brand, p_type, p_size, count(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 20 GROUP BY ALL) SELECT p_brand, p_type, p_size, count, round(count * 1e6 / sum(count) OVER (PARTITION BY p_type), 4) AS tpm FROM c""")
def _(t):
    c = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type", "p_size").agg(F.count(F.lit(1)).alias("count"))
    return aggregates.per_million(c, "p_type", length="p_size", min_length=20).select("p_brand", "p_type", "p_size", "count", r("tpm").alias("tpm"))


@query("tpm_matrix", """
WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS count FROM lineitem GROUP BY ALL), t AS (SELECT *, count * 1e6 / sum(count) OVER (PARTITION BY l_returnflag) AS tpm FROM c)
SELECT l_suppkey, CAST(coalesce(sum(count) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS "A", CAST(coalesce(sum(count) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS "N", CAST(coalesce(sum(count) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS "R", round(avg(tpm), 4) AS avg_tpm FROM t GROUP BY l_suppkey""")
def _(t):
    return aggregates.tpm_matrix(aggregates.counts_per_feature(t.lineitem, "l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag", ["A", "N", "R"]).withColumn("avg_tpm", r("avg_tpm"))


@query("count_matrix", """
SELECT n_nationkey, n_name, count(*) FILTER (c_mktsegment = 'BUILDING') AS "BUILDING", count(*) FILTER (c_mktsegment = 'MACHINERY') AS "MACHINERY", count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS "HOUSEHOLD" FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(c_custkey) >= 40""")
def _(t):
    c = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").withColumn("one", F.lit(1).cast("long"))
    return aggregates.count_matrix(c, "n_nationkey", "c_mktsegment", "one", ["BUILDING", "MACHINERY", "HOUSEHOLD"], features=t.nation.select("n_nationkey", "n_name"), min_total=40)


@query("ranked_labels", """
WITH c AS (SELECT ProteinAccession, strftime(loaded_at, '%Y-%m') AS month, count(*) AS count FROM peptidetoprotein GROUP BY ALL), s AS (SELECT ProteinAccession, sum(count) AS total FROM c GROUP BY 1 HAVING sum(count) >= 2), l AS (SELECT ProteinAccession, 'P' || (row_number() OVER (ORDER BY total DESC, ProteinAccession) - 1) AS label FROM s)
SELECT ProteinAccession, month, CAST(count AS BIGINT) AS count, label FROM c JOIN l USING (ProteinAccession)""")
def _(t):
    c = t.peptidetoprotein.groupBy("ProteinAccession", F.date_format("loaded_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("count"))
    return aggregates.ranked_labels(c, "ProteinAccession", "month", "count").select("ProteinAccession", "month", "count", "label")


@query("inclusion_ratio", """
SELECT p_brand, count(*) FILTER (l_returnflag = 'R') AS inclusion, count(*) FILTER (l_returnflag = 'A') AS exclusion, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS ambiguous, round(CAST(count(*) FILTER (l_returnflag = 'R') / nullif(count(*) FILTER (l_returnflag IN ('R', 'A')), 0) AS FLOAT), 4) AS psi FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def _(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return aggregates.inclusion_ratio(j, "p_brand", F.col("l_returnflag") == "R", F.col("l_returnflag") == "A").withColumn("psi", r("psi"))


@query("intron_lengths", """
SELECT coalesce(motif, 'none') AS motif, count(*) AS n, round(quantile_cont(acceptor_pos - donor_pos, 0.5), 2) AS p50, round(quantile_cont(acceptor_pos - donor_pos, 0.95), 2) AS p95, round(quantile_cont(acceptor_pos - donor_pos, 0.99), 2) AS p99, max(acceptor_pos - donor_pos) AS max FROM introns GROUP BY 1""")
def _(t):
    d = aggregates.distribution(t.introns.withColumn("len", F.col("acceptor_pos") - F.col("donor_pos")).withColumn("motif", F.coalesce("motif", F.lit("none"))), "len", "motif")
    return d.select("motif", "n", *[r(c, 2).alias(c) for c in ("p50", "p95", "p99")], "max")


@query("block_histogram", "SELECT strand, CASE WHEN n_blocks >= 8 THEN 4 WHEN n_blocks >= 4 THEN 3 WHEN n_blocks >= 2 THEN 2 WHEN n_blocks >= 1 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM read_fingerprints WHERE n_blocks IS NOT NULL GROUP BY ALL")
def _(t):
    return aggregates.histogram(t.read_fingerprints, "n_blocks", [1, 2, 4, 8], "strand")


@query("motif_composition", """
WITH k AS (SELECT CASE WHEN motif IN ('GT-AG', 'GC-AG', 'AT-AC') THEN motif ELSE 'other' END AS motif, is_intron_seed AS s, read_count AS n FROM introns), e AS (SELECT unnest(['GT-AG', 'GC-AG', 'AT-AC', 'other']) AS motif),
j AS (SELECT e.motif, count(*) FILTER (s) AS seeds, CAST(coalesce(sum(n), 0) AS BIGINT) AS support FROM e LEFT JOIN k USING (motif) GROUP BY 1)
SELECT motif, seeds, support, round(seeds * 100.0 / sum(seeds) OVER (), 4) AS seed_pct, round(support * 100.0 / sum(support) OVER (), 4) AS support_pct FROM j""")
def _(t):
    return aggregates.motif_composition(t.introns).withColumns({c: r(c) for c in ("seed_pct", "support_pct")})


@query("annotated_agreement", "SELECT coalesce(annotated, false) AS annotated, count(*) AS introns, CAST(sum(read_count) AS BIGINT) AS support FROM introns GROUP BY 1")
def _(t):
    return aggregates.annotated_agreement(t.introns)


@query("quality_summary", "SELECT round(median(p_size), 4) AS median, round(avg(CASE WHEN p_size = 0 THEN 1.0 ELSE 0 END) * 100, 4) AS zero_pct, round(avg(CASE WHEN p_size < 30 THEN 1.0 ELSE 0 END) * 100, 4) AS below_30_pct FROM part")
def _(t):
    return aggregates.quality_summary(t.part, "p_size").select(*[r(c).alias(c) for c in ("median", "zero_pct", "below_30_pct")])


@query("json_attribute", "SELECT event_id, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k')) AS name FROM events")
def _(t):
    return t.events.select("event_id", aggregates.json_attribute("props", "name", "k").alias("name"))


@query("unpivot_counts", "SELECT l_orderkey, l_linenumber, l_partkey, name AS sample, CAST(value AS BIGINT) AS count FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS quantity, l_suppkey AS supplier FROM lineitem) UNPIVOT (value FOR name IN (quantity, supplier))")
def _(t):
    w = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"), F.col("l_suppkey").alias("supplier"))
    return aggregates.unpivot_counts(w, ["l_orderkey", "l_linenumber", "l_partkey"], ["quantity", "supplier"])


@query("window_ids", """
WITH p AS (SELECT spectrum_index, coalesce(precursor_charge, 0) AS level, isolation_window_lower AS lo, isolation_window_upper AS hi, isolation_window_center AS mz FROM dia_spectra),
w AS (SELECT level, lo, hi, dense_rank() OVER (PARTITION BY level ORDER BY lo NULLS FIRST, hi NULLS FIRST) - 1 AS native, count(*) OVER (PARTITION BY level) AS n FROM (SELECT DISTINCT level, lo, hi FROM p))
SELECT spectrum_index, p.level, CASE WHEN n <= 10 THEN native ELSE CAST(floor(mz / 2.0) AS BIGINT) END AS window_id FROM p JOIN w ON p.level = w.level AND p.lo IS NOT DISTINCT FROM w.lo AND p.hi IS NOT DISTINCT FROM w.hi""")
def _(t):
    p = t.dia_spectra.select("spectrum_index", F.coalesce("precursor_charge", F.lit(0)).alias("level"), F.col("isolation_window_lower").alias("lo"), F.col("isolation_window_upper").alias("hi"), F.col("isolation_window_center").alias("mz"))
    return aggregates.window_ids(p, "level", "lo", "hi", "mz", max_windows=10).select("spectrum_index", "level", "window_id")


@query("rollup_extension", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))


# --- coverage and windows ----------------------------------------------------------------------------------------

_RLE = """
WITH e AS (SELECT contig_id, span_start AS pos, 1 AS d FROM cluster_pileup WHERE span_end > span_start UNION ALL SELECT contig_id, span_end, -1 FROM cluster_pileup WHERE span_end > span_start),
s AS (SELECT contig_id, pos, sum(d) AS d FROM e GROUP BY ALL HAVING sum(d) <> 0),
c AS (SELECT contig_id, pos AS start, lead(pos) OVER w AS "end", CAST(sum(d) OVER (PARTITION BY contig_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM s WINDOW w AS (PARTITION BY contig_id ORDER BY pos))
"""


@query("rle_coverage", _RLE + 'SELECT contig_id, start, "end", depth FROM c WHERE depth > 0')
def _(t):
    return coverage.rle_coverage(t.cluster_pileup, "contig_id", "span_start", "span_end", tile=1 << 16)


@query("coverage_depths", _RLE + 'SELECT depth, CAST(sum("end" - start) AS BIGINT) AS bases FROM c WHERE depth > 0 GROUP BY depth')
def _(t):
    return coverage.rle_coverage(t.cluster_pileup, "contig_id", "span_start", "span_end").groupBy("depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


_MERGE = """
WITH s AS (SELECT contig_id, span_start AS a, span_end AS b FROM cluster_pileup WHERE span_end > span_start), o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY contig_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM s),
i AS (SELECT *, sum(o) OVER (PARTITION BY contig_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM o), m AS (SELECT contig_id, min(a) AS a, max(b) AS b FROM i GROUP BY contig_id, i.i)
"""


@query("merge_intervals", _MERGE + 'SELECT contig_id, a AS start, b AS "end" FROM m')
def _(t):
    return coverage.merge_intervals(t.cluster_pileup, "contig_id", "span_start", "span_end")


@query("cut_segments", _MERGE + """
, c AS (SELECT DISTINCT contig_id, span_start + 37 AS p FROM cluster_pileup), k AS (SELECT contig_id, a AS p FROM m UNION SELECT contig_id, b FROM m UNION SELECT m.contig_id, p FROM c JOIN m ON c.contig_id = m.contig_id AND p > a AND p < b),
n AS (SELECT contig_id, p AS start, lead(p) OVER (PARTITION BY contig_id ORDER BY p) AS "end" FROM k) SELECT n.contig_id, start, "end" FROM n JOIN m ON n.contig_id = m.contig_id AND start >= a AND "end" <= b""")
def _(t):
    m = coverage.merge_intervals(t.cluster_pileup, "contig_id", "span_start", "span_end")
    cuts = t.cluster_pileup.select("contig_id", (F.col("span_start") + 37).alias("pos"))
    return coverage.cut_segments(m, "contig_id", "start", "end", cuts, "pos")


@query("derived_exons")
def _(t):
    c = coverage.rle_coverage(t.read_fingerprints, "contig_id", "span_start", "span_end", tile=1 << 16)
    return coverage.derive_exons(c, t.introns, min_depth=2)


@query("value_runs", """
WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), q AS (SELECT c.*, ts FROM c JOIN events USING (event_id))
SELECT q.event_id, CAST(sum(q.n) OVER (PARTITION BY q.user_id ORDER BY ts, q.event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM q""")
def _(t):
    return coverage.runs_of(t.events, "user_id", [F.asc("ts"), F.asc("event_id")], "event_type").select("event_id", "run")


@query("acquisition_order", "SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN CAST(row_number() OVER (PARTITION BY CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END ORDER BY o_orderdate NULLS LAST, o_orderkey) AS INTEGER) END AS acquisition_order FROM orders")
def _(t):
    from sparkloom.operators.windows import rank_in_group

    serial = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))
    return rank_in_group(t.orders.withColumn("serial", serial), "serial", "o_orderdate", "o_orderkey", "acquisition_order").select("o_orderkey", "acquisition_order")


@query("junction_clusters")
def _(t):
    one = t.introns.groupBy("contig_id", "strand", "donor_pos", "acceptor_pos").agg(F.sum("read_count").alias("read_count"), F.min("motif").alias("motif"))
    return clustering.cluster_junctions(one)


@query("fingerprint_clusters", """
WITH x AS (SELECT *, CASE WHEN strand = '-' THEN span_end ELSE span_start END AS f, CASE WHEN strand = '-' THEN span_start ELSE span_end END AS t FROM read_fingerprints),
m AS (SELECT contig_id, strand, fingerprint_hash, median(f) AS mf, median(t) AS mt, count(*) AS n FROM x GROUP BY ALL),
k AS (SELECT x.*, n, abs(trunc(f - mf)) <= 25 AND abs(trunc(t - mt)) <= 75 AS kept FROM x JOIN m ON x.contig_id = m.contig_id AND x.strand = m.strand AND x.fingerprint_hash = m.fingerprint_hash)
SELECT contig_id, strand, fingerprint_hash, max(n) AS n_reads, count(*) FILTER (kept) AS n_kept, min(span_start) FILTER (kept) AS span_start, max(span_end) FILTER (kept) AS span_end FROM k GROUP BY ALL HAVING count(*) FILTER (kept) >= 1""")
def _(t):
    return clustering.cluster_by_fingerprint(t.read_fingerprints)


@query("cluster_representatives", """
WITH p AS (SELECT fingerprint_hash, junction_signature, count(*) AS n, avg(n_blocks) AS q, min(read_id) AS read_id FROM read_fingerprints GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY fingerprint_hash ORDER BY n DESC, coalesce(q, -1) DESC, junction_signature DESC) AS k, count(*) OVER (PARTITION BY fingerprint_hash) AS n_unique, sum(n) OVER (PARTITION BY fingerprint_hash) AS n_reads FROM p)
SELECT fingerprint_hash, read_id, junction_signature, n AS n_same, n_unique, CAST(n_reads AS BIGINT) AS n_reads FROM k WHERE k = 1""")
def _(t):
    return clustering.representatives(t.read_fingerprints, "fingerprint_hash", "junction_signature", "n_blocks", "read_id")


@query("anchored_units")
def _(t):
    return clustering.split_by_span(t.entries.select("PeptideModSeq", "RTInSeconds").distinct(), "PeptideModSeq", "RTInSeconds", 30.0)


@query("row_packing")
def _(t):
    rows = t.cluster_pileup.select("cluster_id", "contig_id", "span_start", "span_end").distinct()
    return clustering.pack_rows(rows.where("span_end > span_start"), "contig_id", "span_start", "span_end")


# --- networks and trees ------------------------------------------------------------------------------------------

_NET = "WITH e AS (SELECT DISTINCT upper(trim(PeptideSeq)) AS src, ProteinAccession AS dst FROM peptidetoprotein WHERE trim(PeptideSeq) <> ''), "


def _network(t):
    from sparkloom.columns import peptide_key

    return graph.from_edges(t.peptidetoprotein.select(peptide_key("PeptideSeq").alias("src"), F.col("ProteinAccession").alias("dst")))


@query("connected_components", _NET.replace("WITH", "WITH RECURSIVE") + """
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT src AS node, src AS root FROM b UNION SELECT b.dst, w.root FROM w JOIN b ON b.src = w.node)
SELECT node, min(root) AS component FROM w GROUP BY node""")
def _(t):
    return graph.connected_components(*_network(t))


@query("component_sizes", _NET.replace("WITH", "WITH RECURSIVE") + """
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT src AS node, src AS root FROM b UNION SELECT b.dst, w.root FROM w JOIN b ON b.src = w.node), c AS (SELECT node, min(root) AS component FROM w GROUP BY node)
SELECT component, count(*) AS size FROM c GROUP BY component""")
def _(t):
    return graph.component_sizes(graph.connected_components(*_network(t)))


@query("node_degrees", _NET + "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS node, count(*) AS degree FROM b GROUP BY 1")
def _(t):
    return graph.degrees(*_network(t))


@query("induced_subgraph", _NET + "k AS (SELECT DISTINCT src AS node FROM e WHERE length(src) > 12 UNION SELECT DISTINCT dst FROM e WHERE dst LIKE 'CST%') SELECT src, dst FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def _(t):
    n, e = _network(t)
    kept = e.where(F.length("src") > 12).select(F.col("src").alias("node")).union(e.where(F.col("dst").startswith("CST")).select("dst"))
    return graph.induced_subgraph(n, e, kept)[1]


_TREE = "WITH RECURSIVE t AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 0 THEN c_custkey // 2 END AS parent FROM customer), "


def _tree(t):
    return t.customer.select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 2)).alias("parent"))


@query("tree_depths", _TREE + "d AS (SELECT node, 0 AS depth FROM t WHERE parent IS NULL OR parent = node UNION ALL SELECT t.node, d.depth + 1 FROM t JOIN d ON t.parent = d.node AND t.node <> d.node) SELECT node, depth FROM d")
def _(t):
    return graph.depths(_tree(t))


@query("tree_lineage", _TREE + "a AS (SELECT node, node AS anc, 0 AS k FROM t UNION ALL SELECT a.node, t.parent, a.k + 1 FROM a JOIN t ON t.node = a.anc WHERE t.parent IS NOT NULL AND t.parent <> t.node) SELECT node, string_agg(CAST(anc AS VARCHAR), '/' ORDER BY k DESC) AS path FROM a GROUP BY node")
def _(t):
    return graph.lineage(_tree(t), _tree(t)).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query("tree_descendants", _TREE + "d AS (SELECT node, node AS descendant, 0 AS distance FROM t UNION ALL SELECT d.node, t.node, d.distance + 1 FROM d JOIN t ON t.parent = d.descendant AND t.node <> t.parent) SELECT node, descendant, distance FROM d WHERE distance > 0")
def _(t):
    return graph.descendants(_tree(t), _tree(t))


@query("tree_lca", _TREE + """
p AS (SELECT c_custkey AS a, (c_custkey * 7) % (SELECT max(c_custkey) + 1 FROM customer) AS b FROM customer),
u AS (SELECT node, node AS anc, 0 AS k FROM t UNION ALL SELECT u.node, t.parent, u.k + 1 FROM u JOIN t ON t.node = u.anc WHERE t.parent IS NOT NULL AND t.parent <> t.node),
j AS (SELECT p.a, p.b, x.anc, row_number() OVER (PARTITION BY p.a, p.b ORDER BY x.k + y.k, x.anc) AS k FROM p JOIN u x ON x.node = p.a JOIN u y ON y.node = p.b AND y.anc = x.anc)
SELECT p.a, p.b, j.anc AS lca FROM p LEFT JOIN j ON j.a = p.a AND j.b = p.b AND j.k = 1""")
def _(t):
    keys = t.customer.agg((F.max("c_custkey") + 1).alias("n"))
    pairs = t.customer.crossJoin(keys).select(F.col("c_custkey").alias("a"), (F.col("c_custkey") * 7 % F.col("n")).alias("b"))
    return graph.lowest_common_ancestor(_tree(t), pairs)


@query("collision_losers")
def _(t):
    live = t.entries.where("deleted_at IS NULL")
    # rows that differ in nothing but loaded_at are re-loads of one spectrum; the first load counts
    whole = F.hex(F.xxhash64(*[c for c in live.columns if c not in ("loaded_at", "deleted_at")]))
    own = F.concat_ws("/", "PeptideModSeq", "PrecursorCharge", "SourceFile", "RTInSeconds", whole).alias("entry_id")
    e = live.groupBy(own).agg(F.min(F.struct("loaded_at", "PeptideModSeq", "PrecursorMz", "RTInSeconds", "Score", "MassArray")).alias("e")).select("entry_id", "e.*")
    e = e.select("entry_id", F.floor(F.col("PrecursorMz") / 25).alias("window_id"), F.col("RTInSeconds").alias("rt"), F.col("Score").alias("score"), F.col("PeptideModSeq").alias("form"), sqlite.decompress_mz("MassArray").alias("mz_list"))
    return graph.collision_losers(e, ppm=10.0, min_shared=3, form="form")


@query("near_precursors", """
WITH p AS (SELECT DISTINCT PrecursorMz AS v FROM entries WHERE PrecursorMz > 0) SELECT round(a.v, 5) AS src, round(b.v, 5) AS dst FROM p a JOIN p b ON a.v < b.v AND b.v - a.v <= a.v * 50 * 1e-6""")
def _(t):
    p = t.entries.select(F.col("PrecursorMz").alias("v")).distinct().withColumn("i", F.col("v"))
    return graph.near_pairs(p, "i", "v", 50.0).select(r("src", 5).alias("src"), r("dst", 5).alias("dst"))


# --- integrity ---------------------------------------------------------------------------------------------------

@query("duplicate_keys", "SELECT cluster_id, count(*) AS n FROM cluster_pileup GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return integrity.duplicate_keys(t.cluster_pileup, "cluster_id")


@query("key_violations", """
SELECT 'pk customer(c_custkey)' AS rule, count(*) AS n FROM (SELECT 1 FROM customer GROUP BY c_custkey HAVING count(*) > 1)
UNION ALL SELECT 'pk introns(intron_id)', count(*) FROM (SELECT 1 FROM introns GROUP BY intron_id HAVING count(*) > 1)
UNION ALL SELECT 'fk orders.o_custkey -> customer.c_custkey', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'fk documents.reissue_of -> documents.doc_id', count(DISTINCT reissue_of) FROM documents WHERE reissue_of IS NOT NULL AND reissue_of NOT IN (SELECT doc_id FROM documents)""")
def _(t):
    tables = {"customer": t.customer, "introns": t.introns, "orders": t.orders, "documents": t.documents}
    return integrity.validate(tables, {"customer": "c_custkey", "introns": "intron_id"}, [("orders", "o_custkey", "customer", "c_custkey"), ("documents", "reissue_of", "documents", "doc_id")])


@query("length_mismatches", "SELECT doc_id FROM documents WHERE length(trim(text)) IS DISTINCT FROM n_chars")
def _(t):
    return integrity.length_mismatches(t.documents.withColumn("text", F.trim("text")), "text", "n_chars").select("doc_id")


# --- sequences ---------------------------------------------------------------------------------------------------

_DNA = "translate(upper(trim(PeptideSeq)), 'ACDEFGHIKLMNPQRSTVWY', 'ACGTACGTACGTACGTACGT')"


def _dna(t):
    from sparkloom.columns import peptide_key

    return t.entries.select(peptide_key("PeptideSeq").alias("p")).distinct().dropna().withColumn("dna", F.translate("p", "ACDEFGHIKLMNPQRSTVWY", "ACGT" * 5))


_SEQ = f"WITH s AS (SELECT DISTINCT upper(trim(PeptideSeq)) AS p, {_DNA} AS dna FROM entries WHERE trim(PeptideSeq) <> '') "


@query("reverse_complement", _SEQ + "SELECT p, reverse(translate(dna, 'ACGT', 'TGCA')) AS rc FROM s")
def _(t):
    return _dna(t).select("p", sequence.reverse_complement("dna").alias("rc"))


@query("kmer_counts", _SEQ + "SELECT k AS kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(dna) - 1), lambda i: substr(dna, i, 3))) AS k FROM s) GROUP BY 1")
def _(t):
    return _dna(t).select(F.explode(sequence.kmers("dna", 3)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query("gc_fraction", _SEQ + "SELECT p, round((length(dna) - length(translate(dna, 'GC', ''))) / length(dna), 4) AS gc FROM s")
def _(t):
    return _dna(t).select("p", r(sequence.gc_fraction("dna")).alias("gc"))


@query("gc_windows", _SEQ + ", w AS (SELECT p, unnest(list_transform(range(1, length(dna) - 6, 2), lambda i: substr(dna, i, 8))) AS w FROM s) SELECT p, round(avg((8 - length(translate(w, 'GC', ''))) / 8.0), 4) AS mean_gc, count(*) AS n FROM w GROUP BY p")
def _(t):
    w = _dna(t).select("p", F.explode(sequence.gc_windows("dna", 8, 2)).alias("g"))
    return w.groupBy("p").agg(r(F.avg("g")).alias("mean_gc"), F.count(F.lit(1)).alias("n"))


@query("hamming_distance", _SEQ + "SELECT p, CAST(hamming(dna, reverse(dna)) AS INTEGER) AS d FROM s")
def _(t):
    return _dna(t).select("p", sequence.hamming("dna", F.reverse("dna")).alias("d"))


@query("alphabets", _SEQ + "SELECT CASE WHEN regexp_full_match(p, '[ACGT]*') THEN 'dna' WHEN regexp_full_match(p, '[ACGU]*') THEN 'rna' WHEN regexp_full_match(p, '[ACDEFGHIKLMNPQRSTVWY]*') THEN 'protein' END AS alphabet, count(*) AS n FROM s GROUP BY 1")
def _(t):
    return _dna(t).groupBy(sequence.identify_alphabet("p", ("dna", "rna", "protein")).alias("alphabet")).agg(F.count(F.lit(1)).alias("n"))


@query("tryptic_digest", _SEQ + ", d AS (SELECT p, unnest(string_split(regexp_replace(regexp_replace(p, '([KR])([^P|])', '\\1|\\2', 'g'), '([KR])([^P|])', '\\1|\\2', 'g'), '|')) AS peptide FROM s) SELECT peptide, count(*) AS n FROM d WHERE peptide <> '' GROUP BY 1")
def _(t):
    return _dna(t).select(F.explode(sequence.tryptic_peptides("p")).alias("peptide")).groupBy("peptide").agg(F.count(F.lit(1)).alias("n"))


@query("digest_missed_cleavages")
def _(t):
    return _dna(t).select("p", F.explode(sequence.digest("p", "trypsin", missed=1, min_length=5)).alias("d")).select("p", "d.start", "d.end", "d.peptide")


@query("open_reading_frames")
def _(t):
    return _dna(t).select("p", F.explode(sequence.orfs(F.repeat("dna", 3), min_length=3)).alias("o")).select("p", "o.strand", "o.start", "o.end", "o.protein")


@query("translation")
def _(t):
    return _dna(t).select("p", sequence.translate("dna", to_stop=True).alias("protein"))


@query("nearest_in_panel", """
WITH k AS (SELECT n_name, r_name, levenshtein(r_name, n_name) AS d, row_number() OVER (PARTITION BY n_name ORDER BY levenshtein(r_name, n_name), r_name) AS k, lead(levenshtein(r_name, n_name)) OVER (PARTITION BY n_name ORDER BY levenshtein(r_name, n_name), r_name) AS nx FROM nation CROSS JOIN region)
SELECT n_name, CASE WHEN d <= 8 THEN r_name END AS r_name, CAST(CASE WHEN d <= 8 THEN d END AS INTEGER) AS distance, CAST(CASE WHEN d <= 8 THEN nx - d END AS INTEGER) AS delta FROM k WHERE k = 1""")
def _(t):
    return nearest_in_panel(t.nation.select("n_name"), "n_name", t.region.withColumn("t", F.col("r_name")), "r_name", "t", 8)


@query("stripped_sequence", "SELECT DISTINCT PeptideModSeq, regexp_replace(regexp_replace(PeptideModSeq, '\\[[^\\[\\]]*\\]', '', 'g'), '[^A-Z]', '', 'g') AS plain FROM entries")
def _(t):
    return t.entries.select("PeptideModSeq", notation.stripped("PeptideModSeq").alias("plain")).distinct()


@query("modseq_notation")
def _(t):
    return t.entries.select("PeptideModSeq").distinct().withColumn("proforma", notation.modseq_to_proforma("PeptideModSeq")).withColumn("back", notation.proforma_to_modseq("proforma"))


@query("mean_quality", "SELECT p, round(-10 * log10(list_sum(list_transform(string_split(p, ''), lambda c: pow(10.0, -(ascii(c) - 33) / 10.0))) / length(p)), 4) AS q FROM (SELECT DISTINCT upper(trim(PeptideSeq)) AS p FROM entries WHERE trim(PeptideSeq) <> '')")
def _(t):
    return _dna(t).select("p", r(sequence.mean_quality("p")).alias("q"))


# --- chemistry ---------------------------------------------------------------------------------------------------

_MASS = "CASE c " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in chem.residue_masses().items()) + " END"
_WATER = chem.mass_of(chem.parse_formula_of("H2O"))


@query("peptide_mz", f"SELECT p, round((CASE WHEN regexp_full_match(p, '[{''.join(chem.RESIDUES)}]*') THEN list_sum(list_transform(string_split(p, ''), lambda c: {_MASS})) END + {_WATER!r} + 2 * {chem.PROTON!r}) / 2, 5) AS mz FROM (SELECT DISTINCT upper(trim(PeptideSeq)) AS p FROM entries WHERE trim(PeptideSeq) <> '')")
def _(t):
    return _dna(t).select("p", r(chem.mz(chem.peptide_mass("p"), 2), 5).alias("mz"))


@query("fragment_ladder", f"""
WITH s AS (SELECT DISTINCT upper(trim(PeptideSeq)) AS p FROM entries WHERE regexp_full_match(upper(trim(PeptideSeq)), '[{''.join(chem.RESIDUES)}]+')), m AS (SELECT p, list_transform(string_split(p, ''), lambda c: {_MASS}) AS m FROM s),
i AS (SELECT p, m, unnest(range(1, len(m))) AS k FROM m)
SELECT p, 'b' AS ion, CAST(k AS INTEGER) AS position, round(CAST(list_sum(m[1:k]) + {chem.PROTON!r} AS DOUBLE), 4) AS mz FROM i UNION ALL SELECT p, 'y', CAST(k AS INTEGER), round(CAST(list_sum(m[len(m) - k + 1:]) + {_WATER!r} + {chem.PROTON!r} AS DOUBLE), 4) FROM i""")
def _(t):
    known = _dna(t).where(F.col("p").rlike(f"^[{''.join(chem.RESIDUES)}]+$"))
    return chem.ladder_rows(known.withColumn("s", F.col("p")), "p", "s").withColumn("mz", r("mz"))


@query("fragment_ladder_losses")
def _(t):
    return chem.fragment_ladders(_dna(t), "p", "p", ions="by", max_charge=2, losses=("H2O", "NH3"))


@query("isotope_envelopes")
def _(t):
    n = F.length("p").cast("string")
    return _dna(t).select("p", chem.envelope(F.concat(F.lit("C"), n, F.lit("H"), n, F.lit("O2N3")), 4).alias("e")).select("p", F.col("e.mass").alias("mass"), F.col("e.share").alias("share"))


@query("decoded_arrays", "SELECT PeptideModSeq, SourceFile, PrecursorCharge, loaded_at::VARCHAR AS loaded, CAST(MassEncodedLength // 8 AS INTEGER) AS n_mz, CAST(IntensityEncodedLength // 4 AS INTEGER) AS n_intensity FROM entries")
def _(t):
    d = sqlite.decode_entries(t.entries)
    loaded = F.regexp_replace(F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return d.select("PeptideModSeq", "SourceFile", "PrecursorCharge", loaded.alias("loaded"), F.size("mz").alias("n_mz"), F.size("intensity").alias("n_intensity"))


# --- vectors -----------------------------------------------------------------------------------------------------

_VEC = """
WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, c FROM embeddings JOIN c USING (label))
"""


def _pairs(t):
    x = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    c = x.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"))
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e")).join(c, "label")


@query("vector_similarity", _VEC + """
SELECT vec_id, round(list_cosine_similarity(e, c), 4) AS cosine, round(1 - 2 * acos(greatest(-1, least(1, list_cosine_similarity(e, c)))) / pi(), 4) AS angle, round(list_cosine_similarity(list_transform(e, lambda x: x - list_avg(e)), list_transform(c, lambda x: x - list_avg(c))), 4) AS pearson FROM v""")
def _(t):
    return _pairs(t).select("vec_id", r(vectors.compare("e", "c", "cosine")).alias("cosine"), r(vectors.compare("e", "c", "spectral_angle")).alias("angle"), r(vectors.compare("e", "c", "pearson")).alias("pearson"))


@query("entropy_similarity", _VEC + """
, a AS (SELECT vec_id, list_transform(e, lambda x: abs(x)) AS e, list_transform(c, lambda x: abs(x)) AS c FROM v), n AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p, list_transform(c, lambda x: x / list_sum(c)) AS q FROM a),
z AS (SELECT vec_id, p, q, list_transform(list_zip(p, q), lambda t: (t[1] + t[2]) / 2) AS m FROM n)
SELECT vec_id, round(1 - (-list_sum(list_transform(m, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) + (list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) + list_sum(list_transform(q, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END))) / 2) / ln(2), 4) AS similarity,
round(list_sum(list_transform(list_zip(p, q), lambda t: CASE WHEN t[1] > 0 AND t[2] > 0 THEN t[1] * ln(t[1] / t[2]) ELSE 0 END)), 4) AS kl FROM z""")
def _(t):
    p = _pairs(t).select("vec_id", F.transform("e", F.abs).alias("e"), F.transform("c", F.abs).alias("c"))
    return p.select("vec_id", r(vectors.compare("e", "c", "entropy")).alias("similarity"), r(vectors.compare("e", "c", "kld", pseudocount=0.0)).alias("kl"))


@query("normalised_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS l1_of_unit FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", r(vectors.total(F.transform(vectors.l2_normalize("embedding"), F.abs))).alias("l1_of_unit"))


@query("spectrum_consensus", """
WITH s AS (SELECT label, vec_id AS replicate, generate_subscripts(embedding, 1) - 1 AS channel, abs(unnest(embedding)::DOUBLE) AS x FROM embeddings), p AS (SELECT *, x / sum(x) OVER (PARTITION BY replicate) AS p FROM s), c AS (SELECT label, channel, sum(x) AS i, stddev_pop(p) AS spread FROM p GROUP BY ALL)
SELECT label, CAST(channel AS INTEGER) AS channel, round(i, 4) AS intensity, round(i / sum(i) OVER (PARTITION BY label), 5) AS proportion, round(spread, 5) AS spread FROM c""")
def _(t):
    s = t.embeddings.select("label", F.col("vec_id").alias("replicate"), F.posexplode(F.col("embedding").cast("array<double>")).alias("channel", "intensity")).withColumn("intensity", F.abs("intensity"))
    return consensus.spectrum_consensus(s, "label").select("label", "channel", r("intensity").alias("intensity"), r("proportion", 5).alias("proportion"), r("spread", 5).alias("spread"))


# --- statistics --------------------------------------------------------------------------------------------------

@query("credible_intervals", "SELECT SourceFile, round(quantile_cont(Actual, 0.025), 6) AS lo, round(quantile_cont(Actual, 0.975), 6) AS hi FROM retentiontimes WHERE Actual IS NOT NULL GROUP BY 1")
def _(t):
    return stats.credible_interval(t.retentiontimes.where("Actual IS NOT NULL"), "SourceFile", "Actual").select("SourceFile", r("lo", 6).alias("lo"), r("hi", 6).alias("hi"))


@query("log_linear_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, ln(l_quantity)), 3) AS slope, round(regr_intercept(l_extendedprice, ln(l_quantity)), 2) AS intercept FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def _(t):
    return stats.log_linear(t.lineitem, "l_returnflag", "l_quantity", "l_extendedprice").select("l_returnflag", r("slope", 3).alias("slope"), r("intercept", 2).alias("intercept"))


@query("normal_log_density", f"SELECT o_orderkey, round(-0.5 * pow((o_totalprice - 150000) / 80000, 2) - ln(80000) - {0.5 * math.log(2 * math.pi)!r}, 6) AS d FROM orders")
def _(t):
    return t.orders.select("o_orderkey", r(stats.normal_log_density(F.col("o_totalprice"), F.lit(150000.0), F.lit(80000.0)), 6).alias("d"))


@query("poisson_log_density", "SELECT event_id, round(floor(value) * ln(12.5) - 12.5 - lgamma(floor(value) + 1), 6) AS d FROM events WHERE value >= 0")
def _(t):
    return t.events.where("value >= 0").select("event_id", r(stats.log_density("poisson", F.floor("value").cast("double"), 12.5), 6).alias("d"))


@query("responsibilities", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS weight FROM lineitem QUALIFY l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) >= 0.05")
def _(t):
    x = stats.responsibilities(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey", "l_partkey", "l_quantity", floor=0.05)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", r("weight", 9).alias("weight"))


@query("trace_grid", "SELECT user_id, coalesce(max(value) FILTER (event_type = 'click'), 0) AS click, coalesce(max(value) FILTER (event_type = 'error'), 0) AS error, coalesce(max(value) FILTER (event_type = 'purchase'), 0) AS purchase, coalesce(max(value) FILTER (event_type = 'signup'), 0) AS signup, coalesce(max(value) FILTER (event_type = 'view'), 0) AS view FROM events GROUP BY 1")
def _(t):
    return stats.trace_grid(t.events, "user_id", "event_type", "value", ["click", "error", "purchase", "signup", "view"])


@query("peak_fits")
def _(t):
    e = t.events.groupBy("user_id", F.hour("ts").cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return stats.fit_groups(e, "user_id", "x", "y", "gaussian", {"area": (0, 5000), "mu": (0, 24), "sigma": (1, 30)})


# --- time --------------------------------------------------------------------------------------------------------

@query("tumbling_bins", "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M:%S') AS bin, event_type, count(*) AS n, round(sum(value), 3) AS total, max(value) AS greatest FROM events GROUP BY ALL")
def _(t):
    b = ingest.tumbling(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["event_type"], "value")
    return b.select(F.date_format("bin_start", "yyyy-MM-dd HH:mm:ss").alias("bin"), "event_type", "n", r("total", 3).alias("total"), "greatest")


@query("sessions_extension", """
WITH c AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events), i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM c)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM i GROUP BY user_id, i.i""")
def _(t):
    s = ingest.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ["user_id"])
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("rt_bins", "SELECT fraction, CAST(floor(scan_start_time_s / 60) AS BIGINT) AS bin, count(*) AS n FROM dia_spectra WHERE scan_start_time_s IS NOT NULL GROUP BY ALL")
def _(t):
    return t.dia_spectra.where("scan_start_time_s IS NOT NULL").groupBy("fraction", F.floor(F.col("scan_start_time_s") / 60).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
