"""Queries over the domain tables for the core data problems, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.columns import peptide_key
from sparkloom.operators.orphans import Child, Parent, orphan_references, orphan_report
from sparkloom.operators.periods import periods_and_gaps
from sparkloom.operators.skew import count_rows, count_values, greatest, heavy_keys, least, salted_aggregate, total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered periods and gaps of each contig and strand."""
    return periods_and_gaps(table(spark, sf_dir, "cluster_pileup"), ["contig_id", "strand"], "span_start", "span_end")


P2_SQL = """
WITH s AS (SELECT contig_id, strand, span_start AS a, span_end AS b FROM cluster_pileup WHERE span_end > span_start),
o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY contig_id, strand ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opened FROM s),
i AS (SELECT *, sum(opened) OVER (PARTITION BY contig_id, strand ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o),
p AS (SELECT contig_id, strand, min(a) AS a, max(b) AS b FROM i GROUP BY contig_id, strand, island),
g AS (SELECT contig_id, strand, b AS a, lead(a) OVER (PARTITION BY contig_id, strand ORDER BY a) AS b FROM p)
SELECT contig_id, strand, 'period' AS kind, a AS range_start, b AS range_end FROM p
UNION ALL SELECT contig_id, strand, 'gap', a, b FROM g WHERE b IS NOT NULL
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, entries = table(spark, sf_dir, "peptidetoprotein"), table(spark, sf_dir, "entries")
    introns, reads = table(spark, sf_dir, "introns"), table(spark, sf_dir, "read_fingerprints")
    live, day = F.col("deleted_at").isNull(), F.date_format("loaded_at", "yyyy-MM-dd")
    peptide = peptide_key("PeptideSeq")
    parents = [
        Parent("peptidetoprotein", links, peptide, live, day),
        Parent("entries", entries, peptide, live, day),
        Parent("introns", introns, F.col("intron_id"), live, day),
    ]
    children = [
        Child("peptidetoprotein", "entries", links.where("deleted_at is null"), peptide, day),
        Child("entries", "peptidetoprotein", entries.where("deleted_at is null"), peptide, day),
        Child("read_fingerprints", "introns", reads, F.col("intron_ids"), day, many=True),
    ]
    return orphan_references(parents, children)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a record, per table and load day."""
    return _orphans(spark, sf_dir).select("source_table", "period", "ref_key", "reason")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan keys and references per table, load day and reason."""
    return orphan_report(_orphans(spark, sf_dir))


_P4 = """
WITH parents AS (
  SELECT 'peptidetoprotein' AS parent_table, upper(trim(PeptideSeq)) AS ref_key, deleted_at IS NULL AS live, strftime(loaded_at, '%Y-%m-%d') AS day FROM peptidetoprotein WHERE trim(PeptideSeq) <> ''
  UNION ALL SELECT 'entries', upper(trim(PeptideSeq)), deleted_at IS NULL, strftime(loaded_at, '%Y-%m-%d') FROM entries WHERE trim(PeptideSeq) <> ''
  UNION ALL SELECT 'introns', CAST(intron_id AS VARCHAR), deleted_at IS NULL, strftime(loaded_at, '%Y-%m-%d') FROM introns),
known AS (SELECT parent_table, ref_key, bool_or(live) AS live, min(day) FILTER (live) AS day FROM parents GROUP BY ALL),
children AS (
  SELECT 'peptidetoprotein' AS source_table, 'entries' AS parent_table, upper(trim(PeptideSeq)) AS ref_key, strftime(loaded_at, '%Y-%m-%d') AS period FROM peptidetoprotein WHERE deleted_at IS NULL AND trim(PeptideSeq) <> ''
  UNION ALL SELECT 'entries', 'peptidetoprotein', upper(trim(PeptideSeq)), strftime(loaded_at, '%Y-%m-%d') FROM entries WHERE deleted_at IS NULL AND trim(PeptideSeq) <> ''
  UNION ALL SELECT 'read_fingerprints', 'introns', CAST(k AS VARCHAR), strftime(loaded_at, '%Y-%m-%d') FROM (SELECT unnest(intron_ids) AS k, loaded_at FROM read_fingerprints)),
judged AS (SELECT source_table, period, c.ref_key, CASE WHEN p.ref_key IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN day > period THEN 'late' END AS reason, count(*) AS n_refs
  FROM children c LEFT JOIN known p ON c.parent_table = p.parent_table AND c.ref_key = p.ref_key GROUP BY ALL)
"""
P4_SQL = _P4 + "SELECT source_table, period, ref_key, reason FROM judged WHERE reason IS NOT NULL"
P4_REPORT_SQL = _P4 + "SELECT source_table, period, reason, count(*) AS n_keys, CAST(sum(n_refs) AS BIGINT) AS n_refs FROM judged WHERE reason IS NOT NULL GROUP BY ALL"


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold at least 2 % of the rows of their table."""
    out = None
    for name, key in (("read_fingerprints", "fingerprint_hash"), ("introns", "intron_id")):
        rows = table(spark, sf_dir, name).select(key)
        result = salted_aggregate(rows, key, {"rows": count_rows()})
        whole = rows.agg(F.count(F.lit(1)).alias("total_rows"))
        found = result.join(F.broadcast(whole), F.col("rows") * 50 >= F.col("total_rows")).where(F.col(key).isNotNull())
        found = found.select(F.lit(name).alias("source_table"), F.col(key).cast("long").alias("key_value"))
        out = found if out is None else out.unionByName(found)
    return out


P5_SQL = """
SELECT 'read_fingerprints' AS source_table, fingerprint_hash AS key_value FROM read_fingerprints WHERE fingerprint_hash IS NOT NULL GROUP BY fingerprint_hash HAVING count(*) * 50 >= (SELECT count(*) FROM read_fingerprints)
UNION ALL SELECT 'introns', intron_id FROM introns WHERE intron_id IS NOT NULL GROUP BY intron_id HAVING count(*) * 50 >= (SELECT count(*) FROM introns)
"""


def p5_read_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, different reads and span of each fingerprint."""
    reads = table(spark, sf_dir, "read_fingerprints")
    once = reads.groupBy("fingerprint_hash", "read_id").agg(F.count(F.lit(1)).alias("n"), F.min("span_start").alias("a"), F.max("span_end").alias("b"))
    heavy = heavy_keys(reads, "fingerprint_hash", 0.005)
    return salted_aggregate(once, "fingerprint_hash", {"n_rows": total("n"), "n_reads": count_values("read_id"), "first_start": least("a"), "last_end": greatest("b")}, heavy=heavy)


P5_READS_SQL = "SELECT fingerprint_hash, count(*) AS n_rows, count(DISTINCT read_id) AS n_reads, min(span_start) AS first_start, max(span_end) AS last_end FROM read_fingerprints GROUP BY fingerprint_hash"


def p5_intron_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, read_count and span of each intron."""
    rows = table(spark, sf_dir, "introns")
    return salted_aggregate(rows, "intron_id", {"n_rows": count_rows(), "read_count": total("read_count"), "first_donor": least("donor_pos"), "last_acceptor": greatest("acceptor_pos")})


P5_INTRONS_SQL = "SELECT intron_id, count(*) AS n_rows, CAST(sum(read_count) AS BIGINT) AS read_count, min(donor_pos) AS first_donor, max(acceptor_pos) AS last_acceptor FROM introns GROUP BY intron_id"

QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_read_groups": p5_read_groups, "p5_intron_support": p5_intron_support}
SQL = {"p2_found": P2_SQL, "p4_found": P4_SQL, "p4_report": P4_REPORT_SQL, "p5_found": P5_SQL, "p5_read_groups": P5_READS_SQL, "p5_intron_support": P5_INTRONS_SQL}
