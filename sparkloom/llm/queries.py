"""Queries over the test tables for the training-data problems, with the same in SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.columns import peptide_key, real
from sparkloom.llm import leaks, nearest_time, packing, quantiles, spam, topn

#: Percentiles of Delta beyond this many seconds, on either side, are reported.
DELTA_LIMIT = 45.0
BUCKETS = quantiles.LogBuckets(rel_error=0.005, anchor=DELTA_LIMIT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    """Ids and texts of the documents. A scan of fewer partitions than there are cores, as of one small file, is spread over all."""
    scan = table(spark, sf_dir, "documents").select("doc_id", "text", *others)
    cores = spark.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and percentiles of Delta beyond 45 s: the limit is an edge of a bucket, so the sketch decides exactly."""
    days = p1_daily_sketches(spark, sf_dir)
    p = quantiles.percentiles(quantiles.merge(days, "SourceFile"), "SourceFile", [5, 50, 95], BUCKETS)
    return p.where(F.abs("value") > DELTA_LIMIT).select("SourceFile", F.col("pct").cast("int").alias("pct"))


P1_SQL = """
WITH v AS (SELECT SourceFile, Delta FROM retentiontimes WHERE Delta IS NOT NULL AND NOT isnan(Delta)),
p AS (SELECT SourceFile, 5 AS pct, quantile_cont(Delta, 0.05) AS value FROM v GROUP BY SourceFile
  UNION ALL SELECT SourceFile, 50, quantile_cont(Delta, 0.5) FROM v GROUP BY SourceFile
  UNION ALL SELECT SourceFile, 95, quantile_cont(Delta, 0.95) FROM v GROUP BY SourceFile)
SELECT SourceFile, pct FROM p WHERE abs(value) > 45
"""


def p1_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sketch of Delta per file and load day."""
    rows = table(spark, sf_dir, "retentiontimes").withColumn("load_day", F.to_date("loaded_at"))
    return quantiles.sketch(rows, ["SourceFile", "load_day"], "Delta", BUCKETS)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of Delta per file over all days, from the daily sketches."""
    days = p1_daily_sketches(spark, sf_dir)
    return quantiles.percentiles(quantiles.merge(days, "SourceFile"), "SourceFile", [1, 5, 25, 50, 75, 95, 99], BUCKETS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey scan nearest to each spectrum, at most 1.75 s away."""
    spectra = table(spark, sf_dir, "dia_spectra").select("fraction", "scan_start_time_s", F.col("spectrum_index"))
    scans = table(spark, sf_dir, "dia_precursor").select("fraction", "scan_start_time_s", F.col("spectrum_index").alias("precursor_index"))
    pairs = nearest_time.nearest_within(spectra, scans, "fraction", "scan_start_time_s", "spectrum_index", "precursor_index", 1.75)
    return pairs.select("precursor_index", "spectrum_index")


P3_SQL = """
WITH pairs AS (SELECT p.spectrum_index AS precursor_index, s.spectrum_index, row_number() OVER (PARTITION BY s.spectrum_index ORDER BY abs(s.scan_start_time_s - p.scan_start_time_s), p.scan_start_time_s, p.spectrum_index) AS k
  FROM dia_spectra s JOIN dia_precursor p ON s.fraction = p.fraction AND abs(s.scan_start_time_s - p.scan_start_time_s) <= 1.75)
SELECT precursor_index, spectrum_index FROM pairs WHERE k = 1
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best-scored peptide forms of each protein. A row without PeptideSeq leads to no protein, so its score counts for none."""
    entries = table(spark, sf_dir, "entries").where("deleted_at is null and PeptideModSeq is not null")
    links = table(spark, sf_dir, "peptidetoprotein").where("deleted_at is null and ProteinAccession is not null")
    forms = entries.select(peptide_key("PeptideSeq").alias("peptide"), "PeptideModSeq", real("Score").alias("Score")).where("peptide is not null and Score is not null")
    forms = forms.groupBy("peptide", "PeptideModSeq").agg(F.max("Score").alias("Score"))
    proteins = links.select(peptide_key("PeptideSeq").alias("peptide"), "ProteinAccession").where("peptide is not null").distinct()
    scored = forms.join(proteins, "peptide").select("ProteinAccession", "PeptideModSeq", "Score")
    return topn.top_n(scored, "ProteinAccession", "Score", "PeptideModSeq", 3).select("ProteinAccession", "PeptideModSeq")


P6_SQL = """
WITH e AS (SELECT upper(trim(PeptideSeq)) AS peptide, PeptideModSeq, max(Score) AS score FROM entries WHERE deleted_at IS NULL AND PeptideModSeq IS NOT NULL AND trim(PeptideSeq) <> '' AND Score IS NOT NULL AND NOT isnan(Score) GROUP BY ALL),
proteins AS (SELECT DISTINCT upper(trim(PeptideSeq)) AS peptide, ProteinAccession FROM peptidetoprotein WHERE deleted_at IS NULL AND ProteinAccession IS NOT NULL AND trim(PeptideSeq) <> ''),
pairs AS (SELECT ProteinAccession, PeptideModSeq, max(score) AS score FROM e JOIN proteins USING (peptide) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ProteinAccession ORDER BY score DESC, PeptideModSeq) AS k FROM pairs)
SELECT ProteinAccession, PeptideModSeq FROM ranked WHERE k <= 3
"""


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2,048 tokens that holds each text, or each piece of a longer text."""
    counts = packing.token_counts(texts(spark, sf_dir), "doc_id", "text")
    return packing.pack(counts.withColumnRenamed("_id", "doc_id"), "doc_id", "_n", 2048)


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that have a container, containers beyond their capacity, texts cut though they fit, and pieces that overlap or are missing: the last three are 0."""
    packed = p7_containers(spark, sf_dir)
    bins = packed.groupBy("container").agg(F.sum("n_units").alias("n"), F.max(F.col("offset") + F.col("n_units")).alias("end"))
    texts_ = packed.groupBy("doc_id").agg(F.sum("n_units").alias("n"), F.count(F.lit(1)).alias("pieces"))
    a = bins.agg(F.count_if((F.col("n") > 2048) | (F.col("end") != F.col("n"))).alias("overfull"))
    b = texts_.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("pieces") != F.greatest(F.ceil(F.col("n") / 2048), F.lit(1))).alias("needless_cuts"))
    return a.join(F.broadcast(b)).select("n_texts", "overfull", "needless_cuts")


P7_SQL = "SELECT count(DISTINCT doc_id) AS n_texts, 0::BIGINT AS overfull, 0::BIGINT AS needless_cuts FROM documents"


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a passage of an evaluation item."""
    found = leaks.leaked_passages(texts(spark, sf_dir), table(spark, sf_dir, "eval_items"), "doc_id", "item_id")
    return found.select("item_id", "doc_id")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and longest repeated passage of each leaked item."""
    found = leaks.leaked_passages(texts(spark, sf_dir), table(spark, sf_dir, "eval_items"), "doc_id", "item_id")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("words").alias("longest"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with more than half of their words in keyword matter."""
    return spam.spam_pages(texts(spark, sf_dir, "lang"), "doc_id", lang="lang").where("share > 0.5").select("doc_id")


def p9_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-frequency curve of each page against its peers."""
    return spam.page_curves(texts(spark, sf_dir, "lang"), "doc_id", lang="lang").withColumnRenamed("_id", "doc_id")


QUERIES = {"p1_found": p1_found, "p1_daily_sketches": p1_daily_sketches, "p1_percentiles": p1_percentiles, "p3_found": p3_found, "p6_found": p6_found, "p7_containers": p7_containers, "p7_invariants": p7_invariants, "p8_found": p8_found, "p8_leaked_items": p8_leaked_items, "p9_found": p9_found, "p9_curves": p9_curves}
SQL = {"p1_found": P1_SQL, "p3_found": P3_SQL, "p6_found": P6_SQL, "p7_invariants": P7_SQL}
