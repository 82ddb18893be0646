"""Extraction targets, novel sequences and networks from library, search and quant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.intervals import first_per_group
from sparkloom.operators.relational import dedupe_first
from sparkloom.schemas import conform


def targets_from_library(precursors: DataFrame, peptides: DataFrame) -> DataFrame:
    """One target per precursor, with its peptide's sequence where there is one."""
    j = precursors.join(peptides.select("peptide_id", "modified_sequence"), "peptide_id", "left")
    return conform(j.withColumn("target_id", F.col("precursor_id")), "xic_targets")


def targets_from_search(psms: DataFrame, precursor_mz: Column) -> DataFrame:
    """One target per match: its id, scan and time are kept."""
    return conform(psms.withColumn("target_id", F.col("psm_id")).withColumn("precursor_mz", precursor_mz).withColumn("rt_center", F.col("rt")).withColumn("scan", F.col("scan").cast("long")), "xic_targets")


def targets_from_quant(quant: DataFrame, precursors: DataFrame, peptides: DataFrame) -> DataFrame:
    """One target per quantified precursor, with what the library knows of it."""
    j = quant.join(precursors.select("precursor_id", "peptide_id", "precursor_mz", "charge"), "precursor_id", "left").join(peptides.select("peptide_id", "modified_sequence"), "peptide_id", "left")
    return conform(j.withColumn("target_id", F.col("precursor_id")), "xic_targets")


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets from CSV with a header, parquet, or a bundle with precursors and peptides."""
    if path.endswith((".csv", ".tsv")):
        return conform(spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path), "xic_targets")
    if path.rstrip("/").endswith(".parquet"):
        return conform(spark.read.parquet(path), "xic_targets")
    from sparkloom.sources.sinks import load_bundle

    tables, _ = load_bundle(spark, path)
    return targets_from_library(tables["precursors"], tables["peptides"])


def exact_errors(traces: DataFrame, peaks: DataFrame) -> DataFrame:
    """Traces of rounded peaks with the m/z, intensity and error of the nearest full-precision peak of the same scan."""
    j = traces.withColumnsRenamed({"mz": "_mz", "intensity": "_i"}).join(peaks.select("scan", "mz", "intensity"), "scan")
    best = first_per_group(j, ["target_id", "ion", "scan"], F.abs(F.col("mz") - F.col("_mz")), F.asc("mz"))
    return best.withColumn("mz_error_ppm", (F.col("mz") - F.col("ion_mz")) / F.col("ion_mz") * 1e6).drop("_mz", "_i")


def novel_sequences(counts: DataFrame, reference: DataFrame, *, least_tpm: float) -> DataFrame:
    """Sequences above an average TPM that the reference lacks, the first id of each: ``protein_id``, ``sequence``, ``avg_tpm``."""
    mean = counts.groupBy("protein_id", "sequence").agg(F.avg("tpm").alias("avg_tpm")).where(F.col("avg_tpm") >= least_tpm)
    new = mean.withColumn("_h", F.sha2("sequence", 256)).join(reference.select(F.sha2("sequence", 256).alias("_h")), "_h", "left_anti").drop("_h")
    return dedupe_first(new, "sequence", "protein_id")


def combined_sequences(reference: DataFrame, novel: DataFrame, hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Reference and novel sequences, each sequence once, novel ones with the gene of their best hit: ``header``, ``sequence``, ``origin``."""
    best = first_per_group(hits, "query", F.asc("evalue"), F.when(F.col("aligned_to") == "reference", 0).otherwise(1), F.asc("target"))
    named = novel.join(best.select(F.col("query").alias("protein_id"), "target"), "protein_id", "left").join(genes.select(F.col("protein_id").alias("target"), "gene"), "target", "left")
    a = reference.select(F.col("record").alias("id"), "header", "sequence", F.lit(0).alias("rank"), F.lit("reference").alias("origin"))
    b = named.select(F.col("protein_id").alias("id"), F.concat(F.col("protein_id"), F.coalesce(F.concat(F.lit(" GN="), F.col("gene")), F.lit(""))).alias("header"), "sequence", F.lit(1).alias("rank"), F.lit("novel").alias("origin"))
    return dedupe_first(a.unionByName(b).withColumn("_o", F.struct("rank", "id")), "sequence", "_o").select("header", "sequence", "origin")


def unite_fasta(*tables: DataFrame) -> DataFrame:
    """Records of several FASTA tables, one after another."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def library_network(protein_peptide: DataFrame, precursors: DataFrame, *, tier: str = "peptide") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from proteins over peptides, and on to precursors if asked; ids carry the tier as a prefix."""
    name = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
    e = protein_peptide.select(name("protein", "protein_id").alias("src"), name("peptide", "peptide_id").alias("dst"))
    if tier == "precursor":
        e = e.unionByName(precursors.select(name("peptide", "peptide_id").alias("src"), name("precursor", "precursor_id").alias("dst")))
    e = e.distinct()
    return e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct(), e


def region_peaks(trace: DataFrame, matched: DataFrame, low_mz: float, high_mz: float) -> DataFrame:
    """Peaks of an m/z region that no channel matched."""
    return trace.where(F.col("mz").between(low_mz, high_mz)).join(matched.select("scan", "mz"), ["scan", "mz"], "left_anti")


def from_records(spark: SparkSession, records: dict[str, list[dict]], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of named schemas from a few records."""
    from sparkloom.schemas import get_schema

    return {t: spark.createDataFrame([tuple(r.get(f.name) for f in get_schema(schemas[t])) for r in rows], get_schema(schemas[t])) for t, rows in records.items()}
