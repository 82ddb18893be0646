"""Primary and foreign keys, surrogate ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.columns import names
from sparkloom.operators.relational import dense_ids


def duplicate_keys(df: DataFrame, keys: str | list[str]) -> DataFrame:
    """Keys that stand in more than one row, with ``n``."""
    return df.groupBy(*names(keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_parents(child: DataFrame, column: str, parent: DataFrame, key: str, *, nullable: bool = True) -> DataFrame:
    """References without a parent: ``ref``, ``n``; null ones too, unless they are allowed."""
    refs = child.groupBy(F.col(column).alias("ref")).agg(F.count(F.lit(1)).alias("n"))
    if nullable:
        refs = refs.where("ref IS NOT NULL")
    return refs.join(parent.select(F.col(key).alias("ref")), "ref", "left_anti")


def validate(tables: dict[str, DataFrame], primary: dict[str, str | list[str]], foreign: list[tuple[str, str, str, str]]) -> DataFrame:
    """Violations of a set of tables: ``rule``, ``n`` (0 where a rule holds), all in one plan.

    ``primary`` names each table's key; ``foreign`` holds (table, column, parent table, parent key). Null references are allowed.
    """
    parts = [duplicate_keys(tables[t], k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"pk {t}({', '.join(names(k))})").alias("rule"), "n") for t, k in primary.items()]
    parts += [missing_parents(tables[t], c, tables[p], k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"fk {t}.{c} -> {p}.{k}").alias("rule"), "n") for t, c, p, k in foreign]
    if not parts:
        raise ValueError("no rules")
    return reduce(DataFrame.unionByName, parts)


def require_valid(violations: DataFrame) -> None:
    """Raise ValueError with the rules that don't hold."""
    bad = violations.where("n > 0").collect()  # one row for each rule
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']}" for r in bad))


#: Keys and references of the containers that are stored as several tables.
CONTAINERS: dict[str, tuple[dict[str, str | list[str]], list[tuple[str, str, str, str]]]] = {
    "library": (
        {"proteins": "protein_id", "peptides": "peptide_id", "precursors": "precursor_id", "fragments": "fragment_id"},
        [("protein_peptide", "protein_id", "proteins", "protein_id"), ("protein_peptide", "peptide_id", "peptides", "peptide_id"), ("precursors", "peptide_id", "peptides", "peptide_id"), ("fragments", "precursor_id", "precursors", "precursor_id")],
    ),
    "quant": ({"acquisitions": "acquisition_id"}, [("precursor_quant", "acquisition_id", "acquisitions", "acquisition_id"), ("peptide_quant", "acquisition_id", "acquisitions", "acquisition_id"), ("protein_quant", "acquisition_id", "acquisitions", "acquisition_id")]),
    "search": ({"acquisitions": "acquisition_id", "psms": "psm_id"}, [("psms", "acquisition_id", "acquisitions", "acquisition_id"), ("peptide_scores", "acquisition_id", "acquisitions", "acquisition_id"), ("protein_scores", "acquisition_id", "acquisitions", "acquisition_id")]),
    "alignments": ({"acquisitions": "acquisition_id", "alignments": "alignment_id"}, [("alignments", "acquisition_id", "acquisitions", "acquisition_id"), ("tags", "alignment_id", "alignments", "alignment_id")]),
    "annotation": ({"features": "feature_id"}, [("features", "parent_id", "features", "feature_id")]),
    "genome": ({"contigs": "contig_id"}, [("sequences", "contig_id", "contigs", "contig_id")]),
    "transcripts": ({"transcripts": "transcript_id"}, []),
    "samples": ({"samples": "sample_id", "acquisitions": "acquisition_id"}, [("edges", "sample_id", "samples", "sample_id"), ("edges", "acquisition_id", "acquisitions", "acquisition_id")]),
}


def validate_container(kind: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of a stored container; tables that it lacks are left out."""
    primary, foreign = CONTAINERS[kind]
    return validate(tables, {t: k for t, k in primary.items() if t in tables}, [f for f in foreign if f[0] in tables and f[2] in tables])


def length_mismatches(df: DataFrame, sequence: str, length: str) -> DataFrame:
    """Rows whose stated length isn't that of their sequence."""
    return df.where(~F.length(sequence).eqNullSafe(F.col(length)))


def assign_ids(tables: dict[str, tuple[DataFrame, str | list[str], str]]) -> dict[str, DataFrame]:
    """Dense ids from 0 in key order for several tables: name -> (table, natural key, id column)."""
    return {name: dense_ids(df, key, column) for name, (df, key, column) in tables.items()}
