"""Named schemas and the cast of tables to them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REGISTRY: dict[str, T.StructType] = {}


_KINDS = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "SMALLINT": T.ShortType(), "TINYINT": T.ByteType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(), "BINARY": T.BinaryType()}


def _parse(ddl: str) -> T.StructType:
    """Flat DDL text to a struct type, without a session."""
    fields = [f.split(maxsplit=2) for f in ddl.split(",")]
    return T.StructType([T.StructField(f[0], _KINDS[f[1]], len(f) < 3) for f in fields])


def register_schema(name: str, schema: T.StructType | str) -> T.StructType:
    """Register a schema, as a struct type or flat DDL text; a name can't change its schema."""
    s = _parse(schema) if isinstance(schema, str) else schema
    if _REGISTRY.setdefault(name, s) != s:
        raise ValueError(f"{name} has another schema")
    return s


def get_schema(name: str) -> T.StructType:
    return _REGISTRY[name]


def schema_names() -> list[str]:
    return sorted(_REGISTRY)


def conform(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The schema's columns in its order and types: other columns go, absent nullable ones are null, absent required ones raise."""
    s = get_schema(schema) if isinstance(schema, str) else schema
    missing = [f.name for f in s if not f.nullable and f.name not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in s])


def with_metadata(df: DataFrame, column: str, metadata: dict) -> DataFrame:
    """Attach JSON metadata to a column; it is kept in parquet files."""
    json.dumps(metadata)
    return df.withMetadata(column, metadata)


def metadata_of(df: DataFrame, column: str) -> dict:
    return dict(df.schema[column].metadata)


#: Schemas of the stored tables.
_TABLES = {
    "contigs": "contig_id BIGINT NOT NULL, name STRING NOT NULL, length BIGINT NOT NULL",
    "sequences": "contig_id BIGINT NOT NULL, sequence STRING NOT NULL",
    "transcripts": "transcript_id BIGINT NOT NULL, name STRING NOT NULL, gene_id BIGINT, sequence STRING NOT NULL, length BIGINT NOT NULL",
    "features": "feature_id BIGINT NOT NULL, contig_id BIGINT NOT NULL, start BIGINT NOT NULL, end BIGINT NOT NULL, strand STRING NOT NULL, type STRING NOT NULL, name STRING, parent_id BIGINT, source STRING, score DOUBLE, phase INT, attributes_json STRING",
    "reads": "read_id STRING NOT NULL, acquisition_id BIGINT, sequence STRING NOT NULL, quality STRING, mean_quality DOUBLE, channel INT, start_time STRING, duration DOUBLE, read_group STRING, duplex INT",
    "alignments": "alignment_id BIGINT NOT NULL, read_id STRING NOT NULL, acquisition_id BIGINT, ref_name STRING NOT NULL, ref_start BIGINT NOT NULL, ref_end BIGINT NOT NULL, strand STRING NOT NULL, mapq INT, flag INT NOT NULL, cigar STRING, is_secondary BOOLEAN NOT NULL, is_supplementary BOOLEAN NOT NULL",
    "alignment_tags": "alignment_id BIGINT NOT NULL, tag STRING NOT NULL, type STRING NOT NULL, value STRING NOT NULL",
    "alignment_blocks": "alignment_id BIGINT NOT NULL, block_index INT NOT NULL, ref_start BIGINT NOT NULL, ref_end BIGINT NOT NULL, query_start BIGINT, query_end BIGINT, n_match BIGINT, n_mismatch BIGINT, n_insert BIGINT, n_delete BIGINT",
    "introns": "intron_id BIGINT NOT NULL, contig_id BIGINT NOT NULL, strand STRING NOT NULL, donor_pos BIGINT NOT NULL, acceptor_pos BIGINT NOT NULL, read_count BIGINT NOT NULL, motif STRING, is_intron_seed BOOLEAN, annotated BOOLEAN",
    "coverage": "contig_id BIGINT NOT NULL, sample_id BIGINT NOT NULL, start BIGINT NOT NULL, end BIGINT NOT NULL, depth INT NOT NULL",
    "feature_quant": "feature_id BIGINT NOT NULL, sample_id BIGINT NOT NULL, engine STRING NOT NULL, count DOUBLE NOT NULL, tpm DOUBLE",
    "exon_psi": "exon_id BIGINT NOT NULL, sample_id BIGINT NOT NULL, inclusion BIGINT NOT NULL, exclusion BIGINT NOT NULL, ambiguous BIGINT NOT NULL, psi FLOAT",
    "alignment_hits": "query STRING NOT NULL, target STRING NOT NULL, evalue DOUBLE NOT NULL, qstart BIGINT NOT NULL, qend BIGINT NOT NULL, tstart BIGINT NOT NULL, tend BIGINT NOT NULL, cigar STRING NOT NULL, aligned_to STRING",
    "acquisitions": "acquisition_id BIGINT NOT NULL, source_file STRING NOT NULL, source_kind STRING NOT NULL, acquisition_datetime STRING, instrument_serial STRING, instrument_model STRING, acquisition_order INT",
    "fragment_ions": "peptide_idx INT, peptide_seq STRING, position INT NOT NULL, ion_type TINYINT NOT NULL, charge INT NOT NULL, loss_id STRING, mz_theoretical DOUBLE NOT NULL",
    "peaks": "scan INT NOT NULL, level TINYINT NOT NULL, rt DOUBLE NOT NULL, mz DOUBLE NOT NULL, intensity DOUBLE NOT NULL, isolation_lower DOUBLE, isolation_upper DOUBLE, precursor_mz DOUBLE",
    "xic_targets": "target_id BIGINT NOT NULL, modified_sequence STRING, precursor_mz DOUBLE NOT NULL, charge INT NOT NULL, rt_center DOUBLE, rt_start DOUBLE, rt_end DOUBLE, scan BIGINT",
    "taxonomy_nodes": "taxid BIGINT NOT NULL, parent_taxid BIGINT NOT NULL, rank STRING NOT NULL, division_id SMALLINT, genetic_code_id SMALLINT, mito_genetic_code_id SMALLINT, scientific_name STRING NOT NULL",
    "taxonomy_names": "taxid BIGINT NOT NULL, name STRING NOT NULL, name_lower STRING NOT NULL, name_class STRING NOT NULL, unique_name STRING",
    "taxonomy_merged": "old_taxid BIGINT NOT NULL, new_taxid BIGINT NOT NULL",
    "assembly_catalog": "catalog_id BIGINT NOT NULL, source STRING NOT NULL, release STRING NOT NULL, taxid BIGINT, species_name STRING NOT NULL, organism_slug STRING NOT NULL, assembly_accession STRING, assembly_name STRING, assembly_level STRING, refseq_category STRING, annotation_release STRING, fasta_url STRING NOT NULL, gff_url STRING, cdna_url STRING, protein_url STRING, checksums_url STRING, checksums_kind STRING, division STRING",
    "trace": "time_s DOUBLE NOT NULL, intensity DOUBLE NOT NULL, channel_id STRING",
    "atoms": "serial INT NOT NULL, name STRING NOT NULL, alt_loc STRING, res_name STRING NOT NULL, chain_id STRING NOT NULL, res_seq INT NOT NULL, ins_code STRING, segment_id STRING, element STRING NOT NULL, occupancy FLOAT, b_factor FLOAT, formal_charge TINYINT, is_hetatm BOOLEAN NOT NULL, model_id INT",
    "psms": "psm_id BIGINT NOT NULL, acquisition_id BIGINT NOT NULL, scan INT, modified_sequence STRING NOT NULL, charge INT, rt DOUBLE, score DOUBLE, qvalue DOUBLE, is_decoy BOOLEAN",
}
for _name, _ddl in _TABLES.items():
    register_schema(_name, _ddl)
