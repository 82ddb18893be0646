"""Writers: text formats, table bundles, partitioned peak indexes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.integrity import CONTAINERS, require_valid, validate_container
from sparkloom.schemas import conform


def write_gff3(features: DataFrame, contigs: DataFrame, path: str) -> None:
    """Features as GFF3 lines: positions 1-based and closed again."""
    j = features.join(contigs.select("contig_id", F.col("name").alias("seqid")), "contig_id")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    own = F.concat_ws(";", F.concat(F.lit("ID="), F.col("feature_id").cast("string")), F.concat(F.lit("Name="), F.col("name")), F.concat(F.lit("Parent="), F.col("parent_id").cast("string")))
    j.select(F.concat_ws("\t", "seqid", dot("source"), "type", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), dot("score"), "strand", dot("phase"), own).alias("value")).write.mode("overwrite").text(path)


def write_fasta(df: DataFrame, header: str, sequence: str, path: str) -> None:
    """FASTA records, one sequence line each."""
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


def write_fastq(reads: DataFrame, demuxed: DataFrame, path: str) -> None:
    """Transcripts' bases and qualities of each sample, gzipped, one folder per sample."""
    j = reads.join(demuxed.select("read_id", "sample", "start", "end"), "read_id").where("sample IS NOT NULL")
    cut = lambda c: F.substring(F.col(c), F.col("start") + 1, F.col("end") - F.col("start"))
    text = F.concat(F.lit("@"), F.col("read_id"), F.lit("\n"), cut("sequence"), F.lit("\n+\n"), cut("quality"))
    j.select("sample", text.alias("value")).write.mode("overwrite").partitionBy("sample").option("compression", "gzip").text(path)


def write_matrix(df: DataFrame, path: str) -> None:
    """A table as TSV with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def save_bundle(tables: dict[str, DataFrame], path: str, kind: str, *, check: bool = True, metadata: dict | None = None) -> None:
    """Tables as parquet folders, and a manifest with kind, columns and metadata. Keys and references are checked first."""
    if check and kind in CONTAINERS:
        require_valid(validate_container(kind, tables))
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = {"kind": kind, "tables": {n: df.schema.jsonValue() for n, df in tables.items()}, "metadata": metadata or {}}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str, kind: str | None = None, schemas: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Tables and metadata of a bundle; tables with a named schema are brought to it."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if kind and manifest["kind"] != kind:
        raise ValueError(f"a bundle of {manifest['kind']}, not {kind}")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in manifest["tables"]}
    return {n: conform(df, schemas[n]) if schemas and n in schemas else df for n, df in tables.items()}, manifest["metadata"]


def write_peak_index(peaks: DataFrame, path: str) -> None:
    """Peaks by level and window as partition folders, sorted by m/z and time within files, so that scans prune folders and row groups."""
    p = peaks.repartition("level", "window_id", F.floor(F.col("mz") / 100)).sortWithinPartitions("level", "window_id", "mz", "rt")
    p.write.mode("overwrite").partitionBy("level", "window_id").parquet(path)


def read_peak_index(spark: SparkSession, path: str, level: int, low_mz: float, high_mz: float) -> DataFrame:
    """Peaks of a level and an m/z range; folders and row groups outside are skipped."""
    return spark.read.parquet(path).where((F.col("level") == level) & F.col("mz").between(low_mz, high_mz))


def bin_retention(peaks: DataFrame, width_s: float, path: str) -> None:
    """Peaks with their retention time bin, one folder per bin."""
    b = peaks.withColumn("rt_bin", F.floor(F.col("rt") / width_s).cast("int"))
    b.repartition("rt_bin").sortWithinPartitions("rt_bin", "scan", "mz").write.mode("overwrite").partitionBy("rt_bin").parquet(path)


def arrow_stream(df: DataFrame) -> bytes:
    """A small result, as of one viewport, as an Arrow IPC stream."""
    import pyarrow as pa

    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()
