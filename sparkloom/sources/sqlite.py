"""SQLite libraries and raw files with zlib-compressed arrays of big-endian floats."""

from __future__ import annotations

import sqlite3
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a library file and of a raw file.
TABLES = ("entries", "peptidetoprotein", "peptidequants", "peptidescores", "proteinscores", "retentiontimes", "fragmentquants", "metadata", "precursor", "spectra", "ranges")


def decode_of(blob: bytes | None, kind: str = "f8", length: int | None = None) -> list[float] | None:
    """Values of a compressed array; a length that doesn't fit raises."""
    if blob is None:
        return None
    raw = zlib.decompress(blob)
    if length is not None and length != len(raw):
        raise ValueError(f"{len(raw)} bytes, not {length}")
    return np.frombuffer(raw, f">{kind}").astype(float).tolist()


def encode_of(values, kind: str = "f8") -> tuple[bytes, int]:
    """Compressed array and its length in bytes before."""
    raw = np.asarray(values, f">{kind}").tobytes()
    return zlib.compress(raw), len(raw)


def _decode(kind: str, result: str):
    def make(blob: str | Column) -> Column:
        @F.pandas_udf(result)
        def run(s: pd.Series) -> pd.Series:
            def one(b):
                try:
                    return decode_of(b, kind) if b is not None else None
                except (zlib.error, ValueError):
                    return None

            return s.map(one)

        return run(F.col(blob) if isinstance(blob, str) else blob)

    return make


#: Arrays of 8-byte and 4-byte floats; null where the bytes can't be read.
decompress_mz = _decode("f8", "array<double>")
decompress_intensity = _decode("f4", "array<double>")


def compress(values: str | Column, kind: str = "f8") -> Column:
    """struct(blob, length) of each array."""

    @F.pandas_udf("struct<blob:binary,length:int>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([encode_of(v, kind) if v is not None else (None, None) for v in s], columns=["blob", "length"], dtype=object)

    return run(F.col(values) if isinstance(values, str) else values)


def read_table(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, *, parts: int = 16) -> DataFrame:
    """A table of a SQLite file that executors can reach, read in ranges of rowid by as many tasks."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table}")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        info = c.execute(f"PRAGMA table_info({table})").fetchall()
        low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
    kinds = {"INT": "bigint", "INTEGER": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary", "BOOLEAN": "bigint"}
    cols = [(n, kinds.get((t or "").upper().split("(")[0], "string")) for _, n, t, *_ in info if columns is None or n in columns]
    schema, chosen = ", ".join(f"`{n}` {t}" for n, t in cols), ", ".join(f'"{n}"' for n, _ in cols)
    if low is None:
        return spark.createDataFrame([], schema)
    step = max(1, -(-(high - low + 1) // parts))

    def scan(batches):
        for part in batches:
            for a in part["id"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                    rows = c.execute(f"SELECT {chosen} FROM {table} WHERE rowid >= ? AND rowid < ?", (int(a), int(a) + step))
                    while chunk := rows.fetchmany(5000):
                        yield pd.DataFrame(chunk, columns=[n for n, _ in cols])

    return spark.range(low, high + 1, step, numPartitions=min(parts, -(-(high - low + 1) // step))).mapInPandas(scan, schema)


def write_table(df: DataFrame, path: str, table: str) -> int:
    """Append rows to a table of one SQLite file, partition by partition through the driver; a file has one writer."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    cols = ", ".join(f'"{n}" {kinds.get(t, "TEXT")}' for n, t in df.dtypes)
    n = 0
    with sqlite3.connect(path) as c:
        c.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({cols})')
        slots = ", ".join("?" * len(df.columns))
        for row in df.toLocalIterator():
            c.execute(f'INSERT INTO "{table}" VALUES ({slots})', [bytes(v) if isinstance(v, bytearray) else v for v in row])
            n += 1
    return n


def read_library(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Entries with their arrays decoded, and the tables beside them."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        there = {r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    out = {t: read_table(spark, path, t) for t in TABLES if t in there}
    if "entries" in out:
        out["entries"] = decode_entries(out["entries"])
    return out


def decode_entries(entries: DataFrame) -> DataFrame:
    """Adds mz, intensity and correlation arrays to library entries."""
    return entries.withColumns({"mz": decompress_mz("MassArray"), "intensity": decompress_intensity("IntensityArray"), "correlation": decompress_intensity("CorrelationArray")})


def read_dia(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Raw spectra and survey scans with decoded arrays, and the isolation windows."""
    out = {t: read_table(spark, path, t) for t in ("spectra", "precursor")}
    out = {t: d.withColumns({"mz_list": decompress_mz("MassArray"), "intensity_list": decompress_intensity("IntensityArray")}) for t, d in out.items()}
    return out | {"ranges": read_table(spark, path, "ranges")}
