"""Raw run folders and archives; arrays as rows and back."""

from __future__ import annotations

import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def members(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and ``content`` of the files in a zip archive or a folder; archives are opened where they are read."""
    if Path(path).is_dir():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.select(F.regexp_replace("path", r"^.*/", "").alias("name"), "content")

    def unzip(batches):
        import io

        for part in batches:
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame({"name": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "name string, content binary")


def arrays_to_rows(df: DataFrame, ident: str, *arrays: str) -> DataFrame:
    """One row per element of parallel arrays: ident, ``i``, and a column per array."""
    zipped = F.arrays_zip(*[F.col(a).alias(a) for a in arrays])
    return df.select(ident, F.posexplode(zipped).alias("i", "z")).select(ident, "i", *[F.col(f"z.{a}").alias(a) for a in arrays])


def rows_to_arrays(df: DataFrame, ident: str, order: str, *columns: str) -> DataFrame:
    """Arrays per ident, in order; the inverse of ``arrays_to_rows``."""
    g = df.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("z"))
    pick = lambda c: F.transform("z", lambda x: x[c]).alias(c)
    return g.select(ident, *[pick(c) for c in columns])


def check_lengths(df: DataFrame, array: str, length: int) -> DataFrame:
    """The rows; one whose array hasn't the length of the axis fails."""
    ok = F.size(array) == length
    return df.withColumn(array, F.when(ok | F.col(array).isNull(), F.col(array)).otherwise(F.raise_error(F.lit(f"{array} hasn't {length} values"))))


def channel_trace(trace: DataFrame, channel: str) -> DataFrame:
    """Times and intensities of one channel as two arrays."""
    rows = trace.where(F.col("channel_id") == channel).select(F.lit(0).alias("_k"), F.col("time_s").alias("_t"), "time_s", "intensity")
    return rows_to_arrays(rows, "_k", "_t", "time_s", "intensity").drop("_k")
