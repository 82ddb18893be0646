"""Structured Streaming: bins, sessions, late data, resumable ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, *, max_files: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], value: str, *, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Count, sum and maximum of a value per time bin and key, on a stream or a table; rows later than ``late`` are dropped on a stream."""
    if late:
        df = df.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("greatest"))
    return g.select(F.col("w.start").alias("bin_start"), *keys, "n", "total", "greatest")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *, late: str | None = None) -> DataFrame:
    """Sessions per key: rows closer than the gap belong together."""
    if late:
        df = df.withWatermark(time, late)
    g = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def ingest(df: DataFrame, path: str, checkpoint: str, *, transform: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> None:
    """Process all files that are there and not yet done, then stop; a later call goes on from the checkpoint.

    With ``transform``, each batch gives several tables, written below ``path`` under the batch's number: a batch that is
    repeated after a failure replaces its own output.
    """
    def several(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, out in transform(batch).items():
            out.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = w.foreachBatch(several).start() if transform else w.format("parquet").option("path", path).outputMode("append").start()
    query.awaitTermination()


def group_in_order(df: DataFrame, key: str, time: str, width: float) -> DataFrame:
    """Runs of equal time bins per key in arrival order, kept as state: a row of another bin opens a new group, late rows too.

    Result: key, bin, group_no, n for each group that ended within a batch or is open at its end.
    """
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bin_, no, n = state.get if state.exists else (None, -1, 0)
        rows = []
        for part in parts:
            for t in part[time]:
                b = int(t // width)
                if b != bin_:
                    if bin_ is not None:
                        rows.append((k[0], bin_, no, n))
                    bin_, no, n = b, no + 1, 0
                n += 1
        state.update((bin_, no, n))
        rows.append((k[0], bin_, no, n))
        yield pd.DataFrame(rows, columns=[key, "bin", "group_no", "n"])

    return df.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, bin long, group_no long, n long", "bin long, no long, n long", "append", "NoTimeout")
