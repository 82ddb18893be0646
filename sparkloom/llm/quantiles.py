"""Percentiles per group with bounded relative error, from mergeable counts in signed logarithmic buckets."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.columns import names, require


@dataclass(frozen=True)
class LogBuckets:
    """Buckets (anchor * gamma**(i - 1), anchor * gamma**i] for both signs, and one for zero.

    ``rel_error`` bounds the relative error of every estimate. An ``anchor`` is an upper edge of a bucket, so values
    on either side of it, or of -anchor, never share one.
    """

    rel_error: float = 0.01
    anchor: float = 1.0

    def __post_init__(self) -> None:
        if not 0 < self.rel_error < 1 or not 0 < self.anchor < math.inf:
            raise ValueError("rel_error lies between 0 and 1, anchor is positive")

    @property
    def log_gamma(self) -> float:
        return math.log((1 + self.rel_error) / (1 - self.rel_error))

    @property
    def offset(self) -> int:
        """Added to the index, so that it is positive for every double."""
        return math.ceil((1500 + abs(math.log(self.anchor))) / self.log_gamma)

    def bucket(self, value: Column) -> Column:
        """Signed bucket number; greater values never have smaller numbers. Infinite values have buckets of their own."""
        size = F.abs(value)
        i = F.when(size == math.inf, F.lit(2 * self.offset)).otherwise(F.ceil(F.ln(size / F.lit(self.anchor)) / F.lit(self.log_gamma)) + F.lit(self.offset))
        return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("int") * i.cast("int"))

    def estimate(self, bucket: Column) -> Column:
        """The value of a bucket that is off by at most ``rel_error`` from any value in it."""
        gamma = math.exp(self.log_gamma)
        i = F.abs(bucket) - F.lit(self.offset)
        size = F.when(F.abs(bucket) >= 2 * self.offset, F.lit(math.inf)).otherwise(F.exp(F.lit(math.log(self.anchor) + math.log(2 / (1 + gamma))) + i * F.lit(self.log_gamma)))
        return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def sketch(df: DataFrame, keys: str | list[str], value: str, buckets: LogBuckets = LogBuckets()) -> DataFrame:
    """Counts per key and bucket: keys, ``bucket``, ``n``, ``least``, ``most``.

    Null and NaN values are left out; null keys form a group of their own; an empty table gives an empty sketch.
    Rows are counted in every map task first, so a key with very many rows sends one row per bucket and task. Columns of
    ``df`` other than keys and value are ignored; repeated rows count as often as they stand there.
    """
    keys = names(keys)
    require(df, *keys, value)
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*[F.col(f"`{k}`") for k in keys], v.alias("_v")).where("_v is not null and not isnan(_v)")
    return rows.groupBy(*keys, buckets.bucket(F.col("_v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def merge(sketches: DataFrame, keys: str | list[str]) -> DataFrame:
    """Add matching buckets of sketches, as of several days, into the sketch of ``keys``."""
    return sketches.groupBy(*names(keys), "bucket").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def percentiles(sketches: DataFrame, keys: str | list[str], pcts: list[float], buckets: LogBuckets = LogBuckets()) -> DataFrame:
    """Percentiles of a sketch with one row per key and bucket: keys, ``pct``, ``value``, ``n_values``.

    A percentile lies between the two values next to rank pct / 100 * (n - 1), as in linear interpolation; each of the two
    is off by at most ``rel_error``. The first and last value of a bucket are known exactly, so two values of different
    buckets are exact: the result lies on the true side of the anchor. ``pct`` keeps the type of ``pcts``; equal ones come once.
    """
    keys = names(keys)
    wanted = sorted(set(pcts))
    if any(not 0 <= p <= 100 for p in wanted):
        raise ValueError("percentiles lie between 0 and 100")
    # a key has no more rows than there are buckets
    w = Window.partitionBy(*keys)
    upto = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketches.withColumn("_cum", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(w))
    pct = F.array(*[F.lit(p) for p in wanted])
    at = lambda p: p.cast("double") / 100 * (F.col("_all") - 1)
    here = lambda r: (r >= F.col("_cum") - F.col("n")) & (r < F.col("_cum"))
    hit = ranked.withColumn("pct", F.explode(F.filter(pct, lambda p: here(F.floor(at(p))) | here(F.ceil(at(p))))))
    middle = F.greatest(F.least(buckets.estimate(F.col("bucket")), F.col("most")), F.col("least"))

    def value(rank: Column) -> Column:
        inside = F.when(rank == F.col("_cum") - F.col("n"), F.col("least")).when(rank == F.col("_cum") - 1, F.col("most")).otherwise(middle)
        return F.max(F.when(here(rank), inside))

    r = at(F.col("pct"))
    both = hit.groupBy(*keys, "pct").agg(value(F.floor(r)).alias("_lo"), value(F.ceil(r)).alias("_hi"), F.first("_all").alias("n_values"))
    share = F.col("pct").cast("double") / 100 * (F.col("n_values") - 1)
    part = share - F.floor(share)
    result = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + part * (F.col("_hi") - F.col("_lo")))
    return both.select(*keys, "pct", result.alias("value"), "n_values")
