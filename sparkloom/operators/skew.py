"""Per-key results when a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.columns import names, require


@dataclass(frozen=True)
class Agg:
    """One mergeable aggregate: ``first`` over rows, ``merge`` over partial results, ``finish`` at the end.

    ``merge`` and ``finish`` take the column that the step before made.
    """

    first: Column
    merge: object
    finish: object = None


def count_rows() -> Agg:
    """Number of rows."""
    return Agg(F.count(F.lit(1)), F.sum)


def count_values(column: str) -> Agg:
    """Number of rows whose value isn't null."""
    return Agg(F.count(column), F.sum)


def total(column: str) -> Agg:
    """Sum; null if all values are null."""
    return Agg(F.sum(column), F.sum)


def least(column: str) -> Agg:
    """Smallest value."""
    return Agg(F.min(column), F.min)


def greatest(column: str) -> Agg:
    """Largest value."""
    return Agg(F.max(column), F.max)


def mean(column: str) -> Agg:
    """Average of the non-null values, from partial sums and counts."""
    return Agg(
        F.struct(F.sum(F.col(column).cast("double")).alias("s"), F.count(column).alias("n")),
        lambda c: F.struct(F.sum(c["s"]).alias("s"), F.sum(c["n"]).alias("n")),
        lambda c: F.when(c["n"] > 0, c["s"] / c["n"]),
    )


def approx_distinct(column: str, lg_k: int = 12) -> Agg:
    """Approximate number of different values, from mergeable sketches (relative error about 1.6 % at 12)."""
    return Agg(
        F.hll_sketch_agg(F.col(column), F.lit(lg_k)),
        lambda c: F.hll_union_agg(c),
        lambda c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0)),
    )


def heavy_keys(df: DataFrame, keys: str | list[str], share: float = 0.01) -> DataFrame:
    """Keys that hold at least ``share`` of all rows: key columns, ``rows``, ``total_rows``.

    There are at most ``1 / share`` of them, so this may be broadcast. Counts are pre-aggregated in every
    map task, so no task sees all rows of a key. A null key is a key like others. An empty table has none.
    """
    if not 0 < share <= 1:
        raise ValueError("share is a fraction of the rows")
    keys = names(keys)
    require(df, *keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    whole = df.agg(F.count(F.lit(1)).alias("total_rows"))
    # one row on one side: a scalar, not a product of rows
    return counts.join(F.broadcast(whole), F.col("rows") >= F.col("total_rows") * F.lit(float(share)))


def _tag(columns: list[str], stem: str) -> str:
    name = stem
    while name in columns:
        name += "_"
    return name


def salted_aggregate(
    df: DataFrame,
    keys: str | list[str],
    aggs: Mapping[str, Agg],
    *,
    share: float = 0.005,
    salts: int = 64,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Aggregate per key in two stages, so that no task gets all rows of a frequent key.

    Rows of heavy keys (at least ``share`` of all rows, so at most ``1 / share`` keys, which are broadcast) get
    one of ``salts`` salts; rows of other keys get salt 0. Stage one groups by key and salt, stage two merges
    the partial results per key. The salt comes from the row's place in its input partition: it is spread evenly
    even over identical rows, and a task that runs again gives the same salts.

    Null keys form one group. An empty table gives an empty result. Other columns of ``df`` are ignored; names in
    ``aggs`` may not repeat a key. Repeated rows count as often as they stand there.
    """
    keys = names(keys)
    require(df, *keys)
    if clash := set(aggs) & set(keys):
        raise ValueError(f"result names repeat keys: {sorted(clash)}")
    if salts < 1:
        raise ValueError("salts is at least 1")
    hot = heavy if heavy is not None else heavy_keys(df, keys, share)
    k = [f"_k{i}" for i in range(len(keys))]
    hot = hot.select(*[F.col(f"`{name}`").alias(f"_h{i}") for i, name in enumerate(keys)], F.lit(True).alias("_hot"))
    salt, row = _tag(df.columns, "_salt"), _tag(df.columns, "_row")
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), F.col(row)), F.lit(salts)).cast("int")
    numbered = df.withColumn(row, F.monotonically_increasing_id()).withColumns({c: F.col(f"`{name}`") for c, name in zip(k, keys)})
    on = F.lit(True)
    for i, c in enumerate(k):
        on = on & F.col(c).eqNullSafe(F.col(f"_h{i}"))
    salted = numbered.join(F.broadcast(hot), on, "left").withColumn(salt, F.when(F.col("_hot"), spread).otherwise(F.lit(0)))
    partial = salted.groupBy(*k, salt).agg(*[a.first.alias(f"_a{i}") for i, a in enumerate(aggs.values())])
    merged = partial.groupBy(*k).agg(*[a.merge(F.col(f"_a{i}")).alias(f"_m{i}") for i, a in enumerate(aggs.values())])
    done = [(a.finish or (lambda c: c))(F.col(f"_m{i}")).alias(name) for i, (name, a) in enumerate(aggs.items())]
    return merged.select(*[F.col(c).alias(name) for c, name in zip(k, keys)], *done)


def salted_join(left: DataFrame, right: DataFrame, keys: str | list[str], *, how: str = "inner", share: float = 0.005, salts: int = 16) -> DataFrame:
    """Join on equal keys where ``left`` has keys with very many rows.

    Rows of heavy keys of ``left`` are spread over ``salts`` salts, and the matching rows of ``right`` are copied
    once for each salt; other rows aren't copied. ``how`` is inner or left. Null keys match nothing. Columns of
    both sides other than the keys must differ in name.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    keys = names(keys)
    require(left, *keys)
    require(right, *keys)
    if clash := (set(left.columns) & set(right.columns)) - set(keys):
        raise ValueError(f"both sides have columns {sorted(clash)}")
    hot = heavy_keys(left.dropna(subset=keys), keys, share).select(*keys, F.lit(True).alias("_hot"))
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    a = left.withColumn("_spread", spread).join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.col("_spread")).otherwise(F.lit(0))).drop("_hot", "_spread")
    b = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
