"""References to records that do not exist, per table and period."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parent:
    """A table that others refer to: its rows, the key, whether a row is live, and the day it came."""

    name: str
    rows: DataFrame
    key: Column
    live: Column
    day: Column


@dataclass(frozen=True)
class Child:
    """A table whose rows refer to a parent's key; ``period`` groups the report. ``keys`` may be an array to explode."""

    name: str
    parent: str
    rows: DataFrame
    key: Column
    period: Column
    many: bool = False


def orphan_references(parents: list[Parent], children: list[Child]) -> DataFrame:
    """Orphan references: source_table, parent_table, period, ref_key, reason, n_refs.

    Parent and child keys are tagged and united in long form, after a count per table, key and period in
    every map task, then grouped by parent table and key. Each group holds one entry per source and period, so its
    size is bounded by the number of periods, however many rows share the key. ``reason`` is ``missing`` if
    the parent has no row with the key, ``deleted`` if it has rows but no live one, ``late`` if the earliest
    day of its live rows is after the period. ``n_refs`` counts the referring rows (elements of an array each).

    Null keys refer to nothing. A reference without a period is reported with a null period and can't be late; live
    parents without a day count as always there. Empty tables give no rows (of the child) or only ``missing``.
    """
    known = {p.name for p in parents}
    if unknown := {c.parent for c in children} - known:
        raise ValueError(f"no such parent: {sorted(unknown)}")
    nothing = F.lit(None)
    long = []
    for p in parents:
        rows = p.rows.select(p.key.cast("string").alias("ref_key"), p.live.alias("_live"), p.day.cast("string").alias("_day")).where("ref_key is not null")
        seen = rows.groupBy("ref_key").agg(F.max(F.coalesce("_live", F.lit(False))).alias("_live"), F.min(F.when(F.col("_live"), F.coalesce("_day", F.lit("")))).alias("_day"))
        long.append(seen.select(F.lit(p.name).alias("parent_table"), "ref_key", F.lit(True).alias("_parent"), "_live", "_day", nothing.cast("string").alias("source_table"), nothing.cast("string").alias("period"), nothing.cast("long").alias("n_refs")))
    for c in children:
        key = F.explode(c.key) if c.many else c.key
        rows = c.rows.select(c.period.cast("string").alias("period"), key.alias("ref_key")).withColumn("ref_key", F.col("ref_key").cast("string")).where("ref_key is not null")
        counted = rows.groupBy("ref_key", "period").agg(F.count(F.lit(1)).alias("n_refs"))
        long.append(counted.select(F.lit(c.parent).alias("parent_table"), "ref_key", F.lit(False).alias("_parent"), F.lit(False).alias("_live"), nothing.cast("string").alias("_day"), F.lit(c.name).alias("source_table"), "period", "n_refs"))
    united = reduce(DataFrame.unionByName, long)
    groups = united.groupBy("parent_table", "ref_key").agg(
        F.max("_parent").alias("_parent"),
        F.max("_live").alias("_live"),
        F.min("_day").alias("_day"),
        F.collect_list(F.when(F.col("source_table").isNotNull(), F.struct("source_table", "period", "n_refs"))).alias("_refs"),
    )
    # groups whose references are all good go before the explode
    late = F.col("_live") & F.exists("_refs", lambda r: r["period"] < F.col("_day"))
    refs = groups.where((~F.col("_live")) | late).select("parent_table", "ref_key", "_parent", "_live", "_day", F.explode("_refs").alias("r"))
    reason = F.when(~F.col("_parent"), "missing").when(~F.col("_live"), "deleted").when(F.col("_day") > F.col("r.period"), "late")
    return refs.select("r.source_table", "parent_table", "r.period", "ref_key", reason.alias("reason"), "r.n_refs").where("reason is not null")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Sums of ``orphan_references`` by period: source_table, period, reason, n_keys, n_refs."""
    return orphans.groupBy("source_table", "period", "reason").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_refs").alias("n_refs"))
