"""Consensus of sequences and of spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.columns import names


def sequence_consensus(votes: DataFrame, reference: DataFrame, keys: str | list[str], *, min_depth: int = 3) -> DataFrame:
    """Consensus sequence per key from weighted votes per position.

    ``votes``: keys, pos, base, weight; ``reference``: keys, pos, base. Positions of less than ``min_depth`` weight take the
    reference base. The base of the greatest weight wins, in alphabetical order on ties; a gap (``-``) or an ambiguous
    winner is left out of the sequence.
    """
    keys = names(keys)
    per = votes.groupBy(*keys, "pos", F.upper("base").alias("base")).agg(F.sum("weight").alias("w"))
    win = per.groupBy(*keys, "pos").agg(F.sum("w").alias("depth"), F.min(F.struct((-F.col("w")).alias("w"), "base")).alias("b"))
    j = reference.withColumnRenamed("base", "_ref").join(win, [*keys, "pos"], "left")
    base = F.when(F.coalesce("depth", F.lit(0)) < min_depth, F.upper("_ref")).otherwise(F.col("b.base"))
    kept = j.withColumn("base", base).where(F.col("base").isin("A", "C", "G", "T"))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("consensus"))


def spectrum_consensus(spectra: DataFrame, keys: str | list[str], *, how: str = "sum") -> DataFrame:
    """Consensus intensity per channel and the spread of the replicates' proportions.

    ``spectra``: keys, replicate, channel, intensity, on a common basis; a channel that a replicate lacks counts as 0.
    Result: keys, channel, ``intensity`` (sum or median), ``proportion``, ``spread`` (population deviation of proportions).
    """
    if how not in ("sum", "median"):
        raise ValueError("how is sum or median")
    keys = names(keys)
    totals = spectra.groupBy(*keys, "replicate").agg(F.sum("intensity").alias("_t"))
    grid = totals.join(spectra.select(*keys, "channel").distinct(), keys).join(spectra, [*keys, "replicate", "channel"], "left").na.fill(0.0, subset=["intensity"])
    grid = grid.withColumn("_p", F.coalesce(F.try_divide("intensity", "_t"), F.lit(0.0)))
    value = F.sum("intensity") if how == "sum" else F.median("intensity")
    out = grid.groupBy(*keys, "channel").agg(value.alias("intensity"), F.stddev_pop("_p").alias("spread"))
    bulk = out.groupBy(*keys).agg(F.sum("intensity").alias("_b"))
    return out.join(bulk, keys).withColumn("proportion", F.coalesce(F.try_divide("intensity", "_b"), F.lit(0.0))).select(*keys, "channel", "intensity", "proportion", "spread")


def replicate_deviance(spectra: DataFrame, consensus: DataFrame, keys: str | list[str]) -> DataFrame:
    """Deviance of each replicate from the consensus proportions: 2 * sum(x * ln((x / n) / p)) over its channels."""
    keys = names(keys)
    n = spectra.groupBy(*keys, "replicate").agg(F.sum("intensity").alias("_n"))
    j = spectra.join(n, [*keys, "replicate"]).join(consensus.select(*keys, "channel", "proportion"), [*keys, "channel"]).where("intensity > 0 AND proportion > 0")
    return j.groupBy(*keys, "replicate").agg((2 * F.sum(F.col("intensity") * F.ln(F.col("intensity") / F.col("_n") / F.col("proportion")))).alias("deviance"))
