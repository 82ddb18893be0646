"""Counts, normalised counts, matrices, ratios and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.columns import names


def per_million(df: DataFrame, sample: str, count: str = "count", *, length: str | None = None, min_length: int = 0) -> DataFrame:
    """Adds ``tpm`` = count * 1e6 / sum of the sample; rows shorter than ``min_length`` go before the sum.

    Sample totals are aggregated in map tasks and joined back, so a sample with very many rows isn't one window.
    """
    if length and min_length:
        df = df.where(F.col(length) >= min_length)
    totals = df.groupBy(sample).agg(F.sum(count).alias("_total"))
    return df.join(totals, sample, "left").withColumn("tpm", F.when(F.col("_total") > 0, F.col(count) * 1e6 / F.col("_total"))).drop("_total")


def counts_per_feature(df: DataFrame, feature: str | list[str], sample: str) -> DataFrame:
    """Rows per feature and sample, with ``tpm``."""
    return per_million(df.groupBy(*names(feature), sample).agg(F.count(F.lit(1)).alias("count")), sample)


def count_matrix(df: DataFrame, feature: str | list[str], sample: str, value: str, samples: list[str], *, features: DataFrame | None = None, min_total: float = 0, total: str | None = None) -> DataFrame:
    """One row per feature, one column per sample, 0 where there is nothing; features of less than ``min_total`` of ``total`` go.

    Conditional sums instead of a pivot that looks for the values first: one aggregation. ``features`` adds features that have no rows.
    """
    keys = names(feature)
    cells = [F.sum(F.when(F.col(sample) == s, F.col(value))).alias(s) for s in samples]
    wide = df.groupBy(*keys).agg(*cells, F.sum(total or value).alias("_total"))
    if features is not None:
        wide = features.join(wide, keys, "left")
    wide = wide.withColumn("_total", F.coalesce("_total", F.lit(0)))
    if min_total:
        wide = wide.where(F.col("_total") >= min_total)
    return wide.drop("_total").na.fill(0, subset=samples)


def tpm_matrix(df: DataFrame, feature: str, sample: str, samples: list[str]) -> DataFrame:
    """Count per sample and ``avg_tpm`` over the samples where the feature is present, in falling order of it."""
    cells = [F.coalesce(F.sum(F.when(F.col(sample) == s, F.col("count"))), F.lit(0)).alias(s) for s in samples]
    return df.groupBy(feature).agg(*cells, F.avg("tpm").alias("avg_tpm")).orderBy(F.desc("avg_tpm"), feature)


def ranked_labels(df: DataFrame, key: str, sample: str, count: str, *, least: int = 2, prefix: str = "P") -> DataFrame:
    """Partial counts summed per key and sample; keys with a total of at least ``least`` get labels P0, P1, ... by falling total, then key."""
    from sparkloom.session import cut_lineage, shuffle_partitions

    cells = df.groupBy(key, sample).agg(F.sum(count).alias("count"))
    totals = cells.groupBy(key).agg(F.sum("count").alias("_total")).where(F.col("_total") >= least)
    # numbers over a range partitioning: no single task sorts all keys
    order = [F.desc("_total"), F.asc(key)]
    placed = totals.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("_pid", F.spark_partition_id())
    local = cut_lineage(placed.withColumn("_n", F.row_number().over(Window.partitionBy("_pid").orderBy(*order))))
    before = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    labels = local.join(F.broadcast(before), "_pid").select(key, F.concat(F.lit(prefix), (F.col("_b") + F.col("_n") - 1).cast("string")).alias("label"))
    return cells.join(labels, key)


def inclusion_ratio(df: DataFrame, keys: str | list[str], included: Column, excluded: Column) -> DataFrame:
    """``inclusion``, ``exclusion``, ``ambiguous`` and ``psi`` = inclusion / (inclusion + exclusion), null where both are 0."""
    out = df.groupBy(*names(keys)).agg(F.count_if(included).alias("inclusion"), F.count_if(excluded).alias("exclusion"), F.count_if(~F.coalesce(included, F.lit(False)) & ~F.coalesce(excluded, F.lit(False))).alias("ambiguous"))
    both = F.col("inclusion") + F.col("exclusion")
    return out.withColumn("psi", F.when(both > 0, F.col("inclusion") / both).cast("float"))


def exon_psi(pairs: DataFrame, spans: DataFrame, exon: str = "exon_id", sample: str = "sample_id") -> DataFrame:
    """PSI per exon and sample: reads that span an exon include it if one of their blocks overlaps it, else exclude it.

    ``pairs``: distinct (alignment_id, exon) overlaps of blocks. ``spans``: (alignment_id, exon, sample, role) of alignments
    over exons; partial ones without overlap are ambiguous.
    """
    j = spans.join(pairs.select("alignment_id", exon).distinct().withColumn("_in", F.lit(True)), ["alignment_id", exon], "left")
    inside = F.coalesce(F.col("_in"), F.lit(False))
    return inclusion_ratio(j.withColumn(sample, F.coalesce(sample, F.lit(-1))), [exon, sample], inside, ~inside & (F.col("role") == "spanning"))


def alignment_metrics(blocks: DataFrame) -> DataFrame:
    """Sums of matches, mismatches, insertions and deletions per alignment, and whether every block has them."""
    parts = ["n_match", "n_mismatch", "n_insert", "n_delete"]
    has_all = F.lit(True)
    for c in parts:
        has_all = has_all & F.col(c).isNotNull()
    return blocks.groupBy("alignment_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in parts], F.bool_and(has_all).alias("complete"))


def window_ids(peaks: DataFrame, level: str, lo: str, hi: str, mz: str, *, max_windows: int = 512, width: float = 2.0) -> DataFrame:
    """Isolation windows per level: native ones numbered in order, or bins of ``width`` m/z where a level has more than ``max_windows``."""
    distinct = peaks.select(level, lo, hi).distinct()
    many = distinct.groupBy(level).agg(F.count(F.lit(1)).alias("_n"))
    numbered = distinct.join(F.broadcast(many.where(F.col("_n") <= max_windows)), level).withColumn("_native", F.dense_rank().over(Window.partitionBy(level).orderBy(F.asc_nulls_first(lo), F.asc_nulls_first(hi))) - 1)
    n = numbered.select(F.col(level).alias("_lv"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), "_native")
    on = (peaks[level] == n["_lv"]) & peaks[lo].eqNullSafe(n["_lo"]) & peaks[hi].eqNullSafe(n["_hi"])
    j = peaks.join(F.broadcast(n), on, "left")  # at most max_windows rows for each level
    return j.withColumn("window_id", F.coalesce(F.col("_native").cast("long"), F.floor(F.col(mz) / width))).drop("_lv", "_lo", "_hi", "_native")


def distribution(df: DataFrame, value: str, keys: str | list[str] = (), pcts: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, exact percentiles (linear), and maximum of a value per group; ``p50`` and so on."""
    cols = [F.count(value).alias("n")] + [F.percentile(value, F.lit(p)).alias(f"p{p * 100:g}".replace(".", "_")) for p in pcts] + [F.max(value).alias("max")]
    keys = names(keys)
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def histogram(df: DataFrame, value: str, edges: list[float], keys: str | list[str] = ()) -> DataFrame:
    """Rows per bin [edge, next edge); bin 0 lies below the first edge."""
    b = F.lit(0)
    for i, e in enumerate(edges, 1):
        b = F.when(F.col(value) >= e, F.lit(i)).otherwise(b)
    return df.where(F.col(value).isNotNull()).groupBy(*names(keys), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Motifs of canonical splice sites.
CANONICAL_MOTIFS = ("GT-AG", "GC-AG", "AT-AC")


def motif_composition(introns: DataFrame) -> DataFrame:
    """Seeds and support per canonical motif and ``other``, zero-filled, with percents."""
    kind = F.when(F.col("motif").isin(*CANONICAL_MOTIFS), F.col("motif")).otherwise("other")
    found = introns.groupBy(kind.alias("motif")).agg(F.count_if("is_intron_seed").alias("seeds"), F.sum("read_count").alias("support"))
    every = introns.sparkSession.createDataFrame([(m,) for m in (*CANONICAL_MOTIFS, "other")], "motif string")
    j = every.join(found, "motif", "left").na.fill(0, subset=["seeds", "support"])
    whole = found.agg(F.sum("seeds").alias("_a"), F.sum("support").alias("_b"))
    j = j.join(F.broadcast(whole))
    return j.select("motif", "seeds", "support", F.coalesce(F.try_divide(F.col("seeds") * 100, F.col("_a")), F.lit(0.0)).alias("seed_pct"), F.coalesce(F.try_divide(F.col("support") * 100, F.col("_b")), F.lit(0.0)).alias("support_pct"))


def annotated_agreement(introns: DataFrame) -> DataFrame:
    """Introns and support by whether they are annotated; unknown counts as not."""
    return introns.groupBy(F.coalesce("annotated", F.lit(False)).alias("annotated")).agg(F.count(F.lit(1)).alias("introns"), F.sum("read_count").alias("support"))


def quality_summary(df: DataFrame, value: str = "mapq") -> DataFrame:
    """Median, percent of zeros and percent below 30."""
    v = F.col(value)
    return df.agg(F.median(v).alias("median"), (F.avg(F.when(v == 0, 1.0).otherwise(0.0)) * 100).alias("zero_pct"), (F.avg(F.when(v < 30, 1.0).otherwise(0.0)) * 100).alias("below_30_pct"))


def overlaps_per_item(pairs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """How many items have 0, 1, 2, ... partners: ``n_partners``, ``n_items``."""
    n = items.select(key).distinct().join(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_partners")), key, "left")
    return n.groupBy(F.coalesce("n_partners", F.lit(0)).alias("n_partners")).agg(F.count(F.lit(1)).alias("n_items"))


def json_attribute(column: str, *keys: str) -> Column:
    """First of some keys that a JSON text has."""
    return F.coalesce(*[F.get_json_object(column, f"$.{k}") for k in keys])


def unpivot_counts(df: DataFrame, ids: list[str], samples: list[str], *, drop: tuple[str, ...] = ()) -> DataFrame:
    """Wide counts to rows: ids, ``sample``, ``count``; zeros stay, counts become whole numbers."""
    return df.drop(*drop).unpivot(ids, samples, "sample", "count").withColumn("count", F.col("count").cast("double").cast("long"))
