"""Run-length coverage and segments cut from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.columns import names, require
from sparkloom.operators.periods import periods_and_gaps


def rle_coverage(df: DataFrame, keys: str | list[str], start: str, end: str, *, tile: int | None = None) -> DataFrame:
    """Depth of overlapping intervals as runs of equal depth: keys, ``start``, ``end``, ``depth``; depth 0 is left out.

    Starts and ends are counted per position in every map task, then summed up along each key. With ``tile``, intervals
    are first cut at multiples of it and each tile is swept by itself, so that a key with very many intervals is spread over
    tasks; runs that continue over a cut are joined again. Intervals with end <= start are dropped.
    """
    keys = names(keys)
    require(df, *keys, start, end)
    rows = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).where("_s < _e")
    part = list(keys)
    if tile:
        first, last = F.floor(F.col("_s") / tile), F.floor((F.col("_e") - 1) / tile)
        rows = rows.withColumn("_t", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        rows = rows.withColumn("_s", F.greatest("_s", F.col("_t") * tile)).withColumn("_e", F.least("_e", (F.col("_t") + 1) * tile))
        part.append("_t")
    events = rows.select(*part, F.inline(F.array(F.struct(F.col("_s").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("_e").alias("pos"), F.lit(-1).alias("step")))))
    steps = events.groupBy(*part, "pos").agg(F.sum("step").alias("step")).where("step <> 0")
    w = Window.partitionBy(*part).orderBy("pos")
    runs = steps.withColumn("depth", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("pos").over(w))
    runs = runs.where("depth > 0").select(*part, F.col("pos").alias("start"), F.col("_next").alias("end"), "depth")
    if not tile:
        return runs
    # runs that touch over a cut: an island of equal depth; only runs at a tile's edge can touch
    order = Window.partitionBy(*keys).orderBy("start")
    edge = ((F.col("start") % tile) == 0) | ((F.col("end") % tile) == 0)
    inner, outer = runs.where(~edge), runs.where(edge)
    new = ~((F.lag("end").over(order) == F.col("start")) & (F.lag("depth").over(order) == F.col("depth")))
    outer = outer.withColumn("_i", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = outer.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("depth").alias("depth")).drop("_i")
    return inner.drop("_t").unionByName(joined)


def merge_intervals(df: DataFrame, keys: str | list[str], start: str, end: str) -> DataFrame:
    """Overlapping and touching intervals merged: keys, ``start``, ``end``."""
    p = periods_and_gaps(df, keys, start, end, gaps=False)
    return p.select(*names(keys), F.col("range_start").alias("start"), F.col("range_end").alias("end"))


def runs_of(df: DataFrame, keys: str | list[str], order: list[Column], value: str) -> DataFrame:
    """Number of the run of equal consecutive values within each key, from 1, as ``run``."""
    w = Window.partitionBy(*names(keys)).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("run", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def cut_segments(segments: DataFrame, keys: str | list[str], start: str, end: str, cuts: DataFrame, position: str) -> DataFrame:
    """Segments cut at the positions strictly inside them: keys, ``start``, ``end``. Segments of one key don't overlap.

    Cut points and the segments' bounds are put in one order per key; each piece runs to the next bound.
    """
    keys = names(keys)
    bounds = segments.select(*keys, F.inline(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))))
    points = bounds.unionByName(cuts.select(*keys, F.col(position).alias("pos"), F.lit(0).alias("d")))
    points = points.groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("pos")
    pieces = points.withColumn("open", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("pos").over(w))
    return pieces.where("open > 0").select(*keys, F.col("pos").alias("start"), "end")


def derive_exons(coverage: DataFrame, introns: DataFrame, *, min_depth: int = 1, min_support: int = 3) -> DataFrame:
    """Exons from coverage: covered intervals of enough depth, cut at the edges of trusted introns, without pieces that are one.

    ``coverage``: contig_id, start, end, depth. ``introns``: contig_id, donor_pos, acceptor_pos, read_count; an intron is
    trusted if its summed support reaches ``min_support``.
    """
    deep = coverage.where(F.col("depth") >= min_depth)
    covered = merge_intervals(deep, "contig_id", "start", "end")
    trusted = introns.groupBy("contig_id", "donor_pos", "acceptor_pos").agg(F.sum("read_count").alias("n")).where(F.col("n") >= min_support)
    cuts = trusted.select("contig_id", F.explode(F.array("donor_pos", "acceptor_pos")).alias("pos")).distinct()
    pieces = cut_segments(covered, "contig_id", "start", "end", cuts, "pos")
    spliced = trusted.select("contig_id", F.col("donor_pos").alias("start"), F.col("acceptor_pos").alias("end"))
    return pieces.join(spliced, ["contig_id", "start", "end"], "left_anti")
