"""Greedy and key-based clustering of junctions, reads and intervals."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.columns import names
from sparkloom.operators.aggregates import CANONICAL_MOTIFS
from sparkloom.operators.intervals import interval_join
from sparkloom.operators.periods import periods_and_gaps
from sparkloom.operators.relational import dense_ids
from sparkloom.session import cut_lineage, shuffle_partitions


def junctions(blocks: DataFrame, alignments: DataFrame) -> DataFrame:
    """Junctions between consecutive blocks of each alignment: alignment_id, contig_id, strand, junction_index, donor_pos, acceptor_pos."""
    w = Window.partitionBy("alignment_id").orderBy("block_index")
    pairs = blocks.select("alignment_id", "block_index", F.col("ref_end").alias("donor_pos"), F.lead("ref_start").over(w).alias("acceptor_pos")).where("acceptor_pos IS NOT NULL")
    return pairs.withColumnRenamed("block_index", "junction_index").join(alignments.select("alignment_id", "contig_id", "strand"), "alignment_id")


def splice_motif(sequence: str | Column, donor: str | Column, acceptor: str | Column, strand: str | Column) -> Column:
    """Bases at both ends of an intron as ``GT-AG``; ``other`` if not canonical or beyond the sequence. Positions are 0-based, half-open."""
    s, d, a, st = (F.col(x) if isinstance(x, str) else x for x in (sequence, donor, acceptor, strand))
    left, right = F.upper(F.substring(s, d + 1, F.lit(2))), F.upper(F.substring(s, a - 1, F.lit(2)))
    comp = lambda x: F.reverse(F.translate(x, "ACGT", "TGCA"))
    motif = F.when(st == "-", F.concat_ws("-", comp(right), comp(left))).otherwise(F.concat_ws("-", left, right))
    fits = (d >= 0) & (a >= d + 2) & (a <= F.length(s))
    return F.when(fits & motif.isin(*CANONICAL_MOTIFS), motif).otherwise("other")


def aggregate_junctions(found: DataFrame, contigs: DataFrame | None = None, annotated: DataFrame | None = None) -> DataFrame:
    """Reads per junction, with motif (``contigs``: contig_id, sequence) and annotated flag (``annotated``: contig_id, donor_pos, acceptor_pos)."""
    keys = ["contig_id", "strand", "donor_pos", "acceptor_pos"]
    out = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("read_count"))
    if contigs is not None:
        out = out.join(contigs.select("contig_id", F.col("sequence").alias("_s")), "contig_id", "left").withColumn("motif", splice_motif("_s", "donor_pos", "acceptor_pos", "strand")).drop("_s")
    if annotated is not None:
        on = ["contig_id", "donor_pos", "acceptor_pos"]
        out = out.join(annotated.select(*on).distinct().withColumn("annotated", F.lit(True)), on, "left").withColumn("annotated", F.coalesce("annotated", F.lit(False)))
    return out


def annotation_splice_sites(exons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Donor and acceptor positions per contig from exons (contig_id, parent_id, start, end) of transcripts."""
    w = Window.partitionBy("parent_id").orderBy("start")
    e = exons.withColumn("_next", F.lead("start").over(w)).where("_next IS NOT NULL")
    return e.select("contig_id", F.col("end").alias("pos")).distinct(), e.select("contig_id", F.col("_next").alias("pos")).distinct()


def cluster_junctions(introns: DataFrame, *, tolerance: int = 5) -> DataFrame:
    """Greedy clusters of junctions: each input row with ``cluster_id`` and ``is_seed``.

    Best-supported junctions come first (then motif, donor, acceptor); each joins the first seed, in order of donor, that is
    within the tolerance on both ends, or becomes a seed. Junctions whose donors are further apart than the tolerance from
    all others never meet, so each stretch of near donors is one group, not a whole contig. Ids follow the global order of seeds.
    Input: contig_id, strand, donor_pos, acceptor_pos, read_count, motif; one row per junction.
    """
    rank = F.lit(len(CANONICAL_MOTIFS))
    for i, m in reversed(list(enumerate(CANONICAL_MOTIFS))):
        rank = F.when(F.col("motif") == m, F.lit(i)).otherwise(rank)
    rows = introns.withColumn("_motif", rank).withColumn("_n", F.coalesce("read_count", F.lit(0)))
    w = Window.partitionBy("contig_id", "strand").orderBy("donor_pos")
    starts = rows.select("contig_id", "strand", "donor_pos").distinct().withColumn("_far", F.coalesce(F.col("donor_pos") - F.lag("donor_pos").over(w) > tolerance, F.lit(True)))
    stretch = starts.withColumn("_stretch", F.sum(F.col("_far").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")
    rows = rows.join(stretch, ["contig_id", "strand", "donor_pos"])

    def every(df: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([greedy(part) for _, part in df.groupby(["contig_id", "strand"], sort=False, dropna=False)])

    def greedy(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["_n", "_motif", "donor_pos", "acceptor_pos"], ascending=[False, True, True, True], kind="stable")
        donors, acceptors = df["donor_pos"].to_numpy(), df["acceptor_pos"].to_numpy()
        seeds: list[tuple[int, int]] = []  # donor, row; rows are in order of support, so equal donors keep that order
        chosen = np.arange(len(df))
        for i, (d, a) in enumerate(zip(donors.tolist(), acceptors.tolist())):
            for k in range(bisect_left(seeds, (d - tolerance, -1)), len(seeds)):
                if seeds[k][0] > d + tolerance:
                    insort(seeds, (d, i))
                    break
                if abs(acceptors[seeds[k][1]] - a) <= tolerance:
                    chosen[i] = seeds[k][1]
                    break
            else:
                insort(seeds, (d, i))
        out = df.copy()
        out["_sd"], out["_sa"], out["_sn"], out["_sm"] = donors[chosen], acceptors[chosen], df["_n"].to_numpy()[chosen], df["_motif"].to_numpy()[chosen]
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    # stretches never meet: any of them may go to Python together, so each task gets a few large groups instead of many small ones
    rows = rows.withColumn("_stretch", F.pmod(F.xxhash64("contig_id", "strand", "_stretch"), F.lit(4 * shuffle_partitions(introns.sparkSession))))
    grouped = cut_lineage(rows.groupBy("_stretch").applyInPandas(every, schema + ", _sd long, _sa long, _sn long, _sm int"))
    numbered = dense_ids(grouped.withColumn("_sn", -F.col("_sn")), ["_sn", "_sm", "contig_id", "_sd", "_sa", "strand"], "cluster_id")
    seed = (F.col("_sd") == F.col("donor_pos")) & (F.col("_sa") == F.col("acceptor_pos"))
    return numbered.withColumn("is_seed", seed).select(*introns.columns, "cluster_id", "is_seed")


def split_by_span(df: DataFrame, keys: str | list[str], value: str, width: float, unit: str = "unit") -> DataFrame:
    """Numbers, from 0, of anchored units of each group: sorted values stay in a unit while they are within ``width`` of its first one."""
    keys = names(keys)

    def split(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(value, kind="stable")
        anchor, k, out = None, -1, []
        for v in part[value]:
            if anchor is None or v - anchor > width:
                anchor, k = v, k + 1
            out.append(k)
        return part.assign(**{unit: out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).applyInPandas(split, f"{schema}, {unit} int")


def restrict_to_star(df: DataFrame, keys: str | list[str], item: str, mz: str, ppm: float) -> DataFrame:
    """Greedy stars within each component: the lowest m/z left is a centre and takes all left within ``ppm`` of it; ``star`` is its item."""
    keys = names(keys)
    kind = df.schema[item].dataType.simpleString()

    def stars(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([mz, item], kind="stable")
        centre, out = None, []
        for v, i in zip(part[mz], part[item]):
            if centre is None or v - centre[0] > ppm * 1e-6 * centre[0]:
                centre = (v, i)
            out.append(centre[1])
        return part.assign(star=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.where(F.col(mz).isNotNull()).groupBy(*keys).applyInPandas(stars, f"{schema}, star {kind}")


def pack_rows(df: DataFrame, keys: str | list[str], start: str, end: str, row: str = "row") -> DataFrame:
    """Display row of each interval of a group: the lowest row that is free when it starts.

    Where no interval is open all rows are free, so each continuous period of a group is packed by itself; intervals that
    only touch are packed together. Rows with a null key and empty intervals have no row. Equal intervals go by all other columns, so that the rows don't depend on the input's order.
    """
    keys = names(keys)
    ties = [c for c in df.columns if c not in (start, end, row)]

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([start, end, *ties], kind="stable")
        busy: list[tuple[int, int]] = []  # end, row
        free: list[int] = []
        out, rows = [], 0
        for s, e in zip(part[start], part[end]):
            while busy and busy[0][0] <= s:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                r = heapq.heappop(free)
            else:
                r, rows = rows, rows + 1
            heapq.heappush(busy, (e, r))
            out.append(r)
        return part.assign(**{row: out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != row)
    rows = df.drop(row).where(F.col(start) < F.col(end))
    k = [f"_k{i}" for i in range(len(keys))]
    periods = periods_and_gaps(rows, keys, start, end, gaps=False).select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.col("range_start").alias("_ps"), F.col("range_end").alias("_pe"))
    placed = interval_join(rows.select("*", *[F.col(c).alias(n) for c, n in zip(keys, k)]), periods, k, start, end, "_ps", "_pe")
    return placed.drop(*k, "_pe").groupBy(*keys, "_ps").applyInPandas(lambda part: assign(part.drop(columns="_ps")), f"{schema}, {row} int")


def read_fingerprints(blocks: DataFrame, alignments: DataFrame, introns: DataFrame) -> DataFrame:
    """Chain of introns of each read: alignment_id, contig_id, strand, n_blocks, span, intron_ids in order, signature and hash.

    Reads with a junction that isn't a known intron are left out. ``introns``: intron_id, contig_id, strand, donor_pos, acceptor_pos.
    """
    span = blocks.groupBy("alignment_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("ref_start").alias("span_start"), F.max("ref_end").alias("span_end"))
    known = introns.select("intron_id", "contig_id", "strand", "donor_pos", "acceptor_pos")
    j = junctions(blocks, alignments).join(known, ["contig_id", "strand", "donor_pos", "acceptor_pos"], "left")
    point = F.struct("junction_index", "intron_id", "donor_pos", "acceptor_pos")
    chain = j.groupBy("alignment_id").agg(F.bool_and(F.col("intron_id").isNotNull()).alias("_ok"), F.sort_array(F.collect_list(point)).alias("_c"))
    out = span.join(alignments.select("alignment_id", "contig_id", "strand"), "alignment_id").join(chain, "alignment_id", "left").where(F.coalesce("_ok", F.lit(True)))
    chain_ = F.coalesce("_c", F.array().cast(out.schema["_c"].dataType))
    ids = F.transform(chain_, lambda x: x["intron_id"])
    where = F.array_join(F.transform(chain_, lambda x: F.concat_ws("-", x["donor_pos"].cast("string"), x["acceptor_pos"].cast("string"))), ",")
    out = out.withColumn("intron_ids", ids).withColumn("junction_signature", F.concat(F.lit("chr"), F.col("contig_id").cast("string"), F.lit(":"), where)).drop("_ok", "_c")
    return out.withColumn("fingerprint_hash", F.xxhash64("contig_id", "strand", F.size("intron_ids"), "intron_ids"))


def cluster_by_fingerprint(reads: DataFrame, *, max_5p_drift: int = 25, max_3p_drift: int = 75, min_size: int = 1) -> DataFrame:
    """Clusters of reads with one fingerprint: key columns, ``n_reads``, ``n_kept``, span of the kept reads.

    Ends are compared with the cluster's median; on the minus strand the 5' end is the right one. Differences are cut to whole
    numbers, and reads beyond the limits are left out of the cluster. Input: contig_id, strand, fingerprint_hash, span_start, span_end.
    """
    keys = ["contig_id", "strand", "fingerprint_hash"]
    minus = F.col("strand") == "-"
    r = reads.withColumn("_five", F.when(minus, F.col("span_end")).otherwise(F.col("span_start"))).withColumn("_three", F.when(minus, F.col("span_start")).otherwise(F.col("span_end")))
    # counts per value first: an exact median of a large cluster holds different values, not rows
    five = r.groupBy(*keys).agg(F.percentile("_five", F.lit(0.5)).alias("_m5"), F.percentile("_three", F.lit(0.5)).alias("_m3"), F.count(F.lit(1)).alias("n_reads"))
    j = r.join(five, keys)
    kept = (F.abs((F.col("_five") - F.col("_m5")).cast("int")) <= max_5p_drift) & (F.abs((F.col("_three") - F.col("_m3")).cast("int")) <= max_3p_drift)
    return j.groupBy(*keys).agg(F.max("n_reads").alias("n_reads"), F.count_if(kept).alias("n_kept"), F.min(F.when(kept, F.col("span_start"))).alias("span_start"), F.max(F.when(kept, F.col("span_end"))).alias("span_end")).where(F.col("n_kept") >= min_size)


def representatives(members: DataFrame, keys: str | list[str], sequence: str, quality: str, read_id: str) -> DataFrame:
    """Representative of each cluster: the most frequent sequence, then best mean quality; of it the least read id. Adds ``n_unique``."""
    keys = names(keys)
    per = members.groupBy(*keys, sequence).agg(F.count(F.lit(1)).alias("n"), F.avg(quality).alias("q"), F.min(read_id).alias(read_id))
    best = F.max_by(F.struct(read_id, sequence, "n"), F.struct("n", F.coalesce("q", F.lit(-1.0)), sequence))
    return per.groupBy(*keys).agg(best.alias("_b"), F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n_reads")).select(*keys, F.col(f"_b.{read_id}").alias(read_id), F.col(f"_b.{sequence}").alias(sequence), F.col("_b.n").alias("n_same"), "n_unique", "n_reads")
