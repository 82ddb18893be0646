"""Views of a genome window: reads, clusters, junctions, bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.clustering import pack_rows
from sparkloom.operators.intervals import viewport
from sparkloom.operators.relational import nest_children, search_text

#: Beyond so many rows, or so many bases a pixel, a view is drawn as a picture.
MOST_ROWS, MOST_BASES = 4000, 50


def mode(df: DataFrame, start: str, end: str, lo: int, hi: int, pixels: int) -> str:
    """``raster`` if the window is wide for its pixels, or has many rows; the count is pushed to the scan."""
    if (hi - lo) / max(pixels, 1) > MOST_BASES:
        return "raster"
    return "raster" if viewport(df, start, end, lo, hi).limit(MOST_ROWS + 1).count() > MOST_ROWS else "vector"


def read_pileup(alignments: DataFrame, blocks: DataFrame, ref_name: str, lo: int, hi: int, *, min_mapq: int = 0, samples: DataFrame | None = None) -> DataFrame:
    """Alignments of a window with display rows and their blocks; one block over all of it where there is none."""
    a = viewport(alignments, "ref_start", "ref_end", lo, hi, where=(F.col("ref_name") == ref_name) & (F.col("mapq") >= min_mapq))
    if samples is not None:
        a = a.join(samples.select("read_id", "sample_id"), "read_id", "left")
    own = blocks.join(a.select("alignment_id"), "alignment_id", "left_semi")
    whole = F.array(F.struct(F.col("ref_start"), F.col("ref_end")))
    return nest_children(pack_rows(a, "ref_name", "ref_start", "ref_end"), own, "alignment_id", "block_index", ["ref_start", "ref_end"], "blocks", whole)


def cluster_pileup(clusters: DataFrame, contig_id: int, lo: int, hi: int, *, members: DataFrame | None = None) -> DataFrame:
    """Clusters of a window, or their members."""
    c = viewport(clusters, "span_start", "span_end", lo, hi, where=F.col("contig_id") == contig_id)
    return c if members is None else members.join(c.select("cluster_id"), "cluster_id", "left_semi")


def splice_junctions(introns: DataFrame, contig_id: int, lo: int, hi: int, *, limit: int = 500) -> DataFrame:
    """Junctions with an end in the window, or around it: the seed of each cluster, or else its best row, with the cluster's support."""
    d, a = F.col("donor_pos"), F.col("acceptor_pos")
    rows = introns.where((F.col("contig_id") == contig_id) & (d.between(lo, hi) | a.between(lo, hi) | ((d < lo) & (a > hi))))
    rank = F.struct(F.coalesce("is_intron_seed", F.lit(False)), "read_count", -F.col("donor_pos"), -F.col("acceptor_pos"))
    g = rows.groupBy("intron_id").agg(F.sum("read_count").alias("support"), F.max_by(F.struct("donor_pos", "acceptor_pos", "strand", "motif"), rank).alias("r"))
    return g.select("intron_id", "support", "r.*").orderBy(F.desc("support"), "intron_id").limit(limit)


def coverage_window(coverage: DataFrame, contig_id: int, lo: int, hi: int, samples: list[int] | None = None) -> DataFrame:
    """Coverage runs of a window."""
    where = F.col("contig_id") == contig_id
    return viewport(coverage, "start", "end", lo, hi, where=where if samples is None else where & F.col("sample_id").isin(samples))


def reference_bases(sequences: DataFrame, contig_id: int, lo: int, hi: int) -> DataFrame:
    """Position and base of a slice of a contig."""
    cut = F.substring(F.col("sequence"), F.lit(lo + 1), F.lit(hi - lo))
    return sequences.where(F.col("contig_id") == contig_id).select(F.posexplode(F.filter(F.split(cut, ""), lambda x: x != "")).alias("i", "base")).select((F.col("i") + lo).alias("pos"), "base")


def search_features(features: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Features whose name contains the query, or whose id is it; reference features first."""
    exact = features.where(F.col("feature_id").cast("string") == query)
    found = search_text(features, ["name"], query).unionByName(exact).distinct()
    return found.orderBy(F.when(F.col("source") == "reference", 0).otherwise(1), "name", "feature_id").limit(limit)
