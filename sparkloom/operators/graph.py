"""Networks, trees and connected components on node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.nearest import shared_ions
from sparkloom.session import Rounds, cut_lineage


def symmetric(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each edge in both directions, once; a self loop stays one edge."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def from_edges(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (``node``) and distinct edges (``src``, ``dst``); nodes without edges may be added."""
    e = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    n = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    if nodes is not None:
        n = n.unionByName(nodes.select("node"))
    return n.distinct(), e


def neighbors(edges: DataFrame, node) -> DataFrame:
    """Neighbours of a node in either direction."""
    other = F.when(F.col("src") == F.lit(node), F.col("dst")).otherwise(F.col("src"))
    return edges.where((F.col("src") == F.lit(node)) | (F.col("dst") == F.lit(node))).select(other.alias("node")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of neighbours of every node, 0 included; a self loop counts once."""
    d = symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").join(d, "node", "left").na.fill(0, subset=["degree"])


def has_edge(edges: DataFrame, pairs: DataFrame, *, directed: bool = False) -> DataFrame:
    """Adds ``has_edge`` to pairs (src, dst)."""
    e = (edges.select("src", "dst").distinct() if directed else symmetric(edges)).withColumn("has_edge", F.lit(True))
    return pairs.join(e, ["src", "dst"], "left").na.fill(False, subset=["has_edge"])


def induced_subgraph(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept nodes, and edges with both ends among them."""
    k = kept.select("node").distinct()
    e = edges.join(k.select(F.col("node").alias("src")), "src", "left_semi").join(k.select(F.col("node").alias("dst")), "dst", "left_semi")
    return nodes.join(k, "node", "left_semi"), e


def connected_components(nodes: DataFrame, edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (least node of it), by alternating large-star and small-star steps.

    Each step takes the least neighbour per node, with partial minima in map tasks, and moves edges to it; the number
    of rounds grows with the logarithm of the size. Edges are written to the shared folder after each round.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    rounds = Rounds(edges.sparkSession)
    e = rounds.write(e)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = rounds.write(small)
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    label = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    every = nodes.select("node").unionByName(ends).distinct()
    return every.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def component_sizes(components: DataFrame) -> DataFrame:
    """Components with ``size``, the largest first."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component")


# --- trees -------------------------------------------------------------------------------------------------------

def is_root(node: str = "node", parent: str = "parent", sentinel=None) -> Column:
    """A root has no parent, itself, or a sentinel as parent."""
    c = F.col(parent).isNull() | (F.col(parent) == F.col(node))
    return c if sentinel is None else c | (F.col(parent) == F.lit(sentinel))


def roots(tree: DataFrame, sentinel=None) -> DataFrame:
    return tree.where(is_root(sentinel=sentinel)).select("node")


def _links(tree: DataFrame, sentinel) -> DataFrame:
    return tree.where(~is_root(sentinel=sentinel)).select(F.col("node").alias("_c"), F.col("parent").alias("_p"))


def ancestors(tree: DataFrame, start: DataFrame, *, sentinel=None, max_depth: int = 200) -> DataFrame:
    """Chain of ancestors of each start node: ``node``, ``ancestor``, ``distance`` from 1. Cycles raise.

    One join for each level, for all start nodes together.
    """
    rounds = Rounds(tree.sparkSession, keep=True)
    links = rounds.write(_links(tree, sentinel))
    front = rounds.write(start.select("node").distinct().withColumn("ancestor", F.col("node")).withColumn("distance", F.lit(0)))
    out = front
    for k in range(1, max_depth + 2):
        front = rounds.write(front.join(links, front["ancestor"] == links["_c"]).select("node", F.col("_p").alias("ancestor"), F.lit(k).alias("distance")))
        if front.isEmpty():
            return out.where("distance > 0")
        out = out.unionByName(front)
    raise ValueError("there is a cycle, or the tree is deeper than max_depth")


def lineage(tree: DataFrame, start: DataFrame, *, sentinel=None) -> DataFrame:
    """Path from the root to each start node: ``node``, ``path``."""
    own = start.select("node").distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    chain = ancestors(tree, start, sentinel=sentinel).unionByName(own)
    return chain.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False), lambda x: x["ancestor"]).alias("path"))


def depths(tree: DataFrame, start: DataFrame | None = None, *, sentinel=None) -> DataFrame:
    """``node`` and ``depth``; a root has depth 0. All depths are counted down from the roots, level by level."""
    if start is not None:
        own = start.select("node").distinct()
        d = ancestors(tree, own, sentinel=sentinel).groupBy("node").agg(F.max("distance").alias("depth"))
        return own.join(d, "node", "left").na.fill(0, subset=["depth"])
    return descendants(tree, roots(tree, sentinel), sentinel=sentinel, own=True).select(F.col("descendant").alias("node"), F.col("distance").alias("depth"))


def descendants(tree: DataFrame, start: DataFrame, *, max_depth: int | None = None, sentinel=None, own: bool = False) -> DataFrame:
    """Nodes below each start node: ``node``, ``descendant``, ``distance``; with ``own`` the node itself at 0."""
    rounds = Rounds(tree.sparkSession, keep=True)
    links = rounds.write(_links(tree, sentinel))
    front = rounds.write(start.select("node").distinct().withColumn("descendant", F.col("node")).withColumn("distance", F.lit(0)))
    out = front
    for k in range(1, (max_depth if max_depth is not None else 200) + 1):
        front = rounds.write(front.join(links, front["descendant"] == links["_p"]).select("node", F.col("_c").alias("descendant"), F.lit(k).alias("distance")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    else:
        if max_depth is None:
            raise ValueError("there is a cycle, or the tree is deeper than 200")
    return out if own else out.where("distance > 0")


def lowest_common_ancestor(tree: DataFrame, pairs: DataFrame, *, sentinel=None) -> DataFrame:
    """``a``, ``b`` and ``lca`` of each pair; a node is an ancestor of itself here. Null if they share none."""
    start = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    up = ancestors(tree, start, sentinel=sentinel).unionByName(start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")))
    x = up.select(F.col("node").alias("a"), F.col("ancestor"), F.col("distance").alias("_da"))
    y = up.select(F.col("node").alias("b"), F.col("ancestor").alias("_anc"), F.col("distance").alias("_db"))
    j = pairs.select("a", "b").distinct().join(x, "a").join(y, "b").where(F.col("ancestor") == F.col("_anc"))
    best = j.groupBy("a", "b").agg(F.min_by("ancestor", F.struct(F.col("_da") + F.col("_db"), "ancestor")).alias("lca"))
    return pairs.select("a", "b").join(best, ["a", "b"], "left")


def subtree(tree: DataFrame, node, *, sentinel=None) -> DataFrame:
    """Rows of a node and everything below it; the node becomes a root."""
    start = tree.where(F.col("node") == F.lit(node)).select("node")
    below = descendants(tree, start, sentinel=sentinel, own=True).select(F.col("descendant").alias("node")).distinct()
    return tree.join(below, "node", "left_semi").withColumn("parent", F.when(F.col("node") != F.lit(node), F.col("parent")))


# --- uses --------------------------------------------------------------------------------------------------------

def roll_up_genes(exons: DataFrame, introns: DataFrame, *, min_support: int = 3) -> DataFrame:
    """Genes from exons that trusted introns join: ``exon_id``, ``gene_id``, and the gene's start and end.

    ``exons``: exon_id, contig_id, start, end. ``introns``: contig_id, donor_pos, acceptor_pos, read_count. An intron joins the
    exon that ends at its donor with the one that starts at its acceptor.
    """
    i = introns.groupBy("contig_id", "donor_pos", "acceptor_pos").agg(F.sum("read_count").alias("n")).where(F.col("n") >= min_support)
    a = exons.select("contig_id", F.col("end").alias("donor_pos"), F.col("exon_id").alias("src"))
    b = exons.select("contig_id", F.col("start").alias("acceptor_pos"), F.col("exon_id").alias("dst"))
    edges = i.join(a, ["contig_id", "donor_pos"]).join(b, ["contig_id", "acceptor_pos"]).select("src", "dst")
    c = connected_components(exons.select(F.col("exon_id").alias("node")), edges).select(F.col("node").alias("exon_id"), F.col("component").alias("gene_id"))
    j = exons.join(c, "exon_id")
    span = j.groupBy("gene_id").agg(F.min("start").alias("gene_start"), F.max("end").alias("gene_end"), F.count(F.lit(1)).alias("n_exons"))
    return j.select("exon_id", "gene_id").join(span, "gene_id")


def collision_losers(entries: DataFrame, *, rt_seconds: float = 5.0, ppm: float = 10.0, min_shared: int = 4, form: str | None = None) -> DataFrame:
    """Entries that collide with a better-scored one: ``entry_id``, ``component``, ``winner``.

    ``entries``: entry_id, window_id, rt, score, mz_list. Two entries of one window collide if their times differ by less than
    ``rt_seconds`` (strictly) and they share ions. The lowest score of a component wins; null scores neither win nor lose.
    ``entry_id`` is unique. With a column ``form``, spectra of one form never collide with each other.
    """
    same = F.lit(None).cast("string") if form is None else F.col(form)
    a = entries.select("window_id", F.col("entry_id").alias("a"), same.alias("_fa"), F.col("rt").alias("_ra"), F.col("mz_list").alias("_ma")).withColumn("_b", F.floor(F.col("_ra") / rt_seconds))
    b = entries.select("window_id", F.col("entry_id").alias("b"), same.alias("_fb"), F.col("rt").alias("_rb"), F.col("mz_list").alias("_mb"), F.explode(F.sequence(F.floor(F.col("rt") / rt_seconds) - 1, F.floor(F.col("rt") / rt_seconds) + 1)).alias("_b"))
    near = a.join(b, ["window_id", "_b"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("_ra") - F.col("_rb")) < rt_seconds))
    if form is not None:
        near = near.where(F.coalesce(F.col("_fa") != F.col("_fb"), F.lit(True)))
    edges = near.where(shared_ions("_ma", "_mb", ppm) >= min_shared).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    edges = cut_lineage(edges)
    c = connected_components(edges.select(F.col("src").alias("node")), edges).select(F.col("node").alias("entry_id"), "component")
    scored = c.join(entries.select("entry_id", "score"), "entry_id").where("score IS NOT NULL AND NOT isnan(score)")
    winner = scored.groupBy("component").agg(F.min_by("entry_id", F.struct("score", "entry_id")).alias("winner"))
    return scored.join(winner, "component").where("entry_id <> winner").select("entry_id", "component", "winner")


def near_pairs(points: DataFrame, ident: str, value: str, ppm: float) -> DataFrame:
    """Pairs of different items whose values differ by at most ``ppm`` of the smaller: ``src`` < ``dst`` by value, then id."""
    width = ppm * 1.01e-6
    p = points.where(F.col(value) > 0).select(F.col(ident).alias("i"), F.col(value).alias("v")).withColumn("_b", F.floor(F.ln("v") / width))
    a = p.select(F.col("i").alias("src"), F.col("v").alias("_va"), F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"))
    j = a.join(p.select(F.col("i").alias("dst"), F.col("v").alias("_vb"), "_b"), "_b")
    j = j.where((F.struct("_va", "src") < F.struct("_vb", "dst")) & (F.col("_vb") - F.col("_va") <= F.col("_va") * (ppm * 1e-6)))
    return j.select("src", "dst")
