"""Filters, choices per group, lookups and set operations on DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.columns import names, require


# --- filters -----------------------------------------------------------------------------------------------------

def filter_chain(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """Rows that pass all predicates; null counts as not passed."""
    for p in predicates.values():
        df = df.where(F.coalesce(p, F.lit(False)))
    return df


def filter_audit(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """``stage``, ``step``, ``kept``, ``dropped`` of a chain of predicates, in one pass over the rows."""
    passed, cols, rows = F.lit(True), [F.count(F.lit(1)).alias("n0")], []
    for k, (name, p) in enumerate(predicates.items(), 1):
        passed = passed & F.coalesce(p, F.lit(False))
        cols.append(F.count_if(passed).alias(f"n{k}"))
        rows.append(F.struct(F.lit(k).alias("step"), F.lit(name).alias("stage"), F.col(f"n{k}").alias("kept"), (F.col(f"n{k - 1}") - F.col(f"n{k}")).alias("dropped")))
    return df.agg(*cols).select(F.inline(F.array(*rows))) if rows else df.sparkSession.createDataFrame([], "step int, stage string, kept long, dropped long")


def alignment_predicates(*, primary_only: bool = True, min_length: int = 0, min_mapq: int = 0, min_aligned_fraction: float = 0.0) -> dict[str, Column]:
    """Predicates on alignments: is_secondary, is_supplementary, read_length, mapq, aligned_fraction."""
    out = {}
    if primary_only:
        out["primary_only"] = ~F.col("is_secondary") & ~F.col("is_supplementary")
    out["min_length"] = F.col("read_length") >= min_length
    out["min_mapq"] = F.col("mapq") >= min_mapq
    out["min_aligned_fraction"] = F.col("aligned_fraction") >= min_aligned_fraction
    return out


def trusted_rows(df: DataFrame, keys: str | list[str], support: str, least: int, seed: Column | None = None) -> DataFrame:
    """Rows (seeds only, if asked) of groups whose summed support reaches ``least``."""
    keys = names(keys)
    good = df.groupBy(*keys).agg(F.sum(support).alias("_n")).where(F.col("_n") >= least).select(*keys)
    return (df if seed is None else df.where(seed)).join(good, keys, "left_semi")


def cascade(start: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Semi-joins down a chain: each step (table, its key, key of the table before) keeps the rows that the kept ones reach."""
    kept = [start]
    for table, key, parent in steps:
        parents = kept[-1].select(F.col(parent).alias(key)).distinct()
        kept.append(table.join(parents, key, "left_semi"))
    return kept


def keep_longest(df: DataFrame, start: str, end: str, n: int, *ties: Column) -> DataFrame:
    """The n rows with the longest interval, by a total order."""
    return df.orderBy(F.desc(F.col(end) - F.col(start)), *ties).limit(n)


# Atom selections: expressions that combine with & | ~

#: Names of backbone atoms, residues and water.
BACKBONE = ("N", "CA", "C", "O")
RESIDUES = tuple("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split())
WATER = ("HOH", "WAT", "H2O", "TIP3", "SOL")


def select_chain(*chains: str) -> Column:
    return F.col("chain_id").isin(*chains)


def select_residues(start: int, end: int, chain: str | None = None) -> Column:
    inside = F.col("res_seq").between(start, end)
    return inside if chain is None else inside & (F.col("chain_id") == chain)


def select_resname(*residues: str) -> Column:
    return F.col("res_name").isin(*residues)


def select_atom_names(*atoms: str) -> Column:
    return F.col("name").isin(*atoms)


def select_backbone() -> Column:
    return select_atom_names(*BACKBONE)


def select_protein() -> Column:
    return select_resname(*RESIDUES)


def select_sidechain() -> Column:
    return select_protein() & ~select_backbone()


def select_water() -> Column:
    return select_resname(*WATER)


def select_hetatm() -> Column:
    return F.col("is_hetatm")


def select_element(symbol: str) -> Column:
    return F.col("element") == symbol


def subset_frames(atoms: DataFrame, coords: DataFrame, expr: Column, frames: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Atoms that meet an expression, and their coordinates (atom_id, frame_id), in some frames if given."""
    kept = atoms.where(expr)
    rows = coords.join(kept.select("atom_id"), "atom_id", "left_semi")
    return kept, rows if frames is None else rows.where(F.col("frame_id").isin(frames))


def induced_topology(atoms: DataFrame, bonds: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept atoms with new numbers from 0 in atom order, and the bonds between two of them in new numbers."""
    numbered = dense_ids(atoms.join(kept.select("atom_id").distinct(), "atom_id", "left_semi"), "atom_id", "new_id")
    m = numbered.select("atom_id", "new_id")
    b = bonds.join(m.select(F.col("atom_id").alias("i"), F.col("new_id").alias("_i")), "i").join(m.select(F.col("atom_id").alias("j"), F.col("new_id").alias("_j")), "j")
    return numbered, b.withColumn("i", F.col("_i")).withColumn("j", F.col("_j")).drop("_i", "_j")


def dense_ids(df: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """Number from 0 for each distinct key in key order, without one task that sorts all rows.

    Distinct keys are range-partitioned; each partition numbers its own, and counts of the partitions before are added.
    """
    from sparkloom.session import cut_lineage, shuffle_partitions

    keys = names(key)
    k = [f"_q{i}" for i in range(len(keys))]
    distinct = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)]).distinct()
    placed = distinct.repartitionByRange(shuffle_partitions(df.sparkSession), *k).withColumn("_pid", F.spark_partition_id())
    local = cut_lineage(placed.withColumn("_n", F.row_number().over(Window.partitionBy("_pid").orderBy(*k))))
    # one row for each partition
    before = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    ids = local.join(F.broadcast(before), "_pid").select(*k, (F.col("_before") + F.col("_n") - 1).alias(name))
    on = F.lit(True)
    for c, a in zip(keys, k):
        on = on & df[c].eqNullSafe(F.col(a))
    return df.join(ids, on).drop(*k)


# --- choices per group -------------------------------------------------------------------------------------------

def argmin_per_group(df: DataFrame, keys: str | list[str], value: str, *ties: str) -> DataFrame:
    """Row with the least value of each group (ties by the given columns), aggregated in map tasks first; null values lose."""
    keys = names(keys)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(value).isNull().alias("_null"), F.col(value).alias("_v"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_m"))
    return best.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def best_hits(hits: DataFrame) -> DataFrame:
    """Best hit of each query: least e-value, reference tier first, then target. Columns query, target, evalue, aligned_to."""
    tier = F.when(F.col("aligned_to") == "reference", 0).otherwise(1)
    return argmin_per_group(hits.withColumn("_tier", tier), "query", "evalue", "_tier", "target").drop("_tier")


def significant(df: DataFrame, hits: DataFrame, key: str, query: str, evalue: str, threshold: float) -> DataFrame:
    """Rows whose least e-value over all hits is at most the threshold."""
    good = hits.groupBy(F.col(query).alias(key)).agg(F.min(evalue).alias("_e")).where(F.col("_e") <= threshold)
    return df.join(good.select(key), key, "left_semi")


def agreeing(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose non-null values all agree: key, value."""
    g = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return g.where("_lo = _hi").select(key, F.col("_lo").alias(value))


def last_by(df: DataFrame, keys: str | list[str], value: str, order: str) -> DataFrame:
    """Value at the greatest order of each group."""
    return df.groupBy(*names(keys)).agg(F.max_by(value, order).alias(value))


def resolve_samples(reads: DataFrame, segments: DataFrame, edges: DataFrame, acquisition_id: int) -> DataFrame:
    """Sample of each read: its last barcode segment, then the first sample registered for acquisition and barcode; null without.

    ``segments``: read_id, segment_index, kind, barcode_id. ``edges``: acquisition_id, barcode_id, sample_id.
    """
    barcode = last_by(segments.where("kind = 'barcode'"), "read_id", "barcode_id", "segment_index")
    first = edges.where(F.col("acquisition_id") == acquisition_id).groupBy("barcode_id").agg(F.min("sample_id").alias("sample_id"))
    return reads.join(barcode, "read_id", "left").join(first, "barcode_id", "left")


def samples_for(edges: DataFrame, acquisition_id: int, barcode_id: int | None) -> DataFrame:
    """Samples of an acquisition and barcode, where no barcode equals no barcode."""
    return edges.where((F.col("acquisition_id") == acquisition_id) & F.col("barcode_id").eqNullSafe(F.lit(barcode_id))).select("sample_id").distinct()


def first_by_precedence(df: DataFrame, key: str, column: str, precedence: list[str], *ties: Column) -> DataFrame:
    """First row of each key by a list of preferred values, others last, then ties."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col(column)), F.lit(0)), F.lit(len(precedence) + 1))
    w = Window.partitionBy(key).orderBy(rank, *ties)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


# --- lookups -----------------------------------------------------------------------------------------------------

def search_text(df: DataFrame, columns: list[str], query: str, *, limit: int | None = None, order: list[Column] | None = None, where: Column | None = None) -> DataFrame:
    """Rows where one of the columns contains the query in any letter case; with a limit, the first by ``order``."""
    q, hit = query.lower(), F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    out = df.where(hit if where is None else hit & where)
    return out if limit is None else out.orderBy(*(order or [F.asc(columns[0])])).limit(limit)


def lookup_taxid(names_: DataFrame, merged: DataFrame, query: DataFrame) -> DataFrame:
    """taxid of each query: a number is a taxid (old ones are redirected), other text an exact name in any letter case, lowest taxid first.

    ``names_``: taxid, name. ``merged``: old_taxid, new_taxid. ``query``: query. Unknown queries get null.
    """
    known = names_.groupBy(F.lower("name").alias("_n")).agg(F.min("taxid").alias("_by_name"))
    own = names_.select(F.col("taxid").alias("_taxid")).distinct()
    q = query.withColumn("_n", F.lower(F.trim("query"))).withColumn("_num", F.expr("try_cast(trim(query) AS BIGINT)"))
    q = q.join(merged.select(F.col("old_taxid").alias("_num"), "new_taxid"), "_num", "left").withColumn("_num", F.coalesce("new_taxid", "_num"))
    q = q.join(own, q["_num"] == own["_taxid"], "left").join(known, "_n", "left")
    return q.select("query", F.when(F.col("_num").isNotNull(), F.col("_taxid")).otherwise(F.col("_by_name")).alias("taxid"))


def search_names(names_: DataFrame, substring: str, *, limit: int, name_class: str | None = None) -> DataFrame:
    """First matching name of each taxid (by name), taxids ascending, up to a limit."""
    hit = F.lower("name").contains(substring.lower())
    if name_class:
        hit = hit & (F.col("name_class") == name_class)
    return names_.where(hit).groupBy("taxid").agg(F.min("name").alias("name")).orderBy("taxid").limit(limit)


# --- sets --------------------------------------------------------------------------------------------------------

def union_prefer_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows, and right rows whose key the left lacks."""
    return left.unionByName(right.join(left.select(key), key, "left_anti"))


def dedupe_first(df: DataFrame, value: str, order: str) -> DataFrame:
    """First row of each value by an order; wide values are compared by hash in the shuffle, then in full."""
    rest = [c for c in df.columns if c != value]
    g = df.withColumn("_h", F.xxhash64(value)).groupBy("_h", value).agg(F.min_by(F.struct(*rest), order).alias("_m"))
    return g.select(value, *[F.col(f"_m.{c}").alias(c) for c in rest]).select(*df.columns)


def novel_items(candidates: DataFrame, reference: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """Keys of candidates that the reference lacks and that were detected."""
    return candidates.select(key).distinct().join(reference.select(key), key, "left_anti").join(detected.select(key), key, "left_semi")


def scan_status(rows: DataFrame, scans: DataFrame, key: str, *, level: int, rt_tolerance: float) -> DataFrame:
    """Status of each row against scan metadata: no_scan_number, scan_not_found, wrong_level, rt_missing, rt_mismatch, ok."""
    j = rows.join(scans.select(key, F.col("level").alias("_level"), F.col("rt").alias("_rt")), key, "left")
    status = (
        F.when(F.col(key).isNull(), "no_scan_number")
        .when(F.col("_level").isNull(), "scan_not_found")
        .when(F.col("_level") != level, "wrong_level")
        .when(F.col("rt").isNull() | F.col("_rt").isNull(), "rt_missing")
        .when(F.abs(F.col("rt") - F.col("_rt")) > rt_tolerance, "rt_mismatch")
        .otherwise("ok")
    )
    return j.withColumn("status", status).drop("_level", "_rt")


def nest_children(parents: DataFrame, children: DataFrame, key: str, index: str, fields: list[str], name: str, default: Column) -> DataFrame:
    """Children of each parent as an array of structs in index order; a default where there are none."""
    nested = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(index, *fields))).alias(name))
    nested = nested.withColumn(name, F.transform(name, lambda x: F.struct(*[x[f].alias(f) for f in fields])))
    return parents.join(nested, key, "left").withColumn(name, F.coalesce(name, default))


def join_children_text(parents: DataFrame, children: DataFrame, key: str, start: str, text: str, strand: str, name: str) -> DataFrame:
    """Texts of the children in order of start, put together; turned to the reverse complement on the minus strand."""
    from sparkloom.functions.sequence import reverse_complement

    whole = children.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(start, text))), lambda x: x[text]), "").alias(name))
    j = parents.join(whole, key)
    return j.withColumn(name, F.when(F.col(strand) == "-", reverse_complement(F.col(name))).otherwise(F.col(name)))
