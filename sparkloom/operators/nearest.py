"""Nearest and within-tolerance matches on a numeric axis, such as m/z."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.columns import names, require


def half_width(query: str | Column, tolerance: float, unit: str = "ppm") -> Column:
    """Half-width of the window around a query: ppm is taken at the query."""
    q = F.col(query) if isinstance(query, str) else query
    if unit == "ppm":
        return q * F.lit(float(tolerance) * 1e-6)
    if unit == "Da":
        return F.lit(float(tolerance))
    raise ValueError("unit is ppm or Da")


def _bin_of(value: Column, tolerance: float, unit: str) -> Column:
    """Bin number on an axis whose bins are at least as wide as a window: logarithmic for ppm."""
    if unit == "ppm":
        return F.floor(F.ln(value) / F.lit(max(tolerance, 1e-3) * 1.01e-6))
    return F.floor(value / F.lit(max(tolerance, 1e-9) * 1.0001))


def all_within(queries: DataFrame, axis: DataFrame, query: str, value: str, tolerance: float, unit: str = "ppm", keys: str | list[str] = ()) -> DataFrame:
    """All pairs with |value - query| <= half-width and equal keys; both ends count. ``delta`` is query - value.

    Values are put into bins as wide as the window; each query looks into its own bin and the two next to it, so a
    pair is made once. NaN, null and (for ppm) non-positive values match nothing.
    """
    keys = names(keys)
    require(queries, *keys, query)
    require(axis, *keys, value)
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & ((F.col(c) > 0) if unit == "ppm" else F.lit(True))
    q = queries.where(ok(query)).withColumn("_b", F.explode(F.sequence(_bin_of(F.col(query), tolerance, unit) - 1, _bin_of(F.col(query), tolerance, unit) + 1)))
    a = axis.where(ok(value)).withColumn("_b", _bin_of(F.col(value), tolerance, unit))
    j = q.join(a, [*keys, "_b"]).drop("_b").where(F.abs(F.col(query) - F.col(value)) <= half_width(query, tolerance, unit))
    return j.withColumn("delta", F.col(query) - F.col(value))


def nearest(queries: DataFrame, axis: DataFrame, query_id: str | list[str], query: str, value: str, value_id: str, tolerance: float, unit: str = "ppm", keys: str | list[str] = ()) -> DataFrame:
    """The nearest value of each query within the tolerance; of equally near ones the smaller, then the lower id.

    Result: query ids, ``value_id``, ``value``, ``delta`` (query - value). Queries without a value have no row.
    """
    ids = names(query_id)
    j = all_within(queries, axis, query, value, tolerance, unit, keys)
    best = j.groupBy(*ids).agg(F.min(F.struct(F.abs("delta").alias("d"), F.col(value).alias("v"), F.col(value_id).alias("i"), F.col("delta").alias("s"))).alias("m"))
    return best.select(*ids, F.col("m.i").alias(value_id), F.col("m.v").alias(value), F.col("m.s").alias("delta"))


def window_counts(queries: DataFrame, axis: DataFrame, query_id: str, query: str, value: str, tolerance: float, unit: str = "ppm") -> DataFrame:
    """Number of axis values in the window of each query, 0 included: ``query_id``, ``n``."""
    found = all_within(queries, axis, query, value, tolerance, unit).groupBy(query_id).agg(F.count(F.lit(1)).alias("n"))
    return queries.select(query_id).join(found, query_id, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def match_list(queries: DataFrame, axis: DataFrame, query_id: str, query: str, value: str, value_id: str, tolerance: float, unit: str = "ppm") -> DataFrame:
    """Matches of each query: all candidates if they span at most the tolerance, else the closest one (the lowest on a tie)."""
    j = all_within(queries, axis, query, value, tolerance, unit)
    g = j.groupBy(query_id, query).agg(F.collect_list(F.struct(F.abs("delta").alias("d"), F.col(value).alias("v"), F.col(value_id).alias("i"))).alias("c"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    kept = F.when(F.col("hi") - F.col("lo") <= half_width(query, tolerance, unit), F.col("c")).otherwise(F.array(F.array_min("c")))
    return g.select(query_id, F.explode(kept).alias("m")).select(query_id, F.col("m.i").alias(value_id), F.col("m.v").alias(value))


def shared_ions(a: str | Column, b: str | Column, ppm: float) -> Column:
    """How many ions of array a have an ion of b closer than ``ppm`` of that ion of b (strictly)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.size(F.filter(a, lambda x: F.exists(b, lambda y: F.abs(x - y) < y * F.lit(ppm * 1e-6))))


def extract_traces(peaks: DataFrame, scans: DataFrame, targets: DataFrame, tolerance: float = 20.0, unit: str = "ppm") -> DataFrame:
    """Extracted ion chromatograms: the nearest peak per target, ion and scan.

    ``peaks``: scan, mz, intensity. ``scans``: scan, level, rt, isolation_lower, isolation_upper. ``targets``: target_id,
    ion, ion_mz, level, precursor_mz, rt_start, rt_end; null bounds don't restrict. A scan of level 2 must isolate the
    precursor, where it says what it isolates. Ions are matched by the peaks first, on bins of the m/z axis; of equally near
    peaks the smaller m/z wins. ``mz_error_ppm`` is observed minus theoretical, over the theoretical.
    """
    require(peaks, "scan", "mz", "intensity")
    require(scans, "scan", "level", "rt", "isolation_lower", "isolation_upper")
    require(targets, "target_id", "ion", "ion_mz", "level", "precursor_mz", "rt_start", "rt_end")
    rows = peaks.join(scans, "scan")
    t = targets.withColumnRenamed("level", "t_level")
    j = all_within(t, rows, "ion_mz", "mz", tolerance, unit)
    in_time = (F.col("rt_start").isNull() | (F.col("rt") >= F.col("rt_start"))) & (F.col("rt_end").isNull() | (F.col("rt") <= F.col("rt_end")))
    isolated = (F.col("level") != 2) | ((F.col("isolation_lower").isNull() | (F.col("precursor_mz") >= F.col("isolation_lower"))) & (F.col("isolation_upper").isNull() | (F.col("precursor_mz") <= F.col("isolation_upper"))))
    j = j.where((F.col("level") == F.col("t_level")) & in_time & isolated)
    best = j.groupBy("target_id", "ion", "scan", "ion_mz", "rt").agg(F.min(F.struct(F.abs("delta").alias("d"), F.col("mz").alias("mz"), (-F.col("intensity")).alias("i"))).alias("m"))
    error = (F.col("m.mz") - F.col("ion_mz")) / F.col("ion_mz") * 1e6
    return best.select("target_id", "ion", "scan", "rt", F.col("m.mz").alias("mz"), (-F.col("m.i")).alias("intensity"), error.alias("mz_error_ppm"))
