"""Interval joins on half-open intervals, without nested loops and without bins that explode on long intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.columns import names, require

#: Bits from one bin level to the next: a bin of level n is 4**n wide.
_BITS = 2


def overlaps(a_start: str | Column, a_end: str | Column, b_start: str | Column, b_end: str | Column) -> Column:
    """Strict half-open overlap: touching intervals don't overlap."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (c(b_start) < c(a_end)) & (c(b_end) > c(a_start))


def _level(start: str, end: str) -> Column:
    length = F.greatest(F.col(end) - F.col(start), F.lit(1))
    return F.ceil(F.log2(length.cast("double")) / F.lit(_BITS)).cast("int")


def _levels(df: DataFrame, start: str, end: str) -> list[int]:
    """Length classes that occur, at most 32."""
    seen = df.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _level(start, end)))).first()[0] or 0
    return [x for x in range(64 // _BITS) if seen >> x & 1]


def _at(df: DataFrame, start: str, end: str, levels: Column) -> DataFrame:
    """Rows with ``_level`` and ``_bin``: one or two bins for each of the levels, none of them below the interval's own."""

    def bins(x: Column) -> Column:
        shift = x * F.lit(_BITS)
        first, last = F.call_function("shiftright", F.col(start), shift), F.call_function("shiftright", F.col(end) - 1, shift)
        return F.transform(F.sequence(first, F.greatest(first, last)), lambda b: F.struct(x.alias("l"), b.alias("b")))

    e = df.withColumn("_bin", F.explode(F.flatten(F.transform(levels, bins))))
    return e.select(*df.columns, F.col("_bin.l").alias("_level"), F.col("_bin.b").alias("_bin"))


def interval_join(left: DataFrame, right: DataFrame, keys: str | list[str], left_start: str, left_end: str, right_start: str, right_end: str) -> DataFrame:
    """All pairs of overlapping intervals with equal keys, once each.

    Two joins: left rows in the length class of each longer or equally long right one, then right rows in that of each longer
    left one. The longer interval of a pair stands in its own class only, in at most two bins, so two short intervals never
    meet in the bins of a long one, and rows grow with the number of length classes that occur, not with lengths. A
    pair counts in the bin where the later one starts. Bins with very many rows are split by AQE, which may divide the rows
    of one bin. Empty and reversed intervals and null keys or bounds overlap nothing. Columns other than keys differ by name.
    """
    keys = names(keys)
    require(left, *keys, left_start, left_end)
    require(right, *keys, right_start, right_end)
    if clash := (set(left.columns) & set(right.columns)) - set(keys):
        raise ValueError(f"both sides have columns {sorted(clash)}")
    a = left.where(F.col(left_start) < F.col(left_end))
    b = right.where(F.col(right_start) < F.col(right_end))
    of_a, of_b = _levels(a, left_start, left_end), _levels(b, right_start, right_end)
    listed = lambda levels: F.array(*[F.lit(x) for x in levels]).cast("array<int>")
    mine_a, mine_b = _level(left_start, left_end), _level(right_start, right_end)
    later = F.greatest(F.col(left_start), F.col(right_start))
    meets = F.col("_bin") == F.call_function("shiftright", later, F.col("_level") * F.lit(_BITS))

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y, [*keys, "_level", "_bin"]).where(overlaps(left_start, left_end, right_start, right_end) & meets).drop("_level", "_bin")

    longer = pairs(_at(a, left_start, left_end, F.filter(listed(of_b), lambda x: x >= mine_a)), _at(b, right_start, right_end, F.array(mine_b)))
    if not of_b or not of_a or of_a[-1] <= of_b[0]:
        return longer  # no left interval is longer than a right one
    return longer.unionByName(pairs(_at(a, left_start, left_end, F.array(mine_a)), _at(b, right_start, right_end, F.filter(listed(of_a), lambda x: x > mine_b))))


def overlap_length(a_start: str, a_end: str, b_start: str, b_end: str) -> Column:
    """Length of the common part."""
    return F.least(F.col(a_end), F.col(b_end)) - F.greatest(F.col(a_start), F.col(b_start))


def assign_overlaps(left: DataFrame, right: DataFrame, keys: str | list[str], left_start: str, left_end: str, right_start: str, right_end: str) -> DataFrame:
    """All overlaps with ``overlap``, ``left_fraction`` and ``right_fraction`` of the intervals' lengths."""
    j = interval_join(left, right, keys, left_start, left_end, right_start, right_end)
    o = overlap_length(left_start, left_end, right_start, right_end)
    return j.withColumn("overlap", o).withColumn("left_fraction", F.col("overlap") / (F.col(left_end) - F.col(left_start))).withColumn("right_fraction", F.col("overlap") / (F.col(right_end) - F.col(right_start)))


def best_overlap(left: DataFrame, right: DataFrame, keys: str | list[str], left_id: str, left_start: str, left_end: str, right_id: str, right_start: str, right_end: str, *, min_fraction: float = 0.5, left_strand: str | None = None, right_strand: str | None = None, allow_antisense: bool = False) -> DataFrame:
    """The right interval with the largest overlap of each left one: ``left_id``, ``right_id``, ``overlap``, ``fraction``.

    Of equal overlaps the lowest right start wins, then the lowest id. Overlaps of less than ``min_fraction`` of the left
    length are dropped after the choice. With strands, the right strand must equal the left one or be ``.``, unless
    antisense is allowed.
    """
    j = interval_join(left, right, keys, left_start, left_end, right_start, right_end)
    if left_strand and right_strand and not allow_antisense:
        j = j.where((F.col(right_strand) == ".") | (F.col(right_strand) == F.col(left_strand)))
    o = overlap_length(left_start, left_end, right_start, right_end)
    rank = F.struct((-o).alias("o"), F.col(right_start).alias("s"), F.col(right_id).alias("i"))
    best = j.groupBy(left_id).agg(F.min(F.struct(rank.alias("k"), (F.col(left_end) - F.col(left_start)).alias("n"))).alias("m"))
    out = best.select(left_id, F.col("m.k.i").alias(right_id), (-F.col("m.k.o")).alias("overlap"), (-F.col("m.k.o") / F.col("m.n")).alias("fraction"))
    return out.where(F.col("fraction") >= F.lit(min_fraction))


def classify_span(left: DataFrame, right: DataFrame, keys: str | list[str], left_start: str, left_end: str, right_start: str, right_end: str) -> DataFrame:
    """Overlaps with ``role``: ``spanning`` if the left interval holds the whole right one, else ``partial``."""
    j = interval_join(left, right, keys, left_start, left_end, right_start, right_end)
    return j.withColumn("role", F.when((F.col(left_start) <= F.col(right_start)) & (F.col(left_end) >= F.col(right_end)), "spanning").otherwise("partial"))


def viewport(df: DataFrame, start: str, end: str, lo: int, hi: int, *, where: Column | None = None, limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows whose interval overlaps [lo, hi); the comparison reaches the scan. With ``limit``, the first by ``order`` (longest first)."""
    out = df.where((F.col(end) > lo) & (F.col(start) < hi))
    if where is not None:
        out = out.where(where)
    if limit is not None:
        out = out.orderBy(*(order or [F.desc(F.col(end) - F.col(start)), F.asc(start)])).limit(limit)
    return out


def assign_window(df: DataFrame, value: str, windows: DataFrame, lo: str, hi: str, window_id: str) -> DataFrame:
    """First window (by lower bound, then id) with lo <= value < hi for every value; null if there is none.

    Windows are a short list as of one instrument method: they go to every task as one array, after a check of its length.
    """
    n = windows.count()
    if n > 100_000:
        raise ValueError("too many windows for one list; use interval_join")
    one = windows.agg(F.sort_array(F.collect_list(F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(window_id).alias("id")))).alias("_w"))
    hit = F.filter("_w", lambda w: (w["lo"] <= F.col(value)) & (F.col(value) < w["hi"]))
    return df.join(F.broadcast(one)).withColumn(window_id, F.try_element_at(hit, F.lit(1))["id"]).drop("_w")


def merge_windows(df: DataFrame, lo: str, hi: str, digits: int = 1) -> DataFrame:
    """Windows whose rounded bounds are equal become one with the mean bounds."""
    g = df.groupBy(F.round(lo, digits).alias("_lo"), F.round(hi, digits).alias("_hi"))
    return g.agg(F.avg(lo).alias("lo"), F.avg(hi).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_lo", "_hi")


def first_per_group(df: DataFrame, keys: str | list[str], *order: Column) -> DataFrame:
    """The first row of each group by a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*names(keys)).orderBy(*order))).where("_k = 1").drop("_k")
