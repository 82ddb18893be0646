"""Continuous periods and gaps from overlapping, nested or touching intervals, by dyadic blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.columns import names, require
from sparkloom.session import cut_lineage, shuffle_partitions

#: Levels in one tree of blocks. A tile has 2**BAND cells, so a group holds at most 2**BAND starts and 2**(BAND + 1) blocks.
BAND = 12
#: Tiles whose trees are reduced together.
TILES = 256


def mark_blocks(row: np.ndarray, start: np.ndarray, end: np.ndarray, full: np.ndarray) -> None:
    """Mark the canonical dyadic blocks of cells [start, end) in the tree ``full[row]``, in heap numbering.

    The tile is block 1, block n has the halves 2n and 2n + 1. At every level at most one block at either end is needed.
    """
    cells = full.shape[1] // 2
    lo, hi = start + cells, end + cells
    while len(lo):
        left, right = lo < hi, lo < hi
        left, right = left & (lo & 1 == 1), right & (hi & 1 == 1)
        full[row[left], lo[left]] = True
        full[row[right], hi[right] - 1] = True
        lo, hi = (lo + left) >> 1, (hi - right) >> 1
        more = lo < hi
        row, lo, hi = row[more], lo[more], hi[more]


def reduce_trees(full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered cells of each tree: row, first cell, cell after the last.

    A block whose two halves are there is there; blocks within one that is there go; adjacent blocks are joined.
    """
    cells = full.shape[1] // 2
    depth = cells.bit_length() - 1
    for d in range(depth - 1, -1, -1):
        lo, hi = 1 << d, 2 << d
        full[:, lo:hi] |= full[:, 2 * lo : 2 * hi : 2] & full[:, 2 * lo + 1 : 2 * hi : 2]
    covered = np.zeros((len(full), 1), bool)
    edge = np.zeros((len(full), cells + 2), np.int8)
    for d in range(depth + 1):
        lo, hi = 1 << d, 2 << d
        top = full[:, lo:hi] & ~covered
        r, n = np.nonzero(top)
        size = cells >> d
        # where one block ends and the next starts, the marks cancel
        edge[r, n * size] += 1
        edge[r, (n + 1) * size] -= 1
        covered = np.repeat(covered | full[:, lo:hi], 2, axis=1)
    (r, s), (_, e) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return r, s, e


def _tiles(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Covered runs of tiles, each given by its pieces, a start and an end in one number."""
    for pieces in parts:
        starts, ends = [], []
        for i in range(0, len(pieces), TILES):
            some = list(pieces.iloc[i : i + TILES])
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            code = np.concatenate(some).astype(np.int64)
            full = np.zeros((len(some), 2 << BAND), bool)
            mark_blocks(np.repeat(np.arange(len(some)), lengths), code >> (BAND + 1), code & ((2 << BAND) - 1), full)
            r, s, e = reduce_trees(full)
            at = np.searchsorted(r, np.arange(1, len(some)))
            starts += np.split(s, at)
            ends += np.split(e, at)
        yield pd.DataFrame({"s": starts, "e": ends})


def _pieces(start: Column, end: Column, bands: int) -> Column:
    """Parts of [start, end) within tiles as an array of (band, cell, n), cells counted in units of their band.

    Its two ends lie within one tile each; the whole tiles between them are cells of the next band, and so on. A piece stands
    for its canonical blocks, of which it is the sum.
    """
    out = []
    for b in range(bands):
        first, last = F.call_function("shiftright", start, F.lit(BAND)), F.call_function("shiftright", end - 1, F.lit(BAND))
        bound = F.call_function("shiftleft", first + 1, F.lit(BAND))
        from_ = F.call_function("shiftleft", last, F.lit(BAND))
        piece = lambda cell, n, b=b: F.struct(F.lit(b).cast("byte").alias("band"), cell.alias("cell"), n.cast("int").alias("n"))
        out.append(F.when(start < end, piece(start, F.least(end, bound) - start)))
        out.append(F.when((start < end) & (first < last), piece(from_, end - from_)))
        start, end = first + 1, last
    return F.array_compact(F.array(*out))


def covered_runs(df: DataFrame, keys: str | list[str], start: str, end: str) -> DataFrame:
    """Disjoint-or-nested covered runs per key (keys, ``_s``, ``_e``): at most two per band for each continuous period.

    Intervals are shuffled as pieces within tiles, of which only the longest at each start is kept, in map tasks first. Tile
    by tile, pieces become canonical blocks and are reduced; a tile that is full goes on as one block of the next band. A
    group is one tile of one key, never a whole key.
    """
    keys = names(keys)
    k = [f"_k{i}" for i in range(len(keys))]
    back = [F.col(c).alias(name) for c, name in zip(k, keys)]
    spans = df.select(*[F.col(f"`{name}`").alias(c) for c, name in zip(k, keys)], F.col(f"`{start}`").cast("long").alias("_s"), F.col(f"`{end}`").cast("long").alias("_e")).where("_s < _e")
    limits = spans.agg(F.min("_s"), F.max("_e")).first()
    if limits[0] is None:
        return spans.select(*back, "_s", "_e")
    # the largest tile there can be: positions of both signs never share a block
    bands = max(abs(int(limits[0])), abs(int(limits[1])), 1).bit_length() // BAND + 1
    pieces = spans.select(*k, F.inline(_pieces(F.col("_s"), F.col("_e"), bands))).groupBy(*k, "band", "cell").agg(F.max("n").alias("n"))
    if bands > 1:
        pieces = cut_lineage(pieces)
    reduce_tiles = F.pandas_udf(_tiles, "s array<int>, e array<int>")
    runs, promoted = [], None
    for b in range(bands):
        own = pieces.where(F.col("band") == b).select(*k, "cell", "n")
        if promoted is not None:
            own = own.unionByName(promoted)
        tile = F.call_function("shiftright", F.col("cell"), F.lit(BAND))
        at = F.col("cell") - F.call_function("shiftleft", tile, F.lit(BAND))
        code = (F.call_function("shiftleft", at, F.lit(BAND + 1)) + at + F.col("n")).cast("int")
        tiles = own.groupBy(*k, tile.alias("tile")).agg(F.collect_list(code).alias("codes"))
        found = tiles.select(*k, "tile", reduce_tiles("codes").alias("u"))
        found = found.select(*k, "tile", F.inline(F.arrays_zip(F.col("u.s").alias("s"), F.col("u.e").alias("e"))))
        if b + 1 < bands:
            found = cut_lineage(found)
            is_full = (F.col("s") == 0) & (F.col("e") == 1 << BAND)
            promoted = found.where(is_full).select(*k, F.col("tile").alias("cell"), F.lit(1).alias("n"))
            found = found.where(~is_full)
        scale = 1 << (b * BAND)
        base = F.col("tile") * F.lit(1 << BAND)
        runs.append(found.select(*k, ((base + F.col("s")) * F.lit(scale)).alias("_s"), ((base + F.col("e")) * F.lit(scale)).alias("_e")))
    return reduce(DataFrame.unionByName, runs).select(*back, "_s", "_e")


def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join overlapping and touching runs of a partition in order of keys and ``_s``, and tell where the next one of the key starts.

    Only the last run of a batch is carried on, so a partition may be of any size.
    """
    context = TaskContext.get()
    pid = context.partitionId() if context else 0
    open_ = None
    schema = None

    def out(rows: pa.Table, s: np.ndarray, e: np.ndarray, following: pa.Array) -> Iterator[pa.RecordBatch]:
        n = len(s)
        cols = [rows.column(c) for c in rows.column_names if c not in ("_s", "_e")]
        fields = [f for f in rows.schema if f.name not in ("_s", "_e")]
        full = pa.schema([*fields, pa.field("_pid", pa.int32()), pa.field("_s", pa.int64()), pa.field("_e", pa.int64()), pa.field("_next", pa.int64())])
        yield from pa.table([*cols, pa.array(np.full(n, pid, np.int32)), pa.array(s), pa.array(e), following], schema=full).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        rows = pa.Table.from_batches([batch] if open_ is None else [*open_.to_batches(), batch]).combine_chunks()
        s, e = rows.column("_s").to_numpy(), rows.column("_e").to_numpy()
        other = np.ones(len(s), bool)
        other[1:] = False
        for c in rows.column_names:
            if c not in ("_s", "_e"):
                code = rows.column(c).combine_chunks().dictionary_encode("encode")
                code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
                other[1:] |= code[1:] != code[:-1]
        segment = np.cumsum(other)
        reach = pd.Series(e).groupby(segment).cummax().to_numpy()
        new = other.copy()
        new[1:] |= s[1:] > reach[:-1]
        at = np.flatnonzero(new)
        s, e, segment = s[at], np.maximum.reduceat(e, at), segment[at]
        heads = rows.take(pa.array(at))
        m = len(at) - 1
        if m:
            same = segment[1:] == segment[:-1]
            yield from out(heads.slice(0, m), s[:-1], e[:-1], pa.array(s[1:], mask=~same))
        last = heads.slice(m, 1)
        open_ = last.set_column(last.column_names.index("_e"), schema.field("_e"), pa.array(e[-1:])).combine_chunks()
    if open_ is not None:
        yield from out(open_, open_.column("_s").to_numpy(), open_.column("_e").to_numpy(), pa.array([None], pa.int64()))


def periods_and_gaps(df: DataFrame, keys: str | list[str], start: str, end: str, *, gaps: bool = True) -> DataFrame:
    """Continuous covered periods per key and the gaps between them: keys, ``kind``, ``range_start``, ``range_end``.

    Integer intervals are half-open. Overlapping, nested and touching ones become one ``period``; a ``gap`` runs
    from the end of a period to the start of the next one of the same key. Runs from ``covered_runs`` are put in
    order over all partitions by key and start and joined within each. What a partition must know of those before and
    after it (the greatest end, the last start, the next start) comes from one summary row per partition of a key that
    lies in several partitions; of these there are at most two for each partition, so they are broadcast.

    Intervals with end <= start or a null bound are ignored; repeated ones change nothing; null keys form a group of
    their own; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    keys = names(keys)
    require(df, *keys, start, end)
    if clash := {"kind", "range_start", "range_end"} & set(keys):
        raise ValueError(f"keys may not be named {sorted(clash)}")
    k = [f"_k{i}" for i in range(len(keys))]
    runs = covered_runs(df, keys, start, end).toDF(*k, "_s", "_e")
    placed = runs.repartitionByRange(shuffle_partitions(df.sparkSession), *k, "_s").sortWithinPartitions(*k, "_s")
    joined = T.StructType([*runs.select(*k).schema.fields, T.StructField("_pid", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("_s", "_e", "_next")]])
    local = cut_lineage(placed.mapInArrow(join_runs, joined))
    earlier = Window.partitionBy(*k).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*k).orderBy("_pid").rowsBetween(1, Window.unboundedFollowing)
    ends = local.groupBy(*k, "_pid").agg(F.max("_e").alias("_m")).withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*k)))
    ends = ends.where("_parts > 1").select(*k, "_pid", F.max("_m").over(earlier).alias("_reach"), F.lit(True).alias("_split"))
    marked = _join_null_safe(local, ends, [*k, "_pid"]).withColumn("_new", F.coalesce(F.col("_s") > F.col("_reach"), F.lit(True)))
    own = F.when(F.col("_new"), F.col("_s"))
    starts = marked.where("_split").groupBy(*k, "_pid").agg(F.max(own).alias("_tail"), F.min(own).alias("_first"))
    starts = starts.select(*k, "_pid", "_tail", F.max("_tail").over(earlier).alias("_last"), F.min("_first").over(later).alias("_after"))
    placed = _join_null_safe(marked, starts, [*k, "_pid"])
    # only the last period of a partition, and runs that lie within or touch an earlier partition's, are put together
    spread = F.col("_split").isNotNull() & (~F.col("_new") | (F.col("_s") == F.col("_tail")))
    alone = placed.where(~spread).select(*k, "_s", "_e", "_next")
    begin = F.when(F.col("_new"), F.col("_s")).otherwise(F.col("_last"))
    across = placed.where(spread).groupBy(*k, begin.alias("_begin")).agg(F.max("_e").alias("_e"), F.min(F.when(F.col("_new"), F.col("_after"))).alias("_next")).withColumnRenamed("_begin", "_s")
    periods = alone.unionByName(across.select(*k, "_s", "_e", "_next"))
    back = [F.col(c).alias(name) for c, name in zip(k, keys)]
    if not gaps:
        return periods.select(*back, F.lit("period").alias("kind"), F.col("_s").alias("range_start"), F.col("_e").alias("range_end"))
    one = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("range_start"), F.col(b).alias("range_end"))
    return periods.select(*back, F.inline(F.array_compact(F.array(one("period", "_s", "_e"), F.when(F.col("_next").isNotNull(), one("gap", "_e", "_next"))))))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys where null equals null; the right side has one row per key, and few rows."""
    r = right.select(*[F.col(c).alias(f"{c}__r") for c in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in keys])
    return left.join(F.broadcast(r), cond, "left").drop(*[f"{c}__r" for c in keys])
