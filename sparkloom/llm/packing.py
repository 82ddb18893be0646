"""Put texts, measured in tokens, into containers of fixed capacity."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.columns import require
from sparkloom.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def token_counts(df: DataFrame, ident: str, text: str, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """Tokens of each text by a public byte-level BPE vocabulary: ``_id``, ``_n``. A null or empty text has none.

    The driver reads the file at ``vocabulary`` and sends its bytes along, so executors need no copy of it.
    ``pattern`` splits texts before merging; without one, that of the vocabularies' package is used.
    """
    require(df, ident, text)
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(vocabulary, "rb") as f:
        lines = f.read()

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for part in parts:
            yield pd.DataFrame({"_id": part["_id"], "_n": [len(encoding.encode_ordinary(t)) if t else 0 for t in part["_text"]]})

    rows = df.select(F.col(f"`{ident}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInPandas(count, f"_id {rows.schema['_id'].dataType.simpleString()}, _n long")


class OpenBins:
    """Bounded-space best fit: at most ``limit`` open bins, found by a bitset over their free space.

    Bit f is set if an open bin has f units free. The best bin for an item is at the lowest set bit that isn't below the
    item's size. If a new bin must be opened and all are in use, the fullest one closes.
    """

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.opened = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return b

    def put(self, size: int) -> tuple[int, int]:
        """Number of the bin that takes an item, and where the item begins in it."""
        fitting = self.bits >> size
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + size
            b = self._take(free)
        else:
            if size < self.capacity and self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, b = self.capacity, self.opened
            self.opened += 1
        left = free - size
        if left or not size:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.count += 1
        return b, self.capacity - free


def pack(sizes: DataFrame, ident: str, size: str, capacity: int = 2048, *, open_bins: int = 64, bins_per_partition: int = 4000) -> DataFrame:
    """Containers of items: ``ident``, ``piece``, ``n_units``, ``container``, ``offset``.

    An item larger than ``capacity`` is cut into full pieces and a rest; every other item stays whole. Items are spread over
    partitions by a hash, each partition packs its own in a fixed order (a task that runs again gives the same), and
    container numbers are unique over all partitions. Each partition fills about ``bins_per_partition`` containers or
    more, so the few that are still open at its end hardly count.

    Items of size 0, and those of null size, go into any open container. Repeated rows are items of their own. An empty
    table gives no rows. Negative sizes raise.
    """
    require(sizes, ident, size)
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins are at least 1")
    n = F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0))
    rows = cut_lineage(sizes.select(F.col(f"`{ident}`").alias("_id"), n.alias("_n")))
    total, least = rows.agg(F.sum("_n"), F.min("_n")).first()
    if least is not None and least < 0:
        raise ValueError("sizes are at least 0")
    partitions = max(1, round((total or 0) / (capacity * bins_per_partition)))
    pieces = F.greatest(F.ceil(F.col("_n") / F.lit(capacity)).cast("int"), F.lit(1))
    cut = rows.select("_id", "_n", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    items = cut.select("_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece") * F.lit(capacity)).alias("n"))
    items = items.withColumn("_h", F.xxhash64(F.col("_id"), F.col("piece"))).repartition(partitions, "_h").sortWithinPartitions("_h", "_id", "piece", "n")

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 33
        for part in parts:
            at = [bins.put(s) for s in part["n"].tolist()]
            yield pd.DataFrame({"_id": part["_id"], "piece": part["piece"], "n_units": part["n"], "container": [first + b for b, _ in at], "offset": [o for _, o in at]})

    kind = rows.schema["_id"].dataType.simpleString()
    return items.mapInPandas(fill, f"_id {kind}, piece int, n_units long, container long, offset long").withColumnRenamed("_id", ident)
