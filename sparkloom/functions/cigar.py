"""CIGAR and cs strings to blocks and junctions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OP = re.compile(r"(\d+)([MIDNSHP=X])")
_CS = re.compile(r"=([A-Za-z]+)|:(\d+)|\*([a-z])([a-z])|\+([a-z]+)|-([a-z]+)|~([a-z]{2})(\d+)([a-z]{2})")
_BLOCK = "array<struct<block_index:int,ref_start:long,ref_end:long,query_start:long,query_end:long,n_match:long,n_mismatch:long,n_insert:long,n_delete:long>>"
_FIELDS = ("block_index", "ref_start", "ref_end", "query_start", "query_end", "n_match", "n_mismatch", "n_insert", "n_delete")


class _Blocks:
    """Collects blocks while a string is walked."""

    def __init__(self, ref: int, query: int) -> None:
        self.ref, self.query, self.out = ref, query, []
        self.open()

    def open(self) -> None:
        self.at, self.n = (self.ref, self.query), [0, 0, 0, 0]

    def close(self) -> None:
        if self.ref > self.at[0]:
            self.out.append((len(self.out), self.at[0], self.ref, self.at[1], self.query, *self.n))

    def jump(self, n: int) -> None:
        self.close()
        self.ref += n
        self.open()


def cigar_blocks_of(cigar: str | None, ref_start: int, query_start: int = 0, intron_min: int = 25) -> list[tuple]:
    """Blocks of a CIGAR, split at N and at deletions of at least ``intron_min`` bases. M counts as match."""
    b = _Blocks(ref_start, query_start)
    for n, op in ((int(n), op) for n, op in _OP.findall(cigar or "")):
        if op in "M=X":
            b.n[op == "X"] += n
            b.ref += n
            b.query += n
        elif op == "I":
            b.n[2] += n
            b.query += n
        elif op == "N" or op == "D" and n >= intron_min:
            b.jump(n)
        elif op == "D":
            b.n[3] += n
            b.ref += n
        elif op == "S" and b.ref == ref_start and not b.out:
            b.query += n
            b.at = (b.ref, b.query)
    b.close()
    return b.out


def cs_blocks_of(cs: str | None, ref_start: int, query_start: int = 0) -> list[tuple]:
    """Blocks of a cs string, split at introns, with matches and mismatches told apart."""
    b = _Blocks(ref_start, query_start)
    for m in _CS.finditer(cs or ""):
        same, count, old, _, insert, delete, _, intron, _ = m.groups()
        if same or count:
            n = len(same) if same else int(count)
            b.n[0] += n
            b.ref += n
            b.query += n
        elif old:
            b.n[1] += 1
            b.ref += 1
            b.query += 1
        elif insert:
            b.n[2] += len(insert)
            b.query += len(insert)
        elif delete:
            b.n[3] += len(delete)
            b.ref += len(delete)
        else:
            b.jump(int(intron))
    b.close()
    return b.out


def cs_mismatches_of(cs: str | None, ref_start: int) -> list[int]:
    """Reference positions of substitutions."""
    pos, out = ref_start, []
    for m in _CS.finditer(cs or ""):
        same, count, old, _, insert, delete, _, intron, _ = m.groups()
        if old:
            out.append(pos)
        pos += len(same) if same else int(count) if count else 1 if old else len(delete) if delete else int(intron) if intron else 0
    return out


def _column(parse, kind: str):
    def make(*columns: str | Column, **options) -> Column:
        @F.pandas_udf(kind)
        def run(text: pd.Series, start: pd.Series) -> pd.Series:
            rows = [parse(t, int(s), **options) if t is not None and s == s else [] for t, s in zip(text, start)]
            return pd.Series([[dict(zip(_FIELDS, r)) for r in x] for x in rows] if kind == _BLOCK else rows)

        return run(*[F.col(c) if isinstance(c, str) else c for c in columns])

    return make


cigar_blocks = _column(cigar_blocks_of, _BLOCK)
cs_blocks = _column(cs_blocks_of, _BLOCK)
cs_mismatches = _column(cs_mismatches_of, "array<long>")


def alignment_blocks(alignments: DataFrame, *, intron_min: int = 25) -> DataFrame:
    """One row per block: alignment_id and the block's fields, from the cs string where there is one, else from the CIGAR."""
    cols = set(alignments.columns)
    found = cigar_blocks("cigar", "ref_start", intron_min=intron_min)
    if "cs" in cols:
        found = F.when(F.col("cs").isNotNull(), cs_blocks("cs", "ref_start")).otherwise(found)
    return alignments.select("alignment_id", F.inline(found))


def block_junctions(blocks: Column) -> Column:
    """(donor, acceptor) pairs between adjacent blocks of an array of blocks."""
    n = F.size(blocks)
    pairs = F.zip_with(F.slice(blocks, 1, F.greatest(n - 1, F.lit(0))), F.slice(blocks, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a["ref_end"].alias("donor_pos"), b["ref_start"].alias("acceptor_pos")))
    return pairs


def query_start(cigar: str | Column) -> Column:
    """Length of the leading soft clip, after a hard clip if there is one."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^(?:\d+H)?(\d+)S", 1), F.lit("")).cast("int"), F.lit(0))


def reference_length(cigar: str | Column) -> Column:
    """Bases of the reference that an alignment covers, within the JVM."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    return F.aggregate(F.regexp_extract_all(c, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
