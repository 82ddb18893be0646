"""Periods, orphans and skewed keys against brute force, with empty, null and repeated rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators.orphans import Child, Parent, orphan_references, orphan_report
from sparkloom.operators.periods import BAND, mark_blocks, periods_and_gaps, reduce_trees
from sparkloom.operators.skew import approx_distinct, count_rows, greatest, heavy_keys, least, mean, salted_aggregate, salted_join, total


def brute_periods(rows):
    out, by = [], {}
    for key, a, b in rows:
        if a is not None and b is not None and a < b:
            by.setdefault(key, []).append((a, b))
    for key, spans in by.items():
        cur = None
        for a, b in sorted(spans):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    out += [(key, "period", *cur), (key, "gap", cur[1], a)]
                cur = [a, b]
        out.append((key, "period", *cur))
    return sorted(out, key=str)


@pytest.mark.parametrize(("reach", "length", "n"), [(60, 12, 80), (5000, 900, 400), (2**40, 2**35, 300)])
def test_periods_match_brute_force(spark, reach, length, n):
    rng = random.Random(reach)
    rows = []
    for _ in range(n):
        a = rng.randint(-reach, reach)
        rows.append((rng.choice(["x", "y", None]), a, a + rng.randint(-2, length)))
    rows += rows[:10] + [("z", None, 4), ("z", 3, None), ("w", 5, 5)]
    df = spark.createDataFrame(rows, "k string, a long, b long").withColumn("kind", F.lit(1)).withColumn("_s", F.lit(2))
    got = sorted((tuple(r) for r in periods_and_gaps(df, "k", "a", "b").collect()), key=str)
    assert got == brute_periods(rows)


def test_periods_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, a long, b long")
    assert periods_and_gaps(empty, "k", "a", "b").collect() == []
    assert periods_and_gaps(spark.createDataFrame([("a", 4, 4)], empty.schema), "k", "a", "b").collect() == []
    with pytest.raises(ValueError):
        periods_and_gaps(empty, "no", "a", "b")


def test_blocks_are_canonical():
    rng = random.Random(3)
    cells = 1 << BAND
    spans = [(a, min(cells, a + rng.randint(1, 900))) for a in (rng.randint(0, cells - 1) for _ in range(60))] + [(0, 1), (0, cells), (cells - 1, cells), (cells // 2 - 1, cells // 2 + 1)]
    full = np.zeros((len(spans), 2 * cells), bool)
    a, b = np.array(spans).T
    mark_blocks(np.arange(len(spans)), a, b, full)
    for row, (s, e) in zip(full, spans):
        taken = {(BAND - (int(n).bit_length() - 1), int(n) - (1 << (int(n).bit_length() - 1))) for n in np.flatnonzero(row)}
        assert sorted(c for level, i in taken for c in range(i << level, (i + 1) << level)) == list(range(s, e))
        assert not any((level, i ^ 1) in taken for level, i in taken)  # no two halves of one block
    r, s, e = reduce_trees(full)
    assert list(zip(s.tolist(), e.tolist())) == spans and r.tolist() == list(range(len(spans)))


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_a_key_over_many_partitions(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot", a, a + rng.choice([1, 30, 30, 9000])) for a in (rng.randint(0, 400_000) for _ in range(900))] + [(f"k{i % 40}", i, i + 2) for i in range(120)] + [("long", 0, 400_000)] + [("long", a, a + 5) for a in range(0, 500_000, 1000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = sorted((tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, "k string, a long, b long").repartition(3), "k", "a", "b").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute_periods(rows)


def test_orphans(spark):
    day = "2026-01-{:02d}"
    parents = spark.createDataFrame([("a", True, day.format(5)), ("b", False, day.format(5)), ("c", True, day.format(9)), ("c", True, day.format(9)), (None, True, day.format(1)), ("d", True, None), ("e", False, day.format(1)), ("e", True, day.format(2))], "k string, live boolean, d string")
    children = spark.createDataFrame([("a", day.format(5)), ("a", day.format(4)), ("b", day.format(6)), ("c", day.format(8)), ("c", day.format(9)), ("x", day.format(7)), ("x", day.format(7)), (None, day.format(7)), ("d", day.format(1)), ("x", None), ("e", day.format(1))], "k string, d string")
    lists = spark.createDataFrame([(["a", "q", None], day.format(9)), ([], day.format(9)), (None, day.format(9))], "k array<string>, d string")
    p = [Parent("P", parents, F.col("k"), F.col("live"), F.col("d"))]
    c = [Child("C", "P", children, F.col("k"), F.col("d")), Child("L", "P", lists, F.col("k"), F.col("d"), many=True)]
    got = {tuple(r) for r in orphan_references(p, c).select("source_table", "period", "ref_key", "reason", "n_refs").collect()}
    assert got == {("C", day.format(4), "a", "late", 1), ("C", day.format(6), "b", "deleted", 1), ("C", day.format(8), "c", "late", 1), ("C", day.format(7), "x", "missing", 2), ("C", None, "x", "missing", 1), ("L", day.format(9), "q", "missing", 1), ("C", day.format(1), "e", "late", 1)}
    report = {tuple(r) for r in orphan_report(orphan_references(p, c)).collect()}
    assert ("C", day.format(7), "missing", 1, 2) in report
    none = [Parent("P", parents.limit(0), F.col("k"), F.col("live"), F.col("d"))]
    assert {r["reason"] for r in orphan_references(none, c).collect()} == {"missing"}
    assert orphan_references(p, [Child("C", "P", children.limit(0), F.col("k"), F.col("d"))]).count() == 0
    with pytest.raises(ValueError):
        orphan_references(p, [Child("C", "Q", children, F.col("k"), F.col("d"))])


def test_salted_aggregate_equals_plain(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1] * 30 + [2] * 10 + list(range(3, 40)) + [None]), rng.randint(0, 50), float(rng.randint(0, 9)) if rng.random() > 0.1 else None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, x double").withColumn("_salt", F.lit(9)).withColumn("rows", F.lit(0))
    aggs = {"n": count_rows(), "s": total("v"), "lo": least("v"), "hi": greatest("v"), "m": mean("x"), "d": approx_distinct("v")}
    got = {r["k"]: r for r in salted_aggregate(df, "k", aggs, share=0.05, salts=7).collect()}
    by: dict = {}
    for k, v, x in rows:
        by.setdefault(k, []).append((v, x))
    assert set(got) == set(by)
    for k, vs in by.items():
        xs = [x for _, x in vs if x is not None]
        r = got[k]
        assert (r["n"], r["s"], r["lo"], r["hi"]) == (len(vs), sum(v for v, _ in vs), min(v for v, _ in vs), max(v for v, _ in vs))
        assert r["m"] == pytest.approx(sum(xs) / len(xs)) if xs else r["m"] is None
        assert abs(r["d"] - len({v for v, _ in vs})) <= 1
    assert salted_aggregate(df.limit(0), "k", aggs).count() == 0
    with pytest.raises(ValueError):
        salted_aggregate(df, "k", {"k": count_rows()})


def test_heavy_keys_and_join(spark):
    rows = [(1, i) for i in range(60)] + [(2, i) for i in range(30)] + [(k, 0) for k in range(3, 13)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k int, v int")
    assert {r["k"]: r["rows"] for r in heavy_keys(df, "k", 0.1).collect()} == {1: 60, 2: 30}
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "n")], "k int, w string")
    got = Counter(tuple(r) for r in salted_join(df, right, "k", share=0.1, salts=4).collect())
    assert got == Counter((k, v, w) for k, v in rows for kk, w in [(1, "a"), (2, "b"), (3, "c"), (3, "d")] if k == kk)
    assert salted_join(df, right, "k", how="left").count() == 60 + 30 + 2 + 9 + 1
