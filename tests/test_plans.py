"""Registered queries on small tables, against brute force: every row of a table counts."""

import datetime as dt
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from sparkloom.plans import kernels, reference

DATA = Path("/root/testdata/sf0.01")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_collision_losers_keep_every_spectrum(spark, tmp_path):
    ions = bytearray(zlib.compress(np.array([100.0, 200.0, 300.0, 400.0], ">f8").tobytes()))
    early, late = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    entry = lambda form, rt, score, loaded=early, deleted=None: (510.0, 2, form, "f", rt, score, ions, 32, loaded, deleted)
    table = [entry("A", 1000.0, 0.01), entry("A", 1000.0, 0.01, late), entry("A", 2000.0, 0.3), entry("A", 2001.0, 0.4), entry("B", 1002.0, 0.1), entry("B", 2002.0, 0.2), entry("C", 3000.0, 0.1), entry("C", 3001.0, 0.2), entry("D", 3002.0, 0.3, late, late)]
    schema = "PrecursorMz double, PrecursorCharge int, PeptideModSeq string, SourceFile string, RTInSeconds double, Score double, MassArray binary, MassEncodedLength int, loaded_at timestamp, deleted_at timestamp"
    spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/entries.parquet")
    at = lambda entry_id: tuple(entry_id.split("/")[i] for i in (0, 3))
    got = [(at(x["entry_id"]), at(x["winner"])) for x in reference.QUERIES["collision_losers"](spark, str(tmp_path)).collect()]
    # spectra of one form (C at 3000 and 3001) never collide with each other, a withdrawn one with none
    assert sorted(got) == [(("A", "2000.0"), ("B", "2002.0")), (("A", "2001.0"), ("B", "2002.0")), (("B", "1002.0"), ("A", "1000.0"))]


def test_trees_of_all_customers(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(300)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    chain = lambda k: [k] + (chain(k // 2) if k else [])
    run = lambda name: rows(reference.QUERIES[name](spark, str(tmp_path)))
    assert run("tree_lineage") == [(k, "/".join(map(str, reversed(chain(k))))) for k in range(300)]
    pairs = [(k, k * 7 % 300) for k in range(300)]
    assert run("tree_lca") == [(a, b, next(x for x in chain(a) if x in chain(b))) for a, b in pairs]


def test_peak_fits_every_user(spark, tmp_path):
    counts = {k: {h: 1 + round(12 * np.exp(-0.5 * ((h - 8 - k % 6) / 3) ** 2)) for h in range(0, 24, 2)} for k in (1, 6, 250, 1499)}
    table = [(k, dt.datetime(2026, 1, 1, h)) for k, hours in counts.items() for h, n in hours.items() for _ in range(n)]
    spark.createDataFrame(table, "user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {x["user_id"]: x for x in reference.QUERIES["peak_fits"](spark, str(tmp_path)).collect()}
    assert set(got) == set(counts)
    mu, sigma = (x.ravel()[:, None] for x in np.meshgrid(np.linspace(0, 24, 97), np.linspace(1, 30, 117)))
    for k, hours in counts.items():
        x, y = np.array(list(hours), float), np.array(list(hours.values()), float)
        shape = np.exp(-0.5 * ((x - mu) / sigma) ** 2) / (sigma * np.sqrt(2 * np.pi))
        area = np.clip((shape * y).sum(1) / (shape * shape).sum(1), 0, 5000)[:, None]  # the best one for each mu and sigma
        best = ((area * shape - y) ** 2).sum(1).min()
        assert got[k]["n"] == len(x) and best * 0.95 <= got[k]["sse"] <= best * (1 + 1e-6)


def _plain(x):
    return "nan" if isinstance(x, float) and x != x else repr(round(float(x), 6)) if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_small_operators_match_their_sql_and_have_rows(spark):
    db = duckdb.connect()
    for f in DATA.iterdir():
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    for name, q in kernels.QUERIES.items():
        if name == "demultiplexed":  # as long as all others; reads have tests of their own
            continue
        df = q(spark, str(DATA))
        cols = sorted(df.columns)
        got = sorted(tuple(map(_plain, x)) for x in df.select(*cols).collect())
        found = db.execute(kernels.SQL[name])
        at = [[d[0] for d in found.description].index(c) for c in cols]
        assert got and got == sorted(tuple(_plain(x[i]) for i in at) for x in found.fetchall()), name


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_demultiplexed_matches_its_sql_with_more_reads(spark, tmp_path):
    db = duckdb.connect()
    db.execute(f"COPY (SELECT p.* REPLACE (p_partkey + 2000 * k AS p_partkey) FROM range(20) t(k), '{DATA}/part.parquet' p) TO '{tmp_path}/part.parquet'")
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    df = kernels.QUERIES["demultiplexed"](spark, str(tmp_path))
    want = db.execute(kernels.SQL["demultiplexed"])
    assert [d[0] for d in want.description] == df.columns
    got = sorted(map(tuple, df.collect()), key=lambda x: x[0])
    assert len(got) == 40_000 and got == sorted(want.fetchall(), key=lambda x: x[0])
