"""Geometry of atom coordinates in long form (frame_id, atom_id, x, y, z)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.chem import ISOTOPES, mass_of

#: Covalent radii in angstrom.
RADII = {"H": 0.31, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "P": 1.07, "S": 1.05, "Cl": 1.02, "Se": 1.20, "Br": 1.20, "I": 1.39, "Na": 1.66, "K": 2.03}


def centroid(coords: DataFrame, weight: Column | float = 1.0) -> DataFrame:
    """Weighted mean position of each frame."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return coords.groupBy("frame_id").agg(*[(F.sum(w * F.col(a)) / F.sum(w)).alias(a) for a in "xyz"])


def with_mass(coords: DataFrame, atoms: DataFrame) -> DataFrame:
    """Adds the average mass of each atom's element."""
    table = F.create_map(*[F.lit(v) for e in ISOTOPES for v in (e, mass_of({e: 1}, average=True))])
    return coords.join(atoms.select("atom_id", F.try_element_at(table, F.col("element")).alias("mass")), "atom_id")


def mass_centroid(coords: DataFrame, atoms: DataFrame) -> DataFrame:
    return centroid(with_mass(coords, atoms), F.col("mass"))


def radius_of_gyration(coords: DataFrame, weight: Column | float = 1.0) -> DataFrame:
    """Root of the weighted mean square distance from the centroid, from sums in one pass."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    n = F.sum(w)
    var = sum((F.sum(w * F.col(a) * F.col(a)) / n - F.pow(F.sum(w * F.col(a)) / n, F.lit(2)) for a in "xyz"), F.lit(0.0))
    return coords.groupBy("frame_id").agg(F.sqrt(F.greatest(var, F.lit(0.0))).alias("rg"))


def principal_axes(coords: DataFrame, weight: Column | float = 1.0) -> DataFrame:
    """Moments of inertia, rising, and their axes, from covariances that are aggregated in the JVM."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    pairs = ["xx", "xy", "xz", "yy", "yz", "zz"]
    sums = coords.groupBy("frame_id").agg(F.sum(w).alias("w"), *[F.sum(w * F.col(a)).alias(a) for a in "xyz"], *[F.sum(w * F.col(p[0]) * F.col(p[1])).alias(p) for p in pairs])
    c = sums.select("frame_id", *[(F.col(p) - F.col(p[0]) * F.col(p[1]) / F.col("w")).alias(p) for p in pairs])

    @F.pandas_udf("struct<moments:array<double>,axes:array<array<double>>>")
    def eigen(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.array([[yy + zz, -xy, -xz], [-xy, xx + zz, -yz], [-xz, -yz, xx + yy]]).transpose(2, 0, 1)
        values, vectors = np.linalg.eigh(m)
        return pd.DataFrame({"moments": list(values), "axes": [[list(v) for v in a.T] for a in vectors]})

    e = c.withColumn("_e", eigen(*pairs))
    return e.select("frame_id", F.col("_e.moments").alias("moments"), F.col("_e.axes").alias("axes"))


def translate(coords: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    return coords.withColumns({a: F.col(a) + F.lit(float(d)) for a, d in zip("xyz", (dx, dy, dz))})


def rotate(coords: DataFrame, matrix: list[list[float]], about: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Rotation by a 3 x 3 matrix about a point."""
    d = [F.col(a) - F.lit(float(o)) for a, o in zip("xyz", about)]
    return coords.withColumns({a: sum((F.lit(float(r)) * v for r, v in zip(row, d)), F.lit(float(o))) for a, row, o in zip("xyz", matrix, about)})


def infer_bonds(atoms: DataFrame, coords: DataFrame, *, tolerance: float = 0.45) -> DataFrame:
    """Pairs i < j whose distance is at most the sum of their radii plus the tolerance.

    Atoms lie in cells as wide as the longest bond; each cell meets itself and the 13 cells on one side of it, so a pair is made once.
    """
    table = F.create_map(*[F.lit(v) for kv in RADII.items() for v in kv])
    width = 2 * max(RADII.values()) + tolerance
    a = coords.join(atoms.select("atom_id", F.try_element_at(table, F.col("element")).alias("r")), "atom_id").where("r IS NOT NULL")
    a = a.withColumns({f"c{k}": F.floor(F.col(k) / width) for k in "xyz"})
    sides = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in sides])
    b = a.withColumn("_s", F.explode(shift)).select("frame_id", F.col("atom_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"), F.col("r").alias("br"), (F.col("cx") - F.col("_s.i")).alias("cx"), (F.col("cy") - F.col("_s.j")).alias("cy"), (F.col("cz") - F.col("_s.k")).alias("cz"), ((F.col("_s.i") == 0) & (F.col("_s.j") == 0) & (F.col("_s.k") == 0)).alias("_same"))
    j = a.join(b, ["frame_id", "cx", "cy", "cz"]).where("(NOT _same OR atom_id < b) AND atom_id <> b")
    d = F.sqrt(F.pow(F.col("x") - F.col("bx"), F.lit(2)) + F.pow(F.col("y") - F.col("by"), F.lit(2)) + F.pow(F.col("z") - F.col("bz"), F.lit(2)))
    return j.where(d <= F.col("r") + F.col("br") + tolerance).select("frame_id", F.least("atom_id", "b").alias("i"), F.greatest("atom_id", "b").alias("j"), d.alias("distance"))


def residue_groups(atoms: DataFrame) -> DataFrame:
    """Residues in the order of their first atom: chain, number, insertion code, name, atoms."""
    return atoms.groupBy("chain_id", "res_seq", "ins_code").agg(F.min("res_name").alias("res_name"), F.min("atom_id").alias("first_atom"), F.count(F.lit(1)).alias("n_atoms"))


def chain_ids(atoms: DataFrame) -> DataFrame:
    """Chains with their first atom, which gives their order."""
    return atoms.groupBy("chain_id").agg(F.min("atom_id").alias("first_atom"))
