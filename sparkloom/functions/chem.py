"""Formulas, masses, isotopes, peptides and fragment ions."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Isotope masses and natural abundances of the elements in use (NIST).
ISOTOPES = {
    "H": ((1.00782503223, 0.999885), (2.01410177812, 0.000115)),
    "C": ((12.0, 0.9893), (13.00335483507, 0.0107)),
    "N": ((14.00307400443, 0.99636), (15.00010889888, 0.00364)),
    "O": ((15.99491461957, 0.99757), (16.99913175650, 0.00038), (17.99915961286, 0.00205)),
    "S": ((31.9720711744, 0.9499), (32.9714589098, 0.0075), (33.967867004, 0.0425), (35.96708071, 0.0001)),
    "P": ((30.97376199842, 1.0),),
    "F": ((18.99840316273, 1.0),),
    "Na": ((22.9897692820, 1.0),),
    "Cl": ((34.968852682, 0.7576), (36.965902602, 0.2424)),
    "K": ((38.9637064864, 0.932581), (39.963998166, 0.000117), (40.9618252579, 0.067302)),
    "Br": ((78.9183376, 0.5069), (80.9162897, 0.4931)),
    "I": ((126.9044719, 1.0),),
    "Si": ((27.97692653465, 0.92223), (28.97649466490, 0.04685), (29.973770136, 0.03092)),
    "Se": ((73.922475934, 0.0089), (75.919213704, 0.0937), (76.919914154, 0.0763), (77.91730928, 0.2377), (79.9165218, 0.4961), (81.9166995, 0.0873)),
}
#: Formulas of amino acid residues.
RESIDUES = {
    "A": "C3H5NO", "R": "C6H12N4O", "N": "C4H6N2O2", "D": "C4H5NO3", "C": "C3H5NOS", "E": "C5H7NO3", "Q": "C5H8N2O2", "G": "C2H3NO", "H": "C6H7N3O", "I": "C6H11NO", "L": "C6H11NO",
    "K": "C6H12N2O", "M": "C5H9NOS", "F": "C9H9NO", "P": "C5H7NO", "S": "C3H5NO2", "T": "C4H7NO2", "W": "C11H10N2O", "Y": "C9H9NO2", "V": "C5H9NO", "U": "C3H5NOSe", "O": "C12H19N3O2",
}
#: Id, name and formula change of common modifications (UniMod).
MODIFICATIONS = {
    "UNIMOD:1": ("Acetyl", "C2H2O"), "UNIMOD:4": ("Carbamidomethyl", "C2H3NO"), "UNIMOD:7": ("Deamidated", "H-1N-1O"), "UNIMOD:21": ("Phospho", "HO3P"), "UNIMOD:23": ("Dehydrated", "H-2O-1"), "UNIMOD:27": ("Glu->pyro-Glu", "H-2O-1"),
    "UNIMOD:28": ("Gln->pyro-Glu", "H-3N-1"), "UNIMOD:34": ("Methyl", "CH2"), "UNIMOD:35": ("Oxidation", "O"), "UNIMOD:36": ("Dimethyl", "C2H4"), "UNIMOD:37": ("Trimethyl", "C3H6"), "UNIMOD:121": ("GG", "C4H6N2O2"),
}
#: Neutral losses, their formula and the residues that allow them (none: the modification must).
LOSSES = {"H2O": ("H2O", "STED", None), "NH3": ("NH3", "RKNQ", None), "H3PO4": ("H3PO4", "ST", "UNIMOD:21"), "HPO3": ("HPO3", "Y", "UNIMOD:21")}
PROTON = 1.007276466621
WATER = "H2O"
#: What an ion holds besides its residues, protons left out.
ION_OFFSETS = {"a": {"C": -1, "O": -1}, "b": {}, "c": {"N": 1, "H": 3}, "x": {"C": 1, "O": 2}, "y": {"H": 2, "O": 1}, "z": {"N": -1, "H": -1, "O": 1}}

_TERM = re.compile(r"([A-Z][a-z]?)(-?\d*)")


def parse_formula_of(text: str) -> dict[str, int]:
    """Element counts of a formula; counts may be negative."""
    out: dict[str, int] = {}
    if _TERM.sub("", text.replace(" ", "")):
        raise ValueError(f"not a formula: {text}")
    for e, n in _TERM.findall(text):
        out[e] = out.get(e, 0) + (int(n) if n else 1)
    return {e: n for e, n in out.items() if n}


def parse_formula(text: str | Column) -> Column:
    """Element counts of a formula as a map, within the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    pairs = F.regexp_extract_all(c, F.lit(r"([A-Z][a-z]?-?\d*)"), F.lit(1))
    each = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([A-Z][a-z]?)", 1).alias("e"), F.coalesce(F.nullif(F.regexp_extract(p, r"(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(1)).alias("n")))
    elements = F.array_distinct(F.transform(each, lambda x: x["e"]))
    return F.map_from_entries(F.transform(elements, lambda e: F.struct(e, F.aggregate(F.filter(each, lambda x: x["e"] == e), F.lit(0), lambda s, x: s + x["n"]))))


def mass_of(counts: dict[str, int], *, average: bool = False) -> float:
    """Monoisotopic (lightest isotopes) or average mass."""
    one = {e: sum(m * a for m, a in iso) if average else max(iso, key=lambda x: x[1])[0] for e, iso in ISOTOPES.items()}
    return sum(one[e] * n for e, n in counts.items())


def formula_mass(counts: str | Column, *, average: bool = False) -> Column:
    """Mass of a map of element counts; an unknown element gives null."""
    c = F.col(counts) if isinstance(counts, str) else counts
    table = F.create_map(*[F.lit(x) for e in ISOTOPES for x in (e, mass_of({e: 1}, average=average))])
    return F.aggregate(F.map_entries(c), F.lit(0.0), lambda s, kv: s + F.try_element_at(table, kv["key"]) * kv["value"])


def hill(counts: dict[str, int]) -> str:
    """Formula in Hill order: C, H, then by name; by name alone without C."""
    order = [e for e in ("C", "H") if e in counts] if "C" in counts else []
    order += sorted(set(counts) - set(order))
    return "".join(e + (str(counts[e]) if counts[e] != 1 else "") for e in order if counts[e])


def add(*parts: dict[str, int]) -> dict[str, int]:
    out: dict[str, int] = {}
    for p in parts:
        for e, n in p.items():
            out[e] = out.get(e, 0) + n
    return {e: n for e, n in out.items() if n}


# --- isotopes ----------------------------------------------------------------------------------------------------

def isotope_pattern(counts: dict[str, int], n_peaks: int = 6) -> np.ndarray:
    """Share of each nominal isotope peak, from powers of the abundance polynomials by Fourier transform; the shares add to 1."""
    size = 1
    while size < max(64, 2 * n_peaks, sum((len(ISOTOPES[e])) * min(abs(n), 40) for e, n in counts.items())):
        size *= 2
    spectrum = np.ones(size, complex)
    for e, n in counts.items():
        if n < 0:
            raise ValueError("negative counts have no isotopes")
        base = ISOTOPES[e][0][0]
        p = np.zeros(size)
        for m, a in ISOTOPES[e]:
            p[round(m - base)] += a
        spectrum *= np.fft.fft(p) ** n
    shares = np.clip(np.fft.ifft(spectrum).real[:n_peaks], 0, None)
    return shares / shares.sum()


def isotope_envelope(counts: dict[str, int], n_peaks: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Masses, one neutron apart from the lightest, and shares."""
    light = sum(ISOTOPES[e][0][0] * n for e, n in counts.items())
    return light + np.arange(n_peaks) * (ISOTOPES["C"][1][0] - 12.0), isotope_pattern(counts, n_peaks)


def isotopologues(counts: dict[str, int], prune: float = 1e-6, max_peaks: int = 2000) -> list[tuple[float, float]]:
    """Masses and probabilities of exact isotopologues, the most probable first; those under ``prune`` are left out on the way."""
    state = {0.0: 1.0}
    for e, n in counts.items():
        iso = ISOTOPES[e]
        own = {0.0: 1.0}
        for _ in range(n):  # one atom after another; equal masses fall together
            grown: dict[float, float] = {}
            for m, p in own.items():
                for im, a in iso:
                    k = round(m + im, 8)
                    grown[k] = grown.get(k, 0.0) + p * a
            own = {m: p for m, p in grown.items() if p >= prune / 100}
        joined: dict[float, float] = {}
        for m, p in state.items():
            for im, a in own.items():
                if p * a >= prune:
                    k = round(m + im, 8)
                    joined[k] = joined.get(k, 0.0) + p * a
        state = joined
    return sorted(state.items(), key=lambda x: (-x[1], x[0]))[:max_peaks]


def exact_envelope(counts: dict[str, int], bin_width: float = 1.0, n_peaks: int = 6) -> list[tuple[float, float]]:
    """Isotopologues summed in mass bins from the lightest on: mean mass and share."""
    iso = isotopologues(counts)
    low = min(m for m, _ in iso)
    bins: dict[int, list[float]] = {}
    for m, p in iso:
        b = bins.setdefault(math.floor((m - low) / bin_width + 0.5), [0.0, 0.0])
        b[0] += m * p
        b[1] += p
    whole = sum(b[1] for b in bins.values())
    return [(b[0] / b[1], b[1] / whole) for _, b in sorted(bins.items())][:n_peaks]


def envelope(formula: str | Column, n_peaks: int = 6) -> Column:
    """struct(mass array, share array) of the isotope peaks of each formula."""

    @F.pandas_udf("struct<mass:array<double>,share:array<double>>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [isotope_envelope(parse_formula_of(x), n_peaks) if x else (None, None) for x in s]
        return pd.DataFrame(rows, columns=["mass", "share"])

    return run(F.col(formula) if isinstance(formula, str) else formula)


# --- peptides ----------------------------------------------------------------------------------------------------

_RESIDUE_MASSES = {r: mass_of(parse_formula_of(f)) for r, f in RESIDUES.items()}
_MODIFICATION_MASSES = {k: mass_of(parse_formula_of(f)) for k, (_, f) in MODIFICATIONS.items()}


def residue_masses() -> dict[str, float]:
    return _RESIDUE_MASSES


def modification_masses() -> dict[str, float]:
    return _MODIFICATION_MASSES


def find_modifications(mass: float, tolerance: float = 0.01) -> list[str]:
    """Modifications whose mass change lies within the tolerance, the nearest first."""
    return sorted((k for k, m in modification_masses().items() if abs(m - mass) <= tolerance), key=lambda k: (abs(modification_masses()[k] - mass), k))


def peptide_composition(sequence: str, mods: list[str] = ()) -> dict[str, int]:
    """Element counts of a peptide with modifications."""
    return add(parse_formula_of(WATER), *[parse_formula_of(RESIDUES[r]) for r in sequence], *[parse_formula_of(MODIFICATIONS[m][1]) for m in mods])


def peptide_mass(sequence: str | Column, mod_mass: Column | None = None) -> Column:
    """Monoisotopic mass of each plain sequence plus a given change; null if a residue is unknown. Within the JVM."""
    c = F.col(sequence) if isinstance(sequence, str) else sequence
    table = F.create_map(*[F.lit(x) for kv in residue_masses().items() for x in kv])
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    sum_ = F.aggregate(letters, F.lit(mass_of(parse_formula_of(WATER))), lambda s, r: s + F.try_element_at(table, r))
    return sum_ if mod_mass is None else sum_ + mod_mass


def mz(mass: Column, charge: Column | int) -> Column:
    """m/z of a neutral mass at a charge."""
    z = F.lit(charge) if isinstance(charge, int) else charge
    return (mass + z * F.lit(PROTON)) / z


def ppm_to_da(ppm: Column, at: Column) -> Column:
    return ppm * at * 1e-6


def da_to_ppm(da: Column, at: Column) -> Column:
    return da / at * 1e6


def fragment_mz(residue_mass: float, ion: str, charge: int = 1) -> float:
    """m/z of a fragment from the summed mass of its residues."""
    return (residue_mass + mass_of(ION_OFFSETS[ion]) + charge * PROTON) / charge


def loss_applies(loss: str, residues: str, mods: list[str] = ()) -> bool:
    """Whether a fragment with these residues and modifications can have the loss."""
    _, allowed, needs = LOSSES[loss]
    return (needs is None or needs in mods) and any(r in allowed for r in residues)


def fragments_of(sequence: str, mods: dict[int, str] | None = None, ions: str = "by", max_charge: int = 1, losses: tuple[str, ...] = ()) -> list[tuple[str, int, int, str | None, float]]:
    """Fragment ladder (ion, position, charge, loss, m/z). ``mods``: position from 1 (0: N-terminus) to modification."""
    mods, masses, table = mods or {}, residue_masses(), modification_masses()
    each = [masses[r] + table.get(mods.get(i), 0.0) for i, r in enumerate(sequence, 1)]
    if 0 in mods:
        each[0] += table[mods[0]]
    sums = np.concatenate([[0.0], np.cumsum(each)])
    n, out = len(sequence), []
    for ion in ions:
        for k in range(1, n):
            head = ion in "abc"
            residues = sequence[:k] if head else sequence[n - k :]
            own = [m for p, m in mods.items() if (p <= k if head else p > n - k)]
            m = sums[k] if head else sums[n] - sums[n - k]
            for z in range(1, max_charge + 1):
                out.append((ion, k, z, None, fragment_mz(m, ion, z)))
                for loss in losses:
                    if loss_applies(loss, residues, own):
                        out.append((ion, k, z, loss, fragment_mz(m - mass_of(parse_formula_of(LOSSES[loss][0])), ion, z)))
    return out


def fragment_ladders(df: DataFrame, ident: str, sequence: str, *, ions: str = "by", max_charge: int = 1, losses: tuple[str, ...] = ()) -> DataFrame:
    """Ladders of all peptides in long form: ident, ion, position, charge, loss, mz. Sequences with unknown residues have none."""
    kind = df.schema[ident].dataType.simpleString()
    known = f"^[{''.join(RESIDUES)}]+$"

    def run(batches):
        for part in batches:
            rows = [(i, *f) for i, s in zip(part[ident], part["_s"]) for f in fragments_of(s, None, ions, max_charge, losses)]
            yield pd.DataFrame(rows, columns=[ident, "ion", "position", "charge", "loss", "mz"])

    return df.select(ident, F.col(sequence).alias("_s")).where(F.col("_s").rlike(known)).mapInPandas(run, f"{ident} {kind}, ion string, position int, charge int, loss string, mz double")


def ladder_rows(df: DataFrame, ident: str, sequence: str) -> DataFrame:
    """b and y ions of charge 1 in long form, by running sums over residues: ident, ion, position, mz. Unknown residues give nulls."""
    table = F.create_map(*[F.lit(x) for kv in residue_masses().items() for x in kv])
    letters = F.filter(F.split(F.col(sequence), ""), lambda x: x != "")
    r = df.select(F.col(ident).alias("_id"), F.posexplode(letters).alias("i", "r")).withColumn("m", F.try_element_at(table, F.col("r")))
    w = Window.partitionBy("_id")
    upto = w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = r.select("_id", (F.col("i") + 1).alias("k"), F.sum("m").over(upto).alias("s"), F.sum("m").over(w).alias("whole"), F.count(F.lit(1)).over(w).cast("int").alias("n")).where("k < n")
    ion = lambda kind, position, mz_: F.struct(F.lit(kind).alias("ion"), position.alias("position"), mz_.alias("mz"))
    b = ion("b", F.col("k"), F.col("s") + PROTON)
    y = ion("y", F.col("n") - F.col("k"), F.col("whole") - F.col("s") + mass_of(parse_formula_of(WATER)) + PROTON)
    return s.select(F.col("_id").alias(ident), F.inline(F.array(b, y)))


def by_ladder(sequence: str | Column) -> Column:
    """b and y ions of charge 1 as an array of structs, by running sums within the JVM."""
    c = F.col(sequence) if isinstance(sequence, str) else sequence
    table = F.create_map(*[F.lit(x) for kv in residue_masses().items() for x in kv])
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    zero = F.array().cast("array<double>")
    prefix = F.aggregate(letters, zero, lambda a, r: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + F.try_element_at(table, r))))
    whole, n, water = F.try_element_at(prefix, F.lit(-1)), F.size(prefix), mass_of(parse_formula_of(WATER))
    inner = F.slice(prefix, 1, F.greatest(n - 1, F.lit(0)))
    b = F.transform(inner, lambda m, i: F.struct(F.lit("b").alias("ion"), (i + 1).alias("position"), (m + PROTON).alias("mz")))
    y = F.transform(inner, lambda m, i: F.struct(F.lit("y").alias("ion"), (n - 1 - i).alias("position"), (whole - m + water + PROTON).alias("mz")))
    return F.concat(b, y)
