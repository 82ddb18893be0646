"""Text notations: modified peptides, peak annotations, spectrum identifiers, comments, scan filters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.chem import MODIFICATIONS, find_modifications, modification_masses

_NAMES = {name: k for k, (name, _) in MODIFICATIONS.items()}
_TAG = re.compile(r"\[([^\[\]]+)\]")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- modified peptides -------------------------------------------------------------------------------------------

def parse_proforma_of(text: str) -> dict:
    """Sequence, modifications (position from 1; 0 N-terminus, -1 C-terminus), labile ones, global ones and charge of a peptide."""
    rest, out = text.strip(), {"sequence": "", "mods": [], "labile": [], "global": [], "charge": None}
    if m := re.search(r"/(-?\d+)$", rest):
        out["charge"], rest = int(m[1]), rest[: m.start()]
    while m := re.match(r"<([^<>]+)>", rest):
        out["global"].append(m[1])
        rest = rest[m.end() :]
    while m := re.match(r"\{([^{}]+)\}", rest):
        out["labile"].append(m[1])
        rest = rest[m.end() :]
    if m := re.match(r"((?:\[[^\[\]]+\])+)-", rest):
        out["mods"] += [(0, t) for t in _TAG.findall(m[1])]
        rest = rest[m.end() :]
    if m := re.search(r"-((?:\[[^\[\]]+\])+)$", rest):
        tail, rest = [(-1, t) for t in _TAG.findall(m[1])], rest[: m.start()]
    else:
        tail = []
    letters = []
    for m in re.finditer(r"([A-Z])((?:\[[^\[\]]+\])*)|(.)", rest):
        if m[3]:
            raise ValueError(f"unexpected {m[3]!r} in {text!r}")
        letters.append(m[1])
        out["mods"] += [(len(letters), t) for t in _TAG.findall(m[2])]
    out["sequence"], out["mods"] = "".join(letters), out["mods"] + tail
    return out


def format_proforma_of(p: dict) -> str:
    """The inverse of ``parse_proforma_of``."""
    at: dict[int, str] = {}
    for i, t in p["mods"]:
        at[i] = at.get(i, "") + f"[{t}]"
    body = "".join(r + at.get(i, "") for i, r in enumerate(p["sequence"], 1))
    head = "".join(f"<{g}>" for g in p.get("global", ())) + "".join(f"{{{x}}}" for x in p.get("labile", ()))
    return head + (at[0] + "-" if 0 in at else "") + body + ("-" + at[-1] if -1 in at else "") + (f"/{p['charge']}" if p.get("charge") else "")


def proforma(text: str | Column) -> Column:
    """struct(sequence, mods, charge) of each peptide; null where the text isn't one."""

    @F.pandas_udf("struct<sequence:string,mods:array<struct<position:int,tag:string>>,charge:int>")
    def run(s: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple] = {}
        for x in s.dropna().unique():  # repeated texts are parsed once
            try:
                p = parse_proforma_of(x)
                known[x] = (p["sequence"], [{"position": i, "tag": t} for i, t in p["mods"]], p["charge"])
            except ValueError:
                known[x] = (None, None, None)
        return pd.DataFrame([known.get(x, (None, None, None)) for x in s], columns=["sequence", "mods", "charge"], dtype=object)

    return run(_col(text))


def modseq_to_proforma_of(modseq: str, tolerance: float = 0.01) -> str:
    """``X[+mass]`` notation to ProForma: masses become modification ids where one is near, the nearest; others stay masses."""
    def tag(m: re.Match) -> str:
        found = find_modifications(float(m[1]), tolerance)
        return f"[{found[0]}]" if found else f"[{float(m[1]):+.6f}]"

    text = re.sub(r"[\[(]([+-]?\d+\.?\d*)[\])]", tag, modseq.strip())
    return re.sub(r"^((?:\[[^\[\]]+\])+)(?=[A-Z])", r"\1-", text)


def proforma_to_modseq_of(text: str) -> str:
    """ProForma to ``X[+mass]`` with six decimals."""
    masses = modification_masses()
    def mass(t: str) -> float:
        return masses[t] if t in masses else masses[_NAMES[t]] if t in _NAMES else float(t)

    p = parse_proforma_of(text)
    at: dict[int, str] = {}
    for i, t in p["mods"]:
        at[i] = at.get(i, "") + f"[{mass(t):+.6f}]"
    return at.get(0, "") + "".join(r + at.get(i, "") for i, r in enumerate(p["sequence"], 1))


def maxquant_to_proforma_of(modseq: str, fixed: dict[str, str] | None = None) -> str:
    """``_(Acetyl (Protein N-term))AC(Oxidation (M))K_`` to ProForma; ``fixed`` adds a modification to each of a residue."""
    fixed = fixed or {}
    s, out, i = modseq.strip("_"), "", 0
    while i < len(s):
        if s[i] == "(":
            depth, j = 1, i + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(s[j], 0)
                j += 1
            name = s[i + 1 : j - 1].split(" (")[0]
            out += f"[{_NAMES.get(name, name)}]" + ("-" if not out else "")
            i = j
        else:
            out += s[i] + (f"[{fixed[s[i]]}]" if s[i] in fixed else "")
            i += 1
    return out


def _texts(parse):
    def make(text: str | Column, **options) -> Column:
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            known = {}
            for x in s.dropna().unique():
                try:
                    known[x] = parse(x, **options)
                except (ValueError, KeyError, IndexError):
                    known[x] = None
            return s.map(known)

        return run(_col(text))

    return make


modseq_to_proforma = _texts(modseq_to_proforma_of)
proforma_to_modseq = _texts(proforma_to_modseq_of)
maxquant_to_proforma = _texts(maxquant_to_proforma_of)


def stripped(modseq: str | Column) -> Column:
    """Plain residues of a modified sequence, within the JVM."""
    return F.regexp_replace(_col(modseq), r"\[[^\[\]]*\]|\([^()]*\)|[^A-Z]", "")


# --- annotations -------------------------------------------------------------------------------------------------

_MZPAF = re.compile(r"^(?:(?P<analyte>\d+)@)?(?:(?P<ion>[abcxyz])(?P<position>\d+)|(?P<precursor>p)|I(?P<immonium>[A-Z])|m(?P<internal>\d+:\d+)|(?P<unknown>\?))(?P<losses>(?:[+-](?:\d*[A-Z][A-Za-z0-9]*))*)(?:(?P<isotope>[+-]\d*)i)?(?:\^(?P<charge>\d+))?(?:/(?P<error>-?\d+\.?\d*(?:e-?\d+)?)(?P<unit>ppm)?)?(?:\*(?P<confidence>\d*\.?\d+))?$")


def parse_mzpaf_of(text: str) -> dict:
    """Parts of a peak annotation; raises ValueError if it isn't one."""
    m = _MZPAF.match(text.strip())
    if not m:
        raise ValueError(f"not an annotation: {text}")
    g = m.groupdict()
    kind = "fragment" if g["ion"] else "precursor" if g["precursor"] else "immonium" if g["immonium"] else "internal" if g["internal"] else "unknown"
    number = lambda x, t: t(x) if x else None
    iso = None if g["isotope"] is None else int(g["isotope"] + "1" if g["isotope"] in "+-" else g["isotope"])
    return {"kind": kind, "ion": g["ion"] or g["immonium"] or g["internal"], "position": number(g["position"], int), "losses": g["losses"] or None, "isotope": iso, "charge": int(g["charge"] or 1), "error": number(g["error"], float), "unit": (g["unit"] or "Da") if g["error"] else None, "confidence": number(g["confidence"], float)}


def format_mzpaf_of(p: dict) -> str:
    """The inverse of ``parse_mzpaf_of``."""
    base = {"fragment": f"{p['ion']}{p['position']}", "precursor": "p", "immonium": f"I{p['ion']}", "internal": f"m{p['ion']}", "unknown": "?"}[p["kind"]]
    iso = "" if p.get("isotope") is None else ("+" if p["isotope"] == 1 else "-" if p["isotope"] == -1 else f"{p['isotope']:+d}") + "i"
    error = "" if p.get("error") is None else f"/{p['error']:g}" + ("ppm" if p.get("unit") == "ppm" else "")
    return base + (p.get("losses") or "") + iso + (f"^{p['charge']}" if p.get("charge", 1) != 1 else "") + error + (f"*{p['confidence']:g}" if p.get("confidence") is not None else "")


def mzpaf(text: str | Column) -> Column:
    """Parts of each annotation as a struct; nulls where it isn't one."""
    fields = ["kind", "ion", "position", "losses", "isotope", "charge", "error", "unit", "confidence"]

    @F.pandas_udf("struct<kind:string,ion:string,position:int,losses:string,isotope:int,charge:int,error:double,unit:string,confidence:double>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                rows.append(parse_mzpaf_of(x) if x is not None else {})
            except ValueError:
                rows.append({})
        return pd.DataFrame([[row.get(f) for f in fields] for row in rows], columns=fields, dtype=object)

    return run(_col(text))


def render_mzpaf(ion: str | Column, position: str | Column, charge: str | Column, loss: str | Column) -> Column:
    """Annotations of fragment rows, within the JVM."""
    z = _col(charge)
    return F.concat(_col(ion), _col(position).cast("string"), F.coalesce(F.concat(F.lit("-"), _col(loss)), F.lit("")), F.when(z > 1, F.concat(F.lit("^"), z.cast("string"))).otherwise(""))


def usi(text: str | Column) -> Column:
    """Parts of universal spectrum identifiers: collection, run, index_type, index, interpretation; null where it isn't one."""
    c = _col(text)
    p = r"^mzspec:([^:]+):(.+):(scan|index|nativeId|trace):([^:]+)(?::(.+))?$"
    part = lambda i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    return F.when(c.rlike(p), F.struct(part(1).alias("collection"), part(2).alias("run"), part(3).alias("index_type"), part(4).alias("index"), part(5).alias("interpretation")))


def comment_fields(line: str | Column) -> Column:
    """``key=value`` pairs of a comment line, quotes allowed, as a map; the last of a repeated key counts."""
    c = _col(line)
    found = F.regexp_extract_all(c, F.lit(r'([^\s=]+=(?:"[^"]*"|\S*))'), F.lit(1))
    pairs = F.transform(found, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"^[^=]+=(.*)$", 1), '^"|"$', "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))


def mods_field(value: str | Column) -> Column:
    """``n/pos,res,name/...`` as an array of structs; positions count from 0 there."""
    parts = F.slice(F.split(_col(value), "/"), 2, 1000)
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(F.split(x, ",")[0].cast("int").alias("position"), F.split(x, ",")[1].alias("residue"), F.split(x, ",")[2].alias("name")))


def scan_filter(text: str | Column) -> Column:
    """Fields of a scan filter text: analyzer, polarity, level, precursor m/z, activation, energy, range."""
    c = _col(text)
    get = lambda p, i=1: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    level = F.coalesce(get(r"\bms(\d+)\b").cast("int"), F.when(c.rlike(r"\bms\b"), F.lit(1)))
    return F.struct(
        get(r"^(FTMS|ITMS|TQMS|SQMS|TOFMS|ASTMS)").alias("analyzer"), F.when(c.rlike(r"\s\+\s"), "+").when(c.rlike(r"\s-\s"), "-").alias("polarity"), level.alias("level"),
        get(r"(\d+\.\d+)@").cast("double").alias("precursor_mz"), get(r"@([a-z]+)\d").alias("activation"), get(r"@[a-z]+(\d+\.?\d*)").cast("double").alias("energy"),
        get(r"\[(\d+\.?\d*)-").cast("double").alias("low_mz"), get(r"-(\d+\.?\d*)\]").cast("double").alias("high_mz"),
    )


def gene_of_header(header: str | Column) -> Column:
    """Gene of a FASTA header: ``GN=`` or ``gene=`` or ``gene:``."""
    c = _col(header)
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(c, r"\bGN=(\S+)", 1), F.lit("")), F.regexp_extract(c, r"\bgene[=:]([^\s\];]+)", 1)), F.lit(""))
