"""Functions on nucleotide and protein sequences; columns in, columns out."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC nucleotide codes and their bases.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Alphabets, the first that holds all characters names a sequence.
ALPHABETS = {"dna": "ACGT", "rna": "ACGU", "dna_iupac": "ACGTRYSWKMBDHVN", "rna_iupac": "ACGURYSWKMBDHVN", "protein": "ACDEFGHIKLMNPQRSTVWY", "protein_extended": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Amino acids of genetic codes, codons in the order of bases TCAG; and their start codons.
CODES = {
    1: ("FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("TTG", "CTG", "ATG")),
    2: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG", ("ATT", "ATC", "ATA", "ATG", "GTG")),
    3: ("FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("ATA", "ATG", "GTG")),
    4: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("TTA", "TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")),
    5: ("FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG", ("TTG", "ATT", "ATC", "ATA", "ATG", "GTG")),
    6: ("FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("ATG",)),
    11: ("FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")),
}
#: Cleavage rules of proteases, a cut where the pattern matches between residues.
PROTEASES = {
    "trypsin": r"(?<=[KR])(?!P)",
    "trypsin/p": r"(?<=[KR])",
    "lys-c": r"(?<=K)",
    "lys-n": r"(?=K)",
    "arg-c": r"(?<=R)",
    "asp-n": r"(?=D)",
    "glu-c": r"(?<=E)",
    "glu-c-de": r"(?<=[DE])",
    "chymotrypsin": r"(?<=[FWY])(?!P)",
    "chymotrypsin-low": r"(?<=[FWYLM])(?!P)",
    "cnbr": r"(?<=M)",
    "proline-endopeptidase": r"(?<=[HKR]P)(?!P)",
    "elastase": r"(?<=[AVSGLI])(?!P)",
    "formic-acid": r"(?<=D)",
    "pepsin": r"(?<=[FL])",
    "no-cleavage": r"(?!)",
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement(seq: str | Column, *, rna: bool = False) -> Column:
    """IUPAC complement in upper case."""
    return F.translate(F.upper(_col(seq)), "ACGTURYSWKMBDHVN", "UGCAAYRSWMKVHDBN" if rna else "TGCAAYRSWMKVHDBN")


def reverse_complement(seq: str | Column, *, rna: bool = False) -> Column:
    return F.reverse(complement(seq, rna=rna))


def normalize(seq: str | Column, *, dna: bool = True) -> Column:
    """Without white space, upper case, U turned to T for DNA."""
    c = F.upper(F.regexp_replace(_col(seq), r"\s+", ""))
    return F.translate(c, "U", "T") if dna else c


def is_valid(seq: str | Column, alphabet: str) -> Column:
    return F.coalesce(F.upper(_col(seq)).rlike(f"^[{ALPHABETS[alphabet]}]*$"), F.lit(False))


def validate(seq: str | Column, alphabet: str) -> Column:
    """The sequence; the query fails at one with other characters. Null stays null."""
    c = _col(seq)
    return F.when(c.isNull() | is_valid(c, alphabet), c).otherwise(F.raise_error(F.concat(F.lit(f"not {alphabet}: "), F.substring(c, 1, 40))))


def identify_alphabet(seq: str | Column, candidates: tuple[str, ...] = tuple(ALPHABETS)) -> Column:
    """First alphabet with all characters; null if none."""
    out = F.lit(None).cast("string")
    for name in reversed(candidates):
        out = F.when(is_valid(seq, name), name).otherwise(out)
    return out


def hamming(a: str | Column, b: str | Column) -> Column:
    """Positions that differ; unequal lengths fail."""
    a, b = _col(a), _col(b)
    differ = F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(F.length(a) != F.length(b), F.raise_error(F.lit("sequences of unequal length")).cast("int")).when(F.length(a) == 0, F.lit(0)).otherwise(differ)


def windows(seq: str | Column, size: int, step: int = 1) -> Column:
    """All substrings of a size at every step, as an array."""
    c = _col(seq)
    starts = F.sequence(F.lit(1), F.length(c) - size + 1, F.lit(step))
    return F.when(F.length(c) >= size, F.transform(starts, lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def kmers(seq: str | Column, k: int, step: int = 1) -> Column:
    return windows(seq, k, step)


def gc_fraction(seq: str | Column) -> Column:
    """GC share; ambiguous codes count by the share of G and C among their bases. Other characters fail; empty gives 0."""
    c = F.upper(F.translate(_col(seq), "Uu", "TT"))
    rest = F.regexp_replace(c, "[" + "".join(IUPAC) + "]", "")
    total = F.lit(0.0)
    for code, bases in IUPAC.items():
        share = sum(b in "GC" for b in bases) / len(bases)
        if share:
            total = total + (F.length(c) - F.length(F.translate(c, code, ""))) * F.lit(share)
    return F.when(c.isNull(), F.lit(None).cast("double")).when(F.length(rest) > 0, F.raise_error(F.lit("not a nucleotide sequence")).cast("double")).when(F.length(c) == 0, 0.0).otherwise(total / F.length(c))


def gc_windows(seq: str | Column, size: int, step: int = 1) -> Column:
    return F.transform(windows(seq, size, step), gc_fraction)


_CODONS: dict[int, dict[str, str]] = {}


def codon_table(code: int = 1) -> dict[str, str]:
    """All 3,375 codons of IUPAC letters: the amino acid if it is certain, B or Z if it is one of two acids, else X."""
    if code in _CODONS:
        return _CODONS[code]
    aminos, _ = CODES[code]
    plain = {a + b + c: aminos[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    out = {}
    for codon in itertools.product(IUPAC, repeat=3):
        found = {plain[a + b + c] for a in IUPAC[codon[0]] for b in IUPAC[codon[1]] for c in IUPAC[codon[2]]}
        out["".join(codon)] = found.pop() if len(found) == 1 else "B" if found == {"D", "N"} else "Z" if found == {"E", "Q"} else "X"
    _CODONS[code] = out
    return out


def translate_text(seq: str | None, *, code: int = 1, frame: int = 0, to_stop: bool = False, first_as_start: bool = False, partial: str = "drop") -> str | None:
    """Protein of one sequence. ``partial``: what a last codon of one or two bases does (drop, X, raise)."""
    if seq is None:
        return None
    s, table = seq.upper().replace("U", "T")[frame:], codon_table(code)
    if len(s) % 3 and partial == "raise":
        raise ValueError("the length isn't a multiple of 3")
    out = "".join(table.get(s[i : i + 3], "X") for i in range(0, len(s) - 2, 3))
    if first_as_start and s[:3] in CODES[code][1]:
        out = "M" + out[1:]
    if to_stop:
        return out.split("*", 1)[0]
    return out + "X" if len(s) % 3 and partial == "X" else out


def translate(seq: str | Column, **options) -> Column:
    """Protein of each sequence, with the options of ``translate_text``."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: translate_text(x, **options), na_action="ignore")

    return run(_col(seq))


def orfs_of(seq: str | None, *, code: int = 1, min_length: int = 30, both_strands: bool = True, longest_per_stop: bool = True) -> list[tuple[str, int, int, str]]:
    """Open reading frames (strand, start, end, protein) from start codon to stop; on ``-`` in coordinates of the reverse complement.

    Only unambiguous codons count. In order of strand, start and falling length.
    """
    if not seq:
        return []
    plain = seq.upper().replace("U", "T")
    strands = [("+", plain)] + ([("-", plain.translate(str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"))[::-1])] if both_strands else [])
    table, starts, out = codon_table(code), set(CODES[code][1]), []
    for strand, s in strands:
        for frame in range(3):
            opened: list[int] = []
            for i in range(frame, len(s) - 2, 3):
                codon = s[i : i + 3]
                if not set(codon) <= set("ACGT"):
                    opened = []
                elif table[codon] == "*":
                    for p in opened[:1] if longest_per_stop else opened:
                        protein = "M" + "".join(table[s[k : k + 3]] for k in range(p + 3, i, 3))
                        if len(protein) >= min_length:
                            out.append((strand, p, i + 3, protein))
                    opened = []
                elif codon in starts:
                    opened.append(i)
    return sorted(out, key=lambda o: (o[0] == "-", o[1], o[1] - o[2]))


def orfs(seq: str | Column, **options) -> Column:
    """Open reading frames as an array of structs."""

    @F.pandas_udf("array<struct<strand:string,start:int,end:int,protein:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"strand": a, "start": b, "end": c, "protein": d} for a, b, c, d in orfs_of(x, **options)])

    return run(_col(seq))


def best_orf(seq: str | Column, **options) -> Column:
    """The longest open reading frame, the first of equally long ones; null if there is none."""
    return F.try_element_at(F.sort_array(F.transform(orfs(seq, **options), lambda o: F.struct((o["start"] - o["end"]).alias("k"), (o["strand"] == "-").alias("m"), o["start"].alias("p"), o.alias("o")))), F.lit(1))["o"]


def cleave_sites_of(seq: str, protease: str = "trypsin") -> list[int]:
    """Cut positions of one protein, both ends included."""
    cuts = {m.start() for m in re.finditer(PROTEASES.get(protease, protease), seq)}
    return sorted({0, len(seq)} | {c for c in cuts if 0 < c < len(seq)})


def digest_of(seq: str | None, protease: str = "trypsin", *, missed: int = 0, min_length: int = 1, max_length: int | None = None, semi: bool = False, excise_met: bool = False) -> list[tuple[int, int, str]]:
    """Peptides (start, end, sequence) of one protein in order of start and end, the first of each sequence.

    ``semi`` adds peptides with one free end; ``excise_met`` adds the first peptides without their initial M.
    """
    if not seq:
        return []
    cuts, spans = cleave_sites_of(seq, protease), set()
    for i in range(len(cuts) - 1):
        for j in range(i + 1, min(i + 2 + missed, len(cuts))):
            spans.add((cuts[i], cuts[j]))
    if semi:
        spans |= {(a, k) for a, b in set(spans) for k in range(a + 1, b)} | {(k, b) for a, b in set(spans) for k in range(a + 1, b)}
    if excise_met and seq[0] == "M":
        spans |= {(1, b) for a, b in set(spans) if a == 0 and b > 1}
    seen, out = set(), []
    for a, b in sorted(spans):
        p = seq[a:b]
        if len(p) >= min_length and (max_length is None or len(p) <= max_length) and p not in seen:
            seen.add(p)
            out.append((a, b, p))
    return out


def digest(seq: str | Column, protease: str = "trypsin", **options) -> Column:
    """Peptides of each protein as an array of structs (start, end, peptide)."""

    @F.pandas_udf("array<struct<start:int,end:int,peptide:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"start": a, "end": b, "peptide": p} for a, b, p in digest_of(x, protease, **options)])

    return run(_col(seq))


def tryptic_peptides(seq: str | Column) -> Column:
    """Fully cleaved tryptic peptides within the JVM, for the usual case without options."""
    return F.filter(F.split(_col(seq), PROTEASES["trypsin"]), lambda p: p != "")


# --- error-tolerant search ---------------------------------------------------------------------------------------

def edit_distance(a: str | Column, b: str | Column, limit: int | None = None) -> Column:
    """Global edit distance; null beyond the limit."""
    if limit is None:
        return F.levenshtein(_col(a), _col(b))
    return F.nullif(F.levenshtein(_col(a), _col(b), limit), F.lit(-1))


def _first_best(query: str, ref: str) -> tuple[int, int]:
    """Least edit distance of a query anywhere in a text and where the first best place ends, a column of the programme at once.

    The differences down a column are kept as bits of two whole numbers.
    """
    m = len(query)
    full, top = (1 << m) - 1, 1 << m - 1
    equal: dict[str, int] = {}
    for i, q in enumerate(query):
        equal[q] = equal.get(q, 0) | 1 << i
    up, down, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(ref, 1):
        eq = equal.get(c, 0)
        across = ((eq & up) + up ^ up) | eq
        more, less = down | ~(across | up) & full, up & across
        score += 1 if more & top else -1 if less & top else 0
        if score < best[0]:
            best = (score, j)
        more, less, eq = more << 1 & full, less << 1 & full, eq | down
        up, down = less | ~(eq | more) & full, more & eq
    return best


def locate_of(query: str, ref: str, mode: str = "infix") -> tuple[int, int, int]:
    """Least edit distance of a query within a text, and where (start, end) the first best place lies.

    ``infix``: anywhere; ``prefix``: from the text's beginning on, its rest is free.
    """
    if mode == "infix" and query and len(ref) > 2 * len(query):
        # only the letters that the first best place can hold are aligned
        d, end = _first_best(query, ref)
        at = max(0, end - len(query) - d)
        d, start, stop = _aligned(query, ref[at:end], mode)
        return (d, at + start, at + stop) if end else (d, 0, 0)
    return _aligned(query, ref, mode)


def _aligned(query: str, ref: str, mode: str) -> tuple[int, int, int]:
    # one row of the dynamic programme for each letter of the text: (distance, start)
    column = [(i, 0) for i in range(len(query) + 1)]
    best = (column[-1][0], 0, 0)
    for j, c in enumerate(ref, 1):
        last, column = column, [(0, j) if mode == "infix" else (j, 0)]
        for i, q in enumerate(query, 1):
            d, s = last[i - 1]
            step = (d + (q != c), s)
            step = min(step, (last[i][0] + 1, last[i][1]), (column[i - 1][0] + 1, column[i - 1][1]), key=lambda x: x[0])
            column.append(step)
        if column[-1][0] < best[0]:
            best = (column[-1][0], column[-1][1], j)
    return best


#: Texts and letters of them that are searched at once; texts are searched in pieces of so many letters, all side by side.
_TEXTS, _LETTERS, _PIECE = 8192, 1 << 22, 512


def _blocks(texts: list[str]):
    """Slices of a list of texts, each within the limits or of one text."""
    begin, letters = 0, 0
    for i, x in enumerate(texts):
        if i > begin and (i - begin == _TEXTS or letters + len(x) > _LETTERS):
            yield slice(begin, i)
            begin, letters = i, 0
        letters += len(x)
    if len(texts) > begin:
        yield slice(begin, len(texts))


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)


def ends_of(query: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of a query anywhere in each text and where the first best place ends, as ``locate_of`` has them."""
    m = len(query)
    if not m or m > 64 or not query.isascii() or "?" in query:  # what isn't Latin is read as a question mark
        found = [_first_best(query, x) if m else (0, 0) for x in texts]
        return np.array([d for d, _ in found], int), np.array([e for _, e in found], int)
    parts = [_first_best_of(query, texts[b]) for b in _blocks(texts)]
    return np.concatenate([np.empty(0, int), *[d for d, _ in parts]]), np.concatenate([np.empty(0, int), *[e for _, e in parts]])


def _first_best_of(query: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The columns of ``_first_best`` of all pieces of the texts at once.

    A piece begins twice the query's length early: no best place is longer, so from there on its distances are those of the whole text.
    """
    m, word = len(query), np.uint32 if len(query) <= 32 else np.uint64
    sizes = np.fromiter(map(len, texts), int, len(texts))
    pieces = -(-sizes // _PIECE)
    own = np.repeat(np.arange(len(texts)), pieces)  # each piece's text
    first = (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _PIECE
    begin, stop = np.maximum(first - 2 * m, 0), np.minimum(first + _PIECE, sizes[own])
    order = np.argsort(begin - stop, kind="stable")  # the longest first: those that go on are always the first ones
    own, begin, length = own[order], begin[order], (stop - begin)[order]
    at, letters = (np.cumsum(sizes) - sizes)[own] + begin, _letters(texts)
    masks, one, top = np.zeros(256, word), word(1), word(m - 1)
    for i, c in enumerate(query):
        masks[ord(c)] |= one << word(i)
    up, down = np.full(len(own), ~word(0)), np.zeros(len(own), word)
    score, best, end = (np.full(len(own), k, np.int32) for k in (m, m, 0))
    for j, n in enumerate(np.searchsorted(-length, -np.arange(length[0]), "left") if len(own) else ()):
        if n < len(up):
            up, down, score = up[:n], down[:n], score[:n]
        eq = masks[letters[at[:n] + j]]
        across = ((eq & up) + up ^ up) | eq
        more, less = down | ~(across | up), up & across
        score = score + (more >> top & one).astype(np.int32) - (less >> top & one).astype(np.int32)
        better = score < best[:n]
        np.copyto(best[:n], score, where=better)
        np.copyto(end[:n], j + 1, where=better)
        more, less, eq = more << one, less << one, eq | down
        up, down = less | ~(eq | more), more & eq
    # of a text's pieces, the least distance and its first end
    key = np.full(len(texts), m << 40)
    np.minimum.at(key, own, np.where(best < m, (best.astype(int) << 40) + begin + end, m << 40))
    return key >> 40, key & (1 << 40) - 1


def places_of(query: str, texts: list[str], max_distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``locate_of`` of a query in each text: distance, start, end; beyond the greatest distance start is -1."""
    d, end = ends_of(query, texts)
    m, start = len(query), np.where(d == 0, end - len(query), 0)
    start[d > max_distance] = -1
    rows = np.flatnonzero((d <= max_distance) & (d > 0) & (end > 0))
    low = np.maximum(end[rows] - m - d[rows], 0)
    windows = [texts[i][a:e] for i, a, e in zip(rows.tolist(), low.tolist(), end[rows].tolist())]
    if not query.isascii() or "?" in query:
        start[rows] = low + np.array([_aligned(query, w, "infix")[1] for w in windows], int)
        return d, start, end
    for b in _blocks(windows):
        start[rows[b]] = low[b] + _starts(query, windows[b])
    return d, start, end


def _starts(query: str, windows: list[str]) -> np.ndarray:
    """Where the place that ends with each window begins: the rows of ``_aligned``, of all windows at once."""
    sizes = np.fromiter(map(len, windows), int, len(windows))
    letters, at = _letters(windows), np.cumsum(sizes) - sizes
    column = [(np.full(len(windows), i, np.int32), np.zeros(len(windows), np.int32)) for i in range(len(query) + 1)]
    out = np.zeros(len(windows), int)
    for j in range(1, int(sizes.max()) + 1):
        c = letters[np.minimum(at + j - 1, len(letters) - 1)]  # what stands behind a window counts no more
        last, column = column, [(np.zeros(len(windows), np.int32), np.full(len(windows), j, np.int32))]
        for i, q in enumerate(query, 1):
            d, s = last[i - 1][0] + (c != ord(q)), last[i - 1][1]
            for other, from_there in (last[i], column[i - 1]):
                better = other + 1 < d
                d, s = np.where(better, other + 1, d), np.where(better, from_there, s)
            column.append((d, s))
        out = np.where(sizes == j, column[-1][1], out)
    return out


def locate(query: str, ref: str | Column, max_distance: int, mode: str = "infix") -> Column:
    """struct(distance, start, end) of the best place of a fixed query in each text; null beyond the limit."""

    @F.pandas_udf("struct<distance:int,start:int,end:int>")
    def run(s: pd.Series) -> pd.DataFrame:
        found = [locate_of(query, x, mode) if x is not None else None for x in s]
        kept = [f if f is not None and f[0] <= max_distance else (None, None, None) for f in found]
        return pd.DataFrame(kept, columns=["distance", "start", "end"], dtype=object)

    return run(_col(ref))


def best_barcode(text: str | Column, panel: dict[str, str], max_distance: int) -> Column:
    """struct(barcode, distance, delta): the nearest of a fixed panel, and by how much the next is further; null beyond the limit.

    Ties go by name. Distances to the whole panel are computed in the JVM.
    """
    c = _col(text)
    scores = F.array_sort(F.array(*[F.struct(F.levenshtein(c, F.lit(s)).alias("d"), F.lit(n).alias("n")) for n, s in sorted(panel.items())]))
    first, second = scores[0], F.try_element_at(scores, F.lit(2))
    return F.when(first["d"] <= max_distance, F.struct(first["n"].alias("barcode"), first["d"].alias("distance"), (second["d"] - first["d"]).alias("delta")))


def kmer_runs(seq: str | Column, kmer: str, min_count: int = 2) -> Column:
    """Runs of a repeated k-mer, as an array of texts."""
    return F.regexp_extract_all(_col(seq), F.lit(f"((?:{re.escape(kmer)}){{{min_count},}})"), F.lit(1))


def poly_a_of(seq: str, query: int = 10, min_length: int = 15, max_length: int = 300, edge: int = 5) -> tuple[int, int] | None:
    """Last run of poly-A: exact A stretches of the query's length, merged over gaps of up to ``edge``, of a length within the limits."""
    runs: list[list[int]] = []
    for m in re.finditer(f"A{{{query},}}", seq):
        if runs and m.start() <= runs[-1][1] + 1 + edge:
            runs[-1][1] = m.end()
        else:
            runs.append([m.start(), m.end()])
    good = [r for r in runs if min_length <= r[1] - r[0] <= max_length]
    return tuple(good[-1]) if good else None


def read_status(primer5: Column, primer3: Column, barcode: Column) -> Column:
    """Status of a read from what was found in it."""
    a, b, c = (F.coalesce(x, F.lit(False)) for x in (primer5, primer3, barcode))
    return F.when(a & b & c, "Complete").when(b & c, "3' Only").when(a & b, "Missing Barcode").when(a, "5' Only").otherwise("Unknown")


def pick_orientation(forward: Column, reverse: Column) -> Column:
    """``+`` or ``-`` and whether the read is complex, from the status in both orientations, as a struct."""
    one = lambda o, x: F.struct(F.lit(o).alias("strand"), F.lit(x).alias("complex"))
    return (
        F.when(reverse == "Unknown", one("+", False))
        .when(forward == "Unknown", one("-", False))
        .when((forward == "Complete") & (reverse != "Complete"), one("+", False))
        .when((reverse == "Complete") & (forward != "Complete"), one("-", False))
        .otherwise(one("+", True))
    )


def decode_phred(quality: str | Column) -> Column:
    """Quality scores of an ASCII string, offset 33."""
    return F.transform(F.filter(F.split(_col(quality), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def mean_quality(quality: str | Column) -> Column:
    """Quality of the mean error probability."""
    q = decode_phred(quality)
    p = F.aggregate(q, F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), -x / 10.0))
    return F.when(F.size(q) > 0, -10 * F.log10(p / F.size(q)))
