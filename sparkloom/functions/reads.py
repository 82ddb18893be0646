"""Demultiplexing of reads and classification of novel peptides."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.sequence import best_orf, digest_of, edit_distance, ends_of, places_of, poly_a_of

#: Classes of novel peptides, the most specific first.
CLASSES = ("snp", "insertion", "deletion", "complex", "n_terminal_truncation", "c_terminal_truncation", "trypsin_cutsite_mutation", "n_term_deviation", "c_term_deviation", "unknown", "non_reference")


def _nearest(texts: list[str], panel: dict[str, str], max_barcode: int) -> list[str | None]:
    """The barcode with the least distance within each text, by name on a tie; None beyond the limit."""
    best, found = [max_barcode + 1] * len(texts), [None] * len(texts)
    for name in sorted(panel):
        for i, d in enumerate(ends_of(panel[name], texts)[0].tolist()):
            if d < best[i]:
                best[i], found[i] = d, name
    return found


def _segments(texts: list[str], adapter5: str, primer3: str, panel: dict[str, str], max_distance: int, max_barcode: int, poly_a: dict[str, int], seen: dict[str, str | None]) -> list[tuple[int, int, str | None, str]]:
    """Start, end, barcode and status of each text in its own direction: the adapter lies anywhere before poly-A, primer and barcode behind it."""
    tails = [poly_a_of(q, **poly_a) for q in texts]
    behind = [q[t[1] :] if t else "" for q, t in zip(texts, tails)]
    distance, five = ends_of(adapter5, [q[: t[0]] if t else q for q, t in zip(texts, tails)])
    primer, at, _ = places_of(primer3, behind, max_distance)
    umis = [q[:k] if k > 0 else "" for q, k in zip(behind, at.tolist())]
    new = list({u for u in umis if u and u not in seen})
    seen.update(zip(new, _nearest(new, panel, max_barcode)))
    out = []
    for q, tail, has5, end5, has3, umi in zip(texts, tails, (distance <= max_distance).tolist(), five.tolist(), (primer <= max_distance).tolist(), umis):
        name = seen[umi] if umi else None
        status = "Complete" if has5 and has3 and name else "3' Only" if has3 and name else "Missing Barcode" if has5 and has3 else "5' Only" if has5 else "Unknown"
        out.append((end5 if has5 else 0, tail[0] if tail else len(q), name, status))
    return out


def demultiplex(reads: DataFrame, *, adapter5: str, primer3: str, barcodes: dict[str, str], max_distance: int = 3, max_barcode: int = 2, min_transcript: int = 100, poly_a: dict[str, int] | None = None) -> DataFrame:
    """Orientation, transcript span, barcode and status of each read (read_id, sequence): adapters, poly-A and barcode in both directions.

    The whole sequence before poly-A is searched for the adapter. ``poly_a``: limits of the run (query, min_length, max_length, edge).
    The reads of an Arrow batch are searched at once, and a barcode is scored once for each different text before the primer.

    The direction with the better status is taken; if both or neither are complete, forward, as complex. ``fragment`` marks short transcripts.
    """
    turn = str.maketrans("ACGTN", "TGCAN")

    def run(batches):
        seen: dict[str, str | None] = {}
        for part in batches:
            rows = []
            if len(seen) > 100_000:
                seen.clear()
            texts = {"+": part["sequence"].tolist()}
            texts["-"] = [q.translate(turn)[::-1] for q in texts["+"]]
            found = {s: _segments(x, adapter5, primer3, barcodes, max_distance, max_barcode, poly_a or {}, seen) for s, x in texts.items()}
            for k, read in enumerate(part["read_id"]):
                f, r = found["+"][k][3], found["-"][k][3]
                strand, odd = ("+", False) if r == "Unknown" else ("-", False) if f == "Unknown" else ("+", False) if f == "Complete" != r else ("-", False) if r == "Complete" != f else ("+", True)
                start, end, name, status = found[strand][k]
                rows.append((read, strand, odd, status, name, start, end, end - start < min_transcript, texts[strand][k][start:end]))
            yield pd.DataFrame(rows, columns=["read_id", "strand", "is_complex", "status", "barcode", "start", "end", "fragment", "transcript"])

    schema = f"read_id {reads.schema['read_id'].dataType.simpleString()}, strand string, is_complex boolean, status string, barcode string, start int, end int, fragment boolean, transcript string"
    return reads.select("read_id", F.upper("sequence").alias("sequence")).where("sequence IS NOT NULL").mapInPandas(run, schema)


def predict_orfs(demuxed: DataFrame, *, statuses: tuple[str, ...] = ("Complete",), min_length: int = 30) -> DataFrame:
    """Best open reading frame of each read of an eligible status: read_id, protein, and where it lies."""
    found = demuxed.where(F.col("status").isin(*statuses)).select("read_id", best_orf("transcript", min_length=min_length, both_strands=False).alias("o"))
    return found.where("o IS NOT NULL").select("read_id", F.col("o.protein").alias("protein"), F.col("o.start").alias("start"), F.col("o.end").alias("end"))


def classify_peptide_of(peptide: str, protein: str | None, reference: str | None, qstart: int, tstart: int, cigar: str | None) -> str:
    """How a peptide of a novel protein differs from the aligned reference protein; coordinates from 1, inclusive."""
    if reference is None or cigar is None:
        return "non_reference"
    at = protein.find(peptide) if protein else -1
    if at < 0:
        return "unknown"
    first, last = at + 1, at + len(peptide)
    q, t, events, begin, stop = qstart, tstart, [], None, None
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MID=X])", cigar)):
        for _ in range(n):
            if op in "M=X":
                if first <= q <= last:
                    begin, stop = (q if begin is None else begin), q
                    if t <= len(reference) and protein[q - 1] != reference[t - 1]:
                        events.append("snp")
                q, t = q + 1, t + 1
            elif op == "I":
                if first <= q <= last:
                    begin, stop = (q if begin is None else begin), q
                    events.append("insertion")
                q += 1
            else:
                if first < q <= last:
                    events.append("deletion")
                t += 1
    if begin is None or begin > first:
        return "n_term_deviation"
    if stop < last:
        return "c_term_deviation"
    kinds = set(events)
    if len(kinds) > 1:
        return "complex"
    if kinds:
        return kinds.pop()
    if peptide in reference:
        own = {p for _, _, p in digest_of(reference)}
        if peptide not in own:
            r = reference.find(peptide)
            if at == 0 and r > 0:
                return "n_terminal_truncation"
            if at + len(peptide) == len(protein) and r + len(peptide) < len(reference):
                return "c_terminal_truncation"
            return "trypsin_cutsite_mutation"
    return "unknown"


def classify_peptides(rows: DataFrame) -> DataFrame:
    """Adds ``class`` to rows of peptide, protein_seq, reference_seq, qstart, tstart, cigar."""

    @F.pandas_udf("string")
    def run(p: pd.Series, q: pd.Series, r: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([classify_peptide_of(x, y, z, int(s) if s == s and s is not None else 1, int(t) if t == t and t is not None else 1, g) for x, y, z, s, t, g in zip(p, q, r, a, b, c)])

    return rows.withColumn("class", run("peptide", "protein_seq", "reference_seq", "qstart", "tstart", "cigar"))


def prefer_class(rows: DataFrame, peptide: str = "peptide", abundance: str = "abundance") -> DataFrame:
    """One row per peptide: the first class of CLASSES, then the greatest abundance, then the least protein id."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("class"))
    rest = [c for c in rows.columns if c != peptide]
    best = rows.groupBy(peptide).agg(F.min_by(F.struct(*rest), F.struct(rank.alias("r"), (-F.col(abundance)).alias("a"), F.col("protein_id"))).alias("m"))
    return best.select(peptide, *[F.col(f"m.{c}").alias(c) for c in rest])


def nearest_in_panel(df: DataFrame, text: str, panel: DataFrame, name: str, target: str, max_distance: int) -> DataFrame:
    """Nearest panel entry of each different text, with the distance and how much further the next is; texts without one keep nulls.

    The panel is a short list: it goes to every task, after a check of its length.
    """
    if panel.count() > 5000:
        raise ValueError("a panel is a short list")
    one = panel.agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("n"), F.col(target).alias("t")))).alias("_p"))
    scored = df.select(text).distinct().join(F.broadcast(one)).withColumn("_s", F.array_sort(F.transform("_p", lambda p: F.struct(edit_distance(p["t"], F.col(text)).alias("d"), p["n"].alias("n")))))
    first, second = F.try_element_at("_s", F.lit(1)), F.try_element_at("_s", F.lit(2))
    near = scored.where(first["d"] <= max_distance).select(text, first["n"].alias(name), first["d"].alias("distance"), (second["d"] - first["d"]).alias("delta"))
    return df.join(near, text, "left")
