"""Find pages of repeated keywords, lists of links, menus or product rows instead of sentences."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.columns import require
from sparkloom.session import cut_lineage

#: Pages with fewer words have no curve of their own.
LEAST_WORDS = 16
#: A page is extreme if its slope is so many spreads steeper, or its residual or divergence so many spreads larger, than that of
#: same-language pages of comparable length; a diverging page only if it has fewer different words than these.
EXTREME = 6.0
#: A page is flagged if its slope, residual, divergence or share of plain words is so many spreads off, on either side.
FLAGGED = 2.5
#: Pages of comparable length are of one half octave; very short and very long ones, of which there are fewer, are held
#: against those of the nearest half octave that has PEERS pages of the language.
PEERS = 30
#: Plain words of a language are those that at least this share of its pages has, so there are at most as many as an average page
#: has different words, divided by it. A language is a label that at least LABELLED of all labelled pages bear.
PLAIN, LABELLED = 0.25, 0.002
#: A word's divergence is the log of its page rate in extreme pages over that in same-language prose, between these limits. The
#: rate in extreme pages of the language is drawn to that in all languages as by so many pages more.
WORD_LIMITS, DRAWN = (-2.0, 3.0), 20.0
#: A word belongs to such matter if the mean divergence of the words around it, NEAR on either side, exceeds FLAG.
NEAR, FLAG = 4, 0.7

_MARKS = re.compile(r"[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")
_SPACED = re.compile(r"(?<!\S)\w(?: \w){3,}(?!\w)")
_DIGITS = re.compile(r"[0-9]+")


def _joined(letters: str) -> str:
    """The word that a run of single letters spells; of a word that is repeated, the word."""
    for p in range(3, len(letters) // 2 + 1):
        if letters[p:] == letters[:-p]:
            return letters[:p]
    return letters


def tokens(text: str | None) -> list[str]:
    """Words of a page, split at blanks and line ends, in lower case and without accents.

    Of a word printed with spaces between its letters each letter counts as a word, and stands for the whole word.
    """
    if not text:
        return []
    plain = _MARKS.sub("", unicodedata.normalize("NFKD", text.lower()))
    if _SPACED.search(plain):
        plain = _SPACED.sub(lambda m: " ".join([_joined(m[0].replace(" ", ""))] * (len(m[0]) // 2 + 1)), plain)
    return plain.split()


def parts(token: str) -> tuple[str, ...]:
    """Compared words within a token: digits become #, a tag keeps its <."""
    out = [_DIGITS.sub("#", w) for w in _WORD.findall(token)]
    if out and token[0] == "<":
        out[0] = "<" + out[0]
    return tuple(out)


class _Memo(dict):
    """Values by token, computed once; emptied when it grows large."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, token: str):
        if len(self) > 500_000:
            self.clear()
        value = self[token] = self.make(token)
        return value


def _pages(documents: DataFrame, doc_id: str, text: str, lang: str | None) -> DataFrame:
    """Word counts of each page, numbers left out: ``_row``, ``_doc``, ``_h``, ``label``, ``n_tokens``, ``words``, ``counts``. One read of the texts.

    ``_h`` is equal for equal texts.
    """
    label = F.lower(F.trim(F.col(f"`{lang}`").cast("string"))) if lang else F.lit(None).cast("string")
    rows = documents.select(F.col(f"`{doc_id}`").alias("_doc"), F.unhex(F.sha2(F.col(f"`{text}`"), 256)).alias("_h"), label.alias("label"), F.col(f"`{text}`").alias("_t")).where("_doc is not null and _t is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Memo(lambda t: tuple(w for w in parts(t) if w != "#"))
        for df in batches:
            n, words, counts = [], [], []
            for text in df["_t"]:
                t = tokens(text)
                c: Counter = Counter()
                for x in t:
                    c.update(memo[x])
                n.append(len(t))
                words.append(list(c))
                counts.append(list(c.values()))
            yield pd.DataFrame({"_doc": df["_doc"], "_h": df["_h"], "label": df["label"], "n_tokens": n, "words": words, "counts": counts})

    kind = rows.schema["_doc"].dataType.simpleString()
    counted = rows.mapInPandas(count, f"_doc {kind}, _h binary, label string, n_tokens int, words array<string>, counts array<int>")
    return cut_lineage(counted.withColumn("_row", F.monotonically_increasing_id()))


def _once(pages: DataFrame) -> DataFrame:
    """One page of each text: of copies only the first stays. Only keys are shuffled where copies are few."""
    keys = pages.select("_row", "_h")
    first = keys.groupBy("_h").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    copies = cut_lineage(keys.join(first, "_h").where("_row <> _first").select("_row"))
    return pages.join(copies, "_row", "left_anti")


def _languages(once: DataFrame) -> DataFrame:
    """Language of each page and share of its words that are plain ones of it: ``_row``, ``lang``, ``plain``.

    A language's plain words come from the pages that bear its label. A page's own label may be wrong: it gets the language
    whose plain words it has, each counting by how much more frequent it is there than elsewhere. Without any, or without
    labels, it is ``none``; its share then is that of words that are plain in any language.
    """
    labels = once.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy())).where(F.col("n") >= F.col("all") * LABELLED)
    labels = {r["label"]: r["n"] for r in labels.collect()}  # at most 1 / LABELLED
    spoken = once.where(F.col("label").isin(list(labels))) if labels else once.withColumn("label", F.lit("none"))
    totals = labels or {"none": once.count()}
    rate = F.col("n") / F.element_at(F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(float(max(v, 1))))]), F.col("label"))
    # every plain word of one label with its rate in the others, from 0.01 on
    rates = spoken.select("label", F.explode("words").alias("word")).groupBy("label", "word").agg(F.count(F.lit(1)).alias("n")).select("word", F.struct("label", rate.alias("r")).alias("x"))
    listed = rates.groupBy("word").agg(F.collect_list("x").alias("x")).where(F.exists("x", lambda x: x["r"] >= PLAIN)).collect()
    plain: dict[str, dict[str, float]] = {}
    for r in listed:
        by = {x["label"]: x["r"] for x in r["x"]}
        mean = sum(by.values()) / len(totals)
        plain[r["word"]] = {k: math.log((by.get(k, 0.0) + 0.01) / (mean + 0.01)) for k in totals} | {f"={k}": 1.0 for k, v in by.items() if v >= PLAIN}
    sent = once.sparkSession.sparkContext.broadcast((sorted(labels), plain))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, known = sent.value
        for df in batches:
            langs, shares = [], []
            for words, counts in zip(df["words"], df["counts"]):
                have = [(known[w], n) for w, n in zip(words, counts) if w in known]
                votes = {k: sum(v[k] for v, _ in have) for k in names}
                best = max(votes, key=votes.get) if have and names else "none"
                if best != "none" and votes[best] <= 0:
                    best = "none"
                mine = f"={best}"
                langs.append(best)
                shares.append(sum(n for v, n in have if best == "none" or mine in v) / max(int(sum(counts)), 1))
            yield pd.DataFrame({"_row": df["_row"], "lang": langs, "plain": shares})

    return once.select("_row", "words", "counts").mapInPandas(judge, "_row long, lang string, plain double")


def _curves(once: DataFrame) -> DataFrame:
    """Curves of different pages with their z values: ``_row``, ``lang``, ``n_words`` and what ``page_curves`` tells."""
    langs = cut_lineage(_languages(once))
    words = once.select("_row", F.explode("counts").alias("n"))
    ranked = words.withColumn("k", F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("n"))))
    ranked = ranked.withColumn("x", F.ln("k")).withColumn("y", F.ln("n")).withColumn("class", F.floor(4 * F.log2("k")).cast("int"))
    sums = ranked.groupBy("_row", "class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    # at most 4 classes for each octave of ranks
    page = sums.groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("n", "v", "x", "y", "xx", "xy", "yy")], F.map_from_entries(F.collect_list(F.struct("class", F.col("n").alias("m")))).alias("mass")).where(F.col("n") >= LEAST_WORDS)
    var = lambda a, b, ab: F.col(ab) / F.col("v") - F.col(a) * F.col(b) / F.col("v") / F.col("v")
    vx, vy, c = F.greatest(var("x", "x", "xx"), F.lit(0.0)), var("y", "y", "yy"), var("x", "y", "xy")
    # a page of one word has no slope: as steep as it gets
    slope = F.when(vx > 0, c / vx).otherwise(F.lit(-10.0))
    residual = F.when(vx > 0, F.sqrt(F.greatest(F.lit(0.0), vy - c * c / vx))).otherwise(F.lit(0.0))
    share = F.transform_values("mass", lambda _, m: m / F.col("n"))
    curves = page.select("_row", F.col("n").alias("n_words"), F.col("v").alias("n_different"), slope.alias("slope"), residual.alias("residual"), share.alias("share"), F.floor(2 * F.log2("n")).alias("size"))
    curves = cut_lineage(curves.join(langs, "_row"))
    ends: dict[str, list[int]] = {}  # half octaves with enough pages; there are a few for each language
    for r in curves.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PEERS).collect():
        ends.setdefault(r["lang"], []).append(r["size"])
    size = F.col("size")
    clamped = F.lit(0).cast("long")  # where no half octave has enough, all lengths together
    for lang, sizes in ends.items():
        clamped = F.when(F.col("lang") == lang, F.greatest(F.lit(min(sizes)), F.least(F.lit(max(sizes)), size))).otherwise(clamped)
    every = [x for lang, sizes in ends.items() for x in sizes]
    if every:
        clamped = F.when(F.col("lang") == "none", F.greatest(F.lit(min(every)), F.least(F.lit(max(every)), size))).otherwise(clamped)
    curves = curves.withColumn("size", clamped.cast("long"))

    def peers(every: DataFrame, make) -> DataFrame:
        """One row for each language and half octave, and for pages of no language one over all."""
        return make(every.where("lang <> 'none'"), F.col("lang")).unionByName(make(every.drop("lang").withColumn("lang", F.lit("none")), F.col("lang")))

    pages = peers(curves, lambda d, lang: d.groupBy(lang, "size").agg(F.count(F.lit(1)).alias("pages")))
    mean = peers(curves, lambda d, lang: d.select(lang, "size", F.explode("share").alias("class", "p")).groupBy("lang", "size", "class").agg(F.sum("p").alias("p")))
    usual = mean.join(F.broadcast(pages), ["lang", "size"]).groupBy("lang", "size").agg(F.map_from_entries(F.collect_list(F.struct("class", F.col("p") / F.col("pages")))).alias("usual"))
    terms = F.transform(F.map_entries("share"), lambda e: e["value"] * F.ln(e["value"] / F.greatest(F.coalesce(F.try_element_at("usual", e["key"]), F.lit(0.0)), F.lit(1e-6))))
    curves = cut_lineage(curves.join(F.broadcast(usual), ["lang", "size"]).withColumn("divergence", F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)).drop("share", "usual"))
    middle = lambda c: F.percentile_approx(c, 0.5, 1000)

    def against(every: DataFrame, measures: tuple[str, ...], keys: list[str]) -> DataFrame:
        """z values of measures among the pages with equal keys, ``lang`` and others."""
        norms = cut_lineage(peers(every, lambda d, lang: d.groupBy(lang, *keys[1:]).agg(*[middle(m).alias(f"_{m}") for m in measures], middle("n_different").alias("_different"))))
        off = lambda d, lang: d.withColumn("lang", lang).join(F.broadcast(norms), keys)
        spreads = peers(every, lambda d, lang: off(d, lang).groupBy(*keys).agg(*[middle(F.abs(F.col(m) - F.col(f"_{m}"))).alias(f"_{m}_off") for m in measures]))
        z = lambda m: ((F.col(m) - F.col(f"_{m}")) / (1.4826 * F.col(f"_{m}_off") + 0.01)).alias(f"{m}_z")
        return every.join(F.broadcast(norms), keys).join(F.broadcast(spreads), keys).select(*every.columns, *[z(m) for m in measures], (F.col("n_different") < F.col("_different")).alias("few"))

    measures = ("slope", "residual", "divergence")
    # the share of plain words doesn't depend on a page's length
    held = against(against(curves, ("plain",), ["lang"]).drop("few"), measures, ["lang", "size"])
    return held.select("_row", "lang", "n_words", "n_different", *measures, "plain", *[f"{m}_z" for m in (*measures, "plain")], "few")


def page_curves(documents: DataFrame, doc_id: str, text: str = "text", lang: str | None = None) -> DataFrame:
    """Rank-frequency curve of each page: ``_id``, ``lang``, ``n_words``, ``n_different``, ``slope``, ``residual``, ``divergence``, ``plain`` and their z values.

    ln frequency is fitted to ln rank over the words of a page. The divergence (Kullback-Leibler) holds the page's share of
    words per rank, in classes of a quarter octave, against the mean of pages of the same language and comparable length, half
    an octave; ``plain`` is the share of words that a quarter of same-language pages has, held against pages of all lengths. The z values hold each against the
    median and spread (median distance from the median, which less than half of the pages cannot carry away) of these pages.
    Languages are learnt from the labels in the column ``lang``, which may be wrong in places; pages without plain words,
    or without such a column, are of ``lang`` none and held against pages of all languages. ``few`` tells whether a page has fewer
    different words than the median page. A text counts once in means, medians and spreads, however many copies it has, and
    each copy gets its values.
    """
    pages = _pages(documents, doc_id, text, lang)
    once = _once(pages)
    held = _curves(once).join(once.select("_row", "_h"), "_row").drop("_row")
    return pages.select("_doc", "_h").distinct().join(held, "_h").drop("_h").withColumnRenamed("_doc", "_id").select("_id", *[c for c in held.columns if c != "_h"])


def _divergences(once: DataFrame, judged: DataFrame) -> DataFrame:
    """Divergence of each word that extreme pages have, in each language: ``lang``, ``word``, ``w``.

    ``judged``: ``_row``, ``lang`` and whether the page is ``extreme``. Languages are a short list (1 / LABELLED, and none).
    """
    words = once.select("_row", "words").join(judged, "_row").select("lang", "seed", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.sum("seed").alias("seeds"), F.sum(1 - F.col("seed")).alias("prose"))
    words = cut_lineage(words)
    size = judged.groupBy("lang").agg(F.sum("seed").alias("n_seeds"), F.sum(1 - F.col("seed")).alias("n_prose"))
    all_size = size.agg(F.sum("n_seeds").alias("all_seeds"), F.sum("n_prose").alias("all_prose"))
    known = words.groupBy("word").agg(F.sum("seeds").alias("seeds_of_all"), F.sum("prose").alias("prose_of_all")).where("seeds_of_all > 0")
    # pages of no language are held against all
    sizes = size.crossJoin(F.broadcast(all_size)).withColumn("n_prose", F.when(F.col("lang") == "none", F.col("all_prose")).otherwise(F.col("n_prose")))
    each = known.crossJoin(F.broadcast(sizes)).join(words, ["lang", "word"], "left").na.fill(0, subset=["seeds", "prose"])
    prose = F.when(F.col("lang") == "none", F.col("prose_of_all")).otherwise(F.col("prose"))
    pooled = (F.col("seeds_of_all") + 0.5) / (F.col("all_seeds") + 1)
    rate = (F.col("seeds") + DRAWN * pooled) / (F.col("n_seeds") + DRAWN)
    low, high = WORD_LIMITS
    return each.select("lang", "word", F.greatest(F.lit(low), F.least(F.lit(high), F.ln(rate) - F.ln((prose + 0.5) / (F.col("n_prose") + 1)))).alias("w"))


def _flagged_shares(texts: DataFrame, flagged: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of the words of each flagged page that lie in diverging matter: ``_row``, ``share``.

    ``texts``: ``_doc``, ``_h``, ``_t``. ``flagged``: ``_row``, ``_doc``, ``_h``, ``lang``, ``words``. Different words of flagged pages meet the
    divergences; each page then gets those of its own words.
    """
    own = flagged.select("_row", "lang", F.explode("words").alias("word")).join(weights, ["lang", "word"]).groupBy("_row").agg(F.collect_list("word").alias("have"), F.collect_list("w").alias("w"))
    rows = texts.join(flagged.select("_row", "_doc", "_h"), ["_doc", "_h"]).select("_row", "_t").join(own, "_row", "left")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Memo(lambda t: [w for w in parts(t) if w != "#"])
        around = np.ones(2 * NEAR + 1)
        for df in batches:
            shares = []
            for text, have, w in zip(df["_t"], df["have"], df["w"]):
                get = {} if have is None else dict(zip(have, w))
                # NaN: nothing to compare, as in marks that separate
                w = np.array([max(get.get(x, 0.0) for x in own) if own else math.nan for own in map(memo.__getitem__, tokens(text))])
                seen = ~np.isnan(w)
                total = np.convolve(np.where(seen, w, 0.0), around)[NEAR : NEAR + len(w)]
                n = np.convolve(seen.astype(float), around)[NEAR : NEAR + len(w)]
                shares.append(float((total > FLAG * np.maximum(n, 1.0)).mean()))
            yield pd.DataFrame({"_row": df["_row"], "share": shares})

    return rows.mapInPandas(score, "_row long, share double")


def spam_pages(documents: DataFrame, doc_id: str, text: str = "text", lang: str | None = None) -> DataFrame:
    """Share of each page's words that is keyword matter: ``doc_id``, ``n_words``, ``share``.

    Rank-frequency curves flag pages whose slope, residual, divergence or share of plain words is off among same-language
    pages of comparable length; pages too short for a curve are flagged too. An exact check of the flagged pages follows:
    a word's divergence compares its page rate in extreme pages with that in same-language prose, and a stretch
    of a page is such matter if its words diverge. Statistics cover all different texts; texts are read once for the curves
    and once for the flagged pages.

    Null texts, and rows with a null id, have no row; pages that no curve flags, and blank ones, have a share of 0. Without
    extreme pages (as in an empty or very small table) every share is 0. Of repeated rows with one id the largest share
    counts. Other columns are ignored.
    """
    require(documents, doc_id, text, *([lang] if lang else []))
    pages = _pages(documents, doc_id, text, lang)
    once = _once(pages)
    curves = cut_lineage(_curves(once))
    extreme = (F.col("slope_z") < -EXTREME) | (F.col("residual_z") > EXTREME) | ((F.col("divergence_z") > EXTREME) & F.col("few"))
    off = F.greatest(*[F.abs(F.col(f"{m}_z")) for m in ("slope", "residual", "divergence", "plain")]) > FLAGGED
    weights = _divergences(once, curves.select("_row", "lang", extreme.cast("long").alias("seed")))
    short = once.select("_row", "n_tokens").join(curves.select("_row"), "_row", "left_anti").where("n_tokens > 0").select("_row", F.lit("none").alias("lang"))
    # written first, so that the join knows how few they are and doesn't shuffle all pages for them
    marks = cut_lineage(curves.where(off).select("_row", "lang").unionByName(short))
    flagged = once.join(marks, "_row").select("_row", "_doc", "_h", "lang", "words")
    texts = documents.select(F.col(f"`{doc_id}`").alias("_doc"), F.unhex(F.sha2(F.col(f"`{text}`"), 256)).alias("_h"), F.col(f"`{text}`").alias("_t"))
    # of copies one was flagged; each gets its share
    checked = _flagged_shares(texts, flagged, weights).where("share > 0").join(once.select("_row", "_h"), "_row").select("_h", "share").distinct()
    shares = pages.select("_doc", "_h", "n_tokens").join(checked, "_h", "left")
    return shares.groupBy("_doc").agg(F.max("n_tokens").alias("n_words"), F.coalesce(F.max("share"), F.lit(0.0)).alias("share")).withColumnRenamed("_doc", doc_id)
