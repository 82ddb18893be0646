"""Find documents that hold passages of evaluation items."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.columns import require

#: Words of one pattern, and of one block of the shift table.
PATTERN, BLOCK = 3, 2
#: A passage of at least so many words of an item, of which at most one in ONE_IN may differ.
LEAST_WORDS, ONE_IN = 24, 8
#: Words put in between are free where the stretches of equal words on both sides speak for themselves: 32 of them between two
#: stretches of at least 12 words (2 to the power of 12 - FREE), twice as many for each word more, without an end. Short stock
#: phrases follow each other by chance, long ones don't. Beyond that SLACK words may stand at one place, in all no more
#: than the passage.
FREE, SLACK = 7, 20
#: COVERED words within LEAST_WORDS words of an item must lie in patterns that a document has, before the passage is aligned.
#: 24 words in seven pieces of three, as of 3 altered words and 3 insertions, have 21; a piece of one or two words has none.
COVERED = 15
#: These patterns lie within BAND words of shift, of which half is safe. Beyond that, stretches of one shift, in which
#: no more than one word in a row differs, count: with at least LONG words each, and FAR within LEAST_WORDS words of the item.
BAND, LONG, FAR = 64, 12, 20
#: Words of items that one index holds; more items are searched in several passes.
INDEX_WORDS = 2_000_000

#: A tag begins with a name, and holds nothing more or attributes; words between signs of less and greater are words.
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z_:-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"']+)))*\s*/?>|<!--.*?-->|\[/?(?:url|b|i|u|quote|img)\b[^\[\]]{0,300}\]")
_LINE_END_HYPHEN = re.compile(r"[-­‐‑][ \t]*\r?\n\s*")
_HIDDEN = re.compile(r"[­​-‏⁠﻿̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")
#: Letters that no decomposition turns into plain ones.
_ODD = re.compile("[æœøđłı]")
_PLAIN = str.maketrans({"æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i"})


def words(text: str | None) -> list[str]:
    """Compared words of a text: without mark-up, line-end hyphens, accents, letter case and punctuation."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    text = _LINE_END_HYPHEN.sub("", _TAG.sub(" ", text))
    if text.isascii():
        return _WORD.findall(text.lower())
    plain = _HIDDEN.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return _WORD.findall(plain.translate(_PLAIN) if _ODD.search(plain) else plain)


def build_index(items: list[tuple[object, str]]) -> dict:
    """Shift table and suffix buckets over all runs of PATTERN words of the items; plain arrays, to be broadcast.

    Item words are numbered from 1; any other word of a document is 0 and lets the search skip.
    """
    texts = [words(t) for _, t in items]
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in t], np.int64) for t in texts]
    width = len(vocabulary) + 1
    starts = [(k, p) for k, c in enumerate(coded) for p in range(len(c) - PATTERN + 1)]
    grams = np.array([coded[k][p : p + PATTERN] for k, p in starts], np.int64).reshape(-1, PATTERN)
    pairs = np.unique(np.concatenate([grams[:, j] * width + grams[:, j + 1] for j in range(PATTERN - 1)]) if len(grams) else np.zeros(0, np.int64))
    shift = np.full(len(pairs) + 1, PATTERN - BLOCK + 1, np.int8)  # the last is for blocks that no pattern has
    for j in range(PATTERN - 1):
        at = np.searchsorted(pairs, grams[:, j] * width + grams[:, j + 1])
        np.minimum.at(shift, at, PATTERN - BLOCK - j)
    prefix = np.searchsorted(pairs, grams[:, 0] * width + grams[:, 1]) if len(grams) else np.zeros(0, np.int64)
    suffix = np.searchsorted(pairs, grams[:, -2] * width + grams[:, -1]) if len(grams) else np.zeros(0, np.int64)
    key = suffix * len(pairs) + prefix
    order = np.argsort(key, kind="stable")
    patterns, first, count = np.unique(key[order], return_index=True, return_counts=True)
    where = np.array(starts, np.int64).reshape(-1, 2)[order]
    places: list[tuple[np.ndarray, np.ndarray]] = []  # blocks of each item in order, and where they stand
    masks: list[tuple[dict[int, int], dict[int, int]]] = []  # words that each block, and each word, of an item covers, as bits
    for c in coded:
        block = np.searchsorted(pairs, c[:-1] * width + c[1:]) if len(c) >= PATTERN else np.zeros(0, np.int64)
        own: dict[int, int] = {}
        for p, x in enumerate(block.tolist()):
            own[x] = own.get(x, 0) | 3 << p
        single: dict[int, int] = {}
        for p, x in enumerate(c.tolist()):
            single[x] = single.get(x, 0) | 1 << p
        at = np.argsort(block, kind="stable")
        places.append((block[at], at))
        masks.append((own, single))
    return {"ids": [i for i, _ in items], "vocabulary": vocabulary, "width": width, "pairs": pairs, "shift": shift, "patterns": patterns, "first": first, "count": count, "item": where[:, 0], "at": where[:, 1], "coded": coded, "places": places, "masks": masks}


def block_numbers(index: dict, codes: np.ndarray) -> np.ndarray:
    """Number of the block of two words that ends at each place; one more than all numbers where no item has it."""
    pairs = index["pairs"]
    block = np.full(len(codes), len(pairs), np.int64)
    known = np.flatnonzero((codes[1:] > 0) & (codes[:-1] > 0)) + 1
    if len(pairs) and len(known):
        value = codes[known - 1] * index["width"] + codes[known]
        at = np.minimum(np.searchsorted(pairs, value), len(pairs) - 1)
        block[known] = np.where(pairs[at] == value, at, len(pairs))
    return block


def scan(index: dict, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of patterns in a row of words, given by their blocks, and the patterns' numbers.

    Many places of the row are searched side by side. At each, the block before it tells how far to move on; where it
    tells 0, the bucket of that suffix is compared word by word.
    """
    pairs, shift = index["pairs"], index["shift"]
    none = np.zeros(0, np.int64)
    if len(block) < PATTERN or not len(pairs):
        return none, none
    lane = 64
    here = np.arange(PATTERN - 1, len(block), lane)
    end = np.minimum(here + lane, len(block))
    found = []
    while len(here):
        move = shift[block[here]]
        found.append(here[move == 0])
        here = here + np.maximum(move, 1)
        more = here < end
        here, end = here[more], end[more]
    hits = np.sort(np.concatenate(found))
    prefix = block[hits - (PATTERN - BLOCK)]
    hits, prefix = hits[prefix < len(pairs)], prefix[prefix < len(pairs)]
    key = block[hits] * len(pairs) + prefix
    bucket = np.minimum(np.searchsorted(index["patterns"], key), len(index["patterns"]) - 1)
    same = index["patterns"][bucket] == key
    return hits[same] - (PATTERN - 1), bucket[same]


def _mask(own: dict[int, int], found: np.ndarray) -> int:
    """Words of an item that any of the blocks, or words, covers, as bits."""
    mask = 0
    for x in own.keys() & set(found.tolist()):
        mask |= own[x]
    return mask


def _within(mask: int, least: int) -> bool:
    """Whether some LEAST_WORDS bits in a row hold ``least`` ones."""
    if mask.bit_count() < least:
        return False
    window = (1 << LEAST_WORDS) - 1
    mask >>= (mask & -mask).bit_length() - 1
    while mask:
        if (mask & window).bit_count() >= least:
            return True
        mask >>= 1
        mask >>= (mask & -mask).bit_length() - 1 if mask else 0
    return False


def _runs(index: dict, item: int, block: np.ndarray) -> tuple[list[int], list[int], list[int], list[float]]:
    """Runs of at least two equal words: start in the item, start in the document, words, and how many words may be put in at either end.

    A stretch is of runs of one shift with single words between them. In order of the document.
    """
    own, at = index["places"][item]
    lo = own.searchsorted(block)
    n = own.searchsorted(block, side="right") - lo
    have = np.flatnonzero(n)
    lo, n = lo[have], n[have]
    j = np.repeat(have - 1, n)
    p = at[np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    order = np.argsort((j - p) * (1 << 32) + j)
    p, j = p[order], j[order]
    turn = j - p
    new = np.ones(len(p), bool)
    new[1:] = (turn[1:] != turn[:-1]) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(p))) + 1
    p, j, turn = p[first], j[first], turn[first]
    new = np.ones(len(p), bool)
    new[1:] = (turn[1:] != turn[:-1]) | (j[1:] - j[:-1] - n[:-1] > 1)
    stretch = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(j)) - 1
    free = np.exp2(np.minimum(j[last] + n[last] - j[first], 60) - FREE)[stretch]
    order = np.argsort(j * (1 << 24) + p)
    return p[order].tolist(), j[order].tolist(), n[order].tolist(), free[order].tolist()


def _singles(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of equal words in order in two short lists, as many as possible."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a) - 1, -1, -1):
        for y in range(len(b) - 1, -1, -1):
            best[x][y] = best[x + 1][y + 1] + 1 if a[x] == b[y] else max(best[x + 1][y], best[x][y + 1])
    out, x, y = [], 0, 0
    while x < len(a) and y < len(b):
        if a[x] == b[y]:
            out.append((x, y))
            x, y = x + 1, y + 1
        elif best[x + 1][y] >= best[x][y + 1]:
            x += 1
        else:
            y += 1
    return out


def _judge(own: list[int], words_: list[int], same: list[tuple[int, int, int]], best: tuple[int, int]) -> tuple[int, int]:
    """The longest passage of a chain of equal words that is longer than ``best``, with single equal words put in.

    ``same``: place in the item, in the document, and words put in before it that are not free.
    """
    full: list[tuple[int, int, int]] = []
    p, j, _ = same[0]
    for x in range(min(p, j, LEAST_WORDS), 1, -1):
        if own[p - x] == words_[j - x]:
            full.append((p - x, j - x, 0))
    for q, k, slack in same:
        if full and q - full[-1][0] > 1 and k - full[-1][1] > 1:
            p, j, _ = full[-1]
            full += [(p + 1 + x, j + 1 + y, 0) for x, y in _singles(own[p + 1 : q], words_[j + 1 : min(k, j + 1 + LEAST_WORDS)])]
        full.append((q, k, slack))
    p, j, _ = full[-1]
    full += [(p + x, j + x, 0) for x in range(2, min(len(own) - p, len(words_) - j, LEAST_WORDS)) if own[p + x] == words_[j + x]]
    place = [p for p, _, _ in full]
    spent = list(accumulate(s for _, _, s in full))
    for a in range(len(full)):
        for b in range(len(full) - 1, a + max(best[0] * (ONE_IN - 1) // ONE_IN - 1, 0), -1):
            length = place[b] - place[a] + 1
            altered = length - (b - a + 1)
            if altered * ONE_IN <= length and length > best[0] and spent[b] - spent[a] <= length:
                best = (length, altered)
                break
    return best


def _best_passage(index: dict, item: int, codes: np.ndarray, block: np.ndarray) -> tuple[int, int]:
    """Length and altered words of the longest passage of the item that the words hold; (0, 0) if there is none.

    Runs of equal words are chained in order of both texts, so that as many words as possible are equal. A chain that holds
    no passage doesn't hide others: each run that no judged chain has is the end of another one.
    """
    ps, js, ns, free = _runs(index, item, block)
    own = index["coded"][item].tolist()
    least = LEAST_WORDS - LEAST_WORDS // ONE_IN
    most = len(own) // ONE_IN
    score, back, cut_at = [float(n) for n in ns], [-1] * len(ns), [0] * len(ns)
    # a run that begins further ahead can't be followed
    back_to = max([SLACK, *free]) + most + 2 * max(ns, default=0)
    for k, (p, j, n, f) in enumerate(zip(ps, js, ns, free)):
        top = score[k]
        for m in range(k - 1, -1, -1):
            if js[m] < j - back_to:
                break
            if score[m] + n <= top or ps[m] >= p:
                continue
            nm = ns[m]
            lost, between = p - ps[m] - nm, j - js[m] - nm
            if lost > most or js[m] >= j:
                continue
            cut = -lost if lost < between else -between
            if cut > 0:
                if cut >= n:
                    continue
                lost, between = lost + cut, between + cut
            else:
                cut = 0
            d = between - lost
            if d > SLACK and (d > f or d > free[m]):
                continue
            s = score[m] + n - cut - 0.001 * lost
            if s > top:
                top, back[k], cut_at[k] = s, m, cut
        score[k] = top
    best = (0, 0)
    judged: set[int] = set()
    words_ = None
    for k in sorted(range(len(ns)), key=score.__getitem__, reverse=True):
        if score[k] < COVERED:
            break
        if k in judged:
            continue
        same: list[tuple[int, int, int]] = []  # equal words: place in the item, in the document, words put in before it
        while k >= 0:
            judged.add(k)
            m = back[k]
            slack = 0
            if m >= 0:
                d = js[k] - js[m] - ps[k] + ps[m]
                slack = d if d > free[k] or d > free[m] else 0
            same[:0] = [(ps[k] + x, js[k] + x, slack if x == cut_at[k] else 0) for x in range(cut_at[k], ns[k])]
            k = m
        reach = [p for p, _, _ in same]
        # within LEAST_WORDS words of the item enough must be equal, or be single words between runs
        if not any(reach[x + COVERED - 1] - reach[x] < LEAST_WORDS for x in range(len(reach) - COVERED + 1)):
            continue
        if words_ is None:
            words_ = codes.tolist()
        best = _judge(own, words_, same, best)
    return best


def _in_order(*fields: np.ndarray) -> list[np.ndarray]:
    """Rows in order of fields of non-negative numbers; as one number each where that has room."""
    bits = [int(f.max()).bit_length() if len(f) else 0 for f in fields]
    if sum(bits) > 62:
        order = np.lexsort(fields[::-1])
        return [f[order] for f in fields]
    key = np.zeros(len(fields[0]), np.int64)
    for f, n in zip(fields, bits):
        key <<= n
        key |= f
    key.sort()
    out = []
    for n in reversed(bits):
        out.append(key & ((1 << n) - 1))
        key = key >> n
    return out[::-1]


def _covered(group: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Groups of which COVERED words within LEAST_WORDS are covered by patterns at ``a``; rows in order, numbers of groups from 0."""
    new = np.ones(len(a), bool)
    new[1:] = group[1:] != group[:-1]
    step = np.minimum(np.diff(a, prepend=a[:1]), PATTERN)
    step[new] = PATTERN
    held = np.cumsum(step)
    line = group * (1 << 24) + a
    last = np.searchsorted(line, line + (LEAST_WORDS - PATTERN), side="right") - 1
    return np.unique(group[held[last] - held + PATTERN >= COVERED])


def _candidates(pair: np.ndarray, at: np.ndarray, turn: np.ndarray) -> Iterator[tuple[int, int | None, int | None]]:
    """Pairs of document and item with enough patterns in place: pair, and first and last place in the document; None for all of it.

    ``at`` is the place in the item, ``turn`` that in the document less ``at``, moved so that none is negative.
    """
    spans: dict[int, tuple[int | None, int | None]] = {}
    # whatever their shift
    keep = np.zeros(int(pair.max()) + 1, bool)
    keep[_covered(*_in_order(pair, at))] = True
    keep = keep[pair]
    pair, at, turn = pair[keep], at[keep], turn[keep]
    if not len(pair):
        return iter(())
    for half in (0, BAND // 2):
        x, band, a, rest = _in_order(pair, (turn + half) // BAND, at, (turn + half) % BAND)
        new = np.ones(len(a), bool)
        new[1:] = (x[1:] != x[:-1]) | (band[1:] != band[:-1])
        group = np.cumsum(new) - 1
        start = np.append(np.flatnonzero(new), len(a))
        for g in _covered(group, a).tolist():
            lo, hi = start[g], start[g + 1]
            place = band[lo:hi] * BAND + rest[lo:hi] - half + a[lo:hi]
            k = int(x[lo])
            low, high = spans.get(k, (1 << 60, -1))
            spans[k] = min(low, int(place.min())), max(high, int(place.max()))
    # stretches of one shift, over single words that differ
    x, t, a = _in_order(pair, turn, at)
    new = np.ones(len(a), bool)
    new[1:] = (x[1:] != x[:-1]) | (t[1:] != t[:-1]) | (a[1:] - a[:-1] > PATTERN + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    words_ = a[last] - a[first] + PATTERN
    long = words_ >= LONG
    x, p, n = x[first[long]], a[first[long]], words_[long]
    several = np.isin(x, x[1:][x[1:] == x[:-1]])  # one stretch alone lies within a band
    x, p, n = x[several], p[several], n[several]
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(p, n)
    x, p = _in_order(np.repeat(x, n), place)
    once = np.ones(len(x), bool)
    once[1:] = (x[1:] != x[:-1]) | (p[1:] != p[:-1])
    x, p = x[once], p[once]
    near = (x[FAR - 1 :] == x[: -FAR + 1]) & (p[FAR - 1 :] - p[: -FAR + 1] < LEAST_WORDS)
    spans.update((k, (None, None)) for k in np.unique(x[: -FAR + 1][near]).tolist())
    return ((k, lo, hi) for k, (lo, hi) in spans.items())


def search(index: dict, texts: list[str | None]) -> list[tuple[int, object, int, int]]:
    """Passages in some texts: number of the text, item id, words of the passage, altered words among them."""
    get = index["vocabulary"].get
    coded = [[get(w, 0) for w in words(t)] for t in texts]
    gap = [0] * PATTERN
    flat: list[int] = []
    begin = np.zeros(len(coded), np.int64)
    for i, c in enumerate(coded):
        begin[i] = len(flat)
        flat += c
        flat += gap
    codes = np.array(flat, np.int64)
    block = block_numbers(index, codes)
    start, pattern = scan(index, block)
    if not len(start):
        return []
    n = index["count"][pattern]
    total = int(n.sum())
    row = np.repeat(np.arange(len(start)), n)
    post = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + index["first"][pattern][row]
    item, place = index["item"][post], start[row]
    doc = np.repeat(np.searchsorted(begin, start, side="right") - 1, n)
    pair = doc * len(index["ids"]) + item
    if len(coded) * len(index["ids"]) <= 1 << 24:
        # COVERED words need so many patterns
        enough = (np.bincount(pair) >= -(-COVERED // PATTERN))[pair]
        pair, doc, place, post = pair[enough], doc[enough], place[enough], post[enough]
    if not len(pair):
        return []
    at = index["at"][post]
    longest = max(len(c) for c in index["coded"])
    out = []
    least = LEAST_WORDS - LEAST_WORDS // ONE_IN
    for k, lo, hi in _candidates(pair, at, place - begin[doc] - at + longest):
        d, i = divmod(k, len(index["ids"]))
        end = begin[d] + len(coded[d])
        if lo is None:
            lo, hi = begin[d], end
        else:
            lo, hi = begin[d] + max(lo - longest - LEAST_WORDS, 0), min(begin[d] + hi - longest + PATTERN + LEAST_WORDS, end)
        runs, single = index["masks"][i]
        if not _within(_mask(runs, block[lo:hi]), COVERED + 1) or not _within(_mask(single, codes[lo:hi]), least):
            continue
        length, altered = _best_passage(index, i, codes[lo:hi], block[lo:hi])
        if length >= LEAST_WORDS:
            out.append((d, index["ids"][i], length, altered))
    return out


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text") -> DataFrame:
    """Documents that repeat a passage of an item: ``doc_id``, ``item_id``, ``words``, ``altered``.

    All runs of three words of the items are searched in every document at once, by shift tables over blocks of two words
    and suffix buckets. Where patterns of one item agree with a document, the words are aligned: a passage has at least
    24 words of the item in order, of which at most one in eight differs. Between them the document may hold other words,
    the more the longer the stretches of equal words on both sides are (FREE, SLACK). ``words`` is the longest passage's length.

    The item index goes to the executors. It is built over at most INDEX_WORDS words; more items are taken in several
    passes over the documents, so its size is bounded whatever the table's. Nothing is shuffled but the passages found.

    Null and empty texts hold nothing. Repeated rows of a document or item are reported once. Items of fewer than 24 words
    can't be found. Other columns are ignored. Empty tables give no rows.
    """
    require(documents, doc_id, text)
    require(items, item_id, text)
    if doc_id == item_id:
        raise ValueError("doc_id and item_id need different names")
    spark = documents.sparkSession
    tests = items.select(F.col(f"`{item_id}`").alias("_i"), F.col(f"`{text}`").alias("_t")).where("_i is not null and _t is not null")
    chars = tests.agg(F.sum(F.length("_t"))).first()[0] or 0
    passes = max(1, -(-chars // (5 * INDEX_WORDS)))
    kinds = f"_d {documents.schema[doc_id].dataType.simpleString()}, _i {items.schema[item_id].dataType.simpleString()}, words int, altered int"
    rows = documents.select(F.col(f"`{doc_id}`").alias("_d"), F.col(f"`{text}`").alias("_t")).where("_t is not null")
    out = None
    for k in range(passes):
        part = tests if passes == 1 else tests.where(F.pmod(F.xxhash64("_i"), F.lit(passes)) == k)
        sent = spark.sparkContext.broadcast(build_index([(r["_i"], r["_t"]) for r in part.distinct().orderBy("_i", "_t").collect()]))

        def find(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for df in parts:
                ids = df["_d"].tolist()
                texts = df["_t"].tolist()
                found = [(ids[a + d], i, n, w) for a in range(0, len(texts), 500) for d, i, n, w in search(sent.value, texts[a : a + 500])]
                yield pd.DataFrame(found, columns=["_d", "_i", "words", "altered"])

        found = rows.mapInPandas(find, kinds)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("_d", "_i").agg(F.max(F.struct("words", (-F.col("altered")).alias("a"))).alias("m"))
    return best.select(F.col("_d").alias(doc_id), F.col("_i").alias(item_id), F.col("m.words").alias("words"), (-F.col("m.a")).alias("altered"))
