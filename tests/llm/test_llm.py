"""Operators of the llm subpackage against brute force, with empty, null, tied and repeated rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import leaks, nearest_time, packing, quantiles, queries, spam, topn


# --- percentiles -------------------------------------------------------------------------------------------------

def test_percentiles_keep_their_bound(spark):
    rng = random.Random(1)
    values = {"a": [rng.lognormvariate(0, 4) * rng.choice([-1, 1]) for _ in range(2000)], "b": [float(rng.randint(-3, 3)) for _ in range(501)], "c": [7.5], "d": [1e-300, 1e300, -1e300, 0.0, 0.0], None: [1.0, 2.0]}
    rows = [(k, rng.randint(1, 3), v) for k, vs in values.items() for v in vs] + [("a", 1, None), ("a", 2, float("nan")), ("e", 1, None)]
    df = spark.createDataFrame(rows, "k string, day int, v double").withColumn("bucket", F.lit("x")).withColumn("n", F.lit(1))
    b = quantiles.LogBuckets(0.01)
    daily = quantiles.sketch(df, ["k", "day"], "v", b)
    merged = quantiles.merge(daily, "k")
    whole = quantiles.sketch(df, "k", "v", b)
    assert sorted(map(str, merged.select(*sorted(merged.columns)).collect())) == sorted(map(str, whole.select(*sorted(whole.columns)).collect()))
    for r in quantiles.percentiles(merged, "k", [0, 5, 50, 95, 100, 50], b).collect():
        vs = sorted(values[r["k"]])
        rank = r["pct"] / 100 * (len(vs) - 1)
        lo, hi = vs[math.floor(rank)], vs[math.ceil(rank)]
        slack = 0.0101 * max(abs(lo), abs(hi))
        assert lo - slack <= r["value"] <= hi + slack and r["n_values"] == len(vs)
    assert {r["k"] for r in merged.collect()} == set(values)
    assert quantiles.sketch(df.limit(0), "k", "v", b).count() == 0
    with pytest.raises(ValueError):
        quantiles.percentiles(merged, "k", [101], b)


def test_anchor_decides_exactly(spark):
    rng = random.Random(2)
    rows = [(g, 45.0 + rng.choice([-1, 1]) * rng.choice([0, 0.001, 0.002, 3.0])) for g in range(60) for _ in range(rng.randint(1, 9))]
    b = quantiles.LogBuckets(0.02, 45.0)
    got = {(r["g"], r["pct"]): r["value"] > 45 for r in quantiles.percentiles(quantiles.sketch(spark.createDataFrame(rows, "g int, v double"), "g", "v", b), "g", [5, 50, 95], b).collect()}
    for g in range(60):
        v = [x for k, x in rows if k == g]
        for p in (5, 50, 95):
            exact = np.percentile(v, p)
            if abs(exact - 45) > 1e-9:
                assert got[g, p] == (exact > 45)


# --- nearest in time ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize(("tolerance", "dense"), [(0.0, 256), (1.75, 256), (1.75, 1), (40.0, 3)])
def test_nearest_in_time(spark, tolerance, dense):
    rng = random.Random(7)
    a = [(rng.choice([1, 2, None]), rng.randint(0, 400) / 8, i) for i in range(300)] + [(1, None, 900), (1, float("nan"), 901), (1, math.inf, 902)]
    b = [(rng.choice([1, 2, 3]), rng.randint(0, 400) / 8, 1000 + i) for i in range(60)] + [(1, None, 5)]
    left = spark.createDataFrame(a + a[:9], "e int, t double, l long").withColumn("_b", F.lit(1))
    right = spark.createDataFrame(b + b[:9], "e int, t double, r long").withColumn("_own", F.lit(1))
    expected = set()
    for e, t, i in a:
        c = [(abs(t - u), u, j) for f, u, j in b if e is not None and t is not None and u is not None and e == f and abs(t - u) <= tolerance]
        if c:
            expected.add((i, min(c)[2]))
    got = nearest_time.nearest_within(left, right, "e", "t", "l", "r", tolerance, dense=dense).collect()
    assert len(got) == len(expected) and {(r["l"], r["r"]) for r in got} == expected
    assert nearest_time.nearest_within(left.limit(0), right, "e", "t", "l", "r", 1.0).count() == 0
    assert nearest_time.nearest_within(left, right.limit(0), "e", "t", "l", "r", 1.0).count() == 0


# --- top n -------------------------------------------------------------------------------------------------------

def test_top_n(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a"] * 20 + ["b", "c", None]), rng.choice(["é", "z", "Z", "x"]) + str(rng.randint(0, 60)), float(rng.randint(0, 4)) if rng.random() > 0.1 else rng.choice([None, math.nan])) for _ in range(1500)] + [("only", "i", None), ("b", None, 3.0)]
    df = spark.createDataFrame(rows + rows[:50], "g string, i string, s double").withColumn("_pid", F.lit(0))
    best = {}
    for g, i, s in rows:
        if i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), -1), s)
    expected = set()
    for g in {k[0] for k in best}:
        order = sorted(((-s, i.encode(), i) for (h, i), s in best.items() if h == g))
        expected |= {(g, i, -s, k) for k, (s, _, i) in enumerate(order[:5], 1)}
    got = topn.top_n(df, "g", "s", "i", 5, partitions=6)
    assert {tuple(r) for r in got.select("g", "i", "s", "position").collect()} == expected and got.count() == len(expected)
    assert topn.top_n(df.limit(0), "g", "s", "i", 5).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "g", "s", "i", 0)


# --- packing -----------------------------------------------------------------------------------------------------

def test_bins_fit_and_are_bounded():
    rng = random.Random(4)
    bins = packing.OpenBins(100, 5)
    used: dict = {}
    for _ in range(3000):
        n = rng.randint(0, 100)
        b, at = bins.put(n)
        assert at == used.get(b, 0)
        used[b] = at + n
        assert used[b] <= 100 and bins.count <= 5
    bins = packing.OpenBins(10, 9)
    assert [bins.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]  # the tightest bin takes an item


def test_packing(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([rng.randint(0, 400), rng.randint(400, 5000)])) for i in range(3000)] + [(5000, 2048), (5001, 4096), (5002, 0), (5003, None), (5004, 2049)]
    df = spark.createDataFrame(sizes + sizes[:5], "id long, n long").withColumn("piece", F.lit(7))
    out = packing.pack(df, "id", "n", 2048, open_bins=32, bins_per_partition=400).collect()
    used: dict = {}
    for r in out:
        used.setdefault(r["container"], []).append((r["offset"], r["n_units"]))
    for parts in used.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at or n == 0 or a >= at
            at = max(at, a + n)
        assert at <= 2048 and sum(n for _, n in parts) == at
    total = {}
    for i, n in sizes + sizes[:5]:
        total[i] = total.get(i, 0) + (n or 0)
    got, pieces = {}, {}
    for r in out:
        got[r["id"]] = got.get(r["id"], 0) + r["n_units"]
        pieces.setdefault(r["id"], []).append(r["n_units"])
    assert got == total and sorted(pieces[5004]) == [1, 2048] and sorted(pieces[5001]) == [2048, 2048] and pieces[5003] == [0]
    assert all(len(pieces[i]) == 1 for i, n in sizes[5:] if (n or 0) <= 2048)
    assert sum(total.values()) / (2048 * len(used)) > 0.93
    again = packing.pack(df, "id", "n", 2048, open_bins=32, bins_per_partition=400).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert packing.pack(df.limit(0), "id", "n").count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, -1)], "id long, n long"), "id", "n")


def test_token_counts(spark):
    text = ["Frankly: the customs reform.", "", None, "Straßenbahnlinie " * 3000, "<|endoftext|>", "日本\u0000\n\n\tx"]
    df = spark.createDataFrame(list(enumerate(text)), "id long, text string").withColumn("_n", F.lit(0))
    got = {r["_id"]: r["_n"] for r in packing.token_counts(df, "id", "text").collect()}
    import base64

    import public_tokenizers
    import tiktoken

    with open(packing.VOCABULARY, "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(text)}
    assert enc.decode(enc.encode_ordinary(text[5])) == text[5]


def test_scores_of_rows_without_peptide_count_for_no_protein(spark, tmp_path):
    entries = [("AK", "aK ", 1.0, None), ("AK", " ", 9.0, None), ("AK", None, 8.0, None), ("A[+1]K", "AK", 2.0, None), ("CK", "CK", math.nan, None), ("DK", "DK", 5.0, 1)]
    links = [("AK", "P1", None), (" ak", "P1", None), ("CK", "P1", None), ("DK", "P2", None), (None, "P3", None), ("AK", "P4", 1)]
    spark.createDataFrame(entries, "PeptideModSeq string, PeptideSeq string, Score double, deleted_at int").write.parquet(f"{tmp_path}/entries.parquet")
    spark.createDataFrame(links, "PeptideSeq string, ProteinAccession string, deleted_at int").write.parquet(f"{tmp_path}/peptidetoprotein.parquet")
    assert [tuple(r) for r in queries.p6_found(spark, str(tmp_path)).orderBy("PeptideModSeq").collect()] == [("P1", "AK"), ("P1", "A[+1]K")]


# --- leaks -------------------------------------------------------------------------------------------------------

_VOCABULARY = [a + b + c for a in ("ka", "mo", "ri", "tu", "se", "lo") for b in ("ban", "del", "gor", "mis", "vup") for c in ("", "a", "en", "os")]


def passage(rng, n):
    return [rng.choice(_VOCABULARY) for _ in range(n)]


def test_scan_finds_all_patterns():
    rng = random.Random(6)
    small = _VOCABULARY[:12]
    items = [(i, " ".join(rng.choice(small) for _ in range(rng.randint(0, 30)))) for i in range(20)]
    index = leaks.build_index(items)
    text = [rng.choice([*small, "other", "words"]) for _ in range(3000)]
    codes = np.array([index["vocabulary"].get(w, 0) for w in text])
    at, pattern = leaks.scan(index, leaks.block_numbers(index, codes))
    m = leaks.PATTERN
    grams = {tuple(t.split()[p : p + m]) for _, t in items for p in range(len(t.split()) - m + 1)}
    assert sorted(at.tolist()) == [p for p in range(len(text) - m + 1) if tuple(text[p : p + m]) in grams]
    for p, k in zip(at.tolist(), pattern.tolist()):
        i, q = index["item"][index["first"][k]], index["at"][index["first"][k]]
        assert items[i][1].split()[q : q + m] == text[p : p + m]
    empty = leaks.build_index([])
    assert len(leaks.scan(empty, leaks.block_numbers(empty, codes))[0]) == 0 and leaks.search(index, ["", None, "x"]) == []


def test_words():
    assert leaks.words("<b>Élève</b> Straße, mi-\n nority ﬁn &amp; Œuvre [url=http://x]y[/url]") == ["eleve", "strasse", "minority", "fin", "oeuvre", "y"]


def test_leaked_passages(spark):
    rng = random.Random(9)
    items = [(i, passage(rng, 80)) for i in range(12)]
    t = dict(items)
    fill = lambda n: passage(rng, n)
    docs, expected = [], set()

    def put(words, *leaked):
        docs.append((len(docs), " ".join(words)))
        expected.update((i, len(docs) - 1) for i in leaked)

    put(fill(100) + t[0][10:34] + fill(50), 0)  # the shortest passage
    put(fill(100) + t[0][10:33] + fill(50))  # a word too few
    put([w.upper() + "," for w in t[1]], 1)
    w = list(t[2][5:45])
    for k in (7, 15, 23, 31, 38):
        w[k] = "altered"
    put(fill(30) + w + fill(9), 2)  # one in eight
    w = list(t[3][0:40])
    for k in range(3, 40, 5):
        w[k] = "altered"
    put(w)  # more than one in eight
    put(fill(5) + t[4][:15] + "( the speaker was cut off and asked to resume )".split() + t[4][15:30] + fill(5), 4)
    put(t[5][:12] + fill(400) + t[5][12:24])  # far apart
    put(fill(20) + t[6] + fill(20) + t[7][20:60] + fill(3000), 6, 7)
    put(list(reversed(t[8])))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "-\n" * 50)]
    long = (docs[-1][0] + 1, " ".join(fill(60000) + t[9][:30] + fill(100)))
    docs.append(long)
    expected.add((9, long[0]))
    d = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").withColumn("words", F.lit(1))
    e = spark.createDataFrame([(i, " ".join(x)) for i, x in items] + [(50, None), (51, ""), (52, "too short")], "item_id long, text string")
    got = leaks.leaked_passages(d, e, "doc_id", "item_id").collect()
    assert {(r["item_id"], r["doc_id"]) for r in got} == expected and len(got) == len(expected)
    assert {r["words"] for r in got if r["item_id"] == 0} == {24}
    assert leaks.leaked_passages(d.limit(0), e, "doc_id", "item_id").count() == 0
    assert leaks.leaked_passages(d, e.limit(0), "doc_id", "item_id").count() == 0


def _put_in(words, spec, fresh):
    """Words with ``spec[i]`` new ones after place i."""
    return [y for i, w in enumerate(words) for y in [w, *(next(fresh) for _ in range(spec.get(i, 0)))]]


def _altered(words, places, fresh):
    return [next(fresh) if i in places else w for i, w in enumerate(words)]


def test_insertions_and_altered_words_together():
    fresh = (f"new{i}" for i in range(10**6))
    item = [f"word{i}" for i in range(80)]
    index = leaks.build_index([(1, " ".join(item)), (2, " ".join(f"else{i}" for i in range(60)))])
    p = item[10:34]
    three = _altered(p, {5, 11, 17}, fresh)
    cases = {
        "plain": (p, 24), "three altered": (three, 24), "one insertion": (_put_in(three, {8: 5}, fresh), 24), "two insertions": (_put_in(three, {8: 5, 14: 5}, fresh), 24),
        "three insertions": (_put_in(three, {2: 2, 8: 2, 14: 2}, fresh), 24), **{f"{n} words put in": (_put_in(p, {11: n}, fresh), 24) for n in (18, 19, 24, 30)},
        "46 words": (_put_in(item[10:56], {22: 19}, fresh), 46), "60 words": (_put_in(item[10:70], {22: 40}, fresh), 60), "one word after every three": (_put_in(p, {i: 1 for i in range(2, 23, 3)}, fresh), 24),
        "angles": (["<", *p[:12], ">", *p[12:]], 24), "altered words close by": (_altered(p, {5, 7, 17}, fresh), 24), "a single word at the end": (_altered(p, {1}, fresh), 24),
        "a page of 1,000 words put in": (_put_in(item[10:50], {19: 1000}, fresh), 40), "a bad chain before": (_altered(item[:50], set(range(2, 50, 4)), fresh) + [next(fresh) for _ in range(30)] + item[50:75], 25),
    }
    for name, (words, least) in cases.items():
        found = leaks.search(index, [" ".join([next(fresh) for _ in range(50)] + words + [next(fresh) for _ in range(60)])])
        assert [f[:2] for f in found] == [(0, 1)] and found[0][2] >= least, name
    for words in (item[10:33], _altered(p, {4, 9, 14, 19}, fresh), p[::-1], _put_in(p, {i: 1 for i in range(24)}, fresh)):
        assert leaks.search(index, [" ".join(words)]) == []


def test_recall_with_words_put_in():
    rng = random.Random(21)
    fresh = (f"new{i}" for i in range(10**7))
    items = [[f"w{k}x{i}" for i in range(90)] for k in range(20)]
    index = leaks.build_index([(k, " ".join(w)) for k, w in enumerate(items)])
    texts, truth = [], []
    for _ in range(600):
        k, n = rng.randrange(20), rng.randint(40, 60)
        a = rng.randint(0, 90 - n)
        # at most 100 words at each of two places, 14 words or more from each other and from the ends
        x, y = 13 + rng.randint(0, n - 40) // 2, 27 + rng.randint(0, n - 40) // 2
        spec = {x: rng.randint(1, 100), max(y, x + 14): rng.randint(0, 100)}
        words = _put_in(items[k][a : a + n], spec, fresh)
        for i in rng.sample(range(0, len(words)), 2):
            words[i] = next(fresh)
        texts.append(" ".join([next(fresh) for _ in range(rng.randint(0, 80))] + words))
        truth.append(k)
    found = {(d, i) for d, i, *_ in leaks.search(index, texts)}
    assert found <= set(enumerate(truth)) and len(found) >= 0.98 * len(texts)


def test_many_items_take_several_passes(spark, monkeypatch):
    rng = random.Random(10)
    items = [(i, passage(rng, 60)) for i in range(10)]
    docs = [(i, " ".join(passage(rng, 40) + w[10:50])) for i, w in items]
    monkeypatch.setattr(leaks, "INDEX_WORDS", 100)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_passages(d, e, "doc_id", "item_id").collect()} == {(i, i) for i in range(10)}


# --- spam --------------------------------------------------------------------------------------------------------

def test_tokens():
    assert spam.tokens("Élan  c r o q u e t t e s!! d o g s d o g s") == ["elan"] + ["croquettes"] * 9 + ["croquettes!!"] + ["dogs"] * 8
    assert spam.parts("c0ff33") == ("c#ff#",) and spam.parts("t69555") == ("t#",) and spam.parts("2026-01-05") == ("#", "#", "#") and spam.parts("<a") == ("<a",) and spam.parts("|") == ()


def test_spam_pages(spark):
    rng = random.Random(11)
    parts = ["ba", "ke", "li", "mo", "nu", "pa", "re", "si", "tan", "vel", "dor", "min"]
    vocabulary = ["the", "of", "and", "to", "in"] + [a + b + c for a in parts for b in parts for c in parts]
    weights = [1 / (r + 3) for r in range(len(vocabulary))]
    prose = lambda n: rng.choices(vocabulary, weights, k=n)
    goods = ["cheap", "tyres", "sofa", "deal", "boats", "order", "shoes", "offer"]
    docs, bad = [], set()
    for i in range(600):
        n = rng.randint(40, 200)
        kind = i % 12
        if kind == 0:
            docs.append((i, " ".join(rng.choice(goods[:3]) for _ in range(n))))
            bad.add(i)
        elif kind == 1:
            docs.append((i, "\n".join("https://www.x.test/" + "/".join(rng.choice(goods) for _ in range(3)) for _ in range(n))))
            bad.add(i)
        elif kind == 2:
            docs.append((i, " ".join(prose(n) + [rng.choice(goods[:3]) for _ in range(n // 3)])))  # less than half
        else:
            docs.append((i, " ".join(prose(n))))
    docs += [(1000, None), (1001, ""), (1002, " "), (None, "x"), (1003, "|" * 500), (1004, " ".join(prose(30000)))]
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").withColumn("share", F.lit("x")).withColumn("n", F.lit(0))
    got = spam.spam_pages(df, "doc_id").collect()
    share = {r["doc_id"]: r["share"] for r in got}
    assert len(got) == len(share) and {i for i, s in share.items() if s > 0.5} == bad
    assert share[1001] == share[1002] == 0 and 1000 not in share and None not in share
    assert spam.spam_pages(df.limit(0), "doc_id").count() == 0
    few = spam.spam_pages(df.where("doc_id = 5"), "doc_id").collect()
    assert [r["share"] for r in few] == [0.0]


def test_curves_match_numpy(spark):
    text = "the aa aa aa bb bb cc the the the dd ee ff gg hh ii jj kk ll mm nn oo pp"
    r = spam.page_curves(spark.createDataFrame([(1, text)], "id long, text string"), "id").first()
    f = np.array(sorted((text.split().count(w) for w in set(text.split())), reverse=True), float)
    x, y = np.log(np.arange(1, len(f) + 1)), np.log(f)
    slope, cut = np.polyfit(x, y, 1)
    assert r["slope"] == pytest.approx(slope) and r["residual"] == pytest.approx(np.sqrt(np.mean((y - cut - slope * x) ** 2))) and r["n_words"] == len(text.split())


def test_rare_keywords_count(spark):
    rng = random.Random(12)
    vocabulary = ["the", "of", "and", "to", "in"] + [a + b + c for a in ("ba", "ke", "li", "mo", "nu") for b in ("pa", "re", "si", "tan", "vel") for c in ("dor", "min", "sul", "ter")]
    docs = [" ".join(rng.choices(vocabulary, [1 / (k + 3) for k in range(len(vocabulary))], k=rng.randint(100, 120))) for _ in range(8000)]
    docs += [" ".join(rng.choices(["cheap", "tyres", "sofa"], k=110)) for _ in range(1990)]
    docs += [" ".join(rng.choices([f"quartz{c}", f"lamps{c}"], k=110)) for c in "abc"]  # fewer pages than SEED_SHARE of the seeds, each with keywords of its own
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"] for r in spam.spam_pages(df, "doc_id").where("share > 0.5").collect()}
    assert found == set(range(8000, 9993))


def test_copies_and_many_extreme_pages_keep_the_norms(spark):
    rng = random.Random(13)
    vocabulary = ["the", "of", "and", "to", "in"] + [a + b + c for a in ("ba", "ke", "li", "mo", "nu") for b in ("pa", "re", "si", "tan", "vel") for c in ("dor", "min", "sul", "ter")]
    page = lambda: " ".join(rng.choices(vocabulary, [1 / (k + 3) for k in range(len(vocabulary))], k=110))
    prose = [page() for _ in range(200)]
    keywords = ["the " + " ".join(rng.choices(["cheap", "tyres", "sofa"], k=109)) for _ in range(110)]
    extreme = lambda docs: {r["_id"] for r in spam.page_curves(spark.createDataFrame(list(enumerate(docs)), "id long, text string"), "id").where(f"slope_z < -{spam.EXTREME} OR residual_z > {spam.EXTREME} OR (divergence_z > {spam.EXTREME} AND few)").collect()}
    # over a third of the class is of keywords, each page another text; copies of one page
    assert extreme(prose + keywords) == set(range(200, 310))
    assert extreme(prose + keywords[:1] * 300) == set(range(200, 500))
    # copies of one prose page are over three quarters of the class
    assert extreme(prose + prose[:1] * 900) == set()


def test_a_language_is_learnt_from_its_labels(spark):
    rng = random.Random(17)
    parts = ["ba", "ke", "li", "mo", "nu", "pa", "re", "si", "tan", "vel", "dor", "min"]
    docs, bad = [], set()
    for lang, common, tail, n in (("xx", ["wo", "li", "na"], "u", 400), ("YY", ["sor", "ta", "em"], "o", 40)):
        words = common + [a + b + tail for a in parts for b in parts]
        weights = [40, 30, 20] + [1] * (len(words) - 3)
        for k in range(n):
            i = len(docs)
            text = rng.choices(words, weights, k=rng.randint(60, 120))
            if k % 10 == 0:  # keywords between words of the language
                text = [w for _ in range(40) for w in (rng.choice(common), rng.choice(["kauf", "preis", "rabatt"]))]
                bad.add(i)
            docs.append((i, " ".join(text), None if k % 9 == 0 else "xx" if k % 11 == 0 else lang))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in spam.spam_pages(df, "doc_id", lang="lang").where("share > 0.5").collect()} == bad
    langs = {r["_id"]: r["lang"] for r in spam.page_curves(df, "doc_id", lang="lang").collect()}
    assert all(langs[i] == ("xx" if i < 400 else "yy") for i in range(440) if i not in bad)
