"""Language filters, language-model scores and URL scores against plain versions of their methods."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sigmill.llm import languages, lm, urls
from sigmill.llm.workspace import Workspace

# ---- 10 ----

SYLLABLES = {"aa": "la ro mi ta ne so".split(), "bb": "ska dru pel mo ra ti".split(), "cc": "ngo ulu wez ama ki so".split()}


def labelled(seed=3):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))
    rows = []
    for k in range(240):
        lang = "aabbcc"[2 * (k % 3) : 2 * (k % 3) + 2]
        text = " ".join(word(lang if rng.random() < 0.95 else rng.choice(list(SYLLABLES))) for _ in range(rng.randint(1, 60)))
        rows.append((k, text.title() if k % 5 == 0 else text.replace(" ", ", ", 2), lang))
    rows += [(500, "Laro12mita", "aa"), (501, rows[3][1], "aa"), (501, rows[3][1], "aa"), (502, "mo " * 20_000, "bb")]  # repeated rows, a very long text
    return rows


def plain_grams(text):
    s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return [s[k : k + n] for n in languages.SIZES for k in range(len(s) - n + 1) if s[k : k + n].count(" ") <= 1]


def exact_sets(rows):
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        counts[lang].update(plain_grams(text))
    rates = {lang: {g: n / c.total() for g, n in c.items() if n > 1 and n / c.total() >= languages.FLOOR} for lang, c in counts.items()}
    top = collections.Counter()
    for own in rates.values():
        for g, r in own.items():
            top[g] = max(top[g], r)
    return {lang: {g for g, r in own.items() if r >= languages.SHARE * top[g]} for lang, own in rates.items()}


def test_languages_against_exact_sets(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"held_out": F.lit("x"), "_text": F.lit(1), "lang_pred": F.lit(2), "score": F.lit("y")})
    filters, sets = languages.train(df), exact_sets(rows)
    assert filters.languages == sorted(sets)
    for k, lang in enumerate(filters.languages):  # every n-gram of the set is in the filter
        for g in sets[lang]:
            points, at = np.array([ord(c) for c in g], np.uint64), np.array([0, len(g)])
            keys = languages.tx.windows(points, len(g), seed=len(g))
            assert all(int(filters.words[0][s[0]]) >> k & 1 for s in filters.slots(keys))
    random_keys = languages.tx.mix(np.arange(1, 200_001, dtype=np.uint64))
    masks = filters.words[0][filters.slots(random_keys)[0]] & filters.words[0][filters.slots(random_keys)[1]]
    for k in range(3):  # the rate that counts are corrected for is that of strange keys
        assert ((masks >> np.uint64(k)) & np.uint64(1)).mean() == pytest.approx(filters.false[k], abs=0.003)
    got = collections.defaultdict(list)
    for r in languages.identify(df.drop("lang"), filters).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    sure = 0
    for i, text, _ in rows:
        hits = {lang: sum(g in s for g in plain_grams(text)) for lang, s in sets.items()}
        share = {lang: n / max(1, sum(hits.values())) for lang, n in hits.items()}
        best = max(share, key=share.get)
        for lang, score in got[i]:
            if sorted(share.values())[-1] - sorted(share.values())[-2] > 0.05:
                sure += 1
                assert lang == best
            assert abs(score - share[lang]) < 0.06 + 1 / len(plain_grams(text))
    assert sure > 200 and len(got[501]) == 2 and got[501][0] == got[501][1]


def test_language_ties_go_to_the_first_by_name():
    one = np.array([5, 9, 77], np.uint64)
    filters = languages.Filters.of({"zz": one, "bb": one}, "zz")
    names, score = filters.predict(pa.array(["1 2 3", "", None, "abc"]))
    assert names[:3] == ["und"] * 3 and names[3] in ("bb", "zz")
    points, at = languages.codes(pa.array(["abcd"]))
    keys = np.concatenate([languages.grams(points, at, n)[0] for n in languages.SIZES])
    assert languages.Filters.of({"zz": keys, "bb": keys}, "zz").predict(pa.array(["abcd"]))[0] == ["bb"]


# ---- 2 ----


def plain_scores(rows):
    """Deleted interpolation written out, with the same steps of the deleted estimates in the weights' training."""
    tokens = {i: [*(t or "").split(), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    uni, bi = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if not held[i]:
            uni.update(t)
            bi.update(zip(["<s>", *t], t))
    ends = uni[None]
    total, types = uni.total(), len(uni)
    count = lambda c: ends if c == "<s>" else uni[c]
    bucket = lambda n: min(math.frexp(max(n, 0))[1], lm.BUCKETS - 1)
    step = lambda p: math.exp(-round(-math.log(p) * lm.GRID) / lm.GRID) if p > 0 else 0.0
    cells = collections.defaultdict(collections.Counter)
    for i, t in tokens.items():
        for c, w in zip(["<s>", *t], t):
            if not held[i]:
                cells[bucket(count(c) - 1)][step((uni[w] - 1) / max(total - 1, 1)), step((bi[c, w] - 1) / max(count(c) - 1, 1))] += 1
    weights = {}
    for b, own in cells.items():
        w = [1 / 3] * 3
        for _ in range(lm.ROUNDS):
            part = [0.0] * 3
            for (u, p), n in own.items():
                each = [w[0] / (types + 1), w[1] * u, w[2] * p]
                part = [x + n * e / sum(each) for x, e in zip(part, each)]
            w = [x / own.total() for x in part]
        w = [max(x, 1e-9) for x in w]
        weights[b] = [x / sum(w) for x in w]
    near = lambda b: weights[min(weights, key=lambda s: (abs(s - b), s))] if weights else (1.0, 0.0, 0.0)
    out = {}
    for i, t in tokens.items():
        p = [sum(x * y for x, y in zip(near(bucket(count(c))), (1 / (types + 1), uni[w] / max(total, 1), bi[c, w] / max(count(c), 1)))) for c, w in zip(["<s>", *t], t)]
        out[i] = (held[i], sum(map(math.log10, p)))
    return out


@pytest.mark.parametrize("only_held_out", [False, True])
def test_language_model_scores(spark, only_held_out):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(50)]
    rows = [(k, " ".join(words[min(49, int(rng.paretovariate(0.8)))] for _ in range(rng.randint(0, 60)))) for k in range(120)] + [(300, None), (301, "w1 " * 3000), (302, "new words only")]
    if only_held_out:  # no document to learn from: every token gets the uniform part
        rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 1]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), Workspace(spark, "t2")).collect()
    want = plain_scores(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1], rel=1e-9, abs=1e-9))


def test_rows_without_an_id_are_held_out(spark):
    got = lm.score(spark.createDataFrame([(None, "a b"), (None, "a b"), (2, "a b")], "doc_id long, text string"), Workspace(spark, "t2")).collect()
    assert sorted((r.doc_id is None, r.held_out) for r in got)[1:] == [(True, True), (True, True)]


# ---- 8 ----


def test_url_scores_are_the_logistic_sum(spark):
    rows = [(f"https://{'spam' if k % 2 else 'book'}{k}.example.com/{'win/cash' if k % 2 else 'read/page'}{k}", k % 2) for k in range(60)]
    labelled_ = spark.createDataFrame(rows, "url string, label int")
    weights, intercept = urls.fit(labelled_)
    asked = ["https://spam7.example.com/win/cash7?x=1", "http://Book.EXAMPLE.com/read/é", "no url", None, "https://a.b/" + "long/" * 20_000, "https:///x"]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(asked)), "page_id long, url string"), labelled_).collect()}
    for k in range(len(asked)):
        on = set()
        for text, kind in ((got[k].host, b"h"), (got[k].path, b"p")):
            marked = f"^{text}$"
            seed = xxhash.xxh64_intdigest(kind, 42)
            on |= {xxhash.xxh64_intdigest(marked[a : a + n].encode(), seed) % (1 << urls.BITS) for n in urls.SIZES for a in range(len(marked) - n + 1)}
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-(intercept + sum(weights[s] for s in on)))), abs=1e-9)
    assert got[0].score > 0.5 > got[1].score
