import math
import random
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import langid

WORDS = {"aa": ["ba", "bada", "dab", "abba"], "bb": ["élu", "lué", "éél", "ulé"], "cc": ["xoz", "zox", "ozzo", "xx"]}


def corpus(rng, n=90):
    langs = [rng.choice(list(WORDS)) for _ in range(n)]
    return [" ".join(rng.choice(WORDS[g]) for _ in range(rng.randint(5, 60))) for g in langs], langs


def brute_unigram_to_order(texts, order):
    """Kneser-Ney by dictionaries, for one language."""
    def chars(t):
        out = " "
        for c in t.lower():
            if c.isalpha():
                out += c
            elif out[-1] != " ":
                out += " "
        return (out + " " if out[-1] != " " else out)

    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = chars(t)
        for n in range(1, order + 1):
            for i in range(max(1, n - 1), len(s)):
                grams[n][s[i - n + 1 : i + 1]] += 1
    counts = {order: grams[order]}
    for n in range(order - 1, 0, -1):
        kinds = Counter(g[1:] for g in grams[n + 1])
        counts[n] = Counter({g: kinds.get(g) or 1 for g in grams[n]})

    def discount(n):
        ones, twos = (sum(v == k for v in counts[n].values()) for k in (1, 2))
        return min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)

    ctx = {n: Counter() for n in counts}
    kinds = {n: Counter() for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            ctx[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1
    floor = 1 / langid.ALPHABET

    def p(g):
        n = len(g)
        low = p(g[1:]) if n > 1 else floor
        total = ctx[n][g[:-1]]
        if not total:
            return low
        d = discount(n)
        return max(counts[n][g] - d, 0) / total * (g in counts[n]) + d * kinds[n][g[:-1]] / total * low

    def entropy(t):
        s = chars(t)
        return -sum(math.log2(p(s[max(0, i - order + 1) : i + 1])) for i in range(1, len(s))) / (len(s) - 1)

    return entropy


def test_entropy_matches_brute_force(spark, rng):
    texts, _ = corpus(rng)
    df = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    model = langid.Model.fit(langid.count_grams(df, 3).toPandas())
    want = brute_unigram_to_order(texts, 3)
    for t in ("bada élu", "Zox! xx 123 abba", "q"):
        assert model.entropies([t])[0][0, 0] == pytest.approx(want(t), rel=1e-4)


def test_held_out_accuracy_and_letters(make_docs, rng):
    texts, langs = corpus(rng, 200)
    docs = make_docs(texts + [None, "", "123 !?", "\0ba\0 bada"], langs=langs + ["aa", "aa", None, "aa"])
    rows = {r.doc_id: r for r in langid.cross_validated(docs).collect()}
    assert len(rows) == 204
    held = [i for i in range(200) if rows[i].held_out]
    assert 20 < len(held) < 90 and np.mean([rows[i].lang_pred == langs[i] for i in held]) > 0.97
    for i in (200, 201, 202):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert all(rows[i].rejected for i in (200, 201, 202)) and np.mean([rows[i].rejected for i in range(200)]) < 0.03
    assert rows[203].lang_pred == "aa" and all(0 <= r.score <= 1 for r in rows.values())


def test_rejection(make_docs, rng):
    texts, langs = corpus(rng, 300)
    model = langid.train(make_docs(texts, langs=langs))
    pred, _, rejected = model.predict(["bada abba dab " * 5, "qqqq wwww pppp " * 5], reject=True)
    assert pred == ["aa", "und"] and rejected.tolist() == [False, True]
    assert model.predict(["qqqq"])[0] != ["und"]


def test_odd_rows(odd_docs):
    rows = langid.cross_validated(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert langid.cross_validated(odd_docs.limit(0)).count() == 0
    assert all(r.lang_pred == "und" for r in langid.identify(odd_docs, None).collect())


def test_every_language_is_learnt(spark, make_docs):
    """One document a language, more than 200 languages: none goes to the calibration or past a cap."""
    texts = [" ".join(chr(0x4E00 + 8 * i + k) * 3 for k in range(8)) for i in range(220)]
    langs = [f"l{i}" for i in range(220)]
    model = langid.train(make_docs(texts, langs=langs))
    assert model.langs == sorted(langs) and model.predict(texts)[0] == langs


def test_rare_languages_keep_their_grams(spark, make_docs):
    rng = random.Random(3)
    frequent = [" ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(60)) for _ in range(40)]
    model = langid.train(make_docs([*frequent, "xoz zox ozzo"], langs=["aa"] * 40 + ["cc"]))
    assert ["aa", "cc"] == model.langs and len(model.shards) == 1
    assert all((model.shards[0].logs[n][:, 1] > model.shards[0].logs[n][:, 0]).sum() >= 6 for n in range(2, 5))


def test_shards_do_not_change_entropies(spark, rng):
    texts, langs = corpus(rng)
    counts = langid.count_grams(spark.createDataFrame(list(zip(langs, texts)), "lang string, text string"), 4).toPandas()
    whole, single = langid.Model.fit(counts), langid.Model.fit(counts, 1)
    assert (len(whole.shards), len(single.shards)) == (1, 3) and whole.langs == single.langs
    some = [*texts[:20], "q", "", None]
    assert np.allclose(whole.entropies(some)[0], single.entropies(some)[0], atol=1e-5)


def test_probabilities_sum_to_one_after_any_context(spark, rng):
    texts, langs = corpus(rng)
    shard = langid.Shard.fit(langid.count_grams(spark.createDataFrame(list(zip(langs, texts)), "lang string, text string"), 4).toPandas())
    known = sorted(set("".join(texts).replace(" ", ""))) + [" "]
    for context in ("ba", "b", "é", "xq", "zo", "qqq", " da"):
        total = np.zeros(3)
        for c, times in [*((c, 1) for c in known), ("\u4e00", langid.ALPHABET - len(known))]:
            codes = np.array([ord(x) for x in " " + context + c], np.uint32)
            total += times * 2.0 ** shard.values(langid.gram_hashes(codes, 4), np.arange(len(codes)))[-1]
        assert np.allclose(total, 1, atol=1e-3), context


def test_a_hundred_languages(spark, make_docs):
    """Languages of the same letters that differ in their syllables alone."""
    rng = random.Random(5)
    syllables = [[rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice(["", "n", "s"]) for _ in range(14)] for _ in range(100)]
    words = lambda i, n: " ".join("".join(rng.choices(syllables[i], k=rng.randint(2, 3))) for _ in range(n))
    texts, langs = zip(*[(words(i, 60), f"l{i:02d}") for i in range(100) for _ in range(12)])
    model = langid.train(make_docs(list(texts), langs=list(langs)))
    assert len(model.langs) == 100 and len(model.shards) == 13
    held = [(words(i, 40), f"l{i:02d}") for i in range(100) for _ in range(3)]
    assert np.mean([p == g for p, (_, g) in zip(model.predict([t for t, _ in held])[0], held)]) > 0.97
