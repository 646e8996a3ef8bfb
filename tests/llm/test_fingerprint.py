import hashlib
import random
import unicodedata

import pytest

from seqloom.llm import fingerprint


def canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return " ".join(t.split())


def edit(t, following):
    t, following = t or "", following or ""
    k = len(t) // 2
    return t[: len(t) - k] + following[:k]


TEXTS = ["", None, "a", "Straße  Été", "STRASSE Été ", "café　x", "ﬁn ①", "fin 1", "x" * 5000, "\U0001f600\U0001f601 odd", "odd", "same", "same", "same", " Same\n"]


def run(make_docs, texts, bits=128):
    ids = random.Random(1).sample(range(-500, 5000), len(texts))
    rows = {r.doc_id: r for r in fingerprint.edit_likeness(make_docs(texts, ids=ids), bits=bits).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    prints = {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        e = edit(t, nxt)
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(t or ""), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == float(canon(t) == canon(e)) and r.near_next == float(canon(t) == canon(nxt))
        for f, x in ((r.fingerprint, canon(t)), (r.edited_fingerprint, canon(e))):
            assert prints.setdefault(f, x) == x
        assert r.group_size == sum(canon(x) == canon(t) for x in texts)
    assert len(prints) == len(set(prints.values()))


def test_against_unicodedata(make_docs):
    rng = random.Random(4)
    run(make_docs, TEXTS + [" ".join(rng.choice(TEXTS[2:6]) for _ in range(rng.randint(0, 9))) for _ in range(40)])


@pytest.mark.parametrize("bits", [1, 4])
def test_texts_of_one_hash_are_compared(make_docs, bits):
    run(make_docs, TEXTS, bits)


def test_buckets_of_ids(make_docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 7)
    run(make_docs, [f"text {i % 50}" for i in range(200)])


@pytest.mark.parametrize("hot", [-(2**63), 40, 2**63 - 1])
def test_a_key_of_many_rows_has_buckets_of_its_own(spark, monkeypatch, hot):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 7)
    rng = random.Random(3)
    rows = [(hot if i % 3 else rng.randrange(100), rng.randrange(-(2**63), 2**63) if i % 4 else 5, i // 12, f"t{i}") for i in range(400)]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "key long, p long, q long, text string")
    order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    want = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    found = fingerprint.with_next(df, ["p", "q"], ["text"])
    assert {tuple(r[:4]): (r.next_key, r.next_p, r.next_q, r.next_text) for r in found.collect()} == want and found.count() == len(rows)
    bounds, parts = [0, hot] if hot > 0 else [hot, 0], [1, 20] if hot > 0 else [20, 1]
    key, p = fingerprint.F.col("key"), fingerprint.F.col("p")
    bucket = fingerprint.bucket_of(key, bounds)
    sizes = df.groupBy(bucket.alias("b"), fingerprint._part(bucket, key, p, bounds, parts).alias("i")).count().collect()
    assert max(r["count"] for r in sizes if r.i) < 130 and len({r.i for r in sizes}) == 21  # a quarter of the rows have one p


@pytest.mark.parametrize("bits", [1, 128])
def test_ids_that_repeat_or_miss(make_docs, bits):
    """Each row gives one row, and has the fingerprint of its own text."""
    texts = ["one", "two", "two", "Two", "three", "", None, "ONE", "four", "four"]
    ids = [7, 7, 7, 7, None, None, None, 3, 7, None]
    rows = fingerprint.edit_likeness(make_docs(texts, ids=ids), bits=bits).collect()
    want = {}
    for i, t in zip(ids, texts):
        want.setdefault((i, len(t or "")), []).append(canon(t))
    assert len(rows) == len(texts)
    sizes = sorted(sum(canon(u) == canon(t) for u in texts) for t in texts)
    assert sorted(r.group_size for r in rows) == sizes and len({r.fingerprint for r in rows}) == len({canon(t) for t in texts})
    for r in rows:
        assert (r.near_edited, r.near_next) in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)) and (r.doc_id, r.n_chars) in want


def test_odd_rows(odd_docs):
    rows = fingerprint.edit_likeness(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert len({r.fingerprint for r in rows if r.doc_id in (6, 7)}) == 1
    assert fingerprint.edit_likeness(odd_docs.limit(0)).count() == 0
    assert fingerprint.edit_likeness(odd_docs.where("doc_id = 9")).first().near_next == 1.0
