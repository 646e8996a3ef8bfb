import random
import re

from seqloom.llm import near
from seqloom.llm.common import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def corpus(seed, groups=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \n", "one two", "One TWO", "one two three", "a b c d e", "A b c d e"]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 300))]
        if rng.random() < 0.5:
            base[5:5] = shared
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
            base = t if rng.random() < 0.5 else base  # chains
    rng.shuffle(texts)
    return texts


def test_components_match_brute_force(spark, make_docs):
    for seed in (1, 2):
        texts = corpus(seed)
        sizes, want = brute(texts)
        rows = {r.doc_id: r for r in near.near_dedup(make_docs(texts)).collect()}
        assert [rows[i].n_shingles for i in range(len(texts))] == sizes
        assert [rows[i].component_id for i in range(len(texts))] == want
        assert all(r.kept == (r.component_id == i) for i, r in rows.items())


def test_a_mixed_bucket_in_blocks(spark, make_docs):
    texts = corpus(5, 12)
    docs = make_docs(texts)
    sizes, want = brute(texts)
    full = near.sketches(docs, "doc_id", "text", "doc_id").where("n > 0")
    one = full.selectExpr("1L AS band", "0 AS no", "id")
    none = spark.createDataFrame([], "id long, component long")
    for block in (7, 512):
        links = near.across(one, none, full, docs, "doc_id", "text", block)
        found = {r.id: r.component for r in near.components(links).collect()}
        assert [found.get(i, i) for i in range(len(texts))] == want


def test_components_of_long_chains(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 30] + [(1000, 1002), (1001, 1002)], "a long, b long")
    found = {r.id: r.component for r in near.components(edges).collect()}
    assert found == {i: 0 if i <= 30 else 31 for i in range(n + 1)} | {i: 1000 for i in (1000, 1001, 1002)}


def test_registers_merge_and_estimate():
    import numpy as np

    rng = random.Random(3)
    words = [f"x{i}" for i in range(2000)]
    a, b = " ".join(words[:1500]).encode(), " ".join(words[300:1800]).encode()
    sets, bounds = near.shingle_sets([a, b], WordHashes())
    regs = near.registers(sets, bounds)
    union = near.registers(np.unique(sets), np.array([0, len(np.unique(sets))]))
    assert (np.maximum(regs[0], regs[1]) == union[0]).all()
    n = np.diff(bounds).astype(float)
    true = len(np.intersect1d(sets[: bounds[1]], sets[bounds[1] :])) / len(np.unique(sets))
    assert abs(near.likelihood(regs[:1], regs[1:], n[:1], n[1:])[0] - true) < 0.12
    many = np.stack([near.registers(np.unique(rng2.integers(0, 2**63, 400 + k, dtype=np.uint64)), np.array([0, 400 + k]))[0] for k in range(2)] * 20) if (rng2 := np.random.default_rng(1)) else None
    left, right = np.repeat(regs[:1], len(many) + 2, axis=0), np.vstack([regs, many])
    right[1, :40] = regs[0, :40]
    n = np.full(len(left), 1496.0)
    for floor in (0.3, 0.52, 0.7):
        assert (near.likely(left, right, n, n, floor) == (near.likelihood(left, right, n, n) >= floor)).all()
    assert rng


def test_odd_rows(spark, odd_docs):
    rows = near.near_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by[None] == {(None, True)} and by[7] == {(6, False)} and by[6] == {(6, True)} and by[1] == {(1, True)}
    assert near.near_dedup(odd_docs.limit(0)).count() == 0


def test_recall_on_the_driver_s_documents(spark):
    """All components of the smaller tables, by comparing all pairs of sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    sizes, want = brute([texts[i] for i in ids])
    rows = {r.doc_id: r for r in near.near_dedup(docs).collect()}
    assert [rows[i].n_shingles for i in ids] == sizes and [rows[i].component_id for i in ids] == [ids[k] for k in want]
