import hashlib
import random
import re

from seqloom.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    out = []
    for d, w in enumerate(words):
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(500)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [make(rng.randint(45, 120)) for _ in range(6)]
    texts = [None, "", " \t", "x " * 120, "x " * 60, "y x " * 40]
    for _ in range(60):
        t = make(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            at = rng.randint(0, len(t))
            t[at:at] = p[a:]
        texts.append("\n".join(t))
        if rng.random() < 0.2:
            texts.append("  ".join(t))
    return texts


def test_removal_matches_brute_force(make_docs):
    for seed in (1, 2, 3):
        texts = corpus(seed)
        want = brute(texts)
        rows = sorted(substring.repeats(make_docs(texts), with_text=True).collect())
        assert [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in rows] == want
        for r in rows:
            assert sum(h - lo for lo, h in zip(r.lo, r.hi)) == r.n_removed and all(h - lo >= 50 for lo, h in zip(r.lo, r.hi))


def test_a_hot_seed_with_many_contexts(make_docs):
    """One passage in most texts, whole or cut on either side, with variants that leave its leader at different words."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(90)]
    texts = []
    for i in range(80):
        a, z = rng.choice([(0, 90), (0, 60), (25, 90), (10, 75), (0, 49)])
        t = passage[a:z]
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(["x", "y"])
        texts.append(" ".join([f"u{i % 7}"] * rng.randint(0, 30) + t + [f"v{i % 5}"] * rng.randint(0, 30)))
    rows = sorted(substring.repeats(make_docs(texts), with_text=True).collect())
    assert [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in rows] == brute(texts)


def test_ids_that_repeat_or_miss(make_docs):
    body = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"z{i}" for i in range(70))
    rows = substring.repeats(make_docs([body, body, other, body + " end", other, None, "few words"], ids=[1, 1, 1, 2, None, None, None])).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows)
    assert got == sorted([(1, 60, 0), (1, 60, 0), (1, 70, 0), (2, 61, 60), (0, 70, 70), (0, 0, 0), (0, 2, 0)])


def test_odd_rows(odd_docs):
    rows = substring.repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r.n_removed for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}
    assert substring.repeats(odd_docs.limit(0)).count() == 0
