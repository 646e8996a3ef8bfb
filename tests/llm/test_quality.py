import random

import numpy as np
import pytest

from seqloom.llm import quality


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts, good = [], []
    for i in range(n):
        ok = i % 3 > 0
        t = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if not ok:
            t = [w + rng.choice(["$$$", "%%%"]) for w in t] if rng.random() < 0.5 else [w for w in t[:8] for _ in range(12)]
        texts.append(" ".join(t))
        good.append(int(ok))
    return texts, good


def test_held_out_labels(spark, make_docs):
    texts, good = corpus()
    docs = make_docs(texts + ["", None])
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)] + [(9999, None, 0), (None, 1, 0), (5, good[5], 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.cross_validated(docs, labels).collect()}
    assert len(rows) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    held = [i for i in range(400) if rows[i].held_out]
    assert np.mean([rows[i].predicted == good[i] for i in held]) > 0.95
    assert rows[400].score == rows[401].score == pytest.approx(np.mean([rows[400].score]))


def test_scores_are_exact_votes():
    texts, good = corpus(120)
    data = [t.encode() for t in texts]
    model = quality.Model.fit(data, np.array(good))
    terms = quality.Terms(model.idf)
    v = quality.project(*terms(data[:20]), model.basis)
    got = model.score(data[:20], terms)
    for x, s in zip(v, got):
        c = model.vectors @ x
        near = np.argsort(-c)[: model.neighbours]
        w = np.maximum(c[near], 0).astype(float) ** model.power
        assert s == pytest.approx((w @ model.labels[near] + 0.01 * model.labels.mean()) / (w.sum() + 0.01), abs=1e-5)


def test_parts_don_t_matter():
    texts, _ = corpus(50)
    data = [t.encode() for t in texts] + [b""]
    one = quality.Terms()(data)
    parts = [quality.Terms()([d]) for d in data]
    assert np.array_equal(one[0], np.concatenate([p[0] for p in parts])) and np.allclose(one[1], np.concatenate([p[1] for p in parts]))


def test_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.score == 0.5 for r in quality.cross_validated(odd_docs, none).collect())
    some = spark.createDataFrame([(5, 1), (6, 0), (8, 1)], "doc_id long, quality int")
    assert quality.cross_validated(odd_docs, some).count() == odd_docs.count()
    assert quality.cross_validated(odd_docs.limit(0), some).count() == 0
