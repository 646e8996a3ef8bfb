import bisect
import random
import re
from collections import defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from seqloom.llm import mixing
from seqloom.llm.common import ROW, numbered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, total, most=3):
    """Targets by resharing the excess until no source is above its most."""
    target, full = {}, set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = {s: weights[s] for s in sizes if s not in full}
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()} if open_ else {}
        above = {s for s in share if share[s] > most * sizes[s]}
        if not above:
            return {s: share.get(s, most * sizes[s]) for s in sizes}
        full |= above


def check(rows, sizes):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = {s: sum(r.size for r in by[s]) for s in by}
    want = fill(total, weights, sum(total.values()))
    for s, own in by.items():
        assert all(r.source_size == total[s] for r in own)
        assert all(r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) < 1.001
        for r in own:
            assert 0 <= r.taken <= 3 * r.size
            assert len(r.positions) == -(-r.taken // r.size) if r.size else r.taken == 0 and not r.positions
            assert r.positions == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)


def test_targets_and_words(make_docs, rng):
    texts, sources = [], []
    for i in range(400):
        texts.append(" ".join("w" for _ in range(rng.choice([0, 1, 5, 60, 900]))))
        sources.append(rng.choice(["a"] * 6 + ["b", "c", "d", "\U0001f600", None]))
    docs = make_docs(texts, sources)
    rows = mixing.mix(docs, bucket_rows=30).collect()
    assert {(r.doc_id, r.size) for r in rows} == {(i, len(WORD.findall(t))) for i, t in enumerate(texts)}
    check(rows, None)
    assert sorted(rows) == sorted(mixing.mix(docs, bucket_rows=30).collect())
    first = [r.positions[0] for r in rows if r.positions]
    assert first == sorted(first)


def test_odd_rows(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check(rows, None)
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_later_phases_move_words_not_targets(make_docs):
    docs = make_docs(["w " * 10] * 300, ["a"] * 100 + ["b"] * 100 + ["c"] * 100)
    flat = mixing.mix(docs, curriculum=((1.0, (1, 1, 1)),)).collect()
    bent = mixing.mix(docs).collect()
    taken = lambda rows: sorted((r.doc_id, r.taken) for r in rows)
    assert taken(flat) == taken(bent)
    mean = lambda rows, s: sum(p for r in rows if r.source == s for p in r.positions) / max(1, sum(len(r.positions) for r in rows if r.source == s))
    assert mean(bent, "c") > mean(flat, "c") and mean(bent, "a") < mean(flat, "a")


def test_positions_against_numeric_inversion(make_docs):
    """Weights integrated in small steps: a copy stands at the share of all tokens that are due when its begin is."""
    rng = random.Random(3)
    docs = make_docs(["w " * rng.randint(1, 30) for _ in range(240)], ["a"] * 100 + ["b"] * 60 + ["c"] * 70 + ["d"] * 10)
    rows = mixing.mix(docs, bucket_rows=20).collect()
    target = {r.source: r.target for r in rows}
    steps, total = 20_000, sum(target.values())
    factor = lambda i, t: next(f[i % 3] for end, f in mixing.CURRICULUM if t < end)
    rate = {s: [factor(i, (k + 0.5) / steps) for k in range(steps)] for i, s in enumerate("abcd")}
    rate = {s: [x * target[s] / sum(xs) for x in xs] for s, xs in rate.items()}
    due = {s: [0.0, *accumulate(xs)] for s, xs in rate.items()}
    all_due = [sum(due[s][k] for s in due) / total for k in range(steps + 1)]
    for s in "abcd":
        starts = sorted(p for r in rows if r.source == s for p in r.positions)
        sizes = {p: r for r in rows if r.source == s for p in r.positions}
        at, bins = 0, []
        for p in starts:
            bins.append(abs(p - all_due[bisect.bisect_left(due[s], at)]))
            r = sizes[p]
            at += r.size
        assert max(bins) < 1e-3
    # The mix is whole at every time: tokens due by a position are that share of all.
    words = sorted((p, r.size if k + 1 < len(r.positions) else r.last_words) for r in rows for k, p in enumerate(r.positions))
    done = 0
    for p, n in words:
        assert abs(done / total - p) < 0.03
        done += n


def test_training_order_cuts_the_last_copy(make_docs):
    docs = numbered(make_docs(["a b c d e f g"] * 20, ["x", "y"] * 10))
    plan = mixing.mix(docs, row_col=ROW)
    rows = mixing.training_order(docs, plan, ROW).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert sum(len(r.text.split()) for r in rows) == sum(r.taken for r in plan.collect())


def test_training_order_of_odd_rows(odd_docs):
    rows = numbered(odd_docs)
    plan = mixing.mix(rows, row_col=ROW)
    made = mixing.training_order(rows, plan, ROW).collect()
    assert len(made) == sum(len(r.positions) for r in plan.collect())
    assert sum(len(WORD.findall(r.text)) for r in made) == sum(r.taken for r in plan.collect())


def test_rows_without_an_id_are_spread(spark, make_docs, rng):
    """Half of the rows, one source, have no id: they go to as many buckets as others, and the mix is whole."""
    texts = [" ".join(["w"] * rng.randint(1, 9)) + f" {i}" for i in range(400)]
    docs = make_docs(texts, ids=[None if i % 2 else i for i in range(400)])
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.xxhash64("text").cast("string")))
    assert docs.where("doc_id is null").select(mixing.drawn(own, mixing.SEED)).distinct().count() == 200
    plan = mixing.mix(docs, bucket_rows=20).collect()
    sizes = [len(t.split()) for t in texts]
    assert len(plan) == 400 and sum(r.taken for r in plan) == sum(sizes) and sorted(r.size for r in plan) == sorted(sizes)
    assert all(r.taken == r.size for r in plan)
    again = mixing.mix(docs.repartition(3), bucket_rows=20).collect()
    assert sorted(map(repr, plan)) == sorted(map(repr, again))
