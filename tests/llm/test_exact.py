import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import exact

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[(t or "").translate(FOLD)].append(d)
    out = []
    for d, t in docs:
        key = (t or "").translate(FOLD)
        ids = [x for x in groups[key] if x is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[key]), d == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("keys,rows", [(exact.SHARD_KEYS, exact.TASK_ROWS), (7, 3)])
def test_groups_match_brute_force(make_docs, monkeypatch, keys, rows):
    monkeypatch.setattr(exact.build_index, "__defaults__", (keys,))
    monkeypatch.setattr(exact.lookup, "__defaults__", (rows,))
    rng = random.Random(1)
    texts = [rng.choice(["a", "A", "b", "É", "é", "", None, " a", "hot"] + ["hot"] * 8 + [f"t{i}" for i in range(20)]) for _ in range(300)]
    assert got(exact.exact_dedup(make_docs(texts))) == brute(list(enumerate(texts)))


def test_history_wins_and_nonmembers_group_apart(spark, make_docs):
    old = make_docs(["seen", "SEEN", "other"], ids=[100, 101, 50])
    history = exact.winners(exact.digest_rows(old)).select("digest", "keep_id", "n")
    rows = {r.doc_id: r for r in exact.exact_dedup(make_docs(["Seen", "new", "NEW", "other"], ids=[1, 2, 3, 50]), history=history).collect()}
    assert (rows[1].keep_id, rows[1].kept) == (101, False) and (rows[50].keep_id, rows[50].kept) == (50, True)
    assert (rows[2].keep_id, rows[2].kept, rows[2].group_size) == (3, False, 2) and rows[3].kept


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(exact.exact_dedup(odd_docs)) == brute(rows)
    assert exact.exact_dedup(odd_docs.limit(0)).count() == 0
    nulls = odd_docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert all(r.kept and r.keep_id is None for r in exact.exact_dedup(nulls).collect())


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 2**63, (5000, 4), dtype=np.uint64)
    sizes, bits = exact.build_mph(keys)
    assert sorted(exact.slots(keys, sizes, bits)) == list(range(5000))
    with pytest.raises(ValueError):
        exact.build_mph(np.zeros((2, 4), np.uint64))
