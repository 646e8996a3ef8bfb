import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from seqloom.llm import packing

PATH = P.path("byte_bpe_50k.json")
ODD = ["", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>x", "a  b\n \n c \t", "é́  x", " \x85   y　z", "'S 's I'll", "\U0001f600 ١٢٣ ½", "\0�", "   ", "word" * 3000]


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_ids_are_the_library_s():
    encode, _ = packing.load(PATH)
    for t in ODD:
        assert list(encode(t)) == library(t)


def check(rows, texts, window=1024):
    encode, _ = packing.load(PATH)
    ids = {d: [*encode(t or ""), 0] for d, t in texts.items()}
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for d, own in by.items():
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    pad = total = 0
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
        total += at
        pad += 0 if at & (at - 1) == 0 else window - at
    assert len(seqs) <= 1.1 * total / window + 8
    return pad / max(total, 1)


def test_pieces(make_docs):
    rng = random.Random(1)
    texts = dict(enumerate(ODD + [None] + [" ".join(rng.choice(["the", "ofen", "Straße.", "x,", "qua\n"]) for _ in range(rng.choice([0, 5, 300, 6000]))) for _ in range(120)]))
    rows = packing.pack(make_docs(list(texts.values())).coalesce(2), PATH, block=5000).collect()
    assert check(rows, texts) < 0.05


def short_of(n, window):
    return (window - n) * (packing.UNDERFILL if n & (n - 1) == 0 and n >= packing.SHORTEST else 1)


def brute_cost(at, penalty, window):
    places = [0, *at]
    best = [0.0] + [float("inf")] * len(at)
    for k in range(1, len(places)):
        for i in range(k):
            n = places[k] - places[i]
            if n <= window:
                best[k] = min(best[k], best[i] + short_of(n, window) + penalty[k - 1] + packing.EACH)
    return best[-1]


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    at = np.cumsum([rng.randint(1, packing.STRIDE) for _ in range(200)])
    penalty = np.array([rng.choice(packing.PENALTY) for _ in at], float)
    window = 256
    ends = packing.cuts(int(at[-1]), at, penalty, window)
    cost = dict(zip(at.tolist(), penalty))
    total, before = 0.0, 0
    for e in ends:
        n = e - before
        assert 0 < n <= window
        total += short_of(n, window) + cost[e] + packing.EACH
        before = e
    assert before == at[-1] and total == pytest.approx(brute_cost(at.tolist(), penalty.tolist(), window))


def test_odd_rows(odd_docs):
    rows = packing.pack(odd_docs, PATH).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}
    assert sum(r.length for r in rows if r.doc_id == 6) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 6)
    assert packing.pack(odd_docs.limit(0), PATH).count() == 0
