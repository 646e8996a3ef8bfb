"""Alignments against brute force, trees on additive distances."""

import random
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from seqloom.operators import align, proteins, tree


def brute(a, b, local, open_, extend, sub):
    """Best score by memoised recursion over (i, j, state)."""
    from functools import lru_cache

    @lru_cache(None)
    def f(i, j, s):
        if i == 0 and j == 0:
            return 0.0 if s == 0 else -1e18
        out = -1e18
        if s == 0 and i and j:
            out = max(f(i - 1, j - 1, t) for t in range(3)) + sub(a[i - 1], b[j - 1])
            if local:
                out = max(out, sub(a[i - 1], b[j - 1]))
        if s == 1 and i:
            out = max(f(i - 1, j, t) + (extend if t == 1 else open_) for t in range(3))
        if s == 2 and j:
            out = max(f(i, j - 1, t) + (extend if t == 2 else open_) for t in range(3))
        return out

    if local:
        return max([0.0] + [f(i, j, 0) for i in range(len(a) + 1) for j in range(len(b) + 1)])
    return max(f(len(a), len(b), s) for s in range(3))


def test_scores_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("ARND") for _ in range(rng.randint(1, 9))) for _ in range(2))
        one = lambda x, y: float(x == y)
        blo = lambda x, y: align.BLOSUM62[align.RESIDUES.index(x), align.RESIDUES.index(y)]
        assert align.align(a, b, False, -0.5, -0.1)[0] == pytest.approx(brute(a, b, False, -0.5, -0.1, one))
        assert align.align(a, b, False, -10, -0.5, align.BLOSUM62)[0] == pytest.approx(brute(a, b, False, -10, -0.5, blo))
        score, pairs = align.align(a, b, True, -11, -1, align.BLOSUM62)
        assert score == pytest.approx(brute(a, b, True, -11, -1, blo))
        assert pairs == sorted(set(pairs))


def test_statistics():
    assert align.identity("ACGT", "ACGT") == 100 and align.identity("", "A") == 0 and align.identity(None, "A") == 0
    assert align.residue_identity("ARND", "ARN") == pytest.approx(0.75)
    score, same, cover = align.local_stats("MKVLAAGG", "TTMKVLTT")
    assert same == 100 and cover == 50 and score == sum(align.BLOSUM62[align.RESIDUES.index(c)][align.RESIDUES.index(c)] for c in "MKVL")


def test_matrix_is_symmetric():
    assert align.BLOSUM62.shape == (24, 24) and (align.BLOSUM62 == align.BLOSUM62.T).all()
    cell = lambda a, b: align.BLOSUM62[align.RESIDUES.index(a), align.RESIDUES.index(b)]
    published = {"XA": 0, "XS": 0, "XT": 0, "XC": -2, "XP": -2, "XW": -2, "XX": -1, "BN": 3, "BD": 4, "ZQ": 3, "ZE": 4, "BZ": 1, "*A": -4, "**": 1, "WW": 11}
    assert {k: cell(*k) for k in published} == published


def test_best_hits_assignment_and_reciprocity(spark):
    q = spark.createDataFrame([("q1", "MKVLAAGGHHTRESW"), ("q2", "MKVLAAGGHHTREAA")], "seq_id string, seq string")
    t = spark.createDataFrame([("t1", "MKVLAAGGHHTRESW"), ("t2", "GGMKVLAAGGHHTREAAGG"), ("t3", "WWWWWWWWWWWW")], "seq_id string, seq string")
    h = align.best_hits(q, t)
    first = {r.qid: r.tid for r in h.where("rank = 1").collect()}
    assert first == {"q1": "t1", "q2": "t2"} and h.where("tid = 't3'").count() == 0
    scores = h.withColumnRenamed("rank", "ord")
    got = {r.qid: r.tid for r in align.assign_one_to_one(scores, ["q1", "q2"]).collect()}
    assert got == first
    back = align.best_hits(t, q)
    assert all(r.reciprocal for r in align.reciprocal(h.where("rank = 1"), back).collect())


def local_score(a, b):
    """Best local score by plain loops over cells: a pair, a gap in either (-11, then -1 a letter)."""
    sub = {(x, y): align.BLOSUM62[i][j] for i, x in enumerate(align.RESIDUES) for j, y in enumerate(align.RESIDUES)}
    known = lambda x: x if x in align.RESIDUES else "X"
    best, pair, down, side = 0.0, [0.0] * (len(b) + 1), [-1e9] * (len(b) + 1), [-1e9] * (len(b) + 1)
    for x in a:
        p2, d2, s2 = [0.0] * (len(b) + 1), [-1e9] * (len(b) + 1), [-1e9] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            p2[j] = max(0.0, pair[j - 1], down[j - 1], side[j - 1]) + sub[known(x), known(y)]
            d2[j] = max(pair[j] - 11, side[j] - 11, down[j] - 1)
            s2[j] = max(p2[j - 1] - 11, d2[j - 1] - 11, s2[j - 1] - 1)
            p2[j] = max(p2[j], 0.0)
            best = max(best, p2[j])
        pair, down, side = p2, d2, s2
    return best


def test_best_hits_on_given_rows(spark):
    """Short documents against parts of benchmark passages: every pair that shares a word is scored as by plain loops, and
    the winners are those of the prefilter with the best scores."""
    letters = lambda t: "".join(c for c in (t or "").upper() if "A" <= c <= "Z")
    rows = lambda name, c, t: [(r[0], letters(r[1])) for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(c, t).collect()]
    queries = [(i, s[:120]) for i, s in sorted(rows("benchmark", "item_id", "text"))[:4]]
    targets = sorted((r for r in rows("documents", "doc_id", "text") if 60 < len(r[1]) < 220), key=lambda r: r[0])[:12] + [(10**6 + i, s[20:100] + s[10:40]) for i, s in queries]
    make = lambda x: spark.createDataFrame(x, "seq_id long, seq string")
    got = align.best_hits(make(queries), make(targets), 5, 6).collect()
    words = lambda s: {s[p : p + 5] for p in range(len(s) - 4)}
    for q, s in queries:
        shared = sorted(((len(words(s) & words(t)), i) for i, t in targets if words(s) & words(t)), reverse=True)[:6]
        score = {i: local_score(s, dict(targets)[i]) for _, i in shared}
        order = sorted(range(len(shared)), key=lambda k: (-score[shared[k][1]], k))
        mine = sorted((r for r in got if r.qid == q), key=lambda r: r.rank)
        assert [(r.tid, r.shared) for r in mine] == [shared[k][::-1] for k in order] and len(mine) >= 1
        assert all(r.score == pytest.approx(score[r.tid]) and 0 < r.identity <= 100 and 0 < r.coverage <= 100 for r in mine)


def test_conservation_by_hand(spark):
    """Fingers of two proteins are paired in order; the mean share of equal residues of the pairs that both have."""
    finger = lambda h: f"CAACK{h}HAAH"
    left = "MM" + finger("AAAAAAAA") + "GGGGGGGGG" + finger("RRRRRRRR")
    pairs = [("a", left, left), ("b", left, "MM" + finger("AAAAAARA") + "GGGGGGGGG" + finger("RRRRRRRR") + "GGGGGGGGG" + finger("DDDDDDDD")), ("c", left, finger("WWWWWWWW")), ("d", left, "MMMM"), ("e", None, left)]
    got = {r.paralog: r.recognition_conservation for r in proteins.conservation(spark.createDataFrame(pairs, "paralog string, left string, right string")).collect()}
    helix = [r[0] for r in spark.createDataFrame([(left,)], "s string").select(proteins.helices(F.col("s"))).collect()][0]
    assert [len(h) for h in helix] == [9, 9]
    assert got == {"a": 1.0, "b": round((8 / 9 + 1) / 2, 2), "c": round(1 / 9, 2)}


def test_assignment_is_the_best_of_all(spark):
    """Random problems with ties and missing candidates, against all choices; the order decides among equals."""
    rng = random.Random(21)
    queries, rows, want = [f"q{i}" for i in range(5)], [], {}
    for p in range(30):
        n = rng.randint(4, 8)
        cells = {}
        for q in queries:
            some = rng.sample(range(n), rng.randint(1, n))
            for o, t in enumerate(some):
                cells[q, f"t{t}"] = (rng.choice([1.0, 2.0, 2.5, 0.1, 0.2, 0.3]) if p % 2 else float(rng.randint(0, 3)), o)
        rows += [(p, q, t, x, o) for (q, t), (x, o) in cells.items()]
        best = None
        for choice in permutations([f"t{t}" for t in range(n)], 5):
            if all((q, t) in cells for q, t in zip(queries, choice)):
                total = sum(Fraction(cells[q, t][0]) for q, t in zip(queries, choice))
                key = (-total, [cells[q, t][1] for q, t in zip(queries, choice)])
                best = min(best, (key, choice)) if best else (key, choice)
        if best:
            want[p] = dict(zip(queries, best[1]))
    df = spark.createDataFrame(rows, "p long, qid string, tid string, score double, ord int")
    got = {}
    for r in align.assign_one_to_one(df, queries, by=["p"]).collect():
        got.setdefault(r.p, {})[r.qid] = r.tid
    assert got == want and 5 < len(want) < 30
    one = {r.qid: r.tid for r in align.assign_one_to_one(df.where(f"p = {min(want)}"), queries).collect()}
    assert one == want[min(want)]
    assert "NestedLoop" not in align.assign_one_to_one(df, queries)._jdf.queryExecution().executedPlan().toString()
    assert align.assign_one_to_one(df.limit(0), queries).collect() == []


def test_neighbour_joining_is_exact_on_additive_distances():
    edges = [("#a", "w", 2.0), ("#a", "x", 3.0), ("#b", "#a", 1.5), ("#b", "y", 4.0), ("#b", "z", 9.0)]
    near = tree._around(edges)

    def dist(a, b):
        stack, seen = [(a, 0.0)], {a}
        while stack:
            n, d = stack.pop()
            if n == b:
                return d
            for m, w in near[n]:
                if m not in seen:
                    seen.add(m)
                    stack.append((m, d + w))

    names = ["w", "x", "y", "z"]
    d = np.array([[dist(a, b) if a != b else 0.0 for b in names] for a in names])
    made = tree.neighbour_joining(names, d)
    near = tree._around(made)
    again = np.array([[dist(a, b) if a != b else 0.0 for b in names] for a in names])
    assert np.allclose(d, again)
    rooted = tree.midpoint_root(made)
    assert frozenset("wx") in tree.splits(rooted).values() or frozenset("yz") in tree.splits(rooted).values()
    depth = {"#root": 0.0}
    for a, b, w in rooted:
        depth[b] = depth[a] + w
    assert max(depth[n] for n in names) == pytest.approx(dist("x", "z") / 2)


def test_newick_round_trip():
    text = "((Cel_a:0.1,Cel_b:0.2):0.05,(x:0.3,y:0.4):0.01):0.0;"
    edges = tree.parse_newick(text)
    tips = {b for _, b, _ in edges} - {a for a, _, _ in edges}
    assert tips == {"Cel_a", "Cel_b", "x", "y"} and sum(w for _, _, w in edges) == pytest.approx(1.06)
    assert tree.sister(edges, "x") == ["y"]


def test_bootstraps(spark):
    rows = [("a", "ARNDARNDARNDARNDARND"), ("b", "ARNDARNDARNDARNDARNE"), ("c", "WWWWCCCCWWWWCCCCWWWW"), ("d", "WWWWCCCCWWWWCCCCWWWF")]
    out = tree.gene_tree(spark, spark.createDataFrame(rows, "name string, aligned string"), 20).collect()
    assert all(r.n_tips == 4 for r in out)
    assert max(r.support for r in out if set(r.clade) in ({"a", "b"}, {"c", "d"})) == 1.0
    assert out[0].consensus.replace(":0.00000", "") in ("((c,d)#,a,b);".replace("#", ""), "((b,c,d),a);", "(a,b,(c,d));", "(a,(b,(c,d)));", "((c,d),a,b);")
    assert sorted(x.split("- ")[-1] for x in out[0].picture.split("\n")) == ["a", "b", "c", "d"]
    again = tree.gene_tree(spark, spark.createDataFrame(rows, "name string, aligned string"), 20).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_ortholog_hits_finds_the_best_alignment(spark, tmp_path):
    """The winners of the registered query are those of brute force, also with no 12 letters in common and many copies."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    q = [word(120) for _ in range(3)]
    docs = []
    for i, s in enumerate(q):
        far = list(s)
        for k in range(5, 120, 8):  # seven equal letters at most
            far[k] = "A" if far[k] != "A" else "W"
        docs.append((10 * i, "".join(far)))
        docs += [(10 * i + k, word(30) + s[30:54] + word(60)) for k in range(1, 6)]  # thirteen 12-mers each
    spark.createDataFrame(list(enumerate(q)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.qid: (r.tid, r.score) for r in entry.queries()["ortholog_hits"](spark, str(tmp_path)).where("rank = 1").collect()}
    for i, s in enumerate(q):
        score, tid = max((align.local_stats(s, t)[0], d) for d, t in docs)
        assert got[i] == (tid, score) and tid == 10 * i
