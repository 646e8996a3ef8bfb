"""Hand-made cases for sequence, position, matrix and vector operators."""

import random
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seqloom.functions import reference_values as V
from seqloom.functions import sequence as S
from seqloom.operators import discovery, hits, kmers, matches, proteins, pwm, vectors
from seqloom.plans import tables as D

COMP = str.maketrans("ACGTN", "TGCAN")


def rc(s):
    return "".join(c if c in "ACGT" else "N" for c in s.upper()).translate(COMP)[::-1]


def seqs(spark, *rows):
    return spark.createDataFrame([(i, g, s) for i, (g, s) in enumerate(rows)], "seq_id long, grp string, seq string")


def rand_dna(rng, n, alphabet="ACGTN"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_windows_across_tiles(spark):
    rng = random.Random(1)
    s = rand_dna(rng, 1000)
    rows = kmers.windows(seqs(spark, ("a", s), ("b", "ACG"), ("c", "")), 7, tile=64).collect()
    assert sorted((r.pos, r.kmer) for r in rows if r.grp == "a") == [(i, s[i : i + 7]) for i in range(994)]
    assert not [r for r in rows if r.grp != "a"]


def test_kmer_counts_are_canonical_and_skip_n(spark):
    s = "acgtNacgtTTGGN"
    want = Counter(min(k, rc(k)) for k in (s.upper()[i : i + 3] for i in range(len(s) - 2)) if "N" not in k)
    got = {r.kmer: r.cnt for r in kmers.count_kmers(seqs(spark, ("a", s)), 3).collect()}
    assert got == dict(want)


def test_scan_finds_overlaps_and_palindromes_twice(spark):
    pats = spark.createDataFrame([("r", "AA"), ("p", "ACGT"), ("lower", "ttggtc")], "name string, motif string")
    got = sorted((r.name, r.position, r.strand) for r in kmers.scan(seqs(spark, ("a", "AAAAcgtTTGGTCgaccaa")), pats, 0).collect())
    text = "AAAACGTTTGGTCGACCAA"
    want = sorted((n, i, s) for n, m in (("r", "AA"), ("p", "ACGT"), ("lower", "TTGGTC")) for s, p in (("+", m), ("-", rc(m))) for i in range(len(text)) if text.startswith(p, i))
    assert got == want
    assert kmers.scan(seqs(spark, ("a", "AAAA")), pats, 5).count() == 0


def test_anchored_windows_edges(spark):
    rng = random.Random(2)
    for s in ("TTGGACGT", "TTGGACGTA", "CCAATTTTTTT", "ACGTCCAATTTTT", "CCAATTGGNACGTACGT", rand_dna(rng, 400, "ACGTTGGCCAA")):
        want, n, length = [], len(s), 8
        for i in range(n - length):
            if s.startswith("TTGG", i):
                w, strand = s[i : i + length], "+"
            elif s.startswith("CCAA", i) and i >= length - 4:
                w, strand = rc(s[i - (length - 4) : i + 4]), "-"
            else:
                continue
            if "N" not in w:
                want.append((i, strand, w))
        got = sorted((r.pos, r.strand, r.window) for r in kmers.anchored_windows(seqs(spark, ("a", s)), length).collect())
        assert got == sorted(want)


def test_scalar_functions(spark):
    rows = [("TTGGCTTGGCTT",), ("ACACAC",), ("AAAT",), ("TTGGATTTGTCT",), ("CCAAGTGCCAA",), ("ACGTACGTACG",), ("TTGG",)]
    df = spark.createDataFrame(rows, "m string")
    m = F.col("m")
    got = {r.m: r for r in df.select("m", S.low_complexity(m).alias("low"), S.framework_spacer(m).alias("sp"), S.orient(m).alias("o"), S.hamming(m, F.lit("TTGGAT")).alias("h"), S.starts_either_strand(m).alias("e")).collect()}
    assert not got["TTGGCTTGGCTT"].low and got["ACACAC"].low and got["AAAT"].low and not got["ACGTACGTACG"].low
    assert got["TTGGATTTGTCT"].sp == 3 and got["TTGG"].sp is None and got["TTGGCTTGGCTT"].sp == 2
    assert got["CCAAGTGCCAA"].o == rc("CCAAGTGCCAA") and got["ACACAC"].o is None and got["CCAAGTGCCAA"].e
    for r in got.values():
        assert r.h == sum(a != b for a, b in zip(r.m, "TTGGAT"))


def test_header_fields(spark):
    df = spark.createDataFrame([("P1 a=1 plain b=x=y a=2",), ("P2",)], "h string")
    got = [r.f for r in df.select(S.header_fields(F.col("h")).alias("f")).collect()]
    assert got == [{"id": "P1", "a": "2", "b": "x=y"}, {"id": "P2"}]


def test_similar_pairs_find_all(spark):
    rng = random.Random(3)
    words = sorted({rand_dna(rng, 8, "AC") for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "window string")
    cores = spark.createDataFrame([(w,) for w in words[:20]], "core string")
    got = {(r.window, r.core) for r in kmers.similar_pairs(df, cores, 2, 8).collect()}
    assert got == {(w, c) for w in words for c in words[:20] if sum(a != b for a, b in zip(w, c)) <= 2}


def brute_window(pos, width, step, close):
    lo, hi = min(pos), max(pos)
    grid = range(lo, hi - width + (1 if close else 0), step)
    best = None
    for w in grid:
        n = sum(w <= p < w + width for p in pos)
        if n and (best is None or n > best[1]):
            best = (w, n)
    return best


def test_densest_windows(spark):
    rng = random.Random(4)
    groups = {f"g{i}": sorted(rng.randrange(rng.choice([80, 400, 3000])) for _ in range(rng.randint(1, 30))) for i in range(30)}
    df = spark.createDataFrame([(g, p % 2, p) for g, ps in groups.items() for p in ps], "g string, e long, pos long")
    got = {r.g: (r.w0, r.n) for r in hits.densest_window(df, ["g"], "pos", 100, 10).collect()}
    for g, ps in groups.items():
        assert got[g] == (brute_window(ps, 100, 10, False) or (0, sum(0 <= p < 100 for p in ps)))
    got = {r.g: (r.e, r.w0, r.n) for r in hits.densest_window_or_none(df, ["g"], "e", "pos", 5, 100, 10).collect()}
    for g, ps in groups.items():
        best = None
        for e in (0, 1):
            own = [p for p in ps if p % 2 == e]
            b = brute_window(own, 100, 10, True) if len(own) >= 5 else None
            if b and (best is None or b[1] > best[2]):
                best = (e, *b)
        assert got.get(g) == best


def test_first_non_null_and_median(spark):
    df = spark.createDataFrame([("a", 2, None, "x"), ("a", 1, 5, "y"), ("b", 1, None, None)], "k string, s int, v int, w string")
    got = {r.k: (r.v, r.w) for r in hits.first_non_null(df, ["k"], [("s", True)], ["v", "w"]).collect()}
    assert got == {"a": (5, "x"), "b": (None, None)}
    p = spark.createDataFrame([("a", 0), ("a", 2), ("a", 7), ("b", 1), ("b", 9)], "k string, p int")
    assert {r.k: r.period for r in hits.median_gap(p, ["k"], "p").collect()} == {"a": 3, "b": None}


def test_compare_and_density(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n long"), spark.createDataFrame([("y", 5), ("z", 7)], "k string, n long")
    assert {tuple(r) for r in hits.compare_counts(a, b, ["k"]).collect()} == {("x", 1, 0), ("y", 2, 5), ("z", 0, 7)}
    d = spark.createDataFrame([("x", p) for p in (0, 9, 10, 20)], "k string, p int")
    assert {r.bin: r.n for r in hits.density(d, ["k"], "p", 10, 0, 20).collect()} == {0: 2, 1: 2}


def test_oligo_matrix_coverage_and_consensus(spark):
    o = spark.createDataFrame([("f", 0, "ACG"), ("f", 1, "CGT"), ("f", 0, "NNN"), ("f", 0, "AC")], "k string, offset int, oligo string")
    got = {r.pos: r for r in pwm.build(o, ["k"]).collect()}
    assert sorted(got) == [0, 1, 2] and [got[i].base for i in range(3)] == ["A", "C", "G"]
    assert got[0].a == pytest.approx(2.25 / 3.0) and got[0].coverage == 2


def test_metric_invariants(spark):
    m = D.motifs(spark)
    truth = pwm.of_motifs(m, ["name"])
    spacers = m.select("name", "spacer")
    assert all(r.skill == pytest.approx(1) and r.distance == 0 for r in pwm.evaluate(truth, truth, spacers, ["name"]).collect())
    flat = truth.select("name", "pos", *[F.lit(0.25).alias(b) for b in "acgt"])
    for r in pwm.evaluate(flat, truth, spacers, ["name"]).collect():
        assert r.skill == pytest.approx(0) and r.distance == pytest.approx(0.8327167344081142)
        assert r.n_variable == {"HIM-8": 6, "ZIM-1": 5, "ZIM-2": 6, "ZIM-3": 6}[r.name]
    with pytest.raises(ValueError):
        S.column_distance([F.lit(1)], [F.lit(1)], "other")


def test_transfer_scores_match_published_ones(spark):
    want = {("ZIM-1", "HIM-8"): 0.9574826113282312, ("ZIM-3", "ZIM-1"): 1.2543999333224651, ("ZIM-3", "ZIM-2"): 1.0962687337295833}
    m = D.motifs(spark)
    side = lambda n: m.select(F.col("name").alias(n), F.col("spacer").alias(f"{n}_spacer"), F.length("motif").alias(f"{n}_len"))
    pairs = side("src").crossJoin(side("dst")).where("src <> dst").withColumn("case", F.concat_ws(">", "src", "dst"))
    moved = pwm.transfer(pairs, pwm.of_motifs(m.withColumnRenamed("name", "id"), ["id"]))
    truth = pairs.select("case", "dst").join(pwm.of_motifs(m, ["name"]).withColumnRenamed("name", "dst"), "dst").drop("dst")
    graded = pwm.evaluate(moved, truth, pairs.select("case", F.col("dst_spacer").alias("spacer")), ["case"])
    got = {(r.src, r.dst): r.distance for r in graded.join(pairs.select("case", "src", "dst"), "case").collect()}
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_unknown_letter_and_information(spark):
    df = spark.createDataFrame([("AN",)], "motif string").withColumn("id", F.lit("x"))
    r = {x.pos: x for x in pwm.of_motifs(df, ["id"]).collect()}
    assert r[1].a == r[1].t == 0.25 and r[0].a == pytest.approx(1.01 / 1.04)
    assert spark.range(1).select(S.information(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()[0] == 2.0


def test_best_match_recovers_the_known_motif(spark):
    m = D.motifs(spark)
    cases = pwm.of_motifs(m.withColumnRenamed("name", "case"), ["case", "spacer"])
    assert {r.case: r.name for r in pwm.best_match(cases, m).collect()} == {n: n for n in V.KNOWN_MOTIFS}


RUN = "chromosome string, discovered_motif string, spacer int, cluster_pos_Mb double, dist_from_end_kb int, copies int, period_bp int, downstream_bits double, chrom_specificity double, ce_paralog string, ce_match_skill double, confidence string"


def test_reconciled_sheet(spark):
    row = lambda c, motif, kb, period, bits, near: (c, motif, 2, 1.0, kb, 50, period, bits, 0.5, near, 0.1, "LOW")
    one = [row("c1", "TTGGAAAAAAAA", 100, 50, 9.0, "P1"), row("c2", "TTGGCCCCCCCC", 2000, 50, 9.0, "P1"), row("c3", "TTGGAAAAAAAA", 100, 50, 2.0, "P3"), row("c4", "TTGGAAAAAAAA", 100, None, 9.0, "P1"), row("c5", "TTGGAAAAAAAA", 2000, 50, 9.0, "P1")]
    two = [row("c1", "TTGGAAAAAACC", 100, 50, 9.0, "P1"), row("c2", "TTGGCCCCCCCC", 100, 50, 9.0, "P1"), row("c3", "TTGGAAAAAAAA", 100, 50, 9.0, "P1"), row("c4", "TTGGAAAAAAAA", 100, 50, 9.0, "P1"), row("c5", "TTGGGGGGGGGG", 1, 50, 9.0, "P1")]
    para = spark.createDataFrame([(f"c{i}", f"P{i}") for i in range(1, 6)], "chromosome string, paralog string")
    rows = discovery.reconcile(spark.createDataFrame(one, RUN), spark.createDataFrame(two, RUN), para).collect()
    assert [(r.chromosome, r.confidence, r.reproduced_on_AF16, r.assignment_agrees) for r in rows] == [("c1", "HIGH", True, True), ("c2", "MEDIUM", True, False), ("c3", "LOW", True, True), ("c4", "LOW", True, False), ("c5", "LOW", False, False)]


def test_permutation_null_is_exact(spark):
    p = [("a", "a"), ("b", "b"), ("a", "c")]
    r = discovery.permutation_null(spark.createDataFrame(p, "predicted string, expected string")).first()
    counts = [sum(x[0] == p[j][1] for x, j in zip(p, q)) for q in permutations(range(3))]
    assert r.matches == 2 and r.mean_null == pytest.approx(np.mean(counts)) and r.p_value == pytest.approx(np.mean([c >= 2 for c in counts]))


def test_published_convergence(spark):
    q = [("X", "ZIM-2"), ("II", "ZIM-3"), ("III", "ZIM-1"), ("V", "ZIM-2"), ("I", "ZIM-3"), ("IV", "ZIM-3")]
    pairs = spark.createDataFrame([(p, V.CHROMOSOME_PARALOG[c]) for c, p in q], "predicted string, expected string")
    r = discovery.permutation_null(pairs, 4).first()
    assert r.matches == 4 and 0 < r.p_value < 0.2


def test_fingers(spark):
    s = "MMCAACAAAAAAAAAAHAAHGGGGGCBBBCKKKKKKKKKHKKKHTAIL"
    df = proteins.with_fingers(spark.createDataFrame([(s,), ("AAAA",), (None,)], "seq string"))
    r = df.select("fingers", proteins.recognition_residues(F.col("seq")).alias("res"), proteins.tail_region(F.col("seq"), F.col("fingers")).alias("tail"), proteins.domain(F.col("seq")).alias("dom"), F.size(proteins.recognition_positions(F.col("fingers"))).alias("n")).collect()
    assert r[0].res == "AAAAAAAAAA" + "KKKKKKKKK" and r[0].n == 19 and s[r[0].tail.start :] == "TAIL" and r[0].dom.start == 0
    assert r[1].tail is None and r[1].dom is None and r[1].fingers == []


def test_leave_one_out_uses_training_rows_only(spark):
    rng = np.random.default_rng(0)
    x = {f"l{i}": rng.normal(size=5) for i in range(6)}
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in x.items()], "label string, vector array<double>")
    for r in vectors.leave_one_out_neighbours(df).collect():
        rest = {k: v for k, v in x.items() if k != r.held}
        mean = np.mean(list(rest.values()), axis=0)
        cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        best = max(rest, key=lambda k: (cos(x[r.held] - mean, rest[k] - mean), k))
        assert r.other == best and r.cosine == pytest.approx(cos(x[r.held] - mean, rest[best] - mean))


def test_pls_fits_what_is_linear(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = x @ rng.normal(size=(4, 2)) + 3
    rows = [Row(x=[float(v) for v in a], y=[float(v) for v in b]) for a, b in zip(x, y)]
    m = vectors.pls(spark.createDataFrame([*rows, Row(x=[float("nan")] * 4, y=[0.0, 0.0])]), "x", "y", 4)
    assert m["n"] == 60 and m["r2"] == pytest.approx(1)
    one = vectors.pls(spark.createDataFrame(rows), "x", "y", 1)
    xc, yc = x - x.mean(0), y - y.mean(0)
    w = np.linalg.svd(xc.T @ yc)[0][:, 0]
    t = xc @ w
    fit = np.outer(t, yc.T @ t / (t @ t))
    assert one["r2"] == pytest.approx(1 - ((yc - fit) ** 2).sum() / (yc**2).sum())


def test_heads_sum_to_one_and_shrink(spark):
    rows = [("f", l2, 0, [1.0, 0.0], [1.0, 0.0, 0.0, 0.0]) for l2 in (0.1, 100.0)] + [("f", l2, 0, [0.0, 1.0], [0.0, 1.0, 0.0, 0.0]) for l2 in (0.1, 100.0)]
    heads = vectors.train_heads(spark.createDataFrame(rows, "fold string, l2 double, slot int, x array<double>, y array<double>"), 200)
    got = {r.l2: r for r in vectors.predict_heads(heads, spark.createDataFrame([("f", [1.0, 0.0])], "fold string, x array<double>")).collect()}
    assert all(r.a + r.c + r.g + r.t == pytest.approx(1) for r in got.values())
    assert got[0.1].a > got[100.0].a > got[100.0].g


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], 1, 3, [0, 2])], "v array<array<double>>, a int, b int, p array<int>")
    assert vectors.pool(df, "v").first().pooled == [3.0, 4.0]
    assert vectors.pool(df, "v", "a", "b").first().pooled == [4.0, 5.0]
    assert vectors.pool(df, "v", positions="p").first().pooled == [3.0, 4.0]


def test_anchored_discovery_finds_a_planted_motif(spark):
    rng = random.Random(5)
    s = list(rand_dna(rng, 6000, "ACGT"))
    motif = "TTGGTCTGCTAA"
    for i in range(30):
        s[1000 + 100 * i : 1012 + 100 * i] = motif
    df = seqs(spark, ("X", "".join(s)))
    w = discovery.end_windows(df, 12, 3000)
    got = discovery.best_end(discovery.refine_anchored(w, spark.createDataFrame([("X", motif)], "grp string, seed string"))).collect()
    assert len(got) == 1 and got[0].motif == motif and got[0].period == 100


def test_free_refinement_finds_a_planted_motif(spark):
    rng = random.Random(6)
    s = list(rand_dna(rng, 5000, "ACGT"))
    motif = "GTGATAGTTGAA"
    for i in range(20):
        s[500 + 90 * i : 512 + 90 * i] = motif if i % 2 else rc(motif)
    df = seqs(spark, ("X", "".join(s)))
    w = discovery.region_windows(df, spark.createDataFrame([("X", 0, 0)], "grp string, seq_id long, start long"), 12)
    got = discovery.refine_free(w, spark.createDataFrame([("X", motif)], "grp string, seed string"), 12).first()
    assert got.motif == motif and got.copies >= 20 and got.period == 90


def test_nearest_in_blocks_is_the_same(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)], "id long, vector array<double>")
    q = df.where("id % 3 = 0")
    for n in (1, 4):
        one = sorted(vectors.nearest(q, df, n).collect())
        assert len(one) == 20 * n and one == sorted(vectors.nearest(q, df, n, block=6).collect())


def test_lopo_head_against_plain_loops(spark):
    """Centring, projection, scaling, descent and grading, one held-out name after the other."""
    rng = np.random.default_rng(4)
    names = list(V.KNOWN_MOTIFS)
    x = {n: rng.normal(size=6) for n in names}
    m = D.motifs(spark)
    df = spark.createDataFrame([(n, [float(v) for v in x[n]]) for n in names], "name string, vector array<double>")
    projection = rng.normal(size=(6, 3))
    weights = lambda motif: np.array([[1.01 / 1.04 if b == c else 0.01 / 1.04 for b in "ACGT"] for c in motif])

    def slots(n):
        s, w = V.SPACERS[n], weights(V.KNOWN_MOTIFS[n])
        at = {p: p - s if 4 <= p < 4 + s else 4 + p - 6 - s for p in range(len(w)) if 4 <= p < 4 + s or 6 + s <= p < 11 + s}
        return w, at

    for p in (None, projection):
        got = {(r.name, r.l2): r.skill for r in vectors.lopo_head(df, m, [1.0, 30.0], p, 200).collect()}
        for l2 in (1.0, 30.0):
            for held in names:
                rest = [n for n in names if n != held]
                f = {n: x[n] - np.mean([x[k] for k in rest], axis=0) for n in names}
                f = f if p is None else {n: p.T @ v for n, v in f.items()}
                f = {n: v / (np.mean([np.linalg.norm(f[k]) for k in rest]) + 1e-8) for n, v in f.items()}
                w, at = slots(held)
                far = flat = 0.0
                for pos, slot in at.items():
                    have = [(f[n], slots(n)[0][q].argmax()) for n in rest for q, s in slots(n)[1].items() if s == slot]
                    W, b = np.zeros((4, len(f[held]))), np.zeros(4)
                    for _ in range(200 if have else 0):
                        X, Y = np.array([h[0] for h in have]), np.eye(4)[[h[1] for h in have]]
                        z = np.exp(X @ W.T + b)
                        g = z / z.sum(axis=1, keepdims=True) - Y
                        W, b = W - (g.T @ X / len(X) + l2 * W) / (1 + l2), b - g.mean(axis=0) / (1 + l2)
                    z = np.exp(W @ f[held] + b)
                    far += np.linalg.norm(z / z.sum() - w[pos])
                    flat += np.linalg.norm(0.25 - w[pos])
                assert got[held, l2] == pytest.approx(1 - far / flat, abs=1e-6)


def test_packed_counts_are_those_of_text(spark):
    rng = random.Random(8)
    rows = [("a" if i % 3 else "b", rand_dna(rng, rng.randint(0, 80), "ACGTNacgtR")) for i in range(40)] + [(None, "ACGTACGTAC")]
    for k in (1, 4, 12, 31):
        want = Counter((g, min(w, rc(w))) for g, s in rows for w in (s.upper()[i : i + k] for i in range(len(s) - k + 1)) if "N" not in w)
        up = seqs(spark, *rows).withColumn("seq", F.upper("seq"))
        got = {(r.grp, r.kmer): r.n for r in kmers.packed_counts(up, k, ["grp"]).select("grp", kmers.unpacked(k).alias("kmer"), "n").collect()}
        assert got == dict(want)
    with pytest.raises(ValueError):
        kmers.packed_counts(up, 32, [])


def test_scan_with_ten_thousand_patterns(spark):
    rng = random.Random(9)
    text = rand_dna(rng, 20_000, "ACGT")
    words = {rand_dna(rng, rng.randint(6, 14), "ACGT") for _ in range(9_990)} | {text[i : i + 30] for i in range(0, 100, 10)}
    pats = spark.createDataFrame([(str(i), w) for i, w in enumerate(sorted(words))], "name string, motif string")
    got = Counter((r.motif, r.strand, r.position) for r in kmers.scan(seqs(spark, ("a", text)), pats, 0).collect())
    at = {}
    for w in words:
        at.setdefault(w, []).append((w, "+"))
        at.setdefault(rc(w), []).append((w, "-"))
    want = Counter((w, s, i) for n in {len(w) for w in words} for i in range(len(text) - n + 1) for w, s in at.get(text[i : i + n], ()))
    assert got == want


def test_gaps_across_stretches(spark):
    rng = random.Random(10)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randint(-40, 40), rng.randint(0, 5000), rng.randint(0, 10**9)])) for _ in range(400)] + [("a", None), ("c", 5)]
    df = spark.createDataFrame(rows, "k string, p long")
    want, last = Counter(), {}
    for k, p in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        want[k, p, None if k not in last else p - last[k]] += 1
        last[k] = p
    for levels, bits in ((3, 2), (2, 6), (3, 20), (1, 20)):
        got = hits.previous(df, ["k"], "p", "before", levels, bits).where("p is not null")
        assert Counter((r.k, r.p, None if r.before is None else r.p - r.before) for r in got.collect()) == want


def test_median_of_gaps(spark):
    rng = random.Random(11)
    rows = [(k, p) for k in range(12) for p in [rng.randint(0, 60 if k % 2 else 10**7) for _ in range(k)]]
    got = {r.k: (r.n, r.period) for r in hits.median_gap(spark.createDataFrame(rows, "k long, p long"), ["k"], "p").collect()}
    for k in range(1, 12):
        at = sorted(p for g, p in rows if g == k)
        assert got[k] == (k, int(np.median(np.diff(at))) if k > 2 else None)


def test_a_hot_key_is_many_tasks_work(spark):
    """One key of all rows: no task of the ordered windows holds more than its stretch."""
    df = spark.range(0, 40_000, 2).select(F.lit("one").alias("k"), F.col("id").alias("p"))
    stretch = F.floor(F.col("p") / 4096)
    most = df.groupBy("k", stretch).count().agg(F.max("count")).first()[0]
    assert most == 2048
    got = hits.previous(df, ["k"], "p", "before", 3, 12)
    assert got.where("p - before = 2").count() == 19_999 and got.where("before is null").count() == 1


def test_anchor_free_run_finds_planted_motifs_at_either_end(spark):
    """Two sources: one array at a right end, one at a left end, each in the second of two sequences."""
    rng = random.Random(12)
    motif, other = "GTGATAGTTGAA", "CCTGAGACTTCA"

    def planted(word, begin):
        s = list(rand_dna(rng, 6000, "ACGT"))
        for i in range(15):
            s[begin + 40 * i : begin + 40 * i + 12] = word
        return "".join(s)

    df = seqs(spark, ("X", rand_dna(rng, 6000, "ACGT")), ("X", planted(motif, 5200)), ("Y", rand_dna(rng, 6000, "ACGT")), ("Y", planted(other, 300)))
    got = {r.grp: r for r in discovery.anchor_free(df, 12, 1000, 1000, 60, 10, 1, 500, 50).collect()}
    assert set(got) == {"X", "Y"}
    for g, word, i, end, lo in (("X", motif, 1, "right", 5200), ("Y", other, 3, "left", 300)):
        r = got[g]
        # A candidate may be the word or the word moved by a letter, which the array repeats too; each lies on the array.
        assert (r.seq_id, r.end, r.period) == (i, end, 40) and lo - 12 <= r.start <= lo + 600
        assert any(r.seed in c for c in ((word + "N" * 28) * 2, rc((word + "N" * 28) * 2))) or r.copies >= 8


def test_regions_skip_n_and_the_last_window(spark):
    df = seqs(spark, ("X", "ACGTNACGTACGTACG"))
    at = spark.createDataFrame([("X", 0, 4)], "grp string, seq_id long, start long")
    # Letters 4 to 13 are NACGTACGTA: seven windows of four, the first with N, the last never visited.
    assert sorted((r.pos, r.window) for r in discovery.region_windows(df, at, 4, 10).collect()) == [(5, "ACGT"), (6, "CGTA"), (7, "GTAC"), (8, "TACG"), (9, "ACGT")]


def test_anchored_discovery_keeps_sequences_apart(spark):
    rng = random.Random(13)
    words = ["TTGGTCTGCTAA", "TTGGACTGAATC"]

    def planted(word, begin, every):
        s = list(rand_dna(rng, 6000, "ACGT"))
        for i in range(25):
            s[begin + every * i : begin + every * i + 12] = word
        return "".join(s)

    df = seqs(spark, ("X", planted(words[0], 200, 60)), ("X", planted(words[0], 4000, 70)))
    found = discovery.best_end(discovery.refine_anchored(discovery.end_windows(df, 12, 2500), spark.createDataFrame([("X", words[0])], "grp string, seed string")))
    got = {r.seq_id: (r.end, r.motif, r.period) for r in found.collect()}
    assert got == {0: ("left", words[0], 60), 1: ("right", words[0], 70)}


def test_match_null_of_any_number_of_rows(spark):
    rng = random.Random(14)
    for n in (1, 4, 7):
        p = [(rng.choice("abc"), rng.choice(["a", "b", "d", None])) for _ in range(n)]
        r = discovery.permutation_null(spark.createDataFrame(p, "predicted string, expected string")).first()
        counts = [sum(a == p[j][1] for (a, _), j in zip(p, o)) for o in permutations(range(n))]
        seen = sum(a == b for a, b in p)
        assert (r.n, r.matches) == (n, seen) and r.mean_null == pytest.approx(np.mean(counts)) and r.p_value == pytest.approx(np.mean([c >= seen for c in counts]))
    many = spark.createDataFrame([(str(i % 5), str(i % 7 % 5)) for i in range(300)], "predicted string, expected string")
    r = discovery.permutation_null(many).first()
    assert r.n == 300 and 0 < r.p_value < 1
    assert discovery.permutation_null(many.limit(0)).first().p_value == 1.0


def test_match_null_of_many_rows_makes_no_long_numbers(spark, monkeypatch):
    """One shared label is a hypergeometric tail; labels that are all different match as Poisson's law says."""
    monkeypatch.delattr(discovery, "rooks")
    n, a, b = 60_000, 3000, 2500
    i = spark.range(n)
    one = i.select(F.when(F.col("id") < a, "x").otherwise("y").alias("predicted"), F.when(F.col("id") % 24 == 0, "x").alias("expected"))
    pmf = lambda k: comb(b, k) * comb(n - b, a - k)
    for least in (None, 100, 190, 600):
        r = discovery.permutation_null(one, least).first()
        right = float(Fraction(sum(pmf(k) for k in range(r.matches, min(a, b, r.matches + 400) + 1)), comb(n, a)))
        assert (r.n, r.mean_null) == (n, 125.0) and r.p_value == pytest.approx(right, rel=1e-10)
    ids = i.select(F.col("id").alias("predicted"), (n - 1 - F.col("id")).alias("expected"))
    assert discovery.permutation_null(ids).first().p_value == 1.0
    assert discovery.permutation_null(ids, 3).first().p_value == pytest.approx(1 - 2.5 / np.e, rel=1e-10)
    assert discovery.permutation_null(ids, n).first().p_value == 0.0


def test_match_null_equals_whole_numbers(spark):
    rng = random.Random(15)
    for n, labels in ((1200, 20), (1500, 11), (700, 150)):
        side = lambda: Counter(int(labels * rng.random() ** 1.2) for _ in range(n))  # noqa: B023, E731
        x, y = side(), side()
        boards = [(a, b, t) for (a, b), t in Counter((x[k], y[k]) for k in x if k in y).items()]
        r = discovery.rooks([(a, b) for a, b, t in boards for _ in range(t)])
        mean = sum(a * b * t for a, b, t in boards) / n
        for least in {1, round(0.7 * mean), round(mean), round(mean + 2 * mean**0.5)}:
            right = float(Fraction(sum(discovery._matches(r, n, least)), factorial(n)))
            assert matches.tail(spark, boards, n, least) == pytest.approx(right, rel=1e-10)
    assert matches.tail(spark, [(500, 500, 2)], 1000, 600) is None
    assert matches.tail(spark, [(20, 30, 1)], 2000, 21) == 0.0


def test_match_null_of_few_labels(spark):
    """A label with half of the rows, beyond the rows that are taken by whole numbers alone."""
    pairs = spark.range(1400).select((F.col("id") % 2).alias("predicted"), (F.col("id") % 4 < 2).cast("long").alias("expected"))
    r = discovery.permutation_null(pairs).first()
    right = Fraction(sum(comb(700, k) ** 2 for k in range(350, 701)), comb(1400, 700))
    assert (r.matches, r.mean_null) == (700, 700.0) and r.p_value == pytest.approx(float(right), rel=1e-10)


def test_shared_kmers_both_ways(spark, monkeypatch):
    """By index and by join, with ids that repeat on either side, null ids and null sequences."""
    rng = random.Random(15)
    make = lambda n, ids: spark.createDataFrame([(rng.choice(ids), rng.choice([None, rand_dna(rng, rng.randint(0, 60), "ACGT")])) for _ in range(n)], "seq_id long, seq string")
    for ids in (list(range(400)), [1, 2, 3, None]):
        q, t = make(12, ids), make(30, ids)
        got = {}
        for letters in (1 << 20, 0):
            monkeypatch.setattr(kmers, "INDEX_LETTERS", letters)
            got[letters] = sorted(map(tuple, kmers.shared_kmers(q, t, 4, 3).collect()))
        assert got[0] == got[1 << 20]
        sets = lambda df: {i: {r.seq[p : p + 4] for r in df.collect() if r.seq_id == i and r.seq for p in range(len(r.seq) - 3)} for i in {r.seq_id for r in df.collect()} - {None}}
        a, b = sets(q), sets(t)
        want = []
        for i in a:
            best = sorted(((len(a[i] & b[j]), j) for j in b if a[i] & b[j]), reverse=True)[:3]
            want += [(i, j, n, k + 1) for k, (n, j) in enumerate(best)]
        assert got[0] == sorted(want)


def test_nearest_with_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [1.0, 2.0, 3.0]), (5, [0.0, 0.0]), (6, [1.0, None]), (None, [1.0, 0.0]), (7, []), (8, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    for block in (2048, 2):
        got = {r.qid: (r.tid, round(r.cosine, 6)) for r in vectors.nearest(df, df, 1, block).collect()}
        assert got == {1: (8, 1.0), 2: (8, 0.995037), 8: (1, 1.0)}
    assert vectors.nearest(df.limit(0), df, 2).collect() == [] and vectors.nearest(df, df.limit(0), 2).collect() == []


def test_leave_one_out_in_blocks(spark):
    rng = np.random.default_rng(6)
    x = {f"l{i}": rng.normal(size=5) for i in range(30)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "label string, vector array<double>")
    for center in (True, False):
        for block in (2048, 7):
            got = {r.held: (r.other, r.cosine) for r in vectors.leave_one_out_neighbours(df, center, block).collect()}
            for h in x:
                m = np.mean([x[o] for o in x if o != h], axis=0) if center else 0
                cos = {o: (x[h] - m) @ (x[o] - m) / np.linalg.norm(x[h] - m) / np.linalg.norm(x[o] - m) for o in x if o != h}
                best = max(cos, key=lambda o: (cos[o], o))
                assert got[h][0] == best and got[h][1] == pytest.approx(cos[best])
    assert vectors.leave_one_out_neighbours(df.limit(1)).collect() == []
