"""Motif discovery in sequence ends, and the result sheets that join, tier and test its runs."""

from __future__ import annotations

from fractions import Fraction
from math import comb, factorial

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import reference_values as V
from ..functions import sequence as S
from . import hits, kmers, matches, pwm

KEY = ["grp", "seq_id", "end"]
WIDTH, STEP = 50_000, 5_000


def end_windows(seqs: DataFrame, length: int, terminal: int, anchor: str = "TTGG") -> DataFrame:
    """(grp, seq_id, end, begin, length, pos, window): anchored windows of both ends of each sequence, with positions from
    the end's begin and the sequence's length; ends of short sequences overlap and are counted twice."""
    n = F.length("seq")
    begin = F.greatest(n - terminal, F.lit(0))
    left = seqs.select("seq_id", F.struct("grp", F.lit("left").alias("end"), F.lit(0).alias("begin"), n.alias("length")).alias("grp"), F.substring("seq", F.lit(1), F.lit(terminal)).alias("seq"))
    right = seqs.select("seq_id", F.struct("grp", F.lit("right").alias("end"), begin.alias("begin"), n.alias("length")).alias("grp"), F.substring("seq", begin + 1, F.lit(terminal)).alias("seq"))
    return kmers.anchored_windows(left.unionByName(right), length, anchor).select("grp.grp", "seq_id", "grp.end", "grp.begin", "grp.length", "pos", "window")


def refine_anchored(windows: DataFrame, seeds: DataFrame, rounds: int = 3, near: int = 2, core: int = 12, least: int = 10, keep_score: float = 4.8, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """Anchored discovery for both ends of all sequences at once: (grp, seq_id, end, w0, from_end_kb, motif, copies, period,
    downstream_bits, score), w0 from the sequence's begin.

    windows: as of :func:`end_windows`; seeds: (grp, seed). Positions of different sequences never meet. Windows near the seed locate the densest span; the windows of that
    span with a framework are the pool, and keys with fewer than ``least`` are left out. The first matrix is of the near
    windows in the pool, or of the pool where there are none; each round scores the pool and keeps the windows above
    ``keep_score``, or, where fewer than ``least`` pass, the best max(20, first set) by score, window and position. The
    last matrix gives motif, bits and copies; keys whose motif is of low complexity or whose period is below 15 are dropped."""
    j = windows.join(F.broadcast(seeds) if _small(seeds) else seeds, "grp")
    # Of the windows, made once, the near ones are counted, the densest place is sought, and the pool is taken.
    j = j.withColumn("near", S.hamming_first(F.col("window"), F.col("seed"), core) <= near).drop("seed").checkpoint()
    best = hits.densest_window(j.where("near"), KEY, "pos", width, step).select(*KEY, "w0")
    pool = j.join(best, KEY).where((F.col("pos") >= F.col("w0")) & (F.col("pos") < F.col("w0") + width))
    pool = pool.where(S.framework_spacer(F.substring("window", 1, core)).isNotNull())
    big = pool.groupBy(*KEY).agg(F.count(F.lit(1)).alias("pool_n"), F.count_if("near").alias("near_n")).where(F.col("pool_n") >= least)
    pool = pool.join(big, KEY).withColumn("first", F.when(F.col("near_n") > 0, F.col("near")).otherwise(F.lit(True)))
    pool = pool.withColumn("n_seed", F.when(F.col("near_n") > 0, F.col("near_n")).otherwise(F.col("pool_n")))
    pool = pool.select(*KEY, "begin", "length", "pos", "window", "w0", "first", "n_seed").checkpoint()
    kept = pool.where("first").select(*KEY, "pos", "window")
    for _ in range(rounds):
        matrix = pwm.from_windows(kept, KEY)
        scored = pwm.score_windows(pool, matrix, KEY, [])
        w = W.partitionBy(*KEY)
        rank = F.row_number().over(w.orderBy(F.desc("score"), F.desc("window"), F.desc("pos")))
        scored = scored.withColumn("n_keep", F.count_if(F.col("score") > keep_score).over(w)).withColumn("rank", rank)
        passes = F.when(F.col("n_keep") >= least, F.col("score") > keep_score).otherwise(F.col("rank") <= F.greatest(F.lit(20), F.col("n_seed")))
        kept = scored.where(passes).select(*KEY, "pos", "window").checkpoint()
    matrix = pwm.from_windows(kept, KEY)
    out = pwm.consensus(matrix, KEY).withColumnRenamed("consensus", "motif")
    out = out.join(hits.median_gap(kept, KEY, "pos"), KEY).withColumnRenamed("n", "copies")
    out = out.join(pwm.bits(matrix, KEY, 4).withColumn("downstream_bits", F.round("bits", 1)).drop("bits"), KEY)
    out = out.where(~S.low_complexity(F.substring("motif", 1, core)) & ~F.coalesce(F.col("period") < 15, F.lit(False)))
    place = F.col("begin") + F.col("w0")
    at = pool.groupBy(*KEY).agg(F.first(place).alias("w0"), F.first(F.round(F.least(place, F.col("length") - place) / 1000)).cast("int").alias("from_end_kb"))
    return out.join(at, KEY).withColumn("score", F.col("downstream_bits") * F.log1p("copies")).select(*KEY, "w0", "from_end_kb", "motif", "copies", "period", "downstream_bits", "score")


def _small(df: DataFrame, most: int = 1 << 20) -> bool:
    """Whether the optimizer's own estimate of the size is within ``most`` bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def best_end(found: DataFrame) -> DataFrame:
    """The end of each sequence with the better score; left wins ties."""
    return kmers.top_per_group(found, ["grp", "seq_id"], [F.desc("score"), "end"], 1).drop("rank")


def end_hits(seqs: DataFrame, candidates: DataFrame, k: int, terminal: int) -> DataFrame:
    """(grp, kmer, seq_id, end, pos): exact hits of each candidate (grp, kmer), on either strand, in both ends of its group's
    sequences, from the sequence's begin. A candidate that is its own reverse complement hits a place twice."""
    pieces = kmers.end_pieces(seqs.withColumn("seq_id", F.struct("seq_id", (F.length("seq") - terminal).alias("begin"))), k, terminal)
    candidates = kmers.settled(candidates.select("grp", "kmer"))
    words = [r.kmer for r in candidates.select("kmer").distinct().limit(kmers.PATTERNS + 1).collect()]
    if not words or len(words) > kmers.PATTERNS or k > kmers.PACKED or any(len(x) != k or set(x) - set(S.BASES) for x in words):
        w = kmers.known(kmers.windows(pieces, k, ["grp", "seq_id", "end"])).withColumn("kmer", S.canonical_kmer(F.col("kmer")))
    else:  # the search leaves only the windows that some group wants
        w = kmers.places(pieces, words, ["grp", "seq_id", "end"])
    wanted = candidates.select("grp", "kmer", F.explode(F.when(F.col("kmer") == S.reverse_complement(F.col("kmer")), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_strand"))
    found = w.join(F.broadcast(wanted) if _small(wanted) else wanted, ["grp", "kmer"])
    return kmers.settled(found.select("grp", "kmer", "seq_id.seq_id", "end", (F.col("pos") + F.when(F.col("end") == "right", F.col("seq_id.begin")).otherwise(0)).alias("pos")))


def located(seqs: DataFrame, candidates: DataFrame, k: int, terminal: int, width: int = WIDTH, step: int = STEP, least: int = 5) -> DataFrame:
    """(grp, kmer, seq_id, end, w0, n): where the exact hits of each candidate (grp, kmer) are densest in an end of a sequence
    of its group, w0 from the sequence's begin. Ties go to the smaller seq_id, then to the left end. Candidates without a
    window in an end of ``least`` hits are left out."""
    found = end_hits(seqs, candidates, k, terminal).withColumn("place", F.struct("seq_id", "end"))
    return hits.densest_window_or_none(found, ["grp", "kmer"], "place", "pos", least, width, step).select("grp", "kmer", "place.seq_id", "place.end", "w0", "n")


def region_windows(seqs: DataFrame, seeds: DataFrame, length: int, width: int = WIDTH) -> DataFrame:
    """(grp, seq_id, pos, window): windows of ``length`` letters, free of N, of the ``width`` letters from each seed's start
    (grp, seq_id, start). The region is cut out before windows are made; its last window is never visited."""
    cut = seqs.join(F.broadcast(seeds) if _small(seeds) else seeds, ["grp", "seq_id"]).select("grp", F.struct("seq_id", "start").alias("seq_id"), F.substring("seq", (F.col("start") + 1).cast("int"), F.lit(width)).alias("seq"))
    w = kmers.known(kmers.windows(cut, length)).where(F.col("pos") < F.col("length") - length)
    return w.select("grp", "seq_id.seq_id", (F.col("pos") + F.col("seq_id.start")).alias("pos"), F.col("kmer").alias("window"))


def refine_free(windows: DataFrame, seeds: DataFrame, length: int, most: int = 3, least: int = 8) -> DataFrame:
    """Anchor-free refinement for all groups at once: (grp, motif, copies, period, info_bits).

    windows: as of :func:`region_windows`, in upper case; seeds: (grp, seed), one a group. Windows within ``most`` mismatches
    count as they are, or else reversed. From at least ``least``, a matrix; those that score above 0.2 a letter, or all, make
    a second one, which is cut to the columns of at least 0.15 bits. The period is that of all windows, kept or not."""
    j = windows.join(F.broadcast(seeds) if _small(seeds) else seeds, "grp")
    rc = S.reverse_complement(F.col("window"))
    word = F.when(S.hamming(F.col("window"), F.col("seed")) <= most, F.col("window")).when(S.hamming(rc, F.col("seed")) <= most, rc)
    j = j.withColumn("window", word).where("window is not null")
    enough = j.groupBy("grp").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("grp")
    j = j.join(enough, "grp", "left_semi").select("grp", "pos", "window").checkpoint()
    scored = pwm.score_windows(j, pwm.from_windows(j, ["grp"]), ["grp"], [])
    passing = scored.groupBy("grp").agg(F.count_if(F.col("score") > 0.2 * length).alias("n_keep"))
    kept = scored.join(passing, "grp").where((F.col("score") > 0.2 * length) | (F.col("n_keep") == 0)).select("grp", "pos", "window")
    m = pwm.from_windows(kept, ["grp"]).withColumn("ic", S.information(*[F.col(b) for b in pwm.ACGT]))
    edge = m.groupBy("grp").agg(F.min(F.when(F.col("ic") >= 0.15, F.col("pos"))).alias("lo"), F.max(F.when(F.col("ic") >= 0.15, F.col("pos"))).alias("hi"))
    m = m.join(edge, "grp").where(F.coalesce(F.col("pos").between(F.col("lo"), F.col("hi")), F.lit(True)))
    out = pwm.consensus(m, ["grp"]).withColumnRenamed("consensus", "motif")
    out = out.join(kept.groupBy("grp").agg(F.count(F.lit(1)).alias("copies")), "grp")
    out = out.join(hits.median_gap(j, ["grp"], "pos").select("grp", "period"), "grp")
    return out.join(m.groupBy("grp").agg(F.round(F.sum("ic"), 1).alias("info_bits")), "grp")


def anchor_free(seqs: DataFrame, k: int, terminal: int, interior: int, top: int = 60, min_count: int = 10, most: int = 3, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """(grp, seq_id, end, start, seed, motif, copies, period, info_bits): the whole anchor-free run, a row a group that has a
    motif. The candidates most enriched at the ends, the densest window of each one's hits in one end of one sequence, the
    most specific candidate that has a window, refined from there. The session needs a checkpoint folder."""
    ends = kmers.end_counts(seqs, k, terminal).checkpoint()
    # Every candidate is ranked by a rounded enrichment, so that ties are ties whatever the order of sums.
    every = kmers.enriched_vs_interior(ends, kmers.interior_counts(seqs, k, interior), 1 << 30, min_count).drop("rank").withColumn("enrichment", F.round("enrichment", 9))
    cand = kmers.top_per_group(every, ["grp"], [F.desc("enrichment"), F.desc("kmer")], top).drop("rank")
    cand = cand.join(kmers.specificity(ends).drop("n"), ["grp", "kmer"]).checkpoint()
    seeds = select_specific(cand, located(seqs, cand, k, terminal, width, step).drop("n")).select("grp", "seq_id", "end", F.col("kmer").alias("seed"), F.col("w0").alias("start")).checkpoint()
    w = region_windows(seqs.withColumn("seq", F.upper("seq")), seeds.select("grp", "seq_id", "start"), k, width)
    return seeds.join(refine_free(w, seeds.select("grp", "seed"), k, most), "grp")


def select_specific(candidates: DataFrame, windows_found: DataFrame) -> DataFrame:
    """The most specific candidate (grp, kmer, enrichment, specificity) that has a window (grp, kmer, ...); ties to the more
    enriched."""
    j = candidates.join(windows_found, ["grp", "kmer"])
    return kmers.top_per_group(j, ["grp"], [F.desc("specificity"), F.desc("enrichment"), F.desc("kmer")], 1).drop("rank")


def seeds_per_group(enriched: DataFrame) -> DataFrame:
    """(grp, end, seed, spacer, fold_enrichment): the most enriched anchored k-mer of each group with a framework spacer
    and without low complexity."""
    m = S.orient(F.col("kmer"))
    e = enriched.where("anchored").withColumn("seed", m).where("seed is not null").where(~S.low_complexity(F.col("seed")))
    e = e.withColumn("spacer", S.framework_spacer(F.col("seed"))).where("spacer is not null")
    return kmers.top_per_group(e, ["grp"], [F.desc("fold_enrichment"), "seed", "end"], 1).select("grp", "end", "seed", "spacer", "fold_enrichment")


def top_candidates(enriched: DataFrame) -> DataFrame:
    """As :func:`seeds_per_group`, for each end and with low complexity let in."""
    e = enriched.where("anchored").withColumn("seed", S.orient(F.col("kmer"))).where("seed is not null")
    e = e.withColumn("spacer", S.framework_spacer(F.col("seed"))).where("spacer is not null")
    return kmers.top_per_group(e, ["grp", "end"], [F.desc("fold_enrichment"), "seed"], 1).select("grp", "end", "seed", "spacer", "fold_enrichment", "terminal_count")


def motif_specificity(windows: DataFrame, motifs: DataFrame, core: int = 12, most: int = 1) -> DataFrame:
    """(grp, motif, specificity): share of the windows within ``most`` mismatches of a motif that its own group holds; 0.0
    without any. Found by shared parts, not by comparing all windows with all motifs. windows: (grp, window), or counts of
    them (grp, window, n)."""
    cores = motifs.select(F.col("grp").alias("home"), "motif", F.substring("motif", 1, core).alias("core"))
    counts = windows.groupBy("grp", F.substring("window", 1, core).alias("window")).agg((F.sum("n") if "n" in windows.columns else F.count(F.lit(1))).alias("n"))
    near = kmers.similar_pairs(counts, cores.select("core").distinct(), most, core)
    c = near.groupBy("core", "grp").agg(F.sum("n").alias("n"))
    j = cores.join(c, "core", "left").groupBy("home", "motif").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("grp") == F.col("home"), F.col("n"))).alias("own"))
    return j.select(F.col("home").alias("grp"), "motif", F.round(F.coalesce(F.col("own") / F.col("total"), F.lit(0.0)), 2).alias("specificity"))


def reconcile(first: DataFrame, second: DataFrame, paralogs: DataFrame) -> DataFrame:
    """The sheet of motifs found in two assemblies: tiers, reproduction within two mismatches, agreement with synteny.

    A paralog is assigned by chromosome; similarity to known motifs is reported beside it. Best tier first."""
    b = second.select("chromosome", F.col("discovered_motif").alias("other"))
    j = first.join(b, "chromosome").join(F.broadcast(paralogs), "chromosome", "left")
    again = S.hamming(F.substring("discovered_motif", 1, 12), F.substring("other", 1, 12)) <= 2
    j = j.withColumn("reproduced_on_AF16", again)
    tier = S.reconciled_tier(F.col("downstream_bits"), F.col("period_bp"), F.col("reproduced_on_AF16"), F.col("dist_from_end_kb"))
    out = j.select("chromosome", F.concat(F.lit("Cbr-"), "paralog").alias("binds_protein"), F.col("discovered_motif").alias("motif"), "reproduced_on_AF16", "spacer", F.col("cluster_pos_Mb").alias("cluster_Mb"), "copies", "period_bp", "downstream_bits", F.col("ce_paralog").alias("motif_similar_to"), F.col("ce_match_skill").alias("similarity_skill"), (F.col("ce_paralog") == F.col("paralog")).alias("assignment_agrees"), tier.alias("confidence"))
    return out.orderBy(S.tier_order(F.col("confidence")), "chromosome")


#: What to do at each status of an anchor.
ADVICE = {"CONSERVED": "keep the anchored motif", "DIVERGED": "test the anchor-free motif", "INTERMEDIATE": "test both motifs"}


def anchor_sheet(chromosomes: DataFrame, conservation: DataFrame, anchored: DataFrame, free: DataFrame, advice: dict[str, str] | None = None) -> DataFrame:
    """Each chromosome's anchored and anchor-free motifs, with the status that its protein's conservation gives the anchor.

    chromosomes: (chromosome, paralog); conservation: (paralog, recognition_conservation)."""
    j = chromosomes.join(conservation, "paralog")
    k = F.col("recognition_conservation")
    status = F.when(k >= V.CONSERVED, "CONSERVED").when(k < V.DIVERGED, "DIVERGED").otherwise("INTERMEDIATE")
    say = F.create_map(*[F.lit(x) for kv in (advice or ADVICE).items() for x in kv])
    a = anchored.select("chromosome", F.col("discovered_motif").alias("anchored_motif"), F.col("ce_match_skill").alias("anchored_skill"), F.col("confidence").alias("anchored_confidence"))
    f = free.select("chromosome", F.col("discovered_motif").alias("anchorfree_motif"), F.col("chrom_specificity").alias("anchorfree_specificity"), F.col("recovered_TTGG").alias("anchorfree_has_TTGG"))
    j = j.withColumn("anchor_status", status).join(a, "chromosome", "left").join(f, "chromosome", "left")
    return j.select("chromosome", F.concat(F.lit("Cbr-"), "paralog").alias("paralog"), "recognition_conservation", "anchor_status", "anchored_motif", "anchored_skill", "anchored_confidence", "anchorfree_motif", "anchorfree_specificity", "anchorfree_has_TTGG", say[F.col("anchor_status")].alias("recommendation")).orderBy(F.desc("recognition_conservation"), "chromosome")


def compare_runs(chromosomes: DataFrame, free: DataFrame, anchored: DataFrame) -> DataFrame:
    """Each chromosome's motifs of the anchor-free and the anchored run side by side, null where a run has none."""
    f = free.select("chromosome", F.col("discovered_motif").alias("ANCHOR_FREE_motif"), F.col("chrom_specificity").alias("ANCHOR_FREE_specificity"), F.col("recovered_TTGG").alias("ANCHOR_FREE_has_TTGG"))
    t = anchored.select("chromosome", F.col("ttgg_motif").alias("TTGG_motif"), F.col("chrom_specificity").alias("TTGG_specificity"), F.col("closest_ce_paralog").alias("TTGG_closest_paralog"), F.col("ce_skill").alias("TTGG_match_skill"))
    return chromosomes.select("chromosome").join(f, "chromosome", "left").join(t, "chromosome", "left").orderBy("chromosome")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate a chromosome by enrichment x specificity, at 0.4 of it without tandem copies; low complexity left out;
    a null of the best candidate is filled from the next."""
    c = candidates.where(~F.col("low_complexity"))
    c = c.withColumn("score", F.col("fold_enrichment") * F.col("chrom_specificity") * F.when(F.col("tandem"), 1.0).otherwise(0.4))
    return hits.first_non_null(c, ["chromosome"], [("score", True), ("end", False)], ["end", "candidate_motif", "spacer", "fold_enrichment", "chrom_specificity", "median_spacing_bp", "best_ce_paralog", "convergent", "score"])


#: Up to so many rows, the chance of matches is taken from whole numbers alone.
WHOLE_ROWS = 1000


def permutation_null(pairs: DataFrame, observed: int | None = None) -> DataFrame:
    """(n, matches, mean_null, p_value): how often a random assignment of the expected labels matches the predicted ones as
    often as the true one does. pairs: (predicted, expected), any number of rows; null matches null.

    Only the labels' counts matter: a label that a rows predict and b rows expect is an a x b board, on which k rooks that
    attack none other stand in C(a, k) C(b, k) k! ways. The boards' polynomials multiply; k rooks in r_k ways, and any order of
    the other n - k rows, give by inclusion and exclusion the orders with exactly m matches:
    sum over k of (-1)^(k - m) C(k, m) r_k (n - k)!. What comes to the driver is a row a pair of counts that labels of both
    sides have. Up to ``WHOLE_ROWS`` rows these are whole numbers throughout, and the product is taken by halves, so its
    cost is that of multiplying numbers of n digits. Beyond, the same sum is taken by :func:`matches.tail`, to 10 digits
    and in time that grows with the rows; where that does not hold (labels with more than about a seventh of the rows), by
    whole numbers again. No rows: no matches, so every order has as many."""
    same = F.col("predicted").eqNullSafe(F.col("expected"))
    n, true = pairs.agg(F.count(F.lit(1)), F.count(F.when(same, 1))).first()
    seen = true if observed is None else observed
    side = lambda c, name: pairs.groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias(name))
    a, b = side("predicted", "a"), side("expected", "b")
    boards = a.join(b, a["label"].eqNullSafe(b["label"])).select("a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).collect()
    mean = Fraction(sum(x.a * x.b * x.times for x in boards), n or 1)
    p = 1.0 if seen <= 0 else None
    if p is None and n > WHOLE_ROWS:
        p = matches.tail(pairs.sparkSession, [tuple(x) for x in boards], n, seen)
    if p is None:
        r = rooks([(x.a, x.b) for x in boards for _ in range(x.times)])
        p = float(Fraction(sum(_matches(r, n, seen)), factorial(n)))
    return pairs.sparkSession.createDataFrame([(n, seen, float(mean), p)], "n long, matches long, mean_null double, p_value double")


def rooks(boards: list[tuple[int, int]]) -> list[int]:
    """The rook polynomial of disjoint boards of a x b squares: ways of 0, 1, 2... rooks."""
    made = [[comb(a, k) * comb(b, k) * factorial(k) for k in range(min(a, b) + 1)] for a, b in boards] or [[1]]
    while len(made) > 1:
        made = [_product(*made[i : i + 2]) for i in range(0, len(made), 2)]
    return made[0]


def _product(p: list[int], q: list[int] | None = None) -> list[int]:
    """Coefficients of p q, read off one product of two long numbers; those are not negative."""
    if q is None:
        return p
    width = (max(p) * max(q) * min(len(p), len(q))).bit_length() // 8 + 1
    pack = lambda c: int.from_bytes(b"".join(x.to_bytes(width, "little") for x in c), "little")
    size = len(p) + len(q) - 1
    raw = (pack(p) * pack(q)).to_bytes(width * (size + 1), "little")
    return [int.from_bytes(raw[width * i : width * (i + 1)], "little") for i in range(size)]


def _matches(r: list[int], n: int, least: int):
    """Signed terms that sum to the orders with at least ``least`` matches: k rooks count (-1)^(k - least) C(k - 1, least - 1)."""
    left = factorial(n - least) if least <= n else 0
    for k in range(least, len(r)):
        yield (-1) ** (k - least) * comb(k - 1, least - 1) * r[k] * left
        left = left // (n - k) if n > k else 0
