"""Position weight matrices: counts, construction, scores, transfer between frames, and the one metric.

A matrix is rows (id, pos, a, c, g, t)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import kmers

ACGT = ["a", "c", "g", "t"]
SLOTS, SPACER_SLOTS, TAIL_SLOTS = 9, 4, 5


def letter_counts(words: DataFrame, keys: list[str], word: str = "window", offset=None) -> DataFrame:
    """(keys, pos, a, c, g, t): counts of each base by column; other letters don't count."""
    up = F.upper(word)
    each = words.select(*keys, F.posexplode(S.letters(up)).alias("_i", "_b"), (offset if offset is not None else F.lit(0)).alias("_o"))
    each = each.withColumn("pos", F.col("_i") + F.col("_o"))
    return each.groupBy(*keys, "pos").agg(*[F.count_if(F.col("_b") == b.upper()).alias(b) for b in ACGT])


def normalised(counts: DataFrame, pseudocount: float) -> DataFrame:
    total = sum((F.col(b) for b in ACGT), F.lit(4.0 * pseudocount))
    return counts.select(*[c for c in counts.columns if c not in ACGT], *[((F.col(b) + pseudocount) / total).alias(b) for b in ACGT])


def from_windows(words: DataFrame, keys: list[str], pseudocount: float = 0.5, word: str = "window") -> DataFrame:
    return normalised(letter_counts(words, keys, word), pseudocount)


def build(oligos: DataFrame, keys: list[str], min_coverage: float = 0.5, pseudocount: float = 0.25) -> DataFrame:
    """(keys, pos, col, coverage, base, a, c, g, t) of aligned oligos (keys, offset, oligo).

    Columns covered by at least that share of all oligos stay, those of N alone among the oligos too; kept columns need
    not be neighbours, and col numbers them. base is the most frequent letter, ties in the order A, C, G, T."""
    n = oligos.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_seq")) if keys else oligos.agg(F.count(F.lit(1)).alias("n_seq"))
    counts = letter_counts(oligos, keys, "oligo", F.col("offset"))
    cover = sum((F.col(b) for b in ACGT), F.lit(0))
    j = (counts.join(n, keys) if keys else counts.crossJoin(n)).withColumn("coverage", cover).where(F.col("coverage") >= min_coverage * F.col("n_seq"))
    base = F.lit("T")
    for b, rest in (("g", ["t"]), ("c", ["g", "t"]), ("a", ["c", "g", "t"])):
        base = F.when(F.col(b) >= F.greatest(*[F.col(x) for x in rest]) if len(rest) > 1 else F.col(b) >= F.col(rest[0]), b.upper()).otherwise(base)
    j = j.withColumn("base", base).withColumn("col", F.row_number().over(W.partitionBy(*keys).orderBy("pos")) - 1 if keys else F.row_number().over(W.orderBy("pos")) - 1)
    return normalised(j, pseudocount).drop("n_seq")


def consensus(matrix: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, consensus): the heaviest base of each column, ties in the order A, C, G, T."""
    top = F.greatest(*[F.col(b) for b in ACGT])
    base = F.when(F.col("a") == top, "A").when(F.col("c") == top, "C").when(F.col("g") == top, "G").otherwise("T")
    return matrix.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), base.alias("b")))), lambda x: x["b"]), "").alias("consensus"))


def bits(matrix: DataFrame, keys: list[str], least_pos: int | None = None) -> DataFrame:
    """(keys, bits): information summed over columns."""
    m = matrix if least_pos is None else matrix.where(F.col("pos") >= least_pos)
    return m.groupBy(*keys).agg(F.sum(S.information(*[F.col(b) for b in ACGT])).alias("bits"))


def score_windows(words: DataFrame, matrix: DataFrame, keys: list[str], row: list[str], word: str = "window") -> DataFrame:
    """(row, score): sum of log2(p / 0.25) of a window's letters; letters other than bases add nothing.

    The matrix of a key is packed into one array, so each window joins one row and is scored in place."""
    packed = matrix.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *ACGT))), lambda x: F.struct(*[x[b].alias(b) for b in ACGT])).alias("_m"))
    j = words.join(packed, keys) if keys else words.crossJoin(F.broadcast(packed))
    n = F.least(F.length(word), F.size("_m"))
    at = lambda i: F.element_at("_m", i)
    letter = lambda i: F.substring(F.col(word), i, F.lit(1))
    value = lambda i: F.when(letter(i) == "A", at(i)["a"]).when(letter(i) == "C", at(i)["c"]).when(letter(i) == "G", at(i)["g"]).when(letter(i) == "T", at(i)["t"])
    score = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.log2(value(i) / 0.25), F.lit(0.0)))
    return j.withColumn("score", F.when(n > 0, score).otherwise(0.0)).drop("_m")


def of_motifs(motifs: DataFrame, keys: list[str], motif: str = "motif", pseudocount: float = 0.01) -> DataFrame:
    """(keys, pos, a, c, g, t) of motifs given as text."""
    each = motifs.select(*keys, F.posexplode(S.motif_columns(F.col(motif), pseudocount)).alias("pos", "_c"))
    return each.select(*keys, "pos", *[F.col("_c")[b].alias(b) for b in ACGT])


def transfer(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """Matrices moved from a source's frame into a destination's.

    pairs: (case, src, src_spacer, src_len, dst_spacer, dst_len); source: (id, pos, a, c, g, t). The anchors are copied, the
    spacer is aligned to the second anchor, the tail to what follows it; what has no counterpart is 0.25. A shift of the
    position by the difference of the spacers says all of that, so it is a left join on the shifted position."""
    dst = pairs.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("dst_len") - 1)))
    shifted = F.col("pos") - F.col("dst_spacer") + F.col("src_spacer")
    frm = F.when(F.col("pos") < 4, F.col("pos")).when((shifted >= 4) & (shifted < F.col("src_len")), shifted)
    s = source.select(F.col("id").alias("src"), F.col("pos").alias("_p"), *ACGT)
    j = dst.withColumn("_p", frm).join(s, ["src", "_p"], "left")
    return j.select("case", "src", "pos", *[F.coalesce(b, F.lit(0.25)).alias(b) for b in ACGT])


def to_slots(matrix: DataFrame, spacer: str = "spacer") -> DataFrame:
    """Columns (..., pos, spacer) to the slots of a common frame: the k-th letter of the spacer, counted from the second
    anchor, is slot 3 - k; the k-th of the tail is slot 4 + k; the anchors and what lies beyond five of the tail have none."""
    s = F.col(spacer)
    in_spacer = (F.col("pos") >= 4) & (F.col("pos") < 4 + s)
    in_tail = (F.col("pos") >= 6 + s) & (F.col("pos") < 6 + s + TAIL_SLOTS)
    slot = F.when(in_spacer, F.col("pos") - s).when(in_tail, SPACER_SLOTS + F.col("pos") - 6 - s)
    return matrix.withColumn("slot", slot.cast("int")).where("slot is not null")


def from_slots(slots: DataFrame, frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """The inverse: frames (case, spacer, length), slots (case, slot, a..t), anchors (case, pos, a..t of the anchor's
    letters); columns without a slot or an anchor are 0.25. Tails beyond five columns can't be got back."""
    d = frames.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("length") - 1)))
    d = d.withColumn("anchor", S.is_anchor(F.col("pos"), F.col("spacer")))
    slot = F.when(F.col("pos") < 4 + F.col("spacer"), F.col("pos") - F.col("spacer")).otherwise(SPACER_SLOTS + F.col("pos") - 6 - F.col("spacer"))
    d = d.withColumn("slot", F.when(~F.col("anchor"), slot))
    a = anchors.select("case", "pos", *[F.col(b).alias(f"_a{b}") for b in ACGT])
    s = slots.select("case", "slot", *[F.col(b).alias(f"_s{b}") for b in ACGT])
    j = d.join(s, ["case", "slot"], "left").join(a, ["case", "pos"], "left")
    return j.select("case", "pos", *[F.when(F.col("anchor"), F.coalesce(f"_a{b}", F.lit(0.25))).otherwise(F.coalesce(f"_s{b}", F.lit(0.25))).alias(b) for b in ACGT])


def evaluate(predicted: DataFrame, truth: DataFrame, spacers: DataFrame, keys: list[str], metric: str = "euclidean") -> DataFrame:
    """(keys, n_variable, distance, skill) of predicted (keys, pos, a..t) against truth (keys, pos, a..t).

    Graded are the columns that aren't anchors. Distance is the mean over them; skill is 1 less its share of the distance
    of a matrix of 0.25, 0 where that is 0, and may be negative."""
    p = predicted.select(*keys, "pos", *[F.col(b).alias(f"p{b}") for b in ACGT])
    j = p.join(truth.select(*keys, "pos", *ACGT), [*keys, "pos"]).join(spacers, keys).where(~S.is_anchor(F.col("pos"), F.col("spacer")))
    t = [F.col(b) for b in ACGT]
    d = S.column_distance([F.col(f"p{b}") for b in ACGT], t, metric)
    u = S.column_distance([F.lit(0.25)] * 4, t, metric)
    g = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_variable"), F.avg(d).alias("distance"), F.avg(u).alias("_base"))
    return g.select(*keys, "n_variable", "distance", F.when(F.col("_base") > 0, 1 - F.col("distance") / F.col("_base")).otherwise(0.0).alias("skill"))


def factor_features(matrix: DataFrame, key: str) -> DataFrame:
    """(key, features): 4 mean base weights and 16 mean products of neighbouring columns' weights, over L - 1 but at
    least 1."""
    nxt = {b: F.lead(b).over(W.partitionBy(key).orderBy("pos")) for b in ACGT}
    m = matrix.withColumns({f"_{b}": nxt[b] for b in ACGT})
    pairs = [(x, y) for x in ACGT for y in ACGT]
    aggs = [F.avg(b).alias(f"m_{b}") for b in ACGT] + [(F.coalesce(F.sum(F.col(x) * F.col(f"_{y}")), F.lit(0.0)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias(f"d_{x}{y}") for x, y in pairs]
    g = m.groupBy(key).agg(*aggs)
    return g.select(key, F.array(*[F.col(f"m_{b}") for b in ACGT], *[F.col(f"d_{x}{y}") for x, y in pairs]).alias("features"))


#: Known motifs that a case is compared with.
KNOWN = 1_000


def best_match(cases: DataFrame, known: DataFrame, columns: int | None = 12) -> DataFrame:
    """The known motif that a case's matrix resembles most, after transfer of the known one into the case's frame.

    cases: (case, spacer, pos, a..t); known: rows (name, motif, spacer). Returns (case, name, skill), best first by skill and
    name. The known motifs are KNOWN at most, so each case has a bounded number of rows."""
    if known.count() > KNOWN:
        raise ValueError(f"more than {KNOWN} known motifs")
    c = kmers.settled(cases if columns is None else cases.where(F.col("pos") < columns))
    frame = c.groupBy("case", "spacer").agg((F.max("pos") + 1).alias("dst_len"))
    k = F.broadcast(known.select(F.col("name"), "motif", F.col("spacer").alias("src_spacer"), F.length("motif").alias("src_len")))
    pairs = frame.crossJoin(k).select(F.concat_ws("|", "case", "name").alias("pair"), "case", "name", "spacer", "src_spacer", "src_len", "dst_len")
    source = of_motifs(known.withColumnRenamed("name", "id"), ["id"])
    moved = transfer(pairs.select(F.col("pair").alias("case"), F.col("name").alias("src"), "src_spacer", "src_len", F.col("spacer").alias("dst_spacer"), "dst_len"), source).withColumnRenamed("case", "pair")
    truth = pairs.select("pair", "case", "spacer").join(c.select("case", "pos", *ACGT), "case")
    scored = evaluate(moved, truth, pairs.select("pair", "spacer"), ["pair"]).join(pairs.select("pair", "case", "name"), "pair")
    rank = F.row_number().over(W.partitionBy("case").orderBy(F.desc("skill"), "name"))
    return scored.withColumn("r", rank).where("r = 1").select("case", "name", "skill")
