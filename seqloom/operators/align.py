"""Pairwise alignment, candidate search by shared words, one-to-one assignment and reciprocal checks."""

from __future__ import annotations

from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kmers

# The BLOSUM62 matrix as published (S. and J. Henikoff, 1992), rows and columns in the order of RESIDUES.
RESIDUES = "ARNDCQEGHILKMFPSTWYVBZX*"
_BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""
BLOSUM62 = np.array([[int(x) for x in line.split()] for line in _BLOSUM62.split("\n") if line.strip()], float)
_INDEX = np.full(256, RESIDUES.index("X"), np.int64)
for _i, _c in enumerate(RESIDUES):
    _INDEX[ord(_c)] = _i
LOW = -1e18


def _codes(s: str) -> np.ndarray:
    return _INDEX[np.frombuffer(s.upper().encode("latin-1", "replace"), np.uint8)]


#: Cells of one alignment: a byte each is kept for the way back.
CELLS = 1 << 31


def align(a: str, b: str, local: bool, open_: float, extend: float, matrix: np.ndarray | None = None) -> tuple[float, list[tuple[int, int]]]:
    """(score, aligned pairs of places) by affine gaps; a gap's first letter costs open_, each more extend. Without a matrix,
    equal letters score 1 and others 0.

    Row by row over a, each row as a vector: a gap along the row is a running maximum once the extensions are taken out.
    Scores are kept for two rows; of each cell a byte says where its three states come from. Longer pairs than CELLS are an
    error, not a cut alignment."""
    n, m = len(a), len(b)
    if not n or not m:
        return (0.0 if local else (open_ + extend * (max(n, m) - 1) if max(n, m) else 0.0)), []
    if (n + 1) * (m + 1) > CELLS:
        raise ValueError(f"an alignment of {n} and {m} letters has more than {CELLS} cells")
    if matrix is None:
        ca, cb = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, b))
        row_of = lambda c: (cb == c).astype(float)
    else:
        ca, cb = _codes(a), _codes(b)
        profile = matrix[:, cb]
        row_of = profile.__getitem__
    cols, eps, near = np.arange(m + 1), 1e-9, 1e-6
    # Bits 0-1 of a cell: the state before a pair (3: the alignment begins with it); 2-3: before a letter of a against a
    # gap; 4-5: before a letter of b against a gap. States are 0 a pair, 1 and 2 the gaps.
    came = np.zeros((n + 1, m + 1), np.uint8)
    M, X, Y = np.full(m + 1, LOW), np.full(m + 1, LOW), np.full(m + 1, LOW)
    if local:
        M[:] = 0.0
    else:
        M[0] = 0.0
        Y[1:] = open_ + extend * (cols[1:] - 1)
        came[0, 2:] = 2 << 4
    top = (0.0, 0, 0)
    for i in range(1, n + 1):
        best = np.maximum(np.maximum(M, X), Y)[:-1]
        pair = np.where(best - M[:-1] <= near, 0, np.where(best - X[:-1] <= near, 1, 2))
        new = np.full(m + 1, LOW)
        new[1:] = best + row_of(ca[i - 1])
        if local:
            pair = np.where((np.abs(best) <= eps) & (M[:-1] <= eps), 3, pair)
            new = np.maximum(new, 0.0)
        down = np.maximum(np.maximum(M, Y) + open_, X + extend)
        gap = np.where((down - (X + extend) <= near) & (i > 1), 1, np.where(down - (M + open_) <= near, 0, 2))
        start = np.maximum(new, down) + open_
        along = np.full(m + 1, LOW)
        along[1:] = np.maximum.accumulate(start - extend * cols)[:-1] + extend * (cols[1:] - 1)
        longer = (np.abs(along[:-1] + extend - along[1:]) <= near) & (cols[1:] > 1)
        side = np.where(longer, 2, np.where(np.abs(new[:-1] + open_ - along[1:]) <= near, 0, 1))
        came[i] = gap << 2
        came[i, 1:] |= (pair | side << 4).astype(np.uint8)
        M, X, Y = new, down, along
        if local:
            j = int(M.argmax())
            if M[j] > top[0]:
                top = (float(M[j]), i, j)
    if local:
        score, i, j = top
        state = 0
        if score <= eps:
            return 0.0, []
    else:
        i, j = n, m
        ends = (M[m], X[m], Y[m])
        state = int(np.argmax(ends))
        score = ends[state]
    pairs = []
    while i > 0 or j > 0:
        cell = int(came[i, j])
        if state == 0:
            if i == 0 or j == 0:
                break
            pairs.append((i - 1, j - 1))
            i, j, state = i - 1, j - 1, cell & 3
            if state == 3:
                break
        elif state == 1:
            i, state = i - 1, cell >> 2 & 3
        else:
            j, state = j - 1, cell >> 4 & 3
    return float(score), pairs[::-1]


def identity(a: str | None, b: str | None) -> float:
    """Percent of equal letters among aligned pairs of a global alignment (1 / 0 / -0.5 / -0.1); 0.0 where there is none."""
    if not a or not b:
        return 0.0
    _, pairs = align(a, b, False, -0.5, -0.1)
    return 100.0 * sum(a[i] == b[j] for i, j in pairs) / len(pairs) if pairs else 0.0


def residue_identity(a: str | None, b: str | None) -> float:
    """Share of equal letters of a global BLOSUM62 alignment (-10 / -0.5) in the longer sequence."""
    if not a or not b:
        return 0.0
    _, pairs = align(a, b, False, -10.0, -0.5, BLOSUM62)
    return sum(a[i] == b[j] for i, j in pairs) / max(len(a), len(b))


def local_stats(a: str | None, b: str | None) -> tuple[float, float, float]:
    """(score, identity %, coverage %): local BLOSUM62 alignment (-11 / -1); coverage is aligned letters of a."""
    if not a or not b:
        return 0.0, 0.0, 0.0
    score, pairs = align(a, b, True, -11.0, -1.0, BLOSUM62)
    if not pairs:
        return score, 0.0, 0.0
    same = sum(a[i].upper() == b[j].upper() for i, j in pairs)
    return score, 100.0 * same / len(pairs), 100.0 * len(pairs) / len(a)


def with_identity(df: DataFrame, a: str, b: str, name: str = "identity", by=identity) -> DataFrame:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([by(p, q) for p, q in zip(x, y)], dtype="float64")

    return df.withColumn(name, run(F.col(a), F.col(b)))


def with_local_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    @F.pandas_udf("score double, identity double, coverage double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([local_stats(p, q) for p, q in zip(x, y)], columns=["score", "identity", "coverage"], dtype="float64")

    return df.withColumn("_s", run(F.col(a), F.col(b))).select(*df.columns, "_s.*")


def best_hits(queries: DataFrame, targets: DataFrame, k: int = 5, prefilter: int = 30) -> DataFrame:
    """(qid, tid, shared, score, identity, coverage, rank): the targets that share most k-mers, aligned and ranked by score;
    ties keep the order of the prefilter. queries and targets: (seq_id, seq)."""
    c = kmers.shared_kmers(queries, targets, k, prefilter).withColumnRenamed("rank", "prefilter_rank")
    j = c.join(queries.select(F.col("seq_id").alias("qid"), F.col("seq").alias("qs")), "qid").join(targets.select(F.col("seq_id").alias("tid"), F.col("seq").alias("ts")), "tid")
    # Alignments cost far more than their rows' bytes say: dealt out by number, which isn't merged again.
    n = max(j.sparkSession.sparkContext.defaultParallelism, int(j.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = with_local_stats(j.repartition(n, "qid", "tid"), "qs", "ts").drop("qs", "ts")
    return kmers.top_per_group(s, ["qid"], [F.desc("score"), "prefilter_rank"], prefilter).drop("prefilter_rank")


#: Cells of queries times candidates of one assignment, which one task solves.
ASSIGNED = 4_000_000


def cheapest_columns(cost: list[list[int | None]]) -> list[int] | None:
    """A column of its own for each row, of least total cost; None where the allowed cells (not None) leave no such choice.

    Rows join one by one along the cheapest alternating path, with potentials that keep all reduced costs from falling below
    0. Costs are whole numbers of any size, so the result is exact."""
    n = len(cost[0]) if cost else 0
    row_of: list[int | None] = [None] * n
    u, v = [0] * len(cost), [0] * n
    for start in range(len(cost)):
        least: list[int | None] = [None] * n
        came, done = [-1] * n, [False] * n
        row, column = start, -1
        while True:
            nearest = None
            for j in range(n):
                if done[j]:
                    continue
                if cost[row][j] is not None:
                    reduced = cost[row][j] - u[row] - v[j]
                    if least[j] is None or reduced < least[j]:
                        least[j], came[j] = reduced, column
                if least[j] is not None and (nearest is None or least[j] < least[nearest]):
                    nearest = j
            if nearest is None:
                return None
            step = least[nearest]
            u[start] += step
            for j in range(n):
                if done[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                elif least[j] is not None:
                    least[j] -= step
            column, done[nearest] = nearest, True
            if row_of[column] is None:
                break
            row = row_of[column]
        while column >= 0:
            before = came[column]
            row_of[column] = row_of[before] if before >= 0 else start
            column = before
    at = {r: j for j, r in enumerate(row_of) if r is not None}
    return [at[i] for i in range(len(cost))]


def _assigned(pdf: pd.DataFrame, queries: list) -> list[tuple]:
    """The (query, target) pairs of one problem (qid, tid, score, ord)."""
    from fractions import Fraction

    targets = sorted(pdf["tid"].unique())
    known = {(q, t): (Fraction(x) if not isinstance(x, float) else Fraction(*x.as_integer_ratio()), int(o)) for q, t, x, o in pdf[["qid", "tid", "score", "ord"]].itertuples(index=False)}
    if len(queries) * len(targets) > ASSIGNED:
        raise ValueError(f"more than {ASSIGNED} cells in one assignment")
    unit = lcm(*(x.denominator for x, _ in known.values()))
    # Order decides among equal totals, that of the first query first: digits below the scores' last.
    base = max((o for _, o in known.values()), default=0) + 1
    above = base ** len(queries)
    cost = [[None if (q, t) not in known else -int(known[q, t][0] * unit) * above + known[q, t][1] * base ** (len(queries) - 1 - i) for t in targets] for i, q in enumerate(queries)]
    chosen = cheapest_columns(cost)
    return [] if chosen is None else [(q, targets[j]) for q, j in zip(queries, chosen)]


def assign_one_to_one(scores: DataFrame, queries: list[str], order: str = "ord", by: list[str] | None = None) -> DataFrame:
    """(by, qid, tid): distinct targets for all queries with the largest total score; the first candidates in order among
    equals, that of the first query counting most.

    scores: (by, qid, tid, score, ord) of the candidates that a search before left, ord from 0 up and distinct for a query.
    Each value of ``by`` is a problem of its own, solved by one task within ASSIGNED cells, and problems are spread over
    tasks. Problems in which some query can get no target have no rows; candidates with a null take no part."""
    keys = by or []
    rows = scores.where(F.col("qid").isin(queries)).select(*keys, "qid", "tid", F.col("score").cast("double").alias("score"), F.col(order).cast("long").alias("ord")).dropna(subset=["qid", "tid", "score", "ord"])
    schema = T.StructType([*(rows.schema[c] for c in keys), rows.schema["qid"], rows.schema["tid"]])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        same = [pdf[c].iloc[0] for c in keys]
        return pd.DataFrame([(*same, q, t) for q, t in _assigned(pdf, queries)], columns=schema.names)

    return rows.withColumn("_problem", F.lit(0)).groupBy("_problem", *keys).applyInPandas(solve, schema)


def reciprocal(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(qid, tid, back, reciprocal): forward pairs with the best backward hit of their target; recorded, not enforced."""
    b = backward.where("rank = 1").select(F.col("qid").alias("tid"), F.col("tid").alias("back"))
    return forward.select("qid", "tid").join(b, "tid", "left").select("qid", "tid", "back", F.coalesce(F.col("back") == F.col("qid"), F.lit(False)).alias("reciprocal"))


def gene_coordinates(gff: DataFrame, order: str | None = None) -> DataFrame:
    """(gene, chrom, start, end, strand, locus, seqname) of gene rows; the last row of a gene wins, in file order or by a
    column."""
    from ..functions import sequence as S

    a = F.col("attributes")
    g = gff.where(F.col("type") == "gene").withColumn("ord", F.col(order) if order else F.monotonically_increasing_id())
    g = g.select(F.regexp_extract(a, r"ID=[Gg]ene:([^;]+)", 1).alias("gene"), F.col("seqid").alias("chrom"), "start", "end", "strand", S.gff_attribute(a, "locus").alias("locus"), S.gff_attribute(a, "sequence_name").alias("seqname"), "ord").where("gene <> ''")
    return g.groupBy("gene").agg(F.max_by(F.struct("chrom", "start", "end", "strand", "locus", "seqname"), "ord").alias("r")).select("gene", "r.*")


def with_distance(hits: DataFrame, coords: DataFrame, to: tuple[str, int]) -> DataFrame:
    """hits (gene, ...) with coordinates (empty where unknown) and the distance in Mb to a place on the same chromosome."""
    j = hits.join(coords, "gene", "left")
    return j.withColumn("distance_mb", F.when(F.col("chrom") == to[0], F.round(F.abs(F.col("start") - to[1]) / 1e6, 3)))


def with_locus(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """hits (qid, ...) with the locus of their query (qid, locus); hits of unknown queries have none."""
    return hits.join(queries.select("qid", "locus"), "qid", "left")


def without_gene(candidates: DataFrame, genes: DataFrame) -> DataFrame:
    """candidates (gene, ...) but those of the listed genes; a candidate without a gene stays."""
    return candidates.join(genes.select("gene").distinct(), "gene", "left_anti").select(*candidates.columns)


def genes_of_names(names: DataFrame, coords: DataFrame) -> DataFrame:
    """(seqname, gene): the gene of each sequence name; the first by name where several genes have one."""
    one = coords.where("seqname <> ''").groupBy("seqname").agg(F.min("gene").alias("gene"))
    return names.select("seqname").distinct().join(one, "seqname")


def collect_proteins(queries: DataFrame, orthologs: DataFrame, proteome: DataFrame, prefixes: tuple[str, str] = ("Cel_", "Cbr_")) -> DataFrame:
    """(label, paralog, protein, seq): the query proteins (paralog, protein, seq), and below them the proteins that a table of
    orthologs (paralog, protein) names, with their sequences (protein, seq); those without one are left out."""
    own = queries.select(F.concat(F.lit(prefixes[0]), "paralog").alias("label"), "paralog", "protein", "seq")
    other = orthologs.join(proteome, "protein").select(F.concat(F.lit(prefixes[1]), "paralog").alias("label"), "paralog", "protein", "seq")
    return own.unionByName(other)


def training_rows(factors: DataFrame, sequences: DataFrame, embedded: DataFrame) -> DataFrame:
    """(key, features, vector) of factors (key, features) that have a sequence (key) and an embedding (key, vector)."""
    return factors.join(sequences.select("key").distinct(), "key", "left_semi").join(embedded.select("key", "vector"), "key").select("key", "features", "vector")
