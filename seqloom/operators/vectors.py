"""Embedding vectors: centroids, nearest neighbours under leave-one-group-out, heads and projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as S


def long_form(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    return df.select(*key, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "v"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, dim, v): mean vector of each label; partial sums before the shuffle."""
    return long_form(df, [label], vector).groupBy(label, "dim").agg(F.avg("v").alias("v"))


def packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vector) of (keys, dim, v)."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("vector"))


#: Vectors of either side that one task holds, about: it multiplies a block of queries with a block of items.
BLOCK = 2048


def nearest(queries: DataFrame, items: DataFrame, n: int = 1, block: int = BLOCK) -> DataFrame:
    """(qid, tid, cosine, rank): the items of greatest cosine for each query, other than itself; ties to the larger id.

    Exact: all queries against all items, in blocks of both (:func:`best_products`). Rows without an id or a vector, vectors
    with a null, a NaN or no length, and pairs of different lengths have no cosine. Rows that repeat an id count each."""

    def cosines(q: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (t / np.linalg.norm(t, axis=1, keepdims=True)).T

    return best_products(queries, items, cosines, n, block)


def best_products(queries: DataFrame, items: DataFrame, score, n: int, block: int = BLOCK) -> DataFrame:
    """(qid, tid, cosine, rank): the n items (id, vector) of greatest score for each query (id, vector), ties to the larger id.

    score takes a matrix of queries and one of items and gives the matrix of their scores; what isn't finite is left out.
    Both sides are dealt out to blocks by a hash of their ids; each pair of blocks is one group, so work is spread over
    (queries / block) x (items / block) tasks and none holds more than two blocks and their product. Of each product, a
    query's best n go on. No vector reaches the driver."""
    size = lambda df: max(1, -(-df.count() // block))
    side = lambda df, i, v: df.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select(F.col("id").alias(i), F.col("vector").cast("array<double>").alias(v))
    q, t = side(queries, "qid", "qv"), side(items, "tid", "tv")
    rows, columns = size(q), size(t)
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    q = q.withColumns({"_d": F.size("qv"), "_i": own("qid", rows)}).withColumn("_j", each(columns))
    t = t.withColumns({"_d": F.size("tv"), "_j": own("tid", columns)}).withColumn("_i", each(rows))
    schema = T.StructType([q.schema["qid"], t.schema["tid"], T.StructField("cosine", T.DoubleType())])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "tid": [], "cosine": []})
        order = np.argsort(right["tid"].to_numpy(), kind="stable")
        ids, tid = left["qid"].to_numpy(), right["tid"].to_numpy()[order]
        with np.errstate(divide="ignore", invalid="ignore"):
            got = score(np.array(left["qv"].tolist(), float), np.array(right["tv"].tolist(), float)[order])
        got[(ids[:, None] == tid[None, :]) | ~np.isfinite(got)] = -np.inf
        rank = np.lexsort((np.broadcast_to(-np.arange(len(tid)), got.shape), -got))[:, :n]
        at = np.repeat(np.arange(len(ids)), rank.shape[1])
        found = pd.DataFrame({"qid": ids[at], "tid": tid[rank.ravel()], "cosine": got[at, rank.ravel()]})
        return found[np.isfinite(found["cosine"])]

    pairs = ["_d", "_i", "_j"]
    out = q.groupBy(*pairs).cogroup(t.groupBy(*pairs)).applyInPandas(best, schema)
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("cosine"), F.desc("tid")))
    return out.withColumn("rank", rank).where(F.col("rank") <= n)


def leave_one_out_neighbours(labels: DataFrame, center: bool = True, block: int = BLOCK) -> DataFrame:
    """(held, other, cosine) for each label held out: its nearest other label, by vectors less the mean of the others.

    labels: (label, vector), a row a label, of one length. The mean is of the training rows alone, so the held-out vector
    leaks nothing. It is (sum - held) / (n - 1), so centring corrects the products of uncentred vectors by terms of the
    held-out vector and the sum, which is all that the driver gets. Ties go to the larger name; one label has no other."""
    rows = labels.select(F.col("label").alias("id"), "vector")
    n = rows.count()
    if center and n > 1:
        total = np.array([r.s for r in long_form(rows, ["id"], "vector").groupBy("dim").agg(F.sum("v").alias("s")).orderBy("dim").collect()])
    else:
        total = None

    def centred(q: np.ndarray, t: np.ndarray) -> np.ndarray:
        mean = np.zeros_like(q) if total is None else (total - q) / (n - 1)
        held = q - mean
        products = held @ t.T - (held * mean).sum(axis=1)[:, None]
        squares = (t * t).sum(axis=1)[None, :] - 2 * mean @ t.T + (mean * mean).sum(axis=1)[:, None]
        return products / (np.linalg.norm(held, axis=1)[:, None] * np.sqrt(np.maximum(squares, 0)))

    found = best_products(rows, rows, centred, 1, block)
    return found.select(F.col("qid").alias("held"), F.col("tid").alias("other"), "cosine")


#: Rows of a labelled set that is compared with all of another.
LABELS = 10_000


def separation(left: DataFrame, right: DataFrame) -> DataFrame:
    """(same, other, difference, nn_right, n): mean cosine of rows (key, vector) of equal keys and of different keys, and
    for how many of the left rows the nearest right row has their key. Both sides are small labelled sets."""
    a = left.select(F.col("key").alias("k1"), F.col("vector").alias("v1"))
    if right.count() > LABELS:
        raise ValueError(f"more than {LABELS} labelled rows")
    b = F.broadcast(right.select(F.col("key").alias("k2"), F.col("vector").alias("v2")))
    c = a.crossJoin(b).select("k1", "k2", S.cosine(F.col("v1"), F.col("v2")).alias("c"))
    means = c.agg(F.avg(F.when(F.col("k1") == F.col("k2"), F.col("c"))).alias("same"), F.avg(F.when(F.col("k1") != F.col("k2"), F.col("c"))).alias("other"))
    nn = c.groupBy("k1").agg(F.max(F.struct("c", "k2")).alias("b")).agg(F.count_if(F.col("b.k2") == F.col("k1")).alias("nn_right"), F.count(F.lit(1)).alias("n"))
    return means.crossJoin(nn).select("same", "other", (F.col("same") - F.col("other")).alias("difference"), "nn_right", "n")


def pool(df: DataFrame, vectors: str, start: str | None = None, stop: str | None = None, positions: str | None = None) -> DataFrame:
    """df with pooled: the mean of per-residue vectors (array of arrays) over a span [start, stop), over listed positions, or over all."""
    rows = F.col(vectors)
    if positions:
        rows = F.transform(positions, lambda i: F.get(F.col(vectors), i))
    elif start:
        rows = F.slice(rows, F.col(start) + 1, F.col(stop) - F.col(start))
    n = F.size(rows)
    pooled = F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda d: F.aggregate(rows, F.lit(0.0), lambda acc, v: acc + F.get(v, d).cast("double")) / n)
    return df.withColumn("pooled", F.when(n > 0, pooled))


def first_token(df: DataFrame, vectors: str) -> DataFrame:
    """df with pooled: the first of the per-token vectors, where a model puts what it makes of the whole; null without any."""
    return df.withColumn("pooled", F.transform(F.get(F.col(vectors), F.lit(0)), lambda v: v.cast("double")))


HEAD = "fold string, l2 double, slot int, weights array<double>, bias array<double>, dim int"


def train_heads(examples: DataFrame, steps: int = 1500, classes: int = 4) -> DataFrame:
    """Softmax regression for each (fold, l2, slot): examples (fold, l2, slot, x array, y distribution array).

    Full-batch gradient descent from zero, a fixed number of steps of 1 / (1 + l2), the bias without penalty: with a
    handful of examples the result depends on the stopping step, so no solver that runs to convergence replaces it. A
    group is a handful of rows by contract."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["x"].tolist(), float)
        y = np.array(pdf["y"].tolist(), float)
        l2 = float(pdf["l2"].iloc[0])
        n, d = x.shape
        w, b, rate = np.zeros((classes, d)), np.zeros(classes), 1 / (1 + l2)
        for _ in range(steps):
            z = x @ w.T + b
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True) - y
            w -= rate * (g.T @ x / n + l2 * w)
            b -= rate * g.mean(axis=0)
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "l2": [l2], "slot": [int(pdf["slot"].iloc[0])], "weights": [w.ravel()], "bias": [b], "dim": [d]})

    return examples.groupBy("fold", "l2", "slot").applyInPandas(fit, HEAD)


def predict_heads(heads: DataFrame, features: DataFrame, classes: int = 4) -> DataFrame:
    """(fold, l2, slot, a, c, g, t) for the features (fold, x) of what each fold holds out."""
    j = heads.join(features, "fold")
    z = F.array(*[F.aggregate(F.zip_with(F.slice("weights", F.col("dim") * k + 1, F.col("dim")), "x", lambda w, x: w * x), F.lit(0.0), lambda acc, v: acc + v) + F.get("bias", F.lit(k)) for k in range(classes)])
    return j.withColumn("p", S.softmax(z)).select("fold", "l2", "slot", *[F.get("p", F.lit(i)).alias(b) for i, b in enumerate("acgt")])


def build_examples(features: DataFrame, motifs: DataFrame) -> DataFrame:
    """(name, slot, x, y) of features (name, x) and motifs (name, motif, spacer): for each slot of the common frame that a
    motif has a letter in, that letter as a distribution."""
    from . import pwm

    slots = pwm.to_slots(pwm.of_motifs(motifs, ["name", "spacer"]))
    top = F.greatest(*[F.col(b) for b in pwm.ACGT])
    first = F.array_position(F.array(*[F.col(b) == top for b in pwm.ACGT]), True)
    y = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i == first, 1.0).otherwise(0.0))
    return features.join(slots.select("name", "slot", y.alias("y")), "name").select("name", "slot", "x", "y")


def held_out_features(vectors_: DataFrame, projection: np.ndarray | None = None) -> DataFrame:
    """(held, name, x) for each of the labelled vectors (name, vector) held out: all vectors less the mean of the others,
    projected if a matrix (dimensions, components) is given, and divided by the others' mean norm."""
    if vectors_.count() > LABELS:
        raise ValueError(f"more than {LABELS} labelled rows")
    each = long_form(vectors_, ["name"], "vector")
    total = each.groupBy("dim").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = each.join(total, "dim").select(F.col("name").alias("held"), "dim", ((F.col("s") - F.col("v")) / (F.col("n") - 1)).alias("m"))
    centred = mean.join(each, "dim").select("held", "name", "dim", (F.col("v") - F.col("m")).alias("v"))
    x = packed(centred, ["held", "name"]).withColumnRenamed("vector", "x")
    if projection is not None:
        columns = [F.array(*[F.lit(float(v)) for v in c]) for c in projection.T]
        x = x.withColumn("x", F.array(*[S.dot(F.col("x"), c) for c in columns]))
    x = x.withColumn("norm", F.sqrt(S.dot(F.col("x"), F.col("x"))))
    scale = x.where("held <> name").groupBy("held").agg((F.avg("norm") + 1e-8).alias("scale"))
    return x.join(scale, "held").select("held", "name", F.transform("x", lambda v: v / F.col("scale")).alias("x"))


def lopo_head(vectors_: DataFrame, motifs: DataFrame, l2s: list[float], projection: np.ndarray | None = None, steps: int = 1500) -> DataFrame:
    """(name, l2, n_variable, distance, skill): the matrix that heads trained on the other names predict for each name that
    is held out, graded against its motif.

    vectors_: (name, vector); motifs: (name, motif, spacer). Slots that no other name has are 0.25 throughout; the anchors
    are the held motif's own."""
    from . import pwm

    spark = vectors_.sparkSession
    features = held_out_features(vectors_, projection)
    train = features.where("held <> name")
    examples = build_examples(train.select("name", F.struct("held", "x").alias("x")), motifs).select(F.col("x.held").alias("fold"), "slot", F.col("x.x").alias("x"), "y")
    grid = spark.createDataFrame([(float(v),) for v in l2s], "l2 double")
    heads = train_heads(examples.crossJoin(F.broadcast(grid)).select("fold", "l2", "slot", "x", "y"), steps)
    predicted = predict_heads(heads, features.where("held = name").select(F.col("held").alias("fold"), "x"))
    cases = motifs.crossJoin(F.broadcast(grid)).withColumn("case", F.concat_ws("|", "name", "l2"))
    full = pwm.of_motifs(cases, ["case", "name", "l2", "spacer"])
    slots = predicted.select(F.concat_ws("|", "fold", "l2").alias("case"), "slot", *pwm.ACGT)
    made = pwm.from_slots(slots, cases.select("case", "spacer", F.length("motif").alias("length")), full.select("case", "pos", *pwm.ACGT))
    graded = pwm.evaluate(made, full.select("case", "pos", *pwm.ACGT), cases.select("case", "spacer"), ["case"])
    return graded.join(cases.select("case", "name", "l2"), "case").select("name", "l2", "n_variable", "distance", "skill")


def centred_neighbours(known: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, other, cosine): the known label (label, vector) nearest to each target (label, vector), all less the mean of
    the known ones; ties to the larger name."""
    k, t = long_form(known, ["label"], "vector"), long_form(targets, ["label"], "vector")
    mean = k.groupBy("dim").agg(F.avg("v").alias("m"))
    less = lambda df: packed(df.join(F.broadcast(mean), "dim").select("label", "dim", (F.col("v") - F.col("m")).alias("v")), ["label"])
    found = nearest(less(t).select(F.concat(F.lit("t"), "label").alias("id"), "vector"), less(k).select(F.concat(F.lit("k"), "label").alias("id"), "vector"))
    return found.select(F.substring("qid", 2, 1 << 20).alias("target"), F.substring("tid", 2, 1 << 20).alias("other"), "cosine")


def pls(df: DataFrame, x: str, y: str, components: int = 12, iterations: int = 500, tol: float = 1e-9) -> dict:
    """Partial least squares of y on x, centred and not scaled, by deflation of cross-products.

    The cluster sums means, X'X and X'Y in one pass of partial sums (dimensions squared values); the driver then works on
    those matrices alone. Rows with a value that isn't finite are left out. Returns rotations, means and in-sample R2."""
    rows = df.where(S.finite(F.col(x)) & S.finite(F.col(y))).select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"))

    def partial(batches):
        s = None
        for pdf in batches:
            if len(pdf):
                a = np.hstack([np.ones((len(pdf), 1)), np.array(pdf["x"].tolist()), np.array(pdf["y"].tolist())])
                s = a.T @ a if s is None else s + a.T @ a
        if s is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(len(s)), len(s)), "j": np.tile(np.arange(len(s)), len(s)), "v": s.ravel()})

    first = rows.first()
    if first is None:
        raise ValueError("no finite rows")
    p, q = len(first.x), len(first.y)
    moments = np.zeros((1 + p + q, 1 + p + q))
    for r in rows.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (1 + p + q)^2 values
        moments[r.i, r.j] = r.v
    n, mean = moments[0, 0], moments[0, 1:] / moments[0, 0]
    c = moments[1:, 1:] - n * np.outer(mean, mean)
    xx, xy, yy = c[:p, :p], c[:p, p:], c[p:, p:]
    k = min(components, p, int(n) - 1)
    rotations, loadings, deflated, remain = [], [], xy.copy(), np.eye(p)
    for _ in range(k):
        u, s, _ = np.linalg.svd(deflated, full_matrices=False)
        if s[0] < tol:
            break
        w = u[:, 0] * np.sign(u[np.abs(u[:, 0]).argmax(), 0])
        r = remain @ w
        t2 = r @ xx @ r
        load = xx @ r / t2
        rotations.append(r)
        loadings.append(xy.T @ r / t2)
        remain = remain - np.outer(r, load)
        deflated = deflated - np.outer(load, xy.T @ r)
    rot, load_y = np.array(rotations).T, np.array(loadings)
    beta = rot @ load_y
    sse = np.trace(yy) - 2 * np.trace(beta.T @ xy) + np.trace(beta.T @ xx @ beta)
    return {"rotations": rot, "x_mean": mean[:p], "y_mean": mean[p:], "coefficients": beta, "r2": float(1 - sse / np.trace(yy)), "n": int(n)}


def r_squared(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: 1 - SSE / SST pooled over all outputs of (truth, predicted) vectors."""
    e = df.select(F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(predicted).alias("p"))).alias("dim", "x")).select("dim", "x.t", "x.p")
    per = e.groupBy("dim").agg(F.sum((F.col("t") - F.col("p")) ** 2).alias("sse"), (F.sum(F.col("t") ** 2) - F.sum("t") * F.sum("t") / F.count(F.lit(1))).alias("sst"))
    return per.agg((1 - F.sum("sse") / F.sum("sst")).alias("r2"))


def _embedder(key: str, embed, seq: str):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "vector": [np.asarray(v, float) for v in embed(pdf[seq].tolist())]})

    return run


def embed_pending(wanted: DataFrame, cached: DataFrame, key: str, embed, seq: str = "seq", least: int = 40) -> DataFrame:
    """(key, vector) of sequences that the cache lacks, by a function of a list of sequences, loaded once a worker."""
    todo = wanted.where(F.length(seq) >= least).join(cached.select(key), key, "left_anti")
    schema = T.StructType([todo.schema[key], T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return todo.select(key, seq).mapInPandas(_embedder(key, embed, seq), schema)


def embed_kept(wanted: DataFrame, path: str, key: str, embed, seq: str = "seq", least: int = 40, batch: int = 16, most: int | None = 300) -> DataFrame:
    """(key, vector) of wanted (key, ord, seq), kept in a table at path: as :func:`embed_pending`, about ``batch`` sequences a
    write, so a run that is stopped goes on where it was; up to ``most`` vectors in all, the first by ord."""
    from ..sources import rest

    schema = T.StructType([wanted.schema[key], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in _embedder(key, embed, seq)(batches):
            yield pdf.assign(error=None)

    work = lambda df: df.select(key, seq).mapInPandas(run, schema)
    return rest.resume(wanted.where(F.length(seq) >= least).select(key, "ord", seq), path, key, work, batch, most).select(key, "vector")
