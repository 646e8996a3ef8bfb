"""Plain Lloyd clustering of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Clusters, rounds, components of a vector, and integer steps to 1.
CLUSTERS, ROUNDS, DIMENSIONS, STEPS = 16, 3, 64, 64
SEED = "1"
#: Up to this magnitude, a squared distance of 64 components surely fits 64 bits.
SAFE = 1 << 27
LONGEST = (1 << 63) - 1
#: 2^63: a component reaching it is no 64-bit integer.
BEYOND = float(1 << 63)
#: Sums are kept in two parts, so that they are exact whatever the components.
LOW = 32


def kept(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS, steps: int = STEPS) -> DataFrame:
    """(id, x): the vectors with exactly ``dimensions`` components, all of them numbers whose integer is a long."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (v * steps >= -BEYOND) & (v * steps < BEYOND))
    return vectors.where((F.size(x) == dimensions) & F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), x.alias("x"))


def integers(column: pd.Series, steps: int) -> np.ndarray:
    return np.floor(np.stack(column.to_numpy()) * float(steps)).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equals, and the squared distance: 64-bit integers, or Python's own
    where they could be too large."""
    if max(np.abs(x.astype(float)).max(initial=0), np.abs(centroids.astype(float)).max(initial=0)) > SAFE:
        x, centroids = x.astype(object), centroids.astype(object)
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(x)), cluster]


def _sums(x: DataFrame, centroids: np.ndarray, steps: int) -> DataFrame:
    """(cluster, dim, n, high, low): for each cluster and component, the vectors and the sum of the component's high and
    low parts, over all partitions."""
    sent = x.sparkSession.sparkContext.broadcast(centroids)
    size = centroids.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        n, high, low = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), np.zeros(c.shape, np.int64)
        for batch in batches:
            if len(batch):
                v = integers(batch["x"], steps)
                cluster, _ = nearest(v, c)
                n += np.bincount(cluster, minlength=len(c))
                np.add.at(high, cluster, v >> LOW)
                np.add.at(low, cluster, v & ((1 << LOW) - 1))
        yield pd.DataFrame({"cluster": np.repeat(np.arange(len(c)), c.shape[1]), "dim": np.tile(np.arange(c.shape[1]), len(c)), "n": np.repeat(n, c.shape[1]), "high": high.reshape(size), "low": low.reshape(size)})

    parts = x.select("x").mapInPandas(run, "cluster int, dim int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), wide("high"), wide("low"))


def start(x: DataFrame, clusters: int, seed: str, steps: int) -> np.ndarray:
    """The integers of the ``clusters`` vectors with the smallest hash of seed and id, then smallest components; a null id
    is empty text."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = x.select("x", key.alias("key")).orderBy("key", "x").limit(clusters).collect()
    return integers(pd.Series([np.array(r.x) for r in first]), steps) if first else np.zeros((0, 0), np.int64)


def next_centroids(x: DataFrame, centroids: np.ndarray, steps: int) -> np.ndarray:
    """The exact floor of each cluster's mean; an empty cluster keeps its centroid. What comes back is a row a centroid and
    component."""
    out = centroids.copy()
    for r in _sums(x, centroids, steps).where("n > 0").collect():
        out[r.cluster, r.dim] = ((int(r.high) << LOW) + int(r.low)) // r.n
    return out


def assign(x: DataFrame, centroids: np.ndarray, steps: int) -> DataFrame:
    """(id, cluster, distance): distance is null where no long holds it."""
    sent = x.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cluster, far = nearest(integers(batch["x"], steps), sent.value)
                held = pd.array([d if d <= LONGEST else None for d in far.tolist()], "Int64")
                yield pd.DataFrame({"id": batch["id"], "cluster": cluster, "distance": held})

    return x.mapInPandas(run, f"id {x.schema['id'].dataType.simpleString()}, cluster int, distance long")


def lloyd(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, steps: int = STEPS, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): a row a kept vector after ``rounds`` rounds.

    Components become floor(steps * x). Centroids are sent to all tasks (``clusters`` rows); each task takes integer squared
    differences a centroid at a time and sums its own vectors, and a groupBy merges the sums. All of it is exact.

    Vectors that are null, have other than ``dimensions`` components, or one that is null, no number, infinite or beyond a
    long's range, are left out. Rows that repeat count each time; null ids are kept. With fewer vectors than ``clusters``
    there are as many centroids as vectors; equal centroids leave the later ones empty. A distance or sum that no long
    holds is null. Other columns take no part. An empty table gives no rows."""
    x = kept(vectors, id_col, vec_col, dimensions, steps)
    spark = vectors.sparkSession
    centroids = start(x, clusters, seed, steps)
    if not len(centroids):
        return assign(x.limit(0), np.zeros((1, dimensions), np.int64), steps).select(F.col("id").alias(id_col), "cluster", "distance", F.lit(None).cast("long").alias("cluster_inertia"), F.lit(None).cast("long").alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = next_centroids(x, centroids, steps)
    found = assign(x, centroids, steps)
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    sums = {r.cluster: None if r.lost or r.s > LONGEST else int(r.s) for r in each}
    total = None if None in sums.values() else sum(sums.values())
    total = None if total is None or total > LONGEST else total
    about = [(c, sums[c], total, sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(sums)]
    clusters_ = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters_), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
