import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from seqloom.llm import clustering

V = "vec_id long, embedding array<double>"


def brute(rows, clusters, rounds, dimensions, steps):
    kept = [(i, [math.floor(steps * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and -(2.0**63) <= steps * x < 2.0**63 for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]
    if not kept:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        centroids = [[sum(x) // len(x) for x in zip(*(v for (_, v), k in zip(kept, of) if k == j))] if j in of else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    fits = lambda x: x if x < 2**63 else None
    each = {k: sum(d for _, c, d in found if c == k) for _, k, _ in found}
    lost = {k for _, k, d in found if d >= 2**63}
    total = None if lost or any(s >= 2**63 for s in each.values()) else fits(sum(each.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, fits(d), None if k in lost else fits(each[k]), total, sha[k]) for i, k, d in found]


def both(spark, rows, clusters=4, rounds=3, dimensions=3, steps=64, parts=3):
    got = clustering.lloyd(spark.createDataFrame(rows, V).repartition(parts), clusters=clusters, rounds=rounds, dimensions=dimensions, steps=steps)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    order = lambda x: tuple((y is not None, y if y is not None else 0) for y in x[:3])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(brute(rows, clusters, rounds, dimensions, steps), key=order)


def test_random_vectors(spark):
    r = np.random.default_rng(3)
    both(spark, [(i, (r.normal(size=3) * 2).tolist()) for i in range(200)])


def test_ties_repeats_and_empty_clusters(spark):
    both(spark, [(i % 9, [float(i % 2), 0.0, -0.0078125]) for i in range(40)], clusters=6)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 0.0, 0.0]), (7, [0.1, -0.1, 0.5]), (None, [0.3, 0.3, 0.3]), (None, [0.2, 0.3, 0.3]), (8, [1e300, 0.0, 0.0])]
    both(spark, rows)


def test_components_beyond_safe_products(spark):
    r = np.random.default_rng(4)
    both(spark, [(i, (r.normal(size=3) * 10.0 ** int(i % 17)).tolist()) for i in range(60)])


def test_no_and_one_vector(spark):
    assert clustering.lloyd(spark.createDataFrame([], V)).collect() == []
    assert clustering.lloyd(spark.createDataFrame([(1, [1.0])], V)).collect() == []
    both(spark, [(5, [1.0, 2.0, 3.0])])


def test_clashing_columns(spark):
    rows = [(i, [0.1 * i, 0.2, 0.3]) for i in range(9)]
    wide = spark.createDataFrame(rows, V).withColumn("x", F.lit(1)).withColumn("id", F.lit("a")).withColumn("cluster", F.lit(7))
    got = clustering.lloyd(wide, clusters=2, dimensions=3)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 2, 3, 3, 64))
