"""Lloyd rounds against plain Python integers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from plethora.llm import centroids


def plain(rows, k=8, dim=64, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", [x.to_bytes(8, "little", signed=True) for x in r[1]])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(x) for x in zip(*own[j])] if j in own else c[j] for j in range(len(c))]
    told = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = {j: sum(d for _, k, d in told if k == j) for j in range(k)}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in told), key=str)


def of(df, **options):
    return sorted((tuple(r) for r in centroids.cluster(df, **options).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    some = [(i, [r.gauss(r.choice((-1, 0, 2)), 0.3) for _ in range(64)]) for i in range(90)]
    odd = [(200, None), (201, [0.5] * 63), (202, [0.5] * 63 + [None]), (203, [0.5] * 63 + [math.nan]), (204, [math.inf] + [0.5] * 63), (205, []), (None, [0.25] * 64), (None, [-0.25] * 64)]
    return some + some[:5] + [(7, [3.0] * 64)] + odd + [(300 + k, [0.125] * 64) for k in range(40)]


def test_odd_vectors_and_repeated_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1), "cluster": F.lit(2)}).repartition(3)
    got = of(df)
    assert got == plain(rows) and len({r[1] for r in got}) > 3


def test_large_components_are_exact(spark):
    rows = [(k, [float((-1) ** (k + at) * (10**9 * (k % 5) + 7919 * k * at)) for at in range(4)]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        of(df, dim=4, k=3)
    rows = [(k, [v / 10000 for v in x]) for k, x in rows]
    assert of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=4, k=3, rounds=4) == plain(rows, 3, 4, 4)
    with pytest.raises(Exception, match="beyond a long"):
        of(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_few_rows_and_none(spark):
    rows = [(1, [0.0] * 64), (2, [1.0] * 64), (3, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert of(df) == plain(rows)
    assert of(df.limit(0)) == [] and of(df.withColumn("embedding", F.lit(None).cast("array<float>"))) == []


def test_a_round_moves_sums_only(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    vectors = centroids.kept_vectors(df)
    parts = vectors.mapInPandas(centroids._assign(centroids.first_centroids(vectors), centroids._summing(8)), "cluster int, at int, sum string, n long")
    assert parts.count() <= vectors.rdd.getNumPartitions() * 8 * 64
