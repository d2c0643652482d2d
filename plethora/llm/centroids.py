"""Centroid clustering: plain Lloyd over integer vectors, exact to the last digit.

Components become floor(SCALE * x), so distances and sums are integers and come out alike in whatever order rows are added up.
A round broadcasts the centroids (k times dim integers, whatever the table) and runs ``mapInPandas``: numpy squares the differences
to one centroid after the other, the least distance wins and of equal ones the lowest number, and a task returns one sum per
cluster and component. groupBy merges those; the driver gets k times dim sums and divides them exactly.

Scale: the kept vectors are written once as integers of eight bytes; rounds read them without a shuffle of rows, so a vector that
a third of all rows share, or a cluster that holds all, changes nothing. Only sums are shuffled.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out. Initial
centroids are the k rows with the smallest hash of their id; rows without an id come last, and rows of equal ids follow by their
components. With fewer than k rows each is one. Repeated rows each count. An empty cluster keeps its centroid. Extra columns are
ignored, whatever their names. An empty table, or one without a kept vector, gives an empty table. The job fails with a message where
a component or a distance is beyond a long, as no result column could hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plethora.llm.common import column, staged, table

K, DIM, SCALE, ROUNDS = 8, 64, 1024, 10
#: Integers up to this size have distances that fit a long at up to 64 components; beyond it they are made of Python's integers.
NARROW, ROWS = 1 << 27, 4096


def kept_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """id, v: the integers of each kept vector as little-endian bytes, a staged table."""
    v = column(vector_col)
    whole = F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")), F.lit(False)) & ~F.isnan(x.cast("double")))
    whole_number = lambda x: F.when(F.abs(x) < 2.0**62, F.floor(x)).otherwise(F.raise_error(F.lit("a component is beyond a long")).cast("long"))
    kept = rows.where((F.size(v) == dim) & whole).select(column(id_col).alias("id"), F.transform(v, lambda x: whole_number(x.cast("double") * scale)).alias("v"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "v": [x.astype("<i8").tobytes() for x in batch["v"]]})

    return staged(kept.mapInPandas(pack, f"id {kept.schema['id'].dataType.simpleString()}, v binary"), "vectors")


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """Those of the k rows with the smallest hash of `3:<id>`, in its order."""
    key = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.select("v", key.alias("key")).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], "<i8") for r in first], np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact: columns are centroids."""
    wide = x.shape[1] > 64 or max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) > NARROW
    found = np.empty((len(x), len(centroids)), object if wide else np.int64)
    for j, c in enumerate(centroids):
        diff = x.astype(object) - c.astype(object) if wide else x - c
        found[:, j] = (diff * diff).sum(1)
    return found


def _assign(centroids: np.ndarray, make: Callable) -> Callable:
    """A mapInPandas function: make gets slices of ids, components, clusters and distances; what it returns is put out, and at the end what it returns for nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        put = make()
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                part = batch.iloc[low : low + ROWS]
                x = np.frombuffer(b"".join(part["v"]), "<i8").reshape(len(part), -1)
                d = distances(x, centroids)
                cluster = d.argmin(1)  # the first of equal ones
                yield from put(part["id"], x, cluster, d[np.arange(len(x)), cluster])
        yield from put(None, None, None, None)

    return run


def _summing(k: int) -> Callable:
    """Per task: cluster, at, sum (as decimal digits), n."""

    def make() -> Callable:
        state: dict = {}

        def put(ids, x, cluster, d):
            if ids is not None:
                wide = np.abs(x).max(initial=0) > NARROW
                for j in np.unique(cluster).tolist():
                    own = x[cluster == j]
                    total = (own.astype(object) if wide else own).sum(0).astype(object)
                    was, n = state.get(j, (0, 0))
                    state[j] = (was + total, n + len(own))
            elif state:
                rows = [(j, at, str(s), n) for j, (sums, n) in state.items() for at, s in enumerate(sums.tolist())]
                yield pd.DataFrame(rows, columns=["cluster", "at", "sum", "n"])

        return put

    return make


def _telling() -> Callable:
    def put(ids, x, cluster, d):
        if ids is not None:
            if len(d) and max(d.tolist()) >= 1 << 63:
                raise ValueError("a squared distance is beyond a long")
            yield pd.DataFrame({"id": ids, "cluster": cluster.astype(np.int32), "distance": d.astype(np.int64)})

    return put


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, first: np.ndarray | None = None) -> np.ndarray:
    """Centroids after the rounds, one per row; of no vector, none."""
    centroids = first_centroids(vectors, k) if first is None else first
    for _ in range(rounds if len(centroids) else 0):
        parts = vectors.mapInPandas(_assign(centroids, _summing(k)), "cluster int, at int, sum string, n long")
        merged = parts.groupBy("cluster", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in merged.collect():  # at most k times dim rows
            centroids[r["cluster"], r["at"]] = int(r["sum"]) // r["n"]
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance: each vector's nearest centroid."""
    kind = vectors.schema["id"].dataType.simpleString()
    if not len(centroids):
        return vectors.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    return vectors.mapInPandas(_assign(centroids, _telling), f"id {kind}, cluster int, distance long")


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dim: int = DIM, scale: int = SCALE, rounds: int = ROUNDS) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    vectors = kept_vectors(rows, id_col, vector_col, dim, scale)
    centroids = fit(vectors, k, rounds)
    told = staged(assign(vectors, centroids), "assigned")
    sums = told.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row per cluster
    said = [(r["cluster"], r["cluster_inertia"], sum(s["cluster_inertia"] for s in sums), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    beside = rows.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(beside), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _sql() -> str:
    near = """SELECT v.vec_id, v.e, v.r, arg_min(c.j, (c.d, c.j)) AS cluster, min(c.d) AS distance
  FROM v, LATERAL (SELECT j, list_sum(list_transform(generate_series(1, {dim}), lambda i: (v.e[i] - c.c[i]) * (v.e[i] - c.c[i])))::BIGINT AS d FROM c{n} c) c GROUP BY v.vec_id, v.e, v.r""".format(dim=DIM, n="{n}")
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e, row_number() OVER () AS r FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIM})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS j, e AS c FROM v QUALIFY j < {K})"]
    for n in range(ROUNDS):
        parts.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        parts.append(f"""s{n} AS (SELECT cluster, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM a{n}, generate_series(1, {DIM}) AS g(i) GROUP BY cluster, i)""")
        parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce((SELECT list((s - ((s % n + n) % n)) // n ORDER BY i) FROM s{n} WHERE cluster = c.j), c.c) AS c FROM c{n} c)""")
    parts.append(f"a{ROUNDS} AS MATERIALIZED ({near.format(n=ROUNDS)})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.j = a.cluster"""


SQL = _sql()
