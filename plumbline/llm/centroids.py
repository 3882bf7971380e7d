"""Centroid clustering by sort-means, in exact integers.

In each round the other centroids are ordered by their distance from each centroid. A
vector begins at the centroid of the round before, at distance d, and meets the others in
that order until one lies strictly beyond 2 d: by the triangle inequality neither it nor
any after it can be as near. The vectors of one centroid are sorted by d, so those that
still go on are a prefix, and one matrix product serves them all.

A round is one pass: it reads what the round before wrote, and writes vectors with their
new centroids to the shared folder. Sums are made per task, then added by cluster, so the
driver gets k rows of sums and no vector but the k first centroids. A lost executor costs
its tasks of the present round only. The folder of a round is removed once the next one
is written.

Vectors that are null, of another length, or hold a null or non-finite component are left
out. A null id is assigned like others but begins no cluster. Repeated rows count once each;
among equal ids the smaller components come first. Equal distances go to the smaller
number. Fewer vectors than k give fewer centroids, none gives an empty result. Components
beyond what 64-bit distances allow (2**26 for 64 of them) raise an error. Columns besides
the id and the vector play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import to_arrow
from plumbline.session import remove, scratch

CLUSTERS, ROUNDS, DIMS, SCALE, SALT = 40, 5, 64, 256, "2"
SCHEMA = "id long, v array<int>, cluster int, distance long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def most(dims: int) -> int:
    """The largest component for which four times a squared distance fits 63 bits."""
    return 1 << ((61 - (dims - 1).bit_length()) // 2 - 1)


class SortMeans:
    """The centroids of one round with their neighbours in order."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = centroids.astype(np.int64)
        self.gaps = np.array([((self.c - x) ** 2).sum(axis=1) for x in self.c])
        self.order = np.argsort(self.gaps, axis=1, kind="stable")

    def assign(self, v: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector, its squared distance, and how many distances were computed."""
        largest = max(int(np.abs(v).max(initial=0)), int(np.abs(self.c).max()))
        kind = np.float64 if v.shape[1] * (2 * largest) ** 2 < 1 << 53 else np.int64  # either is exact
        v, c = v.astype(kind), self.c.astype(kind)
        norms, own = (v * v).sum(axis=1), (c * c).sum(axis=1)
        cluster, distance, work = before.copy(), np.zeros(len(v), np.int64), 0
        for start in np.unique(before):
            at = np.flatnonzero(before == start)
            d = norms[at] - 2 * (v[at] @ c[start]) + own[start]
            far = np.argsort(-d, kind="stable")
            at, d = at[far], d[far]
            x, n, reach = v[at], norms[at], -4 * d
            best, name = d.copy(), np.full(len(at), start, before.dtype)
            work += len(at)
            for j in self.order[start]:
                if j == start:
                    continue
                m = int(np.searchsorted(reach, -self.gaps[start, j], side="right"))  # gap <= 4 d, so not strictly beyond
                if not m:
                    break
                new = n[:m] - 2 * (x[:m] @ c[j]) + own[j]
                nearer = (new < best[:m]) | ((new == best[:m]) & (j < name[:m]))
                best[:m][nearer], name[:m][nearer] = new[nearer], j
                work += m
            cluster[at], distance[at] = name, best.astype(np.int64)
        return cluster, distance, work


def whole(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors kept, as floor(scale * x)."""
    e, bound = F.col(vector), most(dims)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(e.isNotNull() & (F.size(e) == dims)).where(F.coalesce(fine, F.lit(False)))
    error = F.raise_error(F.lit(f"a component is beyond {bound} steps")).cast("double")
    step = lambda x: F.when(F.abs(x.cast("double")) * scale < bound, F.floor(x.cast("double") * scale)).otherwise(error)
    return kept.select(F.col(vec_id).cast("long").alias("id"), F.transform(e, lambda x: step(x).cast("int")).alias("v"))


def first(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hashes, in their order."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = kept.where("id IS NOT NULL").select(mark.alias("_mark"), "v").orderBy("_mark", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def assigned(rows: DataFrame, centroids: np.ndarray, begun: bool) -> DataFrame:
    """(id, v, cluster, distance) for (id, v) or, once begun, (id, v, cluster, ...)."""
    schema = to_arrow(rows, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = SortMeans(centroids)
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1)
                flat = v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                before = batch.column(2).to_numpy(zero_copy_only=False) if begun else np.zeros(batch.num_rows, np.int32)
                cluster, distance, _ = table.assign(flat, before)
                yield pa.RecordBatch.from_arrays([batch.column(0), v.cast(schema.field(1).type), pa.array(cluster, pa.int32()), pa.array(distance)], schema=schema)

    return rows.select("id", "v", *["cluster"] * begun).mapInArrow(run, SCHEMA)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the exact floored mean of its vectors; one without any stays."""
    k, dims = centroids.shape
    names = [f"s{i}" for i in range(dims)]
    schema = f"cluster int, n long, {', '.join(f'{s} long' for s in names)}"
    arrow = to_arrow(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                cluster = batch.column(1).to_numpy(zero_copy_only=False)
                n += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    total[c] += v[cluster == c].sum(axis=0, dtype=np.int64)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), *[pa.array(total[some, i]) for i in range(dims)]], schema=arrow)

    wide = lambda s: F.sum(F.col(s).cast("decimal(20,0)"))
    sums = rows.select("v", "cluster").mapInArrow(run, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[wide(s).alias(s) for s in names]).collect()  # k rows at most
    out = centroids.copy()
    for r in sums:
        out[r["cluster"]] = [int(r[s]) // r["n"] for s in names]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """One row per vector kept: its cluster, squared distance, inertia and the centroid's digest."""
    spark = vectors.sparkSession
    kept = whole(vectors, dims=dims, scale=scale)
    centroids = first(kept, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    folder, rows = scratch(spark, "centroids"), kept
    for step in range(rounds + 1):
        assigned(rows, centroids, step > 0).write.parquet(f"{folder}/{step}")
        rows = spark.read.schema(SCHEMA).parquet(f"{folder}/{step}")
        if step:
            remove(spark, f"{folder}/{step - 1}")
        if step < rounds:
            centroids = moved(rows, centroids)
    return summed(rows, centroids)


def summed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The final assignments with what is said of their clusters: a table of k rows is broadcast."""
    spark = rows.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    said = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    clusters = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> str:
    """The whole clustering as DuckDB SQL: every vector meets every centroid, round by round."""
    near = "SELECT v.r, min({{'d': list_sum(list_transform(range(1, {last}), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))::BIGINT, 'k': c.k}}) AS b FROM v, c{n} c GROUP BY 1"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS k, v AS c FROM v WHERE vec_id IS NOT NULL QUALIFY k < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(last=dims + 1, n=n)})")
        if n < rounds:
            steps += [
                f"s{n} AS (SELECT a.b.k AS k, i, sum(v.v[i]) AS s, count(*) AS n FROM a{n} a JOIN v USING (r), range(1, {dims + 1}) t(i) GROUP BY 1, 2)",
                f"m{n} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{n} GROUP BY 1)",
                f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (k))",
            ]
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, a.b.k::INT AS cluster, a.b.d AS distance, sum(a.b.d) OVER (PARTITION BY a.b.k)::BIGINT AS cluster_inertia, "
        f"sum(a.b.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.k = a.b.k"
    )
