"""Nearest neighbours of a stated set of query vectors, by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES, VECTORS = 512, 8192


def two_nearest(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, match, distance, next_distance): the nearest vector of each query and the distance of the next; ties go to the smaller id.

    vectors (id long, v array<double>), queries likewise; a vector with the query's own id doesn't count. Each
    block of queries meets each block of vectors in a task that holds one of each, and two candidates a query
    come out of it.
    """
    importable(vectors)
    n_vectors, n_queries = vectors.count(), queries.count()
    rows, cols = max(1, -(-n_queries // QUERIES)), max(1, -(-n_vectors // VECTORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.select(place(rows).alias("row"), every(cols).alias("col"), "id", "v")
    right = vectors.select(every(rows).alias("row"), place(cols).alias("col"), "id", "v")

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, float, int]] = []
        if len(q) and len(v):
            v = v.sort_values("id")
            ids, all_v = v["id"].to_numpy(), np.stack(v["v"].to_numpy())
            for own, w in zip(q["id"], q["v"], strict=True):
                d = ((all_v - np.asarray(w)) ** 2).sum(1)
                d[ids == own] = np.inf
                for k in np.lexsort((ids, d))[:2] if len(d) <= 2 else nearest_two(d):
                    if np.isfinite(d[k]):
                        out.append((own, float(d[k]), int(ids[k])))
        return pd.DataFrame(out, columns=["query", "square", "id"])

    found = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInPandas(meet, "query long, square double, id long")
    row = F.struct("square", "id")
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(row)), 1, 2).alias("d"))  # two rows a block of vectors
    return best.select("query", F.col("d")[0]["id"].alias("match"), F.sqrt(F.col("d")[0]["square"]).alias("distance"), F.sqrt(F.get("d", F.lit(1))["square"]).alias("next_distance"))


def nearest_two(d: np.ndarray) -> list[int]:
    """The places of the two smallest values, the first of equals first."""
    one = int(d.argmin())
    kept, d[one] = d[one], np.inf
    two = int(d.argmin())
    d[one] = kept
    return [one, two]


def importable(df: DataFrame) -> None:
    from plumbline.session import importable as ready

    ready(df.sparkSession)
