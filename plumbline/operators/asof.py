"""Nearest-timestamp joins with a tolerance.

A pure band condition would plan as a nested loop, and an equi-join of buckets would make
all pairs of a bucket. Here both sides go to buckets of one tolerance, each bucket also gets
the nearest right row of the buckets beside it, and two passes over a bucket in time order
carry the last right row before and the first one after to each left row: a shuffle on the
bucket, and work in proportion to the rows however many share a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.keyed import first_wins


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, right_key: str, right_at: str, tolerance: float, by: Sequence[str] = ()) -> DataFrame:
    """(key, at, *by, right_key, right_at, offset) for left rows with a right row within `tolerance` (inclusive).

    Ties go to the earlier right row, then to the smaller right key. `at` columns are numbers; rows without
    one, or without a `by` column, match nothing.
    """
    c = F.col
    best = nearest_of(left, {"right": right}, key, at, tolerance, right_key, right_at, by)
    return best.select(c("_key").alias(key), c("_at").alias(at), *by, c("_right._rk").alias(right_key), c("_right._rt").alias(right_at), c("_right.offset").alias("offset"))


def nearest_of(left: DataFrame, streams: dict[str, DataFrame], key: str, at: str, tolerance: float, right_key: str, right_at: str, by: Sequence[str] = ()) -> DataFrame:
    """(_key, _at, *by, _<stream> ...): the nearest row of every stream as a struct (offset, _rt, _rk), left rows that lack one left out.

    However many streams, all rows are dealt to buckets once and two passes carry one struct a stream.
    """
    c = F.col
    bucket = lambda column: F.floor(column / tolerance).cast("long")
    known = lambda df, *columns: df.dropna(subset=list(columns))
    rows = reduce(DataFrame.unionByName, [known(s, right_at, *by).select(F.lit(n).alias("_s"), *by, c(right_at).alias("_at"), c(right_key).alias("_rk")) for n, s in streams.items()])
    base = rows.groupBy("_s", *by, "_at").agg(F.min("_rk").alias("_rk")).withColumn("_bucket", bucket(c("_at")))
    row = F.struct(c("_at").alias("_rt"), c("_rk"))
    # The last row of a bucket is before all of the next one, the first after all of the one before.
    ends = base.groupBy("_s", *by, "_bucket").agg(F.max(row).alias("_last"), F.min(row).alias("_first"))
    after = ends.select("_s", *by, (c("_bucket") + 1).alias("_bucket"), c("_last._rt").alias("_at"), c("_last").alias("_row"))
    before = ends.select("_s", *by, (c("_bucket") - 1).alias("_bucket"), c("_first._rt").alias("_at"), c("_first").alias("_row"))
    rights = base.select("_s", *by, "_bucket", "_at", row.alias("_row")).unionByName(after).unionByName(before)
    lefts = known(left, at, *by).select(*by, bucket(c(at)).alias("_bucket"), c(at).alias("_at"), c(key).alias("_key"), F.lit(True).alias("_left"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    own = Window.partitionBy(*by, "_bucket")
    # At one time right rows come first, so a left row finds them before it.
    back = own.orderBy(c("_at"), c("_left").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = own.orderBy(c("_at").desc(), c("_left").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    of = lambda k, n, w: F.last(F.when(c("_s") == n, c("_row")), ignorenulls=True).over(w).alias(f"_{k}_{n}")
    seen = both.select("*", *[of("a", n, back) for n in streams]).select("*", *[of("b", n, ahead) for n in streams])
    near = lambda name: F.when(c(name).isNotNull(), F.struct(F.abs(c(f"{name}._rt") - c("_at")).alias("offset"), c(f"{name}._rt").alias("_rt"), c(f"{name}._rk").alias("_rk")))
    best = seen.where("_left").select("_key", "_at", *by, *[F.least(near(f"_a_{n}"), near(f"_b_{n}")).alias(f"_{n}") for n in streams])
    return reduce(lambda df, n: df.where(c(f"_{n}.offset") <= tolerance), streams, best)


def nearest_streams(left: DataFrame, streams: dict[str, DataFrame], key: str, at: str, tolerance: float, right_key: str = "id", right_at: str = "ts") -> DataFrame:
    """Left rows for which every stream has a row within tolerance: (key, at, <stream>_id, <stream>_offset ...)."""
    c = F.col
    both = nearest_of(left, streams, key, at, tolerance, right_key, right_at)
    return both.select(c("_key").alias(key), c("_at").alias(at), *[x for n in streams for x in (c(f"_{n}._rk").alias(f"{n}_id"), c(f"_{n}.offset").alias(f"{n}_offset"))])


def first_use(matched: DataFrame, right_key: str, at: str, key: str) -> DataFrame:
    """A right row serves one left row only, the earliest."""
    return first_wins(matched, [right_key], [at, key])


def outcomes(left: DataFrame, matched: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Counts of left rows that were accepted, rejected for want of a match, or duplicates of a used match."""
    marked = left.select(key).join(matched.select(key, F.lit(True).alias("_m")), key, "left").join(used.select(key, F.lit(True).alias("_u")), key, "left")
    return marked.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("_u")).alias("n_used"),
        F.count_if(F.col("_m") & F.col("_u").isNull()).alias("n_duplicate"), F.count_if(F.col("_m").isNull()).alias("n_rejected"),
    )


def must_match(left: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """`matched`, failing at run time if some left row has no match."""
    missing = left.select(key).join(matched.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("_missing"))
    fail = F.raise_error(F.concat(F.col("_missing").cast("string"), F.lit(" rows without a match within tolerance"))).cast("boolean")
    checked = matched.crossJoin(F.broadcast(missing))  # the right side is one row
    return checked.where(F.when(F.col("_missing") > 0, fail).otherwise(True)).drop("_missing")
