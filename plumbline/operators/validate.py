"""Constraint checks that report every violation as a row (rule, key, message)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, rule: str, key: str | Column, message: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), F.lit(message).alias("message"))


def unique(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _rows(twice, rule, F.concat_ws("/", *keys), "must be unique")


def refers(df: DataFrame, column: str, to: DataFrame, to_column: str, rule: str) -> DataFrame:
    """Every value names a row of `to`; nulls are another rule's matter."""
    lost = df.where(F.col(column).isNotNull()).join(to.select(F.col(to_column).alias("_t")).distinct(), F.col(column) == F.col("_t"), "left_anti")
    return _rows(lost.select(column).distinct(), rule, column, "refers to nothing")


def holds(df: DataFrame, key: str | Column, condition: Column, rule: str, message: str) -> DataFrame:
    """Rows for which `condition` isn't true; null counts as a violation."""
    return _rows(df.where(~F.coalesce(condition, F.lit(False))), rule, key, message)


def not_blank(df: DataFrame, key: str | Column, column: str, rule: str) -> DataFrame:
    return holds(df, key, F.trim(F.col(column)) != "", rule, "must not be blank")


def positive(df: DataFrame, key: str | Column, column: str, rule: str) -> DataFrame:
    return holds(df, key, (F.col(column) > 0) & ~F.isnan(F.col(column).cast("double")), rule, "must be a positive number")


def one_of(df: DataFrame, key: str, column: str, allowed: Sequence[str], rule: str) -> DataFrame:
    return holds(df, key, F.col(column).isin(*allowed), rule, "must be one of " + ", ".join(allowed))


def ring(df: DataFrame, key: str, column: str, rule: str) -> DataFrame:
    """At least three points of two nonnegative numbers."""
    good = (F.size(column) >= 3) & F.forall(column, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v >= 0))
    return holds(df, key, good, rule, "must be a polygon of at least 3 nonnegative points")


def group_size(df: DataFrame, group: str, low: int, high: int, rule: str) -> DataFrame:
    odd = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(~F.col("_n").between(low, high))
    return _rows(odd, rule, group, f"must have {low} to {high} rows")


def report(checks: Sequence[DataFrame]) -> DataFrame:
    """All violations together."""
    return reduce(DataFrame.unionByName, checks)


def assert_clean(df: DataFrame, violations: DataFrame) -> DataFrame:
    """`df`, failing at run time with the first messages if there are violations: checked before anything is written."""
    found = violations.agg(F.count(F.lit(1)).alias("_n"), F.min(F.concat_ws(" ", "rule", "key", "message")).alias("_m"))
    fail = F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(" violations, first: "), F.col("_m"))).cast("boolean")
    return df.crossJoin(F.broadcast(found)).where(F.when(F.col("_n") > 0, fail).otherwise(True)).drop("_n", "_m")  # one row


def schema_violations(documents: DataFrame, key: str, json: str, required: dict[str, str]) -> DataFrame:
    """Paths of a JSON document that are missing or of another type: (key, path, message), sorted by path.

    `required` maps a path such as $.run.status to string, number, boolean, object or array.
    """
    rows = []
    for path, kind in required.items():
        value = F.get_json_object(json, path)
        shape = F.when(value.isNull(), "missing").when(value.startswith("{"), "object").when(value.startswith("["), "array").when(value.isin("true", "false"), "boolean").when(F.expr(f"try_cast(get_json_object({json}, '{path}') as double)").isNotNull(), "number").otherwise("string")
        rows.append(documents.select(key, F.lit(path).alias("path"), shape.alias("_s")).where(F.col("_s") != kind).select(key, "path", F.concat(F.lit(f"expected {kind}, found "), F.col("_s")).alias("message")))
    return reduce(DataFrame.unionByName, rows).orderBy(key, "path", "message")


def segments(df: DataFrame, key: str, start: str, end: str, length: Column) -> DataFrame:
    """Time segments: unique simple ids, positive and inside the recording."""
    return report([
        unique(df, [key], "segment_id"), holds(df, key, F.col(key).rlike("^[A-Za-z0-9_-]+$"), "segment_id", "must be a simple name"),
        holds(df, key, (F.col(start) >= 0) & (F.col(end) > F.col(start)), "segment", "must have a positive length"), holds(df, key, F.col(end) <= length, "segment", "must end inside the recording"),
    ])
