"""Joins and selections by key: which duplicate wins, what a missing link means."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import pieces, shuffled


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal `keys`, the first by `order`."""
    return _pick(df, keys, [F.col(c).asc() for c in order])


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal `keys`, the last by `order`."""
    return _pick(df, keys, [F.col(c).desc() for c in order])


#: Rows of a few narrow columns that may be broadcast once they are counted.
SMALL = 100_000
#: Pieces of work for each task of a shuffle, so that hashing deals them evenly.
CELLS = 4


def if_small(df: DataFrame) -> DataFrame:
    """`df`, a stored table of narrow rows, to be broadcast if it is counted to be small, else left to a shuffle."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def spread_join(rows: DataFrame, names: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """`rows` with the one row that `names` has for `key`, however many rows share a key.

    Rows are salted by their own hash, and `names` goes only to the (key, salt) that occur, so
    neither the rows of a hot key nor its copies in `names` meet in one task. The square root
    of the number of rows is a good `salts`. `rows` is read twice.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, salts))))
    wanted = salted.select(key, "_salt").distinct().join(names, key)
    return salted.join(wanted, [key, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """1-based numbers in input order, within `by`; without it the rows are numbered in range partitions."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    from plumbline.operators.stats import positions

    return positions(df, order).withColumn(name, F.col("position") + 1).drop("position", "total")


def two_hop(truth: DataFrame, match: DataFrame, prediction: DataFrame, truth_key: str, match_left: str, match_right: str, prediction_key: str) -> DataFrame:
    """Truth to prediction by way of a correspondence table; a missing link leaves nulls, the truth row stays."""
    linked = truth.join(match, F.col(truth_key) == F.col(match_left), "left")
    return linked.join(prediction, F.col(match_right) == F.col(prediction_key), "left")


def id_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(id, side): matched, missing (left only) or extra (right only)."""
    a = left.select(F.col(key).alias("id")).distinct().withColumn("_l", F.lit(True))
    b = right.select(F.col(key).alias("id")).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "matched").when(F.col("_l"), "missing").otherwise("extra")
    return a.join(b, "id", "full").select("id", side.alias("side"))


def intersect_keys(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys present in every frame."""
    out = frames[0].select(key).distinct()
    for f in frames[1:]:
        out = out.join(f.select(key), key, "left_semi")
    return out


def renamed(df: DataFrame, names: DataFrame, key: str, old: str, new: str, out: str) -> DataFrame:
    """`key` under its new name, its own where there is none."""
    return df.join(names.select(F.col(old).alias("_old"), F.col(new).alias("_new")), F.col(key) == F.col("_old"), "left").withColumn(out, F.coalesce("_new", key)).drop("_old", "_new")


def undirected(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges with the smaller end first; loops and null ends go."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def cooccurrence(df: DataFrame, group: str, item: str, piece: int = 1_000_000) -> DataFrame:
    """Distinct unordered pairs of items that share a group.

    Rows, then pairs are counted first and dealt over as many tasks as they fill at `piece` each, before they are made
    distinct: the memory of a task doesn't grow with the table. A row counts twice, as its task holds it on both sides
    of the join. The table is read three times.
    """
    spark = df.sparkSession
    rows = df.select(group, item).repartition(pieces(spark, 2 * df.count(), piece), group).distinct()
    total = rows.groupBy(group).count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0))).first()[0]
    other = shuffled(rows.select(group, F.col(item).alias("_other")))
    pairs = rows.join(other, group).where(F.col(item) < F.col("_other")).select(F.col(item).alias("a"), F.col("_other").alias("b"))
    return pairs.repartition(pieces(spark, total, piece), "a", "b").distinct()


def in_all(df: DataFrame, item: str, group: str) -> DataFrame:
    """Items that occur in every group of `df` (relational division)."""
    total = df.agg(F.count_distinct(group).alias("_groups"))
    counts = df.groupBy(item).agg(F.count_distinct(group).alias("_in"))
    return counts.join(F.broadcast(total), F.col("_in") == F.col("_groups")).select(item)  # one row


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def interval_cut(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points in half-open intervals [start, end), by buckets of `width` instead of a theta join.

    Choose `width` near the usual interval length: an interval is repeated for each bucket it touches.
    """
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    keyed = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return keyed.join(spread, "_bucket").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def prefix_of(df: DataFrame, names: DataFrame, text: str, prefix: str, mark: str = "__") -> DataFrame:
    """Join on the part of `text` before `mark`."""
    return df.withColumn("_prefix", F.substring_index(text, mark, 1)).join(names, F.col("_prefix") == F.col(prefix)).drop("_prefix")


def band_pairs(df: DataFrame, key: str, value: str, width: float, piece: int = 100_000) -> DataFrame:
    """Pairs (a, b), a < b, whose values differ by at most `width`, by buckets of that width.

    Each row is met in its own bucket by the rows of lower or equal values, which go to the one or two buckets that
    reach up to `width` more. A bucket is one task's work, or where that is over `piece` rows on a side and a fair share of
    all comparisons it is cut into rectangles. So what is shuffled grows with the table, whatever its values; pairs are
    written in full and grow with the square of a bucket. The table is read three times, four with such buckets.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_k"), F.col(value).alias("_v")).where(F.abs(value) < float("inf"))
    own = F.floor(F.col("_v") / width)
    reach = F.floor((F.col("_v") + math.nextafter(width, math.inf)) / width)  # rounding is monotone: no value within `width` has a higher bucket
    low = rows.select("_k", "_v", own.alias("_own"), F.explode(F.sequence(own, reach)).alias("_b"))
    met = low.groupBy("_b").agg(F.count("*").cast("double").alias("l"), F.count_if(F.col("_b") == F.col("_own")).cast("double").alias("h"))
    total, most, work = (x or 0.0 for x in met.agg(F.sum(F.col("l") + F.col("h")), F.max("l"), F.sum(F.col("l") * F.col("h"))).first())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = max(piece, math.sqrt(work / (CELLS * tasks)))
    crowded = met.where(F.col("l") > side).collect() if most > side else []  # few, as each of them or a neighbour has a share of the work
    cuts = {x: _looked_up("_b", {r["_b"]: math.ceil(r[x] / side) for r in crowded}) for x in "lh"}
    dealt_to = pieces(spark, math.ceil(total + 2 * work / side), 1_000_000)

    def cells(side_rows: DataFrame, name: str, mine: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("_k"), cuts[mine]).alias(f"_{mine}")
        each = F.explode(F.sequence(F.lit(0).cast("long"), cuts[other] - 1)).alias(f"_{other}")
        return side_rows.select(F.col("_k").alias(f"k{name}"), F.col("_v").alias(f"v{name}"), "_b", part, each).repartition(dealt_to, "_b", "_l", "_h")

    upper = cells(rows.withColumn("_b", own), "2", "h", "l")
    lower_first = (F.col("v1") < F.col("v2")) & (F.col("k1") != F.col("k2")) | (F.col("v1") == F.col("v2")) & (F.col("k1") < F.col("k2"))
    near = cells(low, "1", "l", "h").join(shuffled(upper), ["_b", "_l", "_h"]).where((F.col("v2") - F.col("v1") <= width) & lower_first)
    return near.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"))


def _looked_up(key: str, found: dict[int, int]) -> Column:
    """A few numbers of keys, 1 for all others."""
    if not found:
        return F.lit(1).cast("long")
    known = F.map_from_arrays(F.lit(list(found)).cast("array<bigint>"), F.lit(list(found.values())).cast("array<bigint>"))
    return F.coalesce(F.try_element_at(known, F.col(key)), F.lit(1).cast("long"))


def changes(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose `value` differs from the one before in their group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_before", F.lag(value).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def consecutive(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(by, a, b): neighbouring values in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_next", F.lead(value).over(w)).where("_next IS NOT NULL").select(*by, F.col(value).alias("a"), F.col("_next").alias("b"))


def natural(column: str) -> list[Column]:
    """Sort order: numbers by value first, then text."""
    number = F.col(column).try_cast("long")
    return [number.isNull(), number, F.col(column)]


def linked(left: DataFrame, right: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """An inner join in which every left row must find a partner, else the run fails."""
    both = left.join(right.withColumn("_found", F.lit(True)), list(keys), "left")
    fail = F.raise_error(F.lit(message)).cast("boolean")
    return both.where(F.when(F.col("_found"), True).otherwise(fail)).drop("_found")


def at_position(df: DataFrame, array: str, index: str, out: str) -> DataFrame:
    """The array's entry at a 0-based index; one out of range fails the run."""
    inside = (F.col(index) >= 0) & (F.col(index) < F.size(array))
    fail = F.raise_error(F.concat(F.lit("index out of range: "), F.col(index).cast("string")))
    return df.withColumn(out, F.when(inside, F.get(F.col(array), F.col(index).cast("int"))).otherwise(fail.cast(df.schema[array].dataType.elementType)))
