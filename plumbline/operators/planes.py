"""Planes through points: least squares from moments, and the best of seeded hypotheses.

A group's points are never brought together: a fit needs ten sums, and hypotheses are a small table that
all points are scored against, with counts added before they are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.keyed import spread_join
from plumbline.operators.stats import positions
from plumbline.session import cut

c = F.col
HYPOTHESES, THRESHOLD = 100, 0.05
#: Two steps of linear congruence that turn a number into a sample position.
MODULUS, FACTORS = 2147483647, (48271, 69621)


def cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def squared(u: list[Column]) -> Column:
    return u[0] * u[0] + u[1] * u[1] + u[2] * u[2]


def least_direction(sums: DataFrame) -> DataFrame:
    """`sums` with `normal` and `value`: the unit vector of the least eigenvalue of the matrix _xx .. _zz, and that value, in closed form.

    The largest of the three cross products of the shifted matrix's rows; where all vanish, as for points
    in a line, a vector across its largest row, and the z axis for a matrix without any direction. The
    component of largest size is positive. Each step is a column of its own, so that none is computed twice.
    """
    m = {k: c(f"_{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
    step = sums.withColumn("_q", (m["xx"] + m["yy"] + m["zz"]) / 3)
    a, b, d = m["xx"] - c("_q"), m["yy"] - c("_q"), m["zz"] - c("_q")
    step = step.withColumn("_p", F.sqrt((a * a + b * b + d * d + 2 * (m["xy"] * m["xy"] + m["yz"] * m["yz"] + m["xz"] * m["xz"])) / 6))
    det = a * (b * d - m["yz"] * m["yz"]) - m["xy"] * (m["xy"] * d - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - b * m["xz"])
    step = step.withColumn("_turn", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(F.try_divide(det, 2 * c("_p") * c("_p") * c("_p")), F.lit(1.0))))) / 3)
    step = step.withColumn("value", c("_q") + 2 * c("_p") * F.cos(c("_turn") + 2 * math.pi / 3))
    rows = [[m["xx"] - c("value"), m["xy"], m["xz"]], [m["xy"], m["yy"] - c("value"), m["yz"]], [m["xz"], m["yz"], m["zz"] - c("value")]]
    pack = lambda u: F.struct(squared(u).alias("s"), F.array(*u).alias("u"))
    step = step.withColumn("_across", F.array_max(F.array(*[pack(cross(rows[i], rows[j])) for i, j in ((0, 1), (0, 2), (1, 2))])))
    step = step.withColumn("_top", F.array_max(F.array(*[pack(r) for r in rows]))["u"])
    t = [c("_top")[k] for k in range(3)]
    shy = F.when((F.abs(t[0]) <= F.abs(t[1])) & (F.abs(t[0]) <= F.abs(t[2])), F.array(F.lit(0.0), t[2], -t[1])).when(F.abs(t[1]) <= F.abs(t[2]), F.array(-t[2], F.lit(0.0), t[0])).otherwise(F.array(t[1], -t[0], F.lit(0.0)))
    up, size = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), 3 * c("_q")
    found = F.when(c("_across.s") > 1e-24 * F.pow(size, 4), c("_across.u")).when(squared(t) > 1e-16 * size * size, shy).otherwise(up)
    return step.withColumn("_found", found).withColumn("normal", unit(c("_found")))


def unit(u: Column) -> Column:
    """A vector of length one whose component of largest size, the first of several, is positive."""
    length = F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, v: s + v * v))
    first = F.filter(u, lambda v: F.abs(v) == F.array_max(F.transform(u, F.abs)))[0]
    return F.transform(u, lambda v: v * F.sign(first) / length)


def fit(points: DataFrame, by: str) -> DataFrame:
    """(by, n, normal, distance, rms) of the least-squares plane of rows (by, x, y, z); null under three points.

    Means, variances and covariances are one partial aggregate, so a group may hold any number of points.
    """
    pairs = {a + b: F.covar_pop(a, b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    sums = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(f"_{k}") for k in "xyz"], *[v.alias(f"_{k}") for k, v in pairs.items()])
    enough = c("n") >= 3
    rows = least_direction(sums).withColumns({"normal": F.when(enough, c("normal")), "rms": F.when(enough, F.sqrt(F.greatest(F.lit(0.0), c("value"))))})
    at = lambda k: c("normal")[k]
    return rows.select(by, "n", "normal", (at(0) * c("_x") + at(1) * c("_y") + at(2) * c("_z")).alias("distance"), "rms")


def drawn(number: Column, size: Column) -> Column:
    """A number below `size` that a seeded number decides."""
    return (number * FACTORS[0]) % MODULUS * FACTORS[1] % MODULUS % size


def samples(sizes: DataFrame, hypotheses: int, seed: int) -> DataFrame:
    """`sizes` rows (..., total) with (hypothesis, corner, position): three different positions for each hypothesis."""
    rows = sizes.where("total >= 3").withColumn("hypothesis", F.explode(F.sequence(F.lit(0), F.lit(hypotheses - 1))))
    number = lambda k: (c("hypothesis") * 3 + k + seed).cast("long")
    rows = rows.withColumn("_p", drawn(number(1), c("total"))).withColumn("_q", (c("_p") + 1 + drawn(number(2), c("total") - 1)) % c("total"))
    third = drawn(number(3), c("total") - 2)
    third = third + (third >= F.least("_p", "_q")).cast("int")
    rows = rows.withColumn("_r", third + (third >= F.greatest("_p", "_q")).cast("int"))
    return rows.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(k).alias("corner"), c(v).alias("position")) for k, v in enumerate(("_p", "_q", "_r"))]))).select(*sizes.columns, "hypothesis", "_c.corner", "_c.position")


def consensus(points: DataFrame, by: str, order: str, hypotheses: int = HYPOTHESES, threshold: float = THRESHOLD, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The planes of (by, n_inliers, hypothesis, n, normal, distance, rms) and their inliers, of rows (by, order, x, y, z).

    Each hypothesis is the plane of three of a group's points; the one with most points nearer than `threshold` wins,
    of equal ones the first, and its inliers are fitted. Groups under three points, or whose best plane has fewer inliers, give nothing.
    """
    placed = cut(positions(points.select(by, order, "x", "y", "z"), [by, order]))
    sizes = placed.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.min("position").alias("_first"))
    wanted = samples(sizes, hypotheses, seed).select(by, "hypothesis", "corner", (c("_first") + c("position")).alias("position"))
    corners = wanted.join(placed.select("position", "x", "y", "z"), "position")
    corner = lambda k: F.max(F.when(c("corner") == k, F.array("x", "y", "z"))).alias(f"_{k}")
    three = corners.groupBy(by, "hypothesis").agg(*[corner(k) for k in range(3)])
    side = lambda k: [c(f"_{k}")[i] - c("_0")[i] for i in range(3)]
    across = cross(side(1), side(2))
    planes = three.withColumn("_u", F.array(*across)).withColumn("_length", F.sqrt(squared([c("_u")[i] for i in range(3)]))).where("_length > 0")
    planes = planes.select(by, "hypothesis", *[(c("_u")[i] / c("_length")).alias(f"_n{i}") for i in range(3)], *[c("_0")[i].alias(f"_o{i}") for i in range(3)])
    tables = cut(planes.groupBy(by).agg(F.collect_list(F.struct("hypothesis", *[f"_n{i}" for i in range(3)], *[f"_o{i}" for i in range(3)])).alias("_planes")))  # at most `hypotheses` a group
    salts = math.isqrt(placed.count())
    off = lambda p: F.abs((c("x") - c(f"{p}_o0")) * c(f"{p}_n0") + (c("y") - c(f"{p}_o1")) * c(f"{p}_n1") + (c("z") - c(f"{p}_o2")) * c(f"{p}_n2"))
    scored = spread_join(placed.select(by, order, "x", "y", "z"), tables, by, salts).select(by, "x", "y", "z", F.explode("_planes").alias("_h")).where(off("_h.") < threshold)
    counts = scored.groupBy(by, c("_h.hypothesis").alias("hypothesis")).agg(F.count(F.lit(1)).alias("n_inliers"))
    best = counts.groupBy(by).agg(F.max_by(F.struct("hypothesis", "n_inliers"), F.struct("n_inliers", -c("hypothesis"))).alias("_b")).select(by, "_b.*").where("n_inliers >= 3")
    chosen = cut(best.join(planes, [by, "hypothesis"]))
    inliers = spread_join(placed.select(by, order, "x", "y", "z"), chosen, by, salts).where(off("") < threshold).select(by, order, "x", "y", "z")
    return chosen.select(by, "n_inliers", "hypothesis").join(fit(inliers, by), by), inliers
