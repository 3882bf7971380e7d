"""Plane fits against numpy, and consensus against plain loops."""

import math

import numpy as np
import pytest

from plumbline.operators import planes

SCHEMA = "g string, k int, x double, y double, z double"


def plain_fit(p):
    centre = p.mean(axis=0)
    _, s, v = np.linalg.svd(p - centre)
    n = v[-1] / np.linalg.norm(v[-1])
    n *= np.sign(n[np.argmax(abs(n) > abs(n).max() - 1e-12)])
    return n, float(n @ centre), s


def test_fit_equals_svd(spark):
    rng = np.random.default_rng(4)
    groups = {"noise": rng.normal(0, 1, (200, 3)), "far": rng.normal(0, 1, (300, 3)) @ np.diag([3, 2, 0.1]) + [1000, -500, 200], "flat": np.c_[rng.uniform(0, 5, (50, 2)), np.full(50, 2.0)], "three": np.array([[0.0, 0, 1], [1, 0, 1.5], [0, 1, 2]])}
    turned = rng.normal(0, 1, (400, 3)) @ np.diag([2, 1, 0.01])
    q, _ = np.linalg.qr(rng.normal(0, 1, (3, 3)))
    groups["turned"] = turned @ q.T
    rows = [(g, k, *map(float, p)) for g, ps in groups.items() for k, p in enumerate(ps)] + [("two", 0, 0.0, 0.0, 0.0), ("two", 1, 1.0, 0.0, 0.0)]
    got = {r.g: r for r in planes.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), "g").collect()}
    for g, ps in groups.items():
        n, d, s = plain_fit(ps)
        turn = np.sign(n @ got[g].normal)  # two components of one size: rounding decides the sign
        assert (turn == 1 or g == "three") and np.allclose(got[g].normal, turn * n, atol=1e-6) and math.isclose(got[g].distance, turn * d, abs_tol=1e-4), g
        assert math.isclose(got[g].rms, s[-1] / math.sqrt(len(ps)) if len(ps) > 2 else 0, abs_tol=1e-6)
    assert (got["two"].n, got["two"].normal, got["two"].distance) == (2, None, None)


def test_fit_without_a_single_answer(spark):
    line = [("line", k, float(k), 2.0 * k, -1.0 * k) for k in range(9)]
    dot = [("dot", k, 1.0, 2.0, 3.0) for k in range(4)]
    got = {r.g: r for r in planes.fit(spark.createDataFrame(line + dot, SCHEMA), "g").collect()}
    assert abs(np.dot(got["line"].normal, [1, 2, -1])) < 1e-6 and math.isclose(np.linalg.norm(got["line"].normal), 1)
    assert got["dot"].normal == [0, 0, 1] and got["dot"].distance == 3.0
    assert planes.fit(spark.createDataFrame([], SCHEMA), "g").count() == 0


@pytest.mark.parametrize("seed", [0, 5])
def test_consensus_equals_plain_loops(spark, seed):
    rng = np.random.default_rng(6)
    groups = {"a": np.vstack([np.c_[rng.uniform(0, 4, (80, 2)), rng.normal(1, 0.01, 80)], rng.uniform(0, 4, (40, 3))]), "b": rng.uniform(0, 1, (30, 3)), "c": np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]]), "d": np.zeros((5, 3)), "e": np.zeros((2, 3))}
    rows = [(g, k, *map(float, p)) for g, ps in groups.items() for k, p in enumerate(ps)]
    fits, inliers = planes.consensus(spark.createDataFrame(rows, SCHEMA).repartition(4), "g", "k", 40, 0.05, seed)
    got, kept = {r.g: r for r in fits.collect()}, {}
    for r in inliers.collect():
        kept.setdefault(r.g, set()).add(r.k)
    draw = lambda x, n: x * 48271 % 2147483647 * 69621 % 2147483647 % n
    for g, p in groups.items():
        best, n = (0, None, None), len(p)
        for h in range(40 if n > 2 else 0):
            i = draw(3 * h + 1 + seed, n)
            j = (i + 1 + draw(3 * h + 2 + seed, n - 1)) % n
            k = [x for x in range(n) if x not in (i, j)][draw(3 * h + 3 + seed, n - 2)]
            normal = np.cross(p[j] - p[i], p[k] - p[i])
            if np.linalg.norm(normal) > 0:
                near = np.flatnonzero(abs((p - p[i]) @ (normal / np.linalg.norm(normal))) < 0.05)
                best = max(best, (len(near), h, set(near.tolist())), key=lambda x: x[0])
        if best[0] < 3:
            assert g not in got
            continue
        assert (got[g].n_inliers, got[g].hypothesis, kept[g]) == best
        assert np.allclose(got[g].normal, plain_fit(p[sorted(best[2])])[0], atol=1e-6)
    assert set(got) == {"a", "b", "c"} and len(kept["a"]) >= 80
