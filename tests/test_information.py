import math
import time

import numpy as np
import pytest

from sketchloom.functions import kernels as K
from sketchloom.operators.correlation import information
from sketchloom.operators.sketch import SketchSpec
from sketchloom.plans import jobs

N, C = "NUMERICAL", "CATEGORICAL"


def slow_kl_mixed(x, k=3):
    n, total = len(x), 0.0
    for v in x:
        far = np.sort(np.abs(x - v))
        kk = max(min(k, n - 1), int((far == 0).sum()))
        total += math.log(far[kk]) - K.digamma(kk)
    return K.digamma(n) + math.log(2) + total / n


def test_kl_mixed_equals_brute_force():
    rng = np.random.default_rng(2)
    for n in (2, 3, 5, 40, 300):
        for x in (rng.normal(size=n), rng.integers(0, 2, n) + np.arange(n) // 9, np.where(rng.random(n) < 0.5, 0.0, rng.normal(size=n))):
            if len(set(x)) > 1:
                assert K.kl_entropy_mixed(x) == pytest.approx(slow_kl_mixed(np.asarray(x, float)), abs=1e-9)


def slow_mixed_ksg(x, y, k):
    n, total = len(x), 0.0
    for a, b in zip(x, y):
        dx, dy = np.abs(x - a), np.abs(y - b)
        far = np.maximum(dx, dy)
        rho = np.sort(far)[min(k, n - 1)]
        near = [d < rho if rho > 0 else d == 0 for d in (dx, dy)]
        kk = min(k, n - 1) if rho > 0 else (far == 0).sum()
        total += K.digamma(kk) - sum(K.digamma(m.sum()) for m in near)
    return max(float(total) / n + math.log(n), 0.0)


@pytest.mark.parametrize("n", [2, 3, 4, 16, 33, 100, 700])
@pytest.mark.parametrize("k", [1, 3, 7])
def test_mixed_ksg_equals_brute_force(n, k):
    rng = np.random.default_rng(n)
    normal, few, some = rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.integers(0, n // 3 + 1, n)
    for x, y in (
        (normal, normal + rng.normal(size=n)), (few, normal), (few, rng.permutation(few)), (np.zeros(n), normal), (np.zeros(n), np.zeros(n)),
        (np.where(few > 1, 0.0, normal), np.where(few % 2 > 0, 0.0, normal)), (normal[some], -few[some]), (rng.standard_cauchy(n) ** 3, normal),
        (1 + few * 2.0**-52, few * 0.1 + normal.round(1)), (np.where(few > 1, 1.0, normal * 1e-20), 1e9 + normal.round(2)),
    ):
        assert K.mixed_ksg(x, y, k) == pytest.approx(slow_mixed_ksg(x, y, k), abs=1e-9)


def test_mixed_ksg_of_values_that_are_not_finite():
    x = np.arange(10.0)
    for odd in (math.nan, math.inf, -math.inf):
        y = np.where(x == 3, odd, x * x)
        assert K.mixed_ksg(x, y) == K.mixed_ksg(y, x) == math.inf


def test_mixed_ksg_of_a_whole_join_does_not_take_the_square():
    rng = np.random.default_rng(8)
    x = rng.normal(size=100_000)
    began = time.process_time()
    value = K.mixed_ksg(x, 0.8 * x + 0.6 * rng.normal(size=len(x)))
    assert time.process_time() - began < 60  # all pairs take minutes
    assert value == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.02)


def test_entropies_of_all_types(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, 80).astype(float)
    y = np.round(x + rng.normal(size=80), 1)
    rows = spark.createDataFrame([("a", "b", float(p), float(q)) for p, q in zip(x, y)], "x_id string, y_id string, xv double, yv double")
    kinds = {"MUTUAL_INFORMATION_DIFF_ENT": K.kl_entropy, "MUTUAL_INFORMATION_DIFF_ENT_MIXED": K.kl_entropy_mixed}
    for name, numeric in kinds.items():
        for tx, ty in ((N, N), (C, N), (N, C)):
            r = information(rows, name, tx, ty).first()
            ex, ey = (K.entropy(v) if t == C else numeric(v) for t, v in ((tx, x), (ty, y)))
            assert (r.ex, r.ey) == pytest.approx((ex, ey)) and r.n == 80 and r.nx is None
            assert r.nmi_max == pytest.approx(r.mi / max(ex, ey)) and r.nmi_min == pytest.approx(r.mi / min(ex, ey))
            root = r.mi / math.sqrt(ex * ey) if ex * ey > 0 else math.nan
            assert r.nmi_sqrt == pytest.approx(root, nan_ok=True)
    both = information(rows, "MUTUAL_INFORMATION_DIFF_ENT_MIXED", C, C).first()
    assert both.ex == pytest.approx(K.entropy(x)) and both.nx == 4


def test_job_has_entropies_of_join_and_sample(spark):
    rng = np.random.default_rng(6)
    data = [(p, i, f"k{i}", float(v)) for p in ("x", "y") for i, v in enumerate(rng.normal(size=50))]
    pairs = spark.createDataFrame(data, "pair_id string, ord long, k string, v double")
    ids = spark.createDataFrame([("x", "y")], "x_id string, y_id string")
    r = jobs.information_stats(pairs, ids, SketchSpec("KMV", 16), N, N, "MEAN").first()
    x = np.array([v for p, _, _, v in data if p == "x"])
    assert r.rows == 50 and r.sample == 16 and r.ex == pytest.approx(K.kl_entropy_mixed(x))
    assert r.ex_est is not None and r.ex_est != r.ex
    assert all(r[f"{c}{s}"] is not None for c in ("ex", "ey", "nmi_sqrt", "nmi_max", "nmi_min") for s in ("", "_est"))
