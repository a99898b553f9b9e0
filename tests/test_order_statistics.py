"""Running sums over range partitions, Kendall's tau by strips, permutation tests."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moltab.operators import permutation as perm
from moltab.operators.concordance import kendall_tau, signed_pairs
from moltab.operators.ordered import average_rank, row_number, running_sum


def brute_running(rows, descending):
    """rows: (group, value, id, weight); order by value (nulls last), then id."""
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for part in groups.values():
        with_value = sorted((r for r in part if r[1] is not None), key=lambda r: (-r[1] if descending else r[1], r[2]))
        total = 0
        for r in with_value + sorted((r for r in part if r[1] is None), key=lambda r: r[2]):
            total += r[3] or 0
            out[r[2]] = total
    return out


@pytest.mark.parametrize("descending, parts", [(False, 1), (True, 7), (False, 23)])
def test_running_sum_equals_brute_force(spark, descending, parts):
    rng = random.Random(parts)
    # group "a" and value 1.0 hold most rows; null groups, null values and null weights occur
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1.0, 1.0, 1.0, 2.5, -3.0, None]), i,
             rng.choice([1, 2, None])) for i in range(1500)] + [("solo", 1.0, 9999, 5)]
    df = spark.createDataFrame(rows, "g string, v double, id long, w int").repartition(5)
    got = running_sum(df, "v", ["w"], by=["g"], descending=descending, tiebreak=["id"], n_buckets=parts)
    assert got.columns == ["g", "v", "id", "w", "cum_w"]
    assert {r.id: r.cum_w for r in got.collect()} == brute_running(rows, descending)


def test_running_sum_of_equal_rows_and_several_values(spark):
    df = spark.range(3000).select(F.lit(1.5).alias("v"), F.lit(2).alias("n"), F.lit(0.5).alias("x"))
    got = running_sum(df, "v", ["n", "x"], n_buckets=6).select("cum_n", "cum_x").collect()
    assert sorted(r.cum_n for r in got) == [2 * (i + 1) for i in range(3000)]
    assert sorted(r.cum_x for r in got) == [0.5 * (i + 1) for i in range(3000)]
    assert running_sum(df.limit(0), "v", ["n"]).count() == 0


def test_row_number_within_groups(spark):
    df = spark.range(700).select((F.col("id") % 3).alias("g"), (F.col("id") % 11).alias("v"), "id")
    got = row_number(df, "v", tiebreak=["id"], by=["g"], n_buckets=9).collect()
    for g in range(3):
        own = sorted((r.v, r.id, r.rn) for r in got if r.g == g)
        assert [r[2] for r in own] == list(range(1, len(own) + 1))


def test_average_rank_by_group(spark):
    rows = [("a", v) for v in [3.0, 1.0, 3.0, None, 3.0]] + [("b", 3.0)]
    got = average_rank(spark.createDataFrame(rows, "g string, v double"), "v", by=["g"], n_buckets=4).collect()
    assert sorted((r.g, r.v or 0, r["rank"] or 0) for r in got) == \
        [("a", 0, 0), ("a", 1.0, 1.0), ("a", 3.0, 3.0), ("a", 3.0, 3.0), ("a", 3.0, 3.0), ("b", 3.0, 1.0)]


def brute_tau(points):
    s = nx = ny = 0
    pairs = list(itertools.combinations(points, 2))
    for (a, b), (c, d) in pairs:
        s += np.sign(a - c) * np.sign(b - d)
        nx += a != c
        ny += b != d
    return s / np.sqrt(nx * ny) if nx and ny else None


@pytest.mark.parametrize("strip", [3, 20, 1 << 18])
@pytest.mark.parametrize("kind", ["ties", "continuous", "hot"])
def test_kendall_equals_all_pairs(spark, strip, kind):
    rng = random.Random(3)
    draw = {"ties": lambda: (rng.randrange(6), rng.randrange(5)), "continuous": lambda: (rng.random(), rng.random()),
            "hot": lambda: (rng.choice([0.5, 0.5, rng.random()]), rng.choice([1, 1, rng.random()]))}[kind]
    points = [tuple(map(float, draw())) for _ in range(150)]
    rows = [("p", *x) for x in points] + [("q", x[1], x[0] + x[1]) for x in points] + [("flat", 1.0, float(i)) for i in range(9)]
    rows += [("p", None, 1.0), ("q", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: (r.n, r.tau) for r in kendall_tau(df, "x", "y", by=["g"], strip=strip).collect()}
    assert got["p"] == (150, pytest.approx(brute_tau(points), abs=1e-12))
    assert got["q"] == (150, pytest.approx(brute_tau([(b, a + b) for a, b in points]), abs=1e-12))
    assert got["flat"] == (9, None)
    alone = kendall_tau(df.where("g = 'p'"), "x", "y", strip=strip).first()
    assert alone.tau == pytest.approx(got["p"][1], abs=1e-12)


def test_signed_pairs_with_weights():
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(0, 9, 80).astype(float), rng.integers(0, 7, 80).astype(float), rng.integers(1, 5, 80)
    want = sum(w[i] * w[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(80) for j in range(i))
    assert signed_pairs(x, y, w) == want


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 399])
def test_permutations_are_bijections(n):
    keys = perm.round_keys(5, 30)
    to = perm.permuted(np.arange(n), keys, n)
    assert all(sorted(to[:, b]) == list(range(n)) for b in range(30))
    assert n < 7 or len({tuple(c) for c in to.T}) > 25


def test_permutations_are_even():
    to = perm.permuted(np.arange(6), perm.round_keys(1, 6000), 6)
    counts = np.array([np.bincount(to[i], minlength=6) for i in range(6)])
    assert np.abs(counts - 1000).max() < 150


def sample_rows(seed=1, n=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choice([0.0, 1.0, 2.0, None]) if i % 10 == 0 else float(rng.randrange(4))
        x = (y or 0) + rng.gauss(0, 1)
        rows.append((i, x, rng.random() if i % 7 else None, 1.0, y))
    return rows


def brute_p(rows, col, method, n_perm, seed, alternative):
    """p-value by building every permuted table."""
    import hashlib
    rows = [r for r in rows if r[4] is not None]
    place = sorted(rows, key=lambda r: (int(hashlib.md5(f"{r[0]}|key".encode()).hexdigest()[:8], 16), r[0]))
    x = np.array([np.nan if r[col] is None else r[col] for r in place])
    y = np.array([r[4] for r in place])
    has = ~np.isnan(x)
    if method == "spearman":
        rank = lambda z: np.array([(z < v).sum() + ((z == v).sum() + 1) / 2 for v in z])
        x[has], y = rank(x[has]), rank(y)
    f = (lambda a, b: brute_tau(list(zip(a, b)))) if method == "kendall" else (lambda a, b: np.corrcoef(a, b)[0, 1])
    r = f(x[has], y[has])
    to = perm.permuted(np.arange(len(y)), perm.round_keys(seed, n_perm), len(y))
    t = np.array([f(x[has], y[to[:, b]][has]) for b in range(n_perm)])
    hit = {"two-sided": np.abs(t) >= abs(r) - 1e-12, "greater": t >= r - 1e-12, "less": -t >= -r - 1e-12}[alternative]
    return r, (1 + hit.sum()) / (n_perm + 1)


@pytest.mark.parametrize("method, alternative", [("pearson", "two-sided"), ("pearson", "less"), ("spearman", "greater"),
                                                 ("kendall", "two-sided")])
def test_permutation_test_equals_permuted_tables(spark, method, alternative, monkeypatch):
    monkeypatch.setattr(perm, "BLOCK", 32)      # several target blocks
    rows = sample_rows()
    df = spark.createDataFrame(rows, "id long, a double, b double, flat double, y double")
    got = {r.feature: r for r in perm.permutation_test(df, "id", ["a", "b", "flat"], "y", method, 60, 9, alternative).collect()}
    for name, col in (("a", 1), ("b", 2)):
        r, p = brute_p(rows, col, method, 60, 9, alternative)
        assert got[name].r == pytest.approx(r, abs=1e-9) and got[name].p_value == pytest.approx(p)
    assert got["flat"].r is None and got["flat"].p_value is None
    assert got["b"].n == sum(r[2] is not None and r[4] is not None for r in rows)


def test_mean_difference(spark, monkeypatch):
    monkeypatch.setattr(perm, "BLOCK", 50)
    rows = sample_rows()
    df = spark.createDataFrame(rows, "id long, a double, b double, flat double, y double")
    got = {r.feature: r for r in perm.permutation_test(df, "id", ["a", "b"], "y", "mean_difference", 80, 3, "less").collect()}
    for name, col in (("a", 1), ("b", 2)):
        side = lambda c: [r[c] for r in sorted(rows, key=lambda r: str(r[0])) if r[c] is not None]
        x, y = side(col), side(4)
        pool = np.array(x + y)
        to = perm.permuted(np.arange(len(pool)), perm.round_keys(3, 80), len(pool))
        t = np.array([pool[to[:len(x), b]].sum() / len(x) - (pool.sum() - pool[to[:len(x), b]].sum()) / len(y) for b in range(80)])
        r = np.mean(x) - np.mean(y)
        assert got[name].r == pytest.approx(r) and got[name].n == len(x)
        assert got[name].p_value == pytest.approx((1 + (-t >= -r - 1e-12).sum()) / 81)


def test_permutation_arguments(spark, monkeypatch):
    df = spark.createDataFrame(sample_rows(), "id long, a double, b double, flat double, y double")
    with pytest.raises(ValueError):
        perm.permutation_test(df, "id", ["a"], "y", "distance")
    with pytest.raises(ValueError):
        perm.permutation_test(df, "id", ["a"], "y", alternative="both")
    monkeypatch.setattr(perm, "MOST_KENDALL", 10)
    with pytest.raises(ValueError):
        perm.permutation_test(df, "id", ["a"], "y", "kendall")


@pytest.mark.parametrize("values", [5, None])
def test_permuted_tau_of_few_and_many_values(monkeypatch, values):
    monkeypatch.setattr(perm, "WALKED", 64)
    rng = np.random.default_rng(4)
    n = 700
    x, v = (rng.integers(0, values, (2, n)) if values else rng.normal(size=(2, n))).astype(float)
    has = np.flatnonzero(rng.random(n) < 0.9)
    keys = perm.round_keys(2, 6)
    got = list(perm._permuted_tau(has, x[has], v, keys))
    to = perm.permuted(has, keys, n)
    want = [brute_tau(list(zip(x[has], v[to[:, b]]))) for b in range(1)]
    assert got[:1] == pytest.approx(want, abs=1e-12) and len(got) == 6


def test_kendall_permutations_of_more_than_a_million_rows(spark):
    n = (1 << 20) + 50
    df = spark.range(n).select("id", (F.col("id") % 7).alias("a"), F.expr("id * 7919 % 1009 % 2").alias("y"))
    got = perm.permutation_test(df, "id", ["a"], "y", "kendall", n_perm=3).first()
    assert got.n == n and abs(got.r) < 0.01 and got.p_value in (0.25, 0.5, 0.75, 1.0)
